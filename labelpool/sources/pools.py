"""Learning pools derived from the given tables.

Each pool has the prepared-dataset layout ``id_sample, label, feature_1..n``
(or an ``embedding`` array for the vector pool) and is read straight from
Parquet, so Catalyst prunes columns and pushes filters into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the pools (FIXTURES.md §2).
ORDER_REVENUE_CUT = 200000.0      # P1 label: order revenue above this
EVENT_POSITIVE_TYPE = "purchase"  # P2 label
VECTOR_POSITIVE_BELOW = 5         # P3 label: class id below this


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1: one row per order from ``lineitem``.

    feature_1 = number of lines, feature_2 = sum of quantity,
    feature_3 = mean discount, feature_4 = max extended price;
    label = 1 when sum(price * (1 - discount)) > 200000.
    The group-by is a partial + final hash aggregate on ``l_orderkey``.
    """
    li = _table(spark, sf_dir, "lineitem")
    agg = li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum("l_quantity").alias("sum_qty"),
        F.avg("l_discount").alias("avg_disc"),
        F.max("l_extendedprice").alias("max_price"),
        F.sum(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("revenue"),
    )
    return agg.select(
        F.col("l_orderkey").cast("bigint").alias("id_sample"),
        (F.col("revenue") > F.lit(ORDER_REVENUE_CUT)).cast("int").alias("label"),
        F.col("n_lines").cast("double").alias("feature_1"),
        F.col("sum_qty").cast("double").alias("feature_2"),
        F.col("avg_disc").cast("double").alias("feature_3"),
        F.col("max_price").cast("double").alias("feature_4"),
    )


def order_pool_sql() -> str:
    return f"""
        SELECT CAST(l_orderkey AS BIGINT) AS id_sample,
               CAST(sum(l_extendedprice * (1 - l_discount)) > {ORDER_REVENUE_CUT} AS INTEGER) AS label,
               CAST(count(*) AS DOUBLE) AS feature_1,
               CAST(sum(l_quantity) AS DOUBLE) AS feature_2,
               CAST(avg(l_discount) AS DOUBLE) AS feature_3,
               CAST(max(l_extendedprice) AS DOUBLE) AS feature_4
        FROM lineitem GROUP BY l_orderkey"""


def event_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P2: one row per event; feature_1 = value, feature_2 = hour(ts),
    feature_3 = integer ``k`` of the JSON ``props``; label = purchase."""
    ev = _table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").cast("bigint").alias("id_sample"),
        (F.col("event_type") == F.lit(EVENT_POSITIVE_TYPE)).cast("int").alias("label"),
        F.col("value").cast("double").alias("feature_1"),
        F.hour("ts").cast("double").alias("feature_2"),
        F.get_json_object("props", "$.k").cast("int").cast("double").alias("feature_3"),
        F.col("event_type"),
    )


def event_pool_sql() -> str:
    return f"""
        SELECT CAST(event_id AS BIGINT) AS id_sample,
               CAST(event_type = '{EVENT_POSITIVE_TYPE}' AS INTEGER) AS label,
               CAST(value AS DOUBLE) AS feature_1,
               CAST(hour(ts) AS DOUBLE) AS feature_2,
               CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) AS DOUBLE) AS feature_3,
               event_type
        FROM events"""


def vector_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P3: ``embeddings`` as ``id_sample, label (class < 5), class_id, embedding``."""
    em = _table(spark, sf_dir, "embeddings")
    return em.select(
        F.col("vec_id").cast("bigint").alias("id_sample"),
        (F.col("label") < F.lit(VECTOR_POSITIVE_BELOW)).cast("int").alias("label"),
        F.col("label").cast("int").alias("class_id"),
        F.col("embedding"),
    )


def run_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timing-run table derived from ``events`` (FIXTURES.md §3): one
    measurement per event with method = event type, cores = 1 + id % 4,
    percentage_set = 10 (1 + user % 5), time = value."""
    ev = _table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_type").alias("method"),
        (F.lit(10) * (F.lit(1) + F.pmod(F.col("user_id"), F.lit(5)))).cast("int").alias("percentage_set"),
        (F.lit(1) + F.pmod(F.col("event_id"), F.lit(4))).cast("int").alias("cores"),
        F.col("value").cast("double").alias("time"),
    )


def run_table_sql() -> str:
    return """
        SELECT event_type AS method,
               CAST(10 * (1 + user_id % 5) AS INTEGER) AS percentage_set,
               CAST(1 + event_id % 4 AS INTEGER) AS cores,
               CAST(value AS DOUBLE) AS time
        FROM events"""
