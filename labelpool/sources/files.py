"""File sources and sinks with explicit schemas (no inference pass)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_FEATURE = re.compile(r"feature_\d+")


def feature_names(n: int, prefix: str = "feature_") -> list[str]:
    """``feature_1 .. feature_n`` — names generated from the column count."""
    return [f"{prefix}{i}" for i in range(1, n + 1)]


def pool_schema(n_features: int, feature_type: T.DataType = T.DoubleType()) -> T.StructType:
    return T.StructType(
        [T.StructField("id_sample", T.LongType()), T.StructField("label", T.IntegerType())]
        + [T.StructField(c, feature_type) for c in feature_names(n_features)]
    )


def load_pool(spark: SparkSession, path: str, n_features: int | None = None,
              fmt: str = "csv", sep: str = ",") -> DataFrame:
    """Load a prepared dataset ``id_sample, label, feature_1..n``.

    CSV columns are matched by the header's names, in any order; other columns
    are carried through as strings. Values that do not parse become null rather
    than failing the scan (:func:`labelpool.operators.pool.cast_pool` applies the
    null policy). ``n_features`` limits the features to the first so many.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    header = spark.read.option("header", True).option("sep", sep).csv(path).columns
    known = {f.name: f.dataType for f in pool_schema(0).fields}
    typed = T.StructType([T.StructField(c, known.get(c, T.DoubleType() if _FEATURE.fullmatch(c) else T.StringType())) for c in header])
    df = spark.read.schema(typed).option("header", True).option("enforceSchema", False).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    if n_features is not None:
        wanted = set(feature_names(n_features))
        df = df.select(*(c for c in header if c in wanted or not _FEATURE.fullmatch(c)))
    return df


def read_headerless_csv(spark: SparkSession, path: str, n_features: int,
                        partitions: int | None = None) -> DataFrame:
    """Raw headerless CSV (column 0 = label, then n features), names generated.

    A gzip file is a single split; ``partitions`` spreads it for later stages, by a
    shuffle on every use. :func:`stage_headerless_csv` decodes it once instead.
    """
    schema = T.StructType([T.StructField("label", T.DoubleType())]
                          + [T.StructField(c, T.DoubleType()) for c in feature_names(n_features)])
    df = spark.read.schema(schema).option("header", False).csv(path)
    if partitions:
        df = df.repartition(partitions)
    return df


def stage_headerless_csv(spark: SparkSession, path: str, out: str, n_features: int,
                         rows_per_file: int = 1_000_000) -> DataFrame:
    """Decode headerless CSV once into Parquet files under ``out`` and return their rows.

    Each input split is written as it is read, in files of at most ``rows_per_file``
    rows, so that nothing is shuffled or held; a gzip file is still decoded by one task.
    Later scans read its files in parallel, with columns pruned and filters pushed down.
    What ``out`` held before is replaced.
    """
    raw = read_headerless_csv(spark, path, n_features)
    raw.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(out)
    return spark.read.schema(raw.schema).parquet(out)


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a table (CSV with header, or Parquet)."""
    w = df.write.mode(mode)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def append_results(df: DataFrame, path: str, fmt: str = "csv", run_id: str | None = None) -> None:
    """Append result rows; every CSV part file carries its own header, which
    the reader skips, so the header is never duplicated into the data.

    With ``run_id``, or with a ``run_id`` column and ``run_id=""``, the rows are the
    partitions of their runs: written again, a run replaces its own rows and no others,
    so a retried append changes nothing. A table is kept in one of the two ways.
    """
    if run_id is None:
        write_table(df, path, fmt=fmt, mode="append")
        return
    if run_id:
        df = df.withColumn("run_id", F.lit(run_id))
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


RUN_SCHEMA = T.StructType([
    T.StructField("method", T.StringType()), T.StructField("percentage_set", T.IntegerType()),
    T.StructField("cores", T.IntegerType()), T.StructField("time", T.DoubleType()),
])
RUN_ID_SCHEMA = T.StructType([T.StructField("run_id", T.StringType()), *RUN_SCHEMA.fields])
CURVE_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("method", T.StringType()), T.StructField("round", T.IntegerType()),
    T.StructField("labeled_percentage", T.DoubleType()), T.StructField("labeled_count", T.LongType()),
    T.StructField("accuracy", T.DoubleType()), T.StructField("dataset_percentage", T.IntegerType()),
])


def read_results(spark: SparkSession, path: str, schema: T.StructType = RUN_SCHEMA,
                 fmt: str = "csv") -> DataFrame:
    """Read a result table (timing runs or a learning curve). ``schema`` names the columns
    and their order; add ``run_id`` to it to read the runs of a table kept by run."""
    if fmt == "parquet":
        df = spark.read.schema(schema).parquet(path)
    else:
        df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*schema.names)
