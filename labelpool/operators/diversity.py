"""Diversity: cluster the candidates, take the row nearest each centroid."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelpool.config import BROADCAST_MAX_BYTES, KMEANS_MAX_ITER
from labelpool.functions.scoring import squared_distance
from labelpool.operators.bisect import bisect_cells, cell_centers
from labelpool.operators.labels import apply_labels


def cluster_candidates(cands: DataFrame, k: int, max_iter: int = KMEANS_MAX_ITER, features: str = "features",
                       out: str = "cluster_id", id_col: str = "id_sample") -> DataFrame:
    """Every candidate with its cluster, by bisecting k-means with exactly
    ``k`` clusters (fewer only when there are fewer distinct vectors)."""
    return bisect_cells(cands, k, id_col, features, max_iter).withColumnRenamed("cell", out)


def centers_bytes(centers: DataFrame) -> int:
    """Size of a centre table: rows × dimension × 8 (one small aggregate)."""
    row = centers.agg(F.count(F.lit(1)).alias("k"), F.max(F.size("center")).alias("d")).first()
    return int(row["k"] or 0) * int(row["d"] or 0) * 8


def with_distance(points: DataFrame, centers: DataFrame, vec: str = "features",
                  cluster_col: str = "cluster_id", out: str = "distance",
                  center_bytes: int | None = None) -> DataFrame:
    """Squared distance of each point to its own centre (a native
    ``zip_with``/``aggregate`` expression). The centre table is broadcast
    when its k × d doubles are under ``BROADCAST_MAX_BYTES``; larger ones join
    by cluster id instead."""
    dtype = dict(points.dtypes)[vec]
    arr = vector_to_array(F.col(vec)) if dtype == "vector" else F.col(vec)
    if center_bytes is None:
        center_bytes = centers_bytes(centers)
    side = centers.withColumnRenamed("cluster_id", cluster_col)
    if center_bytes <= BROADCAST_MAX_BYTES:
        side = F.broadcast(side)
    return (points.join(side, cluster_col)
            .withColumn(out, squared_distance(arr, F.col("center")))
            .drop("center"))


def nearest_to_centroid(points: DataFrame, centers: DataFrame, id_col: str = "id_sample",
                        vec: str = "features", cluster_col: str = "cluster_id",
                        center_bytes: int | None = None) -> DataFrame:
    """Per cluster, the row with the smallest squared distance to the centre
    (equal distances → smaller id): ``(cluster_id, id, distance)``.

    ``min(struct(distance, id))`` is a partial + final aggregate: each task
    keeps one row per cluster before the shuffle, so a cluster holding a
    third of the rows costs no more than any other.
    """
    d = with_distance(points, centers, vec, cluster_col, center_bytes=center_bytes)
    best = d.groupBy(cluster_col).agg(F.min(F.struct(F.col("distance"), F.col(id_col))).alias("_lp_m"))
    return best.select(cluster_col, F.col(f"_lp_m.{id_col}").alias(id_col),
                       F.col("_lp_m.distance").alias("distance"))


def diverse_batch(spark: SparkSession, cands: DataFrame, budget: int, id_col: str = "id_sample",
                  features: str = "features", max_iter: int = KMEANS_MAX_ITER) -> DataFrame:
    """Ids of a diverse batch: ``budget`` clusters of the candidates, the row
    nearest to each cluster's mean. Fewer rows only when there are fewer
    distinct vectors. The ids are cached; the caller releases them."""
    if budget <= 0:
        return cands.select(id_col).filter(F.lit(False))
    clustered = cluster_candidates(cands, budget, max_iter, features, "cell", id_col)
    centers = cell_centers(clustered, features)
    picked = nearest_to_centroid(clustered.withColumnRenamed("cell", "cluster_id"), centers, id_col, features).select(id_col)
    picked = picked.persist(StorageLevel.MEMORY_AND_DISK)
    picked.count()
    return picked


def diversity_selection(spark: SparkSession, cands: DataFrame, pool: DataFrame, budget: int,
                        id_col: str = "id_sample", features: str = "features") -> DataFrame:
    """Cluster the candidates, pick the nearest row per cluster, flip them to L."""
    picked = diverse_batch(spark, cands, budget, id_col, features)
    return apply_labels(pool, picked, id_col=id_col, n_arrivals=max(int(budget), 0))
