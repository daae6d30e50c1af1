"""Composite preparation plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelpool.config import (
    DATA_PERCENTAGES, INITIAL_LABELED_FRACTION, RANDOM_SEED, TRAIN_FRACTION,
)
from labelpool.operators.pool import (
    assemble_features, cast_pool, feature_columns, init_state, standardize,
)
from labelpool.operators.sampling import (
    assign_dense_ids, nested_subsets, split_flag, stratified_sample, train_test_split,
)
from labelpool.session import ensure_checkpoint_dir


def pool_partitions(spark: SparkSession, n_rows: int, n_features: int) -> int:
    """Partitions for a pool, from its counted rows: their bytes over Spark's
    advisory partition size, but enough to use the cores on small pools. An
    explicit repartition is not resized by AQE, so the count must fit."""
    target = _bytes(spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64m"))
    few = min(spark.sparkContext.defaultParallelism, -(-n_rows // 5_000))
    return max(1, few, -(-n_rows * (8 * n_features + 48) // max(target, 1)))


def _bytes(text: str) -> int:
    units = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
    t = text.strip().lower().rstrip("b")
    return int(float(t[:-1]) * units[t[-1]]) if t and t[-1] in units else int(t)


def prepare_pool(raw: DataFrame, train_fraction: float = TRAIN_FRACTION,
                 init_fraction: float = INITIAL_LABELED_FRACTION, seed: int = RANDOM_SEED,
                 id_col: str = "id_sample", feature_type: str = "float",
                 partitions: int | None = None,
                 null_policy: str = "error", cache: bool = True) -> tuple[DataFrame, DataFrame]:
    """Raw pool → ``(train, test)`` ready for the loop.

    cast → assemble → hash-partition by id → hash split → scale (fit on
    train only) → initial L/U state. ``null_policy`` is ``error`` (a null or
    NaN feature fails the job) or ``skip`` (such rows are dropped). The hash partitioning spreads
    single-file inputs over all cores for the iterative fits and leaves the
    pool partitioned by id for the label-flip joins of later rounds.
    """
    spark = raw.sparkSession
    if null_policy not in ("error", "skip"):
        raise ValueError(f"unknown null policy {null_policy!r}")
    df = cast_pool(raw, id_col=id_col, feature_type=feature_type,
                   policy="skip" if null_policy == "skip" else "keep")
    feats = feature_columns(df)
    # null / NaN features: 'error' fails the job (the published default), 'skip' drops the row
    df = assemble_features(df, feats, handle_invalid=null_policy)
    source = df
    if cache:
        # computed once: the row count, then the repartitioned pool read it
        source = df.persist(StorageLevel.MEMORY_AND_DISK)
    n_parts = partitions or pool_partitions(spark, source.count(), len(feats))
    df = source.repartition(n_parts, id_col)
    if cache:
        # the scaler fit, the train side and the test side all read it
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        df.count()
        source.unpersist()
    train, test = train_test_split(df, train_fraction, seed, id_col)
    train, test = standardize(train, test)
    train = init_state(train, init_fraction, seed, id_col)
    return train, test


def prepare_subsets(raw: DataFrame, n_target: int | None = None, id_col: str = "source_id",
                    label_col: str = "label", seed: int = RANDOM_SEED,
                    percentages: Sequence[int] = DATA_PERCENTAGES) -> DataFrame:
    """Data preparation: stratified sample of ``n_target`` rows → seeded
    shuffle with dense ids ``id_sample`` = 0..m-1 → nested membership rows
    ``(percentage_set, id_sample, …)``; :func:`write_subsets` writes them all."""
    raw = raw.persist(StorageLevel.MEMORY_AND_DISK)
    n_rows = raw.count()
    if n_target is None:
        n_target = n_rows
    if n_target > n_rows:
        raw.unpersist()
        raise ValueError(f"requested sample ({n_target:,}) is larger than the data ({n_rows:,})")
    sample = stratified_sample(raw, n_target, label_col, id_col, seed, n_rows=n_rows) if n_target < n_rows else raw
    # the sample is written once to the shared folder: its source is read in one scan
    ensure_checkpoint_dir(raw.sparkSession)
    kept = sample.checkpoint()
    raw.unpersist()
    m = kept.count()
    return nested_subsets(assign_dense_ids(kept, id_col, "id_sample", seed, n_rows=m), m, "id_sample", percentages)


def write_subsets(subsets: DataFrame, path: str, fmt: str = "csv") -> None:
    """All subsets of one preparation in one write, a folder for each:
    ``percentage_set=10`` and so on."""
    w = subsets.write.mode("overwrite").partitionBy("percentage_set")
    w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path)


def split_label(id_col: str = "id_sample", train_fraction: float = TRAIN_FRACTION,
                seed: int = RANDOM_SEED):
    """'train' / 'test' label of the seeded hash split."""
    return F.when(split_flag(id_col, train_fraction, seed), F.lit("train")).otherwise(F.lit("test"))
