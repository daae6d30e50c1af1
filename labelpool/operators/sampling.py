"""Seeded, layout-independent sampling: split, strata, shuffle ids, subsets,
random batches. All decisions are functions of (seed, purpose, id), so the
result is the same for 1 or 1,000 partitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelpool.config import BROADCAST_MAX_ROWS, DATA_PERCENTAGES
from labelpool.functions.hashing import hash_below, seeded_hash
from labelpool.operators.cutoff import dense_ids, select_smallest
from labelpool.operators.labels import apply_labels
from labelpool.operators.pool import unlabeled_rows


def split_flag(id_col: str = "id_sample", train_fraction: float = 0.7, seed: int = 42):
    """Column: true for the train side of the seeded hash split."""
    return hash_below(id_col, train_fraction, "split", seed)


def train_test_split(df: DataFrame, train_fraction: float = 0.7, seed: int = 42,
                     id_col: str = "id_sample") -> tuple[DataFrame, DataFrame]:
    """Seeded 70/30 split by hash of the id: two narrow filters, no shuffle."""
    flag = split_flag(id_col, train_fraction, seed)
    return df.filter(flag), df.filter(~flag)


def class_quotas(df: DataFrame, n_target: int, label_col: str = "label") -> DataFrame:
    """Per-class quota ``round_half_even(N · n_c / n)`` (may not sum to N
    exactly, as with Python's ``round``). One row per class."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("_lp_nc"))
    total = F.lit(df.count())
    return counts.select(
        label_col,
        F.bround(F.lit(float(n_target)) * F.col("_lp_nc") / total, 0).cast("bigint").alias("quota"),
    )


def stratified_sample(df: DataFrame, n_target: int, label_col: str = "label",
                      id_col: str = "id_sample", seed: int = 42,
                      n_rows: int | None = None) -> DataFrame:
    """Exactly ``quota_c`` rows of each class, the ones with the smallest
    seeded hash. Raises if more rows are requested than exist."""
    if n_rows is None:
        n_rows = df.count()
    if n_target > n_rows:
        raise ValueError(f"requested sample ({n_target:,}) is larger than the data ({n_rows:,})")
    quotas = class_quotas(df, n_target, label_col)
    small = quotas.count() <= BROADCAST_MAX_ROWS  # else a shuffled join, which AQE splits
    tagged = (df.join(F.broadcast(quotas) if small else quotas, label_col)
              .withColumn("_lp_h", seeded_hash(id_col, "stratify", seed)))
    picked = select_smallest(tagged, "_lp_h", id_col, "quota", by=[label_col])
    return picked.drop("quota", "_lp_h")


def assign_dense_ids(df: DataFrame, id_col: str, out: str = "id_sample",
                     seed: int = 42, n_rows: int | None = None) -> DataFrame:
    """Shuffle all rows by seeded hash and number them ``0..n-1`` in that
    order (a global shuffle + ``range(n)`` without a global sort)."""
    tagged = df.withColumn("_lp_h", seeded_hash(id_col, "shuffle", seed))
    return dense_ids(tagged, "_lp_h", id_col, out, n=n_rows).drop("_lp_h")


def subset_cut(n_rows: int, pct: int) -> int:
    """Rows in the ``pct`` % subset: Python's half-to-even ``round``."""
    return round(n_rows * pct / 100)


def nested_subsets(df: DataFrame, n_rows: int, dense_col: str = "id_sample",
                   percentages: Sequence[int] = DATA_PERCENTAGES) -> DataFrame:
    """Membership rows ``(percentage_set, ...)``: a row is in the p % subset
    iff its dense id is below ``round(n · p / 100)``, so 10 ⊂ 20 ⊂ … ⊂ 100."""
    cuts = F.array(*[F.struct(F.lit(int(p)).alias("p"), F.lit(subset_cut(n_rows, p)).alias("cut"))
                     for p in percentages])
    return (df.withColumn("_lp_cut", F.explode(cuts))
            .filter(F.col(dense_col) < F.col("_lp_cut.cut"))
            .withColumn("percentage_set", F.col("_lp_cut.p"))
            .drop("_lp_cut"))


def random_batch(pool: DataFrame, budget: int, seed: int = 42, round_no: int = 0,
                 id_col: str = "id_sample", state_col: str = "state") -> DataFrame:
    """Exactly ``min(budget, |U|)`` unlabelled ids, the smallest by
    hash(seed, round, id): a fresh, layout-independent draw every round."""
    u = unlabeled_rows(pool, state_col).select(id_col)
    if budget <= 0:
        return u.filter(F.lit(False))
    tagged = u.withColumn("_lp_h", seeded_hash(id_col, "random", seed, round_no))
    return select_smallest(tagged, "_lp_h", id_col, int(budget)).select(id_col)


def random_selection(pool: DataFrame, budget: int, seed: int = 42, round_no: int = 0,
                     id_col: str = "id_sample", state_col: str = "state") -> DataFrame:
    """Random baseline: flip a random batch of ``budget`` U rows to L."""
    picked = random_batch(pool, budget, seed, round_no, id_col, state_col)
    return apply_labels(pool, picked, id_col=id_col, n_arrivals=max(int(budget), 0),
                        state_col=state_col)
