"""Uncertainty scoring and the candidate cut."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelpool.config import RANDOM_SEED, SKETCH_ROWS_FACTOR, UNCERTAINTY_CANDIDATE_FACTOR, UNCERTAINTY_QUANTILE_EPSILON
from labelpool.functions.hashing import seeded_hash
from labelpool.functions.scoring import binary_uncertainty
from labelpool.operators.cutoff import exact_quantile, select_smallest
from labelpool.operators.pool import unlabeled_rows


def score_pool(model, df: DataFrame, probability: str = "probability",
               out: str = "uncertainty") -> DataFrame:
    """Apply a fitted probabilistic classifier and add ``p1`` = P(y=1) and
    the binary uncertainty ``1 - 2|p1 - 0.5|`` (JVM-side vector access)."""
    scored = model.transform(df)
    return (scored.withColumn("p1", vector_to_array(F.col(probability))[1])
            .withColumn(out, binary_uncertainty(F.col("p1"))))


def keep_fraction(budget: int, n_unlabeled: int,
                  alpha: float = UNCERTAINTY_CANDIDATE_FACTOR) -> float:
    """Share of U kept as candidates: ``min(1, alpha·B / |U|)``."""
    return min(1.0, (alpha * budget) / n_unlabeled)


def uncertainty_threshold(scored: DataFrame, budget: int, n_unlabeled: int,
                          alpha: float = UNCERTAINTY_CANDIDATE_FACTOR,
                          epsilon: float = UNCERTAINTY_QUANTILE_EPSILON,
                          col: str = "uncertainty", id_col: str = "id_sample",
                          seed: int = RANDOM_SEED) -> float | None:
    """The (1 - p)-quantile of the uncertainty, p = keep fraction.

    ``epsilon > 0``: :func:`sampled_quantile`, over a sample whose size depends on
    ``epsilon`` only. ``epsilon == 0``: exact, by bucketed counting
    (:mod:`labelpool.operators.cutoff`), never by an exact sketch whose size grows
    with the data. ``None`` for an empty U.
    """
    if n_unlabeled <= 0 or budget <= 0:
        return None
    q = 1.0 - keep_fraction(budget, n_unlabeled, alpha)
    if epsilon == 0:
        return exact_quantile(scored, col, q, id_col, n=n_unlabeled)
    return sampled_quantile(scored, col, q, epsilon, id_col, n=n_unlabeled, seed=seed)


def sketch_rows(epsilon: float) -> int:
    """Rows of a uniform sample whose quantiles miss the true rank by ``epsilon`` or less
    at four standard deviations at the median, at more towards the ends."""
    return math.ceil(SKETCH_ROWS_FACTOR / (epsilon * epsilon))


def sampled_quantile(scored: DataFrame, col: str, q: float, epsilon: float, id_col: str = "id_sample",
                     n: int | None = None, seed: int = RANDOM_SEED) -> float | None:
    """The q-quantile of a bottom-k sketch: of the k rows with the smallest seeded hash of
    their ids (ties: smaller id), k = :func:`sketch_rows`.

    The sketch is a uniform sample that any layout, and SQL, gives alike. Its rows are
    found by counting per hash bucket and stay in Spark. A table of up to k rows is its
    own sketch, so the quantile is exact there."""
    rows = scored.filter(F.col(col).isNotNull())
    if n is None:
        n = rows.count()
    k = sketch_rows(epsilon)
    if n <= k:
        return exact_quantile(rows, col, q, id_col, n=n)
    hashed = rows.select(id_col, col).withColumn("_lp_h", seeded_hash(id_col, "sketch", seed))
    sample = select_smallest(hashed, "_lp_h", id_col, k).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return exact_quantile(sample, col, q, id_col, n=k)
    finally:
        sample.unpersist()


def uncertainty_candidates(scored: DataFrame, threshold: float, id_col: str = "id_sample",
                           features: str | None = "features", col: str = "uncertainty") -> DataFrame:
    """Rows with ``uncertainty >= threshold`` (ties kept), pruned to
    ``id, [features,] uncertainty``."""
    keep = [id_col] + ([features] if features else []) + [col]
    return scored.select(*keep).filter(F.col(col) >= F.lit(float(threshold)))


def get_uncertainty_candidates(pool: DataFrame, model, budget: int, n_unlabeled: int,
                               alpha: float = UNCERTAINTY_CANDIDATE_FACTOR,
                               epsilon: float = UNCERTAINTY_QUANTILE_EPSILON,
                               id_col: str = "id_sample", features: str = "features",
                               state_col: str = "state", mode: str = "quantile") -> DataFrame:
    """Score U and keep about ``alpha·B`` candidates: ``quantile`` cuts at
    the (1 - p)-quantile (ties kept); ``topk`` keeps exactly the
    ``int(alpha·B)`` most uncertain rows (ties → smaller id)."""
    scored = score_pool(model, unlabeled_rows(pool, state_col).select(id_col, features))
    # scored once: the cut and the final filter both read it; the caller may unpersist the result
    scored = scored.select(id_col, features, "uncertainty").persist(StorageLevel.MEMORY_AND_DISK)
    if mode == "topk":
        keep = scored
        return topk_uncertain(keep, int(alpha * budget), id_col) if budget > 0 else keep.filter(F.lit(False))
    if mode != "quantile":
        raise ValueError(f"unknown candidate mode {mode!r}")
    t = uncertainty_threshold(scored, budget, n_unlabeled, alpha, epsilon, id_col=id_col)
    if t is None:
        return scored.filter(F.lit(False))
    return uncertainty_candidates(scored, t, id_col, features)


def topk_uncertain(scored: DataFrame, k: int, id_col: str = "id_sample",
                   col: str = "uncertainty") -> DataFrame:
    """Exactly the k most uncertain rows (ties → smaller id), found by
    bucketed counting rather than one ``k``-row merge task."""
    return select_smallest(scored, -F.col(col), F.col(id_col), int(k))
