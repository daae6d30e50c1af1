"""Training, one active-learning round, and the multi-round loop."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelpool.config import (
    INITIAL_LABELED_FRACTION, QUERY_BATCH_FRACTION, RANDOM_SEED,
    UNCERTAINTY_CANDIDATE_FACTOR, UNCERTAINTY_QUANTILE_EPSILON, FIT_PARTITION_BYTES,
)
from labelpool.operators.diversity import diverse_batch
from labelpool.operators.labels import apply_labels
from labelpool.operators.logistic import ReweightedLogistic
from labelpool.operators.pool import labeled_rows, state_counts
from labelpool.operators.sampling import random_batch
from labelpool.operators.uncertainty import get_uncertainty_candidates
from labelpool.plans.store import PoolState
from labelpool.sources.files import CURVE_SCHEMA
from labelpool.session import ensure_checkpoint_dir, small_frame


def default_estimator():
    """Logistic regression without a penalty, by reweighted least squares."""
    return ReweightedLogistic(label="label", features="features")


def train_and_evaluate(pool: DataFrame, test: DataFrame, estimator=None,
                       metric: str = "accuracy", state_col: str = "state",
                       n_labeled: int | None = None):
    """Fit on the labelled rows, evaluate on the test set with any metric of
    Spark's multiclass evaluator. Returns ``(model, value)``.

    With ``n_labeled`` known, the labelled rows are filtered at the pool's full
    parallelism and then dealt into partitions sized by their bytes, so a small
    L does not pay for every pool partition on each optimizer pass."""
    est = estimator if estimator is not None else default_estimator()
    if n_labeled == 0:
        raise ValueError("no labelled rows to train on")
    fit_input = labeled_rows(pool, state_col)
    if n_labeled is not None:
        fit_input = fit_input.select("label", "features").repartition(fit_partitions(fit_input, n_labeled))
    model = est.fit(fit_input)
    pred = model.transform(test)
    value = MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction",
                                              metricName=metric).evaluate(pred)
    return model, value


def fit_partitions(rows: DataFrame, n_rows: int, features: str = "features") -> int:
    """Partitions of about FIT_PARTITION_BYTES for ``n_rows`` rows of a vector column."""
    one = rows.select(F.size(vector_to_array(F.col(features)))).first()
    return max(1, -(-n_rows * ((one[0] if one else 0) * 8 + 48) // FIT_PARTITION_BYTES))


def query_budget(train_size: int, n_unlabeled: int, fraction: float = QUERY_BATCH_FRACTION) -> int:
    """``B = int(n_train · fraction)``, never more than the unlabelled rows."""
    return min(int(train_size * fraction), n_unlabeled)


@dataclass
class Params:
    seed: int = RANDOM_SEED
    alpha: float = UNCERTAINTY_CANDIDATE_FACTOR
    epsilon: float = UNCERTAINTY_QUANTILE_EPSILON
    batch_fraction: float = QUERY_BATCH_FRACTION
    metric: str = "accuracy"
    checkpoint_every: int = 1
    compact_every: int = 10
    candidates: str = "quantile"   # or "topk": exactly int(alpha * B) most uncertain


def smart_batch(spark, pool, model, budget, n_unlabeled, round_no, p: Params) -> DataFrame:
    """Ids of the uncertainty-filtered, cluster-diverse batch."""
    cands = get_uncertainty_candidates(pool, model, budget, n_unlabeled, p.alpha, p.epsilon,
                                       mode=p.candidates)
    try:
        return diverse_batch(spark, cands, budget)
    finally:
        cands.unpersist()


def random_batch_ids(spark, pool, model, budget, n_unlabeled, round_no, p: Params) -> DataFrame:
    """Ids of a random batch, a fresh seeded draw per round."""
    return random_batch(pool, budget, p.seed, round_no)


STRATEGIES: dict[str, Callable[..., DataFrame]] = {"smart": smart_batch, "random": random_batch_ids}


def strategy(name: str) -> Callable[..., DataFrame]:
    try:
        return STRATEGIES[name]
    except KeyError:
        raise ValueError(f"unknown strategy {name!r}; known: {sorted(STRATEGIES)}") from None


def counts(pool: DataFrame) -> tuple[int, int]:
    row = state_counts(pool).first()
    return int(row["labeled"]), int(row["unlabeled"])


def settle(new_pool: DataFrame, old_pool: DataFrame | None, checkpoint: bool) -> DataFrame:
    """Make the new pool the cached state: persist → (checkpoint →) action →
    release the old one.

    The flip is computed once, into the cache; the reliable checkpoint in
    ``spark.checkpoint.dir`` is then written from that cache and cuts the
    lineage, so a lost executor re-reads round state from the shared folder
    instead of replaying every earlier round. The old pool is released only
    after the new one is materialised, or it would be recomputed."""
    new_pool = new_pool.persist(StorageLevel.MEMORY_AND_DISK)
    if checkpoint:
        ensure_checkpoint_dir(new_pool.sparkSession)
        ck = new_pool.checkpoint(eager=True).persist(StorageLevel.MEMORY_AND_DISK)
        ck.count()
        new_pool.unpersist()
        new_pool = ck
    else:
        new_pool.count()
    if old_pool is not None:
        old_pool.unpersist()
    return new_pool


@dataclass
class RoundResult:
    pool: DataFrame
    accuracy: float
    budget: int
    labeled: int
    unlabeled: int
    seconds: float = 0.0
    extra: dict = field(default_factory=dict)


def _flip(spark, state, pool_df, batch, budget, round_no, checkpoint):
    """Fold a batch of ids into the state; returns the new pool frame."""
    if isinstance(state, PoolState):
        state.add(batch, round_no)
        return state.frame()
    new = apply_labels(pool_df, batch, n_arrivals=max(int(budget), 0))
    return settle(new, pool_df, checkpoint)


def active_round(spark: SparkSession, pool: DataFrame | PoolState, test: DataFrame,
                 method: str = "smart", round_no: int = 1, estimator=None,
                 params: Params | None = None, labeled: int | None = None,
                 unlabeled: int | None = None, checkpoint: bool = True) -> RoundResult:
    """One round: fit + test evaluation → budget → select → flip → recount.

    ``pool`` is a :class:`PoolState` (bucketed tables; the flip appends the
    batch ids) or a DataFrame with a ``state`` column (the flip is a join,
    then persist + reliable checkpoint). Both strategies work (the published
    single-round script fails on the random one)."""
    p = params or Params()
    step = strategy(method)
    t0 = time.time()
    phases: dict[str, float] = {}
    pool_df = pool.frame() if isinstance(pool, PoolState) else pool
    if labeled is None or unlabeled is None:
        labeled, unlabeled = counts(pool_df)
    model, acc = train_and_evaluate(pool_df, test, estimator, p.metric, n_labeled=labeled)
    phases["fit_evaluate"] = time.time() - t0
    budget = query_budget(labeled + unlabeled, unlabeled, p.batch_fraction)
    if budget <= 0:
        return RoundResult(pool_df, acc, 0, labeled, unlabeled, time.time() - t0, phases)
    t1 = time.time()
    batch = step(spark, pool_df, model, budget, unlabeled, round_no, p)
    phases["select"] = time.time() - t1
    t1 = time.time()
    new_pool = _flip(spark, pool, pool_df, batch, budget, round_no, checkpoint)
    l2, u2 = counts(new_pool)
    batch.unpersist()
    phases["flip_recount"] = time.time() - t1
    return RoundResult(new_pool, acc, budget, l2, u2, time.time() - t0, phases)


def active_loop(spark: SparkSession, pool: DataFrame | PoolState, test: DataFrame, method: str = "smart",
                rounds: int = 10, estimator=None, params: Params | None = None,
                dataset_percentage: int = 100, state: str = "table", run_id: str | None = None,
                tag: str | None = None, keep_state: bool = False) -> tuple[DataFrame, DataFrame]:
    """T rounds; returns ``(final_pool, learning_curve)``. Row 0 is the model
    before any query. The curve keeps the nominal labelled percentage of the
    published workflow (5 + t · 1) and the measured labelled count.

    ``state='table'`` keeps round state in bucketed tables (:class:`PoolState`,
    no pool shuffle, O(B) written per round) and commits a record of every round;
    ``'memory'`` joins, persists and checkpoints the whole pool each
    ``checkpoint_every`` rounds. ``run_id`` tags the curve rows so reruns appended
    to one result table stay apart. What the loop caches or writes for itself is
    released; the returned final pool of the table mode is a checkpoint in the
    shared folder.

    A loop with a ``tag`` can be taken up after its driver was lost: pass
    ``PoolState.open(spark, tag)`` as the pool, and the same method and parameters.
    It goes on after the last committed round and returns the whole curve. A state
    that is passed in, or kept by ``keep_state``, stays for the caller to close."""
    p = params or Params()
    step = strategy(method)
    held = test.is_cached
    store: PoolState | None = None
    if isinstance(pool, PoolState):
        store, keep_state = pool, True
    elif state == "table":
        store = PoolState(spark, pool, tag=tag)
    elif state != "memory":
        raise ValueError(f"unknown state mode {state!r}")
    done = store.records() if store is not None else []
    if any(r["method"] != method or r["metric"] != p.metric for r in done):
        raise ValueError(f"the state's rounds were made by {done[0]['method']!r} with {done[0]['metric']!r}")
    run_id = run_id or (done[0]["run_id"] if done else uuid.uuid4().hex[:12])
    test = test if held else test.persist(StorageLevel.MEMORY_AND_DISK)
    pool_df = store.frame() if store is not None else settle(pool, None, checkpoint=False)
    labeled, unlabeled = counts(pool_df)
    train_size = labeled + unlabeled
    rows: list[tuple] = []

    def finished(t: int, nominal: float, budget: int, acc: float) -> None:
        rows.append((run_id, method, t, nominal, labeled, float(acc), dataset_percentage))
        if store is not None:
            store.commit(round=t, run_id=run_id, method=method, budget=budget, labeled=labeled, unlabeled=unlabeled, nominal=nominal,
                         metric=p.metric, value=float(acc), dataset_percentage=dataset_percentage)

    model, acc = train_and_evaluate(pool_df, test, estimator, p.metric, n_labeled=labeled)
    nominal = INITIAL_LABELED_FRACTION * 100
    if done:
        rows += [(run_id, method, r["round"], r["nominal"], r["labeled"], r["value"], r["dataset_percentage"]) for r in done]
        nominal = done[-1]["nominal"]
    else:
        finished(0, nominal, 0, acc)
    for t in range(rows[-1][2] + 1, rounds + 1):
        budget = query_budget(train_size, unlabeled, p.batch_fraction)
        if budget > 0:
            batch = step(spark, pool_df, model, budget, unlabeled, t, p)
            ck = t % max(1, p.checkpoint_every) == 0
            pool_df = _flip(spark, store if store is not None else None, pool_df, batch, budget, t, ck)
            batch.unpersist()
            if store is not None and t % max(1, p.compact_every) == 0:
                store.compact()
                pool_df = store.frame()
            labeled, unlabeled = counts(pool_df)
        model, acc = train_and_evaluate(pool_df, test, estimator, p.metric, n_labeled=labeled)
        nominal = nominal + p.batch_fraction * 100
        finished(t, nominal, budget, acc)
    if not held:
        test.unpersist()
    if store is not None:  # the final pool outlives the state's tables
        pool_df = pool_df.checkpoint()
        if not keep_state:
            store.close()
    return pool_df, small_frame(spark, rows, CURVE_SCHEMA)
