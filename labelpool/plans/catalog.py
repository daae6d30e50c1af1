"""Registered queries over the given tables, with their DuckDB oracles.

Every query reads whole tables (or data Spark derives from them). Keys with
an entry in :func:`oracle_sql` are checked value by value; the others run a
trained model and are checked by row count here and by invariants in tests.
Floating outputs are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from labelpool.config import (
    INITIAL_LABELED_FRACTION, QUERY_BATCH_FRACTION, RANDOM_SEED, TRAIN_FRACTION,
    UNCERTAINTY_CANDIDATE_FACTOR,
)
from labelpool.functions.hashing import hash_sql, hash_threshold
from labelpool.functions.scoring import binary_uncertainty, logistic
from labelpool.operators import diversity, labels, metrics, pool, runs, sampling, uncertainty
from labelpool.operators.cutoff import exact_quantile
from labelpool.operators.logistic import fit_sql
from labelpool.plans import loop, prepare
from labelpool.plans.store import PoolState
from labelpool.session import ensure_checkpoint_dir
from labelpool.sources import files, pools

SEED = RANDOM_SEED
SPLIT_CUT = hash_threshold(TRAIN_FRACTION)
STATE_CUT = hash_threshold(INITIAL_LABELED_FRACTION)
FEATS = ["feature_1", "feature_2", "feature_3", "feature_4"]
BISECT_FEATS = ("feature_1", "feature_2", "feature_3")

# Fixed values of the SQL-checkable scorer over the event pool (FIXTURES.md §3):
# p = 1 / (1 + exp(-(0.03 (value - 50) + 0.1 (hour - 12) + 0.02 (k - 50))))
FIXED_WEIGHTS = (0.03, 0.1, 0.02)
FIXED_CENTERS = (50.0, 12.0, 50.0)
# Fixed rule of the metric queries: predict 1 when the max line price > 80000.
RULE_PRICE_CUT = 80000.0
# Answers table of apply_labels: orders of this priority were labelled.
ANSWER_PRIORITY = "1-URGENT"


def _r(c: str, d: int = 6):
    return F.round(F.col(c), d).alias(c)


# ---------------------------------------------------------------- shared plans
def _order_train_state(spark: SparkSession, sf: str) -> DataFrame:
    """P1 train side with the initial L/U state."""
    p1 = pools.order_pool(spark, sf)
    train = p1.filter(sampling.split_flag("id_sample", TRAIN_FRACTION, SEED))
    return pool.init_state(train, INITIAL_LABELED_FRACTION, SEED)


def _event_state(spark: SparkSession, sf: str) -> DataFrame:
    """P2 with the fixed-weight score and an L/U state (the whole table is the
    pool); persisted, as it feeds the counts, the cut and the final filter."""
    ev = pools.event_pool(spark, sf)
    w1, w2, w3 = FIXED_WEIGHTS
    c1, c2, c3 = FIXED_CENTERS
    margin = (F.lit(w1) * (F.col("feature_1") - F.lit(c1)) + F.lit(w2) * (F.col("feature_2") - F.lit(c2))
              + F.lit(w3) * (F.col("feature_3") - F.lit(c3)))
    p = F.round(logistic(margin), 6)
    scored = ev.select("id_sample", p.alias("p"))
    scored = scored.withColumn("uncertainty", F.round(binary_uncertainty(F.col("p")), 6))
    return pool.init_state(scored, INITIAL_LABELED_FRACTION, SEED).persist()


def _event_budget(spark: SparkSession, st: DataFrame) -> tuple[int, int, int]:
    row = pool.state_counts(st).first()
    total, n_u = int(row["total"]), int(row["unlabeled"])
    return total, n_u, loop.query_budget(total, n_u)


# ---------------------------------------------------------------- SQL-checked
def q_load_pool(spark, sf):
    return pools.order_pool(spark, sf).select("id_sample", "label", *[_r(c) for c in FEATS])


def q_load_pool_file(spark, sf):
    """The order pool written as CSV with its columns reversed and one more, and loaded by name."""
    path = f"{ensure_checkpoint_dir(spark)}/load-pool-{uuid.uuid4().hex[:12]}"
    p1 = pools.order_pool(spark, sf).withColumn("note", F.lit("x"))
    files.write_table(p1.select(*reversed(p1.columns)), path)
    return files.load_pool(spark, path).select("id_sample", "label", *[_r(c) for c in FEATS], "note")


def q_stage_headerless(spark, sf):
    """The order pool written as gzip CSV without a header, decoded once into files of 5,000 rows."""
    path = f"{ensure_checkpoint_dir(spark)}/headerless-{uuid.uuid4().hex[:12]}"
    p1 = pools.order_pool(spark, sf)
    p1.select(F.col("label").cast("double"), *FEATS).write.option("compression", "gzip").csv(f"{path}/raw")
    staged = files.stage_headerless_csv(spark, f"{path}/raw", f"{path}/staged", len(FEATS), rows_per_file=5_000)
    return staged.select("label", *[_r(c) for c in FEATS])


def q_cast_pool(spark, sf):
    typed = pool.cast_pool(pools.event_pool(spark, sf), feature_type="float")
    return typed.select("id_sample", "label", *[F.col(c).cast("double").alias(c)
                                                for c in ["feature_1", "feature_2", "feature_3"]],
                        "event_type")


def q_assemble_features(spark, sf):
    typed = pool.cast_pool(pools.order_pool(spark, sf), feature_type="double")
    return pool.vector_entries(pool.assemble_features(typed, FEATS))


def q_train_test_split(spark, sf):
    return pools.order_pool(spark, sf).select("id_sample", prepare.split_label().alias("split"))


def q_init_state(spark, sf):
    return _order_train_state(spark, sf).select("id_sample", "state")


def q_labeled_rows(spark, sf):
    return pool.labeled_rows(_order_train_state(spark, sf)).select("id_sample", "label")


def q_unlabeled_rows(spark, sf):
    return pool.unlabeled_rows(_order_train_state(spark, sf)).select("id_sample", "label")


def q_state_counts(spark, sf):
    return pool.state_counts(_order_train_state(spark, sf))


def q_class_distribution(spark, sf):
    return pool.class_distribution(pools.order_pool(spark, sf)).select("label", "n", _r("fraction"))


def q_query_budget(spark, sf):
    st = _order_train_state(spark, sf)
    total, n_u, budget = _event_budget(spark, st)
    return pool.state_counts(st).select(F.col("total").alias("train_size"), F.col("unlabeled"),
                                        F.lit(budget).cast("bigint").alias("budget"))


def q_uncertainty_score(spark, sf):
    return _event_state(spark, sf).select("id_sample", "p", "uncertainty")


def _event_threshold(spark, sf):
    st = _event_state(spark, sf)
    total, n_u, budget = _event_budget(spark, st)
    u = pool.unlabeled_rows(st)
    q = 1.0 - uncertainty.keep_fraction(budget, n_u, UNCERTAINTY_CANDIDATE_FACTOR)
    t = exact_quantile(u, "uncertainty", q, "id_sample", n=n_u)
    return st, u, n_u, budget, q, t


def q_uncertainty_quantile(spark, sf):
    st, u, n_u, budget, q, t = _event_threshold(spark, sf)
    # one summary row, computed from the unlabelled rows (not a fixed input)
    return u.agg(F.count(F.lit(1)).alias("n_unlabeled")).select(
        "n_unlabeled",
        F.lit(budget).cast("bigint").alias("budget"),
        F.round(F.lit(1.0 - q), 6).alias("keep_fraction"),
        F.round(F.lit(q), 6).alias("quantile"),
        F.lit(t).cast("double").alias("threshold"))


def q_uncertainty_candidates(spark, sf):
    st, u, n_u, budget, q, t = _event_threshold(spark, sf)
    return uncertainty.uncertainty_candidates(u, t, features=None)


def q_topk_uncertain(spark, sf):
    st = _event_state(spark, sf)
    total, n_u, budget = _event_budget(spark, st)
    k = int(UNCERTAINTY_CANDIDATE_FACTOR * budget)
    u = pool.unlabeled_rows(st).select("id_sample", "uncertainty")
    return uncertainty.topk_uncertain(u, k)


def q_stratified_sample(spark, sf):
    p1 = pools.order_pool(spark, sf).persist()
    n = p1.count()
    return sampling.stratified_sample(p1, n // 2, n_rows=n).select("id_sample", "label")


def q_assign_dense_ids(spark, sf):
    p1 = pools.order_pool(spark, sf).select(F.col("id_sample").alias("source_id"))
    return sampling.assign_dense_ids(p1, "source_id", "id_sample", SEED)


def q_nested_subsets(spark, sf):
    ids = q_assign_dense_ids(spark, sf)
    n = ids.count()
    return sampling.nested_subsets(ids, n).select("percentage_set", "id_sample", "source_id")


def q_prepare_subsets(spark, sf):
    p1 = pools.order_pool(spark, sf).select(F.col("id_sample").alias("source_id"), "label").persist()
    n = p1.count()
    return prepare.prepare_subsets(p1, n // 2).select("percentage_set", "id_sample", "source_id", "label")


def q_random_selection(spark, sf):
    st = _order_train_state(spark, sf).select("id_sample", "state").persist()
    row = pool.state_counts(st).first()
    budget = loop.query_budget(int(row["total"]), int(row["unlabeled"]))
    return sampling.random_selection(st, budget, SEED, round_no=0).select("id_sample", "state")


def q_apply_labels(spark, sf):
    st = _order_train_state(spark, sf).select("id_sample", "label", "state")
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    answers = orders.filter(F.col("o_orderpriority") == F.lit(ANSWER_PRIORITY)).select("o_orderkey")
    return labels.apply_labels(st, answers, arrival_id="o_orderkey")


def _scaled_wide(train: DataFrame, test: DataFrame) -> DataFrame:
    def wide(df, split):
        arr = vector_to_array(F.col("features"))
        state = F.col("state") if "state" in df.columns else F.lit(None).cast("string")
        return df.select("id_sample", F.lit(split).alias("split"), state.alias("state"), "label",
                         *[F.round(arr[i], 6).alias(c) for i, c in enumerate(FEATS)])
    return wide(train, "train").unionByName(wide(test, "test"))


def q_standardize_features(spark, sf):
    p1 = pool.cast_pool(pools.order_pool(spark, sf), feature_type="float")
    df = pool.assemble_features(p1, FEATS)
    train, test = sampling.train_test_split(df, TRAIN_FRACTION, SEED)
    train, test = pool.standardize(train, test)
    return _scaled_wide(train, test).drop("state")


def q_prepare_pool(spark, sf):
    train, test = prepare.prepare_pool(pools.order_pool(spark, sf))
    return _scaled_wide(train, test)


def q_nearest_to_centroid(spark, sf):
    p3 = pools.vector_pool(spark, sf)
    pts = pool.array_features(p3, "embedding").select("id_sample", F.col("class_id").alias("cluster_id"),
                                                       "features")
    centers = pts.groupBy("cluster_id").agg(
        vector_to_array(Summarizer.mean(F.col("features"))).alias("center"))
    best = diversity.nearest_to_centroid(pts, centers)
    return best.select(F.col("cluster_id").alias("class_id"), "id_sample", _r("distance"))


def _means(spark, sf):
    return runs.mean_runs(pools.run_table(spark, sf))


def q_mean_runs(spark, sf):
    return _means(spark, sf).select("method", "cores", "percentage_set", _r("time"))


def _ratio_out(df, ratio):
    return df.select("method", "cores", "percentage_set", _r("time"), _r("reference_time"), _r(ratio))


def q_speed_up(spark, sf):
    return _ratio_out(runs.speed_up(_means(spark, sf)), "speed_up")


def q_size_up(spark, sf):
    return _ratio_out(runs.size_up(_means(spark, sf)), "size_up")


def q_scale_up(spark, sf):
    df = runs.scale_up(_means(spark, sf))
    # sorted by (cores, size) for presentation: a sort of the small means table
    return df.select("method", "cores", "percentage_set", "configuration", _r("time"),
                     _r("reference_time"), _r("scale_up")).orderBy("cores", "percentage_set", "method")


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def q_learning_curve_pivot(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    curve = ev.select(F.col("event_type").alias("method"),
                      (F.lit(5.0) + F.pmod(F.col("user_id"), F.lit(11)).cast("double")).alias("labeled_percentage"),
                      (F.col("value") / F.lit(100.0)).alias("accuracy"))
    return runs.learning_curve_pivot(curve, EVENT_TYPES)


def _rule_predictions(spark, sf):
    p1 = pools.order_pool(spark, sf)
    return p1.select("id_sample", "label",
                     (F.col("feature_4") > F.lit(RULE_PRICE_CUT)).cast("double").alias("prediction"))


def q_evaluate_accuracy(spark, sf):
    return metrics.accuracy(_rule_predictions(spark, sf)).select("n", _r("accuracy"))


def q_classification_metrics(spark, sf):
    m = metrics.classification_metrics(_rule_predictions(spark, sf))
    return m.select("n", _r("accuracy"), _r("weighted_precision"), _r("weighted_recall"), _r("f1"))


# ---------------------------------------------------------------- trained models
# Gaussian naive Bayes has a closed-form fit, so SQL checks its fit, scores and
# loop; the logistic versions are row checks.
def naive_bayes():
    return NaiveBayes(modelType="gaussian", labelCol="label", featuresCol="features")


def _prepared(spark, sf):
    return prepare.prepare_pool(pools.order_pool(spark, sf))


def _trained(spark, sf, estimator):
    train, test = _prepared(spark, sf)
    l, u = loop.counts(train)
    model, acc = loop.train_and_evaluate(train, test, estimator, n_labeled=l)
    return train, test, l, u, model, acc


def _accuracy_row(spark, sf, estimator):
    _, _, l, _, _, acc = _trained(spark, sf, estimator)
    return spark.range(1).select(F.lit(l).cast("bigint").alias("labeled"), F.lit(float(acc)).alias("accuracy"))


def q_train_and_evaluate(spark, sf):
    return _accuracy_row(spark, sf, None)


def q_train_and_evaluate_nb(spark, sf):
    return _accuracy_row(spark, sf, naive_bayes()).select("labeled", _r("accuracy"))


def q_score_pool(spark, sf):
    train, _, _, _, model, _ = _trained(spark, sf, None)
    return uncertainty.score_pool(model, pool.unlabeled_rows(train)).select("id_sample", _r("p1"), _r("uncertainty"))


def q_score_pool_nb(spark, sf):
    train, _, _, _, model, _ = _trained(spark, sf, naive_bayes())
    return uncertainty.score_pool(model, pool.unlabeled_rows(train)).select("id_sample", _r("p1", 4), _r("uncertainty", 4))


def _candidates(spark, sf, estimator=None):
    train, _, l, u, model, _ = _trained(spark, sf, estimator)
    budget = loop.query_budget(l + u, u)
    return train, uncertainty.get_uncertainty_candidates(train, model, budget, u), budget


def q_model_candidates(spark, sf):
    """The default model's candidates at the default relative error."""
    _, cands, _ = _candidates(spark, sf)
    return cands.select("id_sample", _r("uncertainty"))


SKETCH_EPSILON = 0.05   # so that the sketch is smaller than the event pool


def q_uncertainty_sketch(spark, sf):
    """The threshold of the event pool from a bottom-k sketch."""
    st = _event_state(spark, sf)
    total, n_u, budget = _event_budget(spark, st)
    u = pool.unlabeled_rows(st)
    t = uncertainty.uncertainty_threshold(u, budget, n_u, epsilon=SKETCH_EPSILON)
    return u.agg(F.count(F.lit(1)).alias("n_unlabeled"), F.count_if(F.col("uncertainty") >= F.lit(t)).alias("n_candidates")).withColumn(
        "threshold", F.lit(t).cast("double"))


def q_label_metrics(spark, sf):
    """By-label rates and log loss of the fixed-weight scorer on the event pool."""
    ev = _event_state(spark, sf).join(pools.event_pool(spark, sf).select("id_sample", "label"), "id_sample")
    pred = ev.select("label", (F.col("p") > 0.5).cast("double").alias("prediction"), F.array(1 - F.col("p"), F.col("p")).alias("probability"))
    m = metrics.label_metrics(pred)
    return m.select("label", "n", "n_predicted", *[_r(c) for c in ("precision", "recall", "false_positive_rate", "f1", "log_loss", "log_loss_all", "hamming_loss")])


def q_append_results(spark, sf):
    """The run table appended run by run, one of the runs twice, and read once."""
    path = f"{ensure_checkpoint_dir(spark)}/runs-{uuid.uuid4().hex[:12]}"
    table = pools.run_table(spark, sf).select(*files.RUN_SCHEMA.names).withColumn("run_id", F.concat_ws("-", F.lit("run"), "cores", "percentage_set"))
    files.append_results(table, path, run_id="")
    files.append_results(table.filter("cores = 1").repartition(3), path, run_id="")   # the retry of some runs
    return files.read_results(spark, path, files.RUN_ID_SCHEMA).select("run_id", "method", "percentage_set", "cores", _r("time"))


def q_cluster_candidates(spark, sf):
    _, cands, budget = _candidates(spark, sf)
    return diversity.cluster_candidates(cands, budget).select("id_sample", "cluster_id")


def q_bisect_events(spark, sf):
    """Four cells of the event pool, two passes a level: SQL-checked."""
    ev = pool.assemble_features(pool.cast_pool(pools.event_pool(spark, sf), feature_type="double"), list(BISECT_FEATS))
    cells = diversity.cluster_candidates(ev, 4, max_iter=2)
    name = F.dense_rank().over(Window.orderBy("first_id"))   # a row for each of the four cells
    firsts = cells.groupBy("cluster_id").agg(F.min("id_sample").alias("first_id")).select("cluster_id", name.alias("cell"))
    return cells.join(F.broadcast(firsts), "cluster_id").select("id_sample", F.col("cell").cast("int").alias("cell"))


def q_diversity_selection(spark, sf):
    train, cands, budget = _candidates(spark, sf)
    return diversity.diversity_selection(spark, cands, train, budget).select("id_sample", "state")


def q_vector_diversity(spark, sf):
    """P3: a diverse batch of B = 1 % of the 64-d embedding pool
    (array → vector input, bisecting k-means, nearest per cluster)."""
    p3 = pools.vector_pool(spark, sf)
    pts = pool.array_features(p3, "embedding").select("id_sample", "features")
    n = pts.count()
    return diversity.diverse_batch(spark, pts, loop.query_budget(n, n))


def _round(spark, sf, method):
    train, test = _prepared(spark, sf)
    store = PoolState(spark, train)
    res = loop.active_round(spark, store, test, method)
    out = res.pool.select("id_sample", "state").checkpoint()  # outlives the state's tables
    store.close()
    return out


def q_active_round_smart(spark, sf):
    return _round(spark, sf, "smart")


def q_active_round_random(spark, sf):
    return _round(spark, sf, "random")


def _loop(spark, sf, method, estimator=None):
    train, test = _prepared(spark, sf)
    _, curve = loop.active_loop(spark, train, test, method, estimator=estimator, run_id=f"{method}-10")
    return curve


def q_active_loop_smart(spark, sf):
    return _loop(spark, sf, "smart")


def q_active_loop_random(spark, sf):
    return _loop(spark, sf, "random")


def q_active_loop_random_nb(spark, sf):
    return _loop(spark, sf, "random", naive_bayes()).select("run_id", "method", "round", _r("labeled_percentage"), "labeled_count", _r("accuracy"),
                                                            "dataset_percentage")


def q_active_loop_resumed_nb(spark, sf):
    """A loop that ends after round 3 with labels of a fourth round written but not
    committed, taken up from its records for the other seven rounds."""
    train, test = _prepared(spark, sf)
    tag = uuid.uuid4().hex[:12]
    loop.active_loop(spark, train, test, "random", rounds=3, estimator=naive_bayes(), run_id="random-10", tag=tag, keep_state=True)
    lost = PoolState.open(spark, tag)
    lost.add(lost.frame().filter("state = 'U' and id_sample % 3 = 0").select("id_sample"), 4)
    store = PoolState.open(spark, tag)
    _, curve = loop.active_loop(spark, store, test, "random", estimator=naive_bayes())
    store.close()
    return curve.select("run_id", "method", "round", _r("labeled_percentage"), "labeled_count", _r("accuracy"), "dataset_percentage")


def q_answers_with_labels(spark, sf):
    """Answers with labels for the order pool: every line's day parity is an answer of
    its order; of an order's many, the one of the latest line holds."""
    st = _order_train_state(spark, sf).select("id_sample", "label", "state")
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").filter("l_quantity > 30")
    answers = lines.select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 2).alias("answer"))
    return labels.apply_labels(st, answers, arrival_id="l_orderkey", arrival_label="answer", arrival_order="l_linenumber")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "load_pool": q_load_pool,
    "load_pool_file": q_load_pool_file,
    "stage_headerless": q_stage_headerless,
    "answers_with_labels": q_answers_with_labels,
    "bisect_events": q_bisect_events,
    "train_and_evaluate_nb": q_train_and_evaluate_nb,
    "score_pool_nb": q_score_pool_nb,
    "active_loop_random_nb": q_active_loop_random_nb,
    "active_loop_resumed_nb": q_active_loop_resumed_nb,
    "cast_pool": q_cast_pool,
    "assemble_features": q_assemble_features,
    "train_test_split": q_train_test_split,
    "init_state": q_init_state,
    "labeled_rows": q_labeled_rows,
    "unlabeled_rows": q_unlabeled_rows,
    "state_counts": q_state_counts,
    "class_distribution": q_class_distribution,
    "query_budget": q_query_budget,
    "uncertainty_score": q_uncertainty_score,
    "uncertainty_quantile": q_uncertainty_quantile,
    "uncertainty_candidates": q_uncertainty_candidates,
    "topk_uncertain": q_topk_uncertain,
    "stratified_sample": q_stratified_sample,
    "assign_dense_ids": q_assign_dense_ids,
    "nested_subsets": q_nested_subsets,
    "prepare_subsets": q_prepare_subsets,
    "random_selection": q_random_selection,
    "apply_labels": q_apply_labels,
    "standardize_features": q_standardize_features,
    "prepare_pool": q_prepare_pool,
    "nearest_to_centroid": q_nearest_to_centroid,
    "mean_runs": q_mean_runs,
    "speed_up": q_speed_up,
    "size_up": q_size_up,
    "scale_up": q_scale_up,
    "learning_curve_pivot": q_learning_curve_pivot,
    "evaluate_accuracy": q_evaluate_accuracy,
    "classification_metrics": q_classification_metrics,
    # trained-model queries: rows-only check, invariants in tests/
    # (active_round_random trains a model too, but picks without it: SQL-checked)
    "train_and_evaluate": q_train_and_evaluate,
    "score_pool": q_score_pool,
    "model_candidates": q_model_candidates,
    "uncertainty_sketch": q_uncertainty_sketch,
    "label_metrics": q_label_metrics,
    "append_results": q_append_results,
    "cluster_candidates": q_cluster_candidates,
    "diversity_selection": q_diversity_selection,
    "vector_diversity": q_vector_diversity,
    "active_round_smart": q_active_round_smart,
    "active_round_random": q_active_round_random,
    "active_loop_smart": q_active_loop_smart,
    "active_loop_random": q_active_loop_random,
}


# ---------------------------------------------------------------- DuckDB oracles
def _h(id_expr: str, purpose: str, round_no: int | None = None) -> str:
    return hash_sql(id_expr, purpose, SEED, round_no)


P1 = pools.order_pool_sql()
P2 = pools.event_pool_sql()
RUNS = pools.run_table_sql()
P1_TRAIN_STATE = f"""
    SELECT *, CASE WHEN {_h('id_sample', 'state')} < {STATE_CUT} THEN 'L' ELSE 'U' END AS state
    FROM ({P1}) p1 WHERE {_h('id_sample', 'split')} < {SPLIT_CUT}"""
w1, w2, w3 = FIXED_WEIGHTS
c1, c2, c3 = FIXED_CENTERS
P2_SCORED = f"""
    SELECT id_sample, p, round(1.0::DOUBLE - 2.0::DOUBLE * abs(p - 0.5::DOUBLE), 6) AS uncertainty,
           CASE WHEN {_h('id_sample', 'state')} < {STATE_CUT} THEN 'L' ELSE 'U' END AS state
    FROM (SELECT id_sample,
                 round(1.0::DOUBLE / (1.0::DOUBLE + exp(-({w1}::DOUBLE * (feature_1 - {c1}::DOUBLE)
                       + {w2}::DOUBLE * (feature_2 - {c2}::DOUBLE)
                       + {w3}::DOUBLE * (feature_3 - {c3}::DOUBLE)))), 6) AS p
          FROM ({P2}) e) s"""
P2_BUDGET = f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE state = 'U') AS n_u,
           least(CAST(floor(count(*)::DOUBLE * {QUERY_BATCH_FRACTION}::DOUBLE) AS BIGINT),
                 count(*) FILTER (WHERE state = 'U')) AS budget
    FROM ({P2_SCORED}) s"""
P2_Q = f"""
    SELECT n_u, budget,
           1.0::DOUBLE - least(1.0::DOUBLE, ({UNCERTAINTY_CANDIDATE_FACTOR}::DOUBLE * budget) / n_u) AS q
    FROM ({P2_BUDGET}) b"""
P2_THRESHOLD = f"""
    SELECT r.uncertainty AS threshold, q.n_u, q.budget, q.q
    FROM (SELECT uncertainty, row_number() OVER (ORDER BY uncertainty, id_sample) AS rn
          FROM ({P2_SCORED}) s WHERE state = 'U') r, ({P2_Q}) q
    WHERE r.rn = greatest(1, CAST(ceil(q.q * q.n_u) AS BIGINT))"""


def _p1_dense() -> str:
    return f"""
    SELECT id_sample AS source_id,
           row_number() OVER (ORDER BY {_h('id_sample', 'shuffle')}, id_sample) - 1 AS id_sample
    FROM ({P1}) p1"""


def _nested(src: str, extra_cols: str) -> str:
    pcts = " UNION ALL ".join(f"SELECT {p} AS p" for p in (10, 20, 40, 80, 100))
    return f"""
    WITH d AS ({src}), m AS (SELECT count(*) AS n FROM d), pc AS ({pcts})
    SELECT CAST(pc.p AS INTEGER) AS percentage_set, d.id_sample, d.source_id{extra_cols}
    FROM d, m, pc WHERE d.id_sample < round_even((m.n * pc.p)::DOUBLE / 100, 0)"""


def _strat(src: str) -> str:
    return f"""
    WITH s AS ({src}), t AS (SELECT count(*) AS n FROM s),
    c AS (SELECT label, count(*) AS nc FROM s GROUP BY label),
    qt AS (SELECT c.label, CAST(round_even((t.n // 2)::DOUBLE * c.nc / t.n, 0) AS BIGINT) AS quota FROM c, t),
    r AS (SELECT s.*, row_number() OVER (PARTITION BY s.label ORDER BY {_h('s.id_sample', 'stratify')}, s.id_sample) AS rn
          FROM s)
    SELECT r.* EXCLUDE (rn) FROM r JOIN qt USING (label) WHERE r.rn <= qt.quota"""


def _scaled_sql(cast: str, with_state: bool, digits: int | None = 6) -> str:
    feats = ", ".join(f"CAST({c} AS {cast}) :: DOUBLE AS {c}" for c in FEATS)
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in FEATS)
    value = {c: f"CASE WHEN s_{c} = 0 THEN 0.0 ELSE (x.{c} - m_{c}) / s_{c} END" for c in FEATS}
    scaled = ", ".join(f"{v if digits is None else f'round({v}, {digits})'} AS {c}" for c, v in value.items())
    state = (f"CASE WHEN split = 'train' THEN CASE WHEN {_h('x.id_sample', 'state')} < {STATE_CUT} "
             f"THEN 'L' ELSE 'U' END END AS state, ") if with_state else ""
    return f"""
    WITH x AS (SELECT id_sample, label, {feats},
                      CASE WHEN {_h('id_sample', 'split')} < {SPLIT_CUT} THEN 'train' ELSE 'test' END AS split
               FROM ({P1}) p1),
    st AS (SELECT {stats} FROM x WHERE split = 'train')
    SELECT x.id_sample, x.split, {state}x.label, {scaled} FROM x, st"""


def _naive_bayes_sql(labeled: str, scored: str) -> str:
    """p1 of each row of ``scored`` (t, id_sample, label, features) by Gaussian naive
    Bayes fitted on the rows of ``labeled`` with the same t: class shares, class means,
    and class variances plus 1e-9 of the largest variance of a feature."""
    per_class = ", ".join(f"avg({c}) AS m_{c}, avg({c} * {c}) - avg({c}) * avg({c}) AS v_{c}" for c in FEATS)
    widest = ", ".join(f"avg({c} * {c}) - avg({c}) * avg({c})" for c in FEATS)
    terms = " + ".join(f"ln(2 * pi() * (v_{c} + eps)) + ({c} - m_{c}) * ({c} - m_{c}) / (v_{c} + eps)" for c in FEATS)
    return f"""
    SELECT t, id_sample, label, 1 / (1 + exp(max(ll) FILTER (WHERE class = 0) - max(ll) FILTER (WHERE class = 1))) AS p1
    FROM (SELECT x.t, x.id_sample, x.label, c.class, ln(c.n / a.n) - 0.5 * ({terms}) AS ll
          FROM ({scored}) x
          JOIN (SELECT t, label AS class, count(*)::DOUBLE AS n, {per_class} FROM ({labeled}) l GROUP BY t, label) c ON c.t = x.t
          JOIN (SELECT t, count(*)::DOUBLE AS n, 1e-9 * greatest({widest}) AS eps FROM ({labeled}) l GROUP BY t) a ON a.t = x.t) z
    GROUP BY t, id_sample, label"""


def _first_round_sql(what: str) -> str:
    s = f"SELECT 0 AS t, s.* FROM ({_scaled_sql('FLOAT', True, None)}) s"
    scored = f"{s} WHERE split = 'test'" if what == "test" else f"{s} WHERE state = 'U'"
    return _naive_bayes_sql(f"{s} WHERE state = 'L'", scored)


def _logistic_sql(what: str) -> str:
    """P(1) of the rows of the test side or of U by the default model, fitted on L."""
    s = f"SELECT * FROM ({_scaled_sql('FLOAT', True, None)}) s"
    margin = " + ".join(["b0", *(f"b{i} * {c}" for i, c in enumerate(FEATS, 1))])
    scored = f"{s} WHERE split = 'test'" if what == "test" else f"{s} WHERE state = 'U'"
    return f"""
    WITH {fit_sql(f"{s} WHERE state = 'L'", FEATS)}
    SELECT id_sample, label, 1 / (1 + exp(-({margin}))) AS p1 FROM ({scored}) x, beta"""


def _candidates_sql() -> str:
    return f"""
    WITH u AS MATERIALIZED (SELECT id_sample, 1.0::DOUBLE - 2.0::DOUBLE * abs(p1 - 0.5::DOUBLE) AS uncertainty FROM ({_logistic_sql('pool')}) p),
    b AS (SELECT count(*) AS n_u, least(CAST(floor((SELECT count(*) FROM ({P1_TRAIN_STATE}) t)::DOUBLE * {QUERY_BATCH_FRACTION}::DOUBLE) AS BIGINT), count(*)) AS budget FROM u),
    r AS (SELECT uncertainty, row_number() OVER (ORDER BY uncertainty, id_sample) AS rn FROM u)
    SELECT id_sample, round(uncertainty, 6) AS uncertainty FROM u WHERE uncertainty >= (
        SELECT r.uncertainty FROM r, b WHERE r.rn = greatest(1, CAST(ceil((1.0::DOUBLE - least(1.0::DOUBLE, ({UNCERTAINTY_CANDIDATE_FACTOR}::DOUBLE * budget) / n_u)) * n_u) AS BIGINT)))"""


def _sketch_sql() -> str:
    k = uncertainty.sketch_rows(SKETCH_EPSILON)
    return f"""
    WITH u AS MATERIALIZED (SELECT id_sample, uncertainty, row_number() OVER (ORDER BY {_h('id_sample', 'sketch')}, id_sample) AS place
                            FROM ({P2_SCORED}) s WHERE state = 'U'),
    q AS (SELECT least(n_u, {k}) AS k, q FROM ({P2_Q}) z),
    r AS (SELECT uncertainty, row_number() OVER (ORDER BY uncertainty, id_sample) AS rn FROM u, q WHERE place <= k),
    t AS (SELECT uncertainty AS threshold FROM r, q WHERE rn = greatest(1, CAST(ceil(q.q * k) AS BIGINT)))
    SELECT count(*) AS n_unlabeled, count(*) FILTER (uncertainty >= threshold) AS n_candidates, any_value(threshold) AS threshold FROM u, t"""


def _label_metrics_sql() -> str:
    return f"""
    WITH e AS (SELECT CAST(label AS DOUBLE) AS label, CASE WHEN p > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction,
                      -ln(least(greatest(CASE WHEN label = 1 THEN p ELSE 1 - p END, 1e-15), 1 - 1e-15)) AS loss
               FROM ({P2_SCORED}) s JOIN ({P2}) e USING (id_sample)),
    t AS (SELECT count(*) AS n_all, avg(loss) AS log_loss_all, avg(CASE WHEN label = prediction THEN 0.0 ELSE 1.0 END) AS hamming_loss FROM e),
    m AS (SELECT x.label, count(*) FILTER (e.label = x.label) AS n, count(*) FILTER (e.prediction = x.label) AS n_predicted,
                 count(*) FILTER (e.label = x.label AND e.prediction = x.label) AS tp, avg(loss) FILTER (e.label = x.label) AS log_loss
          FROM e, (SELECT label FROM e UNION SELECT prediction FROM e) x GROUP BY x.label),
    r AS (SELECT *, CASE WHEN n_predicted > 0 THEN tp / n_predicted ELSE 0.0 END AS precision, CASE WHEN n > 0 THEN tp / n END AS recall FROM m)
    SELECT label, n, n_predicted, round(precision, 6) AS precision, round(recall, 6) AS recall, round((n_predicted - tp) / (n_all - n), 6) AS false_positive_rate,
           round(CASE WHEN n > 0 THEN CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END END, 6) AS f1,
           round(log_loss, 6) AS log_loss, round(log_loss_all, 6) AS log_loss_all, round(hamming_loss, 6) AS hamming_loss FROM r, t"""


def _random_loop_sql(rounds: int = 10) -> str:
    steps = [f"s AS ({_scaled_sql('FLOAT', True, None)})",
             "l0 AS (SELECT id_sample, CASE WHEN state = 'L' THEN 0 END AS since FROM s WHERE split = 'train')",
             f"b AS (SELECT CAST(floor(count(*)::DOUBLE * {QUERY_BATCH_FRACTION}::DOUBLE) AS BIGINT) AS budget FROM l0)"]
    for t in range(1, rounds + 1):
        steps.append(f"""l{t} AS (SELECT l.id_sample, CASE WHEN since IS NULL AND rn <= (SELECT budget FROM b) THEN {t} ELSE since END AS since
            FROM l{t - 1} l LEFT JOIN (SELECT id_sample, row_number() OVER (ORDER BY {_h('id_sample', 'random', t)}, id_sample) AS rn
                                       FROM l{t - 1} WHERE since IS NULL) r USING (id_sample))""")
    labeled = f"SELECT t, s.* FROM s JOIN l{rounds} l USING (id_sample), range({rounds + 1}) r(t) WHERE l.since <= t"
    test = f"SELECT t, s.* FROM s, range({rounds + 1}) r(t) WHERE split = 'test'"
    return f"""
    WITH {", ".join(steps)},
    n AS (SELECT t, count(*) AS labeled_count FROM ({labeled}) x GROUP BY t),
    a AS (SELECT t, round(avg(CASE WHEN (p1 > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_naive_bayes_sql(labeled, test)}) p GROUP BY t)
    SELECT 'random-{rounds}' AS run_id, 'random' AS method, CAST(t AS INTEGER) AS round, round(5.0::DOUBLE + t, 6) AS labeled_percentage,
           labeled_count, accuracy, CAST(100 AS INTEGER) AS dataset_percentage FROM n JOIN a USING (t)"""


def _bisect_sql(levels: int = 2, passes: int = 2) -> str:
    """Cells of the event pool after ``levels`` in which every cell is split."""
    k = range(1, len(BISECT_FEATS) + 1)
    rows = ", ".join(f"CAST({c} AS DOUBLE) AS f{i}" for i, c in zip(k, BISECT_FEATS))
    steps = [f"r0 AS (SELECT id_sample, 0 AS cell, {rows} FROM ({P2}) e)"]
    right = " + ".join(f"f{i} * (r{i} - l{i})" for i in k) + " > (" + " + ".join(f"r{i} * r{i} - l{i} * l{i}" for i in k) + ") / 2"
    for n in range(levels):
        stats = ", ".join(f"avg(f{i}) AS m{i}, var_samp(f{i}) AS v{i}" for i in k)
        wide = "CASE " + " ".join(f"WHEN v{i} = greatest({', '.join(f'v{j}' for j in k)}) THEN {i}" for i in k) + " END"
        start = ", ".join(f"m{i} - CASE WHEN w = {i} THEN sqrt(v{i}) ELSE 0 END AS l{i}, m{i} + CASE WHEN w = {i} THEN sqrt(v{i}) ELSE 0 END AS r{i}" for i in k)
        steps.append(f"c{n}_0 AS (SELECT cell, {start} FROM (SELECT *, {wide} AS w FROM (SELECT cell, {stats} FROM r{n} GROUP BY cell) y) z)")
        for p in range(passes):
            means = ", ".join(f"avg(f{i}) FILTER (WHERE NOT right_side) AS l{i}, avg(f{i}) FILTER (WHERE right_side) AS r{i}" for i in k)
            steps.append(f"c{n}_{p + 1} AS (SELECT cell, {means} FROM (SELECT x.*, {right} AS right_side FROM r{n} x JOIN c{n}_{p} USING (cell)) y GROUP BY cell)")
        cols = ", ".join(f"f{i}" for i in k)
        steps.append(f"r{n + 1} AS (SELECT id_sample, cell * 2 + CASE WHEN {right} THEN 2 ELSE 1 END AS cell, {cols} FROM r{n} JOIN c{n}_{passes} USING (cell))")
    return f"""
    WITH {", ".join(steps)},
    o AS (SELECT cell, CAST(row_number() OVER (ORDER BY min(id_sample)) AS INTEGER) AS place FROM r{levels} GROUP BY cell)
    SELECT id_sample, place AS cell FROM r{levels} JOIN o USING (cell)"""


def _ratio_sql(match: list[str], ref_pred: str, name: str, ref_over_value: bool) -> str:
    on = " AND ".join(f"m.{c} = r.{c}" for c in match)
    ratio = "r.time / m.time" if ref_over_value else "m.time / r.time"
    return f"""
    WITH m AS (SELECT method, cores, percentage_set, avg(time) AS time FROM ({RUNS}) x
               GROUP BY method, cores, percentage_set),
    r AS (SELECT * FROM m WHERE {ref_pred})
    SELECT m.method, m.cores, m.percentage_set, round(m.time, 6) AS time,
           round(r.time, 6) AS reference_time, round({ratio}, 6) AS {name}
    FROM m LEFT JOIN r ON {on}"""


def _metrics_sql() -> str:
    return f"""
    WITH pr AS (SELECT label::DOUBLE AS label,
                       CAST(feature_4 > {RULE_PRICE_CUT} AS INTEGER)::DOUBLE AS prediction FROM ({P1}) p1),
    conf AS (SELECT label, prediction, count(*) AS n FROM pr GROUP BY 1, 2),
    bl AS (SELECT label, sum(n) AS n_label, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp
           FROM conf GROUP BY label),
    bp AS (SELECT prediction AS label, sum(n) AS n_pred FROM conf GROUP BY prediction),
    per AS (SELECT bl.n_label, bl.tp,
                   CASE WHEN coalesce(bp.n_pred, 0) > 0 THEN bl.tp / bp.n_pred ELSE 0.0 END AS p,
                   bl.tp / bl.n_label AS r
            FROM bl LEFT JOIN bp USING (label))
    SELECT CAST(sum(n_label) AS BIGINT) AS n,
           round(sum(tp) / sum(n_label), 6) AS accuracy,
           round(sum(n_label * p) / sum(n_label), 6) AS weighted_precision,
           round(sum(n_label * r) / sum(n_label), 6) AS weighted_recall,
           round(sum(n_label * CASE WHEN p + r > 0 THEN 2.0 * p * r / (p + r) ELSE 0.0 END) / sum(n_label), 6) AS f1
    FROM per"""


def oracle_sql() -> dict[str, str]:
    feats6 = ", ".join(f"round({c}, 6) AS {c}" for c in FEATS)
    pcts = ", ".join(
        f"round(avg(CASE WHEN method = '{m}' THEN accuracy END), 4) AS \"{m}\"" for m in EVENT_TYPES)
    unpivot = " UNION ALL ".join(
        f"SELECT id_sample, CAST({i} AS INTEGER) AS pos, round({c}, 6) AS value FROM ({P1}) p1"
        for i, c in enumerate(FEATS))
    return {
        "load_pool_file": f"SELECT id_sample, label, {feats6}, 'x' AS note FROM ({P1}) p1",
        "stage_headerless": f"SELECT CAST(label AS DOUBLE) AS label, {feats6} FROM ({P1}) p1",
        "answers_with_labels": f"""
            WITH t AS ({P1_TRAIN_STATE}),
            a AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) % 2 AS answer,
                         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, CAST(l_quantity AS INTEGER) % 2 DESC) AS rn
                  FROM lineitem WHERE l_quantity > 30)
            SELECT t.id_sample, CAST(coalesce(a.answer, t.label) AS INTEGER) AS label,
                   CASE WHEN a.l_orderkey IS NOT NULL THEN 'L' ELSE t.state END AS state
            FROM t LEFT JOIN a ON t.id_sample = a.l_orderkey AND a.rn = 1""",
        "bisect_events": _bisect_sql(),
        "train_and_evaluate_nb": f"""
            SELECT (SELECT count(*) FROM ({P1_TRAIN_STATE}) t WHERE state = 'L') AS labeled,
                   round(avg(CASE WHEN (p1 > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_first_round_sql('test')}) p""",
        "score_pool_nb": f"""
            SELECT id_sample, round(p1, 4) AS p1, round(1 - 2 * abs(p1 - 0.5), 4) AS uncertainty FROM ({_first_round_sql('pool')}) p""",
        "active_loop_random_nb": _random_loop_sql(),
        "active_loop_resumed_nb": _random_loop_sql(),
        "train_and_evaluate": f"""
            SELECT (SELECT count(*) FROM ({P1_TRAIN_STATE}) t WHERE state = 'L') AS labeled,
                   avg(CASE WHEN (p1 > 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy FROM ({_logistic_sql('test')}) p""",
        "score_pool": f"""
            SELECT id_sample, round(p1, 6) AS p1, round(1.0::DOUBLE - 2.0::DOUBLE * abs(p1 - 0.5::DOUBLE), 6) AS uncertainty FROM ({_logistic_sql('pool')}) p""",
        "model_candidates": _candidates_sql(),
        "uncertainty_sketch": _sketch_sql(),
        "label_metrics": _label_metrics_sql(),
        "append_results": f"""
            SELECT 'run-' || CAST(cores AS VARCHAR) || '-' || CAST(percentage_set AS VARCHAR) AS run_id, method,
                   CAST(percentage_set AS INTEGER) AS percentage_set, CAST(cores AS INTEGER) AS cores, round(time, 6) AS time FROM ({RUNS}) x""",
        "load_pool": f"SELECT id_sample, label, {feats6} FROM ({P1}) p1",
        "cast_pool": f"""
            SELECT CAST(id_sample AS BIGINT) AS id_sample, CAST(label AS INTEGER) AS label,
                   CAST(feature_1 AS FLOAT)::DOUBLE AS feature_1, CAST(feature_2 AS FLOAT)::DOUBLE AS feature_2,
                   CAST(feature_3 AS FLOAT)::DOUBLE AS feature_3, event_type
            FROM ({P2}) e""",
        "assemble_features": unpivot,
        "train_test_split": f"""
            SELECT id_sample, CASE WHEN {_h('id_sample', 'split')} < {SPLIT_CUT} THEN 'train' ELSE 'test' END AS split
            FROM ({P1}) p1""",
        "init_state": f"SELECT id_sample, state FROM ({P1_TRAIN_STATE}) t",
        "labeled_rows": f"SELECT id_sample, label FROM ({P1_TRAIN_STATE}) t WHERE state = 'L'",
        "unlabeled_rows": f"SELECT id_sample, label FROM ({P1_TRAIN_STATE}) t WHERE state = 'U'",
        "state_counts": f"""
            SELECT count(*) FILTER (WHERE state = 'L') AS labeled,
                   count(*) FILTER (WHERE state = 'U') AS unlabeled, count(*) AS total
            FROM ({P1_TRAIN_STATE}) t""",
        "class_distribution": f"""
            SELECT label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS fraction
            FROM ({P1}) p1 GROUP BY label""",
        "query_budget": f"""
            SELECT count(*) AS train_size, count(*) FILTER (WHERE state = 'U') AS unlabeled,
                   CAST(least(floor(count(*)::DOUBLE * {QUERY_BATCH_FRACTION}::DOUBLE),
                              count(*) FILTER (WHERE state = 'U')) AS BIGINT) AS budget
            FROM ({P1_TRAIN_STATE}) t""",
        "uncertainty_score": f"SELECT id_sample, p, uncertainty FROM ({P2_SCORED}) s",
        "uncertainty_quantile": f"""
            SELECT n_u AS n_unlabeled, budget, round(1.0 - q, 6) AS keep_fraction,
                   round(q, 6) AS quantile, threshold
            FROM ({P2_THRESHOLD}) t""",
        "uncertainty_candidates": f"""
            SELECT s.id_sample, s.uncertainty FROM ({P2_SCORED}) s, ({P2_THRESHOLD}) t
            WHERE s.state = 'U' AND s.uncertainty >= t.threshold""",
        "topk_uncertain": f"""
            SELECT id_sample, uncertainty FROM (
                SELECT s.id_sample, s.uncertainty,
                       row_number() OVER (ORDER BY s.uncertainty DESC, s.id_sample) AS rn
                FROM ({P2_SCORED}) s WHERE s.state = 'U') r, ({P2_BUDGET}) b
            WHERE r.rn <= CAST(floor({UNCERTAINTY_CANDIDATE_FACTOR}::DOUBLE * b.budget) AS BIGINT)""",
        "stratified_sample": f"SELECT id_sample, label FROM ({_strat(P1)}) z",
        "assign_dense_ids": _p1_dense(),
        "nested_subsets": _nested(_p1_dense(), ""),
        "prepare_subsets": _nested(f"""
            SELECT id_sample AS source_id, label,
                   row_number() OVER (ORDER BY {_h('id_sample', 'shuffle')}, id_sample) - 1 AS id_sample
            FROM ({_strat(f'SELECT id_sample, label FROM ({P1}) p1')}) st""", ", d.label"),
        "random_selection": f"""
            WITH t AS ({P1_TRAIN_STATE}),
            b AS (SELECT CAST(least(floor(count(*)::DOUBLE * {QUERY_BATCH_FRACTION}::DOUBLE),
                                    count(*) FILTER (WHERE state = 'U')) AS BIGINT) AS budget FROM t),
            r AS (SELECT id_sample, row_number() OVER (ORDER BY {_h('id_sample', 'random', 0)}, id_sample) AS rn
                  FROM t WHERE state = 'U'),
            pick AS (SELECT r.id_sample FROM r, b WHERE r.rn <= b.budget)
            SELECT t.id_sample, CASE WHEN pick.id_sample IS NOT NULL THEN 'L' ELSE t.state END AS state
            FROM t LEFT JOIN pick USING (id_sample)""",
        "active_round_random": f"""
            WITH t AS ({P1_TRAIN_STATE}),
            b AS (SELECT CAST(least(floor(count(*)::DOUBLE * {QUERY_BATCH_FRACTION}::DOUBLE),
                                    count(*) FILTER (WHERE state = 'U')) AS BIGINT) AS budget FROM t),
            r AS (SELECT id_sample, row_number() OVER (ORDER BY {_h('id_sample', 'random', 1)}, id_sample) AS rn
                  FROM t WHERE state = 'U'),
            pick AS (SELECT r.id_sample FROM r, b WHERE r.rn <= b.budget)
            SELECT t.id_sample, CASE WHEN pick.id_sample IS NOT NULL THEN 'L' ELSE t.state END AS state
            FROM t LEFT JOIN pick USING (id_sample)""",
        "apply_labels": f"""
            WITH t AS ({P1_TRAIN_STATE}),
            a AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_orderpriority = '{ANSWER_PRIORITY}')
            SELECT t.id_sample, t.label, CASE WHEN a.o_orderkey IS NOT NULL THEN 'L' ELSE t.state END AS state
            FROM t LEFT JOIN a ON t.id_sample = a.o_orderkey""",
        "standardize_features": _scaled_sql("FLOAT", with_state=False),
        "prepare_pool": _scaled_sql("FLOAT", with_state=True),
        "nearest_to_centroid": """
            WITH u AS (SELECT vec_id, label AS class_id, unnest(embedding)::DOUBLE AS v,
                              generate_subscripts(embedding, 1) AS i FROM embeddings),
            c AS (SELECT class_id, i, avg(v) AS m FROM u GROUP BY class_id, i),
            d AS (SELECT u.class_id, u.vec_id, sum((u.v - c.m) * (u.v - c.m)) AS dist
                  FROM u JOIN c USING (class_id, i) GROUP BY u.class_id, u.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY class_id ORDER BY dist, vec_id) AS rn FROM d)
            SELECT CAST(class_id AS INTEGER) AS class_id, CAST(vec_id AS BIGINT) AS id_sample,
                   round(dist, 6) AS distance
            FROM r WHERE rn = 1""",
        "mean_runs": f"""
            SELECT method, cores, percentage_set, round(avg(time), 6) AS time
            FROM ({RUNS}) x GROUP BY method, cores, percentage_set""",
        "speed_up": _ratio_sql(["method", "percentage_set"], "cores = 1", "speed_up", True),
        "size_up": _ratio_sql(["method", "cores"], "percentage_set = 10", "size_up", False),
        "scale_up": f"""
            WITH m AS (SELECT method, cores, percentage_set, avg(time) AS time FROM ({RUNS}) x
                       GROUP BY method, cores, percentage_set),
            r AS (SELECT * FROM m WHERE cores = 1 AND percentage_set = 10)
            SELECT m.method, m.cores, m.percentage_set,
                   CAST(m.cores AS VARCHAR) || 'C / ' || CAST(m.percentage_set AS VARCHAR) || '%' AS configuration,
                   round(m.time, 6) AS time, round(r.time, 6) AS reference_time,
                   round(r.time / m.time, 6) AS scale_up
            FROM m LEFT JOIN r ON m.method = r.method""",
        "learning_curve_pivot": f"""
            SELECT labeled_percentage, {pcts}
            FROM (SELECT event_type AS method, 5.0::DOUBLE + (user_id % 11)::DOUBLE AS labeled_percentage,
                         value / 100.0::DOUBLE AS accuracy FROM events) c
            GROUP BY labeled_percentage""",
        "evaluate_accuracy": f"""
            SELECT count(*) AS n,
                   round(avg(CAST(label::DOUBLE = CAST(feature_4 > {RULE_PRICE_CUT} AS INTEGER)::DOUBLE AS INTEGER)::DOUBLE), 6) AS accuracy
            FROM ({P1}) p1""",
        "classification_metrics": _metrics_sql(),
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)
