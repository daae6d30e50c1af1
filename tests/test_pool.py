"""Typing, vectors, scaling, counts, labels."""

from pyspark.sql import functions as F

from labelpool.operators import labels as Lb
from labelpool.operators import pool as P


def test_cast_pool_try_cast_policies(spark):
    df = spark.createDataFrame([("1", "0", "1.5", "x", "keep"), ("2", "1", "bad", "2", "me")],
                               "id_sample string, label string, feature_1 string, feature_2 string, other string")
    kept = P.cast_pool(df)
    assert kept.columns == ["id_sample", "label", "feature_1", "feature_2", "other"]
    assert dict(kept.dtypes)["feature_1"] == "float" and dict(kept.dtypes)["id_sample"] == "bigint"
    assert kept.filter(F.col("feature_1").isNull()).count() == 1
    assert P.cast_pool(df, policy="skip").count() == 0


def test_standardize_train_only_and_constant(spark):
    train = spark.createDataFrame([(1, 0, 1.0, 5.0), (2, 1, 3.0, 5.0)],
                                  "id_sample long, label int, feature_1 double, feature_2 double")
    test = spark.createDataFrame([(3, 0, 5.0, 7.0)], "id_sample long, label int, feature_1 double, feature_2 double")
    tr, te = P.standardize(P.assemble_features(train), P.assemble_features(test))
    from pyspark.ml.functions import vector_to_array
    t = [r[0] for r in tr.select(vector_to_array("features")).orderBy("id_sample").collect()]
    assert t[0][1] == 0.0 and t[1][1] == 0.0          # constant feature → 0
    x = te.select(vector_to_array("features")).first()[0]
    assert abs(x[0] - (5.0 - 2.0) / (2 ** 0.5)) < 1e-9  # test uses train stats


def test_apply_labels_with_answers_and_duplicates(spark):
    pool = spark.createDataFrame([(1, 0, "U"), (2, 0, "U"), (3, 1, "L")], "id_sample long, label int, state string")
    ans = spark.createDataFrame([(2, 1), (2, 1), (9, 0)], "aid long, y int")
    out = {r.id_sample: (r.label, r.state) for r in
           Lb.apply_labels(pool, ans, arrival_id="aid", arrival_label="y").collect()}
    assert out == {1: (0, "U"), 2: (1, "L"), 3: (1, "L")}


def test_vector_entries(spark):
    df = spark.createDataFrame([(1, 0.5, 2.0)], "id_sample long, feature_1 double, feature_2 double")
    rows = P.vector_entries(P.assemble_features(df)).collect()
    assert [(r.pos, r.value) for r in rows] == [(0, 0.5), (1, 2.0)]


def test_prepare_null_policy(spark):
    import pytest
    from labelpool.plans import prepare
    rows = [(i, i % 2, float(i), (None if i == 3 else float(i % 5)), float("nan") if i == 4 else 1.0 * i)
            for i in range(40)]
    raw = spark.createDataFrame(rows, "id_sample long, label int, feature_1 double, feature_2 double, feature_3 double")
    train, test = prepare.prepare_pool(raw, null_policy="skip", partitions=4)
    assert train.count() + test.count() == 38
    with pytest.raises(Exception):
        tr, te = prepare.prepare_pool(raw, null_policy="error", partitions=4)
        tr.count()


def test_uncertainty_ties_all_kept(spark):
    from labelpool.operators import uncertainty as U
    df = spark.range(100).select(F.col("id").alias("id_sample"), F.lit(0.5).alias("uncertainty"))
    t = U.uncertainty_threshold(df, 2, 100, alpha=10, epsilon=0)
    assert t == 0.5 and U.uncertainty_candidates(df, t, features=None).count() == 100
    assert U.topk_uncertain(df, 20).count() == 20


def test_approx_cut_within_gk_bound(spark):
    from labelpool.operators import uncertainty as U
    df = spark.range(20000).select(F.col("id").alias("id_sample"),
                                   ((F.col("id") * 7919) % 20000 / 20000.0).alias("uncertainty"))
    n, budget, eps = 20000, 100, 0.001
    t = U.uncertainty_threshold(df, budget, n, alpha=10, epsilon=eps)
    kept = U.uncertainty_candidates(df, t, features=None).count()
    p = U.keep_fraction(budget, n, 10)
    assert abs(kept - p * n) <= eps * n + 1
