"""The default model, the quantile sketch, by-label metrics and replayed appends."""

import os
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from conftest import SF_SMALL
from labelpool.operators import metrics, uncertainty
from labelpool.operators.logistic import ReweightedLogistic
from labelpool.plans import prepare
from labelpool.sources import files, pools


def _rows(n=600, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 3)) * [1, 2, 0.5]
    y = rng.random(n) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 0.0] + 0.3)))
    return [(int(a), Vectors.dense(b)) for a, b in zip(y, x.tolist())]


def test_fit_equals_spark_classifier(spark):
    df = spark.createDataFrame(_rows(), ["label", "features"]).repartition(7)
    mine = ReweightedLogistic().fit(df)
    spark_model = LogisticRegression(labelCol="label", featuresCol="features", tol=1e-12, maxIter=200).fit(df)
    assert np.allclose(mine.weights, spark_model.coefficients.toArray(), atol=1e-5) and abs(mine.intercept - spark_model.intercept) < 1e-5
    again = ReweightedLogistic().fit(df.repartition(2))
    assert np.allclose(mine.weights, again.weights, atol=1e-9)
    a, b = (m.transform(df).select("label", "prediction", "probability") for m in (mine, spark_model))
    assert [r.prediction for r in a.collect()] == [r.prediction for r in b.collect()]


def test_fit_of_odd_rows(spark):
    def fit(rows):
        return ReweightedLogistic().fit(spark.createDataFrame(rows, "label int, features array<double>"))

    constant = fit([(i % 2, [1.0, 0.0, float(i)]) for i in range(20)])           # constant and zero features
    assert np.isfinite(constant.weights).all()
    apart = fit([(int(i > 4), [float(i)]) for i in range(10)])                    # separable: no maximum
    assert apart.weights[0] > 1 and np.isfinite(apart.intercept)
    one = fit([(1, [0.5]), (1, [0.7])]).transform(spark.createDataFrame([(1, [0.6])], "label int, features array<double>")).first()
    assert one.prediction == 1.0 and one.probability[1] > 0.99
    for bad in ([], [(2, [0.0])], [(None, [0.0])]):
        with pytest.raises(ValueError):
            fit(bad)


def test_sampled_quantile_has_the_stated_error(spark):
    rnd = random.Random(3)
    for values in ([rnd.random() for _ in range(6000)], [rnd.choice([0.0, 0.0, 0.0, 0.5, 1.0]) for _ in range(6000)]):
        df = spark.createDataFrame(list(enumerate(values)), "id_sample long, u double")
        n, ordered = len(values), np.sort(values)
        for q, eps in ((0.9, 0.04), (0.5, 0.05), (0.0, 0.05), (1.0, 0.05)):
            assert uncertainty.sketch_rows(eps) < n
            got = [uncertainty.sampled_quantile(df.repartition(p), "u", q, eps) for p in (1, 6)]
            assert got[0] == got[1]
            lo, hi = np.searchsorted(ordered, got[0], "left") / n, np.searchsorted(ordered, got[0], "right") / n
            assert lo - eps <= q <= hi + eps
        assert uncertainty.sampled_quantile(df, "u", 0.3, 0.001) == df.stat.approxQuantile("u", [0.3], 0.0)[0]
    assert uncertainty.sampled_quantile(df.limit(0), "u", 0.5, 0.1) is None


def test_label_metrics_equal_spark_evaluator(spark):
    rnd = random.Random(4)
    rows = []
    for _ in range(400):
        p = [rnd.random() for _ in range(3)]
        p = [x / sum(p) for x in p]
        rows.append((float(rnd.randrange(3)), float(max(range(3), key=lambda i: p[i])), Vectors.dense(p)))
    df = spark.createDataFrame(rows, ["label", "prediction", "probability"]).persist()
    got = {r.label: r for r in metrics.label_metrics(df).collect()}
    assert set(got) == {0.0, 1.0, 2.0}

    def want(name, label=0.0):
        return MulticlassClassificationEvaluator(metricName=name, metricLabel=label, probabilityCol="probability").evaluate(df)

    for label, r in got.items():
        for mine, name in (("precision", "precisionByLabel"), ("recall", "truePositiveRateByLabel"),
                           ("false_positive_rate", "falsePositiveRateByLabel"), ("f1", "fMeasureByLabel")):
            assert abs(r[mine] - want(name, label)) < 1e-12
        assert abs(r.log_loss_all - want("logLoss")) < 1e-12 and abs(r.hamming_loss - want("hammingLoss")) < 1e-12
    odd = spark.createDataFrame([(0.0, 1.0), (0.0, None), (None, 1.0)], "label double, prediction double")
    rows = {r.label: r for r in metrics.label_metrics(odd, probability=None).collect()}
    assert (rows[0.0].n, rows[0.0].recall, rows[0.0].log_loss, rows[1.0].n, rows[1.0].recall) == (2, 0.0, None, 0, None)
    assert metrics.label_metrics(odd.limit(0), probability=None).count() == 0


def test_a_replayed_run_replaces_its_rows(spark, tmpdir_path):
    def runs(*rows):
        return spark.createDataFrame(list(rows), files.RUN_SCHEMA)

    for fmt in ("csv", "parquet"):
        path = os.path.join(tmpdir_path, fmt)
        files.append_results(runs(("smart", 10, 1, 2.0), ("smart", 10, 1, 2.0)), path, fmt, run_id="7")
        files.append_results(runs(("smart", 10, 2, 3.0)), path, fmt, run_id="b/ c")
        files.append_results(runs(("smart", 10, 1, 4.0)), path, fmt, run_id="7")
        back = files.read_results(spark, path, files.RUN_ID_SCHEMA, fmt)
        assert sorted(map(tuple, back.collect())) == [("7", "smart", 10, 1, 4.0), ("b/ c", "smart", 10, 2, 3.0)]
        assert files.read_results(spark, path, fmt=fmt).columns == files.RUN_SCHEMA.names


def test_candidates_cover_the_cut(spark):
    train, _ = prepare.prepare_pool(pools.order_pool(spark, SF_SMALL))
    model = ReweightedLogistic().fit(train.filter("state = 'L'"))
    n = train.filter("state = 'U'").count()
    cands = uncertainty.get_uncertainty_candidates(train, model, n // 100, n)
    scored = uncertainty.score_pool(model, train.filter("state = 'U'"))
    least = cands.agg(F.min("uncertainty")).first()[0]
    assert cands.count() >= n // 100 * 10 and scored.filter(F.col("uncertainty") >= least).count() == cands.count()
