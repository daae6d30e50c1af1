"""Classification metrics as aggregates over the prediction table.

The confusion table (one row per (label, prediction) pair) is the only
thing aggregated beyond the first partial/final count; every metric is a
small computation over it. Definitions follow Spark's multiclass metrics:
per label l, precision = tp / #pred(l) (0 when nothing is predicted l),
recall = tp / #label(l), F1 = 2pr / (p + r) (0 when p + r = 0); weighted
metrics are averages over labels weighted by #label(l) / N.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row ``(n, accuracy)``."""
    hit = (F.col(label).cast("double") == F.col(prediction).cast("double")).cast("double")
    return pred.select(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def confusion(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return pred.groupBy(F.col(label).cast("double").alias("label"),
                        F.col(prediction).cast("double").alias("prediction")) \
        .agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(pred: DataFrame, label: str = "label",
                           prediction: str = "prediction") -> DataFrame:
    """One row ``(n, accuracy, weighted_precision, weighted_recall, f1)``."""
    conf = confusion(pred, label, prediction)
    by_label = conf.groupBy("label").agg(
        F.sum("n").alias("n_label"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = conf.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("n_pred"))
    per = by_label.join(by_pred, "label", "left")
    p = F.when(F.coalesce(F.col("n_pred"), F.lit(0)) > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    r = F.col("tp") / F.col("n_label")
    per = per.select("n_label", "tp", p.alias("p"), r.alias("r"))
    f1 = F.when(F.col("p") + F.col("r") > 0,
                F.lit(2.0) * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    total = F.sum("n_label")
    return per.select(
        total.alias("n"),
        (F.sum("tp") / total).alias("accuracy"),
        (F.sum(F.col("n_label") * F.col("p")) / total).alias("weighted_precision"),
        (F.sum(F.col("n_label") * F.col("r")) / total).alias("weighted_recall"),
        (F.sum(F.col("n_label") * f1) / total).alias("f1"),
    )


def label_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction", probability: str | None = "probability",
                  eps: float = 1e-15) -> DataFrame:
    """One row per label: ``label, n, n_predicted, precision, recall, false_positive_rate, f1,
    log_loss, log_loss_all, hamming_loss``.

    One pass over the predictions gives a row per (label, prediction) pair with its count
    and the sum of ``-ln`` of the true label's probability; everything else is made of
    these pairs. ``probability`` is a vector or array with a class's probability at its
    label's position, at least ``eps`` and at most ``1 - eps``; without it the losses are
    null. ``log_loss`` is the mean over the label's rows, ``log_loss_all`` and
    ``hamming_loss`` are those of all rows. Labels that are only predicted have n = 0 and
    null rates. Rows without a label take no part; one without a prediction counts as wrong.
    """
    loss = F.lit(None).cast("double")
    if probability is not None:
        p = vector_to_array(F.col(probability)) if dict(pred.dtypes)[probability] == "vector" else F.col(probability)
        loss = -F.log(F.least(F.greatest(F.get(p, F.col(label).cast("int")), F.lit(eps)), F.lit(1 - eps)))
    pairs = pred.filter(F.col(label).isNotNull()).groupBy(
        F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("predicted"))
    pairs = pairs.agg(F.count(F.lit(1)).alias("n"), F.sum(loss).alias("loss"))
    hit = F.col("label") == F.col("predicted")
    sides = pairs.select(F.explode(F.array(
        F.struct(F.col("label"), F.col("n"), F.lit(0).cast("long").alias("n_predicted"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.col("loss")),
        F.struct(F.col("predicted").alias("label"), F.lit(0).cast("long").alias("n"), F.col("n").alias("n_predicted"),
                 F.lit(0).cast("long").alias("tp"), F.lit(None).cast("double").alias("loss")))).alias("s")).select("s.*")
    per = sides.filter(F.col("label").isNotNull()).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("n", "n_predicted", "tp", "loss")))
    total = pairs.agg(F.sum("n").alias("n_all"), F.sum("loss").alias("loss_all"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp_all"))
    per = per.select("*", *(total.select(c).scalar().alias(c) for c in total.columns))
    precision = F.when(F.col("n_predicted") > 0, F.col("tp") / F.col("n_predicted")).otherwise(0.0)
    recall = F.when(F.col("n") > 0, F.col("tp") / F.col("n"))
    others = F.col("n_all") - F.col("n")
    return per.select(
        "label", "n", "n_predicted", precision.alias("precision"), recall.alias("recall"),
        F.when(others > 0, (F.col("n_predicted") - F.col("tp")) / others).alias("false_positive_rate"),
        F.when(F.col("n") > 0, F.when(precision + recall > 0, 2.0 * precision * recall / (precision + recall)).otherwise(0.0)).alias("f1"),
        F.when(F.col("n") > 0, F.col("loss") / F.col("n")).alias("log_loss"),
        (F.col("loss_all") / F.col("n_all")).alias("log_loss_all"), (1 - F.col("tp_all") / F.col("n_all")).alias("hamming_loss"))
