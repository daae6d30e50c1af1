"""Logistic regression by iteratively reweighted least squares.

Each pass is one aggregate over the labelled rows: the weighted Gram matrix
``X' W X`` and the gradient ``X' (y - p)``, with a last coordinate of ones for the
intercept. Every task adds up one such matrix for its rows, the matrices are added
cell by cell, and the driver solves the system of (d + 1) unknowns. The number of
passes is fixed; it ends earlier only where a step is under ``TOLERANCE``, so a fit
on the same rows gives the same model on any layout but for the order of sums.

There is no penalty: the model is the maximum of the likelihood, as with Spark's own
classifier by default. ``DAMPING`` times the row count is added to the Gram matrix'
diagonal (not to the gradient), which leaves that maximum where it is and keeps the
system solvable for constant or repeated features; a step's largest entry is at most
``MAX_STEP``. Where the classes can be separated there is no maximum, and the model is
that of the last pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelpool.config import IRLS_DAMPING, IRLS_MAX_STEP, IRLS_PASSES, IRLS_TOLERANCE
from labelpool.functions.scoring import logistic


def _array(df: DataFrame, features: str) -> Column:
    return vector_to_array(F.col(features)) if dict(df.dtypes)[features] == "vector" else F.col(features).cast("array<double>")


@dataclass
class LogisticModel:
    """A fitted model: ``transform`` adds ``probability`` (vector of P(0), P(1)) and
    ``prediction`` (1.0 where P(1) > 0.5) with JVM expressions only."""
    weights: list[float]
    intercept: float
    features: str = "features"

    def transform(self, df: DataFrame) -> DataFrame:
        terms = F.zip_with(_array(df, self.features), F.array(*map(F.lit, self.weights)), lambda x, w: x * w)
        scored = df.withColumn("_lp_p", logistic(F.aggregate(terms, F.lit(float(self.intercept)), lambda s, t: s + t)))
        return (scored.withColumn("probability", array_to_vector(F.array(1.0 - F.col("_lp_p"), F.col("_lp_p"))))
                .withColumn("prediction", (F.col("_lp_p") > 0.5).cast("double")).drop("_lp_p"))


@dataclass
class ReweightedLogistic:
    """Estimator for labels 0 and 1 over a vector (or array) column."""
    label: str = "label"
    features: str = "features"
    passes: int = IRLS_PASSES

    def fit(self, df: DataFrame) -> LogisticModel:
        rows = df.select(F.col(self.label).cast("double").alias("y"), _array(df, self.features).alias("x"))
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            head = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d"),
                            F.count_if(F.coalesce(~F.col("y").isin(0.0, 1.0), F.lit(True))).alias("odd")).first()
            if not head["n"]:
                raise ValueError("no labelled rows to train on")
            if head["odd"]:
                raise ValueError(f"{head['odd']} labels are neither 0 nor 1")
            beta = np.zeros(head["d"] + 1)
            for _ in range(self.passes):
                step = newton_step(*_sums(rows, beta), head["n"])
                beta += step
                if np.abs(step).max() < IRLS_TOLERANCE:
                    break
        finally:
            rows.unpersist()
        return LogisticModel(beta[:-1].tolist(), float(beta[-1]), self.features)


def newton_step(gram: np.ndarray, gradient: np.ndarray, n: int) -> np.ndarray:
    step = np.linalg.solve(gram + IRLS_DAMPING * n * np.eye(len(gram)), gradient)
    return step * min(1.0, IRLS_MAX_STEP / max(np.abs(step).max(), 1e-300))


def _sums(rows: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weighted Gram matrix and gradient at ``beta``; (d + 1)(d + 2) numbers reach the driver."""
    size = len(beta)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((size, size + 1))
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            x = np.ones((len(y), size))
            x[:, :-1] = np.asarray(batch.column(1).flatten()).reshape(len(y), size - 1)
            z = np.clip(x @ beta, -700, 700)
            p = 1 / (1 + np.exp(-z))
            out[:, :-1] += x.T @ (x * (p * (1 - p))[:, None])
            out[:, -1] += x.T @ (y - p)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], names=["at", "value"])

    cells = rows.mapInArrow(add_up, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(size * (size + 1))
    for r in cells:
        out[r["at"]] = r["value"]
    out = out.reshape(size, size + 1)
    return out[:, :-1], out[:, -1]


def fit_sql(labeled: str, features: list[str], passes: int = IRLS_PASSES) -> str:
    """DuckDB common table expressions of the same passes over the rows of ``labeled``
    (label, features); the last one, ``beta``, is a row ``b1 .. bd, b0`` (b0: intercept)."""
    d = len(features) + 1
    idx = range(1, d + 1)
    x = {i: f"{f}" for i, f in zip(idx, features)} | {d: "1.0::DOUBLE"}
    ctes = [f"irls_l AS MATERIALIZED ({labeled})", "irls_b0 AS MATERIALIZED (SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in idx) + ")"]
    for t in range(passes):
        margin = " + ".join(f"b{i} * {x[i]}" for i in idx)
        cells = [f"sum(p * (1 - p) * {x[i]} * {x[j]})" + (f" + {IRLS_DAMPING} * count(*)" if i == j else "") + f" AS m{i}_{j}" for i in idx for j in idx]
        cells += [f"sum((label - p) * {x[i]}) AS m{i}_{d + 1}" for i in idx]
        ctes.append(f"irls_g{t}_0 AS MATERIALIZED (SELECT {', '.join(cells)} FROM (SELECT l.*, 1 / (1 + exp(-({margin}))) AS p FROM irls_l l, irls_b{t}) z)")
        for k in idx:   # Gauss-Jordan elimination, one column after the other
            done = []
            for i in idx:
                for j in range(k + 1, d + 2):
                    row = f"m{k}_{j} / m{k}_{k}"
                    done.append(f"{row if i == k else f'm{i}_{j} - m{i}_{k} * ({row})'} AS m{i}_{j}")
            ctes.append(f"irls_g{t}_{k} AS MATERIALIZED (SELECT {', '.join(done)} FROM irls_g{t}_{k - 1})")
        largest = f"greatest({', '.join(f'abs(m{i}_{d + 1})' for i in idx)}, 1e-300)"
        step = ", ".join(f"b{i} + m{i}_{d + 1} * least(1.0, {IRLS_MAX_STEP} / {largest}) AS b{i}" for i in idx)
        ctes.append(f"irls_b{t + 1} AS MATERIALIZED (SELECT {step} FROM irls_b{t}, irls_g{t}_{d})")
    names = ", ".join(f"b{i} AS b{i if i < d else 0}" for i in idx)
    return ", ".join([*ctes, f"beta AS MATERIALIZED (SELECT {names} FROM irls_b{passes})"])
