"""Embedding whitening: principal components by QDWH divide and conquer, then a broadcast projection.

An entry c counts as the integer x = floor(1024 * c) + 100000.

1. One pass gives, for each task, the number of its vectors, their exact sums and their
   products centred on the task's own mean; this table of a row a task is checkpointed. Two
   aggregates over it give the exact common sums, and the covariance: the tasks' centred
   products, and the products of the distances of their means from the common one.
2. :func:`labelpool.llm.spectral.symmetric_components` splits the covariance, a matrix of
   the embeddings' width, into unit eigenvectors on the driver.
3. The first components, scaled by their standard deviations, are broadcast (width x
   components doubles) and each vector is projected. The covariance of the whitened rows is
   taken like that of step 1.

A task sends one table of width x width numbers, whatever its rows, so hot keys and copies
don't matter.

Defined results: a vector that is null, empty, or holds null or non-finite entries takes no
part; of vectors of several lengths, those of the most frequent length do (of equally
frequent ones, the longest). Entries beyond 2**37 either way count as 2**37. A component
without variance (an eigenvalue under width x double precision of the largest) has null
``whitened`` and counts in no ``identity_error``, which is null where no component is left.
``deviation`` is null where the exact number exceeds a long. Repeated rows and ids are
vectors of their own; an empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from labelpool.llm.batches import bounded_batches, checkpointed
from labelpool.llm.spectral import symmetric_components

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000   # fixed values of the integer form
LARGEST_ENTRY = 2.0 ** 37
MAX_LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """``x -> (x - sums / n) @ directions``, of unit variance in every direction."""
    n: int
    sums: list[int]
    vectors: np.ndarray   # unit eigenvectors as columns, by falling eigenvalue
    values: np.ndarray
    trace: float

    @property
    def varies(self) -> np.ndarray:
        least = float(self.values[0]) * len(self.values) * np.finfo(np.float64).eps
        return self.values > max(least, 0.0)

    def directions(self, components: int) -> np.ndarray:
        scale = np.sqrt(np.where(self.varies, self.values, np.nan))
        return (self.vectors / scale)[:, :components]

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of arrays: rows that hold only finite entries, their starts and lengths, all entries."""
    entries = column.values.cast(pa.float64())
    values = (entries.fill_null(float("nan")) if entries.null_count else entries).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy().astype(np.int64)
    starts, lengths = offsets[:-1], np.diff(offsets)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (odd[offsets[1:]] == odd[starts]) & (lengths > 0) & column.is_valid().to_numpy(zero_copy_only=False)
    return np.flatnonzero(good), starts, lengths, values


def _integers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that take part and their x-vectors, exact in doubles."""
    rows, starts, lengths, values = _usable(column)
    rows = rows[lengths[rows] == width]
    c = values[starts[rows][:, None] + np.arange(width)]
    return rows, np.floor(SCALE * np.clip(c, -LARGEST_ENTRY, LARGEST_ENTRY)) + SHIFT


def embedding_width(vectors: DataFrame) -> int:
    """The most frequent length of the usable vectors; 0 if there are none."""
    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for batch in batches:
            rows, _, size, _ = _usable(batch.column("vec"))
            for width, n in zip(*np.unique(size[rows], return_counts=True)):
                seen[int(width)] = seen.get(int(width), 0) + int(n)
        yield pa.RecordBatch.from_pydict({"width": pa.array(list(seen), pa.int64()), "n": pa.array(list(seen.values()), pa.int64())})

    widths = vectors.mapInArrow(lengths, "width long, n long").groupBy("width").agg(F.sum("n").alias("n"))
    top = widths.agg(F.max(F.struct("n", "width")).alias("top")).first()["top"]
    return top["width"] if top else 0


class Moments:
    """Number, sums and centred products of the rows of matrices, added one by one."""

    def __init__(self, width: int, exact: bool):
        self.n, self.exact = 0, exact
        self.sums = [0 if exact else 0.0] * width
        self.products = np.zeros((width, width))

    def add(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        m = len(rows)
        mean = rows.mean(axis=0)
        mean += (rows - mean).mean(axis=0)
        centred = rows - mean
        self.products += centred.T @ centred
        if self.n:
            gap = mean - np.array([s / self.n for s in self.sums])
            self.products += np.outer(gap, gap) * (self.n * m / (self.n + m))
        more = rows.astype(np.int64).sum(axis=0) if self.exact else rows.sum(axis=0)
        self.sums = [s + t for s, t in zip(self.sums, more.tolist())]
        self.n += m

    def batch(self) -> pa.RecordBatch:
        kind = pa.decimal128(38, 0) if self.exact else pa.float64()
        sums = [Decimal(s) for s in self.sums] if self.exact else self.sums
        return pa.RecordBatch.from_arrays([
            pa.array([self.n], pa.int64()), pa.array([sums], pa.list_(kind)),
            pa.array([self.products.ravel()], pa.list_(pa.float64()))], names=["n", "sums", "products"])


def _moments_schema(exact: bool) -> str:
    return f"n long, sums array<{'decimal(38,0)' if exact else 'double'}>, products array<double>"


def _covariance(moments: DataFrame, width: int) -> tuple[int, list, np.ndarray]:
    """Number, sums and covariance of all rows from the tasks' moments."""
    moments = checkpointed(moments.filter("n > 0"))
    spread = moments.select(F.posexplode("sums").alias("at", "value")).groupBy("at").agg(F.sum("value").alias("value"))
    total = {r["at"]: r["value"] for r in spread.collect()}   # one number a dimension
    n = moments.agg(F.sum("n")).first()[0] or 0
    if not n:
        return 0, [], np.zeros((0, 0))
    sums = [total[i] if isinstance(total[i], float) else int(total[i]) for i in range(width)]
    mean = np.array([s / n for s in sums])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((width, width))
        for batch in batches:
            for row in batch.to_pylist():
                gap = np.array([float(s / row["n"]) for s in row["sums"]]) - mean
                out += np.array(row["products"]).reshape(width, width) + row["n"] * np.outer(gap, gap)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(out.ravel())], names=["at", "value"])

    few = moments.coalesce(max(1, math.isqrt(moments.rdd.getNumPartitions())))   # then one matrix a task again
    cells = few.mapInArrow(merged, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    covariance = np.zeros(width * width)
    for r in cells:   # one number for two dimensions
        covariance[r["at"]] = r["value"]
    return n, sums, covariance.reshape(width, width) / n


def _vectors(table: DataFrame, id_col: str, vector: str) -> DataFrame:
    bounded_batches(table.sparkSession)
    return table.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("vec"))


def fit_whitening(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> Whitening | None:
    """Mean and components of all usable vectors; None where there are none."""
    vectors = _vectors(table, id_col, vector)
    width = embedding_width(vectors)
    if not width:
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Moments(width, exact=True)
        for batch in batches:
            out.add(_integers(batch.column("vec"), width)[1])
        yield out.batch()

    n, sums, covariance = _covariance(vectors.mapInArrow(moments, _moments_schema(True)), width)
    values, axes = symmetric_components(covariance)
    return Whitening(n, sums, axes, values, float(np.trace(covariance)))


def identity_error(table: DataFrame, fit: Whitening, components: int = COMPONENTS, id_col: str = "vec_id",
                   vector: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity."""
    keep = fit.varies[:components]
    width, k = len(fit.sums), int(keep.sum())
    if not k:
        return None
    vectors = _vectors(table, id_col, vector)
    shared = table.sparkSession.sparkContext.broadcast((fit.mean(), fit.directions(components)[:, keep]))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, directions = shared.value
        out = Moments(k, exact=False)
        for batch in batches:
            out.add((_integers(batch.column("vec"), width)[1] - mean) @ directions)
        yield out.batch()

    _, _, covariance = _covariance(vectors.mapInArrow(moments, _moments_schema(False)), k)
    return float(np.abs(covariance - np.eye(k)).max())


def exact_deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of ``(n * x - sums) ** 2``, None beyond a long.

    64-bit sums wrap around, so they are exact wherever the true number fits; a double
    tells whether it does, and whole numbers decide next to the limit."""
    mask = (1 << 64) - 1
    z = x.astype(np.int64).view(np.uint64) * np.uint64(n & mask) - np.array([s & mask for s in sums], np.uint64)
    wrapped = (z * z).sum(axis=1, dtype=np.uint64)
    rough = ((n * (x - np.array([s / n for s in sums]))) ** 2).sum(axis=1)
    out: list[int | None] = wrapped.tolist()
    for i in np.flatnonzero(rough > MAX_LONG * (1 - 1e-6)).tolist():
        exact = sum((n * int(v) - s) ** 2 for v, s in zip(x[i], sums)) if rough[i] < MAX_LONG * (1 + 1e-6) else MAX_LONG + 1
        out[i] = exact if exact <= MAX_LONG else None
    return out


def whitening_report(table: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id",
                     vector: str = "embedding") -> DataFrame:
    """A row per usable vector and component: ``vec_id, component, n, deviation, whitened,
    explained, identity_error``."""
    spark = table.sparkSession
    schema = (f"vec_id {table.schema[id_col].dataType.simpleString()}, component int, n long, deviation long, "
              "whitened double, explained double, identity_error double")
    fit = fit_whitening(table, id_col, vector)
    if fit is None:
        return spark.createDataFrame([], schema)
    error = identity_error(table, fit, components, id_col, vector)
    directions = fit.directions(components)
    k, width = directions.shape[1], len(fit.sums)
    share = np.clip(fit.values[:k], 0, None) / fit.trace if fit.trace > 0 else np.zeros(k)
    shared = spark.sparkContext.broadcast((fit.mean(), directions, share, fit.n, fit.sums))

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes, explained, n, sums = shared.value
        for batch in batches:
            rows, x = _integers(batch.column("vec"), width)
            white = ((x - mean) @ axes).ravel()
            deviation = pa.array(exact_deviation(x, n, sums), pa.int64())
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                pa.array(np.full(len(white), n)), deviation.take(pa.array(np.repeat(np.arange(len(rows)), k))),
                pa.array(white, mask=np.isnan(white)), pa.array(np.tile(explained, len(rows))),
                pa.array([error] * len(white), pa.float64())],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return _vectors(table, id_col, vector).mapInArrow(report, schema)


def whiten(table: DataFrame, fit: Whitening, components: int = COMPONENTS, id_col: str = "vec_id",
           vector: str = "embedding") -> DataFrame:
    """``(id, whitened)``: each usable vector's whitened components as one array."""
    width = len(fit.sums)
    shared = table.sparkSession.sparkContext.broadcast((fit.mean(), fit.directions(components)))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = shared.value
        for batch in batches:
            rows, x = _integers(batch.column("vec"), width)
            white = (x - mean) @ axes
            flat = pa.array(white.ravel(), mask=np.isnan(white.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * white.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), lists], names=[id_col, "whitened"])

    kind = table.schema[id_col].dataType.simpleString()
    return _vectors(table, id_col, vector).mapInArrow(project, f"`{id_col}` {kind}, whitened array<double>")
