"""Helpers for Arrow batches: whole texts as one byte buffer, bounded slices.

The functions work on a batch at a time inside ``mapInArrow``: the UTF-8
bytes of a string column are viewed without a copy, and per-word or
per-document figures come from array operations over that buffer.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 8 << 20   # Arrow batch sent to a Python worker
SLICE_BYTES = 1 << 19   # bytes of text worked on at once inside a batch


def bounded_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, since one text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def checkpoint_dir(spark: SparkSession) -> str:
    from labelpool.session import ensure_checkpoint_dir

    return ensure_checkpoint_dir(spark)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder. It is
    written by the job that computes the rows."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark clean the shuffles and checkpoints of finished steps now: it does so
    once the driver's JVM has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield (first row, end row, bytes, offsets) over a string column.

    A null text counts as empty. ``offsets`` has one more entry than the slice
    has rows and starts at 0. A slice ends once it holds ``limit`` bytes, so a
    single longer text is a slice of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, off_buf, data_buf = column.buffers()
    offsets = np.frombuffer(off_buf, dtype=np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data_buf, dtype=np.uint8) if data_buf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(fold_case: bool) -> np.ndarray:
    """A fixed random 64-bit code for each byte value; A-Z may take a-z's."""
    codes = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    if fold_case:
        codes[65:91] = codes[97:123]
    return codes


_POWERS = np.ones(1 << 12, dtype=np.uint64)
for _i in range(1, len(_POWERS)):
    _POWERS[_i] = (int(_POWERS[_i - 1]) * 0xD6E8FEB86659FD93) & ((1 << 64) - 1)


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd multiplier mod 2**64."""
    global _POWERS
    while len(_POWERS) < n:
        step = np.uint64((int(_POWERS[-1]) * 0xD6E8FEB86659FD93) & ((1 << 64) - 1))
        _POWERS = np.concatenate([_POWERS, _POWERS * step])
    return _POWERS


def segment_hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hash of each run ``codes[start:start + length]`` (length > 0)."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    total = int(lengths.sum())
    begin = np.cumsum(lengths) - lengths
    inside = np.arange(total, dtype=np.int64) - np.repeat(begin, lengths)
    picked = codes[np.repeat(starts, lengths) + inside]
    sums = np.add.reduceat(picked * powers(int(lengths.max()))[inside], begin)
    return mix64(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def words_of(data: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths and document indices of the maximal runs of bytes that
    ``is_gap`` (256 flags) does not mark; no run crosses a document's end."""
    n_docs = len(offsets) - 1
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~is_gap[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts = np.flatnonzero(begin)
    lengths = np.flatnonzero(end) + 1 - starts
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return starts, lengths, np.minimum(doc, n_docs - 1)
