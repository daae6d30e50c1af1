"""Harmonic packing of tokenised documents into sequences of one capacity.

A document is its token ids and a closing id 0. Pieces of the full capacity are
cut off first; the rest is cut into pieces of capacity / k for k = 2, 4, 8, ...,
at most one of each, so every piece lies exactly at the bound of a reciprocal
class. A class's bins take k pieces each and are then full. Each worker fills
bins on its own, in one pass, without a shuffle: all it keeps is the one open
bin of each class. At its end, an open bin's j pieces go out as sequences of
powers of two of them, whose lengths are powers of two and need no padding.

Sequence ids are the partition's number and a counter in it. Defined results: a
null or empty text is the id 0 alone, one piece; repeated rows and ids are each
packed; an empty table gives no pieces. Other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from labelpool.llm.batches import bounded_batches

CAPACITY = 1024
END_ID = 0
CACHED_CHUNKS = 400_000   # distinct chunks whose ids a Python worker remembers
_COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


# fixed value: how byte-level BPE cuts a text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def chunk_encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids by the tokenizers file at ``path``.

    A byte-level BPE whose merges come in the order of their results' ids is run
    by tiktoken, which gives the same ids several times faster; any other file by
    the tokenizers library.
    """
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model.get("merges", [])]
    results = [model["vocab"].get(m, -1) for m in merges]
    plain = (cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
             and not spec.get("normalizer") and results == sorted(results))
    if plain:
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


class ChunkIds(dict):
    """The ids of a chunk of text as little-endian unsigned 32-bit bytes.

    A blank between two other characters begins a token, whatever stands around,
    so the ids of a text are those of its chunks cut before such blanks.
    """

    def __init__(self, path: str):
        super().__init__()
        self.encode = chunk_encoder(path)

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.encode(chunk), dtype="<u4").tobytes()
        if len(self) >= CACHED_CHUNKS:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = ids
        return ids

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        parts = text.split(" ")
        if "" in parts or any(p[0].isspace() or p[-1].isspace() for p in parts):
            parts = _joined_at_gaps(parts)
        return self[parts[0]] + b"".join(map(self.__getitem__, [" " + p for p in parts[1:]]))


def _joined_at_gaps(parts: list[str]) -> list[str]:
    """Parts between single blanks, where both neighbours are no white space."""
    out = [parts[0]]
    for p in parts[1:]:
        if p == "" or p[0].isspace() or out[-1] == "" or out[-1][-1].isspace():
            out[-1] += " " + p
        else:
            out.append(p)
    return out


_TOKENIZERS: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """This worker's tokenizer for the vocabulary file, kept between tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = ChunkIds(path)
    return _TOKENIZERS[path]


class Bins:
    """The open bin of each class, for one worker."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next_id = capacity, first_id
        self.open: dict[int, list] = {}

    def new_id(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def add(self, length: int, piece: tuple) -> list[tuple]:
        """Put a piece of its class's length into a bin; the rows of a full one."""
        bin_ = self.open.setdefault(length, [])
        bin_.append(piece)
        if len(bin_) * length < self.capacity:
            return []
        del self.open[length]
        at = self.new_id()
        return [(*p, at, k * length) for k, p in enumerate(bin_)]

    def close(self) -> list[tuple]:
        """The rows of all open bins, as sequences of powers of two of pieces."""
        rows = []
        for length, bin_ in sorted(self.open.items()):
            while bin_:
                take = 1 << (len(bin_).bit_length() - 1)
                at = self.new_id()
                rows += [(*p, at, k * length) for k, p in enumerate(bin_[:take])]
                bin_ = bin_[take:]
        self.open.clear()
        return rows


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset and, ``with_ids``, the piece's ``ids``.

    ``vocabulary`` is the path of a tokenizers file that every worker can read.
    ``capacity`` is a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    bounded_batches(docs.sparkSession)
    schema = _COLUMNS + (", ids array<int>" if with_ids else "")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * 8
        order = [0, 1, 2, 3, 4, 6, 7]
        arrays = [pa.array(columns[k], pa.int64()) for k in order]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            arrays.append(pa.array([np.frombuffer(x, "<i4") for x in columns[5]], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def work(batches):
        ids_of = chunk_ids(vocabulary)
        bins = Bins(capacity, TaskContext.get().partitionId() << 40)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for b in batches:
            rows = []
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                ids = ids_of.of(text or "") + end
                total, start = len(ids) // 4, 0
                lengths = [capacity] * (total // capacity) + [k for k in _powers_below(capacity) if total % capacity & k]
                for length in lengths:
                    part = ids[4 * start:4 * (start + length)]
                    rows += bins.add(length, (doc, start, length, zlib.crc32(part), total, part if with_ids else None))
                    start += length
            if rows:
                yield batch_of(rows)
        rows = bins.close()
        if rows:
            yield batch_of(rows)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)


def _powers_below(capacity: int) -> list[int]:
    return [1 << k for k in range(capacity.bit_length() - 2, -1, -1)]
