"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes of a text: each byte adds a random number of its
own and older ones are shifted out, so it depends on the last 16 bytes alone. A
chunk ends where the hash is the least within REACH bytes on both sides, at the end of
a character. The rule looks at nothing else, so an insertion moves boundaries only
beside it and a passage is cut alike wherever it stands. Unlike places where some bits
are zero, least values seldom leave wide gaps, so passages of 51 short words keep a run
that is long enough between the chunks that they share with their surroundings; a run's
ends are those of whole chunks. Chunks are known by a 128-bit
digest. Those that occur in several documents are joined into runs; runs of at least
``least`` characters are repeats, and the first document that holds one keeps it.

Most chunks occur once, so they are sorted out before rows are moved. A first pass sends
four bytes of each digest that a task meets, by blocks of the digests' first bits; a
digest that two tasks send, or that a task met in two documents, sets its bit in a bitmap.
The second pass only gives out chunks whose bit is set. The bitmap has about one bit for
each chunk of the corpus, 2**MAP_BITS at most (64 MB), and is broadcast; beyond that it
lets more chunks through, and the exact comparison of digests follows in any case.

Positions are code points, end exclusive; no boundary splits a character. Defined
results: a null or empty text has no chunks; rows that share id and text are one
document; ties for the first holder go to the smallest id (null last), then to the
text's hash; an empty table gives no rows. Extra columns are not looked at by
``repeated_spans`` and pass through ``drop_repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from labelpool.llm.batches import bounded_batches, checkpointed, mix64, text_slices

REACH = 12          # a boundary about every 25 bytes, and none nearer than this
LONGEST = 4_096     # bytes after which a chunk is cut in any case
LEAST_RUN = 80      # characters of a run that counts as repeated
MAP_BITS = 29       # the bitmap of repeated digests has at most 2**29 bits
BLOCK_CHUNKS = 1 << 18   # chunks of the corpus in a block of digests, about
GATHERED = 1 << 21  # chunks whose digests a task sends at once
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(32)).astype(np.uint32)


def _spans(reach: int) -> list[int]:
    """Shifts after which a running minimum spans ``reach`` values."""
    out, have = [], 1
    while have < reach:
        out.append(min(have, reach - have))
        have += out[-1]
    return out


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """End places of the chunks of all texts of a slice (each text's end is one)."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):   # sums over the last 2, 4, 8, 16 bytes
        older = np.zeros_like(h)
        older[step:] = h[:-step] << np.uint32(2 * step)
        h = h + older
    none = np.uint32(0xFFFFFFFF)
    h[:-1][(data[1:] & 0xC0) == 0x80] = none             # not inside a character
    least = h                                            # of the REACH values from each place on
    for step in _spans(REACH):
        least = np.minimum(least[:len(least) - step], least[step:])
    end = np.arange(REACH, len(data) - REACH) if len(data) > 2 * REACH else np.zeros(0, np.int64)
    end = end[(h[end] < least[end - REACH]) & (h[end] <= least[end + 1]) & (h[end] != none)]
    text = np.searchsorted(offsets, end, side="right") - 1
    # all that is compared must be of the text's own bytes
    end = end[(end - offsets[text] >= 15 + REACH) & (offsets[text + 1] - end > REACH)] + 1
    end = np.unique(np.concatenate([end, offsets[1:][np.diff(offsets) > 0]]))
    start = np.concatenate([[0], end[:-1]])
    far = np.flatnonzero(end - start > LONGEST)
    if len(far):
        more = np.concatenate([np.arange(start[i] + LONGEST, end[i], LONGEST) for i in far])
        while len(inside := np.flatnonzero((data[more] & 0xC0) == 0x80)):
            more[inside] -= 1
        end = np.unique(np.concatenate([end, more]))
    return end


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    whole = data.tobytes()
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(whole[i:j]) for i, j in zip(start.tolist(), end.tolist())]), "<i8").reshape(-1, 2)


def repeat_bitmap(docs: DataFrame) -> np.ndarray:
    """A bit, by the first bits of its digest, for each chunk that several documents hold.

    A bit may be set without one; none is missing. A task's digests are sent once for every
    GATHERED chunks it meets, so a chunk that all documents hold is as small as any other."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_bits = min(MAP_BITS, max(20, (size // 25).bit_length()))
    block_bits = min(n_bits - 3, max(8, (size // 25 // BLOCK_CHUNKS).bit_length()))

    def sent(first: list[np.ndarray], doc: list[np.ndarray]) -> pa.RecordBatch:
        d, owner = np.concatenate(first), np.concatenate(doc)
        order = np.argsort(d, kind="stable")
        d, owner = d[order], owner[order]
        begin = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
        several = np.minimum.reduceat(owner, begin) != np.maximum.reduceat(owner, begin)
        d = d[begin]
        block = (d >> np.uint64(64 - block_bits)).astype(np.int64)
        rest = (d >> np.uint64(32 - block_bits)).astype(np.uint32)
        at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])).tolist()
        rows = [(block[i], rest[i:j].tobytes(), rest[i:j][several[i:j]].tobytes()) for i, j in zip(at, [*at[1:], len(d)])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary()))], names=["block", "met", "several"])

    def gather(batches):
        first, doc, held, n_docs = [], [], 0, 0
        for b in batches:
            for lo, hi, data, offsets in text_slices(b.column("text")):
                if not len(data):
                    continue
                end = chunk_ends(data, offsets)
                start = np.concatenate([[0], end[:-1]])
                first.append(np.ascontiguousarray(_digests(data, start, end)[:, 0]).view(np.uint64))
                doc.append(np.searchsorted(offsets, start, side="right") + n_docs)
                held, n_docs = held + len(end), n_docs + hi - lo
                if held >= GATHERED:
                    yield sent(first, doc)
                    first, doc, held = [], [], 0
        if held:
            yield sent(first, doc)

    def repeated(table):
        met = np.sort(np.concatenate([np.frombuffer(x, np.uint32) for x in table.column("met").to_pylist()]))
        several = [np.frombuffer(x, np.uint32) for x in table.column("several").to_pylist()]
        bits = np.zeros(1 << (n_bits - block_bits), np.uint8)
        bits[np.concatenate([met[1:][met[1:] == met[:-1]], *several]) >> np.uint32(32 - n_bits + block_bits)] = 1
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    blocks = docs.select("text").mapInArrow(gather, "block long, met binary, several binary") \
        .groupBy("block").applyInArrow(repeated, "block long, bits binary")
    out = np.zeros((1 << block_bits, 1 << (n_bits - block_bits - 3)), np.uint8)
    for r in blocks.collect():   # 2**MAP_BITS bits in all, at most
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def chunks(docs: DataFrame, bitmap: np.ndarray | None = None) -> DataFrame:
    """doc_id, text_key, start, size (code points) and digest (d1, d2) of every chunk, or
    of those whose bit in ``bitmap`` is set."""
    shared = None if bitmap is None else docs.sparkSession.sparkContext.broadcast(bitmap)

    def cut(batches):
        bits = None if shared is None else shared.value
        for b in batches:
            ids, keys = b.column("doc_id").to_numpy(zero_copy_only=False), b.column("text_key").to_numpy(zero_copy_only=False)
            known = b.column("known").to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in text_slices(b.column("text")):
                if not len(data):
                    continue
                end = chunk_ends(data, offsets)
                start = np.concatenate([[0], end[:-1]])
                doc = np.searchsorted(offsets, start, side="right") - 1
                digest = _digests(data, start, end)
                if bits is not None:
                    place = np.ascontiguousarray(digest[:, 0]).view(np.uint64) >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
                    few = np.flatnonzero(bits[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1)
                    start, end, doc, digest = start[few], end[few], doc[few], digest[few]
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                at = chars[start] - chars[offsets[doc]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[lo:hi][doc].astype(np.int64), mask=~known[lo:hi][doc].astype(bool)), pa.array(keys[lo:hi][doc]), pa.array(at),
                     pa.array(chars[end] - chars[start]), pa.array(digest[:, 0]), pa.array(digest[:, 1])],
                    names=["doc_id", "text_key", "start", "size", "d1", "d2"])

    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc_id"), doc_id.isNotNull().alias("known"),
                       F.xxhash64(doc_id, "text").alias("text_key"), "text")
    return rows.mapInArrow(cut, "doc_id long, text_key long, start long, size long, d1 long, d2 long")


def repeated_spans(docs: DataFrame, least: int = LEAST_RUN) -> DataFrame:
    """doc_id, text_key, start, end, n_chunks, first_doc_id and ``keeps`` of every run
    of repeated chunks, in all documents that hold one."""
    bounded_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    found = checkpointed(chunks(docs, repeat_bitmap(docs)))
    holder = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    first = found.groupBy("d1", "d2").agg(F.min(holder).alias("first"), F.min("text_key").alias("lo"), F.max("text_key").alias("hi")) \
        .filter("lo < hi").select("d1", "d2", "first")
    held = found.join(first, ["d1", "d2"]).groupBy("text_key", "doc_id").agg(F.array_sort(F.collect_set(F.struct(
        "start", (F.col("start") + F.col("size")).alias("end"), F.col("first.doc_id").alias("first"),
        (F.col("first.text_key") == F.col("text_key")).alias("own")))).alias("parts"))

    def runs(batches):
        for b in batches:
            out = []
            for key, doc, parts in zip(*(b.column(c).to_pylist() for c in ("text_key", "doc_id", "parts"))):
                run = None
                for p in parts:
                    # a run is one stretch of chunks that have one first holder or are all this document's own
                    if run and p["start"] == run["end"] and p["own"] == run["own"]:
                        run["end"], run["n"] = p["end"], run["n"] + 1
                    else:
                        run = {"doc_id": doc, "text_key": key, "start": p["start"], "end": p["end"], "n": 1, "first": p["first"], "own": p["own"]}
                        out.append(run)
            # neighbours of both kinds together make a repeat; shorter stretches are chance
            keep, i = [], 0
            while i < len(out):
                j = i + 1
                while j < len(out) and out[j]["text_key"] == out[i]["text_key"] and out[j]["start"] == out[j - 1]["end"]:
                    j += 1
                if out[j - 1]["end"] - out[i]["start"] >= least:
                    keep += out[i:j]
                i = j
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[c] for r in keep], t) for c, t in (("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int64()), ("end", pa.int64()),
                                                                ("n", pa.int64()), ("first", pa.int64()), ("own", pa.bool_()))],
                names=["doc_id", "text_key", "start", "end", "n_chunks", "first_doc_id", "keeps"])

    return held.mapInArrow(runs, "doc_id long, text_key long, start long, end long, n_chunks long, first_doc_id long, keeps boolean")


def drop_repeats(docs: DataFrame, least: int = LEAST_RUN) -> DataFrame:
    """``docs`` with each repeated run cut out of all texts but its first holder's."""
    gone = repeated_spans(docs, least).filter("not keeps").groupBy("doc_id", "text_key").agg(
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts")).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "_cuts")
    doc_id = docs["doc_id"].cast("long")
    rows = docs.join(gone, doc_id.eqNullSafe(F.col("_id")) & (F.xxhash64(doc_id, docs["text"]) == F.col("_key")), "left")
    text = F.expr("aggregate(_cuts, named_struct('at', 0L, 'out', ''), (a, c) -> named_struct('at', c.end, 'out', "
                  "concat(a.out, substring(text, cast(a.at + 1 as int), cast(c.start - a.at as int)))), a -> concat(a.out, substring(text, cast(a.at + 1 as int))))")
    return rows.withColumn("text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(text)).select(*docs.columns)


def repeat_report(docs: DataFrame) -> DataFrame:
    """Every repeated run of every document: one row each."""
    return repeated_spans(docs).select("doc_id", "start", "end", "n_chunks", "first_doc_id", "keeps")
