"""N-gram Jaccard join: token-combination prefixes, then verification.

A document is the set of its distinct 4-word shingles (words are runs of other
than white-space bytes, A-Z lower-cased; with fewer words the whole sequence is
the one shingle). Two documents link when their sets' Jaccard similarity reaches
the threshold. The method:

* Documents with equal sets form one class; only classes are joined.
* Every shingle belongs to a token class: *frequent* if some tens of documents hold it
  (shingles are counted by 36 bits of their hash, flags of the frequent ones by fewer),
  else *rare*. The number does not follow the input, or the rare shingles of a large input
  would chain most of its classes. Sets are ordered rare first, then by hash. A set of n
  shingles that reaches similarity t with another misses at most d = n - ceil(t n) of its own.
* With more than d rare shingles, the first d + 1 of them are its signatures. Else
  all its rare shingles are, and its prefix extends into the frequent ones: the
  2-combinations of neighbours among the first floor(2 (1 - t) n) + 2 frequent ones.
  A shingle that one set lacks breaks at most two of the other's neighbour pairs and
  one that it has besides breaks one, at most floor(2 (1 - t) n) in all, so similar
  sets share a single or a combination. A frequent passage alone makes no candidates.
* In signatures of many classes, each class is verified, on whole sets, against the
  pivots that it shares most signatures with. These links give components; a signature
  whose classes are all in one component is done. The classes of the others are compared
  in blocks of bounded size, which return only links that tie components.
* In signatures of few classes, all pairs of classes of different components whose
  sizes and number of shared signatures allow a link are verified. So no link between
  components is lost, and large groups are never expanded into pairs.

Defined results: a null, empty or word-less text has no shingles and links with
nothing; repeated rows share one class and all keep their row; a null doc_id takes
part, but a component is named by its smallest non-null doc_id. Other columns pass
by untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from labelpool.llm.batches import bounded_batches, byte_codes, checkpointed, mix64, release, segment_hashes, text_slices, words_of
from labelpool.llm.components import connected_components

COUNT_BITS = 36           # of a shingle's hash, by which it is counted
COUNTED_AT_ONCE = 1 << 22  # shingles that a task sorts and sends at once, about
FLAG_BITS = 26            # slots of the flags of frequent shingles at most; a bound, whatever the input
FREQUENT_AT_LEAST = 32    # a shingle under this count is never frequent
SKIP = 0xFFFF             # a step that names no value
SIG_BITS = 40             # of a signature, by which nodes are brought together
LARGE = 32       # signatures of more classes are compared by pivots and blocks, not by pairs
PIVOTS = 4       # pivots that a class is verified against
BLOCK = 256      # sets of one side that a task holds, about
BLOCK_SHINGLES = 1 << 19   # and their shingles, where blocks are compared whole
BROADCAST_ROWS = 250_000  # rows of a few numbers that are broadcast at most

# fixed values: the white space that separates words
_GAP = np.zeros(256, dtype=bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_CODES = byte_codes(fold_case=True)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted inside it, and their offsets."""
    n = len(offsets) - 1
    starts, lengths, doc = words_of(data, offsets, _GAP)
    words = segment_hashes(_CODES[data], starts, lengths)
    n_words = np.bincount(doc, minlength=n)
    last = np.cumsum(n_words)
    grams = np.zeros(len(words), np.uint64)
    for j in range(width):  # the word j places on, where the document has one
        to = len(words) - j
        ahead = words[j:] * np.uint64(0x9E3779B97F4A7C15 + 2 * j)
        grams[:to] = np.where(doc[:to] == doc[j:], mix64(grams[:to] + ahead), grams[:to])
    place = np.arange(len(words)) - (last - n_words)[doc]
    keep = place <= np.maximum(n_words[doc] - width, 0)
    grams, doc = grams[keep], doc[keep]
    ends = np.cumsum(np.bincount(doc, minlength=n)).tolist()
    for lo, hi in zip([0, *ends], ends):
        grams[lo:hi].sort()
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=n))])


def set_key(grams: np.ndarray) -> int:
    """64-bit key of a set, from its sorted hashes; 0 for the empty set."""
    if not len(grams):
        return 0
    mixed = mix64(grams ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    total = int(mixed.sum(dtype=np.uint64)) ^ (len(grams) * 0x9E3779B97F4A7C15)
    return int(mix64(np.array([total & (1 << 64) - 1], np.uint64)).view(np.int64)[0]) or 1


def _block_bits(spark: SparkSession) -> int:
    """Leading bits of a hash that name its block: some blocks for each shuffle partition."""
    return min(16, max(8, (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length()))


def _steps(values: np.ndarray) -> bytes:
    """Sorted values as steps of two bytes from 0; SKIP goes on and names no value."""
    steps = np.diff(values.astype(np.int64), prepend=0)
    skips = steps // SKIP
    out = np.full(len(values) + int(skips.sum()), SKIP, "<u2")
    out[np.cumsum(skips + 1) - 1] = steps % SKIP
    return out.tobytes()


def _stepped(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, "<u2")
    return np.cumsum(steps, dtype=np.uint32)[steps != SKIP]


def frequent_flags(docs: DataFrame, width: int) -> np.ndarray:
    """Packed flags, by leading bits of the hash, of the shingles that FREQUENT_AT_LEAST
    documents hold, or more if these are too many for an eighth of 2**FLAG_BITS slots.

    Each task sends the hashes of its shingles, sorted, as steps of two bytes; a
    block of hashes is counted by one task. Only the frequent ones reach the driver.
    """
    least, at_once, bits = FREQUENT_AT_LEAST, COUNTED_AT_ONCE, _block_bits(docs.sparkSession)
    low = COUNT_BITS - bits

    def sent(held: list[np.ndarray]) -> pa.RecordBatch:
        values = np.sort(np.concatenate(held) >> np.uint64(64 - COUNT_BITS))
        ends = np.searchsorted(values, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(low))
        there = np.flatnonzero(np.diff(ends))
        values = values & np.uint64((1 << low) - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array(there.astype(np.int32)), pa.array([_steps(values[ends[i]:ends[i + 1]]) for i in there], pa.binary())], names=["block", "steps"])

    def deal(batches):
        held, n = [], 0
        for b in batches:
            for _, _, data, offsets in text_slices(b.column("text")):
                held.append(shingle_sets(data, offsets, width)[0])
                n += len(held[-1])
                if n >= at_once:
                    yield sent(held)
                    held, n = [], 0
        if n:
            yield sent(held)

    def count(table):
        values = np.sort(np.concatenate([_stepped(x) for x in table.column("steps").to_pylist()]))
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        counts = np.diff(np.append(first, len(values)))
        often = counts >= least
        return pa.table({"value": pa.array(values[first[often]].astype(np.int64) + (table.column("block")[0].as_py() << low)), "n": pa.array(counts[often].astype(np.int64))})

    found = checkpointed(docs.select("text").mapInArrow(deal, "block int, steps binary").groupBy("block").applyInArrow(count, "value long, n long"))
    most, n_found = 1 << FLAG_BITS - 3, found.count()
    if n_found > most:   # the count that leaves few enough
        for r in found.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).count().orderBy("n").collect():
            if n_found <= most:
                break
            n_found, least = n_found - r["count"], r["n"] + 1
        found = found.filter(F.col("n") >= least)
    flag_bits = min(FLAG_BITS, max(16, (8 * n_found).bit_length()))
    slots = found.select("value").toArrow().column("value").to_numpy() >> (COUNT_BITS - flag_bits)
    flags = np.zeros(1 << flag_bits - 3, np.uint8)
    np.bitwise_or.at(flags, slots >> 3, np.right_shift(128, slots & 7).astype(np.uint8))
    return flags


def _flagged(grams: np.ndarray, flags: np.ndarray) -> np.ndarray:
    slots = (grams >> np.uint64(65 - (8 * len(flags)).bit_length())).astype(np.int64)
    return (flags[slots >> 3] << (slots & 7) & 128) > 0


def signatures(grams: np.ndarray, flags: np.ndarray, percent: int) -> tuple[np.ndarray, int, int]:
    """Signature hashes of one sorted set (none if only an equal set can link);
    if they are singles only, how many shingles may be shared besides them, else
    -1; and how many combinations there are, or -1."""
    n = len(grams)
    if n == 0 or 100 * n < percent * (n + 1):
        return np.zeros(0, np.uint64), -1, -1
    may_miss = n - -(-percent * n // 100)
    often = _flagged(grams, flags)
    rare = grams[~often]
    if len(rare) > may_miss:
        return rare[:may_miss + 1], n - may_miss - 1, -1
    pairs = grams[often][:2 * (100 - percent) * n // 100 + 2]
    return np.concatenate([rare, mix64(pairs[:-1] * np.uint64(3) + mix64(pairs[1:]))]), -1, len(pairs) - 1


def _as_signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _set_rows(docs: DataFrame, width: int, signed=None) -> DataFrame:
    """doc_id, the text's hash, set key, set size, and the whole set or, with ``signed`` (flags,
    percent), its signatures, ``rest`` and ``pairs`` as ``signatures`` has them."""
    names = ["doc_id", "text_key", "node", "n", "rest", "pairs", "grams"]

    def rows(batches):
        for b in batches:
            ids, keys = b.column("doc_id"), b.column("text_key")
            for lo, hi, data, offsets in text_slices(b.column("text")):
                grams, at = shingle_sets(data, offsets, width)
                sets = [grams[at[i]:at[i + 1]] for i in range(hi - lo)]
                given = [signatures(x, *signed) if signed else (x, -1, -1) for x in sets]
                ends = np.cumsum([0] + [len(x[0]) for x in given]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), keys.slice(lo, hi - lo), pa.array([set_key(x) for x in sets], pa.int64()), pa.array(np.diff(at).astype(np.int64)),
                     pa.array([x[1] for x in given], pa.int64()), pa.array([x[2] for x in given], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends), _as_signed(np.concatenate([x[0] for x in given])))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        rows, "doc_id long, text_key long, node long, n long, rest long, pairs long, grams array<long>")


def _shared_signatures(rows: DataFrame) -> DataFrame:
    """(sig, node), once each, of the signatures that several nodes have; ``sig`` is SIG_BITS
    of the signature, so that now and then two are taken for one and verified for nothing.

    Signatures move once, packed by blocks of their hashes, four bytes and the node.
    """
    bits = _block_bits(rows.sparkSession)
    rows_mask = np.uint64((1 << 64 - SIG_BITS) - 1)   # a batch has fewer rows: each has 16 bytes or more of BATCH_BYTES

    def deal(batches):
        for b in batches:
            grams = b.column("grams")
            row = np.repeat(np.arange(len(grams), dtype=np.uint64), grams.value_lengths().to_numpy())
            both = np.sort(grams.flatten().to_numpy().view(np.uint64) & ~rows_mask | row)
            sigs, nodes = both >> np.uint64(64 - SIG_BITS), b.column("node").to_numpy()[(both & rows_mask).astype(np.int64)]
            ends = np.searchsorted(sigs, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(SIG_BITS - bits))
            sigs = (sigs & np.uint64((1 << SIG_BITS - bits) - 1)).astype("<u4")
            there = np.flatnonzero(np.diff(ends))
            yield pa.RecordBatch.from_arrays(
                [pa.array(there.astype(np.int32)), *(pa.array([x[ends[i]:ends[i + 1]].tobytes() for i in there], pa.binary()) for x in (sigs, nodes))],
                names=["block", "sigs", "nodes"])

    def several(table):
        sigs, nodes = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("sigs", "<u4"), ("nodes", "<i8")))
        in_order = np.sort(sigs)
        twice = np.unique(in_order[1:][in_order[1:] == in_order[:-1]])
        if len(twice):
            keep = twice[np.minimum(np.searchsorted(twice, sigs), len(twice) - 1)] == sigs
            sigs, nodes = sigs[keep], nodes[keep]
            order = np.lexsort((nodes, sigs))
            sigs, nodes = sigs[order], nodes[order]
            new = np.concatenate([[True], (sigs[1:] != sigs[:-1]) | (nodes[1:] != nodes[:-1])])
            sigs, nodes = sigs[new], nodes[new]
            same = sigs[1:] == sigs[:-1]   # as the one before, or the one after
            shared = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            sigs, nodes = sigs[shared], nodes[shared]
        else:
            sigs, nodes = sigs[:0], nodes[:0]
        return pa.table({"sig": pa.array(sigs.astype(np.int64) + (table.column("block")[0].as_py() << SIG_BITS - bits)), "node": pa.array(nodes)})

    return rows.select("node", "grams").mapInArrow(deal, "block int, sigs binary, nodes binary").groupBy("block").applyInArrow(several, "sig long, node long")


def _placed_sets(docs: DataFrame, rows: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """Each of ``places`` (node and what goes with it) with the node's whole set,
    read again from the text of one document of the class."""
    wanted = checkpointed(rows.join(places.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key")).alias("of")).select(F.col("node").alias("wanted"), F.col("of.doc_id").alias("_id"), F.col("of.text_key").alias("_key")))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    if places.count() <= BROADCAST_ROWS:   # then the sets move once, to their tasks
        places = F.broadcast(places)
    match = docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_key"))
    return _whole_sets(docs.join(wanted, match).select("text", "wanted"), width).join(places, "node")


def _whole_sets(texts: DataFrame, width: int) -> DataFrame:
    """node and whole set of each text."""
    def rows(batches):
        for b in batches:
            for lo, hi, data, offsets in text_slices(b.column("text")):
                grams, at = shingle_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays(
                    [b.column("wanted").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), _as_signed(grams))], names=["node", "grams"])

    return texts.mapInArrow(rows, "node long, grams array<long>")


def _sets_in(table: pa.Table) -> dict[int, np.ndarray]:
    return {k: x.values.to_numpy().view(np.uint64) for k, x in zip(table.column("node").to_pylist(), table.column("grams"))}


def _verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, percent: int, width: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough.

    Each pair names a ``task``; a task holds some BLOCK nodes a side, whose sets
    are sent to it once, however many of its pairs they are in.
    """
    places = checkpointed(pairs.select("task", F.explode(F.array("a", "b")).alias("node")).distinct())

    def check(given: pa.Table, held: pa.Table) -> pa.Table:
        sets_of = _sets_in(held)
        keep = []
        for a, b in zip(given.column("a").to_pylist(), given.column("b").to_pylist()):
            x, y = sets_of[a], sets_of[b]
            at = np.searchsorted(x, y)
            shared = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y)) if len(x) else 0
            keep.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
        return given.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    held = _placed_sets(docs, rows, places, width).select("task", "node", "grams").toDF("task", "node", "grams")
    return pairs.select("task", "a", "b").toDF("task", "a", "b").groupBy("task").cogroup(held.groupBy("task")).applyInArrow(check, "a long, b long")


def _tied_blocks(members: DataFrame, docs: DataFrame, rows: DataFrame, percent: int, width: int) -> DataFrame:
    """Links (a, b) that tie the components in large signatures together.

    The classes that such signatures chain together are dealt into blocks by hash,
    and a task compares two blocks, all classes of different components, in array
    operations. It returns only as many links as tie them.
    """
    pivots = members.groupBy("sig").agg(F.min("node").alias("pivot"))
    chained = connected_components(members.join(pivots, "sig").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()) \
        .withColumnRenamed("component", "chain")
    sized = chained.join(members.select("node", "component", "n").distinct(), "node")
    sizes = sized.groupBy("chain").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), "blocks").cast("int")
    places = sized.join(sizes, "chain").withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("node", "component", F.xxhash64("chain", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
                (F.col("own") > F.col("other")).alias("second"), (F.col("own") == F.col("other")).alias("same"))
    places = checkpointed(places)

    def tie(held: pa.Table) -> pa.Table:
        sets_of = _sets_in(held)
        kinds = {k: v for k, *v in zip(*(held.column(c).to_pylist() for c in ("node", "component", "second", "same")))}
        nodes = sorted(sets_of, key=lambda k: (len(sets_of[k]), k))
        group = {c: c for c, _, _ in kinds.values()}

        def root(c: int) -> int:
            while group[c] != c:
                group[c] = c = group[group[c]]
            return c

        sizes = np.array([len(sets_of[k]) for k in nodes])
        _, flat = np.unique(np.concatenate([sets_of[k] for k in nodes]), return_inverse=True)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        component = np.array([kinds[k][0] for k in nodes])
        side = np.array([kinds[k][1] for k in nodes])
        within = kinds[nodes[0]][2]
        mark = np.zeros(int(flat.max(initial=0)) + 1, dtype=np.int64)
        links = []
        for i, node in enumerate(nodes):
            upto = int(np.searchsorted(sizes, sizes[i] * 100 // percent, side="right"))
            if upto <= i + 1 or not sizes[i]:
                continue
            mark[flat[ends[i]:ends[i + 1]]] = 1
            shared = np.add.reduceat(mark[flat[ends[i + 1]:ends[upto]]], ends[i + 1:upto] - ends[i + 1])
            mark[flat[ends[i]:ends[i + 1]]] = 0
            near = 100 * shared >= percent * (sizes[i] + sizes[i + 1:upto] - shared)
            near &= component[i + 1:upto] != component[i]
            if not within:
                near &= side[i + 1:upto] != side[i]
            for j in np.flatnonzero(near) + i + 1:
                x, y = root(int(component[i])), root(int(component[j]))
                if x != y:
                    group[max(x, y)] = min(x, y)
                    links.append((node, nodes[j]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return _placed_sets(docs, rows, places, width).groupBy("task").applyInArrow(tie, "a long, b long")


def _fits(n: str, m: str, percent: int):
    """Sizes so different that no overlap suffices are left out."""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def similar_classes(docs: DataFrame, percent: int = 85, width: int = 4) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, node, n; components: node, component) over ``docs``' doc_id and text.

    ``node`` is the class of documents with an equal shingle set; nodes without
    any link are not among the components.
    """
    if not 80 <= percent <= 100:
        raise ValueError("the threshold must be 80 to 100 percent")
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    flags = frequent_flags(docs, width)
    release(docs.sparkSession)
    signed = checkpointed(_set_rows(docs, width, (flags, percent)))
    rows = checkpointed(signed.drop("grams"))
    facts = rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "rest", "pairs")))
    members = checkpointed(_shared_signatures(signed).join(facts, "node"))
    del signed, facts
    release(docs.sparkSession)
    sizes = members.groupBy("sig").agg(F.count("*").alias("size"))
    large = checkpointed(members.join(sizes.filter(F.col("size") > LARGE).select("sig"), "sig"))
    small = members.join(large.select("sig").distinct(), "sig", "left_anti")

    # large signatures: pivots first, then what they left apart, in blocks
    star = checkpointed(_pivot_pairs(_still_open(large, None), percent))
    links = checkpointed(_verified(star, docs, rows, percent, width))
    release(docs.sparkSession)
    links = links.union(checkpointed(_tied_blocks(_still_open(large, connected_components(links)), docs, rows, percent, width)))
    release(docs.sparkSession)
    # small signatures: the pairs that they still leave apart
    comp = connected_components(links)
    rest = checkpointed(_blocked(checkpointed(_cross_pairs(_still_open(small, comp), percent))))
    links = links.union(checkpointed(_verified(rest, docs, rows, percent, width)))
    return rows, connected_components(links)


def _still_open(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The members of signatures whose classes lie in several components."""
    placed = members.withColumn("component", F.col("node")) if comp is None else \
        members.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("sig")
    return checkpointed(placed.join(ends, "sig"))


def _pivot_pairs(members: DataFrame, percent: int) -> DataFrame:
    """(task, a, b): each class with the pivots that it shares most signatures
    with. A signature's two pivots are the ends of an order of its own."""
    order = F.struct(F.xxhash64("sig", "node").alias("turn"), "node", "n", "component")
    pivots = members.groupBy("sig").agg(F.min(order).alias("p0"), F.max(order).alias("p1"))
    near = members.join(pivots, "sig").select("node", "n", "component", F.explode(F.array("p0", "p1")).alias("p")) \
        .filter((F.col("component") != F.col("p.component")) & _fits("n", "p.n", percent)) \
        .groupBy("node", F.col("p.node").alias("pivot")).count()
    best = near.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("count"), "pivot"))).filter(F.col("place") <= PIVOTS)
    pairs = best.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b"), "pivot", "node").dropDuplicates(["a", "b"])
    shares = pairs.groupBy("pivot").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    return pairs.join(shares, "pivot").select(F.xxhash64("pivot", F.pmod(F.xxhash64("node"), "parts")).alias("task"), "a", "b")


def _cross_pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of classes in different components that share enough of
    these signatures for a link (pairs that share a large one, too, are compared
    there, whatever their number here).

    Sets of x and y shingles that link share at least o = t (x + y) / (1 + t).
    With singles only, they share at most the common signatures and what the set
    whose signatures end first has besides; with combinations in both, at least
    those of that set's that 2 (x - o) + (y - o) breaks leave.
    """
    side = lambda k: members.select("sig", *(F.col(c).alias(c + k) for c in ("node", "n", "rest", "pairs", "component")))
    least = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent) - 1e-9)
    lacks = lambda x, y: 2 * (F.col(x) - least) + F.col(y) - least
    need = F.when((F.col("resta") >= 0) & (F.col("restb") >= 0), least - F.greatest("resta", "restb")) \
        .when((F.col("pairsa") >= 0) & (F.col("pairsb") >= 0), F.least(F.col("pairsa") - lacks("na", "nb"), F.col("pairsb") - lacks("nb", "na"))).otherwise(1)
    both = side("a").join(side("b"), "sig").filter((F.col("nodea") < F.col("nodeb")) & (F.col("componenta") != F.col("componentb")) & _fits("na", "nb", percent))
    return both.groupBy(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).agg(F.count("*").alias("shared"), F.first(need).alias("need")) \
        .filter("shared >= need").select("a", "b")


def _blocked(pairs: DataFrame) -> DataFrame:
    """(task, a, b): the nodes that pairs tie together are dealt into blocks by
    hash, and a task takes the pairs between two blocks."""
    tied = connected_components(pairs)
    sizes = tied.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    of = checkpointed(tied.join(sizes, "component").select("node", "component", F.pmod(F.xxhash64("node"), "blocks").alias("block")))
    both = pairs.join(of.toDF("a", "component", "i"), "a").join(of.select("node", "block").toDF("b", "j"), "b")
    return both.select(F.xxhash64("component", F.least("i", "j"), F.greatest("i", "j")).alias("task"), "a", "b")


def keep_one(docs: DataFrame, percent: int = 85, width: int = 4) -> DataFrame:
    """``docs`` with one row of each group of linked or equal documents: the one
    with the smallest doc_id (null last). Documents without words all stay."""
    rows, comp = similar_classes(docs, percent, width)
    named = rows.filter("node <> 0").select("doc_id", "text_key", "node").join(comp, "node", "left") \
        .withColumn("component", F.coalesce("component", "node"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    best = named.groupBy("component").agg(F.min(first).alias("best"))
    keyed = named.join(best, "component").groupBy("doc_id", "text_key").agg(
        F.count("*").alias("copies"), F.first(first == F.col("best")).alias("stays"))
    gone = checkpointed(keyed.filter(~F.col("stays") | (F.col("copies") > 1)).select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "stays"))
    match = lambda keys: docs["doc_id"].cast("long").eqNullSafe(keys["_id"]) & (F.xxhash64(docs["text"]) == keys["_key"])
    small = gone.count() <= BROADCAST_ROWS
    out = docs.join(F.broadcast(gone) if small else gone, match(gone), "left_anti")
    repeated = gone.filter("stays")
    if not repeated.isEmpty():  # rows that share id and text: one of them stays
        repeated = F.broadcast(repeated) if small else repeated
        out = out.union(docs.join(repeated, match(repeated), "left_semi").dropDuplicates(["doc_id", "text"]))
    return out


def linked_documents(docs: DataFrame, percent: int = 85, width: int = 4) -> DataFrame:
    """doc_id, n_shingles and component_id (its smallest doc_id) for every row."""
    rows, comp = similar_classes(docs, percent, width)
    named = rows.select("doc_id", "node", "n").join(comp, "node", "left") \
        .withColumn("component", F.when(F.col("node") != 0, F.coalesce("component", "node")))
    least = named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
