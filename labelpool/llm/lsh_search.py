"""Approximate nearest neighbours: multiprobe p-stable hashing, exact reranking.

Each table projects a vector on a few Gaussian directions and cuts each projection
into intervals; the numbers of its intervals are the vector's bucket. A query visits
its own bucket and those that differ by one interval in some directions (by up to two
where one does not reach the recall that is asked for), in the order of their estimated
success: the sum of squared distances to the interval borders that are crossed.
Candidates of all tables are merged, ranked by the exact inner product and cut to the
nearest. Queries that found fewer than they may return, and all of them where no number
of probes reaches the recall, are compared with every entry, in blocks.

For the largest inner product, vectors are brought to one length with an extra
coordinate, per class of similar length, so that Euclidean distance orders them as
the product does.

Work is laid out in blocks: the vectors of one coarse cell of buckets in one table,
dealt into blocks of bounded size, meet the queries that visit it: a block's vectors are
copied once for each QUERY_BLOCK queries that visit the block, and to no other. Equal vectors are
one entry with their smallest ids, as many as a query may return.

Defined results: rows whose vector is null, empty, zero, of another width than the
table's, or has null or non-finite components take no part; a repeated vec_id counts
once per distinct vector; with fewer candidates than asked for, all of them are
returned. Extra columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelpool.llm.batches import bounded_batches, checkpointed

TABLES = 2
DIRECTIONS = 6
WIDTH = 2.0           # interval width, for vectors of length 1
RECALL = 0.96         # on the fit's sample
SAMPLE_ROWS = 4_096   # vectors that the number of probes is fitted on, at most about
SAMPLE_QUERIES = 256
BLOCK = 32_768        # index vectors in one task, about
QUERY_BLOCK = 2_048   # queries in one task, about
BROADCAST_ROWS = 1_000_000
REACH = 2             # intervals that a probe may step in a direction, at most
_FAR = 100            # intervals from the middle; what lies beyond shares the last one


class Tables:
    """The random directions of all tables, and how buckets follow from them."""

    def __init__(self, width: int, tables: int = TABLES, directions: int = DIRECTIONS, seed: int = 42, reach: int = 1):
        rng = np.random.default_rng(seed)
        self.n, self.directions, self.reach = tables, directions, reach
        self.axes = rng.standard_normal((width + 1, tables * directions))
        self.shift = rng.random(tables * directions) * WIDTH
        steps = np.array(np.meshgrid(*[range(-reach, reach + 1)] * directions, indexing="ij")).reshape(directions, -1).T
        self.steps = steps[np.argsort(np.abs(steps).sum(axis=1), kind="stable")]

    def project(self, rows: np.ndarray) -> np.ndarray:
        """Places of unit rows (with the extra coordinate), in interval widths."""
        return ((rows @ self.axes + self.shift) / WIDTH).reshape(len(rows), self.n, self.directions)

    @staticmethod
    def code(cells: np.ndarray) -> np.ndarray:
        """Buckets as one number each (the last axis is the directions)."""
        c = np.clip(cells, -_FAR, _FAR).astype(np.int64) + _FAR
        return (c * (2 * _FAR + 1) ** np.arange(c.shape[-1], dtype=np.int64)).sum(axis=-1)

    def costs(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The own cells of queries at ``place`` in one table, and the cost of each step from them."""
        cell = np.floor(place)
        inside = place - cell
        cost = np.zeros((len(place), len(self.steps)))
        far = np.arange(self.reach)
        for k in range(self.directions):
            x = inside[:, k, None]
            to = np.concatenate([(x + far[::-1]) ** 2, np.zeros((len(place), 1)), (1 - x + far) ** 2], axis=1)
            cost += to[:, self.steps[:, k] + self.reach]
        return cell, cost

    def probes(self, place: np.ndarray, count: int) -> np.ndarray:
        """The buckets that queries at ``place`` visit in one table, by estimated success."""
        cell, cost = self.costs(place)
        order = np.argsort(cost, axis=1, kind="stable")[:, :count]
        return self.code(cell[:, None, :] + self.steps[order])


def _unit(rows: np.ndarray, longest: np.ndarray | float) -> np.ndarray:
    """Rows over their class's longest length, with the coordinate that makes them units."""
    scaled = rows / np.reshape(longest, (-1, 1))
    rest = np.sqrt(np.maximum(0.0, 1 - (scaled ** 2).sum(axis=1)))
    return np.concatenate([scaled, rest[:, None]], axis=1)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _fitted_probes(sample: np.ndarray, tables: Tables, k: int) -> int | None:
    """The least number of probes whose recall on the sample reaches RECALL, if any does.

    The nearest in a sample are farther than those in all rows, so this is on the
    safe side."""
    most = len(tables.steps)
    queries = sample[:SAMPLE_QUERIES]
    if len(sample) <= k + 1:
        return most     # queries that find too few are completed
    unit = _unit(sample, np.linalg.norm(sample, axis=1).max())
    own = _unit(queries, np.linalg.norm(queries, axis=1))
    scores = queries @ sample.T
    scores[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    true = np.argsort(-scores, axis=1)[:, :k]
    cells = np.floor(tables.project(unit))
    rank = np.full(true.shape, most)
    place = tables.project(own)
    number = (2 * tables.reach + 1) ** np.arange(tables.directions)
    step_of = np.zeros(most, np.int64)
    step_of[(tables.steps + tables.reach) @ number] = np.arange(most)
    for t in range(tables.n):
        for q in range(len(queries)):
            cell, cost = tables.costs(place[q:q + 1, t])
            order = np.argsort(cost[0], kind="stable")
            at = np.empty(most, np.int64)
            at[order] = np.arange(most)
            step = (cells[true[q], t] - cell[0]).astype(np.int64)
            near = (np.abs(step) <= tables.reach).all(axis=1)
            rank[q, near] = np.minimum(rank[q, near], at[step_of[(step[near] + tables.reach) @ number]])
    needed = np.sort(rank.ravel())[math.ceil(RECALL * rank.size) - 1]
    return int(needed + 1) if needed < most else None


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector, h, h2) of the rows that take part, once each."""
    v = F.col(vector_col).cast("array<double>")
    fine = F.size(v) > 0
    fine &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector")).filter(F.coalesce(fine, F.lit(False)))
    return rows.withColumn("h", F.xxhash64("vector")).withColumn("h2", F.xxhash64("vector", F.lit(1)))


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
           tables: int = TABLES, directions: int = DIRECTIONS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each row that
    ``queries`` (a condition on ``vec_id``) selects, among all other rows."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = usable(vectors, id_col, vector_col)
    widths = rows.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    width = widths[0]["w"] if widths else 1
    rows = rows.filter(F.size("vector") == width)
    # one entry for each distinct vector, with its smallest ids: more can't be among the nearest
    by_id = Window.partitionBy("h", "h2").orderBy("vec_id")
    firsts = rows.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k + 1)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    entries = checkpointed(firsts.groupBy("h", "h2").agg(F.min_by("vector", "place").alias("vector"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
                           .withColumn("norm", norm).withColumn("band", F.floor(F.log2("norm") * 2 + 0.5)))
    asked = checkpointed(rows.filter(queries).select("vec_id", "h", "h2").distinct())
    n = entries.count()
    places = min(k + 1, entries.agg(F.sum(F.size("ids"))).first()[0] or 0)   # that each query's vector has, its own among them
    longest = {r["band"]: r["m"] for r in entries.groupBy("band").agg(F.max("norm").alias("m")).collect()}   # at most two a power of two
    share = int(1_000_000 * min(1.0, SAMPLE_ROWS / max(n, 1)))
    sample = _matrix(entries.filter(F.pmod("h2", F.lit(1_000_000)) < share).orderBy("h", "h2").select("vector").toArrow().column("vector")) if n else np.zeros((0, width))
    for reach in range(1, REACH + 1):
        hashing = Tables(width, tables, directions, reach=reach)
        probes = _fitted_probes(sample.reshape(-1, width), hashing, k)
        if probes:
            break

    def index(batches):
        for b in batches:
            vec = _matrix(b.column("vector"))
            band = b.column("band").to_pylist()
            codes = hashing.code(np.floor(hashing.project(_unit(vec, np.array([longest[x] for x in band])))))
            cells = [[f"{t}:{x}:{c}" for t, c in enumerate(row)] for x, row in zip(band, codes.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("h2"), pa.array(cells, pa.list_(pa.string()))], names=["h", "h2", "cells"])

    def visit(batches):
        for b in batches:
            vec = _matrix(b.column("vector"))
            place = hashing.project(_unit(vec, np.linalg.norm(vec, axis=1)))
            size = max(8, 186_624 // len(hashing.steps))
            for lo in range(0, len(vec), size):
                visited = [hashing.probes(place[lo:lo + size, t], probes or 1).tolist() for t in range(hashing.n)]
                cells = [[f"{t}:{x}:{c}" for x in longest for t in range(hashing.n) for c in dict.fromkeys(visited[t][i])] for i in range(len(visited[0]))]
                yield pa.RecordBatch.from_arrays([b.column("h").slice(lo, len(cells)), b.column("h2").slice(lo, len(cells)), pa.array(cells, pa.list_(pa.string()))], names=["h", "h2", "cells"])

    shape = "h long, h2 long, cells array<string>"
    placed = checkpointed(entries.select("h", "h2", "vector", "band").mapInArrow(index, shape).select("h", "h2", F.explode("cells").alias("cell")))
    ask = asked.select("h", "h2").distinct().join(entries, ["h", "h2"])
    visits = ask.select("h", "h2", "vector").mapInArrow(visit, shape).select("h", "h2", F.explode("cells").alias("cell"))
    # cells of a table share a block by hash, so that a vector is in a block once; a cell of
    # more than BLOCK vectors is dealt into blocks of its own
    cells = placed.groupBy("cell").count()
    groups = max(1, math.ceil(n / BLOCK))
    table = F.substring_index("cell", ":", 1)
    cells = checkpointed(cells.select("cell", F.ceil(F.col("count") / BLOCK).alias("parts")))
    if cells.count() <= BROADCAST_ROWS:
        cells = F.broadcast(cells)
    block = lambda part: F.when(F.col("parts") > 1, F.xxhash64("cell", part)).otherwise(F.xxhash64(table, F.pmod(F.xxhash64("cell"), F.lit(groups))))
    held = placed.join(cells, "cell").withColumn("block", block(F.pmod("h2", "parts"))).select("block", "cell", "h", "h2")
    going = checkpointed(visits.join(cells, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
                         .withColumn("block", block(F.col("part"))).groupBy("block", "h", "h2").agg(F.collect_set("cell").alias("cells")))
    # a block's queries are dealt by its own number of them, and its vectors go where queries are
    splits = checkpointed(going.groupBy("block").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("splits")))
    if splits.count() <= BROADCAST_ROWS:
        splits = F.broadcast(splits)
    left = going.join(splits, "block").withColumn("query_block", F.pmod("h2", "splits")).join(entries.select("h", "h2", "vector"), ["h", "h2"]) \
        .select("block", "query_block", "h", "h2", "vector", "cells")
    right = held.join(splits, "block").withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("splits") - 1))) \
        .join(entries.select("h", "h2", F.col("vector").alias("vector"), "ids"), ["h", "h2"]).select("block", "query_block", "cell", "h", "h2", "vector", "ids")

    def nearest(a: pa.Table, b: pa.Table) -> pa.Table:
        out = {c: [] for c in ("qh", "qh2", "score", "h", "h2", "ids")}
        if a.num_rows and b.num_rows:
            q, x = _matrix(a.column("vector")), _matrix(b.column("vector"))
            number = {c: i for i, c in enumerate(dict.fromkeys(b.column("cell").to_pylist()))}
            cell_of = np.array([number[c] for c in b.column("cell").to_pylist()])
            first = np.array([i[0] for i in b.column("ids").to_pylist()])
            wanted, ids, keys = a.column("cells").to_pylist(), b.column("ids").to_pylist(), [(b.column(c).to_pylist(), a.column(c).to_pylist()) for c in ("h", "h2")]
            for lo in range(0, len(q), 128):
                part = q[lo:lo + 128]
                visited = np.zeros((len(part), len(number)), dtype=bool)
                for i in range(len(part)):
                    visited[i, [number[c] for c in wanted[lo + i] if c in number]] = True
                scores = np.where(visited[:, cell_of], part @ x.T, -np.inf)
                floor = np.partition(scores, max(0, len(x) - k - 1), axis=1)[:, max(0, len(x) - k - 1)]
                for i in range(len(part)):
                    some = np.flatnonzero((scores[i] >= floor[i] - 1e-9) & (scores[i] > -np.inf))
                    exact = (part[i] * x[some]).sum(axis=1)
                    some, exact = (v[np.lexsort((first[some], -exact))][:k + 1] for v in (some, exact))
                    out["score"] += exact.tolist()
                    for c, (own, asking) in zip(("h", "h2"), keys):
                        out[c] += [own[j] for j in some]
                        out["q" + c] += [asking[lo + i]] * len(some)
                    out["ids"] += [ids[j] for j in some]
        return pa.table({"qh": pa.array(out["qh"], pa.int64()), "qh2": pa.array(out["qh2"], pa.int64()), "score": pa.array(out["score"], pa.float64()),
                         "h": pa.array(out["h"], pa.int64()), "h2": pa.array(out["h2"], pa.int64()), "ids": pa.array(out["ids"], pa.list_(pa.int64()))})

    def best_of(left: DataFrame, right: DataFrame) -> DataFrame:
        """The nearest of all blocks: the nearest entries first, then their ids and the queries'."""
        found = left.groupBy("block", "query_block").cogroup(right.groupBy("block", "query_block")).applyInArrow(
            nearest, "qh long, qh2 long, score double, h long, h2 long, ids array<long>")
        entry = Window.partitionBy("qh", "qh2").orderBy(F.desc("score"), F.col("ids")[0])
        merged = found.dropDuplicates(["qh", "qh2", "h", "h2"]).withColumn("place", F.row_number().over(entry)).filter(F.col("place") <= k + 1) \
            .select("qh", "qh2", "score", F.explode("ids").alias("near"))
        order = Window.partitionBy("qh", "qh2").orderBy(F.desc("score"), "near")
        return checkpointed(merged.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1))

    best = best_of(left, right)
    # queries that found too few (or all, if no number of probes will do) meet every entry
    full = best.groupBy("qh", "qh2").count().filter(F.col("count") >= places).select(F.col("qh").alias("h"), F.col("qh2").alias("h2"))
    short = checkpointed(ask.select("h", "h2", "vector").join(full, ["h", "h2"], "left_anti") if probes else ask.select("h", "h2", "vector"))
    if n_short := short.count():
        blocks, query_blocks = math.ceil(n / BLOCK), math.ceil(n_short / QUERY_BLOCK)
        part = lambda count: F.pmod("h2", F.lit(count).cast("long"))
        every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
        scan = best_of(short.select(every(blocks).alias("block"), part(query_blocks).alias("query_block"), "h", "h2", "vector", F.array(F.lit("all")).alias("cells")),
                       entries.select(part(blocks).alias("block"), every(query_blocks).alias("query_block"), F.lit("all").alias("cell"), "h", "h2", "vector", "ids"))
        best = best.join(short.select(F.col("h").alias("qh"), F.col("h2").alias("qh2")), ["qh", "qh2"], "left_anti").unionByName(scan)
    each = asked.join(best, (asked["h"] == best["qh"]) & (asked["h2"] == best["qh2"])).filter("near <> vec_id")
    # of k + 1 places at most one is the query's own, so the rank needs no window over all queries of a vector
    own = asked.join(best, (asked["h"] == best["qh"]) & (asked["h2"] == best["qh2"]) & (best["near"] == asked["vec_id"])) \
        .select(F.col("vec_id").alias("_id"), F.col("place").alias("_own"), F.col("qh").alias("_h"), F.col("qh2").alias("_h2"))
    ranked = each.join(own, (each["vec_id"] == own["_id"]) & (each["qh"] == own["_h"]) & (each["qh2"] == own["_h2"]), "left") \
        .withColumn("rank", (F.col("place") - F.when(F.col("_own") < F.col("place"), 1).otherwise(0)).cast("int"))
    return ranked.filter(F.col("rank") <= k).select(F.col("vec_id").alias("query_id"), "rank", F.col("near").alias("vec_id"), "score")


def nearest_vectors(embeddings: DataFrame) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20."""
    return search(embeddings, F.col("vec_id") % 20 == 0)
