"""K-d tree sharding: split at distributed weighted medians, in DataFrame operations.

Rows are points of numeric metadata, weighted by their bytes. Starting with one
cell, every cell is cut along its widest dimension (spread over that of the whole
table) at the key where its weight divides as its two halves' leaves ask for, until
the leaves reach the target bytes. All cells of a level are cut in the same jobs: a
cut is found by histograms of a cell's keys, narrowed to the bucket that holds the
median, so that no cell's rows come together anywhere.

Text metadata is a dimension by the order of its distinct values in the whole table,
which a range-partitioned sort numbers.

Rows with equal text form a group that stays in one shard. Groups of over 1 % of a
shard's target (there are at most 100 a shard) are placed first, heaviest first, each in
the shard with most room, and the tree's leaves get what is left of their targets. The
share rises with the number of shards beyond 1,000, so that at most PLACED groups reach
the driver; of the cells, a row each does. Only a group that is larger than a shard is
divided.

Defined results: a null text has no bytes and size 1; null metadata counts as 0;
repeated rows and ids each get a slot; with fewer groups than shards some shards
stay empty; an empty table gives no rows. Extra columns are not looked at.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelpool.llm.batches import checkpointed

BUCKETS = 1024
HEAVY = 0.01          # share of a shard's target from which a group is placed by itself
PLACED = 100_000      # groups that are placed by themselves, at most
BROADCAST_VALUES, BROADCAST_BYTES = 100_000, 16 << 20   # distinct values, and their bytes, that are broadcast at most
SLOT_ROWS = 5_000     # rows that one window of slot numbers holds, about


def _numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the place of ``column``'s value among its distinct values in
    order, from 1; a null's is 0. ``column`` goes."""
    in_order = rows.select(F.col(column).alias("_value")).filter("_value is not null").distinct().orderBy("_value")
    in_order = checkpointed(in_order.withColumn("_at", F.monotonically_increasing_id()))
    # the upper bits of _at are the partition, the lower 33 the place in it
    counts = in_order.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_rows"), F.sum(F.octet_length("_value")).alias("_bytes")).collect()
    begin, n = [], 0
    for r in sorted(counts, key=lambda r: r["_part"]):
        begin.append((r["_part"], n))
        n += r["_rows"]
    begins = _small(rows.sparkSession, {"_part": pa.array([x for x, _ in begin], pa.int64()), "_begin": pa.array([x for _, x in begin], pa.int64())})
    places = in_order.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(begins), "_part") \
        .select("_value", (F.col("_begin") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))
    if n <= BROADCAST_VALUES and sum(r["_bytes"] for r in counts) <= BROADCAST_BYTES:
        places = F.broadcast(places)
    return rows.join(places, F.col(column) == F.col("_value"), "left").drop("_value", column).fillna(0, [name])


def _small(spark, columns: dict) -> DataFrame:
    return spark.createDataFrame(pa.table(columns))


def _cuts(rows: DataFrame, cells: dict[int, tuple[float, int]], n_dims: int, spans: list[int]) -> dict[int, tuple[int, int]]:
    """(dimension, last key of the left side) for each cell: (left weight, leaves).

    Keys are longs; of a dimension ``k`` they are the column ``k{k}``. Per round, one
    row for each cell reaches the driver.
    """
    spark = rows.sparkSession
    of = Window.partitionBy("cell").orderBy("bucket")
    found = rows.filter(F.col("cell").isin(list(cells))) if len(cells) <= 64 else rows
    ends = found.groupBy("cell").agg(*(f(f"k{k}").alias(f"{n}{k}") for k in range(n_dims) for f, n in ((F.min, "lo"), (F.max, "hi")))).collect()
    state = {}
    for r in ends:
        if r["cell"] in cells:
            wide = max(range(n_dims), key=lambda k: ((r[f"hi{k}"] >> 32) - (r[f"lo{k}"] >> 32)) / max(spans[k], 1))
            state[r["cell"]] = [wide, r[f"lo{wide}"], r[f"hi{wide}"], 0]
    cuts = {}
    while state:
        now = _small(spark, {"cell": pa.array(list(state), pa.int64()), "dim": pa.array([s[0] for s in state.values()], pa.int32()),
                             "lo": pa.array([s[1] for s in state.values()], pa.int64()), "hi": pa.array([s[2] for s in state.values()], pa.int64()),
                             "before": pa.array([s[3] for s in state.values()], pa.int64()), "goal": pa.array([cells[c][0] for c in state], pa.float64())})
        key = F.coalesce(*(F.when(F.col("dim") == k, F.col(f"k{k}")) for k in range(n_dims)))
        hist = found.join(F.broadcast(now), "cell").withColumn("key", key).filter(F.col("key").between(F.col("lo"), F.col("hi"))) \
            .withColumn("bucket", F.floor((F.col("key") - F.col("lo")) / (F.floor((F.col("hi") - F.col("lo")) / BUCKETS) + 1))) \
            .groupBy("cell", "bucket").agg(F.sum("weight").alias("w"), F.min("key").alias("lo"), F.max("key").alias("hi"),
                                           F.first("before").alias("before"), F.first("goal").alias("goal"))
        upto = hist.withColumn("upto", F.col("before") + F.sum("w").over(of)).withColumn("last", F.lead("bucket").over(of).isNull())
        hit = upto.filter((F.col("upto") >= F.col("goal")) | F.col("last")).withColumn("place", F.row_number().over(of)).filter("place = 1")
        for r in hit.select("cell", "lo", "hi", "w", "upto").collect():
            dim, before = state[r["cell"]][0], r["upto"] - r["w"]
            if r["lo"] < r["hi"]:
                state[r["cell"]] = [dim, r["lo"], r["hi"], before]
            else:  # one key is left; it goes to the side that ends nearer to the goal
                goal = cells[r["cell"]][0]
                cuts[r["cell"]] = (dim, r["lo"] if r["upto"] - goal <= goal - before else r["lo"] - 1)
                del state[r["cell"]]
    return cuts


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, text_col: str = "text",
              dims: list[Column] | None = None) -> DataFrame:
    """``id``, size, text_crc32, shard and slot (gapless in a shard) for each row.

    Give the number of shards or the target bytes of a leaf. ``docs`` needs
    ``doc_id``; ``dims``, of integers or strings, default to language, source and length.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    dims = dims or [F.col("lang"), F.col("source"), F.octet_length(text)]
    texts = [f.dataType.typeName() in ("string", "varchar", "char") for f in docs.select(*(d.alias(f"d{k}") for k, d in enumerate(dims))).schema]
    narrow = checkpointed(docs.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"), *(d.alias(f"s{k}") if texts[k] else F.coalesce(d, F.lit(0)).cast("long").alias(f"d{k}") for k, d in enumerate(dims)),
        F.monotonically_increasing_id().alias("uid")))
    for k in range(len(dims)):
        if texts[k]:
            narrow = _numbered(narrow, f"s{k}", f"d{k}")
    ends = narrow.agg(F.sum("size").alias("total"), F.count("*").alias("rows"),
                      *(f(f"d{k}").alias(f"{n}{k}") for k in range(len(dims)) for f, n in ((F.min, "lo"), (F.max, "hi")))).first()
    total = ends["total"] or 0
    leaves = n_shards or max(1, math.ceil(total / max(target_bytes or total, 1)))
    target = max(total / leaves, 1)

    # groups of equal texts; one that is larger than a shard is divided
    parts = narrow.groupBy("h").agg(F.sum("size").alias("all")).filter(F.col("all") > target) \
        .select("h", F.ceil(F.col("all") * 2 / target).alias("parts"))
    held = narrow.join(parts, "h", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("uid"), "parts"), F.lit(0))).drop("parts")
    groups = held.groupBy("h", "part").agg(F.sum("size").alias("weight"), *(F.min(f"d{k}").alias(f"d{k}") for k in range(len(dims))))
    # a key: the dimension's value in 31 bits, then bits of the group's hash
    tie = F.shiftrightunsigned(F.xxhash64("h", "part"), 32)
    spans = []
    for k in range(len(dims)):
        lo, hi = ends[f"lo{k}"] or 0, ends[f"hi{k}"] or 0
        shift = max(0, (hi - lo).bit_length() - 31)
        spans.append((hi - lo) >> shift)
        groups = groups.withColumn(f"k{k}", F.shiftleft(F.shiftright(F.col(f"d{k}") - F.lit(lo), shift), 32) + tie)
    groups = checkpointed(groups.drop(*(f"d{k}" for k in range(len(dims)))))

    least = max(HEAVY, leaves / PLACED) * target
    heavy_at = groups.filter(F.col("weight") > least).select("h", "part", "weight").collect()   # under leaves * target / least
    room, placed = [(-target, shard) for shard in range(leaves)], []
    for r in sorted(heavy_at, key=lambda r: (-r["weight"], r["h"], r["part"])):
        left, shard = room[0]
        heapq.heapreplace(room, (left + r["weight"], shard))
        placed.append((r["h"], r["part"], shard))
    room = [-left for left, _ in sorted(room, key=lambda x: x[1])]
    light = groups.filter(F.col("weight") <= least).withColumn("cell", F.lit(0).cast("long"))

    tree = {0: (0, leaves)}   # cell -> its leaves, from .. to
    while any(b - a > 1 for a, b in tree.values()):
        split = {c: (a, b) for c, (a, b) in tree.items() if b - a > 1}
        goals = {}
        weights = {r["cell"]: r["w"] for r in light.groupBy("cell").agg(F.sum("weight").alias("w")).collect()}
        for c, (a, b) in split.items():
            rooms = [max(x, 0) for x in room[a:b]]
            if c in weights:
                goals[c] = (weights[c] * sum(rooms[:(b - a) // 2]) / (sum(rooms) or 1), b - a)
        cuts = _cuts(light, goals, len(dims), spans)
        made = {c: cuts.get(c, (0, -1)) for c in split}
        table = _small(spark, {"cell": pa.array(list(made), pa.int64()), "dim": pa.array([d for d, _ in made.values()], pa.int32()),
                               "cut": pa.array([k for _, k in made.values()], pa.int64())})
        key = F.coalesce(*(F.when(F.col("dim") == k, F.col(f"k{k}")) for k in range(len(dims))))
        light = checkpointed(light.join(F.broadcast(table), "cell", "left").withColumn(
            "cell", F.when(F.col("dim").isNull(), F.col("cell") * 2 + 1).otherwise(F.col("cell") * 2 + F.when(key <= F.col("cut"), 1).otherwise(2))).drop("dim", "cut"))
        tree = {child: leaf for c, (a, b) in tree.items() for child, leaf in (
            [(2 * c + 1, (a, a + (b - a) // 2)), (2 * c + 2, (a + (b - a) // 2, b))] if c in split else [(2 * c + 1, (a, b))])}
    leaf_of = _small(spark, {"cell": pa.array(list(tree), pa.int64()), "shard": pa.array([a for a, _ in tree.values()], pa.int32())})
    by_group = light.join(F.broadcast(leaf_of), "cell").select("h", "part", "shard")
    if placed:
        by_group = by_group.unionByName(_small(spark, {"h": pa.array([p[0] for p in placed], pa.int64()), "part": pa.array([p[1] for p in placed], pa.int64()),
                                                      "shard": pa.array([p[2] for p in placed], pa.int32())}))
    sharded = checkpointed(held.join(by_group, ["h", "part"]).select("doc_id", "size", "text_crc32", "shard", "uid"))

    # slots: rows are dealt into buckets by hash, whose counts give where each begins
    buckets = max(1, math.ceil((ends["rows"] or 0) / (leaves * SLOT_ROWS)))
    dealt = sharded.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    counts = dealt.groupBy("shard", "bucket").count()
    begin = counts.select("shard", "bucket", (F.sum("count").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("count")).alias("begin"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("uid"))
    return dealt.withColumn("place", place).join(begin, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("begin") + F.col("place") - 1).cast("long").alias("slot"))


def shard_table(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """The sharding of ``docs`` under the law of near equal bytes."""
    return kd_shards(docs, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
