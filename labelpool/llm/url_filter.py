"""URL filters: a Bloom filter cascade that answers membership exactly.

The cascade is built over a universe of keys, all keys that the corpus can ask
for. Its first level holds the listed keys, the second the universe's keys that
the first wrongly takes for listed, the third the listed ones that the second
takes for wrong, and so on until a level errs nowhere. A key's answer is that of
the first level that lacks it, so lookups need no join. Every level places keys by hashes
of its own, so keys that meet in one seldom meet in the next, and the levels shrink
until they end. Levels are made by aggregating bits; what reaches the driver is the levels, about 1.5 bytes a
listed key. Beyond MAX_BYTES a left join with the listed keys answers instead.

A rule is a host and the beginning of a path, ``example.net/en/``. It fits its
host and all subdomains if the url's path starts with the rule's; the longest
rule wins. Names are labels of a host: where no rule fits, a host with a listed
label is blocked; all labels of all hosts are the universe of that list's cascade.
``BLOCKED_NAMES`` are the registered query's list, a parameter of ``url_verdicts``.
Defined results: a null url or one without ``://`` has empty host and
path and fits no rule; repeated rows are judged alike; without listed keys
everything is allowed. Extra columns are not looked at.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from labelpool.llm.batches import bounded_batches, checkpointed, mix64

BITS_PER_KEY = 12
HASHES = 6
MAX_BYTES = 64 << 20
# the query's own list: labels by which unwanted hosts among the given pages are known
BLOCKED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; a blank path starts where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


@dataclass(frozen=True)
class Cascade:
    """Levels of bits, each with its number of bits; odd ones hold errors."""

    levels: tuple[np.ndarray, ...]

    def contains(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key of the universe, given by two hashes, is listed."""
        answer = np.full(len(h1), len(self.levels) % 2 == 1)
        open_ = np.arange(len(h1))
        for k, bits in enumerate(self.levels):
            inside = _inside(bits, h1[open_], h2[open_], k)
            answer[open_[~inside]] = k % 2 == 1
            open_ = open_[inside]
        return answer


def _places(h1: np.ndarray, h2: np.ndarray, n_bits: int, level: int) -> list[np.ndarray]:
    """The HASHES places of each key in a level's bits."""
    with np.errstate(over="ignore"):
        a, b = (mix64(h.view(np.uint64) + np.uint64(2 * level + 1) * np.uint64(0x9E3779B97F4A7C15)) for h in (h1, h2))
        return [(a + np.uint64(k) * (b | np.uint64(1))) % np.uint64(n_bits) for k in range(HASHES)]


def _inside(bits: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    inside = np.ones(len(h1), dtype=bool)
    for at in _places(h1, h2, len(bits) * 8, level):
        inside &= (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return inside


def level_bits(n: int) -> int:
    return 8 * max(8, math.ceil(n * BITS_PER_KEY / 8))


def _bytes_of(h1: np.ndarray, h2: np.ndarray, n_bits: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the keys of a level touch, and the bit in each."""
    at = np.concatenate(_places(h1, h2, n_bits, level))
    return (at >> np.uint64(3)).astype(np.int64), 1 << (at & np.uint64(7)).astype(np.int64)


def hashed(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))


def _level(keys: DataFrame, n: int, level: int) -> np.ndarray:
    """The bits of all (h1, h2); bytes are merged before they reach the driver."""
    n_bits = level_bits(n)

    def places(batches):
        for b in batches:
            h1, h2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            yield pa.RecordBatch.from_arrays([*map(pa.array, _bytes_of(h1, h2, n_bits, level))], names=["byte", "bit"])

    got = keys.mapInArrow(places, "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(n_bits // 8, np.uint8)
    bits[got.column("byte").to_numpy()] = got.column("bits").to_numpy().astype(np.uint8)
    return bits


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """Cascade for the listed ones among the universe's keys (each (h1, h2), distinct
    pairs); None if it would be over MAX_BYTES."""
    inside = checkpointed(universe.join(listed, ["h1", "h2"], "left_semi"))
    outside = universe.join(listed, ["h1", "h2"], "left_anti")
    n, levels = inside.count(), []
    if n * BITS_PER_KEY / 8 > MAX_BYTES:
        return None
    now, other = inside, outside
    while n:
        bits = _level(now, n, len(levels))
        levels.append(bits)
        now, other = checkpointed(_taken(other, bits, len(levels) - 1)), now  # what the new level wrongly holds
        n = now.count()
    return Cascade(tuple(levels))


def _taken(keys: DataFrame, bits: np.ndarray, level: int) -> DataFrame:
    def keep(batches):
        for b in batches:
            h1, h2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            yield b.filter(pa.array(_inside(bits, h1, h2, level)))

    return keys.mapInArrow(keep, "h1 long, h2 long")


def lookup_keys(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """Keys that a rule of at most so many labels and slashes can fit by, longest
    first: every suffix of whole labels with every beginning of the path up to a /."""
    names, parts = F.split(host, r"\."), F.split(path, "/", -1)
    count = F.least(F.size(names), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), count), lambda k: F.array_join(F.slice(names, F.size(names) - k + 1, k), "."))
    depth = F.least(F.size(parts) - 1, F.lit(slashes))
    starts = F.when(depth > 0, F.transform(F.sequence(F.lit(1), depth), lambda k: F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))).otherwise(
        F.array().cast("array<string>"))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(starts, lambda p: F.concat(s, p))))
    return F.transform(F.array_sort(F.transform(keys, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key")))), lambda x: x["key"])


def filter_urls(pages: DataFrame, block: DataFrame, allow: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``block`` and ``allow`` have a column ``key``: rules whose path ends in ``/``.
    A url that no rule fits is allowed. Of a key in both lists, block holds.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    rules = block.select("key", F.lit(True).alias("block")).union(allow.select("key", F.lit(False).alias("block")))
    reach = rules.agg(F.max(F.size(F.split(F.substring_index("key", "/", 1), r"\."))), F.max(F.size(F.split("key", "/")) - 1)).first()
    labels, slashes = (x or 0 for x in reach)
    rows = pages.withColumn("host", F.coalesce(host_of(F.col(url_col)), F.lit(""))).withColumn("path", F.coalesce(path_of(F.col(url_col)), F.lit(""))) \
        .withColumn("_keys", lookup_keys(F.col("host"), F.col("path"), max(labels, 1), slashes))
    universe = checkpointed(rows.select(F.explode("_keys").alias("key")).distinct().select(_pair(F.col("key")).alias("h")).select("h.*"))
    lists = [checkpointed(x.select(_pair(F.col("key")).alias("h")).select("h.*").distinct()) for x in (block, allow)]
    cascades = [build_cascade(x, universe) for x in lists]
    if any(c is None for c in cascades):
        return _joined(rows, rules)
    schema = [*rows.columns]

    def judge(batches):
        for b in batches:
            keys, at = b.column("_keys").flatten(), b.column("_keys").offsets.to_numpy()
            at = at - at[0]
            h1, h2 = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("_h1", "_h2"))
            blocks, allows = (c.contains(h1, h2) for c in cascades)
            hit = np.flatnonzero(blocks | allows)
            first = np.searchsorted(hit, at[:-1])
            has = (first < len(hit)) & (at[1:] > at[:-1])
            has[has] = hit[first[has]] < at[1:][has]
            place = np.where(has, hit[np.minimum(first, max(len(hit) - 1, 0))] if len(hit) else 0, 0)
            rule = keys.take(pa.array(place, mask=~has)) if len(keys) else pa.nulls(b.num_rows, pa.string())
            blocked = has & (blocks[place] if len(blocks) else False)
            verdict = pa.array(np.where(blocked, "block", "allow"), pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in schema if c != "_keys"), rule, verdict], names=[*(c for c in schema if c != "_keys"), "rule", "verdict"])

    hashes = rows.withColumn("_h1", F.transform("_keys", lambda k: hashed(k)[0])).withColumn("_h2", F.transform("_keys", lambda k: hashed(k)[1]))
    out = rows.drop("_keys").withColumn("rule", F.lit("")).withColumn("verdict", F.lit("")).schema
    for f in out.fields:
        f.nullable = True
    return hashes.mapInArrow(judge, out)


def _joined(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The same answers by a join, for lists too long for a cascade in memory."""
    listed = rules.groupBy("key").agg(F.max("block").alias("block"))
    keyed = rows.withColumn("_row", F.monotonically_increasing_id())
    keyed = checkpointed(keyed)
    best = keyed.select("_row", F.explode("_keys").alias("key")).join(listed, "key") \
        .groupBy("_row").agg(F.min(F.struct((-F.length("key")).alias("n"), "key", "block")).alias("best"))
    return keyed.drop("_keys").join(best, "_row", "left").select(
        *(c for c in rows.columns if c != "_keys"), F.col("best.key").alias("rule"),
        F.when(F.col("best.block"), "block").otherwise("allow").alias("verdict"))


def _pair(key: Column) -> Column:
    return F.struct(*(h.alias(n) for n, h in zip(("h1", "h2"), hashed(key))))


def with_listed_label(rows: DataFrame, names: DataFrame, host: str = "host", out: str = "listed") -> DataFrame:
    """Add whether one of a host's labels is a ``name`` of the list, by a cascade over all
    labels of all hosts."""
    bounded_batches(rows.sparkSession)
    labels = F.split(F.coalesce(F.col(host), F.lit("")), r"\.")
    universe = checkpointed(rows.select(F.explode(labels).alias("key")).distinct().select(_pair(F.col("key")).alias("h")).select("h.*"))
    listed = checkpointed(names.select(_pair(F.col("name")).alias("h")).select("h.*").distinct())
    cascade = build_cascade(listed, universe)
    if cascade is None:
        held = rows.select(F.col(host).alias("_host"), F.explode(labels).alias("name")).distinct().join(names.select("name").distinct(), "name", "left_semi")
        return rows.join(held.select("_host").distinct().withColumn(out, F.lit(True)), F.col(host) == F.col("_host"), "left") \
            .drop("_host").withColumn(out, F.coalesce(F.col(out), F.lit(False)))
    kept = rows.columns

    def judge(batches):
        for b in batches:
            h1, h2 = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("_h1", "_h2"))
            at = b.column("_h1").offsets.to_numpy()
            found = np.concatenate([[0], np.cumsum(cascade.contains(h1, h2))])
            at = at - at[0]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(found[at[1:]] > found[at[:-1]])], names=[*kept, out])

    schema = rows.withColumn(out, F.lit(True)).schema
    for f in schema.fields:
        f.nullable = True
    return rows.withColumn("_h1", F.transform(labels, lambda k: hashed(k)[0])).withColumn("_h2", F.transform(labels, lambda k: hashed(k)[1])).mapInArrow(judge, schema)


def url_verdicts(pages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict, by the four fixed rules and, where none
    fits, by a list of host labels (a column ``name``; by default BLOCKED_NAMES)."""
    spark = pages.sparkSession
    table = lambda column, values: spark.createDataFrame(pa.table({column: list(values)}))
    if names is None:
        names = table("name", BLOCKED_NAMES)
    block, allow = table("key", ["net/", "example.com/de/"]), table("key", ["example.net/en/", "org/fr/"])
    judged = with_listed_label(filter_urls(pages.select("page_id", "url"), block, allow), names)
    verdict = F.when(F.col("rule").isNull() & F.col("listed"), "block").otherwise(F.col("verdict"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
