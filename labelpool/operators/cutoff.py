"""Exact order statistics without a global sort or a single-task window.

``orderBy(...).limit(k)`` ends in one merge task holding ``k`` rows, and
``row_number()`` over an unpartitioned window moves every row into one task.
Both break when ``k`` is a fixed share of a very large pool (the query batch
is 1 % of the pool, the candidate set 10 %). Instead we find the boundary row
(the k-th smallest by ``(key, tie)``) by counting rows per bucket of the key,
keeping only the bucket that holds the boundary, and refining inside it:

* level: ``count`` per (group, bucket) of the rows still in range — a
  partial/final hash aggregate, so a hot group is pre-aggregated map-side;
* the cumulative count runs over the small bucket table, one window per
  group of at most ``2^bucket_bits`` rows;
* the bucket that holds the k-th row becomes the new range; if all its rows
  share one key value the refinement continues on the tie column (ids are
  unique, so it always terminates);
* a range always shrinks, as its two ends lie in different buckets, and infinite
  keys are counted at the ends of the finite range;
* once a group's range holds at most ``final_rows`` rows a ``row_number``
  over just those rows names the boundary.

Selecting the k smallest is then a plain filter ``(key, tie) <= boundary``
(a literal filter for one group; a join with the per-group boundary table
otherwise, broadcast only when the number of groups is checked to be small).
"""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelpool.config import BROADCAST_MAX_ROWS
from labelpool.session import small_frame

_GROUP0 = "_lp_g0"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


_LARGEST = sys.float_info.max


def _finite(key: Column) -> Column:
    """The key as a double, with infinite ones at the ends of the finite range:
    so one infinite key fills an end bucket and does not widen the others."""
    k = key.cast("double")
    return F.when(k.isNull() | F.isnan(k), k).otherwise(F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), k)))


def _unbounded(key: float) -> float:
    return math.copysign(math.inf, key) if abs(key) == _LARGEST else key


def _maybe_broadcast(small: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(small) if n_rows <= BROADCAST_MAX_ROWS else small


def kth_smallest(df: DataFrame, key: str | Column, tie: str | Column,
                 k: int | str, by: Sequence[str] = (), *,
                 bucket_bits: int = 12, final_rows: int = 1 << 18) -> DataFrame:
    """Per group, the k-th smallest row by ``(key asc, tie asc)``, 1-based.

    ``k`` is an int or the name of a column constant within each group. A
    group with ``k > n`` yields its largest row; groups with ``k < 1`` and
    rows with a null key, tie or group are left out.

    Returns ``(by..., kth_key double, kth_tie bigint, need bigint)``.
    """
    by = list(by)
    if not by and isinstance(k, int):
        found = _kth_global(df, key, tie, int(k), bucket_bits=bucket_bits, final_rows=min(final_rows, 1 << 16))
        one = df.sparkSession.range(1)
        if found is None:
            return one.filter(F.lit(False)).select(
                F.lit(None).cast("double").alias("kth_key"), F.lit(None).cast("bigint").alias("kth_tie"),
                F.lit(None).cast("bigint").alias("need"))
        return one.select(F.lit(found[0]).cast("double").alias("kth_key"),
                          F.lit(found[1]).cast("bigint").alias("kth_tie"),
                          F.lit(found[2]).cast("bigint").alias("need"))
    gcols = by if by else [_GROUP0]
    nb = 1 << bucket_bits
    k_col = F.lit(int(k)) if isinstance(k, int) else F.col(k)
    grp = [F.col(c) for c in by] if by else [F.lit(0).alias(_GROUP0)]
    base = df.select(
        *grp,
        _finite(_col(key)).alias("_k"),
        _col(tie).cast("bigint").alias("_t"),
        k_col.cast("bigint").alias("_q"),
    )
    cond = F.col("_k").isNotNull() & F.col("_t").isNotNull() & ~F.isnan("_k")
    for c in by:
        cond = cond & F.col(c).isNotNull()
    base = base.filter(cond).persist(StorageLevel.MEMORY_AND_DISK)

    pending = (
        base.groupBy(*gcols)
        .agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("lo_k"), F.max("_k").alias("hi_k"),
             F.min("_t").alias("lo_t"), F.max("_t").alias("hi_t"), F.max("_q").alias("need"))
        .filter(F.col("need") >= 1)
        .withColumn("need", F.least(F.col("need"), F.col("n")))
        .persist(StorageLevel.MEMORY_AND_DISK)
    )
    finished: list[DataFrame] = []
    cached = [pending]

    def in_range() -> Column:
        key_mode = F.col("lo_k") < F.col("hi_k")
        return ((F.col("_k") >= F.col("lo_k")) & (F.col("_k") <= F.col("hi_k"))
                & (key_mode | ((F.col("_t") >= F.col("lo_t")) & (F.col("_t") <= F.col("hi_t")))))

    def sizes(frame: DataFrame) -> tuple[int, int]:
        # one action: number of groups and how many still exceed final_rows
        row = frame.agg(F.count(F.lit(1)).alias("g"),
                        F.count_if(F.col("n") > final_rows).alias("big")).first()
        return int(row["g"]), int(row["big"])

    n_groups, n_large = sizes(pending)
    while True:
        finished.append(pending.filter(F.col("n") <= final_rows))
        if n_large == 0:
            break
        large = pending.filter(F.col("n") > final_rows)
        key_mode = F.col("lo_k") < F.col("hi_k")
        frac = F.when(key_mode, (F.col("_k") / 2 - F.col("lo_k") / 2) / (F.col("hi_k") / 2 - F.col("lo_k") / 2)) \
            .otherwise((F.col("_t") - F.col("lo_t")).cast("double")
                       / (F.col("hi_t") - F.col("lo_t") + F.lit(1)).cast("double"))
        bucket = F.least(F.greatest(F.floor(frac * F.lit(nb)), F.lit(0)), F.lit(nb - 1))
        rows = (base.join(_maybe_broadcast(large, n_large), gcols)
                .filter(in_range())
                .withColumn("_b", bucket))
        counts = rows.groupBy(*gcols, "_b").agg(
            F.count(F.lit(1)).alias("c"), F.min("_k").alias("b_lo_k"), F.max("_k").alias("b_hi_k"),
            F.min("_t").alias("b_lo_t"), F.max("_t").alias("b_hi_t"), F.max("need").alias("need"))
        w = Window.partitionBy(*gcols).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        counts = counts.withColumn("cum", F.sum("c").over(w))
        pending = (counts.filter((F.col("cum") - F.col("c") < F.col("need")) & (F.col("need") <= F.col("cum")))
                   .select(*gcols,
                           F.col("c").alias("n"),
                           F.col("b_lo_k").alias("lo_k"), F.col("b_hi_k").alias("hi_k"),
                           F.col("b_lo_t").alias("lo_t"), F.col("b_hi_t").alias("hi_t"),
                           (F.col("need") - (F.col("cum") - F.col("c"))).alias("need"))
                   .persist(StorageLevel.MEMORY_AND_DISK))
        cached.append(pending)
        _, n_large = sizes(pending)

    ranges = finished[0]
    for extra in finished[1:]:
        ranges = ranges.unionByName(extra)
    w = Window.partitionBy(*gcols).orderBy("_k", "_t")
    result = (base.join(_maybe_broadcast(ranges, n_groups), gcols)
              .filter(in_range())
              .withColumn("_rn", F.row_number().over(w))
              .filter(F.col("_rn") == F.col("need"))
              .select(*gcols, F.when(F.abs("_k") == F.lit(_LARGEST), F.signum("_k") * F.lit(math.inf)).otherwise(F.col("_k")).alias("kth_key"),
                      F.col("_t").alias("kth_tie"), "need")
              .persist(StorageLevel.MEMORY_AND_DISK))
    result.count()
    for c in cached:
        c.unpersist()
    base.unpersist()
    if not by:
        result = result.drop(_GROUP0)
    return result


def _kth_global(df: DataFrame, key: str | Column, tie: str | Column, k: int, *,
                bucket_bits: int = 12, final_rows: int = 1 << 16) -> tuple[float, int, int] | None:
    """One group: the state is a single row, so each level's range is a
    literal filter and its histogram (at most 2^bucket_bits counts, a bounded
    summary like a quantile sketch) is cumulated on the driver, as are the
    last range's at most ``final_rows`` pairs (1 MB by default). About two
    jobs when the data fits ``final_rows``, one more per refinement level."""
    nb = 1 << bucket_bits
    base = (df.select(_finite(_col(key)).alias("_k"), _col(tie).cast("bigint").alias("_t"))
            .filter(F.col("_k").isNotNull() & F.col("_t").isNotNull() & ~F.isnan("_k"))
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        st = base.agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("lo_k"), F.max("_k").alias("hi_k"),
                      F.min("_t").alias("lo_t"), F.max("_t").alias("hi_t")).first()
        n = int(st["n"])
        if k < 1 or n == 0:
            return None
        need = min(k, n)
        lo_k, hi_k, lo_t, hi_t = st["lo_k"], st["hi_k"], int(st["lo_t"]), int(st["hi_t"])

        def in_range() -> Column:
            c = (F.col("_k") >= F.lit(lo_k)) & (F.col("_k") <= F.lit(hi_k))
            if lo_k == hi_k:
                c = c & (F.col("_t") >= F.lit(lo_t)) & (F.col("_t") <= F.lit(hi_t))
            return c

        while n > final_rows:
            if lo_k < hi_k:
                frac = (F.col("_k") / 2 - F.lit(lo_k / 2)) / F.lit(hi_k / 2 - lo_k / 2)
            else:
                frac = (F.col("_t") - F.lit(lo_t)).cast("double") / F.lit(float(hi_t - lo_t + 1))
            bucket = F.least(F.greatest(F.floor(frac * F.lit(nb)), F.lit(0)), F.lit(nb - 1))
            hist = (base.filter(in_range()).groupBy(bucket.alias("b"))
                    .agg(F.count(F.lit(1)).alias("c"), F.min("_k").alias("lk"), F.max("_k").alias("hk"),
                         F.min("_t").alias("lt"), F.max("_t").alias("ht"))
                    .collect())
            before = 0
            for r in sorted(hist, key=lambda r: r["b"]):
                if before + r["c"] >= need:
                    need -= before
                    n = int(r["c"])
                    lo_k, hi_k, lo_t, hi_t = r["lk"], r["hk"], int(r["lt"]), int(r["ht"])
                    break
                before += r["c"]
        # the last range: at most final_rows pairs of numbers
        last = base.filter(in_range()).toArrow()
        keys, ties = (last.column(c).to_numpy() for c in ("_k", "_t"))
        at = np.lexsort((ties, keys))[need - 1]
        return _unbounded(float(keys[at])), int(ties[at]), int(need)
    finally:
        base.unpersist()


FEW_GROUPS = 64


def _kth_few_groups(df: DataFrame, key: str | Column, tie: str | Column, k: int | str,
                    group: str, *, bucket_bits: int = 12, final_rows: int = 1 << 18) -> dict | None:
    """Per-group boundaries for one group column with at most ``FEW_GROUPS``
    values (class strata, a few clusters): per-group ranges and histograms
    are literal predicates, so there is no join and few jobs. ``None`` when
    there are more groups (the caller then takes the all-Spark path)."""
    k_col = F.lit(int(k)) if isinstance(k, int) else F.col(k)
    base = (df.select(F.col(group).alias("_g"), _finite(_col(key)).alias("_k"),
                      _col(tie).cast("bigint").alias("_t"), k_col.cast("bigint").alias("_q"))
            .filter(F.col("_g").isNotNull() & F.col("_k").isNotNull() & F.col("_t").isNotNull()
                    & ~F.isnan("_k"))
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        stats = (base.groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.min("_k").alias("lk"),
                                        F.max("_k").alias("hk"), F.min("_t").alias("lt"),
                                        F.max("_t").alias("ht"), F.max("_q").alias("q"))
                 .limit(FEW_GROUPS + 1).collect())
        if len(stats) > FEW_GROUPS:
            return None
        # group value -> [n, need, lo_k, hi_k, lo_t, hi_t]
        st = {r["_g"]: [int(r["n"]), min(int(r["q"]), int(r["n"])), r["lk"], r["hk"], int(r["lt"]), int(r["ht"])]
              for r in stats if r["q"] is not None and int(r["q"]) >= 1}
        if not st:
            return {}

        def in_range(g) -> Column:
            n, need, lk, hk, lt, ht = st[g]
            c = (F.col("_g") == F.lit(g)) & (F.col("_k") >= F.lit(lk)) & (F.col("_k") <= F.lit(hk))
            if lk == hk:
                c = c & (F.col("_t") >= F.lit(lt)) & (F.col("_t") <= F.lit(ht))
            return c

        def any_range(groups) -> Column:
            c = F.lit(False)
            for g in groups:
                c = c | in_range(g)
            return c

        while True:
            large = [g for g, v in st.items() if v[0] > final_rows]
            if not large:
                break
            bits = max(4, min(bucket_bits, int(math.log2(65536 / len(large)))))
            nb = 1 << bits
            frac = None
            for g in large:
                n, need, lk, hk, lt, ht = st[g]
                f = ((F.col("_k") / 2 - F.lit(lk / 2)) / F.lit(hk / 2 - lk / 2)) if lk < hk else \
                    ((F.col("_t") - F.lit(lt)).cast("double") / F.lit(float(ht - lt + 1)))
                frac = F.when(F.col("_g") == F.lit(g), f) if frac is None else frac.when(F.col("_g") == F.lit(g), f)
            bucket = F.least(F.greatest(F.floor(frac * F.lit(nb)), F.lit(0)), F.lit(nb - 1))
            hist = (base.filter(any_range(large)).groupBy("_g", bucket.alias("b"))
                    .agg(F.count(F.lit(1)).alias("c"), F.min("_k").alias("lk"), F.max("_k").alias("hk"),
                         F.min("_t").alias("lt"), F.max("_t").alias("ht")).collect())
            by_group: dict = {}
            for r in hist:
                by_group.setdefault(r["_g"], []).append(r)
            for g in large:
                before, need = 0, st[g][1]
                for r in sorted(by_group.get(g, []), key=lambda r: r["b"]):
                    if before + r["c"] >= need:
                        st[g] = [int(r["c"]), need - before, r["lk"], r["hk"], int(r["lt"]), int(r["ht"])]
                        break
                    before += r["c"]
        need_of = None
        for g, v in st.items():
            need_of = F.when(F.col("_g") == F.lit(g), F.lit(v[1])) if need_of is None \
                else need_of.when(F.col("_g") == F.lit(g), F.lit(v[1]))
        w = Window.partitionBy("_g").orderBy("_k", "_t")   # at most final_rows rows per group
        rows = (base.filter(any_range(st)).withColumn("_rn", F.row_number().over(w))
                .filter(F.col("_rn") == need_of).select("_g", "_k", "_t").collect())
        return {r["_g"]: (_unbounded(float(r["_k"])), int(r["_t"])) for r in rows}
    finally:
        base.unpersist()


def select_smallest(df: DataFrame, key: str | Column, tie: str | Column,
                    k: int | str, by: Sequence[str] = (), **kw) -> DataFrame:
    """Rows of ``df`` among the ``k`` smallest by ``(key, tie)`` in each group.

    Exact: with a unique tie column exactly ``min(k, n)`` rows per group.
    """
    by = list(by)
    key_c = _col(key).cast("double")
    tie_c = _col(tie).cast("bigint")
    if isinstance(k, int) and k <= 0:
        return df.filter(F.lit(False))
    if not by and isinstance(k, int):
        found = _kth_global(df, key, tie, int(k), **kw)
        if found is None:
            return df.filter(F.lit(False))
        kk, kt = found[0], found[1]
        return df.filter((key_c < F.lit(kk)) | ((key_c == F.lit(kk)) & (tie_c <= F.lit(kt))))
    if len(by) == 1:
        few = _kth_few_groups(df, key, tie, k, by[0], **kw)
        if few is not None:
            if not few:
                return df.filter(F.lit(False))
            keep = F.lit(False)
            for g, (kk, kt) in few.items():
                keep = keep | ((F.col(by[0]) == F.lit(g))
                               & ((key_c < F.lit(kk)) | ((key_c == F.lit(kk)) & (tie_c <= F.lit(kt)))))
            return df.filter(keep)
    bounds = kth_smallest(df, key, tie, k, by, **kw)
    n_bounds = bounds.count()
    b = bounds.select(*by, "kth_key", "kth_tie")
    return (df.join(_maybe_broadcast(b, n_bounds), by)
            .filter((key_c < F.col("kth_key"))
                    | ((key_c == F.col("kth_key")) & (tie_c <= F.col("kth_tie"))))
            .drop("kth_key", "kth_tie"))


def exact_quantile(df: DataFrame, col: str | Column, q: float, tie: str | Column,
                   n: int | None = None) -> float | None:
    """Exact q-quantile with the rank ``max(1, ceil(q·n))`` of Spark's
    ``approxQuantile(..., 0.0)`` (= DuckDB ``quantile_disc``), found without
    an exact GK summary (whose size grows with n)."""
    if n is None:
        n = df.filter(_col(col).isNotNull()).count()
    if n == 0:
        return None
    rank = max(1, math.ceil(q * n))
    found = _kth_global(df, col, tie, min(rank, n))
    return None if found is None else found[0]


def hash_bucket_bits(n: int, target_rows: int = 1 << 17, max_bits: int = 20) -> int:
    """Bits of a 32-bit uniform hash giving buckets of about ``target_rows``."""
    if n <= target_rows:
        return 0
    return min(max_bits, max(0, math.ceil(math.log2(n / target_rows))))


def dense_ids(df: DataFrame, hash_col: str, tie: str, out: str,
              n: int | None = None, target_rows: int = 1 << 17) -> DataFrame:
    """Ids ``0..n-1`` in the order ``(hash_col, tie)`` without a global sort.

    ``hash_col`` is a uniform 32-bit hash, so its top bits cut the rows into
    equal buckets: a count per bucket gives each bucket's offset, and
    ``row_number`` inside each bucket gives the rest. Offsets are prefix sums on
    two levels: over the at most 2^10 buckets of a group, and over the at most
    2^10 groups. Only the in-bucket numbering shuffles the rows, by bucket.
    """
    if n is None:
        n = df.count()
    bits = hash_bucket_bits(n, target_rows)
    bucket = F.shiftright(F.col(hash_col), 32 - bits) if bits else F.lit(0).cast("bigint")
    tagged = df.withColumn("_lp_b", bucket)
    counts = tagged.groupBy("_lp_b").agg(F.count(F.lit(1)).alias("_lp_c"))
    group = F.shiftright(F.col("_lp_b"), 10)
    totals = counts.groupBy(group.alias("_lp_g")).agg(F.sum("_lp_c").alias("c")).collect()   # at most 2^10 rows
    before, bases = 0, []
    for r in sorted(totals, key=lambda r: r["_lp_g"]):
        bases.append((r["_lp_g"], before))
        before += r["c"]
    starts = small_frame(df.sparkSession, bases, T.StructType([T.StructField("_lp_g", T.LongType()), T.StructField("_lp_base", T.LongType())]))
    inside = Window.partitionBy("_lp_g").orderBy("_lp_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.withColumn("_lp_g", group).join(F.broadcast(starts), "_lp_g").select(
        "_lp_b", (F.col("_lp_base") + F.sum("_lp_c").over(inside) - F.col("_lp_c")).alias("_lp_off"))
    w = Window.partitionBy("_lp_b").orderBy(F.col(hash_col), F.col(tie))
    # at most 2^20 bucket rows: a bounded broadcast
    return (tagged.withColumn("_lp_rn", F.row_number().over(w))
            .join(F.broadcast(offsets), "_lp_b")
            .withColumn(out, (F.col("_lp_off") + F.col("_lp_rn") - F.lit(1)).cast("bigint"))
            .drop("_lp_b", "_lp_rn", "_lp_off"))
