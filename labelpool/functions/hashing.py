"""Seeded, layout-independent pseudo-random numbers.

``rand(seed)`` depends on how rows are laid out in partitions, so the same
seed selects different rows after a repartition. Every random decision here
is instead a function of (seed, purpose, [round], id): the first 32 bits of
``md5('seed|purpose|round|id')``. The same number is produced by DuckDB as
``('0x' || substr(md5('seed|purpose|id'), 1, 8))::BIGINT``, which is what
the SQL oracles use.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPACE = 1 << 32


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seeded_hash(id_col: str | Column, purpose: str, seed: int = 42,
                round_no: int | None = None) -> Column:
    """Uniform integer in [0, 2^32) derived from the row id."""
    parts = [F.lit(str(seed)), F.lit(purpose)]
    if round_no is not None:
        parts.append(F.lit(str(round_no)))
    parts.append(_as_col(id_col).cast("string"))
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def hash_threshold(fraction: float) -> int:
    """Integer cut so that ``hash < cut`` holds for ``fraction`` of ids."""
    return int(fraction * HASH_SPACE)


def hash_below(id_col: str | Column, fraction: float, purpose: str,
               seed: int = 42, round_no: int | None = None) -> Column:
    """Boolean column: true for about ``fraction`` of ids, chosen by hash."""
    return seeded_hash(id_col, purpose, seed, round_no) < F.lit(hash_threshold(fraction))


def hash_sql(id_expr: str, purpose: str, seed: int = 42,
             round_no: int | None = None) -> str:
    """DuckDB text of :func:`seeded_hash` (used by the SQL oracles)."""
    prefix = f"{seed}|{purpose}|" + (f"{round_no}|" if round_no is not None else "")
    return f"('0x' || substr(md5('{prefix}' || CAST({id_expr} AS VARCHAR)), 1, 8))::BIGINT"
