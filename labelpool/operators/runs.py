"""Analysis of run tables: means of repeats, ratios to a reference row,
the speed-up / size-up / scale-up tables and the learning-curve pivot.

Each ratio is a conditional ``first`` over a window partitioned by the
matching columns, so the reference row is found without a self-join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_KEYS = ("method", "cores", "percentage_set")


def mean_runs(runs: DataFrame, keys: Sequence[str] = RUN_KEYS, value: str = "time") -> DataFrame:
    """Mean of repeated measurements per configuration."""
    return runs.groupBy(*keys).agg(F.avg(value).alias(value))


def ratio_to_reference(means: DataFrame, match: Sequence[str], is_reference: Column,
                       out: str, value: str = "time", reference_over_value: bool = True) -> DataFrame:
    """Add ``reference_<value>`` (the value of the row matching
    ``is_reference`` within the same ``match`` group) and ``out`` =
    reference / value (or value / reference). Rows without a reference row
    get nulls, as a left join would."""
    w = Window.partitionBy(*match)
    ref = F.first(F.when(is_reference, F.col(value)), ignorenulls=True).over(w)
    df = means.withColumn("reference_time", ref)
    ratio = (F.col("reference_time") / F.col(value)) if reference_over_value \
        else (F.col(value) / F.col("reference_time"))
    return df.withColumn(out, ratio)


def speed_up(means: DataFrame) -> DataFrame:
    """T(1 core) / T(n cores) per (method, dataset size)."""
    return ratio_to_reference(means, ["method", "percentage_set"], F.col("cores") == 1, "speed_up")


def size_up(means: DataFrame) -> DataFrame:
    """T(size) / T(10 %) per (method, cores)."""
    return ratio_to_reference(means, ["method", "cores"], F.col("percentage_set") == 10,
                              "size_up", reference_over_value=False)


def scale_up(means: DataFrame) -> DataFrame:
    """T(1 core, 10 %) / T(n cores, size) per method, with the
    ``'<cores>C / <pct>%'`` label; sort by (cores, size) when presenting."""
    df = ratio_to_reference(means, ["method"], (F.col("cores") == 1) & (F.col("percentage_set") == 10),
                            "scale_up")
    return df.withColumn("configuration", F.concat(F.col("cores").cast("string"), F.lit("C / "),
                                                   F.col("percentage_set").cast("string"), F.lit("%")))


def learning_curve_pivot(curve: DataFrame, methods: Sequence[str] = (),
                         names: Mapping[str, str] | None = None,
                         index: str = "labeled_percentage", method: str = "method",
                         value: str = "accuracy", decimals: int = 4) -> DataFrame:
    """One row per labelled share, one column per method of the table:
    ``methods`` come first, in their order, then all others by name. Repeated
    (share, method) rows are averaged instead of failing."""
    names = dict(names or {})
    found = [r[0] for r in curve.select(method).where(F.col(method).isNotNull()).distinct().orderBy(method).collect()]  # one name a method
    methods = [*methods, *(m for m in found if m not in methods)]
    wide = curve.groupBy(index).pivot(method, list(methods)).agg(F.avg(value))
    return wide.select(index, *[F.round(F.col(f"`{m}`"), decimals).alias(names.get(m, m)) for m in methods])
