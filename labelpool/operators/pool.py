"""Pool shaping: typing, feature vectors, standardisation, state, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelpool.functions.hashing import hash_below

LABELED, UNLABELED = "L", "U"


def feature_columns(df: DataFrame, prefix: str = "feature_") -> list[str]:
    """Columns whose name starts with ``prefix``, in table order."""
    return [c for c in df.columns if c.startswith(prefix)]


def cast_pool(df: DataFrame, id_col: str = "id_sample", label_col: str = "label",
              prefix: str = "feature_", feature_type: str = "float",
              policy: str = "keep") -> DataFrame:
    """Type the pool: id → bigint, label → int, features → ``feature_type``;
    other columns are carried through after them.

    Casts use ``try_cast`` (Spark 4 ANSI casts raise). ``policy`` says what a
    value that does not cast becomes: ``keep`` (null), ``skip`` (drop the row).
    The default float type repeats the float32 rounding of the published
    workflow; pass ``double`` to keep full precision.
    """
    feats = feature_columns(df, prefix)
    rest = [c for c in df.columns if c not in [id_col, label_col, *feats]]
    out = df.select(
        F.col(id_col).try_cast("bigint").alias(id_col),
        F.col(label_col).try_cast("int").alias(label_col),
        *[F.col(c).try_cast(feature_type).alias(c) for c in feats],
        *rest,
    )
    if policy == "skip":
        out = out.dropna(subset=[id_col, label_col, *feats])
    elif policy != "keep":
        raise ValueError(f"unknown null policy {policy!r}")
    return out


def assemble_features(df: DataFrame, feature_cols: Sequence[str] | None = None,
                      out: str = "features", handle_invalid: str = "error",
                      prefix: str = "feature_") -> DataFrame:
    """Assemble feature columns into one ML vector and drop the sources."""
    cols = list(feature_cols) if feature_cols else feature_columns(df, prefix)
    assembler = VectorAssembler(inputCols=cols, outputCol=out, handleInvalid=handle_invalid)
    return assembler.transform(df).drop(*cols)


def array_features(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    """``array<float|double>`` column → ML vector (native, no Python)."""
    return df.withColumn(out, array_to_vector(F.col(array_col))).drop(array_col) \
        if array_col != out else df.withColumn(out, array_to_vector(F.col(array_col)))


def vector_entries(df: DataFrame, id_col: str = "id_sample", features: str = "features",
                   decimals: int | None = 6) -> DataFrame:
    """Long form ``(id, pos, value)`` of a vector column."""
    arr = vector_to_array(F.col(features))
    exploded = df.select(F.col(id_col), F.posexplode(arr).alias("pos", "value"))
    if decimals is not None:
        exploded = exploded.withColumn("value", F.round("value", decimals))
    return exploded.withColumn("pos", F.col("pos").cast("int"))


def standardize(train: DataFrame, test: DataFrame | None = None,
                features: str = "features") -> tuple[DataFrame, DataFrame | None]:
    """Scale to zero mean / unit sample std, fitted on ``train`` only.

    The statistics are one distributed summary pass; the model (two vectors)
    is applied to both sides, so nothing of the test set leaks into training.
    A constant feature scales to 0.0.
    """
    scaler = StandardScaler(inputCol=features, outputCol="_lp_scaled", withMean=True, withStd=True)
    model = scaler.fit(train)

    def apply(df: DataFrame) -> DataFrame:
        return model.transform(df).drop(features).withColumnRenamed("_lp_scaled", features)

    return apply(train), (apply(test) if test is not None else None)


def init_state(df: DataFrame, fraction: float = 0.05, seed: int = 42,
               id_col: str = "id_sample", state_col: str = "state") -> DataFrame:
    """Initial ``state``: 'L' for about ``fraction`` of rows (by seeded hash), else 'U'."""
    return df.withColumn(
        state_col,
        F.when(hash_below(id_col, fraction, "state", seed), F.lit(LABELED)).otherwise(F.lit(UNLABELED)))


def labeled_rows(df: DataFrame, state_col: str = "state") -> DataFrame:
    return df.filter(F.col(state_col) == F.lit(LABELED))


def unlabeled_rows(df: DataFrame, state_col: str = "state") -> DataFrame:
    return df.filter(F.col(state_col) == F.lit(UNLABELED))


def state_counts(df: DataFrame, state_col: str = "state") -> DataFrame:
    """One row ``(labeled, unlabeled, total)`` in a single pass."""
    return df.select(
        F.count_if(F.col(state_col) == F.lit(LABELED)).alias("labeled"),
        F.count_if(F.col(state_col) == F.lit(UNLABELED)).alias("unlabeled"),
        F.count(F.lit(1)).alias("total"),
    )


def class_distribution(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``(label, n, fraction)`` sorted by label; the total is a window over
    the per-class table (one row per class), not over the data."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select(label_col, "n", (F.col("n") / total).alias("fraction")).orderBy(label_col)


def duplicate_ids(df: DataFrame, id_col: str = "id_sample") -> int:
    """Number of ids that occur more than once (0 for a valid pool). On a
    table bucketed or hash-partitioned by the id this is a scan, no shuffle."""
    return (df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_lp_n"))
            .filter(F.col("_lp_n") > 1).count())


def round_cols(df: DataFrame, cols: Sequence[str], decimals: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(c), decimals).alias(c) if c in cols else F.col(c) for c in df.columns])
