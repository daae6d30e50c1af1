"""Scalar expressions used for scoring and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def binary_uncertainty(p1: Column) -> Column:
    """``1 - 2 |P(y=1) - 0.5|``: 1 at the decision boundary, 0 when certain."""
    return F.lit(1.0) - F.lit(2.0) * F.abs(p1 - F.lit(0.5))


def logistic(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two equal-length numeric arrays.

    Built from ``zip_with`` + ``aggregate`` so it stays a native expression
    (no Python worker, no RDD).
    """
    diffs = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, x: acc + x)
