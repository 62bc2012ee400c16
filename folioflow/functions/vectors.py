"""Expressions over embedding arrays."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F


def has_nan(vector: Column | str) -> Column:
    """True when an element is NaN; false for a null vector."""
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.coalesce(F.exists(column, lambda x: F.isnan(x)), F.lit(False))


def all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def all_clean(columns: Sequence[str]) -> Column:
    """No vector is null and none holds a NaN."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~has_nan(c) for c in columns])


def nan_to_zero(vector: Column | str) -> Column:
    column = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(column, lambda x: F.when(F.isnan(x), F.lit(0).cast("float")).otherwise(x))


def concat_features(columns: Sequence[Column | str], element: str = "double") -> Column:
    """The vectors side by side, in the given order, in double precision unless asked otherwise."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast(f"array<{element}>") for c in columns]
    return F.concat(*parts)


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logistic_probability(features: Column, coefficients: Column | Sequence[float], intercept: float) -> Column:
    """P(positive) for fixed coefficients."""
    if not isinstance(coefficients, Column):
        coefficients = F.array(*[F.lit(float(c)) for c in coefficients])
    return sigmoid(dot(features, coefficients) + F.lit(float(intercept)))


def interpolate(start: Column, end: Column, alpha: Column) -> Column:
    """``start + alpha * (end - start)`` element by element."""
    return F.zip_with(start, end, lambda a, b: a + alpha * (b - a))
