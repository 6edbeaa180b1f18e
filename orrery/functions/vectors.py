"""Column expressions over vectors stored as arrays; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def l2_squared(a: Column, b: Column) -> Column:
    """Squared Euclidean distance in double precision; null where a side is null or lengths differ."""
    total = F.aggregate(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    return F.when(F.size(a) == F.size(b), total)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    return F.sqrt(l2_squared(a, b))


def is_finite(x: Column) -> Column:
    """True for a number that is neither null, NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def is_valid_vector(v: Column, dimension: int) -> Column:
    """True for an array of exactly ``dimension`` finite, non-null components; never null."""
    return F.coalesce((F.size(v) == dimension) & F.forall(v, is_finite), F.lit(False))
