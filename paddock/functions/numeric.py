"""Number functions that keep null and rounding rules in one place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_even(col: Column, digits: int) -> Column:
    """Round half to even after scaling, the way array libraries round doubles; never the
    negative zero."""
    factor = float(10**digits)
    return F.rint(col * factor) / factor + F.lit(0.0)


def round_half_up(col: Column, digits: int) -> Column:
    """Round half away from zero after scaling, the way SQL engines round doubles; never the
    negative zero."""
    factor = float(10**digits)
    return F.round(col * factor, 0) / factor + F.lit(0.0)


def flag(condition: Column) -> Column:
    """Comparison that is false, never null, when a side is missing."""
    return F.coalesce(condition, F.lit(False))


def clip(col: Column, low: float, high: float) -> Column:
    """Value held inside [low, high]; null stays null."""
    return F.when(col.isNotNull(), F.greatest(F.least(col, F.lit(high)), F.lit(low)))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, null when the bottom is zero."""
    return top / F.nullif(bottom, F.lit(0).cast("double"))


def to_units(col: Column, scale: int | None) -> Column:
    """Value as a whole number of its last decimal, or as double without a scale.

    Sums of whole numbers are exact, so they do not depend on the order in which executors
    deliver their parts, and they are added as primitive longs. A sum beyond a long is an
    error, not a wrong result."""
    return col.cast("double") if scale is None else F.rint(col * float(10**scale)).cast("bigint")


def from_units(col: Column, scale: int | None) -> Column:
    return col.cast("double") if scale is None else col.cast("double") / float(10**scale)


def total(col: Column, scale: int | None = None) -> Column:
    """Sum as double, exact for values of at most ``scale`` decimals."""
    return from_units(F.sum(to_units(col, scale)), scale)


def mean(col: Column, scale: int | None = None) -> Column:
    """Mean of the values that are not null, with the summing of :func:`total`."""
    return total(col, scale) / F.nullif(F.count(col), F.lit(0))
