"""Aggregates and numeric rules over measured columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def total(column, kind: str = "decimal(8,2)") -> Column:
    """Exact sum: of measures as DECIMAL(18,2), with room for 10^16 and still held in one
    long; of whole numbers with ``kind="long"``."""
    return F.sum(F.col(column).cast(kind))


def exact_mean(column, kind: str = "decimal(8,2)") -> Column:
    """Mean from the exact sum, so it does not depend on the order of rows."""
    return F.try_divide(total(column, kind).cast("double"), F.count(F.col(column)))


def mean(column, digits: int = 6, kind: str = "decimal(8,2)") -> Column:
    return F.round(exact_mean(column, kind), digits)


def calibrated(weight: Column, offset: Column) -> Column:
    """Weight plus its device's offset; the result is rounded once, when stored."""
    shift = F.coalesce(offset, F.lit(0.0))
    shifted = (weight.cast("double") + shift).try_cast("decimal(8,2)")
    return F.when(weight.isNotNull() & (shift != 0.0), shifted).otherwise(
        weight.try_cast("decimal(8,2)"))


def one_decimal(value: Column) -> Column:
    """Text with one decimal, rounded half up from the printed value."""
    return value.cast("decimal(20,1)").cast("string")
