"""Guarded ratios and conditional counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part`` as a percentage of ``whole``, 0 when the whole is 0 or missing."""
    return (F.when(whole > 0, F.round(F.lit(100.0) * part / whole, digits))
            .otherwise(F.lit(0.0)).cast("double"))


def whole_percent(part: Column, whole: Column) -> Column:
    """Percentage without decimals."""
    return percent(part, whole, 0)


def count_in(status: Column, values: list[str]) -> Column:
    """Number of rows whose status is one of the values."""
    return F.count_if(status.isin(values))
