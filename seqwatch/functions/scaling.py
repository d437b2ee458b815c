"""The min-max expression."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def min_max(x: Column, low: Column, high: Column) -> Column:
    """``(x - low) / (high - low)``; 0.5 for a constant channel; values outside
    the fitted range are not clamped."""
    x = x.cast("double")
    return F.when(high == low, F.when(x.isNotNull(), F.lit(0.5))).otherwise(
        (x - low) / (high - low)
    )
