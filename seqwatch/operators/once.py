"""Evaluate costly columns once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def add_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add columns that are computed once per row, however often they are used.

    A plain projection is inlined into the filters and lambdas above it and then
    computed again for each use. A one-row ``inline`` is never merged with them.
    """
    packed = F.struct(*[c.alias(name) for name, c in columns.items()])
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(packed)))
