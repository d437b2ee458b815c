"""Result rows to key/value messages (PRJ-5, FN-4 to FN-8)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from seqwatch import names
from seqwatch.functions import times


def prediction_messages(
    scored: DataFrame, channels: Sequence[str] = names.CHANNELS, carry: Sequence[str] = ()
) -> DataFrame:
    """Flat score rows to messages that carry their event time, so they can be archived."""
    body = [
        F.col("window_start"),
        F.col("window_end"),
        F.unix_timestamp("window_end").alias(names.TIME_KEY),
        F.col("isAnomaly"),
        *[F.col(f"mae_{c}") for c in channels],
        *[F.col(f"threshold_{c}") for c in channels],
        F.col("features"),
        F.col("prediction"),
    ]
    return scored.select(
        *carry,
        F.to_json(F.struct(*body)).alias("value"),
        times.text_key(F.col("window_end")).alias("key"),
    )


def nested_prediction_messages(
    scored: DataFrame, channels: Sequence[str] = names.CHANNELS
) -> DataFrame:
    """The variant from rows that kept ``window`` as a struct; without an event time."""
    body = [
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        F.col("isAnomaly"),
        *[F.col(f"mae_{c}") for c in channels],
        *[F.col(f"threshold_{c}") for c in channels],
        F.col("features"),
        F.col("prediction"),
    ]
    return scored.select(
        F.to_json(F.struct(*body)).alias("value"),
        times.text_key(F.col("window.end")).alias("key"),
    )


def diagnostic_messages(
    shapes: DataFrame, channels: Sequence[str] = names.CHANNELS
) -> DataFrame:
    """Shape diagnostics to messages without a key."""
    body = [
        F.col("features"),
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        F.col("shape_before"),
        F.col("shape_after"),
        *[F.col(f"threshold_{c}") for c in channels],
    ]
    return shapes.select(F.to_json(F.struct(*body)).alias("value"))
