"""JOB-2 to JOB-4 as batch plans over readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from seqwatch import names
from seqwatch.functions import sequences
from seqwatch.operators import scaling, scoring, windows
from seqwatch.plans.detector import Detector


def flatten_window(df: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The window struct as ``window_start`` and ``window_end``, other columns as they are."""
    rest = [c for c in df.columns if c != "window" and c not in carry]
    return df.select(
        *carry,
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        *rest,
    )


def score_windows(
    windowed: DataFrame,
    detector: Detector,
    keep_incomplete: bool = False,
    float32: bool = False,
) -> DataFrame:
    """Scores of ready windows; the same on batch and stream."""
    return scoring.score(
        windowed,
        detector.model,
        detector.threshold,
        detector.channels,
        detector.steps,
        keep_incomplete,
        float32,
    )


def score_readings(
    readings: DataFrame,
    detector: Detector,
    *,
    time_col: str = "timestamp",
    tie_cols: Sequence[str] = (),
    series_keys: Sequence[str] = (),
    on_overflow: str = "error",
    keep_incomplete: bool = False,
    float32: bool = False,
) -> DataFrame:
    """Readings to scored sliding windows."""
    windowed = windows.sliding_sequences(
        scaling.scale(readings, detector.scaler, detector.channels),
        detector.channels,
        time_col=time_col,
        tie_cols=tie_cols,
        series_keys=series_keys,
        steps=detector.steps,
        on_overflow=on_overflow,
    )
    return score_windows(windowed, detector, keep_incomplete, float32)


def window_shapes(
    windowed: DataFrame,
    threshold: DataFrame | Sequence[float],
    channels: Sequence[str] = names.CHANNELS,
    steps: int = names.STEPS,
) -> DataFrame:
    """Shape texts of complete windows, next to the thresholds; no model."""
    limits = scoring.threshold_columns(threshold, channels)
    return windowed.filter(scoring.is_complete(F.col("features"), steps)).withColumns(
        {
            "shape_before": sequences.shape_text(F.col("features")),
            "shape_after": sequences.shape_text(F.col("features"), batched=True),
        }
        | {f"threshold_{c}": t for c, t in zip(channels, limits)}
    )
