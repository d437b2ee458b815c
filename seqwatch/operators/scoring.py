"""Reconstruction error against a threshold (SCR-1 to SCR-3, FLT-1, FLT-4, FLT-5, JOIN-1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from seqwatch import names
from seqwatch.functions import sequences
from seqwatch.operators.once import add_once


def is_complete(features: Column, steps: int = names.STEPS) -> Column:
    return F.size(features) >= steps


def add_errors(
    reconstructed: DataFrame,
    channels: Sequence[str] = names.CHANNELS,
    features: str = "features",
    prediction: str = "prediction",
) -> DataFrame:
    """``mae_<channel>`` between a sequence and its reconstruction, both steps x channels."""
    return add_once(
        reconstructed,
        {
            f"mae_{c}": sequences.channel_mae(F.col(features), F.col(prediction), i)
            for i, c in enumerate(channels)
        },
    )


def fit_threshold(errors: DataFrame, channels: Sequence[str] = names.CHANNELS) -> DataFrame:
    """One row, ``mae_threshold``: each channel's largest error."""
    return errors.agg(F.array(*[F.max(f"mae_{c}") for c in channels]).alias("mae_threshold"))


def threshold_columns(
    threshold: DataFrame | Sequence[float], channels: Sequence[str] = names.CHANNELS
) -> list[Column]:
    """Thresholds by value: literals, or the one row of a frame as a scalar subquery."""
    if isinstance(threshold, DataFrame):
        fitted = threshold.select("mae_threshold").scalar()
        return [F.get(fitted, F.lit(i)) for i in range(len(channels))]
    return [F.lit(float(t)) for t in threshold]


def is_anomaly(errors: Sequence[Column], limits: Sequence[Column]) -> Column:
    """Any error strictly above its limit."""
    above = F.lit(False)
    for error, limit in zip(errors, limits, strict=True):
        above = above | (error > limit)
    return above


def judge(
    errors: DataFrame,
    threshold: DataFrame | Sequence[float],
    channels: Sequence[str] = names.CHANNELS,
) -> DataFrame:
    """Add ``isAnomaly`` and ``threshold_<channel>`` to rows with errors."""
    limits = threshold_columns(threshold, channels)
    judged = errors.withColumns({f"threshold_{c}": t for c, t in zip(channels, limits)})
    return judged.withColumn(
        "isAnomaly",
        is_anomaly(
            [F.col(f"mae_{c}") for c in channels], [F.col(f"threshold_{c}") for c in channels]
        ),
    )


def score(
    windows: DataFrame,
    model,
    threshold: DataFrame | Sequence[float],
    channels: Sequence[str] = names.CHANNELS,
    steps: int = names.STEPS,
    keep_incomplete: bool = False,
    float32: bool = False,
) -> DataFrame:
    """Score records for windows with ``features``.

    A sequence longer than ``steps`` fails the job: a model takes one length. Incomplete
    windows are left out before the model sees them. With
    ``keep_incomplete`` they come back with null scores but their thresholds.
    ``float32`` compares at a network's single precision.
    """
    ready = windows
    if float32:
        ready = ready.withColumn(
            "features", sequences.as_float32(F.col("features")).cast("array<array<double>>")
        )
    complete = ready.filter(is_complete(F.col("features"), steps))
    failure = F.raise_error(F.lit(f"a sequence is longer than {steps} steps"))
    exact = F.when(F.size("features") == steps, F.col("features"))
    complete = complete.withColumn("features", exact.otherwise(failure.cast("array<array<double>>")))
    scored = judge(add_errors(model.reconstruct(complete), channels), threshold, channels)
    if not keep_incomplete:
        return scored
    limits = threshold_columns(threshold, channels)
    rest = ready.filter(~is_complete(F.col("features"), steps))
    rest = rest.withColumns({f"threshold_{c}": t for c, t in zip(channels, limits)})
    return scored.unionByName(rest, allowMissingColumns=True)


def drop_unscored(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("isAnomaly").isNotNull())


def as_score_struct(scored: DataFrame, channels: Sequence[str] = names.CHANNELS) -> DataFrame:
    """The score columns packed into one ``predictions`` struct."""
    packed = [
        "isAnomaly",
        *[f"threshold_{c}" for c in channels],
        *[f"mae_{c}" for c in channels],
        "prediction",
    ]
    rest = [c for c in scored.columns if c not in packed]
    return scored.select(*rest, F.struct(*packed).alias("predictions"))


def unpack_scores(
    packed: DataFrame, channels: Sequence[str] = names.CHANNELS, carry: Sequence[str] = ()
) -> DataFrame:
    """Window bounds and scores as flat columns; unscored windows are dropped."""
    fields = [
        "isAnomaly",
        *[f"mae_{c}" for c in channels],
        *[f"threshold_{c}" for c in channels],
        "prediction",
    ]
    return drop_unscored(
        packed.select(
            *carry,
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "features",
            *[F.col(f"predictions.{f}").alias(f) for f in fields],
        )
    )
