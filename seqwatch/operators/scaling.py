"""Min-max scaling fitted on history (AGG-3, FN-9 to FN-12, JOIN-2)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import MinMaxScaler, MinMaxScalerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from seqwatch import names
from seqwatch.functions.scaling import min_max


@dataclass(frozen=True)
class MinMaxParams:
    """Fitted bounds per channel, small enough to travel as literals."""

    channels: tuple[str, ...]
    lows: tuple[float, ...]
    highs: tuple[float, ...]

    @classmethod
    def of_row(cls, fitted: DataFrame, channels: Sequence[str]) -> MinMaxParams:
        """From the one-row result of ``fit``."""
        row = fitted.first()
        return cls(
            tuple(channels),
            tuple(row[f"{c}_min"] for c in channels),
            tuple(row[f"{c}_max"] for c in channels),
        )

    @classmethod
    def of_model(cls, model: MinMaxScalerModel, channels: Sequence[str]) -> MinMaxParams:
        return cls(
            tuple(channels),
            tuple(float(v) for v in model.originalMin),
            tuple(float(v) for v in model.originalMax),
        )


def fit(
    df: DataFrame, channels: Sequence[str] = names.CHANNELS, series_keys: Sequence[str] = ()
) -> DataFrame:
    """Bounds ``<channel>_min`` and ``<channel>_max``: one row, or one per series."""
    bounds = []
    for c in channels:
        bounds.append(F.min(F.col(c).cast("double")).alias(f"{c}_min"))
        bounds.append(F.max(F.col(c).cast("double")).alias(f"{c}_max"))
    return df.groupBy(*series_keys).agg(*bounds)


def _scaled(channels: Sequence[str], bound) -> dict[str, Column]:
    return {c: min_max(F.col(c), bound(f"{c}_min"), bound(f"{c}_max")) for c in channels}


def scale(
    df: DataFrame,
    params: MinMaxParams | DataFrame,
    channels: Sequence[str] = names.CHANNELS,
    series_keys: Sequence[str] = (),
) -> DataFrame:
    """Replace each channel by its scaled value.

    ``params`` is a fitted literal set, or the result of ``fit``: its one row
    enters as a scalar subquery, and one row per series as an equi-join whose
    physical form is left to the size of the bounds (see ``tables.stored``). Rows of
    a series without bounds, or without a series, stay, with null channels.
    """
    if isinstance(params, MinMaxParams):
        lows = dict(zip(params.channels, params.lows))
        highs = dict(zip(params.channels, params.highs))
        literal = {f"{c}_min": F.lit(lows[c]) for c in channels}
        literal |= {f"{c}_max": F.lit(highs[c]) for c in channels}
        return df.withColumns(_scaled(channels, literal.__getitem__))
    if series_keys:
        columns = df.columns
        return (
            df.join(params, list(series_keys), "left")
            .withColumns(_scaled(channels, F.col))
            .select(*columns)
        )
    row = params.select(F.struct("*")).scalar()
    return df.withColumns(_scaled(channels, row.getField))


def assemble(df: DataFrame, columns: Sequence[str], output: str) -> DataFrame:
    """Scalars and vectors to one ML vector. Nulls raise, as ML defines it."""
    return VectorAssembler(inputCols=list(columns), outputCol=output).transform(df)


def fit_model(df: DataFrame, channels: Sequence[str] = names.CHANNELS) -> MinMaxScalerModel:
    """The same bounds as an ML model, for exchange with ML pipelines."""
    scaler = MinMaxScaler(inputCol="features", outputCol="scaled_features")
    return scaler.fit(assemble(df, channels, "features"))


def time_tagged_vectors(
    df: DataFrame,
    model: MinMaxScalerModel,
    channels: Sequence[str] = names.CHANNELS,
    time_col: str = "timestamp",
    carry: Sequence[str] = (),
) -> DataFrame:
    """``features_with_timestamp``: epoch seconds, then the scaled channels, as an array."""
    scaled = model.transform(assemble(df, channels, "features")).withColumn(
        "timestamp_long", F.unix_timestamp(time_col)
    )
    tagged = assemble(scaled, ["timestamp_long", "scaled_features"], "tagged")
    return tagged.select(
        time_col, *carry, vector_to_array("tagged").alias("features_with_timestamp")
    )
