"""JOB-1: fit scaler, model and threshold on history; keep them together."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from seqwatch import names
from seqwatch.operators import models, rows, scaling, scoring
from seqwatch.session import scratch_path
from seqwatch.sinks import tables
from seqwatch.sources import files


@dataclass(frozen=True)
class Detector:
    """Everything the scoring jobs need; a few numbers per channel plus the model."""

    scaler: scaling.MinMaxParams
    model: object
    threshold: tuple[float, ...]
    steps: int = names.STEPS

    @property
    def channels(self) -> tuple[str, ...]:
        return self.scaler.channels

    def save(self, spark: SparkSession, path: str) -> None:
        bounds = [
            (i, c, low, high)
            for i, (c, low, high) in enumerate(
                zip(self.scaler.channels, self.scaler.lows, self.scaler.highs)
            )
        ]
        spark.createDataFrame(
            bounds, "position int, channel string, low double, high double"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/scaler")
        tables.write_threshold(
            spark.createDataFrame([(list(self.threshold),)], "mae_threshold array<double>"),
            f"{path}/threshold",
        )
        kind = getattr(self.model, "kind", "user")
        spark.createDataFrame([(kind, self.steps)], "model string, steps int").coalesce(
            1
        ).write.mode("overwrite").parquet(f"{path}/about")
        if hasattr(self.model, "save"):
            self.model.save(f"{path}/model", spark)

    @classmethod
    def load(
        cls,
        spark: SparkSession,
        path: str,
        load_model: Callable[[str, SparkSession], object] | None = None,
    ) -> Detector:
        """A saved detector. A user's own model needs ``load_model(path, spark)``."""
        about = spark.read.parquet(f"{path}/about").first()
        if load_model is None and about.model not in models.LOADERS:
            raise ValueError(f"the model is of kind {about.model!r}: give load_model")
        load_model = load_model or models.LOADERS[about.model]
        bounds = spark.read.parquet(f"{path}/scaler").orderBy("position").collect()
        scaler = scaling.MinMaxParams(
            tuple(b.channel for b in bounds),
            tuple(b.low for b in bounds),
            tuple(b.high for b in bounds),
        )
        threshold = files.read_threshold(spark, f"{path}/threshold").first().mae_threshold
        return cls(scaler, load_model(f"{path}/model", spark), tuple(threshold), about.steps)


def training_errors(
    training: DataFrame, model, channels: Sequence[str] = names.CHANNELS
) -> DataFrame:
    """Errors of training sequences (steps x channels) under a model."""
    return scoring.add_errors(model.reconstruct(training), channels)


def fit_detector(
    history: DataFrame,
    make_model: Callable[[DataFrame], object],
    *,
    channels: Sequence[str] = names.CHANNELS,
    order_by: Sequence[str] = ("timestamp",),
    series_keys: Sequence[str] = (),
    steps: int = names.STEPS,
) -> Detector:
    """Fit on history: bounds, then ``make_model(training sequences)``, then threshold.

    Only the one-row results reach the driver.
    """
    scaler = scaling.MinMaxParams.of_row(scaling.fit(history, channels), channels)
    training = rows.row_sequences(
        scaling.scale(history, scaler, channels),
        channels,
        order_by=order_by,
        series_keys=series_keys,
        steps=steps,
        flat=False,
    ).select("features")
    model = make_model(training)
    fitted = scoring.fit_threshold(training_errors(training, model, channels), channels)
    return Detector(scaler, model, tuple(fitted.first().mae_threshold), steps)


def window_mean(_training: DataFrame) -> models.WindowMean:
    """For ``fit_detector``: a model that needs no fitting."""
    return models.WindowMean()


def pca(k: int, steps: int = names.STEPS, channels: int = len(names.CHANNELS)):
    """For ``fit_detector``: principal components of the training sequences."""
    return lambda training: models.PcaReconstruction.fit(training, k, steps, channels)


def absolute(k: int, steps: int = names.STEPS, channels: int = len(names.CHANNELS), rounds: int = 8):
    """For ``fit_detector``: components with a decoder of least absolute error.

    Its rounds read the training sequences again and again, so they are stored first.
    """

    def make(training: DataFrame) -> models.AbsoluteReconstruction:
        spark = training.sparkSession
        path = scratch_path(spark, "training")
        kept = tables.stored(training, path)
        try:
            return models.AbsoluteReconstruction.fit(kept, k, steps, channels, rounds)
        finally:
            tables.remove(spark, path)

    return make
