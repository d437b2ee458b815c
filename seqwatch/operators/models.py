"""Sequence models (MDL-1 to MDL-3). Each turns ``features`` (steps x channels) into ``prediction``.

A model offers ``reconstruct(df)`` and, where it has state, ``save(path, spark)``.
None of them is a neural network; a user's own network goes in through ``BatchModel``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from seqwatch import names
from seqwatch.functions import sequences
from seqwatch.operators.once import add_once

Predict = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class WindowMean:
    """Each channel's mean over the sequence, repeated."""

    channels: int = len(names.CHANNELS)
    kind: ClassVar[str] = "window_mean"

    def reconstruct(self, df: DataFrame) -> DataFrame:
        step = F.array(
            *[sequences.channel_mean(F.col("features"), c) for c in range(self.channels)]
        )
        return add_once(df, {"prediction": F.array_repeat(step, F.size("features"))})


@dataclass(frozen=True)
class BatchModel:
    """Any batch function over arrays of shape (rows, steps, channels).

    ``make_predict`` runs once per Python worker and returns the function, so a
    network is loaded once, and is called with whole batches.
    """

    make_predict: Callable[[], Predict]
    steps: int = names.STEPS
    channels: int = len(names.CHANNELS)
    batch_size: int = 1024

    def reconstruct(self, df: DataFrame) -> DataFrame:
        make, width = self.make_predict, self.steps * self.channels

        def flat_predict() -> Predict:
            predict = make()
            return lambda x: np.asarray(predict(x), dtype=np.float64).reshape(-1, width)

        call = predict_batch_udf(
            flat_predict,
            return_type=ArrayType(DoubleType()),
            batch_size=self.batch_size,
            input_tensor_shapes=[[self.steps, self.channels]],
        )
        # Named on its own so that the model is called once per row.
        called = df.withColumn("_flat", call(sequences.flat(F.col("features"))))
        return called.withColumn(
            "prediction", sequences.unflat(F.col("_flat"), self.steps, self.channels)
        ).drop("_flat")


def summed(training: DataFrame, width: int, size: int, add: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of ``add``, which turns flat ``features`` (rows x ``width``) into ``size`` numbers.

    Each task adds up its own sums, which are then added by their place: what is shuffled
    and collected depends on ``size`` and the number of tasks, never on the rows.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size)
        for batch in batches:
            sums += add(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
        places = np.arange(size, dtype=np.int32)
        yield pa.record_batch([pa.array(places), pa.array(sums)], names=["place", "value"])

    flat = training.select(sequences.flat(F.col("features")).alias("x"))
    added = flat.mapInArrow(partial, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    sums = np.zeros(size)
    for row in added.collect():
        sums[row.place] = row.value
    return sums


def moments(training: DataFrame, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Count, sum and sum of products of flat ``features``, in one pass."""
    upper = np.triu_indices(width)
    sums = summed(
        training,
        width,
        1 + width + len(upper[0]),
        lambda x: np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x)[upper]]),
    )
    products = np.zeros((width, width))
    products[upper] = products.T[upper] = sums[1 + width :]
    return sums[0], sums[1 : 1 + width], products


@dataclass(frozen=True)
class PcaReconstruction:
    """Projection on the leading components: the best linear autoencoder under squared error."""

    center: np.ndarray
    components: np.ndarray
    steps: int = names.STEPS
    channels: int = len(names.CHANNELS)
    kind: ClassVar[str] = "pca"

    @classmethod
    def fit(
        cls,
        training: DataFrame,
        k: int,
        steps: int = names.STEPS,
        channels: int = len(names.CHANNELS),
    ) -> PcaReconstruction:
        """From training sequences, which are read once: the eigenvectors of their covariance."""
        count, total, products = moments(training, steps * channels)
        if not count:
            raise ValueError("no training sequences")
        center = total / count
        _, vectors = np.linalg.eigh(products / count - np.outer(center, center))
        return cls(center, vectors[:, ::-1][:, :k].copy(), steps, channels)

    def reconstruct(self, df: DataFrame) -> DataFrame:
        center, projection = self.center, self.components @ self.components.T

        def make() -> Predict:
            return lambda x: center + (x.reshape(len(x), -1) - center) @ projection

        return BatchModel(make, self.steps, self.channels).reconstruct(df)

    def save(self, path: str, spark: SparkSession) -> None:
        columns = "center array<double>, components array<array<double>>, steps int, channels int"
        row = (self.center.tolist(), self.components.tolist(), self.steps, self.channels)
        spark.createDataFrame([row], columns).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> PcaReconstruction:
        row = spark.read.parquet(path).first()
        return cls(np.array(row.center), np.array(row.components), row.steps, row.channels)


#: Errors below this weigh as if they were this large, which keeps weights finite.
LEAST_ERROR = 1e-4


@dataclass(frozen=True)
class AbsoluteReconstruction:
    """A linear autoencoder with the least absolute error: components in, a robust decoder out.

    The code of a sequence is that of principal components. The way back is fitted under the
    absolute error, by iteratively reweighted least squares: in every round each value of each
    sequence weighs the inverse of its last error. Rows that are far off pull the model less than
    under squared error.
    """

    center: np.ndarray
    encoder: np.ndarray
    decoder: np.ndarray  # a row per component, then the constant
    steps: int = names.STEPS
    channels: int = len(names.CHANNELS)
    kind: ClassVar[str] = "absolute"

    @classmethod
    def fit(
        cls,
        training: DataFrame,
        k: int,
        steps: int = names.STEPS,
        channels: int = len(names.CHANNELS),
        rounds: int = 8,
    ) -> AbsoluteReconstruction:
        """One pass over the training sequences per round; give a stored table if they are costly.

        A round's sums are a weighted k+1 square and its right side per value of a sequence. The
        decoder with the least absolute error of all rounds is kept, so it is never worse than
        principal components on the sequences it is fitted on.
        """
        width = steps * channels
        start = PcaReconstruction.fit(training, k, steps, channels)
        center, encoder = start.center, start.components
        decoder = np.vstack([encoder.T, center])
        n, upper = encoder.shape[1] + 1, np.triu_indices(encoder.shape[1] + 1)
        best, least = decoder, np.inf
        for number in range(rounds + 1):

            def add(x: np.ndarray, decoder: np.ndarray = decoder) -> np.ndarray:
                code = np.hstack([(x - center) @ encoder, np.ones((len(x), 1))])
                error = np.abs(x - code @ decoder)
                weight = 1 / np.maximum(error, LEAST_ERROR)
                squares = weight.T @ (code[:, upper[0]] * code[:, upper[1]])
                return np.concatenate([[error.sum()], squares.ravel(), ((weight * x).T @ code).ravel()])

            sums = summed(training, width, 1 + width * (len(upper[0]) + n), add)
            if sums[0] < least:
                best, least = decoder, sums[0]
            if number == rounds:
                break
            squares = sums[1 : 1 + width * len(upper[0])].reshape(width, -1)
            sides = sums[1 + squares.size :].reshape(width, n)
            full = np.zeros((width, n, n))
            full[:, upper[0], upper[1]] = full[:, upper[1], upper[0]] = squares
            decoder = np.stack([np.linalg.lstsq(a, b)[0] for a, b in zip(full, sides)], axis=1)
        return cls(center, encoder, best, steps, channels)

    def reconstruct(self, df: DataFrame) -> DataFrame:
        center, encoder, decoder = self.center, self.encoder, self.decoder

        def make() -> Predict:
            return lambda x: (x.reshape(len(x), -1) - center) @ encoder @ decoder[:-1] + decoder[-1]

        return BatchModel(make, self.steps, self.channels).reconstruct(df)

    def save(self, path: str, spark: SparkSession) -> None:
        columns = "center array<double>, encoder array<array<double>>, decoder array<array<double>>, steps int, channels int"
        arrays = (a.tolist() for a in (self.center, self.encoder, self.decoder))
        spark.createDataFrame([(*arrays, self.steps, self.channels)], columns).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> AbsoluteReconstruction:
        row = spark.read.parquet(path).first()
        arrays = (np.array(a) for a in (row.center, row.encoder, row.decoder))
        return cls(*arrays, row.steps, row.channels)


LOADERS = {
    WindowMean.kind: lambda path, spark: WindowMean(),
    PcaReconstruction.kind: PcaReconstruction.load,
    AbsoluteReconstruction.kind: AbsoluteReconstruction.load,
}
