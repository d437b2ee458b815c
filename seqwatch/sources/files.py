"""File-backed records and history (SRC-2, SRC-3, SRC-4)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from seqwatch import names
from seqwatch.operators import points as pts


def stream_records(
    spark: SparkSession,
    path: str,
    schema: StructType = names.RECORD_SCHEMA,
    glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """A stream over Parquet files with the columns of Kafka records."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def history(
    points: DataFrame,
    as_of: datetime,
    span: timedelta = names.HISTORY,
    key: str = names.READINGS_TOPIC,
    channels: Sequence[str] = names.CHANNELS,
    sort: bool = True,
) -> DataFrame:
    """Archived readings of ``[as_of - span, as_of)`` as ``timestamp`` and channels.

    On an archive the tag and the dates of the range are partition filters. The
    dates have a day to spare, as writer and reader may be in different zones.
    """
    ranged = pts.time_range(pts.tagged(points, key), as_of, span)
    if "date" in points.columns:
        ranged = ranged.filter(
            (F.col("date") >= F.lit((as_of - span - timedelta(days=1)).date()))
            & (F.col("date") <= F.lit((as_of + timedelta(days=1)).date()))
        )
    wide = pts.pivot(ranged, channels).withColumnRenamed("_time", "timestamp")
    wide = with_history_types(wide, channels)
    return wide.orderBy("timestamp") if sort else wide


def with_history_types(readings: DataFrame, channels: Sequence[str] = names.CHANNELS) -> DataFrame:
    """The history schema: a timestamp and single-precision channels."""
    return readings.select(
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        *[F.col(c).cast("float").alias(c) for c in channels],
    )


def history_from_rows(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """A small hand-made history under its explicit schema."""
    return spark.createDataFrame(list(rows), names.HISTORY_SCHEMA)


def read_threshold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("mae_threshold array<double>").parquet(path)
