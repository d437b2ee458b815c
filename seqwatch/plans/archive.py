"""JOB-5: encode, archive, read back."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from seqwatch import names
from seqwatch.operators import points, records
from seqwatch.sinks import tables
from seqwatch.sources import files


def archive_points(
    wire: DataFrame,
    topics: Sequence[str] = (names.READINGS_TOPIC, names.PREDICTIONS_TOPIC),
    max_bytes: int = names.MAX_MESSAGE_BYTES,
) -> DataFrame:
    """Records of the archived topics to points; oversize messages are dropped."""
    wanted = records.select_topics(wire, topics)
    return points.unpivot_json(records.drop_oversize(wanted, max_bytes))


def archive(wire: DataFrame, path: str, mode: str = "append", **options) -> None:
    tables.write_archive(archive_points(wire, **options), path, mode)


def read_history(
    spark: SparkSession,
    path: str,
    as_of: datetime,
    span: timedelta = names.HISTORY,
    **options,
) -> DataFrame:
    return files.history(spark.read.parquet(path), as_of, span, **options)
