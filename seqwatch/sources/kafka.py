"""Kafka as a stream source and sink (SRC-1, SNK-1, SNK-2): option sets only.

The connector is the ``spark-sql-kafka`` package of the session.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def source_options(
    servers: str,
    topics: str | Sequence[str],
    group_id: str | None = None,
    starting_offsets: str = "latest",
    fail_on_data_loss: bool = False,
    max_offsets_per_trigger: int | None = None,
) -> dict[str, str]:
    options = {
        "kafka.bootstrap.servers": servers,
        "subscribe": topics if isinstance(topics, str) else ",".join(topics),
        "startingOffsets": starting_offsets,
        "failOnDataLoss": str(fail_on_data_loss).lower(),
    }
    if group_id:
        options["kafka.group.id"] = group_id
    if max_offsets_per_trigger:
        options["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return options


def sink_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def read_stream(spark: SparkSession, **options) -> DataFrame:
    """A stream of Kafka records; keywords as in ``source_options``."""
    return spark.readStream.format("kafka").options(**source_options(**options)).load()
