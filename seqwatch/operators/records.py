"""Sensor records: wire form to readings and back (PRJ-1, PRJ-2, SNK-5, FLT-6, FLT-7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from seqwatch import names
from seqwatch.functions import times
from seqwatch.operators.once import add_once


def decode(
    records: DataFrame,
    schema: StructType = names.PAYLOAD_SCHEMA,
    time_col: str = "timestamp",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Record time and parsed JSON payload; unreadable fields become null."""
    payload = F.from_json(F.col("value").cast("string"), schema)
    return records.select(
        F.col(time_col).cast("timestamp").alias("timestamp"),
        *[F.col(c) for c in carry],
        payload.alias("payload"),
    )


def unpack(decoded: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The payload's fields as columns."""
    return decoded.select("timestamp", *carry, "payload.*")


def require_channels(
    readings: DataFrame,
    channels: Sequence[str] = names.CHANNELS,
    on_invalid: str = "error",
    observed_as: str | None = None,
) -> DataFrame:
    """Readings with every channel present.

    ``on_invalid`` is ``"error"`` (the query fails on the first incomplete reading), ``"keep"``,
    or ``"drop"``, which loses readings and has to be asked for. ``observed_as`` names an observation that counts
    ``readings`` and ``invalid`` on the way, in batch and in stream progress.
    """
    if on_invalid not in ("drop", "keep", "error"):
        raise ValueError(f"unknown on_invalid: {on_invalid}")
    valid = F.lit(True)
    for c in channels:
        valid = valid & F.col(c).isNotNull()
    if observed_as:
        readings = readings.observe(
            observed_as,
            F.count(F.lit(1)).alias("readings"),
            F.count_if(~valid).alias("invalid"),
        )
    if on_invalid == "keep":
        return readings
    if on_invalid == "error":
        failure = F.raise_error(F.lit("reading without a value for every channel"))
        return readings.filter(F.when(valid, F.lit(True)).otherwise(failure.cast("boolean")))
    return readings.filter(valid)


def read_records(
    records: DataFrame,
    channels: Sequence[str] = names.CHANNELS,
    carry: Sequence[str] = (),
    on_invalid: str = "error",
    observed_as: str | None = None,
    payload_time: bool = False,
) -> DataFrame:
    """Records to complete readings: decode, unpack, check.

    A reading's time is the record's; with ``payload_time`` the message's own
    event time, without which a reading is incomplete.
    """
    schema = StructType([f for f in names.PAYLOAD_SCHEMA if f.name in channels])
    if len(schema) != len(channels):
        raise ValueError("channels outside the payload schema: decode with a schema of your own")
    if not payload_time:
        readings = unpack(decode(records, schema, carry=carry), carry)
        return require_channels(readings, channels, on_invalid, observed_as)
    schema = StructType([*schema, StructField(names.TIME_KEY, StringType())])
    readings = unpack(decode(records, schema, carry=carry), carry)
    own_time = times.from_epoch_text(F.col(names.TIME_KEY))
    readings = readings.withColumn("timestamp", own_time).drop(names.TIME_KEY)
    return require_channels(readings, ["timestamp", *channels], on_invalid, observed_as)


def reason(channels: Sequence[str] = names.CHANNELS, timed: bool = False) -> Column:
    """Why a record gives no complete reading, or null if it does.

    The first of: no value; no JSON; no time in the message, if that is asked for; no readable
    value for a channel.
    """
    text = F.col("value").cast("string")
    message = F.try_parse_json(text)
    schema = StructType([f for f in names.PAYLOAD_SCHEMA if f.name in channels])
    found = F.when(F.col("value").isNull(), "no value").when(message.isNull(), "no JSON")
    if timed:
        own_time = times.from_epoch_text(F.try_variant_get(message, f"$.{names.TIME_KEY}", "string"))
        found = found.when(own_time.isNull(), "no time")
    if channels:
        payload = F.from_json(text, schema)
        for c in channels:
            found = found.when(payload[c].isNull(), f"no {c}")
    return found


def rejects(records: DataFrame, channels: Sequence[str] = names.CHANNELS, timed: bool = False) -> DataFrame:
    """The records that give no complete reading, whole, with the ``reason``."""
    marked = add_once(records, {"reason": reason(channels, timed)})
    return marked.filter(F.col("reason").isNotNull())


def encode(
    readings: DataFrame,
    channels: Sequence[str] = names.CHANNELS,
    time_col: str | None = "timestamp",
    key: str = names.RECORD_KEY,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Readings to ``key`` and JSON ``value``; ``time_col=None`` leaves the event time out."""
    fields = [F.col(c) for c in channels]
    if time_col:
        fields.append(times.epoch_text(F.col(time_col)).alias(names.TIME_KEY))
    return readings.select(
        *carry, F.lit(key).alias("key"), F.to_json(F.struct(*fields)).alias("value")
    )


def drop_oversize(
    records: DataFrame, max_bytes: int = names.MAX_MESSAGE_BYTES, value_col: str = "value"
) -> DataFrame:
    """Records whose message is at most ``max_bytes`` long."""
    return records.filter(F.octet_length(value_col) <= max_bytes)


def select_topics(
    records: DataFrame, topics: Sequence[str], topic_col: str = "topic"
) -> DataFrame:
    return records.filter(F.col(topic_col).isin(list(topics)))
