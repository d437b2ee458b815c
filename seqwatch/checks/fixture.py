"""The ``events`` table seen as sensor data.

Each event is one reading: ``props.k`` is the set point, the whole part of
``value`` the measurement. Three clocks: one series at one reading per second,
eight series at one reading per second each, and the events' own time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqwatch import names
from seqwatch.functions import times
from seqwatch.operators import records

BASE = 1_704_067_200
SERIES = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _reading_columns() -> list[Column]:
    return [
        F.get_json_object("props", "$.k").cast("int").alias("set_t"),
        F.col("value").cast("int").alias("v_t"),
    ]


def _topic() -> Column:
    return F.when(F.col("event_id") % 5 == 0, names.PREDICTIONS_TOPIC).otherwise(
        names.READINGS_TOPIC
    )


def _readings(events: DataFrame, timestamp: Column, *extra: Column) -> DataFrame:
    return events.select(
        "event_id",
        timestamp.alias("timestamp"),
        *extra,
        _topic().alias("topic"),
        *_reading_columns(),
    )


def _one_clock(events: DataFrame) -> DataFrame:
    return _readings(events, F.timestamp_seconds(F.lit(BASE) + F.col("event_id")))


def _keyed_clock(events: DataFrame) -> DataFrame:
    second = F.lit(BASE) + times.floor_div(F.col("event_id"), SERIES)
    return _readings(
        events, F.timestamp_seconds(second), (F.col("event_id") % SERIES).alias("series")
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series, one reading per second."""
    return _one_clock(table(spark, sf_dir, "events"))


def keyed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight series, each with one reading per second."""
    return _keyed_clock(table(spark, sf_dir, "events"))


def event_time_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' own irregular time."""
    events = table(spark, sf_dir, "events")
    return _readings(events, times.naive_to_timestamp(F.col("ts")), F.col("user_id"))


def history(df: DataFrame) -> DataFrame:
    """The readings of the archived sensor topic."""
    return df.filter(F.col("topic") == names.READINGS_TOPIC)


def jumped(readings: DataFrame) -> DataFrame:
    """Readings with a jump of the measurement now and then, never in the history."""
    jump = F.when(F.col("event_id") % 500 == 0, 1000).otherwise(0)
    return readings.withColumn("v_t", F.col("v_t") + jump)


def damaged(wire: DataFrame) -> DataFrame:
    """Records of which some are no JSON, some lack a channel and some are empty."""
    place = F.col("offset") % 40
    text = F.col("value").cast("string")
    value = (
        F.when(place == 0, F.concat(F.lit("{"), text))
        .when(place == 1, F.regexp_replace(text, '"v_t":[^,]*,', ""))
        .when(place != 2, text)
    )
    return wire.withColumn("value", value.cast("binary"))


def nested_wire(readings: DataFrame) -> DataFrame:
    """Readings as JSON records whose values lie four levels down."""
    item = F.struct(F.col("set_t").alias("c"), F.array("v_t").alias("d"))
    message = F.struct(
        times.epoch_text(F.col("timestamp")).alias(names.TIME_KEY),
        F.struct(F.array(item).alias("b")).alias("a"),
    )
    return readings.select(
        F.to_json(message).cast("binary").alias("value"), "topic", F.col("event_id").alias("offset")
    )


def wire(readings: DataFrame, key: Column | None = None) -> DataFrame:
    """Readings as Kafka records, under the fixed record key or one of their own."""
    source = readings if key is None else readings.withColumn("own_key", key.cast("string"))
    carry = ["event_id", "timestamp", "topic"] + ([] if key is None else ["own_key"])
    return records.encode(source, carry=carry).select(
        F.col("key" if key is None else "own_key").cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        "topic",
        F.lit(0).alias("partition"),
        F.col("event_id").alias("offset"),
        "timestamp",
    )


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return reader.parquet(sf_dir)


def wire_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of Kafka records."""
    return wire(_one_clock(_event_stream(spark, sf_dir)))


def keyed_wire_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the series as record key."""
    return wire(_keyed_clock(_event_stream(spark, sf_dir)), F.col("series"))
