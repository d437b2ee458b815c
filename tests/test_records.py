from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import Observation, functions as F

from seqwatch import names
from seqwatch.functions import times
from seqwatch.operators import records

JSON = [
    '{"set_t": 1, "v_t": 2}',
    "junk",
    '{"set_t": 1}',
    '{"set_t": 1.5, "v_t": 2}',
    None,
]


@pytest.fixture
def wire(spark):
    rows = [(i, v, datetime(2024, 1, 1, 0, 0, i)) for i, v in enumerate(JSON)]
    df = spark.createDataFrame(rows, "offset bigint, value string, timestamp timestamp")
    return df.withColumn("value", F.col("value").cast("binary"))


def test_unreadable_fields_become_null(wire):
    got = records.unpack(records.decode(wire, carry=["offset"]), ["offset"])
    values = [(r.set_t, r.v_t) for r in got.orderBy("offset").collect()]
    assert values == [(1, 2), (None, None), (1, None), (None, 2), (None, None)]


def test_null_value_gives_null_payload(wire):
    decoded = records.decode(wire, carry=["offset"]).filter("offset = 4")
    assert decoded.first().payload is None


@pytest.mark.parametrize("policy, count", [("drop", 1), ("keep", 5)])
def test_invalid_policy(wire, policy, count):
    assert records.read_records(wire, on_invalid=policy).count() == count


def test_invalid_error(wire):
    with pytest.raises(Exception, match="without a value for every channel"):
        records.read_records(wire).collect()


def test_invalid_are_counted(wire):
    seen = Observation("seen")
    readings = records.unpack(records.decode(wire))
    valid = F.col("set_t").isNotNull() & F.col("v_t").isNotNull()
    readings.observe(seen, F.count_if(~valid).alias("invalid")).collect()
    assert seen.get["invalid"] == 4
    checked = records.require_channels(readings, on_invalid="drop", observed_as="decode")
    assert checked.count() == 1


def test_payload_time(spark):
    rows = [
        (datetime(2024, 1, 1), '{"set_t":1,"v_t":2,"event_timestamp":"1704067205"}'),
        (datetime(2024, 1, 1), '{"set_t":1,"v_t":2,"event_timestamp":"soon"}'),
        (datetime(2024, 1, 1), '{"set_t":1,"v_t":2}'),
    ]
    wire = spark.createDataFrame(rows, "timestamp timestamp, value string")
    got = records.read_records(wire, payload_time=True, on_invalid="drop").collect()
    assert [r.timestamp for r in got] == [datetime(2024, 1, 1, 0, 0, 5)]


def test_encode_forms(spark):
    df = spark.createDataFrame(
        [(datetime(2024, 1, 1), 5, 6)], "timestamp timestamp, set_t int, v_t int"
    )
    assert records.encode(df).first().value == (
        '{"set_t":5,"v_t":6,"event_timestamp":"1704067200"}'
    )
    plain = records.encode(df, time_col=None).first()
    assert (plain.key, plain.value) == ("modb_temp", '{"set_t":5,"v_t":6}')


def test_size_limit_counts_bytes(spark):
    df = spark.createDataFrame([("aé",), ("aéb",)], "value string")
    kept = records.drop_oversize(df, max_bytes=3)
    assert [r.value for r in kept.collect()] == ["aé"]


def test_topics(spark):
    df = spark.createDataFrame(
        [(names.READINGS_TOPIC,), (names.PREDICTIONS_TOPIC,), ("other",)], "topic string"
    )
    wanted = [names.READINGS_TOPIC, names.PREDICTIONS_TOPIC]
    assert records.select_topics(df, wanted).count() == 2


def test_naive_time_is_utc_in_any_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-07-01 12:00:00.25' AS ts")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = df.select(F.unix_micros(times.naive_to_timestamp(F.col("ts"))).alias("us")).first().us
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == 1_719_835_200_250_000


def test_floor_div(spark):
    df = spark.range(-7, 8).select("id", times.floor_div(F.col("id"), 3).alias("q"))
    assert all(r.q == r.id // 3 for r in df.collect())


def test_rejects_say_why(spark):
    good = '{"set_t":1,"v_t":2,"event_timestamp":"5"}'
    texts = [good, None, "{", "5", '{"v_t":2}', '{"set_t":1}', '{"set_t":1.5,"v_t":2}', '{"set_t":1,"v_t":2}']
    wire = spark.createDataFrame([(t,) for t in texts], "value string").select(F.col("value").cast("binary"))
    found = [(r.value and bytes(r.value).decode(), r.reason) for r in records.rejects(wire).collect()]
    assert found == list(zip(texts[1:7], ["no value", "no JSON", "no set_t", "no set_t", "no v_t", "no set_t"]))
    timed = [r.reason for r in records.rejects(wire, channels=(), timed=True).collect()]
    assert timed == ["no value", "no JSON", *["no time"] * 5]
