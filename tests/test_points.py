from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from seqwatch import names
from seqwatch.operators import points
from seqwatch.plans import archive
from seqwatch.sinks import tables
from seqwatch.sources import files

WIRE = "topic string, offset bigint, value string"


def unpivot(spark, *values, **options):
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate(values)], WIRE)
    got = points.unpivot_json(df, **options).collect()
    return {(r._arrival, r._field): (r._value, r._svalue) for r in got}


def test_arrays_of_numbers_in_any_shape(spark):
    texts = ("[]", "[[]]", "[[1,-2.5],[3e2]]", "[[],[0]]", "[[[7]],8,[9,[10,11]]]", "[1,null]", "[[1],[2,\"x\"]]")
    got = unpivot(spark, *(f'{{"event_timestamp":17,"f":{text}}}' for text in texts))
    assert {place: value for place, (value, _) in got.items()} == {
        (2, "f_0_0"): 1.0, (2, "f_0_1"): -2.5, (2, "f_1_0"): 300.0,
        (3, "f_1_0"): 0.0,
        (4, "f_0_0_0"): 7.0, (4, "f_1"): 8.0, (4, "f_2_0"): 9.0, (4, "f_2_1_0"): 10.0, (4, "f_2_1_1"): 11.0,
        (5, "f_0"): 1.0, (6, "f_0_0"): 1.0, (6, "f_1_0"): 2.0,
    }
    assert points._places("[[0,0],[],[0]]") == ["_0_0", "_0_1", "_2_0"]


def test_nested_fields_and_kinds(spark):
    got = unpivot(
        spark,
        '{"event_timestamp":17,"features":[[1,2],[3,4.5]],"isAnomaly":true,"note":"x",'
        '"window_start":"2024","flag":false,"deep":{"a":1,"b":{"c":2}},"none":null,"text":"7"}',
    )
    assert got == {
        (0, "features_0_0"): (1.0, None),
        (0, "features_0_1"): (2.0, None),
        (0, "features_1_0"): (3.0, None),
        (0, "features_1_1"): (4.5, None),
        (0, "isAnomaly"): (None, "true"),
        (0, "window_start"): (None, "2024"),
        (0, "deep_a"): (1.0, None),
        (0, "deep_b_c"): (2.0, None),
    }


def test_messages_of_any_depth(spark):
    deep = "[" * 400 + "1.5" + "]" * 400
    got = unpivot(spark, '{"event_timestamp":17,"a":[[[1,{"b":[2]}]]],"e":4}', f'{{"event_timestamp":17,"d":{deep}}}')
    assert got == {
        (0, "a_0_0_0"): (1.0, None),
        (0, "a_0_0_1_b_0"): (2.0, None),
        (0, "e"): (4.0, None),
        (1, "d" + "_0" * 400): (1.5, None),
    }
    assert unpivot(spark, '{"event_timestamp":17,"a":[[]],"b":{},"c":[null,{}],"e":4}') == {(0, "e"): (4.0, None)}


def test_nested_text_is_kept_by_its_name(spark):
    message = '{"event_timestamp":17,"a":{"note":"x","ok":true,"big":123456789012345678901,"n":[1e3]}}'
    assert unpivot(spark, message, string_fields=["a_note", "a_ok"]) == {
        (0, "a_note"): (None, "x"),
        (0, "a_ok"): (None, "true"),
        (0, "a_big"): (123456789012345678901.0, None),
        (0, "a_n_0"): (1000.0, None),
    }


def test_pivot_needs_arrivals_and_hashes(spark):
    rows = [("k", datetime(2024, 1, 1), "set_t", 1.0, None)]
    df = spark.createDataFrame(rows, POINTS)
    with pytest.raises(Exception, match="without an arrival"):
        points.pivot(df).collect()
    plan = points.pivot(df)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_messages_without_time_or_object_have_no_points(spark):
    assert unpivot(spark, '{"a":1}', "junk", None, "[1]", "5", '{"event_timestamp":"x","a":1}') == {}


def test_time_is_read_from_text_and_number(spark):
    df = spark.createDataFrame(
        [("t", 0, '{"event_timestamp":"17","a":1}'), ("t", 1, '{"event_timestamp":17.5,"a":1}')],
        WIRE,
    )
    got = points.unpivot_json(df).select(F.unix_micros("_time").alias("us")).orderBy("us")
    assert [r.us for r in got.collect()] == [17_000_000, 17_500_000]


POINTS = "key string, _time timestamp, _field string, _value double, _arrival bigint"


def test_pivot_last_wins_and_missing_is_null(spark):
    t0, t1 = datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 1)
    rows = [
        ("k", t0, "set_t", 1.0, 0),
        ("k", t0, "set_t", 9.0, 2),
        ("k", t0, "set_t", 5.0, 1),
        ("k", t0, "v_t", 3.0, 0),
        ("k", t1, "v_t", 4.0, 3),
    ]
    got = points.pivot(spark.createDataFrame(rows, POINTS)).orderBy("_time").collect()
    assert [(r.set_t, r.v_t) for r in got] == [(9.0, 3.0), (None, 4.0)]


def test_pivot_undoes_unpivot(spark):
    df = spark.range(500).select(
        F.timestamp_seconds("id").alias("timestamp"),
        (F.col("id") * 7 % 13).cast("double").alias("set_t"),
        F.when(F.col("id") % 5 > 0, F.col("id") / 4).alias("v_t"),
    )
    long = points.unpivot_columns(df.withColumn("n", F.lit(1)), arrival_col="n")
    back = points.pivot(long).withColumnRenamed("_time", "timestamp")
    assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


def test_time_range_is_half_open(spark):
    df = spark.range(10).select(F.timestamp_seconds("id").alias("_time"))
    as_of = datetime(1970, 1, 1, 0, 0, 8, tzinfo=timezone.utc)
    got = points.time_range(df, as_of, timedelta(seconds=3)).select(F.unix_seconds("_time"))
    assert sorted(r[0] for r in got.collect()) == [5, 6, 7]


@pytest.fixture(scope="module")
def archive_path(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("points") / "archive")
    readings = spark.range(0, 4 * 86_400, 600).select(
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("timestamp"),
        F.col("id").cast("double").alias("set_t"),
        (F.col("id") / 2).alias("v_t"),
        F.col("id").alias("n"),
    )
    for key in (names.READINGS_TOPIC, names.PREDICTIONS_TOPIC):
        tables.write_archive(points.unpivot_columns(readings, key=key, arrival_col="n"), path)
    return path


def test_history_reads_its_partitions_only(spark, archive_path):
    as_of = datetime(2024, 1, 4, 6, tzinfo=timezone.utc)
    got = archive.read_history(spark, archive_path, as_of, timedelta(hours=12))
    assert got.count() == 72
    assert dict(got.dtypes) == {"timestamp": "timestamp", "set_t": "float", "v_t": "float"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(key" in plan and "date" in plan.split("PartitionFilters")[1]
    assert "_svalue" not in plan


@pytest.mark.parametrize("zone", ["Asia/Tokyo", "America/Los_Angeles"])
def test_history_is_the_same_in_another_zone(spark, archive_path, zone):
    as_of = datetime(2024, 1, 4, tzinfo=timezone.utc)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert archive.read_history(spark, archive_path, as_of, timedelta(days=1)).count() == 144
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_history_from_rows(spark):
    df = files.history_from_rows(spark, [(datetime(2024, 1, 1), 1.0, 2.0)])
    assert df.schema == names.HISTORY_SCHEMA


def test_archive_takes_known_topics_and_sizes(spark):
    ok = '{"event_timestamp":"1","set_t":1}'
    wire = spark.createDataFrame(
        [(names.READINGS_TOPIC, 0, ok), ("other", 1, ok), (names.READINGS_TOPIC, 2, ok + " " * 99)],
        WIRE,
    )
    assert archive.archive_points(wire, max_bytes=60).count() == 1


def test_arrival_orders_records_of_all_partitions(spark):
    rows = [(1000, 3, 5), (1000, 3, 6), (1000, 4, 0), (1001, 0, 0), (10_000_000_000, 99_999, 2**63 - 1)]
    df = spark.createDataFrame(rows, "s long, partition int, offset long").select(
        F.timestamp_seconds("s").alias("timestamp"), "partition", "offset"
    )
    found = [r[0] for r in df.select(points.arrival()).collect()]
    assert found == sorted(found) and len(set(found)) == len(rows)
    none = spark.range(1).select(
        F.lit(None).cast("timestamp").alias("timestamp"), F.lit(0).alias("partition"), F.lit(0).alias("offset")
    )
    assert none.select(points.arrival()).first()[0] is None


def test_pivot_by_arrival_is_hashed(spark):
    df = spark.range(8).select(
        F.timestamp_seconds(F.lit(5)).alias("timestamp"), F.col("id").alias("set_t"), F.col("id").alias("v_t"),
        (F.col("id") % 4).cast("int").alias("partition"), F.floor(F.col("id") / 4).alias("offset"),
    )
    wide = points.pivot(points.unpivot_columns(df, arrival_col=points.arrival()))
    assert wide.first()[1:] == (7.0, 7.0)
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan and "ObjectHash" not in plan
