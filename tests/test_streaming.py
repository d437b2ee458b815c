from __future__ import annotations

from datetime import timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from seqwatch import names
from seqwatch.operators import models, records, scaling, windows
from seqwatch.plans import archive, detector as det, scoring as plan
from seqwatch.sinks import tables
from seqwatch.sources import files, kafka
from seqwatch.streaming import run, scoring as streams, windows as stateful

BASE = 1_704_067_200
DETECTOR = det.Detector(
    scaling.MinMaxParams(names.CHANNELS, (0.0, 0.0), (50.0, 50.0)), models.WindowMean(), (0.255, 0.265)
)


def wire(spark, offsets, first=0, key="modb_temp"):
    """One record per offset second; the first is number ``first``."""
    rows = [(first + i, t) for i, t in enumerate(offsets)]
    df = spark.createDataFrame(rows, "offset bigint, t bigint").select(
        "offset",
        F.timestamp_seconds(F.lit(BASE) + F.col("t")).alias("timestamp"),
        (F.col("t") * 7 % 50).cast("int").alias("set_t"),
        (F.col("t") * 11 % 50).cast("int").alias("v_t"),
    )
    return records.encode(df, carry=["offset", "timestamp"]).select(
        F.lit(key).cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.lit(names.READINGS_TOPIC).alias("topic"),
        F.lit(0).alias("partition"),
        "offset",
        "timestamp",
    )


class Job:
    """A scoring stream over one folder that can be run again and again."""

    def __init__(self, spark, root, **options):
        self.spark, self.root, self.options = spark, root, options

    def add(self, df):
        df.coalesce(1).write.mode("append").parquet(f"{self.root}/in")

    def run(self, **kw):
        stream = files.stream_records(self.spark, f"{self.root}/in")
        scored = streams.score_stream(stream, DETECTOR, tie_cols=["offset"], **self.options)
        return run.run_to_end(scored, f"{self.root}/out", f"{self.root}/state", **kw)

    def rows(self):
        out = self.spark.read.parquet(f"{self.root}/out")
        return sorted(tuple(r) for r in out.select(
            F.unix_seconds("window_end") - BASE, "mae_set_t", "mae_v_t", "isAnomaly").collect())


def batch_rows(df, closed_by):
    readings = records.read_records(df, carry=["offset"])
    scored = plan.flatten_window(plan.score_readings(readings, DETECTOR, tie_cols=["offset"]))
    closed = scored.filter(F.unix_seconds("window_end") <= BASE + closed_by)
    return sorted(tuple(r) for r in closed.select(
        F.unix_seconds("window_end") - BASE, "mae_set_t", "mae_v_t", "isAnomaly").collect())


@pytest.mark.parametrize("slots", [1, 4])
def test_stream_equals_closed_batch_windows(spark, tmp_path, slots):
    job = Job(spark, tmp_path, burst_slots=slots)
    source = wire(spark, range(100))
    job.add(source)
    assert job.run(state_partitions=3).input_rows == 100
    assert job.rows() == batch_rows(source, closed_by=99 - 5)
    assert any(r[3] for r in job.rows()) and not all(r[3] for r in job.rows())


@pytest.mark.parametrize("slots", [1, 4])
def test_late_record_is_dropped_and_counted(spark, tmp_path, slots):
    job = Job(spark, tmp_path, burst_slots=slots)
    for part, first in (([*range(60)], 0), ([200], 60)):
        job.add(wire(spark, part, first))
        report = job.run()
        assert report.dropped_by_watermark == 0
    before = job.rows()
    assert len(before) == 41
    job.add(wire(spark, [10], 61))
    assert job.run().dropped_by_watermark == 20
    assert job.rows() == before


def test_late_but_within_the_watermark_counts(spark, tmp_path):
    job = Job(spark, tmp_path)
    job.add(wire(spark, [t for t in range(60) if t != 57]))
    job.run()
    job.add(wire(spark, [57], 60))
    job.run()
    job.add(wire(spark, [300], 61))
    job.run()
    assert [r[0] for r in job.rows()] == list(range(20, 61))


def test_restart_repeats_nothing(spark, tmp_path):
    job = Job(spark, tmp_path)
    source = wire(spark, range(120))
    for low, high in ((0, 50), (50, 90), (90, 120)):
        job.add(source.filter((F.col("offset") >= low) & (F.col("offset") < high)))
        job.run()
    job.run()
    assert job.rows() == batch_rows(source, closed_by=119 - 5)


def test_series_are_windowed_apart(spark, tmp_path):
    job = Job(spark, tmp_path, series_keys=["key"])
    job.add(wire(spark, range(50), key="a").union(wire(spark, range(0, 50, 2), key="b")))
    job.run()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert [r.key for r in out.select(F.col("key").cast("string")).distinct().collect()] == ["a"]


def test_burst_in_one_second(spark, tmp_path):
    source = wire(spark, [*range(30), *[30] * 500, 31, 100])
    failing = Job(spark, tmp_path / "error")
    failing.add(source)
    with pytest.raises(Exception, match="more than 20 points"):
        failing.run()


def test_invalid_records_are_counted(spark, tmp_path):
    job = Job(spark, tmp_path, on_invalid="drop")
    good = wire(spark, range(40))
    job.add(good.union(good.limit(3).withColumn("value", F.lit("junk").cast("binary"))))
    assert job.run().invalid == 3
    failing = Job(spark, tmp_path / "error")
    failing.add(good.limit(1).withColumn("value", F.lit("junk").cast("binary")))
    with pytest.raises(Exception, match="without a value"):
        failing.run()


def test_event_time_from_the_payload(spark, tmp_path):
    job = Job(spark, tmp_path, payload_time=True)
    source = wire(spark, range(60))
    job.add(source.withColumn("timestamp", F.timestamp_seconds(F.lit(5))))
    job.run()
    assert job.rows() == batch_rows(source, closed_by=59 - 5)


def test_batch_model_on_a_stream(spark, tmp_path):
    wire(spark, range(40)).coalesce(1).write.parquet(f"{tmp_path}/in")
    detector = det.Detector(DETECTOR.scaler, models.BatchModel(lambda: lambda x: x), (0.0, 0.0))
    scored = streams.score_stream(files.stream_records(spark, f"{tmp_path}/in"), detector, nested=True)
    assert "window" in scored.columns
    run.run_to_end(scored, f"{tmp_path}/out", f"{tmp_path}/state")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 15 and out.filter("isAnomaly OR mae_set_t != 0").count() == 0


def test_start_wait_stop(spark, tmp_path):
    wire(spark, range(40)).write.parquet(f"{tmp_path}/in")
    scored = streams.score_stream(files.stream_records(spark, f"{tmp_path}/in"), DETECTOR)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    query = run.start(
        scored,
        f"{tmp_path}/state",
        format="parquet",
        path=f"{tmp_path}/out",
        every=timedelta(seconds=1),
        state_partitions=2,
        query_name="scores",
    )
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert query.isActive and query.name == "scores"
    assert run.wait(query, timeout=2) is False
    query.stop()
    assert run.wait(query) is True


def test_stream_archive_equals_batch(spark, tmp_path):
    source = wire(spark, range(30))
    source.write.parquet(f"{tmp_path}/in")
    stream = archive.archive_points(files.stream_records(spark, f"{tmp_path}/in"))
    run.to_archive(stream, f"{tmp_path}/out", f"{tmp_path}/state", finish=True).awaitTermination()
    columns = ["measurement", "key", "_time", "_field", "_value", "_svalue", "_arrival"]
    got = spark.read.parquet(f"{tmp_path}/out").select(*columns)
    want = archive.archive_points(source).select(*columns)
    assert got.exceptAll(want).count() == 0 and got.count() == 60


def test_kafka_options():
    assert kafka.source_options("h:9092", "temperature_modbus", "scorers") == {
        "kafka.bootstrap.servers": "h:9092",
        "subscribe": "temperature_modbus",
        "startingOffsets": "latest",
        "failOnDataLoss": "false",
        "kafka.group.id": "scorers",
    }
    both = kafka.source_options("h:9092", ["a", "b"], max_offsets_per_trigger=10)
    assert (both["subscribe"], both["maxOffsetsPerTrigger"]) == ("a,b", "10")
    assert kafka.sink_options("h:9092", "predictions")["topic"] == "predictions"


def test_grouped_sequences_in_batch_match_the_stream_plan(spark):
    readings = records.read_records(wire(spark, range(30)), carry=["offset"])
    one = windows.grouped_sequences(readings, tie_cols=["offset"])
    many = windows.grouped_sequences(readings, tie_cols=["offset"], burst_slots=5)
    assert one.exceptAll(many).count() == 0 and many.count() == one.count()


def late_job(spark, root, part, first=0):
    wire(spark, part, first).coalesce(1).write.mode("append").parquet(f"{root}/in")
    late = streams.late_stream(files.stream_records(spark, f"{root}/in"), DETECTOR.scaler, tie_cols=["offset"])
    return run.run_to_end(late, f"{root}/late", f"{root}/state")


def test_late_rows_are_kept_with_the_windows_they_missed(spark, tmp_path):
    late_job(spark, tmp_path, [*range(60), 200])
    report = late_job(spark, tmp_path, [10, 180, 194, 195, 199], 61)
    found = spark.read.parquet(f"{tmp_path}/late").orderBy("offset").collect()
    # The watermark is 195: a window that ends there is out.
    assert [(r.offset, r.missed_windows) for r in found] == [(61, 20), (62, 15), (63, 1)]
    assert report.dropped_by_watermark == 36
    assert found[0].set_t == pytest.approx(70 % 50 / 50) and found[0].v_t == pytest.approx(110 % 50 / 50)


def test_late_for_some_windows_counts_in_the_others(spark, tmp_path):
    job = Job(spark, tmp_path)
    job.add(wire(spark, [t for t in range(101) if t != 90]))
    job.run()
    job.add(wire(spark, [90], 101))
    job.run()
    job.add(wire(spark, [300], 102))
    job.run()
    # The windows that end at 91 to 95 went out without it, as ended windows of 19 points.
    assert [r[0] for r in job.rows()] == [*range(20, 91), *range(96, 102)]


def test_blocks_do_not_show(spark, tmp_path):
    source = wire(spark, [*range(0, 90), *range(400, 470, 2)])
    source.coalesce(1).write.parquet(f"{tmp_path}/in")
    readings = records.read_records(source, carry=["offset"])
    want = windows.sliding_sequences(readings, tie_cols=["offset"], on_overflow="error")
    want = want.filter(F.col("window.end") <= F.timestamp_seconds(F.lit(BASE + 468 - 5)))
    for block in (1, 7, 33):
        stream = records.read_records(files.stream_records(spark, f"{tmp_path}/in"), carry=["offset"])
        found = stateful.cut_windows(
            stateful.block_rows(stream, tie_cols=["offset"], block=block), tie_cols=["offset"]
        )
        run.run_to_end(found, f"{tmp_path}/out{block}", f"{tmp_path}/state{block}", state_partitions=2)
        have = spark.read.parquet(f"{tmp_path}/out{block}")
        assert sorted(map(tuple, have.collect())) == sorted(map(tuple, want.collect()))


def test_windows_with_gaps_and_rows_without_channels(spark, tmp_path):
    how = dict(window=timedelta(seconds=4), slide=timedelta(seconds=6), steps=4)
    source = wire(spark, range(60)).withColumn(
        "value", F.when(F.col("offset") % 9 == 0, F.lit("junk")).otherwise(F.col("value").cast("string")).cast("binary")
    )
    source.coalesce(1).write.parquet(f"{tmp_path}/in")
    kept = dict(carry=["offset"], on_invalid="keep")
    want = windows.sliding_sequences(records.read_records(source, **kept), tie_cols=["offset"], **how)
    want = want.filter(F.col("window.end") <= F.timestamp_seconds(F.lit(BASE + 59 - 5)))
    stream = records.read_records(files.stream_records(spark, f"{tmp_path}/in"), **kept)
    blocks = stateful.block_rows(stream, tie_cols=["offset"], window=how["window"], slide=how["slide"])
    run.run_to_end(stateful.cut_windows(blocks, tie_cols=["offset"], **how), f"{tmp_path}/out", f"{tmp_path}/state")
    have = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, have.collect())) == sorted(map(tuple, want.collect()))


def test_state_has_each_point_of_open_windows_once(spark, tmp_path):
    job = Job(spark, tmp_path)
    job.add(wire(spark, range(200)))
    job.run()
    held = stateful.held_points(spark, f"{tmp_path}/state").collect()
    # Windows from 175 on are open; block 1 starts at window 160 and has them all.
    own = [r.point.o0 for r in held if r.key._block == (BASE + 199) // 160]
    assert sorted(own) == list(range(175, 200)) and len(held) <= 2 * 25


def test_state_has_a_chunk_per_block_and_batch(spark, tmp_path):
    job = Job(spark, tmp_path)
    for low, high in ((0, 100), (100, 200)):
        job.add(wire(spark, range(low, high), low))
        job.run()
    chunks = spark.read.format("statestore").option("stateVarName", "points").load(f"{tmp_path}/state")
    points = stateful.held_points(spark, f"{tmp_path}/state").count()
    assert points >= 25 and chunks.count() <= 2 * 2


def test_shapes_of_windows_of_any_length_keep_points_once(spark, tmp_path):
    """A burst of 30 readings in a second, and every block's points once in its state."""
    source = wire(spark, [*range(100), *[50] * 30])
    source.coalesce(1).write.parquet(f"{tmp_path}/in")
    shapes = streams.shape_stream(
        files.stream_records(spark, f"{tmp_path}/in"), DETECTOR.scaler, [0.5, 0.5], tie_cols=["offset"]
    )
    run.run_to_end(shapes, f"{tmp_path}/out", f"{tmp_path}/state", state_partitions=2)
    readings = scaling.scale(records.read_records(source, carry=["offset"]), DETECTOR.scaler)
    want = plan.window_shapes(windows.sliding_sequences(readings, tie_cols=["offset"]), [0.5, 0.5])
    want = want.filter(F.col("window.end") <= F.timestamp_seconds(F.lit(BASE + 99 - 5)))
    have = spark.read.parquet(f"{tmp_path}/out").select(want.columns)
    assert sorted(map(str, have.collect())) == sorted(map(str, want.collect()))
    assert have.filter(F.size("features") == 50).count() == 20
    held = stateful.held_points(spark, f"{tmp_path}/state").count()
    assert 25 <= held <= 2 * 25


def test_a_repeated_batch_leaves_no_second_copy(spark, tmp_path):
    batch = archive.archive_points(wire(spark, range(30)))
    for number in (0, 1, 0):
        tables.write_batch(batch, f"{tmp_path}/archive", number)
    stored = spark.read.parquet(f"{tmp_path}/archive")
    assert stored.count() == 2 * batch.count() and {"key", "date"} < set(stored.columns)
    assert len(stored.inputFiles()) == 2


def test_parts_of_a_batch_go_to_their_folders(spark, tmp_path):
    wire(spark, range(40)).write.parquet(f"{tmp_path}/in")
    parts = {
        "even": (f"{tmp_path}/even", lambda b: b.filter("offset % 2 = 0")),
        "odd": (f"{tmp_path}/odd", lambda b: b.filter("offset % 2 = 1")),
    }
    stream = files.stream_records(spark, f"{tmp_path}/in")
    assert run.finished(run.to_parts(stream, parts, f"{tmp_path}/state", finish=True)).input_rows == 40
    assert [spark.read.parquet(f"{tmp_path}/{n}").count() for n in parts] == [20, 20]


def test_counts_are_told_by_the_batch(spark, tmp_path):
    """A running job with the default trigger, looked at while it runs and after it was stopped."""
    source = wire(spark, range(60)).withColumn(
        "value", F.when(F.col("offset") % 20 == 3, F.lit("junk")).otherwise(F.col("value").cast("string")).cast("binary")
    )
    source.filter("offset < 40").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.score_stream(
        files.stream_records(spark, f"{tmp_path}/in"), DETECTOR, tie_cols=["offset"], on_invalid="drop"
    )
    job = run.start(stream, f"{tmp_path}/state", format="parquet", path=f"{tmp_path}/out")
    try:
        job.processAllAvailable()
        source.filter("offset >= 40").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        job.processAllAvailable()
        assert job.isActive and run.so_far(job, spark).input_rows <= 60
    finally:
        job.stop()
    report = run.finished(job, spark)
    assert (report.input_rows, report.invalid, report.complete) == (60, 3, True)
    assert run.so_far(job, spark) == run.RunReport()  # told once, then forgotten


def test_a_missing_batch_makes_the_report_incomplete():
    def event(batch, rows):
        progress = SimpleNamespace(runId="r", batchId=batch, numInputRows=rows, observedMetrics={}, stateOperators=[])
        return SimpleNamespace(progress=progress, runId="r")

    told = run.Counts()
    for batch in (4, 4, 5):
        told.onQueryProgress(event(batch, 10))
    assert told.so_far("r") == run.RunReport(30, complete=True)
    told.onQueryProgress(event(7, 1))
    told.onQueryTerminated(event(7, 0))
    assert told.of_ended("r", 1) == run.RunReport(31, complete=False)
    assert not told.of_ended("never told", 0.01).complete
