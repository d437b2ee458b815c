from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from seqwatch import app
from seqwatch.plans.detector import Detector
from test_streaming import wire


def call(spark, *argv):
    args = app.parser().parse_args(list(argv))
    return app.JOBS[args.job](spark, args)


@pytest.mark.parametrize("model", [["--window-mean"], ["--pca", "4"], ["--absolute", "4"], []])
def test_archive_fit_score_diagnose(spark, tmp_path, model):
    wire(spark, range(300)).coalesce(1).write.parquet(f"{tmp_path}/records")
    path, detector = f"{tmp_path}/archive", f"{tmp_path}/detector"
    records = ["--records", f"{tmp_path}/records"]
    call(spark, "archive", *records, "--path", path, "--checkpoint", f"{tmp_path}/c1")
    fitted = call(
        spark, "fit", "--path", path, "--detector", detector, "--as-of", "2024-01-02", *model
    )
    again = Detector.load(spark, detector)
    assert again.threshold == fitted.threshold and type(again.model) is type(fitted.model)

    out = f"{tmp_path}/scores"
    call(spark, "score", *records, "--detector", detector, "--out", out, "--checkpoint", f"{tmp_path}/c2")
    sent = spark.read.parquet(out)
    assert set(sent.columns) == {"key", "value"} and sent.count() == 275
    assert sent.filter(F.get_json_object("value", "$.isAnomaly") == "true").count() == 0

    shapes = f"{tmp_path}/shapes"
    call(spark, "diagnose", *records, "--detector", detector, "--out", shapes, "--checkpoint", f"{tmp_path}/c3")
    assert spark.read.parquet(shapes).columns == ["value"]


def test_damaged_records_end_no_job_and_are_kept(spark, tmp_path):
    good = wire(spark, range(300))
    text = F.col("value").cast("string")
    bad = good.withColumn(
        "value", F.when(F.col("offset") % 100 == 7, F.concat(F.lit("{"), text)).otherwise(text).cast("binary")
    )
    good.coalesce(1).write.parquet(f"{tmp_path}/history")
    bad.coalesce(1).write.parquet(f"{tmp_path}/records")
    path, detector = f"{tmp_path}/archive", f"{tmp_path}/detector"
    call(spark, "archive", "--records", f"{tmp_path}/history", "--path", path, "--checkpoint", f"{tmp_path}/c1")
    call(spark, "fit", "--path", path, "--detector", detector, "--as-of", "2024-01-02", "--window-mean")

    records = ["--records", f"{tmp_path}/records"]
    out, rejects = f"{tmp_path}/scores", f"{tmp_path}/rejects"
    call(spark, "score", *records, "--detector", detector, "--out", out, "--rejects", rejects, "--checkpoint", f"{tmp_path}/c2")
    kept = spark.read.parquet(rejects).select("reason").collect()
    assert [r.reason for r in kept] == ["no JSON"] * 3
    # Of the windows that end in time, those with a missing reading are not scored: 20 for each of the three but the first.
    assert spark.read.parquet(out).count() == 275 - 8 - 20 - 20

    beside = f"{tmp_path}/unreadable"
    call(spark, "archive", *records, "--path", f"{tmp_path}/second", "--rejects", beside, "--checkpoint", f"{tmp_path}/c3")
    assert spark.read.parquet(beside).count() == 3
    assert spark.read.parquet(f"{tmp_path}/second").count() == 297 * 2


def test_late_readings_are_kept(spark, tmp_path):
    wire(spark, range(300)).coalesce(1).write.parquet(f"{tmp_path}/records")
    path, detector, late = f"{tmp_path}/archive", f"{tmp_path}/detector", f"{tmp_path}/late"
    records = ["--records", f"{tmp_path}/records"]
    call(spark, "archive", *records, "--path", path, "--checkpoint", f"{tmp_path}/c1")
    call(spark, "fit", "--path", path, "--detector", detector, "--as-of", "2024-01-02", "--window-mean")
    score = ["score", *records, "--detector", detector, "--out", f"{tmp_path}/out", "--late", late, "--checkpoint", f"{tmp_path}/c2"]
    call(spark, *score)
    assert spark.read.parquet(late).count() == 0
    wire(spark, range(100, 110), first=300).coalesce(1).write.mode("append").parquet(f"{tmp_path}/records")
    call(spark, *score)
    found = spark.read.parquet(late).select("offset", "missed_windows").collect()
    assert sorted((r.offset, r.missed_windows) for r in found) == [(i, 20) for i in range(300, 310)]


def test_arguments():
    with pytest.raises(SystemExit):
        app.parser().parse_args(["score", "--detector", "d", "--checkpoint", "c"])
    args = app.parser().parse_args(["fit", "--path", "p", "--detector", "d"])
    assert (args.days, args.pca, args.window_mean) == (2, 8, False)
    assert app.named("seqwatch.plans.detector:window_mean")(None).channels == 2
