"""The jobs as programs, for ``spark-submit``.

    app.py archive  --servers HOST --path ARCHIVE --checkpoint DIR
    app.py fit      --path ARCHIVE --detector DIR [--as-of TIME] [--days 2] [--pca 8 | --absolute 8 | --window-mean]
    app.py score    --servers HOST --detector DIR --checkpoint DIR [--nested] [--float32] [--late DIR] [--rejects DIR]
    app.py diagnose --servers HOST --detector DIR --checkpoint DIR

Streams run until they are stopped. With ``--records`` and ``--out`` folders in place of
``--servers`` they take record files, write message files, and end. ``--model MODULE:FUNCTION``
names a model of your own: for ``fit`` a function of the training sequences, else one of the
model's folder and the session.
"""

from __future__ import annotations

import argparse
import importlib
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from seqwatch import names
from seqwatch.operators import records
from seqwatch.plans import archive, detector as det
from seqwatch.session import RECOMMENDED_CONF
from seqwatch.sinks import messages
from seqwatch.sources import files, kafka
from seqwatch.streaming import run, scoring


def named(text: str) -> Callable:
    """The function that ``MODULE:FUNCTION`` names."""
    module, _, function = text.partition(":")
    return getattr(importlib.import_module(module), function)


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="seqwatch")
    jobs = root.add_subparsers(dest="job", required=True)

    def job(name: str, *wanted: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        for option in wanted:
            sub.add_argument(f"--{option}", required=True)
        return sub

    fit = job("fit", "path", "detector")
    fit.add_argument("--as-of", type=datetime.fromisoformat, help="end of the history, default now")
    fit.add_argument("--days", type=float, default=names.HISTORY.days)
    kind = fit.add_mutually_exclusive_group()
    kind.add_argument("--pca", type=int, default=8, help="components of the fitted model")
    kind.add_argument("--absolute", type=int, help="components of a model fitted under the absolute error")
    kind.add_argument("--window-mean", action="store_true", help="a model that needs no fitting")
    kind.add_argument("--model", type=named, help="MODULE:FUNCTION that fits a model of your own")
    fit.add_argument("--drop-incomplete", action="store_true", help="leave out incomplete history rows")
    scores = job("score", "detector", "checkpoint")
    scores.add_argument("--late", help="folder for readings that came too late for some window")
    for sub in (
        job("archive", "path", "checkpoint"),
        scores,
        job("diagnose", "detector", "checkpoint"),
    ):
        origin = sub.add_mutually_exclusive_group(required=True)
        origin.add_argument("--servers")
        origin.add_argument("--records", help="folder of record files instead of a broker")
        sub.add_argument("--out", help="folder for message files, with --records")
        sub.add_argument("--topic", help="topic to read, default that of the job")
        sub.add_argument("--group", help="consumer group, default one per query")
        sub.add_argument("--state-partitions", type=int)
        sub.add_argument("--nested", action="store_true", help="messages without an event time")
        sub.add_argument("--model", type=named, help="MODULE:FUNCTION that loads a model of your own")
        sub.add_argument("--rejects", help="folder for records without a reading, which then end no job")
        sub.add_argument("--float32", action="store_true", help="compare at single precision")
    return root


def _records(spark: SparkSession, args: argparse.Namespace, topics) -> DataFrame:
    if args.records:
        return files.stream_records(spark, args.records)
    return kafka.read_stream(
        spark, servers=args.servers, topics=args.topic or topics, group_id=args.group
    )


def _send(sent: DataFrame, args: argparse.Namespace, topic: str) -> None:
    if args.records:
        run.run_to_end(sent, args.out, args.checkpoint, state_partitions=args.state_partitions)
        return
    options = kafka.sink_options(args.servers, topic)
    run.wait(
        run.to_kafka(sent, args.checkpoint, options, state_partitions=args.state_partitions)
    )


def _send_with_rejects(
    sent: DataFrame, wire: DataFrame, args: argparse.Namespace, topic: str
) -> None:
    """Messages to where they go, and the records that gave no reading to ``--rejects``."""
    target = args.out if args.records else run.kafka_target(kafka.sink_options(args.servers, topic))
    parts = {
        "messages": (target, lambda batch: batch.filter("reason IS NULL").drop("reason")),
        "rejects": (args.rejects, lambda batch: batch.filter("reason IS NOT NULL")),
    }
    both = scoring.with_rejects(sent, wire)
    options = dict(finish=bool(args.records), state_partitions=args.state_partitions)
    run.wait(run.to_parts(both, parts, args.checkpoint, **options))


def fit(spark: SparkSession, args: argparse.Namespace) -> det.Detector:
    as_of = args.as_of or datetime.now(timezone.utc)
    if as_of.tzinfo is None:
        as_of = as_of.replace(tzinfo=timezone.utc)
    history = archive.read_history(
        spark, args.path, as_of, timedelta(days=args.days), sort=False
    )
    history = records.require_channels(history, on_invalid="drop" if args.drop_incomplete else "error")
    components = det.absolute(args.absolute) if args.absolute else det.pca(args.pca)
    make_model = args.model or (det.window_mean if args.window_mean else components)
    fitted = det.fit_detector(history, make_model)
    fitted.save(spark, args.detector)
    return fitted


def store(spark: SparkSession, args: argparse.Namespace) -> None:
    topics = [names.READINGS_TOPIC, names.PREDICTIONS_TOPIC]
    wire = _records(spark, args, topics)
    points = archive.archive_points(wire)
    finish = bool(args.records)
    archived = run.to_archive(points, args.path, args.checkpoint, finish=finish)
    if args.rejects:
        # Points and records have nothing in common, so the records without a point have their own query.
        bad = records.rejects(wire, channels=(), timed=True)
        beside = run.start(bad, f"{args.checkpoint}-rejects", format="parquet", path=args.rejects, finish=finish)
        if finish:
            run.wait(beside)
    run.wait(archived)


def score(spark: SparkSession, args: argparse.Namespace) -> None:
    wire = _records(spark, args, names.READINGS_TOPIC)
    detector = det.Detector.load(spark, args.detector, args.model)
    reading = dict(tie_cols=["offset"], on_invalid="drop" if args.rejects else "error")
    sent = scoring.message_stream(
        wire, detector, nested=args.nested, float32=args.float32, **reading
    )
    if args.late:
        # A query of its own: it keeps its state beside that of the scores.
        beside = run.start(
            scoring.late_stream(wire, detector.scaler, **reading),
            f"{args.checkpoint}-late",
            format="parquet",
            path=args.late,
            finish=bool(args.records),
            state_partitions=args.state_partitions,
        )
    if args.rejects:
        _send_with_rejects(sent, wire, args, names.PREDICTIONS_TOPIC)
    else:
        _send(sent, args, names.PREDICTIONS_TOPIC)
    if args.late and args.records:
        run.wait(beside)


def diagnose(spark: SparkSession, args: argparse.Namespace) -> None:
    wire = _records(spark, args, names.DEMO_TOPIC)
    detector = det.Detector.load(spark, args.detector, args.model)
    shapes = scoring.shape_stream(wire, detector.scaler, detector.threshold, tie_cols=["offset"])
    _send(messages.diagnostic_messages(shapes, detector.channels), args, names.DIAGNOSTICS_TOPIC)


JOBS = {"fit": fit, "archive": store, "score": score, "diagnose": diagnose}


def main(argv: list[str] | None = None) -> None:
    options = parser()
    args = options.parse_args(argv)
    if getattr(args, "records", None) and args.job != "archive" and not args.out:
        options.error("--records needs --out")
    spark = SparkSession.builder.appName(f"seqwatch-{args.job}").config(map=RECOMMENDED_CONF)
    JOBS[args.job](spark.getOrCreate(), args)


if __name__ == "__main__":
    main()
