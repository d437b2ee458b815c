"""One query per operator or job; every one reads whole tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqwatch import names
from seqwatch.checks import fixture
from seqwatch.functions import sequences, times
from seqwatch.operators import models, points, records, rows, scaling, scoring, windows
from seqwatch.operators.once import add_once
from seqwatch.plans import archive, detector as det, scoring as plan
from seqwatch.session import scratch_path
from seqwatch.sinks import messages, tables
from seqwatch.sources import files
from seqwatch.streaming import run, scoring as streams, windows as stateful

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, Query] = {}

DIGITS = 9
FULL_SPAN = (datetime(2100, 1, 1, tzinfo=timezone.utc), timedelta(days=36_525))


def query(fn: Query) -> Query:
    def run_in_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)

    ALL[fn.__name__] = run_in_utc
    return fn


def rounded(c: str | Column) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, DIGITS)


def epoch(c: str) -> Column:
    return F.unix_timestamp(c)


def digest(seq: Column, channel: int) -> Column:
    """A value that depends on every element of a channel and its place."""
    weighted = F.transform(seq, lambda x, i: x[channel] * (i + 1))
    return F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)


def window_bounds() -> list[Column]:
    return [
        epoch("window.start").alias("window_start"),
        epoch("window.end").alias("window_end"),
    ]


def digests(features: str = "features") -> list[Column]:
    return [
        F.size(features).alias("n_points"),
        rounded(digest(F.col(features), 0)).alias("digest_set_t"),
        rounded(digest(F.col(features), 1)).alias("digest_v_t"),
    ]


def scaled_readings(df: DataFrame) -> DataFrame:
    return scaling.scale(df, scaling.fit(df))


def shaped(sequence_rows: DataFrame) -> DataFrame:
    return sequence_rows.withColumn(
        "features", sequences.unflat(F.col("features"), names.STEPS, len(names.CHANNELS))
    )


def score_columns() -> list[Column]:
    return [
        epoch("window_start").alias("window_start"),
        epoch("window_end").alias("window_end"),
        F.col("isAnomaly").alias("is_anomaly"),
        *[rounded(f"mae_{c}").alias(f"mae_{c}") for c in names.CHANNELS],
        *[rounded(f"threshold_{c}").alias(f"threshold_{c}") for c in names.CHANNELS],
    ]


def fitted(spark: SparkSession, sf_dir: str) -> det.Detector:
    history = fixture.history(fixture.readings(spark, sf_dir))
    return det.fit_detector(history, det.window_mean, order_by=["timestamp", "event_id"])


def state_partitions(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def trainer_tasks(spark: SparkSession, trainers: int) -> int:
    """Tasks for each trainer's share, so that all together are as many as of any other shuffle."""
    return -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // trainers)


# Records


@query
def decode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = fixture.wire(fixture.readings(spark, sf_dir))
    decoded = records.read_records(wire, carry=["offset"])
    return decoded.select(
        "offset", epoch("timestamp").alias("event_time"), "set_t", "v_t"
    )


@query
def decode_payload_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = fixture.wire(fixture.readings(spark, sf_dir))
    decoded = records.read_records(wire, carry=["offset"], payload_time=True)
    return decoded.select(
        "offset", epoch("timestamp").alias("event_time"), "set_t", "v_t"
    )


@query
def encode_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = records.encode(fixture.readings(spark, sf_dir), carry=["event_id"])
    return encoded.select(
        "event_id",
        "key",
        F.col("value").alias("message"),
        times.from_epoch_text(F.get_json_object("value", "$.event_timestamp"))
        .cast("bigint")
        .alias("event_time"),
    )


@query
def encode_records_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = records.encode(
        fixture.readings(spark, sf_dir), time_col=None, carry=["event_id"]
    )
    return encoded.select("event_id", "key", F.col("value").alias("message"))


@query
def oversize_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = fixture.table(spark, sf_dir, "documents")
    kept = records.drop_oversize(documents, max_bytes=5_000, value_col="text")
    return kept.select("doc_id", F.octet_length("text").alias("n_bytes"))


@query
def topic_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = fixture.table(spark, sf_dir, "events")
    chosen = records.select_topics(events, ["click", "error"], topic_col="event_type")
    return chosen.select("event_id", F.col("event_type").alias("topic"))


@query
def damaged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreadable and incomplete records stay, with nulls, if asked for."""
    wire = fixture.damaged(fixture.wire(fixture.readings(spark, sf_dir)))
    kept = records.read_records(wire, carry=["offset"], on_invalid="keep")
    return kept.select("offset", epoch("timestamp").alias("event_time"), "set_t", "v_t")


# Points


@query
def points_unpivot_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = fixture.nested_wire(fixture.readings(spark, sf_dir))
    return points.unpivot_json(wire).select(
        "key",
        epoch("_time").alias("point_time"),
        F.col("_field").alias("field"),
        F.col("_value").alias("value"),
    )


@query
def points_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = fixture.wire(fixture.readings(spark, sf_dir))
    return points.unpivot_json(wire).select(
        "measurement",
        "key",
        epoch("_time").alias("point_time"),
        F.col("_field").alias("field"),
        F.col("_value").alias("value"),
        F.col("_arrival").alias("arrival"),
    )


@query
def points_unpivot_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = plan.score_readings(fixture.readings(spark, sf_dir), fitted(spark, sf_dir))
    wire = messages.prediction_messages(plan.flatten_window(scored)).select(
        "value", F.lit(names.PREDICTIONS_TOPIC).alias("topic"), F.lit(0).alias("offset")
    )
    found = points.unpivot_json(wire)
    # The least and greatest text are found by sorting: equal texts, and all numbers, are hashed before.
    cells = found.groupBy(F.col("key"), F.col("_field").alias("field"), "_svalue").agg(
        F.count("_value").alias("n_values"),
        F.count("_svalue").alias("n_texts"),
        F.sum("_value").alias("total"),
    )
    return cells.groupBy("key", "field").agg(
        F.sum("n_values").alias("n_values"),
        F.sum("n_texts").alias("n_texts"),
        F.round(F.sum("total"), 6).alias("total"),
        F.min("_svalue").alias("first_text"),
        F.max("_svalue").alias("last_text"),
    )


@query
def points_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = points.unpivot_columns(
        fixture.readings(spark, sf_dir), key=F.col("topic"), arrival_col="event_id"
    )
    return points.pivot(long, row_key=["key", "_time"]).select(
        "key", epoch("_time").alias("point_time"), "set_t", "v_t"
    )


@query
def points_pivot_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = points.unpivot_columns(
        fixture.keyed_readings(spark, sf_dir), key=F.col("topic"), arrival_col="event_id"
    )
    return points.pivot(long, row_key=["key", "_time"]).select(
        "key", epoch("_time").alias("point_time"), "set_t", "v_t"
    )


@query
def points_pivot_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last point to arrive, from four partitions that have the same offsets."""
    df = fixture.keyed_readings(spark, sf_dir).withColumns(
        {"partition": (F.col("event_id") % 4).cast("int"), "offset": F.floor(F.col("event_id") / 4)}
    )
    long = points.unpivot_columns(df, key=F.col("topic"), arrival_col=points.arrival())
    return points.pivot(long, row_key=["key", "_time"]).select(
        "key", epoch("_time").alias("point_time"), "set_t", "v_t"
    )


@query
def history_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = points.unpivot_columns(
        fixture.event_time_readings(spark, sf_dir), key=F.col("topic"), arrival_col="event_id"
    )
    path = scratch_path(spark, "archive")
    tables.write_archive(long, path)
    as_of = datetime(2024, 1, 30, tzinfo=timezone.utc)
    found = archive.read_history(spark, path, as_of)
    return found.select(
        F.unix_micros("timestamp").alias("time_us"), "set_t", "v_t"
    )


@query
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    wire = fixture.wire(fixture.readings(spark, sf_dir))
    path = scratch_path(spark, "archive")
    archive.archive(wire, path)
    back = [
        archive.read_history(spark, path, *FULL_SPAN, key=topic, sort=False).withColumn(
            "key", F.lit(topic)
        )
        for topic in (names.READINGS_TOPIC, names.PREDICTIONS_TOPIC)
    ]
    return back[0].unionByName(back[1]).select(
        "key", epoch("timestamp").alias("event_time"), "set_t", "v_t"
    )


# Scaling


@query
def scaler_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.fit(fixture.readings(spark, sf_dir))


@query
def scaler_fit_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaling.fit(fixture.event_time_readings(spark, sf_dir), series_keys=["user_id"])


@query
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = scaled_readings(fixture.readings(spark, sf_dir))
    return scaled.select(
        "event_id", *[rounded(c).alias(f"scaled_{c}") for c in names.CHANNELS]
    )


@query
def minmax_scale_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture.event_time_readings(spark, sf_dir)
    bounds = tables.stored(
        scaling.fit(df, series_keys=["user_id"]), scratch_path(spark, "bounds")
    )
    scaled = scaling.scale(df, bounds, series_keys=["user_id"])
    return scaled.select(
        "event_id", "user_id", *[rounded(c).alias(f"scaled_{c}") for c in names.CHANNELS]
    )


@query
def minmax_scale_unseen_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds that miss a series: its rows stay, with null channels."""
    df = fixture.keyed_readings(spark, sf_dir)
    bounds = tables.stored(
        scaling.fit(df.filter("series != 3"), series_keys=["series"]), scratch_path(spark, "bounds")
    )
    scaled = scaling.scale(df, bounds, series_keys=["series"])
    return scaled.select(
        "event_id", "series", *[rounded(c).alias(f"scaled_{c}") for c in names.CHANNELS]
    )


@query
def scaler_model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture.readings(spark, sf_dir)
    path = scratch_path(spark, "scaler")
    tables.save_scaler(scaling.fit_model(df), path)
    loaded = scaling.MinMaxParams.of_model(tables.load_scaler(path), names.CHANNELS)
    return scaling.scale(df, loaded).select(
        "event_id", *[rounded(c).alias(f"scaled_{c}") for c in names.CHANNELS]
    )


@query
def vector_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture.readings(spark, sf_dir)
    tagged = scaling.time_tagged_vectors(df, scaling.fit_model(df), carry=["event_id"])
    vector = F.col("features_with_timestamp")
    return tagged.select(
        "event_id",
        vector[0].alias("epoch_seconds"),
        rounded(vector[1]).alias("scaled_set_t"),
        rounded(vector[2]).alias("scaled_v_t"),
    )


# Sequences per window


@query
def sliding_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.sliding_sequences(
        scaled_readings(fixture.readings(spark, sf_dir)), tie_cols=["event_id"]
    )
    return found.select(
        *window_bounds(), F.posexplode("features").alias("pos", "x")
    ).select(
        "window_start",
        "window_end",
        "pos",
        rounded(F.col("x")[0]).alias("set_t"),
        rounded(F.col("x")[1]).alias("v_t"),
    )


@query
def sliding_sequences_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.sliding_sequences(
        scaled_readings(fixture.keyed_readings(spark, sf_dir)), series_keys=["series"]
    )
    return found.select("series", *window_bounds(), *digests())


@query
def sliding_sequences_irregular(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.sliding_sequences(
        fixture.event_time_readings(spark, sf_dir),
        tie_cols=["event_id"],
        series_keys=["user_id"],
        window=timedelta(days=1),
        slide=timedelta(hours=1),
    )
    return found.select("user_id", *window_bounds(), *digests())


@query
def vector_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture.readings(spark, sf_dir)
    tagged = scaling.time_tagged_vectors(df, scaling.fit_model(df))
    found = windows.sliding_vectors(tagged, "features_with_timestamp")
    return found.select(*window_bounds(), *digests())


@query
def window_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.sliding_sequences(
        fixture.event_time_readings(spark, sf_dir),
        tie_cols=["event_id"],
        window=timedelta(hours=1),
        slide=timedelta(minutes=5),
    )
    return found.select(
        *window_bounds(),
        F.size("features").alias("n_points"),
        scoring.is_complete(F.col("features")).alias("complete"),
    )


@query
def sequence_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture.readings(spark, sf_dir)
    windowed = windows.sliding_sequences(scaled_readings(df))
    return plan.window_shapes(windowed, [0.25, 0.5]).select(
        *window_bounds(), "shape_before", "shape_after", "threshold_set_t", "threshold_v_t"
    )


@query
def float32_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    windowed = windows.sliding_sequences(scaled_readings(fixture.readings(spark, sf_dir)))
    single = windowed.withColumn("features", sequences.as_float32(F.col("features")))
    return single.select(
        *window_bounds(), F.posexplode("features").alias("pos", "x")
    ).select(
        "window_start",
        "pos",
        rounded(F.col("x")[0].cast("double")).alias("set_t"),
        rounded(F.col("x")[1].cast("double")).alias("v_t"),
    )


# Sequences by row count


@query
def row_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rows.row_sequences(
        scaled_readings(fixture.readings(spark, sf_dir)), order_by=["timestamp", "event_id"]
    )
    return shaped(found).select(
        F.col("event_id").alias("first_event"), F.posexplode("features").alias("pos", "x")
    ).select(
        "first_event",
        "pos",
        rounded(F.col("x")[0]).alias("set_t"),
        rounded(F.col("x")[1]).alias("v_t"),
    )


@query
def row_sequences_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rows.row_sequences(
        scaled_readings(fixture.event_time_readings(spark, sf_dir)),
        order_by=["timestamp", "event_id"],
        series_keys=["user_id"],
        chunk_rows=512,
    )
    return shaped(found).select(
        "user_id", F.col("event_id").alias("first_event"), *digests()
    )


@query
def row_sequences_tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of all rows are equal in the order asked for; they follow each other by event."""
    readings = scaled_readings(fixture.readings(spark, sf_dir))
    third = F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("event_id"))
    found = rows.row_sequences(
        readings.withColumn("place", third), order_by=["place"], carry=["event_id"], chunk_rows=512
    )
    return shaped(found).select(F.col("event_id").alias("first_event"), *digests())


@query
def row_index_equal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows equal in all columns, thousands of each: the numbers each group of them takes."""
    readings = fixture.readings(spark, sf_dir).select("topic", (F.col("set_t") % 2).alias("odd"))
    numbered = rows.row_index(readings, ["topic"])
    return numbered.groupBy("topic", "odd").agg(
        F.min("row_index").alias("first_row"),
        F.max("row_index").alias("last_row"),
        F.countDistinct("row_index").alias("n_rows"),
    )


@query
def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides of every pair, each as a number that depends on all its values."""
    found = rows.row_sequences(
        scaled_readings(fixture.readings(spark, sf_dir)), order_by=["timestamp", "event_id"]
    )
    pairs = rows.as_training_pairs(found, partitions=4, carry=["event_id"], tasks=trainer_tasks(spark, 4))

    def weighted(side: str) -> Column:
        terms = F.transform(side, lambda x, i: x * (i + 1))
        return rounded(F.aggregate(terms, F.lit(0.0), lambda a, v: a + v)).alias(side)

    return pairs.select(
        F.col("event_id").alias("first_event"), F.size("labels").alias("n"),
        weighted("features"), weighted("labels"),
    )


@query
def fit_split_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rows.row_sequences(
        scaled_readings(fixture.readings(spark, sf_dir)), order_by=["timestamp", "event_id"]
    )
    pairs = rows.as_training_pairs(found, partitions=2, carry=["event_id"], tasks=trainer_tasks(spark, 2))
    _, first = tables.preview(pairs, ["event_id"], 2)
    return first.select(
        F.col("event_id").alias("first_event"), F.posexplode("labels").alias("pos", "label")
    ).select("first_event", "pos", rounded("label").alias("label"))


@query
def fit_split_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of the training pairs, with the counts of all of them."""
    found = rows.row_sequences(
        scaled_readings(fixture.readings(spark, sf_dir)), order_by=["timestamp", "event_id"]
    )
    pairs = rows.as_training_pairs(found, partitions=2, carry=["event_id"], tasks=trainer_tasks(spark, 2))
    return tables.schema_rows(pairs)


# Scores


@query
def sequence_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    windowed = windows.sliding_sequences(scaled_readings(fixture.readings(spark, sf_dir)))
    complete = windowed.filter(scoring.is_complete(F.col("features")))
    errors = scoring.add_errors(models.WindowMean().reconstruct(complete))
    return errors.select(
        *window_bounds(), *[rounded(f"mae_{c}").alias(f"mae_{c}") for c in names.CHANNELS]
    )


@query
def mae_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = scaled_readings(fixture.history(fixture.readings(spark, sf_dir)))
    training = rows.row_sequences(history, order_by=["timestamp", "event_id"], flat=False)
    path = scratch_path(spark, "threshold")
    tables.write_threshold(
        scoring.fit_threshold(det.training_errors(training, models.WindowMean())), path
    )
    stored = files.read_threshold(spark, path)
    return stored.select(
        *[
            rounded(F.col("mae_threshold")[i]).alias(f"threshold_{c}")
            for i, c in enumerate(names.CHANNELS)
        ]
    )


@query
def anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = plan.score_readings(
        fixture.readings(spark, sf_dir), fitted(spark, sf_dir), tie_cols=["event_id"]
    )
    packed = scoring.as_score_struct(scored)
    return scoring.unpack_scores(packed).select(
        F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_key"),
        *score_columns(),
    )


@query
def anomaly_scores_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with and without anomalies; the unscored ones come along and are dropped."""
    scored = plan.score_readings(
        fixture.jumped(fixture.readings(spark, sf_dir)),
        fitted(spark, sf_dir),
        tie_cols=["event_id"],
        keep_incomplete=True,
    )
    return scoring.unpack_scores(scoring.as_score_struct(scored)).select(*score_columns())


@query
def anomaly_scores_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds per series by join and the threshold by subquery, all lazy."""
    df = fixture.keyed_readings(spark, sf_dir)
    bounds = tables.stored(
        scaling.fit(fixture.history(df), series_keys=["series"]), scratch_path(spark, "bounds")
    )
    scaled = scaling.scale(df, bounds, series_keys=["series"])
    training = rows.row_sequences(
        fixture.history(scaled), order_by=["timestamp"], series_keys=["series"], flat=False
    )
    model = models.WindowMean()
    threshold = scoring.fit_threshold(det.training_errors(training, model))
    windowed = windows.sliding_sequences(scaled, series_keys=["series"])
    scored = plan.flatten_window(scoring.score(windowed, model, threshold), ["series"])
    return scored.select("series", *score_columns())


@query
def anomaly_scores_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = plan.score_readings(
        fixture.readings(spark, sf_dir), fitted(spark, sf_dir), keep_incomplete=True
    )
    return plan.flatten_window(scored).select(
        F.size("features").alias("n_points"), *score_columns()
    )


@query
def predictions_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = plan.score_readings(fixture.readings(spark, sf_dir), fitted(spark, sf_dir))
    sent = messages.prediction_messages(plan.flatten_window(scored))
    return _parsed(sent).select("key", *_message_columns(), _message_time().alias("event_time"))


@query
def predictions_message_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = plan.score_readings(fixture.readings(spark, sf_dir), fitted(spark, sf_dir))
    sent = messages.nested_prediction_messages(scored)
    return _parsed(sent).select(
        "key",
        *_message_columns(),
        _message_time().isNotNull().alias("has_event_time"),
    )


_MESSAGE = (
    "window_start string, window_end string, event_timestamp bigint, isAnomaly boolean, "
    "mae_set_t double, mae_v_t double, threshold_v_t double, "
    "features array<array<double>>, prediction array<array<double>>"
)


def _parsed(sent: DataFrame) -> DataFrame:
    """Messages with their fields, which are parsed once and not for each use."""
    return add_once(sent, {"message": F.from_json("value", _MESSAGE)})


def _message_field(name: str) -> Column:
    return F.col("message")[name]


def _message_time() -> Column:
    return _message_field(names.TIME_KEY)


def _message_columns() -> list[Column]:
    return [
        _message_field("window_start").alias("window_start"),
        _message_field("window_end").alias("window_end"),
        _message_field("isAnomaly").alias("is_anomaly"),
        *[rounded(_message_field(c)).alias(c) for c in ("mae_set_t", "mae_v_t", "threshold_v_t")],
        rounded(_message_field("features")[19][1]).alias("last_v_t"),
        rounded(_message_field("prediction")[0][0]).alias("mean_set_t"),
    ]


@query
def user_model_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    windowed = windows.sliding_sequences(scaled_readings(fixture.readings(spark, sf_dir)))
    halving = models.BatchModel(lambda: lambda x: x / 2)
    return scoring.score(windowed, halving, [0.2, 0.02]).select(
        *window_bounds(),
        "isAnomaly",
        rounded("mae_set_t").alias("mae_set_t"),
        rounded("mae_v_t").alias("mae_v_t"),
    )


@query
def pca_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = fixture.readings(spark, sf_dir)
    path = scratch_path(spark, "detector")
    det.fit_detector(
        fixture.history(df), det.pca(8), order_by=["timestamp", "event_id"]
    ).save(spark, path)
    detector = det.Detector.load(spark, path)
    return plan.flatten_window(plan.score_readings(df, detector)).select(*score_columns())


@query
def absolute_reconstruct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the autoencoder that is fitted under the absolute error, saved and loaded."""
    df = fixture.readings(spark, sf_dir)
    path = scratch_path(spark, "detector")
    det.fit_detector(
        fixture.history(df), det.absolute(8), order_by=["timestamp", "event_id"]
    ).save(spark, path)
    detector = det.Detector.load(spark, path)
    return plan.flatten_window(plan.score_readings(df, detector)).select(*score_columns())


@query
def pca_leading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first component alone."""
    df = fixture.readings(spark, sf_dir)
    detector = det.fit_detector(fixture.history(df), det.pca(1), order_by=["timestamp", "event_id"])
    return plan.flatten_window(plan.score_readings(df, detector)).select(*score_columns())


@query
def pca_fixed_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstruction from mean and trend of each channel, about a centre outside that space."""
    steps, width = names.STEPS, len(names.CHANNELS)
    basis = np.zeros((steps * width, 2 * width))
    trend = np.arange(steps) - (steps - 1) / 2
    for c in range(width):
        basis[c::width, 2 * c] = 1 / np.sqrt(steps)
        basis[c::width, 2 * c + 1] = trend / np.sqrt((trend**2).sum())
    center = np.repeat(0.1 * (-1.0) ** np.arange(steps), width)
    path = scratch_path(spark, "model")
    models.PcaReconstruction(center, basis).save(path, spark)
    model = models.PcaReconstruction.load(path, spark)
    windowed = windows.sliding_sequences(scaled_readings(fixture.readings(spark, sf_dir)))
    return scoring.score(windowed, model, [0.2537, 1.0]).select(
        *window_bounds(),
        "isAnomaly",
        rounded("mae_set_t").alias("mae_set_t"),
        rounded("mae_v_t").alias("mae_v_t"),
    )


@query
def pca_full_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many fitted components as values: every window comes back as it was."""
    df = fixture.readings(spark, sf_dir)
    detector = det.fit_detector(
        fixture.history(df),
        det.pca(names.STEPS * len(names.CHANNELS)),
        order_by=["timestamp", "event_id"],
    )
    return plan.flatten_window(plan.score_readings(df, detector)).select(
        epoch("window_start").alias("window_start"),
        rounded("mae_set_t").alias("mae_set_t"),
        rounded("mae_v_t").alias("mae_v_t"),
    )


@query
def fit_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "detector")
    fitted(spark, sf_dir).save(spark, path)
    bounds = spark.read.parquet(f"{path}/scaler")
    thresholds = files.read_threshold(spark, f"{path}/threshold").select(
        F.posexplode("mae_threshold").alias("position", "threshold")
    )
    return bounds.join(thresholds, "position").select(
        "channel", "low", "high", rounded("threshold").alias("threshold")
    )


# Streams


def _finish(spark: SparkSession, df: DataFrame, checkpoint: str, out: str) -> run.RunReport:
    return run.run_to_end(df, out, checkpoint, state_partitions=state_partitions(spark))


@query
def stream_anomaly_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = streams.score_stream(
        fixture.wire_stream(spark, sf_dir), fitted(spark, sf_dir), tie_cols=["offset"], least_block=stateful.LONG_BLOCK
    )
    out = scratch_path(spark, "scores")
    _finish(spark, scored, scratch_path(spark, "stream"), out)
    return spark.read.parquet(out).select(*score_columns())


def _message_stream(spark: SparkSession, sf_dir: str, nested: bool) -> DataFrame:
    sent = streams.message_stream(
        fixture.wire_stream(spark, sf_dir),
        fitted(spark, sf_dir),
        nested=nested,
        tie_cols=["offset"], least_block=stateful.LONG_BLOCK,
    )
    out = scratch_path(spark, "messages")
    _finish(spark, sent, scratch_path(spark, "stream"), out)
    return spark.read.parquet(out)


@query
def stream_predictions_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _message_stream(spark, sf_dir, nested=False)
    return _parsed(sent).select("key", *_message_columns(), _message_time().alias("event_time"))


@query
def stream_predictions_message_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = _message_stream(spark, sf_dir, nested=True)
    return _parsed(sent).select(
        "key", *_message_columns(), _message_time().isNotNull().alias("has_event_time")
    )


@query
def stream_scores_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record key names the series; each has windows of its own."""
    df = fixture.keyed_readings(spark, sf_dir)
    bounds = scaling.MinMaxParams.of_row(scaling.fit(df), names.CHANNELS)
    detector = det.Detector(bounds, models.WindowMean(), (0.3, 0.1))
    scored = streams.score_stream(
        fixture.keyed_wire_stream(spark, sf_dir),
        detector,
        series_keys=["key"],
        tie_cols=["offset"], least_block=stateful.LONG_BLOCK,
    )
    out = scratch_path(spark, "scores")
    _finish(spark, scored, scratch_path(spark, "stream"), out)
    return spark.read.parquet(out).select(
        F.col("key").cast("string").cast("bigint").alias("series"), *score_columns()
    )


@query
def stream_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table once in time, then the whole table again, too late to count."""
    wire = fixture.wire(fixture.readings(spark, sf_dir))
    source, out = scratch_path(spark, "records"), scratch_path(spark, "scores")
    checkpoint = scratch_path(spark, "stream")
    detector = fitted(spark, sf_dir)
    for _ in range(2):
        wire.write.mode("append").parquet(source)
        scored = streams.score_stream(
            files.stream_records(spark, source, wire.schema), detector, tie_cols=["offset"], least_block=stateful.LONG_BLOCK
        )
        _finish(spark, scored, checkpoint, out)
    return spark.read.parquet(out).select(*score_columns())


@query
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table twice; what of the second time is late, and for how many windows."""
    df = fixture.readings(spark, sf_dir)
    wire = fixture.wire(df)
    scaler = scaling.MinMaxParams.of_row(scaling.fit(df), names.CHANNELS)
    source, out = scratch_path(spark, "records"), scratch_path(spark, "late")
    checkpoint = scratch_path(spark, "stream")
    for _ in range(2):
        wire.write.mode("append").parquet(source)
        late = streams.late_stream(
            files.stream_records(spark, source, wire.schema), scaler, tie_cols=["offset"], least_block=stateful.LONG_BLOCK
        )
        _finish(spark, late, checkpoint, out)
    return spark.read.parquet(out).select(
        "offset",
        epoch("timestamp").alias("event_time"),
        *[rounded(c).alias(c) for c in names.CHANNELS],
        "missed_windows",
    )


@query
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a finished stream still holds: points of windows to come, by the block."""
    df = fixture.keyed_readings(spark, sf_dir)
    scaler = scaling.MinMaxParams.of_row(scaling.fit(df), names.CHANNELS)
    checkpoint = scratch_path(spark, "stream")
    windowed = streams.stream_windows(
        fixture.keyed_wire_stream(spark, sf_dir), scaler, series_keys=["key"], tie_cols=["offset"]
    )
    _finish(spark, windowed, checkpoint, scratch_path(spark, "windows"))
    held = stateful.held_points(spark, checkpoint)
    return held.groupBy(
        F.col("key.key").cast("string").cast("bigint").alias("series"), F.col("key._block").alias("block")
    ).agg(
        F.count("*").alias("n_points"),
        F.min("point.o0").alias("first_offset"),
        F.max("point.o0").alias("last_offset"),
        rounded(F.sum("point.x1")).alias("total"),
    )


@query
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged records go to a table of their own, the messages of the others to theirs."""
    wire = fixture.damaged(fixture.wire_stream(spark, sf_dir))
    scaler = scaling.MinMaxParams(names.CHANNELS, (0.0, 0.0), (100.0, 100.0))
    detector = det.Detector(scaler, models.WindowMean(), (0.25, 0.25), names.STEPS)
    sent = streams.message_stream(wire, detector, tie_cols=["offset"], least_block=stateful.LONG_BLOCK, on_invalid="drop")
    both = streams.with_rejects(sent, wire)
    good, bad = scratch_path(spark, "messages"), scratch_path(spark, "rejects")
    parts = {
        "messages": (good, lambda batch: batch.filter("reason IS NULL").drop("reason")),
        "rejects": (bad, lambda batch: batch.filter("reason IS NOT NULL")),
    }
    checkpoint = scratch_path(spark, "stream")
    run.finished(
        run.to_parts(both, parts, checkpoint, finish=True, state_partitions=state_partitions(spark))
    )
    rejected = spark.read.parquet(bad).select("value", "reason")
    return rejected.groupBy("reason").agg(
        F.count("*").alias("n_records"),
        F.count("value").alias("n_values"),
        F.min("value").alias("first_value"),
        F.max("value").alias("last_value"),
    ).crossJoin(spark.read.parquet(good).agg(F.count("*").alias("n_messages")))


@query
def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of the time range in turn, with a stop and a restart between them."""
    df = fixture.readings(spark, sf_dir)
    wire = fixture.wire(df)
    span = df.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    middle = F.lit(span.a + (span.b - span.a) / 2)
    source, out = scratch_path(spark, "records"), scratch_path(spark, "scores")
    checkpoint = scratch_path(spark, "stream")
    detector = fitted(spark, sf_dir)
    for half in (F.col("timestamp") < middle, F.col("timestamp") >= middle):
        wire.filter(half).write.mode("append").parquet(source)
        scored = streams.score_stream(
            files.stream_records(spark, source, wire.schema), detector, tie_cols=["offset"], least_block=stateful.LONG_BLOCK
        )
        _finish(spark, scored, checkpoint, out)
    return spark.read.parquet(out).select(*score_columns())


@query
def stream_restart_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job with the default trigger, stopped and restarted: what was told of each of its runs."""
    df = fixture.readings(spark, sf_dir)
    wire = fixture.damaged(fixture.wire(df))
    span = df.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    middle = F.lit(span.a + (span.b - span.a) / 2)
    source, out = scratch_path(spark, "records"), scratch_path(spark, "scores")
    checkpoint = scratch_path(spark, "stream")
    detector = fitted(spark, sf_dir)
    told = []
    for number, half in enumerate((F.col("timestamp") < middle, F.col("timestamp") >= middle)):
        wire.filter(half).write.mode("append").parquet(source)
        stream = files.stream_records(spark, source, wire.schema)
        scored = streams.score_stream(stream, detector, tie_cols=["offset"], least_block=stateful.LONG_BLOCK, on_invalid="drop")
        job = run.start(
            scored, checkpoint, format="parquet", path=out, state_partitions=state_partitions(spark)
        )
        job.processAllAvailable()
        job.stop()
        report = run.finished(job, spark)
        counts = (report.input_rows, report.invalid, report.dropped_by_watermark, report.complete)
        told.append((number, *counts, spark.read.parquet(out).count()))
    columns = "run int, n_records bigint, n_invalid bigint, n_dropped bigint, complete boolean, n_scores bigint"
    return spark.createDataFrame(told, columns)


@query
def stream_scores_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four batches from four partitions of a topic; at their borders, records come out of order."""
    wire = fixture.wire(fixture.jumped(fixture.readings(spark, sf_dir)))
    wire = wire.withColumn("partition", (F.col("offset") % 4).cast("int"))
    span = wire.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    source, out = scratch_path(spark, "records"), scratch_path(spark, "scores")
    checkpoint = scratch_path(spark, "stream")
    detector = fitted(spark, sf_dir)
    # A record comes up to two seconds late, within the watermark.
    arrives = F.unix_seconds("timestamp") + F.col("offset") % 3
    first, length = F.unix_seconds(F.lit(span.a)), (span.b - span.a).total_seconds()
    batch = F.least(F.floor((arrives - first) * 4 / F.lit(length)), F.lit(3))
    for part in range(4):
        wire.filter(batch == part).write.mode("append").parquet(source)
        scored = streams.score_stream(
            files.stream_records(spark, source, wire.schema), detector, tie_cols=["partition", "offset"], least_block=stateful.LONG_BLOCK
        )
        _finish(spark, scored, checkpoint, out)
    return spark.read.parquet(out).select(*score_columns())


@query
def stream_user_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plugged model on the stream."""
    bounds = scaling.fit(fixture.readings(spark, sf_dir))
    detector = det.Detector(
        scaling.MinMaxParams.of_row(bounds, names.CHANNELS),
        models.BatchModel(lambda: lambda x: x / 2),
        (0.2537, 1.0),
    )
    scored = streams.score_stream(
        fixture.wire_stream(spark, sf_dir), detector, tie_cols=["offset"], least_block=stateful.LONG_BLOCK
    )
    out = scratch_path(spark, "scores")
    _finish(spark, scored, scratch_path(spark, "stream"), out)
    return spark.read.parquet(out).select(*score_columns())


@query
def stream_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = scaling.fit(fixture.readings(spark, sf_dir))
    shapes = streams.shape_stream(
        fixture.wire_stream(spark, sf_dir),
        scaling.MinMaxParams.of_row(bounds, names.CHANNELS),
        [0.25, 0.5],
        tie_cols=["offset"],
    )
    out = scratch_path(spark, "messages")
    _finish(spark, messages.diagnostic_messages(shapes), scratch_path(spark, "stream"), out)
    return spark.read.parquet(out).select(
        F.get_json_object("value", "$.window_start").alias("window_start"),
        F.get_json_object("value", "$.window_end").alias("window_end"),
        F.get_json_object("value", "$.shape_before").alias("shape_before"),
        F.get_json_object("value", "$.shape_after").alias("shape_after"),
        F.get_json_object("value", "$.threshold_v_t").cast("double").alias("threshold_v_t"),
    )


@query
def stream_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "archive")
    archived = archive.archive_points(fixture.wire_stream(spark, sf_dir))
    run.to_archive(
        archived, out, scratch_path(spark, "stream"), finish=True
    ).awaitTermination()
    return spark.read.parquet(out).select(
        "measurement",
        "key",
        F.date_format("date", "yyyy-MM-dd").alias("day"),
        epoch("_time").alias("point_time"),
        F.col("_field").alias("field"),
        F.col("_value").alias("value"),
    )
