"""JOB-2 to JOB-4 on a stream of records (STR-1 to STR-5, STR-9)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from seqwatch import names
from seqwatch.operators import records as rec, scaling, windows
from seqwatch.plans import scoring as plan
from seqwatch.plans.detector import Detector
from seqwatch.sinks import messages
from seqwatch.streaming import windows as stateful


def read_scaled(
    wire: DataFrame,
    scaler: scaling.MinMaxParams,
    *,
    series_keys: Sequence[str] = (),
    tie_cols: Sequence[str] = (),
    on_invalid: str = "error",
    payload_time: bool = False,
) -> DataFrame:
    """Records to scaled readings."""
    carry = list(dict.fromkeys([*series_keys, *tie_cols]))
    readings = rec.read_records(
        wire,
        scaler.channels,
        carry,
        on_invalid,
        observed_as="decode",
        payload_time=payload_time,
    )
    return scaling.scale(readings, scaler, scaler.channels)


def stream_blocks(
    wire: DataFrame,
    scaler: scaling.MinMaxParams,
    *,
    series_keys: Sequence[str] = (),
    tie_cols: Sequence[str] = (),
    watermark: timedelta = names.WATERMARK,
    window: timedelta = names.WINDOW,
    slide: timedelta = names.SLIDE,
    least_block: int = stateful.LEAST_BLOCK,
    **reading,
) -> DataFrame:
    """Records to ended windows by the block, and late readings; see `stateful`."""
    scaled = read_scaled(wire, scaler, series_keys=series_keys, tie_cols=tie_cols, **reading)
    return stateful.block_rows(
        scaled,
        scaler.channels,
        watermark=watermark,
        tie_cols=tie_cols,
        series_keys=series_keys,
        window=window,
        slide=slide,
        least_block=least_block,
    )


def stream_windows(
    wire: DataFrame,
    scaler: scaling.MinMaxParams,
    *,
    series_keys: Sequence[str] = (),
    tie_cols: Sequence[str] = (),
    watermark: timedelta = names.WATERMARK,
    window: timedelta = names.WINDOW,
    slide: timedelta = names.SLIDE,
    steps: int = names.STEPS,
    on_overflow: str = "error",
    burst_slots: int | None = None,
    least_block: int = stateful.LEAST_BLOCK,
    **reading,
) -> DataFrame:
    """Records to ordered sequences per window; append mode emits a window once,
    when the watermark has passed its end.

    Windows are cut out of state that has each point once. With ``on_overflow="keep"`` a window
    may have any number of points. With ``burst_slots`` as well it is gathered in that many
    groups, which write each point 20 times, so that one busy series does not end in one task.
    """
    if on_overflow == "keep" and burst_slots:
        scaled = read_scaled(wire, scaler, series_keys=series_keys, tie_cols=tie_cols, **reading)
        return windows.grouped_sequences(
            scaled.withWatermark("timestamp", f"{watermark.total_seconds()} seconds"),
            scaler.channels,
            tie_cols=tie_cols,
            series_keys=series_keys,
            window=window,
            slide=slide,
            steps=steps,
            on_overflow=on_overflow,
            burst_slots=burst_slots,
        )
    shape = dict(tie_cols=tie_cols, series_keys=series_keys, window=window, slide=slide)
    found = stream_blocks(wire, scaler, watermark=watermark, least_block=least_block, **shape, **reading)
    return stateful.cut_windows(
        found, scaler.channels, steps=steps, on_overflow=on_overflow, **shape
    )


def late_stream(
    wire: DataFrame,
    scaler: scaling.MinMaxParams,
    *,
    series_keys: Sequence[str] = (),
    tie_cols: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Records to the readings that came too late for some window, scaled, and how many they missed."""
    shape = dict(tie_cols=tie_cols, series_keys=series_keys)
    found = stream_blocks(wire, scaler, **shape, **options)
    return stateful.late_readings(found, scaler.channels, **shape)


def score_stream(
    wire: DataFrame,
    detector: Detector,
    *,
    nested: bool = False,
    float32: bool = False,
    series_keys: Sequence[str] = (),
    **window_options,
) -> DataFrame:
    """Records to scores; ``nested`` keeps ``window`` as a struct."""
    windowed = stream_windows(
        wire,
        detector.scaler,
        series_keys=series_keys,
        steps=detector.steps,
        **window_options,
    )
    scored = plan.score_windows(windowed, detector, float32=float32)
    return scored if nested else plan.flatten_window(scored, series_keys)


def message_stream(
    wire: DataFrame, detector: Detector, *, nested: bool = False, **options
) -> DataFrame:
    """Records to prediction messages; ``nested`` gives the variant without an event time."""
    scored = score_stream(wire, detector, nested=nested, **options)
    if nested:
        return messages.nested_prediction_messages(scored, detector.channels)
    return messages.prediction_messages(scored, detector.channels)


def with_rejects(
    sent: DataFrame, wire: DataFrame, channels: Sequence[str] = names.CHANNELS, timed: bool = False
) -> DataFrame:
    """Messages and, beside them, the records that gave no reading: ``key, value, reason``.

    Both come out of one query, so that `run.to_parts` can write them batch by batch; messages
    have no reason. The messages' stream has to drop such records (``on_invalid="drop"``).
    """
    columns = [F.col(c).cast("string").alias(c) for c in ("key", "value")]
    good = sent.select(*columns, F.lit(None).cast("string").alias("reason"))
    return good.unionByName(rec.rejects(wire, channels, timed).select(*columns, "reason"))


def shape_stream(
    wire: DataFrame,
    scaler: scaling.MinMaxParams,
    threshold: Sequence[float],
    **window_options,
) -> DataFrame:
    """The diagnostic stream: window shapes instead of scores, of windows of any length."""
    window_options.setdefault("on_overflow", "keep")
    return plan.window_shapes(
        stream_windows(wire, scaler, **window_options), threshold, scaler.channels
    )
