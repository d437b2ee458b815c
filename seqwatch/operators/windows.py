"""Ordered sequences per sliding event-time window (AGG-1, AGG-2, STR-2)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta
from math import gcd

from pyspark.sql import DataFrame, Window, functions as F

from seqwatch import names
from seqwatch.functions import sequences, times
from seqwatch.operators.once import add_once


def _checked(found: DataFrame, steps: int, on_overflow: str) -> DataFrame:
    """``features`` from all points ``_found``; with ``"error"`` no more than ``steps``."""
    if on_overflow == "keep":
        return found.withColumnRenamed("_found", "features")
    found = add_once(found, {"_found": F.col("_found")})
    failure = F.raise_error(F.lit(f"a window holds more than {steps} points"))
    features = F.when(F.size("_found") <= steps, F.col("_found")).otherwise(
        failure.cast("array<array<double>>")
    )
    return found.withColumn("features", features).drop("_found")


def _overflow(on_overflow: str) -> None:
    if on_overflow not in ("keep", "error"):
        raise ValueError(f"unknown on_overflow: {on_overflow}")


def sliding_sequences(
    df: DataFrame,
    channels: Sequence[str] = names.CHANNELS,
    *,
    time_col: str = "timestamp",
    tie_cols: Sequence[str] = (),
    series_keys: Sequence[str] = (),
    window: timedelta = names.WINDOW,
    slide: timedelta = names.SLIDE,
    steps: int = names.STEPS,
    on_overflow: str = "keep",
    panes_per_chunk: int | None = None,
) -> DataFrame:
    """Per series and window the ordered ``features`` of all its points.

    The same rows as grouping by ``window(time, ...)``, but a row is shuffled
    once or twice instead of once per window it belongs to:

    1. Time is cut into panes (the largest unit that divides window and slide).
    2. Neighbouring panes form a chunk, which also gets the last panes of the
       one before, so that every window ending in a chunk is whole in it.
    3. A window is emitted by its last non-empty pane, from a frame over the
       panes before it. Windows that end in a gap are kept so.

    A row with a missing channel is no point, but its windows are there, if need be empty.

    ``on_overflow="error"`` fails on a window with more than ``steps`` points. That is known
    from ``steps + 1`` points of a pane, or as many panes, so a pane is ranked down to those
    before the shuffle and after it: a burst of any size costs that many rows per map
    task, and the frame stays short however wide the window is.
    """
    _overflow(on_overflow)
    unit = gcd(times.micros(window), times.micros(slide))
    width = times.micros(window) // unit
    stride = times.micros(slide) // unit
    if panes_per_chunk is None:
        panes_per_chunk = max(1024, 8 * width)
    if panes_per_chunk < width:
        raise ValueError("a chunk must hold at least one window")
    keys = list(series_keys)
    order = [time_col, *tie_cols]

    complete = F.lit(True)
    for c in channels:
        complete = complete & F.col(c).isNotNull()
    points = df.filter(F.col(time_col).isNotNull()).select(
        *keys,
        times.floor_div(F.unix_micros(time_col), unit).alias("_pane"),
        F.when(complete, sequences.time_tagged(order, channels)).alias("_point"),
    )
    if on_overflow == "error":
        newest = Window.partitionBy(*keys, "_pane").orderBy(F.desc_nulls_last("_point"))
        points = points.withColumn("_rank", F.row_number().over(newest)).filter(
            F.col("_rank") <= steps + 1
        )
    gathered = F.array_sort(F.collect_list("_point"))
    panes = points.groupBy(*keys, "_pane").agg(
        sequences.strip_time(gathered, len(channels)).alias("_points")
    )

    chunk = times.floor_div(F.col("_pane"), panes_per_chunk)
    in_tail = F.pmod(F.col("_pane"), F.lit(panes_per_chunk)) > panes_per_chunk - width
    chunked = panes.withColumn(
        "_chunk", F.explode(F.when(in_tail, F.array(chunk, chunk + 1)).otherwise(F.array(chunk)))
    )
    along = Window.partitionBy(*keys, "_chunk").orderBy("_pane")
    recent = along.rangeBetween(1 - width, Window.currentRow)
    framed = chunked.select(
        *keys,
        "_pane",
        "_chunk",
        F.lead("_pane").over(along).alias("_next"),
        F.collect_list(F.struct("_pane", "_points")).over(recent).alias("_recent"),
    )
    # The last panes of the windows this pane is the last non-empty one of.
    first = F.col("_chunk") * panes_per_chunk
    low = F.greatest(F.col("_pane"), first)
    high = F.least(
        F.col("_next") - 1, F.col("_pane") + (width - 1), first + (panes_per_chunk - 1)
    )
    # Only those whose window starts at a multiple of the slide.
    low = low + F.pmod(-(low + (1 - width)), F.lit(stride))
    ends = F.when(low <= high, F.sequence(low, high, F.lit(stride).cast("bigint")))
    ended = framed.select(*keys, "_recent", F.explode(ends).alias("_end")).withColumn(
        "_start", F.col("_end") - (width - 1)
    )
    inside = F.filter("_recent", lambda p: p["_pane"] >= F.col("_start"))
    features = F.flatten(F.transform(inside, lambda p: p["_points"]))
    begin = F.col("_start") * unit
    found = ended.select(
        *keys,
        F.struct(
            F.timestamp_micros(begin).alias("start"),
            F.timestamp_micros(begin + times.micros(window)).alias("end"),
        ).alias("window"),
        features.alias("_found"),
    )
    return _checked(found, steps, on_overflow)


def grouped_sequences(
    df: DataFrame,
    channels: Sequence[str] = names.CHANNELS,
    *,
    time_col: str = "timestamp",
    tie_cols: Sequence[str] = (),
    series_keys: Sequence[str] = (),
    window: timedelta = names.WINDOW,
    slide: timedelta = names.SLIDE,
    steps: int = names.STEPS,
    on_overflow: str = "keep",
    burst_slots: int = 1,
) -> DataFrame:
    """The stream form: a grouped aggregate whose state Spark keeps per window.

    On a stream, call it on a frame that carries a watermark. Without slots all
    points of a window meet in one group, which suits series of a steady rate.
    With ``burst_slots`` a window's points are first gathered in that many
    groups; with ``on_overflow="error"`` each passes on ``steps + 1`` points at most, enough
    to tell. Take as many as the busiest window needs. Rows and lateness are the same
    either way.
    """
    _overflow(on_overflow)
    order = [time_col, *tie_cols]
    keys = list(series_keys)
    points = sequences.time_tagged(order, channels)
    span = F.window(time_col, times.interval_text(window), times.interval_text(slide))
    complete = F.lit(True)
    for c in channels:
        complete = complete & F.col(c).isNotNull()
    gathered = F.collect_list(F.when(complete, points))
    if burst_slots <= 1:
        grouped = df.groupBy(*keys, span).agg(gathered.alias("_points"))
    else:
        slot = F.pmod(F.xxhash64(*order, *channels), F.lit(burst_slots)).alias("_slot")
        slots = df.groupBy(*keys, span, slot).agg(gathered.alias("_points"))
        if on_overflow == "error":
            slots = slots.withColumn("_points", F.slice("_points", 1, steps + 1))
        grouped = slots.groupBy(*keys, "window").agg(
            F.flatten(F.collect_list("_points")).alias("_points")
        )
    in_order = sequences.strip_time(F.array_sort("_points"), len(channels))
    ordered = grouped.withColumn("_found", in_order).drop("_points")
    return _checked(ordered, steps, on_overflow)


def sliding_vectors(
    df: DataFrame, vector: str, channels: Sequence[str] = names.CHANNELS, **options
) -> DataFrame:
    """:func:`sliding_sequences` of ``array<double>`` rows that are led by their time in seconds.

    Rows of one time are ordered by their remaining elements.
    """
    time_col = options.get("time_col", "timestamp")
    kept = [time_col, *options.get("series_keys", ()), *options.get("tie_cols", ())]
    elements = [F.get(vector, F.lit(i + 1)).alias(c) for i, c in enumerate(channels)]
    return sliding_sequences(df.select(*dict.fromkeys(kept), *elements), channels, **options)
