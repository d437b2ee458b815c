"""Sliding windows on a stream that keep each point once (STR-2, STR-4, STR-5).

Grouping by ``window(time, ...)`` writes every reading to the state of each window it belongs to,
20 times for 20 s every second. Here a series' windows are dealt to blocks of neighbours, and
the state of a block has its points once; readings near a block's border go to two blocks.
Windows are cut out of the points when a timer at the next window's end expires.

The rule for late data is that of a grouped window, window by window: in a batch with the
watermark W a reading is late for its windows that end at W or before, and counts in all
others. Readings late for some window come out as well, with the number of such windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, IntegralType, LongType, StructField, StructType

from seqwatch import names
from seqwatch.functions import times
from seqwatch.operators.once import add_once

#: Windows of a block, at least; and how many times those that one point is in.
LEAST_BLOCK = 64
BLOCK_OF = 8
#: ``least_block`` for jobs whose windows have few points: a block costs a fixed number of calls to its
#: state. It is part of a query's state, so a stream that is restarted has to keep it.
LONG_BLOCK = 1024
LATEST = np.iinfo(np.int64).max


def _chunk(point: StructType) -> StructType:
    return StructType([StructField(f.name, ArrayType(f.dataType)) for f in point])


class BlockWindows(StatefulProcessor):
    """Points of a block of windows; times are microseconds, window k starts at ``k * slide``.

    The state has a chunk per batch, an array per field: as elements of their own, points cost
    far more to pickle one by one than all else that is done with them.
    """

    def __init__(self, point: StructType, keys: list[str], window: int, slide: int, block: int) -> None:
        self.point, self.keys = point, keys
        self.window, self.slide, self.block = window, slide, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.points = handle.getListState("points", _chunk(self.point))
        self.fired = handle.getValueState("fired", StructType([StructField("watermark", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        some, least = yield from self._fire(key, now)
        ended = (now - self.window) // self.slide  # the last window that has
        for part in rows:
            t = part["t"].to_numpy()
            first, last = (t - self.window) // self.slide + 1, t // self.slide
            missed = np.clip(ended - first + 1, 0, last - first + 1)
            late = (missed > 0) & (first // self.block == key[-1])
            if late.any():
                yield self._late(key, part[late], missed[late])
            open_ = np.minimum(last, (key[-1] + 1) * self.block - 1) > ended
            if open_.any():
                self.points.appendValue(self._columns(part[open_]))
                some, least = True, min(least, int(t[open_].min()))
        self._schedule(now, some, least)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        some, least = yield from self._fire(key, now)
        self._schedule(now, some, least)

    def close(self) -> None:
        pass

    def _columns(self, part: pd.DataFrame) -> tuple[list, ...]:
        return tuple(self._cells(part[f.name], f.dataType) for f in self.point)

    @staticmethod
    def _cells(column: pd.Series, kind: DataType) -> list:
        if isinstance(kind, DoubleType):
            return column.tolist()
        whole = isinstance(kind, IntegralType)  # comes as a float beside a null
        return [None if none else int(x) if whole else x for x, none in zip(column.tolist(), column.isna())]

    def _fire(self, key, now: int):
        """The windows that have ended since the last time. Returns whether points are left for
        later ones and, if they were read, the time of the first."""
        before = self.fired.get()
        if before is None or now <= before[0]:
            return before is not None, LATEST
        chunks = list(self.points.get())
        cells = {name: list(chain.from_iterable(c[i] for c in chunks)) for i, name in enumerate(self.point.names)}
        stored = pd.DataFrame(cells, dtype=object)
        t = stored["t"].to_numpy(dtype=np.int64)
        low, high = key[-1] * self.block, (key[-1] + 1) * self.block - 1
        ended = (now - self.window) // self.slide
        k = np.arange(max(low, (before[0] - self.window) // self.slide + 1), min(high, ended) + 1)
        if len(k):
            yield from self._windows(key, stored.iloc[np.argsort(t, kind="stable")], k)
        needed = (t >= (ended + 1) * self.slide) & (ended < high)
        if not needed.any():
            self.points.clear()
        elif not needed.all():
            self.points.put([tuple(stored.loc[needed, name].tolist() for name in self.point.names)])
        return bool(needed.any()), int(t[needed].min()) if needed.any() else LATEST

    def _windows(self, key, stored: pd.DataFrame, k: np.ndarray) -> Iterator[pd.DataFrame]:
        every = stored["t"].to_numpy(dtype=np.int64)
        starts = k * self.slide
        k = k[np.searchsorted(every, starts + self.window) > np.searchsorted(every, starts)]
        if not len(k):
            return
        whole = stored[stored["whole"].to_numpy(dtype=bool)]
        t = whole["t"].to_numpy(dtype=np.int64)
        low = np.searchsorted(t, k * self.slide)
        size = np.searchsorted(t, k * self.slide + self.window) - low
        cells = {"missed": [0], "k": [k], "low": [low.astype(np.int32)], "size": [size.astype(np.int32)]}
        yield self._frame(key, 1, cells | {f.name: [whole[f.name].tolist()] for f in self.point})

    def _late(self, key, rows: pd.DataFrame, missed: np.ndarray) -> pd.DataFrame:
        values = {f.name: [[x] for x in column] for f, column in zip(self.point, self._columns(rows))}
        none = [None] * len(rows)
        return self._frame(key, len(rows), {"missed": missed, "k": none, "low": none, "size": none} | values)

    def _frame(self, key, rows: int, cells: dict) -> pd.DataFrame:
        return pd.DataFrame({name: [value] * rows for name, value in zip(self.keys, key)} | cells)

    def _schedule(self, now: int, some: bool, least: int) -> None:
        """Remember up to when windows are out, and set a timer at the next one's end. The
        watermark is there if and only if points are."""
        if not some:
            self.fired.clear()
            return
        self.fired.update((now,))
        if least < LATEST:
            k = max((now - self.window) // self.slide + 1, (least - self.window) // self.slide + 1)
            end = -(-(k * self.slide + self.window) // 1000)
            if not any(now < timer * 1000 and timer <= end for timer in self.handle.listTimers()):
                self.handle.registerTimer(end)


def block_rows(
    df: DataFrame,
    channels: Sequence[str] = names.CHANNELS,
    *,
    watermark: timedelta = names.WATERMARK,
    time_col: str = "timestamp",
    tie_cols: Sequence[str] = (),
    series_keys: Sequence[str] = (),
    window: timedelta = names.WINDOW,
    slide: timedelta = names.SLIDE,
    block: int | None = None,
    least_block: int = LEAST_BLOCK,
) -> DataFrame:
    """Ended windows by the block, and late readings: rows for `cut_windows` and `late_readings`."""
    keys = list(series_keys)
    width, step = times.micros(window), times.micros(slide)
    block = block or max(least_block, BLOCK_OF * -(-width // step))
    marked = df.withWatermark(time_col, f"{watermark.total_seconds()} seconds")
    t = F.unix_micros(time_col)
    complete = F.lit(True)
    for c in channels:
        complete = complete & F.col(c).isNotNull()
    first = times.floor_div(times.floor_div(t - width, step) + 1, block)
    last = times.floor_div(times.floor_div(t, step), block)
    points = marked.filter(F.col(time_col).isNotNull()).select(
        *keys,
        t.alias("t"),
        complete.alias("whole"),
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(tie_cols)],
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(channels)],
        F.when(first <= last, F.sequence(first, last)).alias("_blocks"),
    )
    points = points.withColumn("_block", F.explode("_blocks")).drop("_blocks")
    point = StructType([f for f in points.schema if f.name not in (*keys, "_block")])
    point = StructType([StructField(f.name, f.dataType, True) for f in point])
    out = StructType([f for f in points.schema if f.name in keys])
    out = StructType([StructField(f.name, f.dataType, True) for f in out]).add("_block", LongType())
    out = out.add("missed", LongType()).add("k", ArrayType(LongType()))
    out = out.add("low", ArrayType(IntegerType())).add("size", ArrayType(IntegerType()))
    for f in point:
        out = out.add(f.name, ArrayType(f.dataType))
    processor = BlockWindows(point, [*keys, "_block"], width, step, block)
    found = points.groupBy(*keys, "_block").transformWithStateInPandas(processor, out, "Append", "EventTime")
    return found.observe("late", F.sum("missed").alias("missed"), F.count_if(F.col("missed") > 0).alias("rows"))


def cut_windows(
    found: DataFrame,
    channels: Sequence[str] = names.CHANNELS,
    *,
    tie_cols: Sequence[str] = (),
    series_keys: Sequence[str] = (),
    window: timedelta = names.WINDOW,
    slide: timedelta = names.SLIDE,
    steps: int = names.STEPS,
    on_overflow: str = "error",
) -> DataFrame:
    """Rows of `block_rows` to ``window, features``, ordered by time, ties, values."""
    keys = list(series_keys)
    fields = ["t", *(f"o{i}" for i in range(len(tie_cols))), *(f"x{i}" for i in range(len(channels)))]
    in_order = F.array_sort(F.arrays_zip(*fields))
    points = F.transform(in_order, lambda p: F.array(*[p[f"x{i}"] for i in range(len(channels))]))
    ended = add_once(found.filter(F.col("k").isNotNull()), {"_points": points})
    cut = ended.select(*keys, "_points", F.inline(F.arrays_zip("k", "low", "size")))
    begin = F.col("k") * times.micros(slide)
    features = F.slice("_points", F.col("low") + 1, F.col("size"))
    if on_overflow == "error":
        failure = F.raise_error(F.lit(f"a window holds more than {steps} points"))
        features = F.when(F.col("size") <= steps, features).otherwise(failure.cast("array<array<double>>"))
    bounds = F.struct(
        F.timestamp_micros(begin).alias("start"),
        F.timestamp_micros(begin + times.micros(window)).alias("end"),
    )
    return cut.select(*keys, bounds.alias("window"), features.alias("features"))


def late_readings(
    found: DataFrame,
    channels: Sequence[str] = names.CHANNELS,
    *,
    tie_cols: Sequence[str] = (),
    series_keys: Sequence[str] = (),
) -> DataFrame:
    """Rows of `block_rows` to the readings that came late, and how many windows they missed.

    The values are those that the windows would have had, scaled if they are.
    """


    def value(i: int) -> Column:
        # Without all channels, a missing one comes back as NaN.
        x = F.get(f"x{i}", F.lit(0))
        return F.when(F.get("whole", F.lit(0)) | ~F.isnan(x), x)

    return found.filter(F.col("missed") > 0).select(
        *series_keys,
        F.timestamp_micros(F.get("t", F.lit(0))).alias("timestamp"),
        *[F.get(f"o{i}", F.lit(0)).alias(c) for i, c in enumerate(tie_cols)],
        *[value(i).alias(c) for i, c in enumerate(channels)],
        F.col("missed").alias("missed_windows"),
    )


def held_points(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``partition_id, key, point``: the state of a stopped query over `block_rows`."""
    state = spark.read.format("statestore").option("stateVarName", "points").load(checkpoint)
    chunks = state.select("partition_id", "key", "list_element.*")
    fields = [c for c in chunks.columns if c not in ("partition_id", "key")]
    return chunks.select("partition_id", "key", F.explode(F.arrays_zip(*fields)).alias("point"))
