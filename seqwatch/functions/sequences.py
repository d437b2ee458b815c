"""Expressions over a sequence: an ``array<array<double>>`` of steps x channels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def time_tagged(order_by: Sequence[str], channels: Sequence[str]) -> Column:
    """One point: the ordering columns first, so that structs sort by time.

    All fields are flat, which keeps a point in a shuffle or a state to its bare values.
    """
    return F.struct(
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order_by)],
        *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(channels)],
    )


def strip_time(points: Column, channels: int) -> Column:
    """Points in time order to the bare sequence."""
    return F.transform(points, lambda p: F.array(*[p[f"x{i}"] for i in range(channels)]))


def ordered_sequence(order_by: Sequence[str], channels: Sequence[str]) -> Column:
    """Aggregate: the group's points in time order, without their time.

    Rows with a missing channel are skipped; a group without points gives an
    empty array. Meant for groups of bounded width such as short event-time windows.
    """
    complete = F.lit(True)
    for c in channels:
        complete = complete & F.col(c).isNotNull()
    points = F.collect_list(F.when(complete, time_tagged(order_by, channels)))
    return strip_time(F.array_sort(points), len(channels))


def ordered_vectors(vector: Column) -> Column:
    """Aggregate: ``array<double>`` rows led by their time, sorted, time dropped.

    Rows that share a time are ordered by their remaining elements.
    """
    return F.transform(F.array_sort(F.collect_list(vector)), drop_first)


def drop_first(values: Column) -> Column:
    """All elements but the first."""
    return F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))


def flat(seq: Column) -> Column:
    """Steps x channels to one time-major array."""
    return F.flatten(seq)


def unflat(values: Column, steps: int, channels: int) -> Column:
    """A time-major array back to steps x channels."""
    return F.array(
        *[
            F.array(*[F.get(values, F.lit(t * channels + c)) for c in range(channels)])
            for t in range(steps)
        ]
    )


def as_float32(seq: Column) -> Column:
    """Single-precision copy, as fed to a network."""
    return seq.cast("array<array<float>>")


def shape_text(seq: Column, batched: bool = False) -> Column:
    """The shape as text: ``(20, 2)``, or ``(1, 20, 2)`` for a batch of one."""
    dims = F.concat(
        F.size(seq).cast("string"), F.lit(", "), F.size(seq[0]).cast("string"), F.lit(")")
    )
    return F.concat(F.lit("(1, " if batched else "("), dims)


def channel(seq: Column, index: int) -> Column:
    """One channel's values over the steps."""
    return F.transform(seq, lambda x: x[index])


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def channel_mean(seq: Column, index: int) -> Column:
    """Mean of one channel over the steps; null for an empty sequence."""
    added = F.aggregate(seq, F.lit(0.0), lambda acc, x: acc + x[index])
    return F.try_divide(added, F.size(seq))


def channel_mae(seq: Column, prediction: Column, index: int) -> Column:
    """Mean absolute error of one channel over the steps.

    Rounded to 12 digits, so that an error equal to a threshold stays equal
    whatever the order the two were summed in.
    """
    gaps = F.zip_with(seq, prediction, lambda x, p: F.abs(p[index] - x[index]))
    return F.round(F.try_divide(total(gaps), F.size(seq)), 12)
