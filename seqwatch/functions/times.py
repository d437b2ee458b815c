"""Time expressions that do not depend on the session time zone, except
``text_key``, which is the session's text form by definition."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, functions as F


def micros(duration: timedelta) -> int:
    return duration // timedelta(microseconds=1)


def interval_text(duration: timedelta) -> str:
    """A duration as Spark's streaming functions take it."""
    return f"{micros(duration)} microseconds"


def epoch_text(ts: Column) -> Column:
    """Whole epoch seconds as text."""
    return F.unix_timestamp(ts).cast("string")


def from_epoch_text(text: Column) -> Column:
    """Epoch seconds as text, fractions allowed, to a timestamp; null if unreadable."""
    return F.timestamp_seconds(text.try_cast("decimal(20,6)"))


def naive_to_timestamp(ts: Column) -> Column:
    """A zoneless timestamp read as UTC."""
    since_epoch = F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)
    return F.timestamp_micros(since_epoch)


def text_key(ts: Column) -> Column:
    return ts.cast("string")


def floor_div(n: Column, by: int) -> Column:
    """Integer division rounded down, also for negative ``n``."""
    by = F.lit(by).cast("bigint")
    return F.call_function("div", n - F.pmod(n, by), by)
