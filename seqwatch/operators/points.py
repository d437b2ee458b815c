"""Archived points: one row per field of a message (RSH-1, RSH-2, FLT-2, FLT-3, PRJ-4)."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timedelta
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from seqwatch import names
from seqwatch.functions import times
from seqwatch.operators.once import add_once


#: 14 digits of milliseconds, 5 of the partition, 19 of the offset.
ARRIVAL = "decimal(38,0)"


#: A number inside a nested field, or a text or boolean, by the names and places that lead to it.
LEAF = StructType(
    [StructField("path", StringType()), StructField("number", DoubleType()), StructField("text", StringType())]
)


_NUMBER = re.compile(r"[-+.0-9eE]+")
_ONLY_NUMBERS = re.compile(r"[-+.0-9eE,\[\]]+")


def _walk(value) -> Iterator[tuple[str, object]]:
    """Path and value of all leaves but null, with a stack, so that the depth is no matter."""
    stack = [("", value)]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            stack.extend((f"{path}_{name}", v) for name, v in value.items())
        elif isinstance(value, list):
            stack.extend((f"{path}_{i}", v) for i, v in enumerate(value))
        elif value is not None:
            yield path, value


@lru_cache(maxsize=256)
def _places(shape: str) -> list[str]:
    """The paths of the numbers of nested arrays, in the order of the text."""
    number = count()
    found = _walk(json.loads(shape, parse_int=lambda _: next(number)))
    return [path for path, _ in sorted(found, key=lambda leaf: leaf[1])]


@F.arrow_udf(ArrayType(LEAF))
def _leaves(nested: pa.Array) -> pa.Array:
    """All leaves of JSON arrays and objects, at any depth; null for null.

    Arrays of nothing but numbers, such as sequences, mostly have the shape of those before, whose paths
    are known. Leaves are given back by the column.
    """
    ends, paths, numbers, texts = [0], [], [], []
    for text in nested.to_pylist():
        if text is None:
            pass
        elif _ONLY_NUMBERS.fullmatch(text):
            paths.extend(_places(_NUMBER.sub("0", text)))
            numbers.extend(map(float, _NUMBER.findall(text)))
            texts.extend([None] * (len(paths) - len(texts)))
        else:
            for path, value in _walk(json.loads(text, parse_int=float)):
                is_number = isinstance(value, float)
                paths.append(path)
                numbers.append(value if is_number else None)
                texts.append(None if is_number else value if isinstance(value, str) else str(value).lower())
        ends.append(len(paths))
    leaf = pa.StructArray.from_arrays(
        [pa.array(paths, pa.string()), pa.array(numbers, pa.float64()), pa.array(texts, pa.string())],
        ["path", "number", "text"],
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), leaf, mask=nested.is_null())


def arrival(
    time_col: str = "timestamp", partition_col: str = "partition", offset_col: str = "offset"
) -> Column:
    """When a record arrived, as one number over all partitions of a topic.

    Offsets say it within a partition only. Milliseconds of the record's time come first, then five
    digits of the partition, then 19 of the offset: a fixed-width decimal, which an aggregate
    hashes. Null if a part is missing, or before 1970.
    """
    millis = F.unix_millis(time_col)
    digits = F.concat(
        F.when(millis >= 0, millis).cast("string"),
        F.lpad(F.col(partition_col).cast("string"), 5, "0"),
        F.lpad(F.col(offset_col).cast("string"), 19, "0"),
    )
    return digits.cast(ARRIVAL)


def unpivot_json(
    records: DataFrame,
    string_fields: Sequence[str] = names.STRING_FIELDS,
    time_key: str = names.TIME_KEY,
    measurement: str = names.MEASUREMENT,
    arrival: Column | None = None,
) -> DataFrame:
    """JSON records to points, whatever fields the messages have.

    Numbers become ``_value`` points, also inside arrays and objects of any depth
    (``features`` gives ``features_0_1``). Text and booleans are kept, in ``_svalue``, only for
    ``string_fields``. Flat fields stay in the JVM; nested ones are opened in Arrow batches. The topic becomes ``key`` and
    ``time_key`` (epoch seconds) the time; a message without a readable time
    or that is not a JSON object has no points. A point arrived at its record's offset,
    or, with several partitions, at the ``arrival`` of a record.
    """
    message = F.try_parse_json(F.col("value").cast("string"))
    opened = add_once(
        records.select(
            "topic",
            (F.col("offset") if arrival is None else arrival).alias("_arrived"),
            message.alias("message"),
        ),
        {"fields": F.try_variant_get("message", "$", "map<string,variant>")},
    )
    time_text = F.try_variant_get(F.try_element_at("fields", F.lit(time_key)), "$", "string")
    rows = opened.select(
        F.col("topic").alias("key"),
        F.col("_arrived").alias("_arrival"),
        times.from_epoch_text(time_text).alias("_time"),
        F.explode("fields").alias("name", "leaf"),
    ).filter(F.col("_time").isNotNull() & (F.col("name") != time_key))
    # As JSON, a field shows its kind: only a number reads as one, only text is quoted.
    shown = add_once(rows, {"json": F.to_json("leaf")})
    is_nested = F.col("json").startswith("{") | F.col("json").startswith("[")
    is_text = F.col("json").startswith('"') | F.col("json").isin("true", "false")
    own = F.struct(
        F.lit("").alias("path"),
        F.col("json").try_cast("double").alias("number"),
        F.when(is_text, F.try_variant_get("leaf", "$", "string")).alias("text"),
    )
    opened = shown.withColumn("inside", _leaves(F.when(is_nested, F.col("json"))))
    leaves = opened.select(
        "key", "_arrival", "_time", "name", F.inline(F.coalesce("inside", F.array(own)))
    ).withColumn("name", F.concat("name", "path"))
    cells = leaves.select(
        "key",
        "_arrival",
        "_time",
        "name",
        F.col("number").alias("_value"),
        F.when(F.col("name").isin(*string_fields), F.col("text")).alias("_svalue"),
    ).filter(F.col("_value").isNotNull() | F.col("_svalue").isNotNull())
    return cells.select(
        F.lit(measurement).alias("measurement"),
        "key",
        "_time",
        F.col("name").alias("_field"),
        "_value",
        "_svalue",
        "_arrival",
    )


def unpivot_columns(
    readings: DataFrame,
    fields: Sequence[str] = names.CHANNELS,
    key: str | Column = names.READINGS_TOPIC,
    time_col: str = "timestamp",
    *,
    arrival_col: str | Column,
    measurement: str = names.MEASUREMENT,
) -> DataFrame:
    """Typed readings to points; the way around JSON when the fields are known."""
    arrived = F.col(arrival_col).cast("bigint") if isinstance(arrival_col, str) else arrival_col
    cells = F.array(
        *[
            F.struct(F.lit(c).alias("_field"), F.col(c).cast("double").alias("_value"))
            for c in fields
        ]
    )
    return (
        readings.select(
            F.lit(measurement).alias("measurement"),
            (F.lit(key) if isinstance(key, str) else key).alias("key"),
            F.col(time_col).alias("_time"),
            arrived.alias("_arrival"),
            F.explode(cells).alias("cell"),
        )
        .filter(F.col("cell._value").isNotNull())
        .select(
            "measurement",
            "key",
            "_time",
            "cell._field",
            "cell._value",
            F.lit(None).cast("string").alias("_svalue"),
            "_arrival",
        )
    )


def tagged(points: DataFrame, key: str, measurement: str = names.MEASUREMENT) -> DataFrame:
    return points.filter((F.col("measurement") == measurement) & (F.col("key") == key))


def time_range(
    df: DataFrame, as_of: datetime, span: timedelta = names.HISTORY, time_col: str = "_time"
) -> DataFrame:
    """Rows of ``[as_of - span, as_of)``. ``as_of`` should carry its zone."""
    return df.filter(
        (F.col(time_col) >= F.lit(as_of - span)) & (F.col(time_col) < F.lit(as_of))
    )


def pivot(
    points: DataFrame, fields: Sequence[str] = names.CHANNELS, row_key: Sequence[str] = ("_time",)
) -> DataFrame:
    """Points to one row per ``row_key`` with a column per field.

    A repeated point counts once, the last to arrive; a missing one is null, and a point
    without an arrival fails. One shuffle: the columns are conditional aggregates, combined
    before it, and ordered by one number so that they are hashed and not sorted.
    """
    missing = F.raise_error(F.lit("a point without an arrival cannot be the last"))
    kind = points.schema["_arrival"].dataType
    arrival = F.when(F.col("_arrival").isNull(), missing.cast(kind)).otherwise(F.col("_arrival"))
    cells = [
        F.max_by("_value", F.when(F.col("_field") == f, arrival)).alias(f) for f in fields
    ]
    return points.filter(F.col("_field").isin(list(fields))).groupBy(*row_key).agg(*cells)
