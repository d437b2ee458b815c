"""Row-count sequences over sorted series (WIN-1, RSH-3, PAR-1, PAR-2)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqwatch import names
from seqwatch.functions import sequences, times
from seqwatch.operators.once import add_once


#: Sampled rows per bucket; more make the buckets more even.
SAMPLED = 64

#: Keys of fewer equal rows than this are never split.
TIED = 1024


def _tied(df: DataFrame, key_hash: Column, buckets: int) -> tuple[int, list[int]]:
    """The number of rows, and the hashes of the keys that fill a quarter of a bucket or more.

    A frequent-items sketch finds them in one pass over the key columns: it tracks four times
    as many keys as there can be such ones. A key that is named too often costs time, not rows.
    """
    most = 4 * buckets
    found = df.select(key_hash.alias("_h")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(_h, {most}, {4 * most})").alias("top")
    ).first()
    least = max(TIED, found.n / most)
    return found.n, [item["item"] for item in found.top or [] if item["count"] >= least]


def _bounds(df: DataFrame, key: Column, key_hash: Column, buckets: int, every: float) -> Column:
    """The keys between buckets, ascending, in groups of about the root of their number.

    A scalar subquery over the distinct keys of about one row in ``every``, drawn by the hash of
    the key; a row that stands for ``_n`` equal ones is drawn ``_n`` times as often. Which rows
    these are depends on nothing but the rows, so every use sees the same bounds.
    """
    share = F.shiftrightunsigned(key_hash, 11) * 2.0**-53
    drawn = df.filter(share * every < F.col("_n")).select(key.alias("_k")).distinct()
    ordered = F.array_sort(F.collect_list("_k"))
    width = math.isqrt(buckets - 1) + 1
    picked = drawn.agg(ordered.alias("k")).select(
        F.filter(
            F.transform(
                F.sequence(F.lit(1), F.lit(buckets - 1)),
                lambda i: F.get("k", (i * F.size("k") / buckets).cast("int")),
            ),
            lambda b: b.isNotNull(),
        ).alias("k")
    )
    starts = F.filter(
        F.sequence(F.lit(1), F.lit(buckets), F.lit(width)), lambda i: i <= F.size("k")
    )
    return picked.select(F.transform(starts, lambda i: F.slice("k", i, width))).scalar()


def _folded(df: DataFrame, key_hash: Column, tied: list[int], most: int) -> DataFrame:
    """Equal rows of the tied keys as one row for up to ``most`` of them: their number is ``_n``,
    ``_part`` tells rows apart that stand for the same. All other rows stay."""
    is_tied = key_hash.isin(tied)
    equal = df.filter(is_tied).groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_all"))
    parts = equal.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_all") - 1, F.lit(most))))
    parts = parts.withColumn("_n", F.least(F.lit(most), F.col("_all") - F.col("_part"))).drop("_all")
    rest = df.filter(~is_tied).withColumns({"_part": F.lit(0).cast("long"), "_n": F.lit(1).cast("long")})
    return rest.unionByName(parts)


def dealt(df: DataFrame, order_by: Sequence[str], buckets: int) -> tuple[DataFrame, list[str]]:
    """``df`` with ``_bucket``, ascending in the total order, and the columns of that order.

    Rows are dealt by bounds taken from the rows themselves, which balances the buckets whatever
    the values are. Keys with more rows than a bucket should have are split by the other columns
    too, and rows that are equal in these as well are folded to one row for ``_n`` of them. Tables
    with map or variant columns are split, but not folded.
    """
    unordered = ("map", "variant")
    ties = [f.name for f in df.schema if f.name not in order_by and f.dataType.typeName() not in unordered]
    order = [*order_by, *ties]
    if buckets == 1:
        return df.withColumns({"_bucket": F.lit(0), "_n": F.lit(1).cast("long")}), order
    key_hash = F.xxhash64(*order_by)
    n, tied = _tied(df, key_hash, buckets)
    every = n / (SAMPLED * buckets)
    weighted, split_by = df.withColumn("_n", F.lit(1).cast("long")), list(order_by)
    if tied:
        split_by = order
        if len(order) == len(df.columns):
            weighted = _folded(df, key_hash, tied, max(1, int(every)))
            order = split_by = [*order, "_part"]
    key = F.struct(*split_by)
    groups = F.col("_groups")
    group = F.size(F.filter(groups, lambda g: g[0] <= key))
    inside = F.size(F.filter(F.get(groups, group - 1), lambda b: b <= key))
    width = math.isqrt(buckets - 1) + 1
    bucket = F.when(group > 0, (group - 1) * width + inside).otherwise(0)
    bounds = _bounds(weighted, key, F.xxhash64(*split_by), buckets, every)
    placed = add_once(weighted.withColumn("_groups", bounds), {"_bucket": bucket})
    return placed.drop("_groups"), order


def row_index(
    df: DataFrame, order_by: Sequence[str], name: str = "row_index", buckets: int | None = None
) -> DataFrame:
    """Number all rows from 0 in the total order ``order_by``, without a single-task sort.

    Rows are :func:`dealt` to buckets, and a bucket is numbered from the count of rows before
    it. Nothing is pinned or written: bounds, counts and numbers come out the same if a task is
    run again elsewhere. Rows equal in ``order_by`` are numbered by their other columns, however
    many they are. One pass over the columns of ``order_by`` runs at once, to find keys that hold
    more rows than a bucket should. In rows of such keys -0.0 may become 0.0.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed, order = dealt(df, order_by, buckets)
    preceding = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per bucket, which bounds both the window and the broadcast.
    offsets = (
        placed.groupBy("_bucket")
        .agg(F.sum("_n").alias("_size"))
        .select("_bucket", F.coalesce(F.sum("_size").over(preceding), F.lit(0)).alias("_offset"))
    )
    sorted_rows = Window.partitionBy("_bucket").orderBy(*order)
    folded = "_part" in placed.columns
    if folded:
        # Folded rows are few, but not those they stand for: buckets must not be coalesced by size.
        placed = placed.repartitionById(buckets, F.col("_bucket"))
    place = F.sum("_n").over(sorted_rows.rowsBetween(Window.unboundedPreceding, 0)) if folded else F.row_number().over(sorted_rows)
    numbered = placed.withColumn("_place", place).join(F.broadcast(offsets), "_bucket")
    last = F.col("_offset") + F.col("_place") - 1
    if folded:
        # Rows of one part are in one bucket; a part is a small share of it.
        last = F.explode(F.sequence(last - F.col("_n") + 1, last))
    return numbered.select(*df.columns, last.alias(name))


def row_sequences(
    df: DataFrame,
    channels: Sequence[str] = names.CHANNELS,
    *,
    order_by: Sequence[str] = ("timestamp",),
    series_keys: Sequence[str] = (),
    carry: Sequence[str] = (),
    steps: int = names.STEPS,
    chunk_rows: int = 4096,
    flat: bool = True,
) -> DataFrame:
    """Each row with its ``steps - 1`` followers as one flat, time-major ``features``,
    or as steps x channels with ``flat=False``.

    A series of N rows gives N - steps + 1 sequences. Rows are numbered across
    all series, cut into chunks of equal size, and a chunk also gets the first
    rows of the next, so neither one long series nor one hot key ends in one task.
    ``carry`` columns are taken from a sequence's first row.
    """
    keys = list(series_keys)
    if chunk_rows < steps:
        raise ValueError("a chunk must hold at least one sequence")
    kept = list(dict.fromkeys([*keys, *order_by, *carry]))
    point = F.array(*[F.col(c).cast("double") for c in channels]).alias("_point")
    indexed = row_index(df.select(*kept, point), [*keys, *order_by], "_i")

    chunk = times.floor_div(F.col("_i"), chunk_rows)
    in_head = (chunk > 0) & (F.pmod("_i", F.lit(chunk_rows)) < steps - 1)
    homes = F.when(in_head, F.array(chunk, chunk - 1)).otherwise(F.array(chunk))
    chunked = indexed.withColumn("_chunk", F.explode(homes))
    ahead = (
        Window.partitionBy("_chunk", *keys)
        .orderBy("_i")
        .rowsBetween(Window.currentRow, steps - 1)
    )
    # A copied row never starts a full sequence: its chunk ends too soon.
    framed = chunked.select(
        *kept, F.collect_list("_point").over(ahead).alias("_ahead")
    ).filter(F.size("_ahead") == steps)
    features = F.col("_ahead")
    if flat:
        features = sequences.flat(features)
    return add_once(framed, {"features": features}).drop("_ahead")


def as_training_pairs(
    sequence_rows: DataFrame,
    partitions: int | None = None,
    carry: Sequence[str] = (),
    tasks: int = 1,
) -> DataFrame:
    """``features`` and identical ``labels``, spread evenly over ``partitions`` trainers.

    A trainer's share is read by ``tasks`` tasks: trainer i has the partitions i,
    i + ``partitions``, and so on. Labels are added after the shuffle.
    """
    kept = sequence_rows.select(*carry, "features")
    if partitions:
        kept = kept.repartition(partitions * tasks)
    return kept.select("*", F.col("features").alias("labels"))
