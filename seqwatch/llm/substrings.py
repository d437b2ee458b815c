"""Exact duplicate substrings by a depth-limited radix sort of suffixes.

A window is a string of ``THRESHOLD`` bytes inside one document. Suffixes are ordered only as
far as that depth, most significant digit first, and groups of equal suffixes at full depth are
exactly the repeated windows. Two things keep the passes small.

Sampling. Each window has one anchor: the first of its ``STEPS`` runs of ``DIGIT`` bytes with
the smallest hash. Equal windows have their anchors at the same place, so only suffixes at
anchors (about two in ``STEPS + 1``) enter the sort, each for all windows it anchors; the
distance from a window's start to its anchor is at most ``STEPS - 1``.

Passes. A unit of a pass is an anchor with a range of distances. Its digit is the string that
all windows of the range share (the core), its span the string that they cover together.

1. Range of all ``STEPS`` distances: units alone with their digit drop out. Units equal in
   their span are repeated as a whole. Only where a digit occurs with different spans does one
   unit of each span go on.
2. Ranges of ``RANGE`` distances, the same way.
3. Single distances: core and span are the window itself, and equal units are repeated.

Units that go on carry their surroundings of less than ``2 * THRESHOLD`` bytes, so the passes
after the first read no documents. Strings are compared by 64-bit hashes of digit and span,
from independent tables. Groups are only counted, never gathered: a group of a third of all
rows is a sum per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seqwatch.llm import kernels, tables

THRESHOLD = 400
STEPS = 256
RANGE = 16
DIGIT = THRESHOLD - STEPS + 1
CHUNK = 1 << 20
ROWS_AT_ONCE = 1024

FIRST = kernels.byte_table(11)
SECOND = kernels.byte_table(12)
SECOND_BASE = 0xD1342543DE82EF95
U = np.uint64


def sliding_first_min(values: np.ndarray, width: int) -> np.ndarray:
    """For every full window of ``width`` values, the place of the first smallest one.

    Blockwise running minima from both sides, on keys that hold the place in their low bits.
    """
    n = len(values)
    low = U((1 << 22) - 1)
    keys = (values & ~low) | np.arange(n, dtype=U)
    padded = np.full(-(-n // width) * width, ~U(0), dtype=U)
    padded[:n] = keys
    blocks = padded.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(backward[: n - width + 1], forward[width - 1 : n])
    return (best & low).astype(np.int64)


def span_key(p: np.ndarray, start: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hash of the bytes from start to end after clipping to the document, and of what was clipped."""
    s, e = np.maximum(start, low), np.minimum(end, high)
    value = (p[e] - p[s]) * kernels.powers(len(p), SECOND_BASE)[1][s]
    return kernels.mix(value + kernels.mix(((s - start) * 65_536 + (end - e)).astype(U)))


def anchors_of(text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(position, digit, span) of the anchors of one document, ``CHUNK`` windows at a time."""
    n = len(text)
    done = -1
    for first in range(0, n - THRESHOLD + 1, CHUNK):
        windows = min(CHUNK, n - THRESHOLD + 1 - first)
        before = min(first, STEPS)
        part = text[first - before : first + windows + THRESHOLD + STEPS]
        p = kernels.prefix_hash(part, FIRST)
        runs = windows + STEPS - 1
        inner = p[before:]
        power = kernels.powers(len(part))[1]
        hashes = kernels.mix((inner[DIGIT : DIGIT + runs] - inner[:runs]) * power[before : before + runs])
        place = np.unique(sliding_first_min(hashes, STEPS))
        place = place[place + first > done]
        if not len(place):
            continue
        done = first + int(place[-1])
        q = kernels.prefix_hash(part, SECOND, SECOND_BASE)
        at = place + before
        low, high = np.full(len(at), 0), np.full(len(at), len(part))
        yield place + first, hashes[place], span_key(q, at - STEPS + 1, at + THRESHOLD, low, high)


ANCHORS = "digit long, span long, doc_id long, key_ long, at long"


def anchors(docs: DataFrame) -> DataFrame:
    """All anchors: digit and span hashes, document and byte position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in kernels.blocks(batch):
                ids, keys = batch.column("doc_id").slice(start, end - start), batch.column("key_").slice(start, end - start)
                found = []
                for i in range(end - start):
                    text = data[offsets[i] : offsets[i + 1]]
                    if len(text) >= THRESHOLD:
                        found += [(i, *x) for x in anchors_of(text)]
                if found:
                    row = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                    at, digit, span = (np.concatenate([f[j] for f in found]) for j in (1, 2, 3))
                    yield pa.record_batch(
                        [pa.array(digit.view(np.int64)), pa.array(span.view(np.int64)), ids.take(pa.array(row)), keys.take(pa.array(row)), pa.array(at)],
                        names=["digit", "span", "doc_id", "key_", "at"],
                    )

    return docs.mapInArrow(run, ANCHORS)


PLACE = ("doc_id", "key_", "at")


def refined(units: DataFrame, label: str, *keys: str) -> DataFrame:
    """The units whose digit occurs more than once. ``several``: the digit has different spans;
    ``alike``: another unit has the same span."""
    group = [*keys, "digit"]
    digits = units.groupBy(*group).agg(F.count("*").alias("n"), F.min("span").alias("low_"), F.max("span").alias("high_"))
    digits = digits.filter("n > 1").select(*group, (F.col("low_") != F.col("high_")).alias("several"))
    # Stored, so that the join has nothing but two shuffles below it: a digit that is in a third
    # of all units is then split by the planner.
    some = tables.stored(units.join(tables.stored(digits, f"{label}-often"), group), label)
    mixed = some.filter("several")
    spans = mixed.groupBy(*group, "span").count().filter("count > 1").select(*group, "span", F.lit(True).alias("alike"))
    spans = tables.stored(spans, f"{label}-alike")
    mixed = mixed.join(spans, [*group, "span"], "left").withColumn("alike", F.coalesce("alike", F.lit(False)))
    return some.filter("NOT several").withColumn("alike", F.lit(True)).unionByName(mixed)


def one_of_each(units: DataFrame, *keys: str) -> DataFrame:
    """One unit of each span where a digit has several; the others of that span are repeated as a whole."""
    open_ = units.filter("several")
    copies = open_.filter("alike").groupBy(*keys, "digit", "span").agg(F.min(F.struct(*PLACE)).alias("one"))
    return open_.filter("NOT alike").select(*PLACE, *keys).unionByName(copies.select("one.*", *keys))


def surroundings(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``doc_id, key_, at, before, around``: the bytes near anchors, from a join with their documents."""
    wanted = places.groupBy("doc_id", "key_").agg(F.collect_list("at").alias("ats"))  # within one document
    wanted = wanted.withColumnsRenamed({"doc_id": "id_", "key_": "k_"})
    joined = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key_") == F.col("k_")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in kernels.blocks(batch):
                rows, ats, before, around = [], [], [], []
                for i, wanted in enumerate(batch.column("ats").slice(start, end - start).to_pylist()):
                    text = data[offsets[i] : offsets[i + 1]]
                    for at in wanted:
                        first = max(0, at - STEPS + 1)
                        rows.append(i)
                        ats.append(at)
                        before.append(at - first)
                        around.append(text[first : at + THRESHOLD].tobytes())
                take = pa.array(rows, pa.int64())
                ids, keys = (batch.column(c).slice(start, end - start).take(take) for c in ("doc_id", "key_"))
                yield pa.record_batch(
                    [ids, keys, pa.array(ats, pa.int64()), pa.array(before, pa.int64()), pa.array(around, pa.binary())],
                    names=["doc_id", "key_", "at", "before", "around"],
                )

    # A row that is there twice gives its surroundings twice; all its windows are repeated anyway.
    return joined.select("doc_id", "key_", "text", "ats").mapInArrow(run, "doc_id long, key_ long, at long, before long, around binary")


def ranges(near: DataFrame, width: int) -> DataFrame:
    """Units of ``width`` distances: ``low`` is the least distance, digit and span as in the passes.

    With a column ``lows`` only the distances from each of its elements on, over ``RANGE``, else
    all ``STEPS`` distances.
    """
    limited = "lows" in near.columns

    def units(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("around")
        data = np.frombuffer(b"".join(x.as_buffer() for x in texts), dtype=np.uint8)
        edges = np.concatenate([[0], np.cumsum([len(x.as_buffer()) for x in texts])])
        if limited:
            lists = batch.column("lows")
            of = np.repeat(np.arange(len(texts)), lists.value_lengths().to_numpy(zero_copy_only=False))
            base, each = lists.flatten().to_numpy(zero_copy_only=False), np.arange(0, RANGE, width)
        else:
            of, base, each = np.arange(len(texts)), np.zeros(len(texts), dtype=np.int64), np.arange(0, STEPS, width)
        row, low = np.repeat(of, len(each)), (base[:, None] + each).ravel()
        start = (edges[:-1] + batch.column("before").to_numpy())[row] - low
        end = start + THRESHOLD - width + 1
        inside = (start >= edges[row]) & (end <= edges[row + 1])
        row, low, start, end = row[inside], low[inside], start[inside], end[inside]
        p, q = kernels.prefix_hash(data, FIRST), kernels.prefix_hash(data, SECOND, SECOND_BASE)
        digit = kernels.mix((p[end] - p[start]) * kernels.powers(len(p))[1][start])
        span = span_key(q, start - width + 1, end + width - 1, edges[row], edges[row + 1])
        places = (batch.column(c).take(pa.array(row)) for c in PLACE)
        return pa.record_batch(
            [pa.array(digit.view(np.int64)), pa.array(span.view(np.int64)), *places, pa.array(low)],
            names=["digit", "span", *PLACE, "low"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                yield units(batch.slice(start, ROWS_AT_ONCE))

    return near.mapInArrow(run, ANCHORS + ", low long")


def repeated(docs: DataFrame) -> DataFrame:
    """``doc_id, key_, at, low, width``: windows that start ``low`` to ``low + width - 1`` bytes before ``at`` repeat.

    Ranges may run over a document's ends; windows outside it are not meant.
    """
    def equal(units: DataFrame, width: int) -> DataFrame:
        low = F.col("low") if "low" in units.columns else F.lit(0).cast("long").alias("low")
        return units.select(*PLACE, low, F.lit(width).cast("long").alias("width"))

    suffixes = tables.stored(anchors(docs), "anchors")
    first = tables.stored(refined(suffixes, "digit-1"), "pass-1")
    near = tables.stored(surroundings(docs, one_of_each(first)), "surroundings")
    second = tables.stored(refined(ranges(near, RANGE), "digit-2", "low"), "pass-2")
    lows = one_of_each(second, "low").groupBy(*PLACE).agg(F.collect_list("low").alias("lows"))
    lows = lows.withColumnsRenamed({"doc_id": "id_", "key_": "k_", "at": "at_"})
    same = F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key_") == F.col("k_")) & (F.col("at") == F.col("at_"))
    single = ranges(near.join(lows, same).drop("id_", "k_", "at_"), 1)
    window = ["digit", "span", "low"]  # both hashes of the window, and where its anchor is
    again = tables.stored(single.groupBy(*window).count().filter("count > 1").select(*window), "digit-3-often")
    third = single.join(again, window, "left_semi")
    return equal(first.filter("alike"), STEPS).unionByName(equal(second.filter("alike"), RANGE)).unionByName(equal(third, 1))


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def covered(n: int, at: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal byte runs covered by repeated windows, from ranges of window starts."""
    first, last = np.maximum(0, at - low - width + 1), np.minimum(at - low, n - THRESHOLD)
    inside = first <= last
    order = np.argsort(first[inside], kind="stable")
    start, end = first[inside][order], last[inside][order] + THRESHOLD
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], reach[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]


def remove(docs: DataFrame) -> DataFrame:
    """Documents without repeated substrings: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept``.

    Every byte covered by a string of ``THRESHOLD`` bytes that also starts anywhere else goes,
    judged on the input. One row per input row; equal rows are each other's copies. Null text
    is empty; other columns are ignored. ``kept`` are the bytes left.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), tables.text_key().alias("key_"))
    found = repeated(rows).groupBy("doc_id", "key_").agg(F.collect_list(F.struct("at", "low", "width")).alias("ranges"))
    # Stored, so that the passes' shuffle files are gone before the texts move.
    found = tables.stored(found, "ranges").withColumnsRenamed({"doc_id": "id_", "key_": "k_"})
    joined = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("key_") == F.col("k_")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = kernels.record_batches(
            [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
        )
        for batch in batches:
            for start, end, data, offsets in kernels.blocks(batch):
                part = batch.slice(start, end - start)
                lists, out = part.column("ranges"), []
                bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                flat = lists.flatten()
                at, low, width = (flat.field(j).to_numpy(zero_copy_only=False) for j in range(3))
                for i in range(end - start):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    own = slice(bounds[i], bounds[i + 1])
                    runs = covered(len(text), at[own], low[own], width[own])
                    edges = [0, *np.column_stack(runs).ravel().tolist(), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    out.append((len(text), len(text) - len(kept), len(runs[0]), hashlib.sha256(kept).hexdigest(), kept))
                yield batch_of(part.column("doc_id"), *zip(*out))

    return joined.select("doc_id", "text", "ranges").mapInArrow(run, REMOVED)
