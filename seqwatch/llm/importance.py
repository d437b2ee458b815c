"""Quality by importance resampling.

Two generative models of hashed words and word pairs are counted: one of target text, one of
the raw corpus. A document's log weight is the sum over its n-grams of the log ratio of the
two. Adding Gumbel noise to the log weights and taking the ``k`` largest draws ``k`` documents
without replacement, in proportion to the weights.

Counting is a sum of ``BUCKETS`` numbers per task. The ``k``-th largest key is found by radix
selection: each pass counts the next ``RADIX`` bits of the keys that are still in question, so
the driver sees at most ``2**RADIX`` counts and nothing is sorted as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqwatch.llm import kernels, tables

BUCKETS = 10_000
SMOOTHING = 0.5
SEED = 42
SHARE = 0.5
RADIX = 12
#: Letters and digits of any script; the rest parts words.
LETTERS = kernels.byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def buckets(data: np.ndarray, offsets: np.ndarray, n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every word and of every pair of neighbouring words."""
    starts, ends, counts = kernels.words(data, offsets, LETTERS)
    hashes = kernels.word_hashes(data, starts, ends)
    docs = np.repeat(np.arange(len(counts)), counts)
    same = docs[1:] == docs[:-1]
    pairs = kernels.mix(hashes[:-1] * np.uint64(3) + hashes[1:])[same]
    all_hashes = np.concatenate([hashes, pairs])
    return np.concatenate([docs, docs[1:][same]]), (all_hashes % np.uint64(n_buckets)).astype(np.int64)


def count(docs: DataFrame, target: Column, n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts per bucket over all rows, and over the rows where ``target`` holds."""
    schema = "bucket long, n_raw long, n_target long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, wanted = np.zeros(n_buckets, dtype=np.int64), np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for start, end, data, offsets in kernels.blocks(batch):
                inside = batch.column("target_").slice(start, end - start).to_numpy(zero_copy_only=False)
                doc, bucket = buckets(data, offsets, n_buckets)
                raw += np.bincount(bucket, minlength=n_buckets)
                wanted += np.bincount(bucket[inside[doc]], minlength=n_buckets)
        yield pa.record_batch([pa.array(np.arange(n_buckets)), pa.array(raw), pa.array(wanted)], names=["bucket", "n_raw", "n_target"])

    marked = docs.select("text", F.coalesce(target, F.lit(False)).alias("target_"))
    sums = marked.mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n_raw").alias("r"), F.sum("n_target").alias("t"))
    raw, wanted = np.zeros(n_buckets), np.zeros(n_buckets)
    for row in sums.collect():  # n_buckets rows
        raw[row.bucket], wanted[row.bucket] = row.r, row.t
    return raw, wanted


#: Bits of the filter that spares unlabelled texts the join; fixed, so 1 MB whatever the corpus.
FILTER_BITS = 1 << 23
WORD = 64


def possible(ids: DataFrame, bits: int = FILTER_BITS) -> Column:
    """Whether ``doc_id`` may be among ``ids``: true for all of them, and by chance for others."""
    at = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(bits))
    place, shift = F.floor(at / WORD).cast("int"), (at % WORD).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), shift)
    some = ids.select(place.alias("place"), mask.alias("w"))
    none = ids.sparkSession.range(bits // WORD).select(F.col("id").cast("int").alias("place"), F.lit(0).cast("long").alias("w"))
    full = some.union(none).groupBy("place").agg(F.bit_or("w").alias("w"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "w")))  # bits // WORD rows
    words = tables.stored(full.agg(F.transform(ordered, lambda x: x["w"]).alias("words")), "target-filter")
    return F.element_at(words.scalar(), place + 1).bitwiseAND(mask) != 0


def marked(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """All rows of ``docs`` with ``target_``: whether their ``doc_id`` is among ``ids``.

    Only texts that pass a filter of ``bits`` bits are joined; the others stay where they are.
    With far more ids than bits all texts are joined. A null id is not among any; repeated
    rows and ids change nothing.
    """
    docs = docs.drop("target_")
    ids = tables.stored(ids.select(F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL").distinct(), "target-ids")
    likely = possible(ids, bits)
    # Never broadcast: the ids grow with the corpus, and their compressed files tell too little of their size.
    found = ids.select(F.col("doc_id").alias("target_id_")).hint("merge")
    joined = docs.filter(likely).join(found, F.col("doc_id").cast("long") == F.col("target_id_"), "left")
    joined = joined.withColumn("target_", F.col("target_id_").isNotNull()).drop("target_id_")
    return joined.unionByName(docs.filter(~likely).withColumn("target_", F.lit(False)))


def log_ratio(raw: np.ndarray, wanted: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Per bucket, log of the target's smoothed probability over the raw corpus's."""
    p = (wanted + smoothing) / (wanted.sum() + smoothing * len(wanted))
    q = (raw + smoothing) / (raw.sum() + smoothing * len(raw))
    return np.log(p / q)


def weigh(docs: DataFrame, ratio: np.ndarray, seed: int = SEED) -> DataFrame:
    """``doc_id, log_weight, gumbel_key`` of every row; null and empty text weigh 0.

    The noise depends on seed, doc_id and text alone, so a repeated row gets the same key.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in kernels.blocks(batch):
                part = batch.slice(start, end - start)
                doc, bucket = buckets(data, offsets, len(shared.value))
                weight = np.bincount(doc, weights=shared.value[bucket], minlength=end - start)
                noise = kernels.mix(part.column("noise_").to_numpy().astype(np.int64).view(np.uint64))
                uniform = ((noise >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
                yield pa.record_batch(
                    [part.column("doc_id"), pa.array(weight), pa.array(weight - np.log(-np.log(uniform)))],
                    names=["doc_id", "log_weight", "gumbel_key"],
                )

    noise = F.xxhash64(F.lit(seed), F.col("doc_id"), tables.text_key())
    rows = docs.select(F.col("doc_id").cast("long"), "text", noise.alias("noise_"))
    return rows.mapInArrow(run, "doc_id long, log_weight double, gumbel_key double")


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the doubles."""
    bits = np.ascontiguousarray(x, dtype=np.float64).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def threshold(keys: DataFrame, column: str, k: int) -> float:
    """The ``k``-th largest value of a column of doubles without nulls, by radix selection.

    With fewer than ``k`` rows the smallest value; minus infinity if ``k`` is over the count.
    """
    prefix, known = 0, 0
    left = k
    while known < 64:
        take = min(RADIX, 64 - known)

        def run(batches: Iterator[pa.RecordBatch], prefix: int = prefix, known: int = known, take: int = take) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(1 << take, dtype=np.int64)
            for batch in batches:
                bits = ordered_bits(batch.column(0).to_numpy(zero_copy_only=False))
                if known:
                    bits = bits[bits >> np.uint64(64 - known) == np.uint64(prefix)]
                digit = (bits >> np.uint64(64 - known - take)) & np.uint64((1 << take) - 1)
                counts += np.bincount(digit.astype(np.int64), minlength=1 << take)
            some = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(some), pa.array(counts[some])], names=["digit", "n"])

        digits = keys.select(column).mapInArrow(run, "digit long, n long").groupBy("digit").agg(F.sum("n").alias("n"))
        found = sorted(digits.collect(), key=lambda r: -r.digit)  # 2**RADIX rows at most
        for row in found:
            if left <= row.n:
                prefix = prefix << take | row.digit
                break
            left -= row.n
        else:
            return -math.inf
        known += take
    bits = np.array([prefix], dtype=np.uint64)
    plain = np.where(bits >> np.uint64(63), bits & np.uint64((1 << 63) - 1), ~bits)
    return float(plain.view(np.float64)[0])


def resample(docs: DataFrame, marked: DataFrame, target: Column, share: float = SHARE, n_buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """``doc_id, log_weight, gumbel_key, selected`` of every row of ``docs``.

    ``marked`` has the same texts, and ``target`` tells which of its rows are target text (null:
    not); both models are counted over all of it. Selected are the rows with the
    ``ceil(share * rows)`` largest keys; rows that tie with the last of them, as repeated rows
    do, are selected too. Without target text all weights follow from smoothing alone. An
    empty table gives no rows; other columns are ignored.
    """
    ratio = log_ratio(*count(marked, target, n_buckets))
    weighed = tables.stored(weigh(docs, ratio, seed), "importance-weights")
    least = threshold(weighed, "gumbel_key", math.ceil(share * weighed.count()))
    return weighed.withColumn("selected", F.col("gumbel_key") >= F.lit(least))
