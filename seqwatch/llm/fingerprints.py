"""Document fingerprints by one-permutation MinHash.

Five-word shingles are hashed once. The hash's top bits choose one of ``BINS`` bins, and a bin
keeps its smallest hash. An empty bin borrows from another, the first filled one in an order
of all bins that depends on the bin alone (optimal densification), so that two documents borrow
alike. Only the ``BITS`` lowest bits of each bin are stored, as hexadecimal text; the estimate
of likeness is corrected for bins that agree by chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from seqwatch.llm import kernels, tables

BINS = 256
BITS = 8


def _tries(bins: int) -> np.ndarray:
    """``[t, b]``: the bin that empty bin ``b`` asks at try ``t``; each bin once, so that a filled one is found."""
    codes = np.arange(bins * bins, dtype=np.uint64) + np.uint64(1 << 40)
    return np.argsort(kernels.mix(codes).reshape(bins, bins), axis=0)


def densified(sorted_hashes: np.ndarray, bins: int = BINS, tries: np.ndarray | None = None) -> np.ndarray | None:
    """The hash kept by each bin, every bin filled; None for an empty set. ``bins`` is a power of two."""
    if not len(sorted_hashes):
        return None
    tries = _tries(bins) if tries is None else tries
    bin_of = (sorted_hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], bin_of[1:] != bin_of[:-1]]))
    kept, filled = np.zeros(bins, dtype=np.uint64), np.zeros(bins, dtype=bool)
    kept[bin_of[first]], filled[bin_of[first]] = sorted_hashes[first], True
    source, empty = np.arange(bins), np.flatnonzero(~filled)
    for t in range(len(tries)):
        if not len(empty):
            break
        asked = tries[t, empty]
        found = filled[asked]
        source[empty[found]] = asked[found]
        empty = empty[~found]
    return kept[source]


def packed(kept: np.ndarray | None, bits: int = BITS) -> str:
    """The lowest bits of each bin as hexadecimal text; empty text for an empty set."""
    if kept is None:
        return ""
    low = kernels.mix(kept) & np.uint64((1 << bits) - 1)
    flat = (low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(flat.astype(np.uint8).ravel(), bitorder="little").tobytes().hex()


def unpacked(text: str, bits: int = BITS) -> np.ndarray:
    flat = np.unpackbits(np.frombuffer(bytes.fromhex(text), dtype=np.uint8), bitorder="little")
    return (flat.reshape(-1, bits) << np.arange(bits)).sum(axis=1)


def likeness(a: str, b: str, bits: int = BITS) -> float:
    """Estimated share of common shingles, from 0 to 1; two empty documents are alike."""
    if not a or not b:
        return float(a == b)
    agree = float((unpacked(a, bits) == unpacked(b, bits)).mean())
    chance = 2.0**-bits
    return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


def of_texts(texts: list[str], bins: int = BINS, bits: int = BITS) -> list[str]:
    """Fingerprints of texts, a few MB of them at a time."""
    tries = _tries(bins)
    batch = pa.record_batch([pa.array(texts, pa.large_string())], names=["text"])
    return [
        packed(densified(s, bins, tries), bits)
        for _, _, data, offsets in kernels.blocks(batch)
        for s in kernels.shingle_sets(data, offsets)
    ]


def fingerprint(docs: DataFrame, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """All rows and columns with a ``fingerprint`` (replacing such a column); null text is empty."""
    docs = docs.drop("fingerprint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            prints = pa.array(of_texts(texts, bins, bits), pa.string())
            yield pa.record_batch([*batch.columns, prints], names=[*batch.schema.names, "fingerprint"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("fingerprint", StringType())]))


PAIRED = (
    "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, "
    "near_edited double, near_next double, part long, kind string, text string"
)


def _row(doc_id, text: str, fp: str, next_text: str, next_fp: str, edited_fp: str, part: int) -> tuple:
    edit = edited(text, next_text)
    digest = hashlib.sha256(edit.encode("utf-8", "surrogatepass")).digest()
    return (doc_id, len(text), digest, bytes.fromhex(fp), bytes.fromhex(edited_fp), likeness(fp, edited_fp), likeness(fp, next_fp), part, "done", None)


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    Next is by ascending doc_id (null first, ties by the hash of the text); after the last
    comes the first. Fingerprints and digests are stored as bytes and become text at the end.
    Rows are dealt out by range and sorted, so a text moves once. A task reads
    its rows in order and leaves its first and last row open; these, two per task, are joined
    to their neighbours afterwards. One document alone follows itself. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie_", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie_").sortWithinPartitions("doc_id", "tie_")
    names = [c.split()[0] for c in PAIRED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.string(), pa.string()]
    batch_of = kernels.record_batches(zip(names, kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = None  # (doc_id, text, fingerprint) not yet paired
        for batch in batches:
            for first, end, _, _ in kernels.blocks(batch):
                piece = batch.slice(first, end - first)
                ids, texts = piece.column("doc_id").to_pylist(), piece.column("text").to_pylist()
                prints = of_texts(texts)
                out = []
                if last is None:
                    out.append((ids[0], None, None, bytes.fromhex(prints[0]), None, None, None, part, "first", texts[0]))
                    chain = list(zip(ids, texts, prints))
                else:
                    chain = [last, *zip(ids, texts, prints)]
                edits = of_texts([edited(a[1], b[1]) for a, b in zip(chain, chain[1:])])
                out += [_row(*a, b[1], b[2], e, part) for a, b, e in zip(chain, chain[1:], edits)]
                last = chain[-1]
                yield batch_of(*zip(*out))
        if last is not None:
            yield batch_of(*zip((last[0], None, None, bytes.fromhex(last[2]), None, None, None, part, "last", last[1])))

    made = tables.stored(dealt.select("doc_id", "text").mapInArrow(run, PAIRED), "fingerprints")
    whole = made.filter("kind = 'done'").select(*names[:7]).unionByName(_borders(made).select(*names[:7]))
    return whole.withColumns({c: F.lower(F.hex(c)) for c in names[2:5]})


def _borders(made: DataFrame) -> DataFrame:
    """Rows of the last document of every task, paired with the first one of the next task."""
    part_order = Window.orderBy("part")  # two rows per task
    ends = made.filter("kind != 'done'").groupBy("part").agg(
        *(F.max(F.when(F.col("kind") == k, F.struct("doc_id", "text", "fingerprint"))).alias(k) for k in ("first", "last"))
    )
    order = ends.select("part", F.lead("part").over(part_order).alias("next_part"), F.min("part").over(part_order).alias("least"))
    order = order.select("part", F.coalesce("next_part", "least").alias("next_part"))
    heads = ends.select(F.col("part").alias("next_part"), F.col("first").alias("head"))
    pairs = ends.select("part", "last").join(order, "part").join(heads, "next_part")
    batch_of = kernels.record_batches([(c, t) for c, t in zip(
        ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"),
        (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()),
    )])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                edit = of_texts([edited(r["text"], r["next_text"])])[0]
                row = _row(r["doc_id"], r["text"], r["fp"].hex(), r["next_text"], r["next_fp"].hex(), edit, 0)
                yield batch_of(*([v] for v in row[:7]))

    flat = pairs.select(
        F.col("last.doc_id").alias("doc_id"), F.col("last.text").alias("text"), F.col("last.fingerprint").alias("fp"),
        F.col("head.text").alias("next_text"), F.col("head.fingerprint").alias("next_fp"),
    )
    return flat.mapInArrow(run, ", ".join(PAIRED.split(", ")[:7]))
