"""Benchmark decontamination by a distributed positional inverted index.

The index is a table with one row per segment, a run of documents of about ``SEGMENT_BYTES``.
It holds the segment's terms (64-bit word hashes, sorted), how often each occurs, and the
sorted word positions of each: the postings of every training token. Searching needs no
shuffle of postings. The corpus-wide count of each test term is summed first; then every
segment starts from the rarest term of each window, shifts its positions by the term's place
in the window, and intersects them with the next rarest term's until a list is empty or all
terms agree.

Windows of the tests are made in tasks and grouped to distinct ones. They are searched in blocks of
at most ``BLOCK_WINDOWS``, by exact counts, which bounds what the driver holds and a task is sent; the
index is read twice per block, for counts and for the search. Windows with the same items share
an owner set, known by a hash of the items; occurrences name owner sets, and a join gives the items.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from seqwatch.llm import kernels, tables
from seqwatch.session import scratch_path

WINDOW = 13
SEGMENT_BYTES = 8 << 20
BLOCK_WINDOWS = 200_000
EMITTED = 1 << 14
SALTS = 16

#: Digits, letters and everything beyond ASCII.
LETTERS = kernels.byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LETTERS[0x41:0x5B] = True  # A-Z count as a-z

INDEX = (
    "segment long, doc_ids binary, has_id binary, text_keys binary, first_words binary, "
    "terms binary, counts binary, positions binary"
)


def index(docs: DataFrame) -> DataFrame:
    """The stored index of ``doc_id, text`` rows. Null text has no words; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        for batch in batches:
            for start, end, data, offsets in kernels.blocks(batch, limit=SEGMENT_BYTES):
                part = batch.slice(start, end - start)
                starts, ends, counts = kernels.words(data, offsets, LETTERS)
                hashes = kernels.word_hashes(data, starts, ends)
                order = np.argsort(hashes, kind="stable")
                ordered = hashes[order]
                edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else order
                row = (
                    part.column("doc_id").fill_null(0).to_numpy(),
                    part.column("doc_id").is_valid().to_numpy(zero_copy_only=False),
                    part.column("key_").to_numpy(),
                    np.concatenate([[0], np.cumsum(counts)]).astype("<u4"),
                    ordered[edge],
                    np.diff(np.concatenate([edge, [len(order)]])).astype("<u4"),
                    order.astype("<u4"),
                )
                yield pa.record_batch(
                    [pa.array([made]), *(pa.array([x.tobytes()], pa.binary()) for x in row)],
                    names=[c.split()[0] for c in INDEX.split(", ")],
                )
                made += 1

    rows = docs.select(F.col("doc_id").cast("long"), "text", tables.text_key().alias("key_"))
    return tables.stored(rows.mapInArrow(run, INDEX), "postings")


@dataclass(frozen=True)
class Windows:
    """Distinct test windows: rows of term numbers (-1 beyond the length), and their owner sets."""

    terms: np.ndarray  # distinct term hashes, sorted
    rows: np.ndarray  # [window, place] -> term number
    lengths: np.ndarray
    owners: np.ndarray  # window -> number of its owner set
    names: list[str]  # owner sets

    def __len__(self) -> int:
        return len(self.lengths)


def _binaries(rows: np.ndarray) -> pa.Array:
    """Rows of term hashes as binary values."""
    n, width = rows.shape
    offsets = np.arange(n + 1, dtype=np.int32) * (8 * width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])


def windows_of(texts: pa.Array, items: np.ndarray, size: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """``window, item`` of all runs of ``size`` words of each text, some thousands at a time; a shorter
    text, but not an empty one, is one window. A window is the hashes of its words."""
    batch = pa.record_batch([texts], names=["text"])
    for first, _, data, offsets in kernels.blocks(batch):
        starts, ends, counts = kernels.words(data, offsets, LETTERS)
        hashes = kernels.word_hashes(data, starts, ends)
        item = np.repeat(items[first : first + len(counts)], counts)
        text = np.repeat(np.arange(len(counts)), counts)
        whole = np.flatnonzero(text[: max(0, len(text) - size + 1)] == text[size - 1 :])
        for at in range(0, len(whole), EMITTED):
            some = whole[at : at + EMITTED]
            yield pa.record_batch([_binaries(hashes[some[:, None] + np.arange(size)]), pa.array(item[some])], names=["window", "item"])
        bounds = np.concatenate([[0], np.cumsum(counts)])
        short = np.flatnonzero((counts > 0) & (counts < size))
        if len(short):
            own = [hashes[bounds[i] : bounds[i + 1]].tobytes() for i in short]
            yield pa.record_batch([pa.array(own, pa.binary()), pa.array(item[bounds[short]])], names=["window", "item"])


def window_table(windows: list[bytes], owners: list[str], size: int = WINDOW) -> Windows:
    """One block of windows for the search."""
    lengths = np.array([len(k) // 8 for k in windows], dtype=np.int64)
    terms, number = np.unique(np.frombuffer(b"".join(windows), dtype=np.uint64), return_inverse=True)
    rows = np.full((len(windows), size), -1)
    rows[np.arange(size) < lengths[:, None]] = number
    names, owner = np.unique(np.array(owners, dtype=object), return_inverse=True)
    return Windows(terms, rows, lengths, owner, names.tolist())


def test_windows(tests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored ``window, owners`` of the distinct windows of ``item_id, text`` rows, and ``owners, item``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from windows_of(batch.column("text"), batch.column("item").to_numpy())

    rows = tests.select(F.col("item_id").cast("long").alias("item"), "text").filter("item IS NOT NULL")
    pairs = tables.stored(rows.mapInArrow(run, "window binary, item long").distinct(), "test-windows")
    # The items of a window are told apart by the exclusive or of two hashes of each, and their number.
    owners = F.concat_ws(
        ":", F.bit_xor(F.xxhash64("item")), F.bit_xor(F.xxhash64("item", F.lit(1))), F.count("item")
    )
    windows = tables.stored(pairs.groupBy("window").agg(owners.alias("owners")), "owned-windows")
    one_of_each = windows.groupBy("owners").agg(F.min("window").alias("window"))
    return windows, tables.stored(one_of_each.join(pairs, "window").select("owners", "item"), "owners")


def _lookup(terms: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted term in a segment's sorted terms, or -1."""
    at = np.searchsorted(terms, wanted)
    at[at == len(terms)] = 0
    return np.where(terms[at] == wanted, at, -1) if len(terms) else np.full(len(wanted), -1)


def frequencies(stored: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How often each of the wanted terms occurs in the whole corpus."""
    shared = stored.sparkSession.sparkContext.broadcast(wanted)  # terms of one block of test texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), dtype=np.int64)
        for batch in batches:
            for terms, counts in zip(batch.column("terms"), batch.column("counts")):
                terms, counts = np.frombuffer(terms.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), "<u4")
                at = _lookup(terms, shared.value)
                total[at >= 0] += counts[at[at >= 0]]
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["term", "n"])

    sums = stored.select("terms", "counts").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(wanted), dtype=np.int64)
    for row in sums.collect():  # as many rows as wanted terms at most
        out[row.term] = row.n
    shared.destroy()
    return out


def occurrences(positions, first_words: np.ndarray, at: np.ndarray, found: Windows, orders: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(window, start positions) of the windows that occur in a segment."""
    rows = found.rows
    present = np.where(rows >= 0, at[rows] >= 0, True).all(axis=1)
    for w in np.flatnonzero(present):
        length, starts = found.lengths[w], None
        for place in orders[w][:length]:
            shifted = positions(at[rows[w, place]]) - place
            if starts is None:
                starts = shifted
            else:
                hit = np.searchsorted(shifted, starts)
                hit[hit == len(shifted)] = 0
                starts = starts[shifted[hit] == starts]
            if not len(starts):
                break
        if len(starts):
            starts = starts[starts >= 0]
            doc = np.searchsorted(first_words, starts, "right")
            starts = starts[starts + length <= first_words[np.minimum(doc, len(first_words) - 1)]]
            if len(starts):
                yield int(w), starts


def _segments(batches: Iterator[pa.RecordBatch]):
    """Per segment: id, terms, a function from a term's place to its positions, first words."""
    for batch in batches:
        for i in range(batch.num_rows):
            terms, counts, flat, first = (
                np.frombuffer(batch.column(c)[i].as_buffer(), t)
                for c, t in (("terms", np.uint64), ("counts", "<u4"), ("positions", "<u4"), ("first_words", "<u4"))
            )
            bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

            def positions(place: int, flat=flat, bounds=bounds) -> np.ndarray:
                return flat[bounds[place] : bounds[place + 1]].astype(np.int64)

            yield batch.column("segment")[i].as_py(), terms, positions, first.astype(np.int64)


SEARCHED = ("segment", "terms", "counts", "positions", "first_words")


HITS = "segment long, doc long, starts array<long>, ends array<long>, owners array<string>"


def search(stored: DataFrame, found: Windows) -> DataFrame:
    """``segment, doc, starts, ends, owners``: per document with occurring windows, the word runs
    that they cover and their owner sets."""
    counts = frequencies(stored, found.terms)
    rarity = np.where(found.rows >= 0, counts[found.rows], np.iinfo(np.int64).max)
    orders = np.argsort(rarity, axis=1, kind="stable")
    shared = stored.sparkSession.sparkContext.broadcast((found, orders))  # one block of test texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, orders = shared.value
        for segment, terms, positions, first_words in _segments(batches):
            runs: dict[int, list[tuple[int, int]]] = {}
            owners: dict[int, set[int]] = {}
            at = _lookup(terms, found.terms)
            for w, starts in occurrences(positions, first_words, at, found, orders):
                docs = np.searchsorted(first_words, starts, "right") - 1
                length, owner = int(found.lengths[w]), int(found.owners[w])
                for doc, start in zip(docs.tolist(), starts.tolist()):
                    runs.setdefault(doc, []).append((start, start + length))
                    owners.setdefault(doc, set()).add(owner)
            if runs:
                merged = [_merged(x) for x in runs.values()]
                yield pa.record_batch(
                    [
                        pa.array([segment] * len(runs)), pa.array(list(runs)),
                        pa.array([[a for a, _ in r] for r in merged]), pa.array([[b for _, b in r] for r in merged]),
                        pa.array([[found.names[o] for o in sorted(owners[d])] for d in runs]),
                    ],
                    names=["segment", "doc", "starts", "ends", "owners"],
                )

    return stored.select(*SEARCHED).mapInArrow(run, HITS)


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def documents(stored: DataFrame) -> DataFrame:
    """``segment, doc, doc_id, key_, n_words`` of every indexed row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, valid, keys, first = (
                    np.frombuffer(batch.column(c)[i].as_buffer(), t)
                    for c, t in (("doc_ids", "<i8"), ("has_id", bool), ("text_keys", "<i8"), ("first_words", "<u4"))
                )
                segment = np.full(len(ids), batch.column("segment")[i].as_py())
                columns = [segment, np.arange(len(ids)), pa.array(ids, mask=~valid), keys, np.diff(first.astype(np.int64))]
                yield pa.record_batch([pa.array(c) for c in columns], names=["segment", "doc", "doc_id", "key_", "n_words"])

    rows = stored.select("segment", "doc_ids", "has_id", "text_keys", "first_words")
    return rows.mapInArrow(run, "segment long, doc long, doc_id long, key_ long, n_words long")


def near(stored: DataFrame, words: list[str], within: int) -> DataFrame:
    """Proximity matches: ``segment, doc, position`` where each of the words is at most ``within``
    words away from the rarest of them, at ``position``, in the same document. No words match nothing."""
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    starts, ends, _ = kernels.words(data, np.array([0, len(data)]), LETTERS)
    terms = np.unique(kernels.word_hashes(data, starts, ends))
    counts = frequencies(stored, terms)
    order = np.argsort(counts, kind="stable")
    shared = stored.sparkSession.sparkContext.broadcast((terms, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, order = shared.value
        for segment, terms, positions, first_words in _segments(batches):
            at = _lookup(terms, wanted)
            if not len(wanted) or (at < 0).any():
                continue
            start = positions(at[order[0]])
            doc = np.searchsorted(first_words, start, "right") - 1
            for term in order[1:]:
                other = positions(at[term])
                low = np.maximum(start - within, first_words[doc])
                high = np.minimum(start + within + 1, first_words[doc + 1])
                has = np.searchsorted(other, high) > np.searchsorted(other, low)
                start, doc = start[has], doc[has]
            n = len(start)
            yield pa.record_batch(
                [pa.array([segment] * n, pa.int64()), pa.array(doc, pa.int64()), pa.array(start - first_words[doc], pa.int64())],
                names=["segment", "doc", "position"],
            )

    return stored.select(*SEARCHED).mapInArrow(run, "segment long, doc long, position long")


def _union_size(starts: Column, ends: Column) -> Column:
    """Words covered by the runs of one document, given as arrays of arrays."""
    runs = F.array_sort(F.flatten(F.transform(starts, lambda s, i: F.arrays_zip(s.alias("a"), ends[i].alias("b")))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))

    def add(acc: Column, run: Column) -> Column:
        end = F.greatest(acc["to"], run["b"])
        return F.struct((acc["n"] + end - F.greatest(acc["to"], F.least(run["a"], end))).alias("n"), end.alias("to"))

    return F.aggregate(runs, zero, add)["n"]


def test_blocks(windows: DataFrame, limit: int | None = None) -> Iterator[Windows]:
    """Distinct windows as tables of at most ``limit`` of them, one at a time."""
    limit = limit or BLOCK_WINDOWS
    blocks = -(-windows.count() // limit)
    dealt = windows.withColumn("block", F.lit(0).cast("long"))
    while blocks > 1:
        dealt = windows.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
        if dealt.groupBy("block").count().agg(F.max("count")).first()[0] <= limit:
            dealt = tables.stored(dealt.repartitionByRange("block").sortWithinPartitions("block"), "window-blocks")
            break
        blocks += 1 + blocks // 8
    for block in range(blocks):
        rows = dealt.filter(F.col("block") == block).select("window", "owners").toArrow()
        if len(rows):
            yield window_table(rows.column("window").to_pylist(), rows.column("owners").to_pylist())


def contamination(docs: DataFrame, tests: DataFrame, least_share: int = 20) -> DataFrame:
    """``doc_id, key_, n_words, n_hit, items, contaminated`` of every row of ``docs``.

    A word is hit inside any occurrence of a test window; ``items`` are the test items with
    occurring windows. Contaminated: some word is hit, and at least one in ``least_share``.
    Repeated rows get a row each; test rows without an id or words are left out. Without tests
    nothing is hit. ``key_`` is :func:`tables.text_key`, to join decisions back to documents.
    """
    spark = docs.sparkSession
    stored = index(docs)
    windows, owned = test_windows(tests)
    path = scratch_path(spark, "hits")
    spark.createDataFrame([], HITS).write.parquet(path)
    for block in test_blocks(windows):
        search(stored, block).write.mode("append").parquet(path)
    hits = spark.read.schema(HITS).parquet(path)
    # Many documents may hold windows of one owner set: these are spread by salt.
    named = hits.select("segment", "doc", F.explode("owners").alias("owners"), F.pmod(F.xxhash64("segment", "doc"), F.lit(SALTS)).alias("salt"))
    salted = owned.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    items = named.join(salted, ["owners", "salt"]).groupBy("segment", "doc").agg(F.collect_set("item").alias("items"))
    all_docs = documents(stored)
    per_doc = hits.groupBy("segment", "doc").agg(
        F.collect_list(F.struct("starts", "ends")).alias("runs")
    )  # per document, bounded by its words and the blocks
    n_hit = _union_size(F.col("runs.starts"), F.col("runs.ends"))
    per_doc = per_doc.select("segment", "doc", n_hit.alias("n_hit")).join(items, ["segment", "doc"])
    per_doc = tables.stored(per_doc, "hit-documents")
    joined = all_docs.join(per_doc, ["segment", "doc"], "left")
    joined = joined.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", F.array().cast("array<long>"))})
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * least_share >= F.col("n_words"))
    return joined.select("doc_id", "key_", "n_words", "n_hit", "items", dirty.alias("contaminated"))


def without_contaminated(docs: DataFrame, tests: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever their names."""
    dirty = contamination(docs, tests).filter("contaminated").select("doc_id", "key_").distinct()
    dirty_id, dirty_key = tables.unused(docs, "dirty_id", "dirty_key")
    dirty = tables.stored(dirty, "contaminated").withColumnsRenamed({"doc_id": dirty_id, "key_": dirty_key})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(dirty_id)) & (tables.text_key() == F.col(dirty_key))
    return docs.join(dirty, same, "left_anti")
