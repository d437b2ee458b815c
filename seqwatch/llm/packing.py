"""Packing of token sequences: window fillings weighted by non-negative least squares.

Documents are cut at full windows; what is left of each is counted by length class
(``GRAIN`` ids wide) over the whole corpus. All ways to fill a window with at most ``DEPTH``
lengths are enumerated, and non-negative least squares finds how often each must be repeated
to use up the histogram. Each task rounds its share of these counts, takes documents of the
wanted classes, and packs the residual end to end. A filling that runs over the window by less
than ``DEPTH * GRAIN`` ids is cut there, and the tail goes to the residual.

The solved plan is a table whose size depends on window, grain and depth alone. Token ids are
stored once, so that no text is tokenised twice, and a task holds ``BLOCK_IDS`` ids at most
beside one document's. Lengths that no filling wants still get whole windows from the residual.
What remains at a task's end is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from seqwatch.llm import kernels, tables

WINDOW = 2048
GRAIN = 16
DEPTH = 3
END_ID = 1
BLOCK_IDS = 4 << 20
CACHED_WORDS = 2 << 20
CACHED_PARTS = 1 << 18
CASED = kernels.byte_table(2)

TOKENS = "doc_id long, ids binary, n_ids long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def fillings(window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All ways to write ``window // grain`` as at most ``depth`` length classes, largest first."""

    def split(total: int, most: int, left: int) -> Iterator[tuple[int, ...]]:
        if total <= most:
            yield (total,)
        if left > 1:
            for first in range(min(most, total - 1), 0, -1):
                if first * left >= total:
                    for rest in split(total - first, first, left - 1):
                        yield (first, *rest)

    units = window // grain
    return [f for f in split(units, units, depth) if len(f) > 1]


def nnls(a: np.ndarray, b: np.ndarray, tolerance: float = 1e-9) -> np.ndarray:
    """Lawson and Hanson's active-set solution of min ``|a x - b|`` with ``x >= 0``."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, dtype=bool)
    gradient = a.T @ b
    floor = tolerance * max(1.0, float(np.abs(gradient).max(initial=0.0)))
    for _ in range(3 * n):
        if active.all() or gradient[~active].max() <= floor:
            break
        active[np.where(active, -np.inf, gradient).argmax()] = True
        while True:
            z = np.zeros(n)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (z <= 0)
            if not bad.any():
                break
            step = (x[bad] / (x[bad] - z[bad])).min()
            x += step * (z - x)
            active &= x > floor * 1e-6
            x[~active] = 0
        x = z
        gradient = a.T @ (b - a @ x)
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> list[tuple[tuple[int, ...], float]]:
    """(length classes, repeats per remainder of the corpus) of the fillings in use, most used first."""
    total = sum(histogram.values())
    ways = fillings(window, grain, depth)
    if not total or not ways:
        return []
    units = window // grain
    use = np.zeros((units, len(ways)))
    for j, way in enumerate(ways):
        for q in way:
            use[q, j] += 1
    wanted = np.array([histogram.get(q, 0) / total for q in range(units)])
    wanted[0] = 0  # shorter than a grain: residual
    repeats = nnls(use, wanted)
    order = np.argsort(-repeats, kind="stable")
    return [(ways[j], float(repeats[j])) for j in order if repeats[j] > 0]


#: Words of these characters are the same after NFC, and lower-case one character at a time.
PLAIN_WORD = re.compile(r"[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
#: What the tokenizer's splitter makes of lower-cased plain words.
PLAIN_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u00ff0-9]+")


#: The splitter that PLAIN_PARTS stands for, and the mark of a word's last character.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"


def plain_encoder(path: str):
    """A fast encoder of plain word parts by the same vocabulary, or None for other tokenizer files.

    Merges apply in the order of their ids, so the vocabulary as ranks gives the same ids. The
    zero byte, which no plain word has, stands for the end of a word.
    """
    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    spec = json.loads(Path(path).read_text())
    model = spec["model"]
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    splitters = [s["pattern"].get("Regex") for s in steps if s["type"] == "Split"]
    if model.get("type", "BPE") != "BPE" or model.get("end_of_word_suffix") != WORD_END or splitters != [SPLITTER]:
        return None
    shown = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(chr(i))[0][0]: i for i in range(128)}
    byte_of = {c: b for c, b in shown.items() if len(c) == 1}
    wide = ByteLevel(add_prefix_space=False, use_regex=False)
    for code in (*range(0x80, 0x800), *range(0x800, 0x110000, 0x40)):
        if not 0xD800 <= code < 0xE000:
            byte_of.update(zip(wide.pre_tokenize_str(chr(code))[0][0], chr(code).encode()))
    special = {t["content"] for t in spec.get("added_tokens", [])}
    ranks: dict[bytes, int] = {}
    for token, rank in model["vocab"].items():
        body = token.removesuffix(WORD_END)
        if token not in special and all(c in byte_of for c in body):
            ranks.setdefault(bytes(byte_of[c] for c in body) + b"\0" * (body != token), rank)
    for missing in (bytes([b]) for b in range(256)):  # bytes that UTF-8 never has
        ranks.setdefault(missing, len(model["vocab"]) + missing[0])
    return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})


class WordIds:
    """Ids of words by a tokenizer file, each word looked up by its 64-bit hash once known.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those
    of its words in turn. Special tokens in a text are read as text. Known words are kept in
    flat arrays of at most ``CACHED_WORDS``, and those of a worker serve all its tasks.
    Words of plain characters go through :func:`plain_encoder`, all others through the
    tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.plain = plain_encoder(path)
        self.parts: dict[str, bytes] = {}
        self.forget()

    def forget(self) -> None:
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.lengths = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u2")

    def _encode(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for i in range(0, len(pieces), 4096):
            got = self.tokenizer.encode_batch_fast(pieces[i : i + 4096], add_special_tokens=False)
            out.extend(struct.pack(f"<{len(e.ids)}H", *e.ids) for e in got)
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Add words, in the order of their hashes, that are not known yet."""
        if len(self.parts) > CACHED_PARTS:
            self.parts.clear()
        split = [PLAIN_PARTS.findall(w.lower()) if self.plain and PLAIN_WORD.fullmatch(w) else None for w in words]
        for part in {p for ps in split if ps for p in ps if p not in self.parts}:
            ids = self.plain.encode_ordinary(part + "\0")
            self.parts[part] = struct.pack(f"<{len(ids)}H", *ids)
        odd = iter(self._encode([w for w, ps in zip(words, split) if ps is None]))
        ids = [next(odd) if ps is None else b"".join(map(self.parts.__getitem__, ps)) for ps in split]
        lengths = np.fromiter((len(x) // 2 for x in ids), dtype=np.int64, count=len(ids))
        starts = len(self.pool) + np.cumsum(lengths) - lengths
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.starts = np.insert(self.starts, at, starts)
        self.lengths = np.insert(self.lengths, at, lengths)
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(ids), dtype="<u2")])

    def of(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        """The ids of each document of a block, as little-endian 16-bit numbers."""
        starts, ends, counts = kernels.words(data, offsets)
        hashes = kernels.word_hashes(data, starts, ends, CASED)
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(0, len(self.hashes) - 1))
        fresh = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), dtype=bool)
        if fresh.any() and len(self.hashes) + fresh.sum() > CACHED_WORDS:
            self.forget()
            fresh[:] = True
        if fresh.any():
            raw = data.tobytes()
            self._learn(distinct[fresh], [raw[starts[i] : ends[i]].decode() for i in first[fresh]])
        at = np.searchsorted(self.hashes, distinct)
        lengths = self.lengths[at][place]
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(self.starts[at][place] - bounds[:-1], lengths) + np.arange(bounds[-1])
        flat = self.pool[take].tobytes()
        edges = bounds[np.concatenate([[0], np.cumsum(counts)])] * 2
        return (flat[a:b] for a, b in zip(edges[:-1], edges[1:]))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``doc_id``, ids as little-endian 16-bit numbers with the end id, and their number.

    Null and empty text give the end id alone; rows of equal doc_id stay apart. The
    vocabulary must have fewer than 65,536 ids.
    """
    end = np.array([END_ID], dtype="<u2").tobytes()
    batch_of = kernels.record_batches([("doc_id", pa.int64()), ("ids", pa.binary()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer_path)
        for batch in batches:
            for first, last, data, offsets in kernels.blocks(batch):
                ids = [x + end for x in encoder.of(data, offsets)]
                yield batch_of(batch.column("doc_id").slice(first, last - first), ids, [len(x) // 2 for x in ids])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENS)


def _pack_block(docs: list[tuple], share: float, ways: list, window: int, grain: int, emit) -> list[tuple]:
    """Fill windows by the plan; the rest of the block, as (document, start, length), is returned."""
    residual: list[tuple] = []
    stock: dict[int, list[tuple]] = {}
    for d in docs:
        whole = d[2] // window * window
        for start in range(0, whole, window):
            emit([(d, start, window)])
        left = d[2] - whole
        if left >= grain:
            stock.setdefault(left // grain, []).append((d, whole, left))
        elif left:
            residual.append((d, whole, left))
    for last_round in (False, True):  # rounded shares first, then while stock lasts
        for way, repeats in ways:
            need: dict[int, int] = {}
            for q in way:
                need[q] = need.get(q, 0) + 1
            times = min(len(stock.get(q, ())) // k for q, k in need.items())
            if not last_round:
                times = min(times, int(repeats * share + 0.5))
            for _ in range(times):
                pieces = [stock[q].pop() for q in way]
                over = sum(p[2] for p in pieces) - window
                if over > 0:
                    d, start, length = pieces[-1]
                    pieces[-1] = (d, start, length - over)
                    residual.append((d, start + length - over, over))
                emit(pieces)
    for q in sorted(stock, reverse=True):
        residual.extend(stock[q])
    return residual


def _lay(pieces: list[tuple], window: int, emit, finish: bool) -> list[tuple]:
    """Lay pieces end to end into windows; at the end, the rest into powers of two."""
    row, room = [], window
    pieces = list(pieces)
    if finish:
        full, rest = divmod(sum(p[2] for p in pieces), window)
        rooms = [window] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    else:
        rooms = [window] * (sum(p[2] for p in pieces) // window)
    at, used = 0, 0
    for room in rooms:
        row = []
        while room:
            d, start, length = pieces[at]
            take = min(room, length - used)
            row.append((d, start + used, take))
            room -= take
            used += take
            if used == length:
                at, used = at + 1, 0
        emit(row)
    left = pieces[at:]
    if used:
        d, start, length = left[0]
        left[0] = (d, start + used, length - used)
    return left


def assign(stored: DataFrame, ways: list, total: int, window: int = WINDOW, grain: int = GRAIN) -> DataFrame:
    """The pieces of all documents: where each lies in its document and in its sequence."""
    batch_of = kernels.record_batches([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        made, rows = 0, []

        def emit(pieces: list[tuple]) -> None:
            nonlocal made
            offset = 0
            for (doc_id, ids, n), start, length in pieces:
                crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
                rows.append((doc_id, start, length, crc, n, base + made, offset))
                offset += length
            made += 1

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal rows
            if rows:
                yield batch_of(*zip(*rows))
            rows = []

        held, held_ids, carried = [], 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("ids")[i].as_buffer(), dtype="<u2")
                held.append((batch.column("doc_id")[i].as_py(), ids, len(ids)))
                held_ids += len(ids)
                if held_ids >= BLOCK_IDS:
                    share = sum(1 for d in held if d[2] % window)
                    carried = _lay(carried + _pack_block(held, share, ways, window, grain, emit), window, emit, False)
                    held, held_ids = [], 0
                    yield from flush()
        share = sum(1 for d in held if d[2] % window)
        _lay(carried + _pack_block(held, share, ways, window, grain, emit), window, emit, True)
        yield from flush()

    return stored.select("doc_id", "ids").mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, grain: int = GRAIN, depth: int = DEPTH) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` ids; see the module's text.

    One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.
    Pieces of a sequence follow each other from offset 0. Rows with a null or repeated doc_id
    are documents of their own; an empty table gives no rows; other columns are ignored.
    """
    ids = tables.stored(tokens(docs, tokenizer_path), "token-ids")
    left = F.col("n_ids") % window
    counts = ids.filter(left > 0).groupBy((left / grain).cast("int").alias("q")).count()
    histogram = {r.q: r["count"] for r in counts.collect()}  # window / grain rows at most
    return assign(ids, plan(histogram, window, grain, depth), sum(histogram.values()), window, grain)
