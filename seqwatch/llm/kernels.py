"""NumPy helpers used inside tasks: text blocks, word hashes, shingles, sketches.

Texts are handled as UTF-8 bytes of Arrow batches, a few MB at a time, so memory per
task does not grow with the table. A word longer than a block is handled whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
SEGMENT = 1 << 20
SHINGLE = 5
BASE = 0x9E3779B97F4A7C15
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` odd 64-bit numbers that depend on the seed alone."""
    return mix(np.arange(1, n + 1, dtype=U) * U(BASE) + U(seed)) | U(1)


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    ones = np.ones(n, dtype=U)
    forward, backward = ones * U(base), ones * U(pow(base, -1, 1 << 64))
    forward[0] = backward[0] = 1
    return np.multiply.accumulate(forward), np.multiply.accumulate(backward)


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for ``i < n`` at least."""
    size = SEGMENT + 4096
    while size < n:
        size *= 2
    return _powers(size, base)


def prefix_hash(data: np.ndarray, table: np.ndarray, base: int = BASE) -> np.ndarray:
    """``p`` with ``(p[j] - p[i]) * base**-i`` a hash of ``data[i:j]``."""
    p = np.zeros(len(data) + 1, dtype=U)
    np.cumsum(table[data] * powers(len(data), base)[0][: len(data)], out=p[1:])
    return p


def byte_table(seed: int, fold_case: bool = False) -> np.ndarray:
    codes = np.arange(256, dtype=U)
    if fold_case:
        codes[65:91] += U(32)
    return mix(codes + U(seed * 256))


def byte_class(*excluded: tuple[int, int]) -> np.ndarray:
    """True for the bytes of words, which are all but the given ranges."""
    word = np.ones(256, dtype=bool)
    for low, high in excluded:
        word[low : high + 1] = False
    return word


SPACED_WORDS = byte_class((0x20, 0x20), (0x09, 0x0D))
FOLDED = byte_table(1, fold_case=True)


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``limit`` bytes; null is empty."""
    values = pc.fill_null(batch.column(column), "").cast(pa.large_binary())
    n = len(values)
    if not n:
        return
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[values.offset : values.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        end = min(end, n)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACED_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words of each document."""
    n_docs = len(offsets) - 1
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(n_docs, dtype=np.int64)
    flags = word[data]
    joined = np.zeros(len(data) + 1, dtype=bool)  # whether byte i goes on from byte i - 1
    joined[1:-1] = flags[1:] & flags[:-1]
    joined[offsets] = False
    starts = np.flatnonzero(flags & ~joined[:-1])
    ends = np.flatnonzero(flags & ~joined[1:]) + 1
    docs = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, np.bincount(docs, minlength=n_docs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLDED, longest: int = 0) -> np.ndarray:
    """64-bit hash of each word, or of at most its first ``longest`` bytes."""
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, at + SEGMENT, "left")))
        part = data[at : ends[j - 1]]
        p = prefix_hash(part, table)
        s, e = starts[i:j] - at, ends[i:j] - at
        if longest:
            e = np.minimum(e, s + longest)
        out[i:j] = mix((p[e] - p[s]) * powers(len(part))[1][s] + (e - s).astype(U))
        i = j
    return out


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words and each document's bounds in them.

    A document of fewer words, but not none, has its whole sequence as its only shingle.
    """
    weights = constants(size, seed=size)
    n_docs = len(counts)
    per_doc = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    out = np.empty(bounds[-1], dtype=U)
    first = np.concatenate([[0], np.cumsum(counts)])[:-1]
    docs = np.repeat(np.arange(n_docs), counts)
    n = len(hashes) - size + 1
    if n > 0:
        sums = hashes[:n] * weights[0]
        for j in range(1, size):
            sums += hashes[j : n + j] * weights[j]
        whole = docs[:n] == docs[size - 1 :]
        long_docs = np.repeat(counts >= size, per_doc)
        out[long_docs] = mix(sums[whole])
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        sums = counts[short].astype(U) * U(BASE)
        for j in range(size - 1):
            has = counts[short] > j
            sums[has] += hashes[first[short][has] + j] * weights[j]
        out[bounds[short]] = mix(sums)
    return out, bounds


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted distinct five-word shingle hashes of each document."""
    starts, ends, counts = words(data, offsets)
    hashes, bounds = shingles(word_hashes(data, starts, ends), counts)
    for i in range(len(counts)):
        yield np.unique(hashes[bounds[i] : bounds[i + 1]])


def record_batches(columns: Iterable[tuple[str, pa.DataType]]):
    """A function that makes an Arrow batch of lists given in the order of the columns."""
    schema = pa.schema(list(columns))

    def make(*values) -> pa.RecordBatch:
        return pa.record_batch([pa.array(v, type=f.type) for v, f in zip(values, schema)], schema=schema)

    return make
