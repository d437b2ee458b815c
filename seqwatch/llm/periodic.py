"""Runs of words that repeat with a period, by an online dynamic programme over sparse diagonals.

The diagonal of lag q holds, for each word, how many words in a row from it on equal the word q
places before. The words of a text are gone through once; a word's earlier occurrences make
the diagonals of their lags grow, and a diagonal that is not continued by the next word ends
and is a run at once, if it is long enough and no divisor of its lag is a period of it, too.

All occurrences of all words would be quadratic. Sparse means that an occurrence counts only
with as much context as every run has, and then the nearest one is enough:

* In a run of ``length >= max(least, periods * q)`` words ``length - q`` words in a row match,
  which is ``match = ceil(least * (periods - 1) / periods)`` at least, whatever q is. Diagonals of
  lags up to ``match`` grow by words that occurred earlier with the ``match - 1`` words after them.
* Longer lags take longer contexts: those over ``size / 2`` and up to ``size`` take ``size`` words, for
  ``size`` twice ``match``, four times and so on. With three periods or more that still fits: the
  run has ``q + 2 * q`` words at least, and ``size < 2 * q``.
* A context of q words or more occurs only once in each period. Were there a nearer occurrence,
  p < q words before, p + q words would have both periods, so also their greatest common
  divisor (Fine and Wilf), and q would not be the run's smallest period.

So a word makes one diagonal of each size grow at most, and a text of n words costs n log n,
even one word or line over and over. Texts in which no ``match`` words occur twice, which are
most, are seen through by one sort of their block.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seqwatch.llm import kernels

LEAST = 24
PERIODS = 3
EXACT_CASE = kernels.byte_table(21)
U = np.uint64

Run = tuple[int, int, int]


def least_match(least: int, periods: int) -> int:
    """Words in a row that match on the diagonal of any run."""
    if least < 1 or periods < 3:
        raise ValueError("a run has a word and three periods at least")
    return max(1, -(-least * (periods - 1) // periods))


def divisors(q: int) -> list[int]:
    """``q`` divided by each of its prime factors."""
    found, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            found.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return found + ([q // rest] if rest > 1 else [])


def _prefix(hashes: np.ndarray) -> np.ndarray:
    p = np.zeros(len(hashes) + 1, dtype=U)
    np.cumsum(kernels.mix(hashes) * kernels.powers(len(hashes) + 1)[0][: len(hashes)], out=p[1:])
    return p


def _names(p: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` words from each place on."""
    return kernels.mix((p[at + size] - p[at]) * kernels.powers(len(p))[1][at])


def growth(hashes: np.ndarray, least: int, periods: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, lag, context) by word: the diagonals that each word of a text makes grow."""
    n, p, size = len(hashes), _prefix(hashes), least_match(least, periods)
    found, shortest = [], 1
    while shortest * periods <= n and size <= n:
        names = _names(p, np.arange(n - size + 1), size)
        order = np.argsort(names, kind="stable")
        again = names[order[1:]] == names[order[:-1]]
        if not again.any():
            break
        word = order[1:][again]
        lag = word - order[:-1][again]
        fits = (lag >= shortest) & (lag <= size)
        found.append((word[fits], lag[fits], np.full(fits.sum(), size)))
        shortest, size = size + 1, 2 * size
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    word, lag, context = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(word, kind="stable")
    return word[order], lag[order], context[order]


def diagonal_runs(hashes: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> list[Run]:
    """(start, length, period) of the runs of one text, from the hashes of its words."""
    words = hashes.tolist()
    active: dict[int, list[int]] = {}  # lag -> first and last word it grew by, context
    runs: list[Run] = []

    def close(lag: int) -> None:
        first, last, context = active.pop(lag)
        start, length = first - lag, last + context - first + lag
        if length >= max(least, periods * lag):
            if not any(words[start + d : start + d + lag] == words[start : start + lag] for d in divisors(lag)):
                runs.append((start, length, lag))

    now = -1
    for word, lag, context in zip(*(x.tolist() for x in growth(hashes, least, periods))):
        if word != now:
            for ended in [q for q, (_, last, _) in active.items() if last < word - 1]:
                close(ended)
            now = word
        if lag in active:
            active[lag][1] = word
        else:
            active[lag] = [word, word, context]
    for lag in list(active):
        close(lag)
    return sorted(runs, key=lambda r: (r[0], r[2]))


def with_repeats(hashes: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """Whether some ``size`` words in a row occur twice in a text, for the texts of a block."""
    docs = np.repeat(np.arange(len(counts)), counts)
    found = np.zeros(len(counts), dtype=bool)
    last = len(hashes) - size + 1
    if last > 0:
        inside = np.flatnonzero(docs[:last] == docs[size - 1 :])
        own = docs[inside]
        names = kernels.mix(_names(_prefix(hashes), inside, size) + kernels.mix(own.astype(U)))
        order = np.argsort(names, kind="stable")
        found[own[order[1:]][names[order[1:]] == names[order[:-1]]]] = True
    return found


def runs_of_block(data: np.ndarray, offsets: np.ndarray, least: int = LEAST, periods: int = PERIODS) -> Iterator[tuple[int, list[Run]]]:
    """Number of words, and runs, of each text of a block."""
    starts, ends, counts = kernels.words(data, offsets)
    hashes = kernels.word_hashes(data, starts, ends, EXACT_CASE)
    searched = with_repeats(hashes, counts, least_match(least, periods))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    for i, n in enumerate(counts.tolist()):
        yield n, diagonal_runs(hashes[bounds[i] : bounds[i + 1]], least, periods) if searched[i] else []


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words without those of a run after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    kept, at = [], 0
    for start, end in sorted((start + period, start + length) for start, length, period in runs):
        kept += words[at : max(at, start)]
        at = max(at, end)
    return b" ".join(kept + words[at:])


def greatest(runs: list[Run]) -> Run | None:
    """The run with the most periods, the first one of several."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
DETECTED = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
DETECTED += "greatest struct<start:long,length:long,period:long>, collapsed string"


def detect(docs: DataFrame, least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """Per row of ``doc_id, text``: ``doc_id, n_words, runs, greatest, collapsed``.

    Words are separated by white space of ASCII and numbered from 0. A run is a stretch of
    words of smallest period q and of ``max(least, periods * q)`` words at least that no
    neighbouring word extends. ``runs`` come by start, then period; ``greatest`` is the one of most
    periods (of several the first), null if there is none; ``collapsed`` is the text without the
    words of a run after its first period. Null is an empty text. Rows that repeat a doc_id
    are rows of their own, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = kernels.record_batches([
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN)), ("greatest", RUN), ("collapsed", pa.string()),
        ])

        def struct(r: Run | None) -> dict | None:
            return r and dict(zip(("start", "length", "period"), r))

        for batch in batches:
            for start, end, data, offsets in kernels.blocks(batch):
                counts, runs, top, texts = [], [], [], []
                for i, (n, found) in enumerate(runs_of_block(data, offsets, least, periods)):
                    counts.append(n)
                    runs.append([struct(r) for r in found])
                    top.append(struct(greatest(found)))
                    texts.append(collapsed(data[offsets[i] : offsets[i + 1]].tobytes().split(), found).decode())
                yield batch_of(batch.column("doc_id").slice(start, end - start), counts, runs, top, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, DETECTED)


def run_lines(runs: Column) -> Column:
    """``start,length,period`` of every run, a line each."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
