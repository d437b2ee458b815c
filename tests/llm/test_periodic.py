"""Periodic runs against a plain search over all periods, and on awkward tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow.parquet as pq
import pytest

from seqwatch.llm import periodic, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words: list[str], least: int = 24, periods: int = 3) -> list[tuple]:
    """Every maximal stretch of every period, without those that have a smaller period."""
    n, found = len(words), []
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.array([number[w] for w in words], dtype=np.int64)
    for q in range(1, n // periods + 1):
        same = np.concatenate([[False], ids[q:] == ids[:-q], [False]])
        for start, end in np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2).tolist():
            length = end - start + q
            if length >= max(least, periods * q):
                own = words[start : start + length]
                if not any(own[d:] == own[:-d] for d in range(1, q)):
                    found.append((start, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(text: str | None) -> tuple:
    words = WORDS.findall(text or "")
    return plain_digest(words)


def plain_digest(words: list[str]) -> tuple:
    runs = plain_runs(words)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    digests = tuple(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept))
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, *digests)


def plain_planted(doc_id: int, words: list[str]) -> list[str]:
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def found(words: list[str], least: int, periods: int) -> list[tuple]:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    return next(periodic.runs_of_block(data, np.array([0, len(data)]), least, periods))[1]


def periodic_words(rng: random.Random) -> list[str]:
    """Periods within periods, some cut short or with a word changed."""
    out: list[str] = []
    for _ in range(rng.randint(1, 5)):
        unit = [rng.choice("abcd"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 9))]
        part = unit * rng.randint(1, 14)
        if rng.random() < 0.4:
            part = (part + [rng.choice("xyz")]) * rng.randint(1, 4)
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] = rng.choice("abx")
        out += part[: rng.randint(1, len(part))]
    return out


@pytest.mark.parametrize("least, periods", [(24, 3), (6, 3), (4, 5), (9, 4), (1, 3)])
def test_runs_are_those_of_the_plain_search(least, periods):
    rng = random.Random(least * 10 + periods)
    for _ in range(300):
        words = periodic_words(rng)
        assert found(words, least, periods) == plain_runs(words, least, periods), words


def test_random_texts_of_few_words():
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.choice("ab") for _ in range(rng.randint(0, 120))]
        assert found(words, 4, 3) == plain_runs(words, 4, 3)


def test_one_word_or_line_over_and_over_takes_linear_time():
    began = time.monotonic()
    assert found(["a"] * 300_000, 24, 3) == [(0, 300_000, 1)]
    line = [f"w{i}" for i in range(100)]
    assert found(line * 3000, 24, 3) == [(0, 300_000, 100)]
    runs = found((["a", "b", "a"] * 100 + ["c"]) * 300, 24, 3)
    assert len(runs) == 301 and runs[:2] == [(0, 300, 3), (0, 301 * 300, 301)]
    assert time.monotonic() - began < 60


def test_two_periods_are_refused():
    with pytest.raises(ValueError, match="three periods"):
        periodic.least_match(24, 2)


def test_periodic_runs_query(spark, small):
    want = {}
    for r in pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        want[r["doc_id"]] = plain_digest(plain_planted(r["doc_id"], WORDS.findall(r["text"] or "")))
    query = queries.op12_periodic_runs(spark, small)
    assert query.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r[0]: tuple(r[1:]) for r in query.collect()} == want
    assert sum(w[0] > 0 for w in want.values()) >= 10


def test_periodic_awkward(spark):
    texts = {
        1: None, 2: "", 3: " \n\t", 4: "one", 5: "a " * 24, 6: "a " * 23, 7: ("x y z " * 8), 8: "é \U0001f600\n" * 40, 9: "A a " * 30,
        10: "b " * 30 + "c d e f g h i j " * 5 + "c", 11: "w" * 500_000,
    }
    rows = [(i, t, "r", 5, 1) for i, t in texts.items()] + [(5, texts[5], "r", 5, 1), (None, texts[10], "r", 5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words long, start long")
    have = periodic.detect(docs)
    assert have.columns == ["doc_id", "n_words", "runs", "greatest", "collapsed"]
    rows = have.collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[10 if r.doc_id is None else r.doc_id]
        assert [tuple(x) for x in r.runs] == plain_runs(WORDS.findall(text or "")) and r.n_words == len(WORDS.findall(text or ""))
        assert hashlib.sha256(r.collapsed.encode()).hexdigest() == plain_row(text)[-1]
    assert periodic.detect(docs.limit(0)).count() == 0


def test_planting_awkward(spark):
    rows = [(None, "a b c"), (7, None), *((i, f"w{i} x y z " * (i % 5)) for i in range(60))]
    have = queries.planted(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for (doc_id, text), r in zip(rows, have):
        words = WORDS.findall(text or "")
        want = words if doc_id is None else plain_planted(doc_id, words)
        assert WORDS.findall(r.text or "") == want
