"""Repeated ids, clashing column names, accounts that capitals follow, pairs on the threshold."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from seqwatch.llm import decontamination, neardup, pii, substrings, urlfilter


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def test_rows_of_one_id_link_by_each_of_their_texts(spark):
    rng = random.Random(1)
    a, b, c = (words(rng, 40) for _ in range(3))
    rows = [(1, a), (1, b), (4, [*a, "more"]), (5, ["more", *b]), (6, c), (None, [*c, "x"]), (7, ["y", *c])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in neardup.clusters(docs).collect())
    assert found == [
        (0, 37, None, True), (1, 36, 1, True), (1, 36, 1, True), (4, 37, 1, False), (5, 37, 1, False), (6, 36, 6, True), (7, 37, 6, False),
    ]


@pytest.mark.parametrize("least, most", [(64, 90), (200, 400), (900, 1500)])
def test_recall_of_large_sets_at_the_threshold(spark, least, most):
    rng, docs = random.Random(least), []
    for _ in range(120):
        n = rng.randint(least, most)
        longer = words(rng, n + int(n * rng.uniform(0.25, 1 / 3)) + 4)
        docs += [" ".join(longer[: n + 4]), " ".join(longer)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    linked = neardup.clusters(df).filter("doc_id % 2 = 1 AND component_id = doc_id - 1").count()
    assert linked >= 0.99 * 120


def test_columns_may_have_any_names(spark):
    text = " ".join(words(random.Random(2), 30))
    docs = spark.createDataFrame([(1, text, 8, "k", "a", "b")], "doc_id long, text string, at_ long, text_key_ string, at string, Text_Key string")
    assert [tuple(r) for r in neardup.one_of_each(docs).collect()] == [tuple(r) for r in docs.collect()]
    docs = spark.createDataFrame([(1, text, 8, "k", "a")], "doc_id long, text string, dirty_id_ long, dirty_key string, dirty_id string")
    tests = spark.createDataFrame([(9, "other words")], "item_id long, text string")
    assert [tuple(r) for r in decontamination.without_contaminated(docs, tests).collect()] == [tuple(r) for r in docs.collect()]
    urls = spark.createDataFrame([("http://a.org/x", 1, 2, 3, 4)], "url string, keys_ int, block_ int, allow int, block_bits int")
    rules = spark.createDataFrame([("org/", "block")], "rule string, verdict string")
    judged = urlfilter.judge(urls, rules).first()
    assert tuple(judged) == ("http://a.org/x", 1, 2, 3, 4, "a.org", "/x", "org/", "block")


@pytest.mark.parametrize("text, want", [
    ("IBAN GB82 WEST 1234 5698 7654 32 AND SO ON", "GB82 WEST 1234 5698 7654 32"),
    ("IBAN GB82WEST12345698765432 OK 5", "GB82WEST12345698765432"),
    ("iban: DE89370400440532013000.", "DE89370400440532013000"),
    ("IBAN NO93 8601 1117 947 NO93", "NO93 8601 1117 947"),
    ("IBAN GB82WEST12345698765432X", None),
    ("IBAN GB82WEST1234569876543", None),
    ("IBAN GB82WEST12345698765433 AND", None),
])
def test_accounts_end_by_their_countrys_length(text, want):
    found = [text[s:e] for kind, s, e in pii.find(text) if kind == "iban"]
    assert found == ([want] if want else [])


def test_a_digit_in_most_documents(spark):
    """One passage in nearly all rows, beside repeats that only few have."""
    rng = random.Random(3)
    common, rare = " ".join(words(rng, 80)), " ".join(words(rng, 80))
    texts = [f"{' '.join(words(rng, 5))} {common} {' '.join(words(rng, 5))}" for _ in range(300)]
    texts += [f"{w} {rare}" for w in words(rng, 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in substrings.remove(docs).select("doc_id", "n_removed", "n_spans").collect()}
    assert min(n for n, _ in found.values()) >= len(common.encode()) and {s for _, s in found.values()} == {1}


def test_unused_names(spark):
    from seqwatch.llm import tables

    df = spark.range(1).select(F.lit(1).alias("At"), F.lit(2).alias("at_"))
    assert tables.unused(df, "at", "at", "new") == ["at__", "at___", "new"]


def test_items_that_share_windows(spark, monkeypatch):
    word = [f"w{i}" for i in range(60)]
    both, first, other = " ".join(word[:40]), " ".join(word[:20]), " ".join(word[30:50])
    tests = spark.createDataFrame([(1, both), (2, both), (3, first), (4, other), (5, "w3 w4"), (5, "w3 w4")], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(word)), (2, f"x {first} y"), (3, "w3 w4 " * 30), (4, "w4 w3")], "doc_id long, text string")
    windows, owned = decontamination.test_windows(tests)
    assert {r.owners for r in owned.collect()} == {r.owners for r in windows.collect()}
    want = {1: (50, [1, 2, 3, 4, 5]), 2: (20, [1, 2, 3, 5]), 3: (60, [5]), 4: (0, [])}
    for limit in (1000, 7):
        monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", limit)
        blocks = list(decontamination.test_blocks(windows))
        assert max(map(len, blocks)) <= limit and sum(map(len, blocks)) == windows.count()
        got = decontamination.contamination(docs, tests).collect()
        assert {r.doc_id: (r.n_hit, sorted(r["items"])) for r in got} == want
