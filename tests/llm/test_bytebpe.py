"""Byte-level BPE against tiktoken, and round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import tiktoken
from pyspark.sql import functions as F

from seqwatch.llm import bytebpe, queries

PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def path() -> str:
    return queries.ranks_path()


@pytest.fixture(scope="module")
def plain(path) -> tiktoken.Encoding:
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bytebpe.ranks(path), special_tokens={})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_byte_table_is_one_to_one():
    assert len(set(bytebpe.BYTE_CHARACTERS)) == 256 and bytebpe.BYTE_CHARACTERS[32] == "Ġ"


def test_random_strings(path, plain):
    rng = random.Random(3)
    letters = ["a", "b", "ab", "x", "xx", " ", "  ", "\n", "\r\n", "\t", "'s", "'", "1", "é", "漢", "\U0001f600", "́", "\x00", " ", "<|endoftext|>"]
    texts = ["".join(rng.choices(letters[: rng.randint(1, len(letters))], k=rng.randint(0, 60))) for _ in range(5000)]
    own = bytebpe.vocabulary(path, PATTERN)
    for text, ids in zip(texts, bytebpe.encoded(texts, own)):
        assert ids.tolist() == plain.encode_ordinary(text), text


def test_units_do_not_show(path, plain, monkeypatch):
    monkeypatch.setattr(bytebpe, "REMEMBERED", 3)
    own = bytebpe.vocabulary(path, PATTERN)
    spaces = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "\u180e", "\u200b"]
    for a in spaces:
        for b in spaces:
            for text in (f"It's{a}{b}one {a}text {b}12{a} ", f"{a}x y{b}", f"a {a}{b} b.{b}'s"):
                assert "".join(bytebpe.units(text)) == text
                assert bytebpe.encoded([text, text], own)[1].tolist() == plain.encode_ordinary(text), text


def test_offsets_of_split_characters(path):
    own = bytebpe.vocabulary(path, PATTERN)
    for text in ("plain words", "\U00013000\U00013001 a", "été 漢字 \U0001f9ff!", ""):
        ids = bytebpe.encoded([text], own)[0]
        starts, ends = bytebpe.character_offsets(ids, own)
        at = 0
        for i, s, e in zip(ids, starts, ends):
            token = own.tokens[i]
            # The bytes of the characters it touches hold the token where the ones before ended.
            before = len(text[:s].encode())
            assert text[s:e].encode()[at - before :].startswith(token) and before <= at
            assert at + len(token) <= len(text[:e].encode())
            at += len(token)
        assert at == len(text.encode())


def test_byte_bpe_query(spark, small, plain):
    large = small.replace("sf0.001", "sf0.01")
    want = {}
    for r in pq.read_table(f"{large}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        ids = plain.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), sha(",".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))
    query = queries.op13_byte_bpe(spark, large)
    assert query.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r[0]: tuple(r[1:]) for r in query.collect()} == want


def test_byte_bpe_awkward(spark, path, plain):
    texts = [None, "", " ", "\n\n\n", "x" * 100_000, "one " * 300_000, "\U0001f600" * 500, "same", "same"]
    rows = [(i if i < 7 else 7, t, "ids", 1) for i, t in enumerate(texts)] + [(None, "no id", "ids", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, starts int")
    found = bytebpe.encode(docs, path, PATTERN, offsets=True)
    for (doc_id, text, _, _), r in zip(rows, found.collect()):
        assert (r.doc_id, r.ids) == (doc_id, plain.encode_ordinary(text or ""))
        assert len(r.starts) == len(r.ends) == len(r.ids) and (not r.ends or r.ends[-1] == len(text))
    back = bytebpe.decode(found, path, PATTERN).collect()
    assert [(r.doc_id, r.text, bytes(r.bytes)) for r in back] == [(i, t or "", (t or "").encode()) for i, t, _, _ in rows]
    assert bytebpe.encode(docs.limit(0), path, PATTERN).count() == 0
    assert bytebpe.decode(found.limit(0), path, PATTERN).count() == 0


def test_ids_cut_out_of_a_list(spark, path):
    own = bytebpe.vocabulary(path, PATTERN)
    ids = bytebpe.encoded(["\U00013000"], own)[0]
    assert len(ids) > 1
    rows = [(1, ids.tolist()), (2, ids[:-1].tolist()), (3, None), (4, [])]
    found = bytebpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), path, PATTERN).orderBy("doc_id").collect()
    assert found[0].text == "\U00013000" and "�" in found[1].text and [r.text for r in found[2:]] == ["", ""]
    bad = spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bytebpe.decode(bad, path, PATTERN).agg(F.sum("n_tokens")).collect()
    assert bytebpe.token_bytes(np.zeros(0, np.int32), own) == b""
