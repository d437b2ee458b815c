"""Every corpus operator against a plain version of itself, and on awkward tables."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import compare, duck
from seqwatch.llm import (
    decontamination, fingerprints, importance, kernels, neardup, packing, pii, queries, substrings, tables, toxicity, urlfilter, warc,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long, bits string, n long, node string, rep string"


@pytest.fixture(scope="module")
def texts(small) -> dict[int, str]:
    rows = pq.read_table(f"{small}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def odd_rows(texts: dict[int, str]) -> list[tuple]:
    """Nulls, empty and blank texts, repeated rows and ids, a long text, one word, ties."""
    some = sorted(texts)[:12]
    long = " ".join(texts[i] for i in sorted(texts)[:40]) * 3
    found = [(i, texts[i]) for i in some]
    found += [(some[0], texts[some[0]]), (some[1], "other text under an id that is there already")]
    found += [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one"), (905, "a b c d"), (906, "a b c d e"), (None, texts[some[2]])]
    found += [(None, None), (907, long), (908, long[:-3] + "end"), (909, "x" * 3000), (910, "\u00e9\U0001f600 \u0130 " * 50)]
    return [(i, t, None, None, None, None, 1, "node", None) for i, t in found]


@pytest.fixture(scope="module")
def odd(spark, texts):
    return spark.createDataFrame(odd_rows(texts), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def lowered(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def shingle_set(text: str) -> frozenset:
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_agree_with_sql(spark, small, name):
    count, difference = compare(queries.ALL[name](spark, small), duck(small), queries.SQL[name])
    assert count and not difference


# kernels


def test_word_hashes_depend_on_the_word_alone():
    texts = ["Ab cd  ef", "", "cd", "\u00e9 ab"]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    seen = defaultdict(set)
    for _, _, data, offsets in kernels.blocks(batch, limit=1):
        starts, ends, _ = kernels.words(data, offsets)
        for h, s, e in zip(kernels.word_hashes(data, starts, ends), starts, ends):
            seen[bytes(data[s:e]).lower()].add(int(h))
    assert all(len(v) == 1 for v in seen.values()) and len(set().union(*seen.values())) == 4


def test_words_longer_than_a_segment(monkeypatch):
    monkeypatch.setattr(kernels, "SEGMENT", 64)
    text = "a" * 500 + " b " + "a" * 500
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    starts, ends, counts = kernels.words(data, offsets)
    hashes = kernels.word_hashes(data, starts, ends)
    assert counts.tolist() == [3] and hashes[0] == hashes[2] != hashes[1]


def test_shingles_do_not_cross_documents(texts):
    some = list(texts.values())[:30] + ["a b", "", "a b c d e f"]
    batch = pa.record_batch([pa.array(some)], names=["text"])
    sizes = [len(s) for _, _, d, o in kernels.blocks(batch) for s in kernels.shingle_sets(d, o)]
    assert sizes == [len(shingle_set(t)) for t in some]


# 1 toxicity


def test_toxicity_held_out(spark, small):
    """Two folds: every labelled document is scored by a chain that saw the other half only."""
    large = small.replace("sf0.001", "sf0.1")  # the small table has a few toxic documents only
    docs, labels = tables.read(spark, large, "documents"), tables.read(spark, large, "labels")
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
    rows = []
    for fold in (0, 1):
        chain = toxicity.fit(docs, labels.filter(half != fold), queries.CATEGORIES)
        scored = toxicity.score(docs, chain).join(labels.filter(half == fold), "doc_id")
        rows += scored.select("toxic", "p_toxic", "quality", "p_low_quality").collect()
        assert [len(link.earlier) for link in chain.links] == [0, 1]
    assert np.mean([r.p_toxic >= 0.5 for r in rows if r.toxic]) > 0.9
    assert np.mean([r.p_toxic < 0.5 for r in rows if not r.toxic]) > 0.97
    assert np.mean([(r.p_low_quality >= 0.5) == (r.quality == 0) for r in rows]) > 0.85


def labelled(texts: list[str], toxic: list[int], folds: list[int]) -> pd.DataFrame:
    """Rows as the operator's fit takes them, from features found per text."""
    slots = []
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        slots.append(toxicity.features(data, np.array([0, len(data)]))[1].astype("<i4").tobytes())
    return pd.DataFrame({"id": range(len(texts)), "fold": folds, "y0": toxic, "y1": toxic, "slots": slots})


def toy_rows() -> pd.DataFrame:
    rng = random.Random(5)
    toxic = [rng.random() < 0.4 for _ in range(60)]
    texts = [" ".join(rng.choices(["alpha", "betaword", "gammawords", "mean" if y else "nice", "more"], k=8)) for y in toxic]
    return labelled(texts, [int(y) for y in toxic], [rng.randrange(toxicity.FOLDS) for _ in texts])


def test_a_link_is_the_ridge_optimum_of_a_plain_model():
    """Gradient of the weighted loss by a dense matrix, at the fitted weights."""
    pdf = toy_rows()
    row, col = toxicity._matrix(pdf)
    y, dense = pdf["y0"].to_numpy(float), np.random.default_rng(1).random((len(pdf), 1))
    ridge = 0.05
    bias, weights, more = toxicity.fit_logistic(row, col, dense, y, ridge, steps=4000)
    x = np.zeros((len(y), toxicity.FEATURES), np.float32)
    x[row, col] = 1
    x = np.hstack([x[:, weights != 0], dense])
    w = np.concatenate([weights[weights != 0], more])
    sample = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    error = sample * (1 / (1 + np.exp(-(x @ w + bias))) - y)
    assert abs(error.sum()) < 1e-4 and np.abs(x.T @ error + ridge * w).max() < 1e-4


def test_no_feature_comes_from_a_model_that_saw_the_row():
    """Other labels for one fold change neither its own probabilities nor leave the others' as they were."""
    pdf = toy_rows()
    for fold in range(toxicity.FOLDS):
        turned = pdf.assign(y0=np.where(pdf["fold"] == fold, 1 - pdf["y0"], pdf["y0"]))
        have = toxicity._fold_task(0)((fold,), pdf)
        same = toxicity._fold_task(0)((fold,), turned)
        assert sorted(have["id"]) == sorted(pdf["id"][pdf["fold"] == fold]) and have.equals(same)
        other = (fold + 1) % toxicity.FOLDS
        assert not toxicity._fold_task(0)((other,), pdf).equals(toxicity._fold_task(0)((other,), turned))


def test_earlier_probability_feeds_the_next_link():
    data, offsets = np.frombuffer(b"some words", np.uint8), np.array([0, 10])
    zero = np.zeros(toxicity.FEATURES)
    links = [toxicity.Link("a", 2.0, zero, np.zeros(0)), toxicity.Link("b", 0.0, zero, np.array([3.0]))]
    first, second = toxicity.probabilities(toxicity.Chain(tuple(links)), data, offsets)
    assert second[0] == pytest.approx(toxicity.sigmoid(3 * first)[0])


def test_toxicity_awkward(spark, odd, none):
    labels = spark.createDataFrame([(900, 1, 1), (901, None, 0), (None, 1, 1), (905, 0, 1), (905, 1, 0), (906, 1, 0)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(odd, labels, queries.CATEGORIES)
    scored = toxicity.score(odd.withColumn("p_toxic", F.lit("old")), chain)
    assert scored.count() == odd.count() and scored.filter("p_toxic IS NULL").count() == 0
    assert set(odd.columns) < set(scored.columns)
    unfitted = toxicity.fit(none, labels, queries.CATEGORIES)
    assert toxicity.score(odd, unfitted).filter("p_toxic > 0.5").count() == 0
    assert toxicity.score(none, chain).count() == 0


# 2 WARC


def test_warc_round_trip_and_pushdown(spark, tmp_path):
    warc.register(spark)
    rows = [("response", "<urn:a>", {"WARC-Target-URI": "http://a/\r\nx", "Content-Type": warc.HTTP}, b"hello \xff\r\n\r\nworld"),
            ("response", "<urn:b>", {"Content-Type": "text/plain"}, b""), ("revisit", "<urn:c>", {"WARC-Refers-To": "<urn:a>"}, None),
            ("request", "<urn:d>", None, b"x" * 700_000)]
    df = spark.createDataFrame(rows, warc.WRITE_SCHEMA)
    for compression in ("gzip", "none"):
        path = f"{tmp_path}/{compression}"
        df.coalesce(1).write.format("warc").option("compression", compression).mode("append").save(path)
        back = spark.read.format("warc").load(path)
        got = {r.record_id: r for r in back.collect()}
        assert {k: bytes(v.payload) for k, v in got.items()} == {r[1]: r[3] or b"" for r in rows}
        assert got["<urn:a>"].target_uri == "http://a/%0D%0Ax" and got["<urn:c>"].refers_to == "<urn:a>"
        only = back.filter((F.col("record_type") == "response") & F.col("target_uri").startswith("http"))
        assert [r.record_id for r in only.collect()] == ["<urn:a>"]
        assert "record_type" not in only._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0].replace("record_type#", "")


def test_warc_skips_unwanted_payloads(tmp_path):
    members = [warc.member(warc.record("response", f"<{i}>", {}, bytes([i]) * 2_000_000)) for i in range(3)]
    foreign = [gzip.compress(warc.record("response", f"<{i}>", {}, b"y" * 99)) for i in range(2)]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(members + foreign))

    class Counting:
        def __init__(self, file):
            self.file, self.n = file, 0

        def size(self):
            return self.file.size()

        def read_at(self, n, at):
            self.n += 1
            return self.file.read_at(n, at)

    inflated = []
    real = warc._Member._more
    warc._Member._more = lambda self, n: inflated.append(len(out := real(self, n))) or out
    try:
        with pa.OSFile(str(tmp_path / "a.warc.gz")) as f:
            found = list(warc.records(f, [warc.Test("warc-record-id", "In", frozenset(["<4>", "<1>"]))]))
    finally:
        warc._Member._more = real
    assert [h["warc-record-id"] for h, _ in found] == ["<1>", "<1>"]
    assert sum(inflated) < 2_100_000 + 3 * 4096 + 2000


def test_warc_pages(spark):
    big = "p" * 150
    rows = [(5, "u5", big), (3, "u3", big), (3, "u3", big), (9, None, None), (7, "u7", "small"), (8, "u8", "small"), (None, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    got = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest == hashlib.sha256((h or "").encode()).hexdigest())
                 for r in warc.read_pages(spark, warc.archive(pages)).collect() for h in [dict((a, c) for a, _, c in rows)[r.page_id]])
    assert [g[:4] for g in got] == [(-1, "revisit", 3, 150), (3, "response", None, 150), (3, "response", None, 150), (5, "revisit", 3, 150), (7, "response", None, 5), (8, "response", None, 5), (9, "response", None, 0)]
    assert all(g[4] for g in got)
    assert warc.read_pages(spark, warc.archive(pages.limit(0))).count() == 0


# 3 importance resampling


def test_threshold_is_the_kth_largest(spark):
    values = [random.Random(1).gauss(0, 50) for _ in range(500)] + [3.0] * 5 + [0.0, -0.0, 1e300, -1e300]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 250, 509):
        assert importance.threshold(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert importance.threshold(df, "x", 510) == -np.inf


def test_resampling_marks_targets(spark):
    docs = spark.createDataFrame([(i % 300, f"text {i}") for i in range(400)] + [(None, None)], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 600, 3)] * 2 + [(None,)], "doc_id int")
    for bits in (64, 4096):  # nearly all texts joined, and few
        got = importance.marked(docs, ids, bits).collect()
        assert sorted((r.text or "", r.target_) for r in got) == sorted(
            [(f"text {i}", i % 300 % 3 == 0) for i in range(400)] + [("", False)]
        )
        assert {r.target_ for r in importance.marked(docs, ids.limit(0), bits).collect()} == {False}


def test_resampling_prefers_target_text(spark, none, odd):
    rows = [(i, ("good fine text " if i % 4 == 0 else "bad poor words ") * (5 + i % 3)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = importance.resample(docs, docs, F.col("doc_id") % 8 == 0, share=0.25).collect()
    assert sum(r.selected for r in got) == 50 and all(r.doc_id % 4 == 0 for r in got if r.selected)
    weights = {r.doc_id: r.log_weight for r in got}
    raw, wanted = Counter(), Counter()
    for i, t in rows:
        w = t.split()
        grams = w + [" ".join(p) for p in zip(w, w[1:])]
        raw.update(grams)
        wanted.update(grams * (i % 8 == 0))
    n = importance.BUCKETS
    lr = {g: np.log((wanted[g] + 0.5) / (sum(wanted.values()) + 0.5 * n) * (sum(raw.values()) + 0.5 * n) / (raw[g] + 0.5)) for g in raw}
    w = rows[0][1].split()
    assert weights[0] == pytest.approx(sum(lr[g] for g in w + [" ".join(p) for p in zip(w, w[1:])]))
    assert importance.resample(none, none, F.lit(True)).count() == 0
    assert importance.resample(odd, odd, F.lit(None).cast("boolean")).count() == odd.count()


# 4 packing


def check_packing(rows, docs: list[tuple], window: int = 2048) -> tuple[int, int]:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.encode_special_tokens = True
    want = Counter()
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[(i, len(ids))] += len(ids)
        full = {a: b for a, b in [(0, len(ids))]}
        assert full
    have, sequences = Counter(), defaultdict(list)
    for r in rows:
        have[(r.doc_id, r.doc_tokens)] += r.length
        sequences[r.sequence_id].append(r)
    assert have == want
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return len(sequences), padding


def test_packing_is_exact(spark, small, texts):
    rows = queries.ALL["op4_nnls_packing"](spark, small).collect()
    n, padding = check_packing(rows, list(texts.items()))
    assert n > 10 and padding == 0
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    for r in rows:
        ids = np.array([*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_packing_awkward(spark, odd, none, texts):
    rows = packing.pack(odd, queries.tokenizer_path()).collect()
    check_packing(rows, [r[:2] for r in odd_rows(texts)])
    assert packing.pack(none, queries.tokenizer_path()).count() == 0


def test_nnls_and_plan():
    a = np.random.default_rng(0).random((6, 9))
    x = packing.nnls(a, a @ np.array([1, 0, 2, 0, 0, 0, 0.5, 0, 0.0]))
    assert (x >= 0).all() and np.allclose(a @ x, a @ np.array([1, 0, 2, 0, 0, 0, 0.5, 0, 0.0]), atol=1e-6)
    assert all(sum(f) == 8 and list(f) == sorted(f, reverse=True) for f in packing.fillings(128, 16, 3))
    assert set(packing.fillings(64, 16, 3)) == {(3, 1), (2, 2), (2, 1, 1)}
    ways = packing.plan({100: 10, 28: 10, 64: 4})
    assert ways[0][0] == (100, 28) and ways[0][1] == pytest.approx(10 / 24, rel=1e-6)
    assert packing.plan({}) == []


def test_word_ids_agree_with_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    tokenizer.encode_special_tokens = True
    some = ["don't STOP", "\u0130stanbul \u03a3\u0391\u03a3", "a\u0301bc e\u0301", "x\u00a0y\u2003z", "<|endoftext|> 12 ab1c\x1cq", "", "''s ('s", " \x85 a\x00b", "\ufb01 \u2167 \U0001d518"]
    batch = pa.record_batch([pa.array(some)], names=["text"])
    for _, _, data, offsets in kernels.blocks(batch):
        for text, ids in zip(some, packing.word_ids(queries.tokenizer_path()).of(data, offsets)):
            assert np.frombuffer(ids, "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_word_ids_forget(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 4)
    encoder = packing.WordIds(queries.tokenizer_path())
    data, offsets = np.frombuffer(b"a b c d e f g", np.uint8), np.array([0, 13])
    once = list(encoder.of(data, offsets))
    assert once == list(encoder.of(data, offsets)) and len(encoder.hashes) == 7


# 5 PII

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_spans(text: str) -> list[tuple]:
    def fits(kind: str, m: str) -> bool:
        digits = re.sub("[^0-9]", "", m)
        luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.split(".")), "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]

    found = [(m.start(), j, k, m.end()) for j, (k, p) in enumerate(PATTERNS) for m in re.finditer(p, text) if fits(k, m[0])]
    return [(k, a, e) for a, _, k, e in sorted(found)]


def test_pii_finds_what_the_patterns_find(texts):
    rng = random.Random(3)
    alphabet = ["@", "+", ".", "-", " ", "1", "4", "25", "300", "0", "a", "b.c", "x@y.z", "4111111111111111", "(", ")", "\u00e9", "://", "iban "]
    made = ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]
    for text in [*texts.values(), *made, "1." * 5000, "1" * 9000, "a@" * 4000, "+1 " * 3000]:
        assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == base_spans(text), text[:200]


def test_pii_added_spans():
    text = "IBAN: GB82 WEST 1234 5698 7654 32, account no. 12-345-678 at ftp://me:secret@host.org/x; iban GB82WEST12345698765433"
    found = {k: text[a:b] for k, a, b in pii.find(text) if k not in pii.BASE_KINDS}
    assert found == {"iban": "GB82 WEST 1234 5698 7654 32", "account": "12-345-678", "login": "me:secret@host.org"}
    assert pii.find("accountable 123456789 http://plain.org/a@b") == []


def test_pii_long_logins():
    for login in ("u" * 300 + ":p@host.org", "me:" + "p" * 3000 + "@host.org", "me:secret@" + "a." * 40 + "org", "me@" + "h" * 70 + ".org"):
        assert ("login", 8, 8 + len(login)) in pii.find(f"https://{login}/x")


def test_pii_awkward(odd, none):
    assert pii.scan(odd).count() == odd.count() and pii.scan(none).count() == 0
    clean = pii.redact(odd.withColumn("text", F.when(F.col("doc_id") == 903, "mail a@b.cd, 1.2.3.4").otherwise(F.col("text"))))
    assert clean.columns == odd.columns and clean.count() == odd.count()
    assert clean.filter("doc_id = 903").first().text == "mail [EMAIL], [IP]"
    assert clean.filter("text IS NULL").count() == odd.filter("text IS NULL").count()


# 6 URL filters


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).selectExpr("concat('key', id) AS key")
    listed = universe.filter("key LIKE '%7'").union(spark.sql("SELECT CAST(NULL AS string)"))
    cascade = urlfilter.build(listed, universe)
    assert len(cascade.levels) > 1
    found = cascade.attach(universe, "w_").withColumn("in", cascade.member(F.col("key"), "w_"))
    assert found.filter("in <> (key LIKE '%7')").count() == 0
    empty = urlfilter.build(listed.limit(0), universe)
    assert empty.attach(universe, "w_").filter(empty.member(F.col("key"), "w_")).count() == 0
    with pytest.raises(ValueError):
        urlfilter.build(listed, universe, max_listed=3)


def test_url_awkward(spark):
    urls = [None, "", "nothing", "http://", "HTTPS://EXAMPLE.org/es/x?y#z", "http://example.org?x=/es/", "a://org", "a://org/", "a://xorg/", "a://b.org#/", "http://\u0130.ORG/en/1", "http://sub.example.org/en/1/2://x", "http://u.com/fr", "x://com/de/"]
    rows = spark.createDataFrame([(i, u, "old") for i, u in enumerate([*urls, urls[4]])], "page_id long, url string, host string")
    rules = spark.createDataFrame(queries.URL_RULES, "rule string, verdict string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(rows, rules).orderBy("page_id").collect()]

    def plain(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lowered(host)
        fits = [(r, v) for r, v in queries.URL_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
        return (host, path, *best)

    assert got == [(i, *plain(u)) for i, u in enumerate([*urls, urls[4]])]
    assert urlfilter.judge(rows.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(rows, rules.limit(0)).collect()} == {"allow"}


# 7 decontamination


def plain_contamination(docs: list[tuple], tests: list[tuple], window: int = 13) -> Counter:
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in tests:
        w = pattern.findall(lowered(text or ""))
        for i in range(max(1, len(w) - window + 1) if w and item is not None else 0):
            windows[tuple(w[i : i + window])].add(item)
    out = Counter()
    for doc_id, text in docs:
        w = pattern.findall(lowered(text or ""))
        hit, items = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        out[(doc_id, len(w), len(hit), tuple(sorted(items)), 0 < len(w) <= 20 * len(hit))] += 1
    return out


def collected(df) -> Counter:
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), r.contaminated) for r in df.collect())


def test_contamination(spark, small, texts, odd, none, monkeypatch):
    docs, tests = tables.read(spark, small, "documents"), tables.read(spark, small, "benchmark")
    items = [tuple(r) for r in tests.select("item_id", "text").collect()]
    want = plain_contamination(list(texts.items()), items)
    assert collected(decontamination.contamination(docs, tests)) == want and any(k[4] for k in want)
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 100)
    more = [*items, (1000, "one"), (1001, None), (None, "a b c d"), (1002, "a b c"), (1003, "!!"), (1003, "x"), (1004, texts[min(texts)])]
    odd_tests = spark.createDataFrame(more, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert collected(decontamination.contamination(odd, odd_tests)) == plain_contamination([r[:2] for r in odd_rows(texts)], more)
    assert decontamination.contamination(none, odd_tests).count() == 0
    assert decontamination.contamination(odd, odd_tests.limit(0)).filter("n_hit > 0").count() == 0
    kept = decontamination.without_contaminated(odd, odd_tests)
    assert kept.columns == odd.columns
    dirty = decontamination.contamination(odd, odd_tests).filter("contaminated").count()
    assert kept.count() == odd.count() - dirty > 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "a x x b x c"), (2, "a b"), (3, "c x x x x a b"), (4, "b c")], "doc_id long, text string")
    stored = decontamination.index(docs)
    named = decontamination.documents(stored)
    for words, within, want in ((["a", "b"], 1, {2, 3}), (["a", "b"], 3, {1, 2, 3}), (["a", "c"], 4, set()), (["a", "b", "c"], 6, {1, 3}), (["zz"], 3, set()), ([], 1, set())):
        hits = decontamination.near(stored, words, within).join(named, ["segment", "doc"])
        assert {r.doc_id for r in hits.collect()} == want


# 8 fingerprints


def test_likeness_estimates_jaccard():
    rng = random.Random(5)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(30):
            words = [str(rng.random()) for _ in range(1500)]
            other = words[: int(1500 * share)] + [str(rng.random()) for _ in range(1500 - int(1500 * share))]
            a, b = " ".join(words), " ".join(other)
            sa, sb = shingle_set(a), shingle_set(b)
            errors.append(fingerprints.likeness(*fingerprints.of_texts([a, b])) - len(sa & sb) / len(sa | sb))
        assert abs(np.mean(errors)) < 0.03 and max(map(abs, errors)) < 0.16


def test_small_sets_are_densified_alike():
    a, b = fingerprints.of_texts(["a b c d e f", "a b c d e f"])
    assert a == b and fingerprints.likeness(a, b) == 1
    assert fingerprints.likeness("", "") == 1 and fingerprints.likeness(a, "") == 0
    assert fingerprints.densified(np.array([], dtype=np.uint64)) is None


def test_unrelated_documents_have_little_noise():
    rng = random.Random(6)
    prints = fingerprints.of_texts([" ".join(str(rng.random()) for _ in range(400)) for _ in range(200)])
    assert np.sqrt(np.mean([fingerprints.likeness(a, b) ** 2 for a, b in zip(prints[::2], prints[1::2])])) < 0.008


def test_few_filled_bins_are_borrowed_evenly():
    rng = np.random.default_rng(7)
    shares = []
    for _ in range(200):
        some = rng.integers(0, 2**64, 4, dtype=np.uint64)
        kept = [fingerprints.densified(np.sort(x)) for x in (some[:3], some)]
        shares.append((kept[0] == kept[1]).mean())
    assert abs(np.mean(shares) - 0.75) < 0.01 and np.std(shares) < 0.05


def test_next_documents(spark, odd, none, texts):
    rows = [(i, t or "") for i, t, *_ in odd_rows(texts)]
    order = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.xxhash64("text")).orderBy("doc_id", "h").collect()
    want = Counter()
    for at, r in enumerate(order):
        following = order[(at + 1) % len(order)]
        n = len(r.text) // 4
        edited = r.text[: len(r.text) - n] + following.text[:n]
        want[(r.doc_id, len(r.text), hashlib.sha256(edited.encode()).hexdigest(), *fingerprints.of_texts([r.text, edited]))] += 1
    for parts in (1, 4, 30):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = fingerprints.with_next(odd).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert Counter(tuple(r)[:5] for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprints.with_next(none).count() == 0
    alone = fingerprints.with_next(odd.filter("doc_id = 906")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1
    assert fingerprints.fingerprint(odd.withColumn("fingerprint", F.lit(1))).count() == odd.count()


# 9 substrings


def plain_removal(docs: list[tuple]) -> Counter:
    seen, t = Counter(), substrings.THRESHOLD
    data = [(i, (text or "").encode()) for i, text in docs]
    for _, x in data:
        seen.update(x[j : j + t] for j in range(len(x) - t + 1))
    out = Counter()
    for i, x in data:
        gone = bytearray(len(x))
        for j in range(len(x) - t + 1):
            if seen[x[j : j + t]] > 1:
                gone[j : j + t] = b"\1" * t
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out[(i, len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    return out


def removal(df) -> Counter:
    return Counter(tuple(r) for r in df.drop("kept").collect())


def test_removal(spark, texts):
    rng = random.Random(11)
    passage = "".join(rng.choices("abcdef ", k=900))
    docs = [(i, texts[i]) for i in sorted(texts)[:20]]
    docs += [(1000 + n, "".join(rng.choices("xyz ", k=rng.randint(0, 300))) + passage[rng.randint(0, 300) : rng.randint(600, 900)] + "".join(rng.choices("xyz", k=rng.randint(0, 600)))) for n in range(40)]
    docs += [(2000, "ab" * 1000), (2001, "c" * 401), (2002, "d" * 400), (2003, passage[:400]), (2004, passage[500:899]), (2005, passage + passage), (2006, "\u00e9" * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert removal(substrings.remove(df)) == plain_removal(docs)


def test_removal_of_long_texts(spark, monkeypatch, texts):
    monkeypatch.setattr(substrings, "CHUNK", 700)
    long = " ".join(texts[i] for i in sorted(texts)[:15])
    data = np.frombuffer(long.encode(), np.uint8)
    pieces = [substrings.anchors_of(data)]
    cut = [tuple(np.concatenate(x)) for p in pieces for x in zip(*p)]
    monkeypatch.setattr(substrings, "CHUNK", 1 << 20)
    whole = [tuple(np.concatenate(x)) for x in zip(*substrings.anchors_of(data))]
    assert cut == whole


def test_removal_awkward(odd, none, texts):
    rows = [(i, t) for i, t, *_ in odd_rows(texts)]
    short = [(i, t) for i, t in rows if len(t or "") < 20_000]
    some = odd.filter("text IS NULL OR length(text) < 20000")
    assert removal(substrings.remove(some)) == plain_removal(short)
    assert substrings.remove(odd).count() == odd.count() and substrings.remove(none).count() == 0


def test_removal_of_planted_passages(spark):
    """Passages of over 50 words, each in two documents: their bytes decide, not their words."""
    rng = random.Random(13)

    def prose(n: int, size: int) -> str:
        return " ".join("".join(rng.choices("abcdefghij", k=size)) for _ in range(n))

    docs, lengths = [], {}
    for n_words, size in [(51, 5), (66, 5), (67, 5), (51, 7), (90, 6)]:  # 305, 395, 401, 407 and 629 bytes
        passage = prose(n_words, size)
        for side in "xy":  # the bytes beside the passage differ
            lengths[len(docs)] = len(passage)
            docs.append((len(docs), f"{prose(30, 6)}{side}{passage}{side}{prose(30, 6)}"))
    docs += [(100 + i, prose(150, 6)) for i in range(5)]
    found = substrings.remove(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).cache()
    assert removal(found) == plain_removal(docs)
    for row in found.collect():
        length = lengths.get(row.doc_id, 0)
        assert (row.n_removed, row.n_spans) == ((length, 1) if length >= substrings.THRESHOLD else (0, 0))
        assert row.n_bytes == len(dict(docs)[row.doc_id])  # of the input, whatever is removed


# 10 near duplicates


def plain_components(docs: list[tuple]) -> tuple[dict, int]:
    sets = {i: shingle_set(t) for i, t in docs}
    inverted, parent, links = defaultdict(list), {i: i for i in sets}, 0

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in sets.items():
        shared = Counter(j for g in x for j in inverted[g])
        for g in x:
            inverted[g].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(x) + len(sets[j]) - n):
                links += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}, links


def planted(rng: random.Random) -> list[tuple]:
    """Groups of near copies around the threshold, a large tight group and a shared passage."""
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    docs = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice((30, 80, 300)))]
        for _ in range(rng.randint(1, 5)):
            other = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                other[rng.randrange(len(other))] = word()
            docs.append(" ".join(other))
    base = [word() for _ in range(120)]
    docs += [" ".join(base[:i] + [word()] + base[i + 1 :]) for i in range(100)]
    passage = [word() for _ in range(40)]
    docs += [" ".join(passage + [word() for _ in range(20)]) for _ in range(60)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("small_node", [neardup.SMALL, 12])
def test_components(spark, monkeypatch, small_node):
    monkeypatch.setattr(neardup, "SMALL", small_node)  # 12: nodes branch, and the largest are cut in blocks
    docs = planted(random.Random(2))
    want, links = plain_components(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.clusters(df).collect()}
    assert got == want and links > 1000


def on_the_threshold(rng: random.Random, pairs: int = 100) -> list[tuple]:
    """Pairs of short texts, the second with a third more shingles: similar by exactly 0.75; each shares a line with others."""
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    line, docs = [word() for _ in range(6)], []
    for n in (3, 6, 9, 12, 45, 63):
        for at in range(pairs):
            longer = [word() for _ in range(n + n // 3 + 4)]
            if at % 2 and n > 9:
                longer[:6] = line
            docs += [" ".join(longer[: n + 4]), " ".join(longer)]
    return list(enumerate(docs))


@pytest.mark.parametrize("small_node", [neardup.SMALL, 12])
def test_small_sets_on_the_threshold(spark, monkeypatch, small_node):
    monkeypatch.setattr(neardup, "SMALL", small_node)
    docs = on_the_threshold(random.Random(4))
    want, links = plain_components(docs)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.clusters(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and links == len(docs) // 2


def test_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (7, 3)], "a long, b long")
    got = {r.rep: r.component for r in neardup.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_near_duplicates_awkward(spark, odd, none, texts):
    rows = [(i, t or "") for i, t, *_ in odd_rows(texts)]
    got = neardup.clusters(odd).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert by_id[900] == {(0, 900, True)} and by_id[902] == {(0, 902, True)}
    assert by_id[904] == {(1, 903, False)} and by_id[908] == {(len(shingle_set(rows[-3][1])), 907, False)}
    first = sorted(texts)[2]
    assert (0, None, True) in by_id[None] and any(c == first and not k for _, c, k in by_id[None])
    kept = neardup.one_of_each(odd)
    assert kept.columns == odd.columns and kept.filter(F.col("doc_id") == sorted(texts)[0]).count() == 1
    assert neardup.clusters(none).count() == 0 and neardup.one_of_each(none).count() == 0


# the pipeline


def test_pipeline_stages(spark, small, texts):
    docs = tables.read(spark, small, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = tables.stored(stage(spark, docs, small), f"test-{name}")
        assert docs.columns == columns
        kept[name] = ([tuple(r) for r in before.select("doc_id", "text").collect()], [tuple(r) for r in docs.select("doc_id", "text").collect()])
    labels = {r.doc_id: r.toxic for r in tables.read(spark, small, "labels").collect()}
    before, after = kept["toxicity"]
    assert not [i for i, _ in after if labels.get(i) == 1] and len(after) > 0.8 * len(before)
    assert {i for i, _ in before if labels.get(i) == 0} == {i for i, _ in after if labels.get(i) == 0}
    before, after = kept["near_duplicates"]
    assert sorted(i for i, _ in after) == sorted(i for i, (_, c) in plain_components(before)[0].items() if i == c)
    before, after = kept["decontamination"]
    items = [tuple(r) for r in tables.read(spark, small, "benchmark").select("item_id", "text").collect()]
    assert sorted(i for i, _ in after) == sorted(k[0] for k in plain_contamination(before, items) if not k[4])
    before, after = kept["pii"]
    assert sorted((i, pii.redacted(t, pii.find(t))) for i, t in before) == sorted(after)
    check_packing(corpus_pipeline.STAGES[-1][1](spark, docs, small).collect(), after)


def test_pipeline_on_empty_and_awkward_tables(spark, small, odd, none):
    wide = "doc_id", "text", "lang", "source", "n_chars"
    for docs in (none.select(*wide), odd.select(*wide)):
        for name, stage in corpus_pipeline.STAGES:
            docs = tables.stored(stage(spark, docs, small), f"awkward-{name}")
    assert docs.count() > 0
