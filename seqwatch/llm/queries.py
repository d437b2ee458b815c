"""The registered queries of this package, and SQL where SQL can express them."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seqwatch.llm import (
    bytebpe, conversations, decontamination, fingerprints, importance, neardup, packing, periodic, pii, substrings, tables, toxicity, urlfilter, warc,
)

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Fixed rules of the URL query.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]


def query(fn: Query) -> Query:
    ALL[fn.__name__] = fn
    return fn


def tokenizer_path() -> str:
    """The public vocabulary file; ``SEQWATCH_TOKENIZER`` names another."""
    given = os.environ.get("SEQWATCH_TOKENIZER")
    return given or importlib.import_module("public_tokenizers").path("word_bpe_49k.json")


#: The chain of the toxicity query, over the label columns there are.
CATEGORIES = [toxicity.Category("low_quality", "quality", 0), toxicity.Category("toxic", "toxic", 1, kept=512)]


@query
def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "labels")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, labels, CATEGORIES))
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= 0.5).alias("toxic"))


@query
def op2_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.archive(tables.read(spark, sf_dir, "pages"))
    return warc.read_pages(spark, path).drop("target_uri")


SQL["op2_warc_roundtrip"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query
def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = tables.read(spark, sf_dir, "labels").filter("quality = 1")
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, importance.marked(docs, good), F.col("target_"))


@query
def op4_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(tables.read(spark, sf_dir, "documents"), tokenizer_path())


def span_list(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op5_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan(tables.read(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *map(count, pii.BASE_KINDS),
        F.sha2(span_list(base), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


@query
def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    judged = urlfilter.judge(tables.read(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


SQL["op6_url_cascade"] = r"""
WITH u AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest
  FROM pages
), h AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rule, rule_host, rule_path, rule_verdict) AS (
  VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
         ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
         ('com/de/', 'com', '/de/', 'block')
)
SELECT page_id, any_value(host) AS host, any_value(path) AS path, arg_max(rule, length(rule)) AS rule,
       coalesce(arg_max(rule_verdict, length(rule)), 'allow') AS verdict
FROM h LEFT JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
GROUP BY page_id
"""


@query
def op7_benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tests = tables.read(spark, sf_dir, "documents"), tables.read(spark, sf_dir, "benchmark")
    found = decontamination.contamination(docs, tests)
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256"), "contaminated"
    )


@query
def op8_oph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_next(tables.read(spark, sf_dir, "documents"))


@query
def op9_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove(tables.read(spark, sf_dir, "documents")).drop("kept")


@query
def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.clusters(tables.read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with fixed faults by the hash of ``conv_id:turn``; ``here_`` is false for dropped rows."""
    cells = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    fault = F.crc32(F.concat_ws(":", *cells)) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    changed = rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault != 0).alias("here_"),
        F.when(fault == 3, 2).otherwise(1).alias("copies_"),
    )
    return changed.withColumn("copies_", F.explode(F.array_repeat(F.lit(0), F.col("copies_")))).drop("copies_")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audits(damaged(tables.read(spark, sf_dir, "conversations")), F.col("here_"))


def planted(docs: DataFrame) -> DataFrame:
    """Documents of which a tenth, by the hash of the id, go on periodically from some word."""
    hashed = F.crc32(F.col("doc_id").cast("string"))  # null stays as it is
    rest = F.floor(hashed / 10)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def periodic_from(w: Column) -> Column:
        n = F.size(w)
        first = rest % n
        period = 1 + F.floor((n - first) / (3 + rest % 8))
        return F.transform(w, lambda word, i: F.when(i < first, word).otherwise(F.get(w, (first + (i - first) % period).cast("int"))))

    # The words are bound by a lambda, so that they are split once, not for each use.
    text = F.array_join(F.flatten(F.transform(F.array(words), periodic_from)), " ")
    return docs.select("doc_id", F.when(hashed % 10 == 0, text).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(planted(tables.read(spark, sf_dir, "documents").select("doc_id", "text")))
    top = F.col("greatest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "greatest.*",
        F.floor(1000 * top["length"] / top["period"]).alias("exponent_milli"),
        F.sha2(periodic.run_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def ranks_path() -> str:
    """The public rank file; ``SEQWATCH_RANKS`` names another."""
    given = os.environ.get("SEQWATCH_RANKS")
    return given or importlib.import_module("public_tokenizers").path("byte_bpe_multi_50k.tiktoken")


@query
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = ranks_path(), importlib.import_module("public_tokenizers").PATTERN
    tokens = bytebpe.encode(tables.read(spark, sf_dir, "documents"), *vocabulary)
    decoded = bytebpe.decode(tokens, *vocabulary)
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
    )
