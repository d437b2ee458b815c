"""From raw documents to packed sequences, stage by stage.

``STAGES`` lists (name, function). A function takes the session, the documents its predecessor
kept and the folder of the tables, and returns a DataFrame; it is written as Parquet and read
back as the next one's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqwatch.llm import decontamination, neardup, packing, pii, queries, tables, toxicity

#: A document is rejected from this probability of the toxic category on.
TOXIC_FROM = 0.5


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier chain, fitted on the labelled ones among all documents, calls toxic."""
    labels = tables.read(spark, sf_dir, "labels")
    chain = toxicity.fit(tables.read(spark, sf_dir, "documents"), labels, queries.CATEGORIES)
    scored = toxicity.score(docs, chain)
    return scored.filter(F.col("p_toxic") < TOXIC_FROM).select(docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of every group of near duplicates."""
    return neardup.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the benchmark's windows cover to a twentieth or more."""
    return decontamination.without_contaminated(docs, tables.read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts by its kind; ``n_chars`` follows the new text."""
    clean = pii.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: A fitted chain and token ids are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents table; each ends in a stored table."""
    docs = tables.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tables.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
