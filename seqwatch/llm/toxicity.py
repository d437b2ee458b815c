"""Toxicity by a classifier chain.

Categories are predicted one after the other. Each has a linear (logistic) model over hashed
words and word beginnings plus the probabilities of the categories before it. While fitting,
those probabilities are out-of-fold: a row's value comes from a model that has not seen the
row, so later models learn from inputs as uncertain as those they get when scoring.

The fit uses at most ``MAX_ROWS`` labelled rows, chosen by the hash of their id; the folds of
one category are fitted by parallel tasks. Models have ``FEATURES`` weights each, so what
scoring ships to tasks does not grow with the corpus. Scoring reads every whole text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from seqwatch.llm import kernels, tables

FEATURES = 1 << 17
MAX_ROWS = 12_000
FOLDS = 4
KEPT_FEATURES = 4096
LEAST_DOCS = 4
PREFIXES = (6, 7)
STEPS = 250
RIDGE = 5e-4

#: Letters and digits of any script; the rest parts words.
LETTERS = kernels.byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


@dataclass(frozen=True)
class Category:
    """``name`` is predicted; a row is positive where the label ``column`` equals ``value``.

    Its model takes the ``kept`` features that depend most on it: a few for a matter of some
    words, more for one of style.
    """

    name: str
    column: str
    value: int = 1
    kept: int = KEPT_FEATURES


@dataclass(frozen=True)
class Link:
    """One model of the chain. Weights of earlier categories follow in their order."""

    name: str
    bias: float
    weights: np.ndarray
    earlier: np.ndarray


@dataclass(frozen=True)
class Chain:
    links: tuple[Link, ...]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, feature) pairs, sorted: whole words and their first bytes, hashed."""
    starts, ends, counts = kernels.words(data, offsets, LETTERS)
    docs = np.repeat(np.arange(len(counts)), counts)
    found = [(docs, kernels.word_hashes(data, starts, ends))]
    for n in PREFIXES:
        longer = ends - starts > n
        hashes = kernels.word_hashes(data, starts[longer], ends[longer], longest=n)
        found.append((docs[longer], hashes ^ np.uint64(n)))
    doc = np.concatenate([d for d, _ in found]).astype(np.int64)
    slot = (np.concatenate([kernels.mix(h) for _, h in found]) % np.uint64(FEATURES)).astype(np.int64)
    pairs = np.unique(doc * FEATURES + slot)
    return pairs // FEATURES, pairs % FEATURES


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_logistic(row: np.ndarray, col: np.ndarray, dense: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = STEPS, most: int = KEPT_FEATURES) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, feature weights and dense weights of a ridge logistic model, classes weighted equally.

    Only the ``most`` features that depend most on the label (chi-square, in at least
    ``LEAST_DOCS`` rows) take part. One class alone gives a constant.
    """
    n, n_dense = len(y), dense.shape[1]
    weights, positive = np.zeros(FEATURES), y.sum()
    if not 0 < positive < n:
        return (30.0 if positive else -30.0), weights, np.zeros(n_dense)
    seen = np.bincount(col, minlength=FEATURES)
    hits = np.bincount(col, weights=y[row], minlength=FEATURES)
    expected = seen * (positive / n)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where(seen >= LEAST_DOCS, (hits - expected) ** 2 / (expected * (1 - seen / (n + 1))), 0.0)
    kept = np.sort(np.argsort(-chi, kind="stable")[:most])
    kept = kept[chi[kept] > 0]
    place = np.full(FEATURES, -1)
    place[kept] = np.arange(len(kept))
    inside = place[col] >= 0
    row, col = row[inside], place[col[inside]]
    sample = np.where(y > 0, 0.5 / positive, 0.5 / (n - positive))
    theta = np.zeros(1 + len(kept) + n_dense)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):  # Adam on the whole sample: a fixed number of passes
        margin = theta[0] + np.bincount(row, weights=theta[1 + col], minlength=n) + dense @ theta[1 + len(kept) :]
        error = sample * (sigmoid(margin) - y)
        grad = np.concatenate([[error.sum()], np.bincount(col, weights=error[row], minlength=len(kept)), dense.T @ error])
        grad[1:] += ridge * theta[1:]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weights[kept] = theta[1 : 1 + len(kept)]
    return float(theta[0]), weights, theta[1 + len(kept) :]


def training_rows(docs: DataFrame, labels: DataFrame, categories: list[Category], max_rows: int = MAX_ROWS) -> DataFrame:
    """``id, fold, y0.., slots``: at most ``max_rows`` labelled rows, by the order of the hash of their id.

    Rows with a null id, text or label are left out; of repeated labels of an id the largest
    counts, and of repeated documents one.
    """
    wanted = labels.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        *(F.max((F.col(c.column) == c.value).cast("int")).alias(f"y{i}") for i, c in enumerate(categories))
    )
    wanted = wanted.dropna().withColumn("order_", F.xxhash64("doc_id"))
    wanted = wanted.orderBy("order_", "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    some = texts.join(F.broadcast(wanted), "doc_id").dropDuplicates(["doc_id"])  # bounded by max_rows
    targets = [f"y{i}" for i in range(len(categories))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in kernels.blocks(batch):
                part = batch.slice(start, end - start)
                doc, slot = features(data, offsets)
                bounds = np.searchsorted(doc, np.arange(end - start + 1))
                slots = [slot[bounds[i] : bounds[i + 1]].astype("<i4").tobytes() for i in range(end - start)]
                columns = [part.column(c) for c in ("doc_id", "fold", *targets)]
                yield pa.record_batch([*columns, pa.array(slots, pa.binary())], names=["id", "fold", *targets, "slots"])

    keyed = some.select(F.col("doc_id").cast("long"), F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold"), *targets, "text")
    return keyed.mapInArrow(run, "id long, fold int, " + ", ".join(f"{t} int" for t in targets) + ", slots binary")


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    slots = [np.frombuffer(s, dtype="<i4") for s in pdf["slots"]]
    rows = np.repeat(np.arange(len(slots)), [len(s) for s in slots])
    return rows, np.concatenate(slots) if slots else np.zeros(0, dtype=np.int64)


def _fold_task(i: int, kept: int = KEPT_FEATURES):
    """Fit category ``i`` without the fold of the key (none left out: -1) and predict that fold."""
    earlier = [f"p{j}" for j in range(i)]

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left_out = key[0]
        pdf = pdf.sort_values("id")
        out = (pdf["fold"] == left_out).to_numpy()
        y, dense = pdf[f"y{i}"].to_numpy(float), pdf[earlier].to_numpy(float)
        row, col = _matrix(pdf[~out])
        bias, weights, more = fit_logistic(row, col, dense[~out], y[~out], most=kept)
        if left_out < 0:
            model = np.concatenate([[bias], more, weights]).astype("<f4").tobytes()
            return pd.DataFrame({"id": [None], "p": [None], "model": [model]}, dtype=object)
        row, col = _matrix(pdf[out])
        p = sigmoid(bias + np.bincount(row, weights=weights[col], minlength=out.sum()) + dense[out] @ more)
        return pd.DataFrame({"id": pdf["id"][out].tolist(), "p": p, "model": [None] * len(p)}, dtype=object)

    return one


def fit(docs: DataFrame, labels: DataFrame, categories: list[Category], max_rows: int = MAX_ROWS) -> Chain:
    """Fit the chain. Without any labelled row every model is a constant 0.

    Each category takes one round of ``FOLDS + 1`` tasks: one model per fold, applied to the
    rows left out of it, and one of all rows, which is kept.
    """
    rows = tables.stored(training_rows(docs, labels, categories, max_rows), "toxicity-rows")
    links: list[Link] = []
    for i, category in enumerate(categories):
        folds = F.explode(F.array(*(F.lit(f) for f in range(-1, FOLDS)))).alias("left_out")
        fitted = rows.select("*", folds).groupBy("left_out").applyInPandas(_fold_task(i, category.kept), "id long, p double, model binary")
        fitted = tables.stored(fitted, "toxicity-fold")
        model = fitted.filter("model IS NOT NULL").select("model").collect()
        numbers = np.frombuffer(model[0][0], dtype="<f4").astype(float) if model else np.zeros(1 + i + FEATURES)
        bias = numbers[0] if model else -30.0
        links.append(Link(category.name, float(bias), numbers[1 + i :].astype(np.float32), numbers[1 : 1 + i]))
        if i + 1 < len(categories):
            held_out = fitted.filter("id IS NOT NULL").select("id", F.col("p").alias(f"p{i}"))
            rows = tables.stored(rows.join(held_out, "id"), "toxicity-rows")
    return Chain(tuple(links))


def probabilities(chain: Chain, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per link, the probability of each document; those of earlier links feed the later ones."""
    doc, slot = features(data, offsets)
    found: list[np.ndarray] = []
    for link in chain.links:
        margin = np.bincount(doc, weights=link.weights[slot], minlength=len(offsets) - 1) + link.bias
        for weight, p in zip(link.earlier, found):
            margin = margin + weight * p
        found.append(sigmoid(margin))
    return found


def score(docs: DataFrame, chain: Chain) -> DataFrame:
    """All rows and columns, with a probability ``p_<name>`` per category (replacing such columns).

    Null and empty texts have no words and get the models' base rates.
    """
    names = [f"p_{link.name}" for link in chain.links]
    docs = docs.drop(*names)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(chain)  # FEATURES floats per category

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end, data, offsets in kernels.blocks(batch):
                part = batch.slice(start, end - start)
                found = probabilities(shared.value, data, offsets)
                yield pa.record_batch([*part.columns, *(pa.array(p) for p in found)], names=[*part.schema.names, *names])

    added = [StructField(name, DoubleType()) for name in names]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *added]))
