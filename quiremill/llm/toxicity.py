"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text, each present or not: its words (runs of letters, lower-cased), its pairs of
neighbouring words, its pairs with one word between (skip-grams), and the words' first five letters,
all as 32-bit hashes. Training takes a bounded sample of labelled rows (``per_class`` rows a class,
``most_features`` features in all; weights restore the classes' true shares) to the driver and runs
FTRL-proximal there: per-coordinate rates, and L1 that leaves a few hundred weights other than zero.
These go to the tasks, and scoring is one scan without a shuffle over every whole text.

Defined results: null and empty texts, and texts without letters, get the score of the intercept;
rows labelled twice count as toxic if any label says so; null labels are ignored; without rows of
both classes every score is 0 (only clean labels, or none) or 1; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiremill.llm._common import sliced
from quiremill.llm.bpe import Memo

_LETTERS = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Features:
    """Texts to sorted arrays of distinct 32-bit feature hashes, many texts at a time."""

    def __init__(self):
        import xxhash

        h = xxhash.xxh64_intdigest
        self.words = Memo(lambda w: (h(w, 1), h(w[:5], 2)), 150_000)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, their text's number); a feature may come more than once in a text."""
        found, counts = [], []
        for t in texts:
            words = _LETTERS.findall(t.lower()) if t else []
            found += map(self.words.__getitem__, words)
            counts.append(len(words))
        if not found:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        word, head = np.array(found, np.uint64).T
        text = np.repeat(np.arange(len(texts)), counts)
        parts, at = [word, head], [text, text]
        for gap, seed in ((1, 3), (2, 5)):
            same = text[gap:] == text[:-gap]
            parts.append(((word[:-gap] * _MIX + np.uint64(seed)) ^ (word[gap:] >> np.uint64(7)))[same])
            at.append(text[gap:][same])
        return ((np.concatenate(parts) * _MIX) >> np.uint64(32)).astype(np.uint32), np.concatenate(at)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, size: int, epochs: int = 8, alpha: float = 1.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.5) -> np.ndarray:
    """Weights for coordinates 0 to size - 1; rows hold the coordinates that are 1."""
    z, n = np.zeros(size), np.zeros(size)

    def current(i):
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i = rows[k]
            w = current(i)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
            g = (p - labels[k]) * weights[k]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return current(np.arange(size))


class Model:
    """Intercept and the weights that are not zero, by 32-bit hash."""

    def __init__(self, intercept: float, keys: np.ndarray, weights: np.ndarray):
        self.intercept, self.keys, self.weights = float(intercept), keys, weights
        self._maybe = None

    def __getstate__(self):
        return {"intercept": self.intercept, "keys": self.keys, "weights": self.weights, "_maybe": None}

    def scores(self, features: Features, texts: list[str | None]) -> np.ndarray:
        total = np.full(len(texts), self.intercept)
        if len(self.keys):
            if self._maybe is None:
                self._maybe = np.zeros(1 << 22, bool)
                self._maybe[self.keys >> np.uint32(10)] = True
            hashes, text = features.of(texts)
            some = self._maybe[hashes >> np.uint32(10)]
            hashes, text = hashes[some], text[some]
            at = np.searchsorted(self.keys, hashes)
            hit = self.keys[np.minimum(at, len(self.keys) - 1)] == hashes
            pairs = np.unique(np.stack([text[hit], at[hit]]), axis=1)
            np.add.at(total, pairs[0], self.weights[pairs[1]])
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2500, most_features: int = 12_000_000, seed: int = 11) -> Model:
    """Learn from labelled rows: ``labels`` (doc_id, toxic), all of which may be learned from."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return Model(35.0 if 1 in counts else -35.0, np.empty(0, np.uint32), np.empty(0))
    scale = 1 << 40
    order = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(scale))
    below = F.when(F.col("toxic") == 1, F.lit(min(scale, scale * per_class // counts[1]))).otherwise(F.lit(min(scale, scale * per_class // counts[0])))
    chosen = known.withColumn("at", order).where(F.col("at") < below).orderBy("at").limit(4 * per_class)  # about 2 * per_class rows: a proven bound for the broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches):
        import pyarrow as pa

        features = Features()
        for b in sliced(batches, 64):
            hashes, text = features.of(b.column(1).to_pylist())
            each = [np.unique(hashes[text == k]).tobytes() for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array(each, pa.binary())], ["at", "toxic", "features"])

    table = texts.select("doc_id", "text", "at", "toxic").mapInArrow(run, "at long, toxic int, features binary").toArrow().sort_by([("at", "ascending"), ("toxic", "ascending")])
    rows, y, total = [], [], 0
    for x, label in zip(table["features"], table["toxic"].to_pylist(), strict=True):
        one = np.frombuffer(x.as_buffer(), np.uint32)
        if rows and total + len(one) > most_features:
            continue
        total += len(one)
        rows.append(one)
        y.append(label)
    if len(set(y)) < 2:
        return Model(35.0 if 1 in y else -35.0, np.empty(0, np.uint32), np.empty(0))
    y = np.array(y, float)
    keys, times = np.unique(np.concatenate(rows), return_counts=True)
    keys = keys[times >= 2]
    rows = [np.append(at[keys[np.minimum(at, len(keys) - 1)] == r] if len(keys) else at[:0], len(keys)) for r in rows for at in [np.searchsorted(keys, r)]]
    share = counts[1] / (counts[0] + counts[1])
    weight = np.where(y == 1, share * len(y) / y.sum(), (1 - share) * len(y) / (len(y) - y.sum()))
    w = ftrl(rows, y, weight, len(keys) + 1)
    used = np.flatnonzero(w[:-1])
    return Model(w[-1], keys[used], w[used])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of every document."""

    def run(batches):
        import pyarrow as pa

        features = Features()
        for b in sliced(batches):
            p = model.scores(features, b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def classified(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Every document scored by a model of the labelled rows outside the held-out fold (crc32 of the id's text mod 5 = 0)."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = fit(docs, labels.where(fold != 0), **options)
    return scored(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")
