"""Quality classifier: random-indexing word vectors, pooled for each document, then a two-layer network.

A word's vector has two halves. Its context half is the sum of sparse random index vectors of the words within SPAN
places of it, over the sample that the model is fitted on; its form half is the sum of index vectors of its shape,
ending and length, so that words never seen before have one too. A document is the mean over all its words, with its
logarithmic length. The network has one hidden layer and a temperature fitted on documents that it has not learned from.

Fitting takes at most SAMPLE labelled documents (a documented bound, chosen by a hash of the id); every document is
scored over its whole text. Labels, lang, source and doc_id are no inputs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, table

#: Labelled documents that fitting takes at most, and words with a context half.
SAMPLE, VOCABULARY = 4000, 20_000
DIM, NONZERO, SPAN, HIDDEN, EPOCHS = 32, 4, 2, 24, 40
FOLDS, HELD_OUT = 3, 1
#: Words whose row a worker remembers, at most.
REMEMBERED = 150_000
_SHAPE = [(re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[B-Z]A*[B-ZA]*|A[A-Z]*"), b"A"), (re.compile(rb"[0-9]+"), b"0"), (re.compile(rb"([^aA0])\1+"), rb"\1\1")]


def index_vector(name: bytes) -> np.ndarray:
    """A sparse vector of +1 and -1 that depends on the name alone."""
    import xxhash

    v, h = np.zeros(DIM, np.float32), xxhash.xxh64_intdigest(name, 9)
    for k in range(NONZERO):
        part = h >> 16 * k & 0xFFFF
        v[part >> 1 & DIM - 1] += 1 if part & 1 else -1
    return v


def shape(word: bytes) -> bytes:
    for pattern, to in _SHAPE:
        word = pattern.sub(to, word)
    return word[:12]


@dataclass
class Words:
    """Vectors of words, made when first met."""

    context: dict[bytes, np.ndarray]
    rows: dict[bytes, int] = field(default_factory=dict)
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((1024, 2 * DIM), np.float32))
    parts: dict[bytes, np.ndarray] = field(default_factory=dict)

    def _part(self, name: bytes) -> np.ndarray:
        if (v := self.parts.get(name)) is None:
            if len(self.parts) > REMEMBERED:
                self.parts.clear()
            v = self.parts[name] = index_vector(name)
        return v

    def row(self, word: bytes) -> int:
        k = self.rows.get(word)
        if k is None:
            k = self.rows[word] = len(self.rows)
            if k >= len(self.vectors):
                self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
            if (c := self.context.get(word)) is None:
                self.vectors[k, :DIM] = 0
            else:
                self.vectors[k, :DIM] = c
            self.vectors[k, DIM:] = self._part(b"s" + shape(word)) + self._part(b"e" + word[-2:]) + self._part(b"n%d" % min(len(word), 24))
        return k

    def pooled(self, text: bytes) -> np.ndarray:
        """Mean of the vectors of all words, logarithm of their number, share of distinct ones."""
        counts = Counter(text.split())
        out, n = np.zeros(2 * DIM + 2, np.float32), sum(counts.values())
        if n:
            if len(self.rows) + len(counts) > max(REMEMBERED, len(counts)):
                self.rows.clear()
            rows = np.fromiter(map(self.row, counts), np.int64, len(counts))
            weights = np.fromiter(counts.values(), np.float32, len(counts))
            total = np.zeros(2 * DIM, np.float64)
            for at in range(0, len(rows), 4096):
                total += weights[at : at + 4096] @ self.vectors[rows[at : at + 4096]]
            out[: 2 * DIM] = total / n
            out[2 * DIM :] = math.log1p(n), len(counts) / n
        return out


def context_vectors(texts: list[bytes]) -> dict[bytes, np.ndarray]:
    """Random indexing: of each frequent word, the normed sum of its neighbours' index vectors."""
    counts = Counter(w for t in texts for w in t.split())
    names = [w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]]
    number = {w: i for i, w in enumerate(names)}
    index = np.array([index_vector(b"w" + w) for w in names] + [np.zeros(DIM, np.float32)])
    gap = [len(names)] * SPAN
    ids = np.array([k for t in texts for k in [*(number.get(w, len(names)) for w in t.split()), *gap]], np.int64)
    out = np.zeros((len(names) + 1, DIM))
    for step in range(1, SPAN + 1):
        for here, there in ((ids[:-step], ids[step:]), (ids[step:], ids[:-step])):
            for d in range(DIM):
                out[:, d] += np.bincount(here, index[there, d], len(names) + 1)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return {w: out[i].astype(np.float32) for w, i in number.items()}


@dataclass
class Model:
    context: dict[bytes, np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit(texts: list[bytes], labels: list[int], seed: int = 7) -> Model:
    """A model from labelled texts; with a single class it gives that class's smoothed share everywhere."""
    y = np.array(labels, np.float64)
    context = context_vectors(texts)
    words = Words(context)
    x = np.array([words.pooled(t) for t in texts], np.float64).reshape(len(texts), 2 * DIM + 2)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(y) else (np.zeros(2 * DIM + 2), np.ones(2 * DIM + 2))
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1)]
    share = (y.sum() + 1) / (len(y) + 2)
    layers[3][:] = math.log(share / (1 - share))
    model = Model(context, mean, scale, layers, 1.0)
    if len(set(labels)) < 2 or len(y) < 10:
        return model
    layers[2][:] = rng.normal(0, 1 / math.sqrt(HIDDEN), HIDDEN)
    order = rng.permutation(len(y))
    apart, own = order[: len(y) // 5], order[len(y) // 5 :]
    z, first, second, step = (x - mean) / scale, [0 * a for a in layers], [0 * a for a in layers], 0
    for _ in range(EPOCHS):
        for at in range(0, len(own), 64):
            rows = rng.permutation(own)[:64] if at + 64 > len(own) else own[at : at + 64]
            w1, b1, w2, b2 = layers
            h = np.tanh(z[rows] @ w1 + b1)
            err = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - y[rows]) / len(rows)
            back = err[:, None] * w2 * (1 - h * h)
            step += 1
            for i, g in enumerate((z[rows].T @ back + 1e-4 * w1, back.sum(0), h.T @ err + 1e-4 * w2, err.sum(keepdims=True))):
                first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
                layers[i] -= 0.01 * first[i] / (1 - 0.9**step) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        rng.shuffle(own)
    logits, target = model.logits(x[apart]), y[apart]

    def loss(t: float) -> float:
        return float(np.logaddexp(0, -np.where(target == 1, 1, -1) * logits / t).mean())

    model.temperature = min(np.geomspace(0.5, 8, 61).tolist(), key=loss)
    return model


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[tuple[bytes, int]]:
    """At most `sample` texts with their labels, from the folds that may be learned from."""
    ids = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
        .groupBy("doc_id").agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    rows = docs.select("doc_id", text).join(F.broadcast(ids), "doc_id")  # at most `sample` rows
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).collect()
    return [(bytes(r["text"]), r["quality"]) for r in sorted(rows, key=lambda r: r["doc_id"])]


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    rows = labelled(docs, labels)
    return fit([t for t, _ in rows], [q for _, q in rows])


def scorer(spark: SparkSession, model: Model):
    """A function from a text column to the probability of label 1; null texts count as empty."""
    shared = spark.sparkContext.broadcast(model)  # at most VOCABULARY words
    state: list[Words] = []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not state:
            state.append(Words(shared.value.context))
        x = np.array([state[0].pooled(t or b"") for t in texts.to_pylist()], np.float64).reshape(len(texts), 2 * DIM + 2)
        return pa.array(shared.value.probabilities(x))

    def of(text: Column) -> Column:
        return score(text.cast("string").cast("binary"))

    return of


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row; no exchange.

    Empty and null texts get the network's answer to no words; repeated rows are scored each; a null doc_id is in no
    fold, so not held out; an empty table gives no rows; columns other than doc_id and text are ignored.
    """
    rows = docs.select("doc_id", scorer(docs.sparkSession, model)(F.col("text")).alias("score"))
    held = F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they were, with a score of at least 0.5."""
    score = scorer(docs.sparkSession, model)(F.col("_row.text"))
    return docs.select(F.struct(*docs.columns).alias("_row")).withColumn("_score", score).where("_score >= 0.5").select("_row.*")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fitted(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op9_quality_classifier": op9_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
