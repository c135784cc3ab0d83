"""Toxicity by a chain of linear classifiers.

The categories have an order. Each category's model is logistic in how often selected words, and words with selected
beginnings, occur in a document, and in the probabilities that the models before it give. The later models are trained
with out-of-fold probabilities of the earlier ones, so that they see them as they are on unseen documents. The last
category is the given label. Those before it are kinds of toxicity that the labelled toxic documents themselves fall
into: clusters of them by the features that they have.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import map_text, materialize, worker_state

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Kinds of toxicity that are told apart, the largest first, and the label at the chain's end.
KINDS = 3
CATEGORIES = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")

#: Bounds of training: labelled rows, features kept, and rows that must hold a feature.
TRAIN_ROWS, FEATURES, LEAST_ROWS = 8_000, 256, 4
#: Lengths of the beginnings of words that are features, in characters.
BEGINNINGS = range(3, 9)
#: A feature is full at this share of a document's words, and present from a fifth of it.
FULL = 0.01
#: Distinct words whose features a worker remembers.
CACHE_WORDS = 100_000
FOLDS, PENALTY, CUT = 3, 0.1, 0.5


class Chain(NamedTuple):
    features: dict[bytes, int]
    #: per category: intercept, weights of the features, weights of the earlier categories' probabilities
    weights: list[np.ndarray]


def word_features(word: bytes) -> list[bytes]:
    """The word itself, marked with =, and its beginnings; a very long word has only its beginnings."""
    text = word.decode("utf-8", "replace")
    return ([b"=" + word] if len(word) <= 64 else []) + [text[:k].encode() for k in BEGINNINGS if len(text) > k]


def shares(text: bytes) -> dict[bytes, float]:
    """Every feature's share of a document's words, as a part of FULL, at most 1; A-Z in lower case."""
    words = WORD.findall(text.lower())
    count: Counter = Counter()
    for w, n in Counter(words).items():
        for f in word_features(w):
            count[f] += n
    return {f: min(1.0, n / (FULL * len(words))) for f, n in count.items()}


class Features:
    """The selected features of documents as rows of numbers, with what each word gives remembered."""

    def __init__(self, chosen: dict[bytes, int]):
        self.chosen, self.known = chosen, {}

    def row(self, text: bytes) -> np.ndarray:
        out = np.zeros(len(self.chosen))
        words = WORD.findall(text.lower())
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in words:
            at = known.get(w)
            if at is None:
                at = tuple(self.chosen[f] for f in word_features(w) if f in self.chosen)
                if len(w) <= 64:
                    known[w] = at
            for i in at:
                out[i] += 1
        return np.minimum(1.0, out / (FULL * len(words))) if words else out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a ridge penalty by Newton steps; the intercept, which is first, is not penalised."""
    if not y.any() or y.all():
        w = np.zeros(x.shape[1] + 1)
        w[0] = 12.0 if len(y) and y.all() else -12.0
        return w
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    ridge = np.full(a.shape[1], PENALTY)
    ridge[0] = 1e-6
    w = np.zeros(a.shape[1])
    w[0] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(25):
        p = sigmoid(a @ w)
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w = w + step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def kinds_of(x: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Rows by kinds: which cluster each toxic row is in, by cosine; the first centres are the row nearest to the mean
    and those farthest from the centres before them. Kinds come by size, and may be empty."""
    out = np.zeros((len(x), KINDS), bool)
    rows = x[toxic] / np.maximum(np.linalg.norm(x[toxic], axis=1, keepdims=True), 1e-12)
    if not len(rows):
        return out
    centres = rows[[int((rows @ rows.mean(axis=0)).argmax())]]
    while len(centres) < KINDS:
        centres = np.concatenate([centres, rows[[int((rows @ centres.T).max(axis=1).argmin())]]])
    for _ in range(20):
        kind = (rows @ centres.T).argmax(axis=1)
        sums = np.array([rows[kind == k].sum(axis=0) for k in range(KINDS)])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        new = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
        if np.allclose(new, centres):
            break
        centres = new
    kind = (rows @ centres.T).argmax(axis=1)
    order = np.argsort(-np.bincount(kind, minlength=KINDS), kind="stable")
    out[np.flatnonzero(toxic), np.argsort(order)[kind]] = True
    return out


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[np.ndarray]:
    """The models of the chain: x is rows by words, labels rows by categories, fold the part of each row."""
    weights = []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        weights.append(fit(x, y))
        unseen = np.zeros(len(x))
        for f in range(FOLDS):
            own = fold == f
            w = fit(x[~own], y[~own])
            unseen[own] = sigmoid(w[0] + x[own] @ w[1:])
        x = np.concatenate([x, unseen[:, None]], axis=1)
    return weights


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Chain:
    """Fit the chain on at most TRAIN_ROWS labelled documents, those with the smallest hash of the key.

    The features are those FEATURES with the largest chi-squared statistic of presence against the label, among
    features that LEAST_ROWS sampled documents have. Rows with a null key, label or text are not used; a key that is
    labelled more than once is toxic if it is so once.
    """
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).cast("bigint").alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    chosen = chosen.orderBy(F.xxhash64("k"), "k").limit(TRAIN_ROWS)
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("binary").alias("t"))
    # broadcast: at most TRAIN_ROWS pairs of numbers; of a key with several texts the longest counts
    one = F.max_by("t", F.struct(F.octet_length("t"), F.xxhash64("t"))).alias("t")
    rows = materialize(texts.join(F.broadcast(chosen), "k").groupBy("k").agg(one, F.max("y").alias("y")))  # in as many files as there are tasks, as each row takes long
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("pos")).first()
    n, pos = total.n, total.pos
    if not n:
        return Chain({}, [np.array([-12.0, *np.zeros(c)]) for c in range(len(CATEGORIES))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            rows_of: Counter = Counter()
            toxic: Counter = Counter()
            for raw, y in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                present = [f for f, v in shares(raw).items() if v >= 0.2]
                rows_of.update(present)
                if y:
                    toxic.update(present)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows_of), pa.binary()), pa.array(list(rows_of.values()), pa.int64()), pa.array([toxic[f] for f in rows_of], pa.int64())], ["f", "n", "pos"])

    counts = rows.select("t", "y").mapInArrow(count, "f binary, n bigint, pos bigint").groupBy("f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(F.col("n") >= LEAST_ROWS)
    gap = F.col("pos") * float(n - pos) - (F.col("n") - F.col("pos")) * float(pos)
    counts = counts.withColumn("chi", gap * gap / (F.col("n") * (F.lit(float(n)) - F.col("n")) + 1e-9))
    features = {bytes(r.f): i for i, r in enumerate(counts.orderBy(F.desc("chi"), "f").limit(FEATURES).collect())}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen_features = Features(features)
        for x in batches:
            v = [chosen_features.row(t).astype(np.float32) for t in x.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(2), pa.array(v, pa.list_(pa.float32()))], ["k", "y", "v"])

    held = rows.select("k", "t", "y").mapInArrow(vectors, "k bigint, y int, v array<float>").orderBy("k").toArrow()  # TRAIN_ROWS by FEATURES at most
    y = held.column("y").to_numpy().astype(bool)
    x = np.array(held.column("v").to_pylist(), np.float64).reshape(len(y), len(features))
    truth = np.column_stack([kinds_of(x, y), y])
    return Chain(features, fit_chain(x, truth, np.arange(len(y)) % FOLDS))


def predict(chain: Chain, features: Features, texts: list[bytes]) -> np.ndarray:
    """Rows by categories: the probabilities of the chain."""
    x = np.array([features.row(t) for t in texts]).reshape(len(texts), len(chain.features))
    for w in chain.weights:
        x = np.concatenate([x, sigmoid(w[0] + x @ w[1:])[:, None]], axis=1)
    return x[:, len(chain.features) :]


def score_toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: key, one probability per category (p_<category>), toxic.

    ``toxic`` is true where the last probability is at least CUT. A null text counts as empty, a null key stays null,
    repeated rows repeat, other columns are left aside, an empty table gives an empty result; without usable labels
    nothing is toxic.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text, label))
    names = [f"p_{c}" for c in CATEGORIES]

    def run(keys: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
        kept = worker_state("toxicity", dict)
        if kept.get("chosen") != held.value.features:
            kept |= {"chosen": held.value.features, "features": Features(held.value.features)}
        p = predict(held.value, kept["features"], texts)
        return pa.RecordBatch.from_arrays([*keys, *[pa.array(p[:, c]) for c in range(p.shape[1])], pa.array(p[:, -1] >= CUT)], ["k", *names, "toxic"])

    schema = "k bigint, " + ", ".join(f"{x} double" for x in names) + ", toxic boolean"
    return map_text(docs.select(F.col(key).cast("bigint").alias("k"), F.col(text).cast("binary").alias("t")), run, schema).withColumnRenamed("k", key)
