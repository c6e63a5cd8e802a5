"""Toxicity: a classifier chain over the categories of a label table.

Categories are predicted one after the other. Each has a linear (logistic) model over words, word beginnings and a few
measures of the whole text, and over the probabilities of the categories before it; in training these earlier
probabilities are out of fold, so that a later model never sees what an earlier one fitted on the same row.

The models are fitted on a sample of at most `train_docs` labelled documents, chosen by a hash of their ids; scoring
covers every document and its whole text, without a shuffle.

Defined results: null and empty texts have no words and get probabilities from the measures alone; words are runs of
letters (Unicode category L), lower-cased; label rows that lack one of the categories aren't used, of labels with equal
ids the largest counts, of documents with equal ids the first text; a category with only one class in the sample gets
its smoothed base rate, without any labels all probabilities are 0; equal texts get equal scores, repeated rows repeat,
a score at the threshold counts as toxic; an empty table gives no rows; a text of any length is read whole, one at a
time; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, letter_runs, table, with_columns

#: Bound of the sample of labelled rows that the models are fitted on.
TRAIN_DOCS = 4000
#: Text features that a model keeps, the most telling ones of its training rows.
KEPT_FEATURES = 1500
BEGINNINGS = (4, 5, 6)
FOLDS = 4
THRESHOLD = 0.5
#: (name, label column, value that counts as positive), in the order of the chain.
CHAIN = (("low_quality", "quality", 0), ("toxic", "toxic", 1))
CACHED_WORDS = 200_000


def word_features(w: str) -> list[int]:
    """Hashes of the word and of its beginnings (marked by a leading ^)."""
    from xxhash import xxh3_64_intdigest as digest

    return [digest(w) >> 1, *(digest("^" + w[:k]) >> 1 for k in BEGINNINGS if len(w) >= k)]


def measures(text: str, n_words: int) -> list[float]:
    """Shares of upper case, digits and other signs; the scale of the length."""
    n = max(1, len(text))
    letters = sum(map(len, letter_runs(text)))
    upper = n - len(re.sub("[A-ZÀ-ÖØ-Þ]", "", text))
    digits = n - len(re.sub("[0-9]", "", text))
    signs = len(re.sub(r"[\w\s]", "", text))
    return [upper / max(1, letters), digits / n, signs / n, math.log1p(n_words) / 10]


def _features(text: str | None) -> tuple[np.ndarray, list[float]]:
    text = text or ""
    words = letter_runs(text.lower())
    return np.array(sorted({f for w in set(words) for f in word_features(w)}), dtype=np.int64), measures(text, len(words))


class Sample:
    """Training rows: the features that come twice at least, as pairs of row and feature, and the dense columns."""

    def __init__(self, rows: list[np.ndarray], dense: np.ndarray) -> None:
        flat = np.concatenate([*rows, np.zeros(0, dtype=np.int64)])
        row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
        names, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        held = count >= 2
        new = np.cumsum(held) - 1
        keep = held[at]
        self.names, self.row, self.at, self.dense = names[held], row[keep], new[at[keep]].astype(np.int32), dense

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row (numbered within `which`, a mask) and feature of the pairs of these rows."""
        keep = which[self.row]
        return (np.cumsum(which) - 1)[self.row[keep]], self.at[keep]


class Linear:
    """Logistic regression on chosen text features (present or not) and dense columns."""

    def __init__(self, sample: Sample, dense: np.ndarray, y: np.ndarray, which: np.ndarray) -> None:
        row, at = sample.rows(which)
        dense, y = dense[which], y[which]
        self.weights: dict[int, float] = {}
        self.center, self.scale = dense.mean(0), dense.std(0) + 1e-6
        base = (y.sum() + 0.5) / (len(y) + 1.0)
        self.dense, self.bias = np.zeros(dense.shape[1]), math.log(base / (1 - base))
        if not 0 < y.sum() < len(y):
            return
        n, p = len(y), float(y.sum())
        seen = np.bincount(at, minlength=len(sample.names)).astype(float)
        pos = np.bincount(at, weights=y[row], minlength=len(sample.names))
        telling = np.abs(np.log((pos + 0.5) / (p + 1)) - np.log((seen - pos + 0.5) / (n - p + 1))) * np.sqrt(seen)
        chosen = np.argsort(-telling, kind="stable")[:KEPT_FEATURES]
        place = np.full(len(sample.names), -1)
        place[chosen] = np.arange(len(chosen))
        keep = place[at] >= 0
        row, at = row[keep], place[at[keep]]
        d, k = (dense - self.center) / self.scale, len(chosen)
        w, u, b = np.zeros(k), np.zeros(dense.shape[1]), self.bias
        grads = [np.zeros(k), np.zeros(dense.shape[1]), 0.0]
        even = np.where(y == 1, n / (2 * p), n / (2 * (n - p)))  # both classes weigh the same
        for _ in range(150):  # AdaGrad over all rows
            z = np.bincount(row, weights=w[at], minlength=n) + d @ u + b
            e = even * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            gw = np.bincount(at, weights=e[row], minlength=k) + 1e-4 * w
            gu, gb = d.T @ e + 1e-3 * u, e.sum()
            grads = [grads[0] + gw**2, grads[1] + gu**2, grads[2] + gb**2]
            w -= 0.5 * gw / np.sqrt(grads[0] + 1e-12)
            u -= 0.2 * gu / np.sqrt(grads[1] + 1e-12)
            b -= 0.2 * gb / math.sqrt(grads[2] + 1e-12)
        self.weights = {int(f): float(x) for f, x in zip(sample.names[chosen], w, strict=True) if x}
        self.dense, self.bias = u, float(b)

    def prob(self, text_score: float, dense: np.ndarray) -> float:
        z = text_score + float(((dense - self.center) / self.scale) @ self.dense) + self.bias
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def prob_rows(self, sample: Sample, dense: np.ndarray, which: np.ndarray) -> np.ndarray:
        row, at = sample.rows(which)
        w = np.array([self.weights.get(int(f), 0.0) for f in sample.names])
        total = np.bincount(row, weights=w[at], minlength=int(which.sum()))
        return np.array([self.prob(float(t), x) for t, x in zip(total, dense[which], strict=True)])


def fit_chain(rows: list[np.ndarray], dense: np.ndarray, labels: np.ndarray) -> list[Linear]:
    """One model for each column of labels; rows are in a fixed order, folds go by position."""
    models, fold, sample = [], np.arange(len(rows)) % FOLDS, Sample(rows, dense)
    for c in range(labels.shape[1]):
        y = labels[:, c]
        models.append(Linear(sample, dense, y, np.ones(len(y), dtype=bool)))
        if c + 1 < labels.shape[1]:
            early = np.zeros(len(rows))
            for k in range(FOLDS):
                out = fold == k
                if out.any() and not out.all():
                    early[out] = Linear(sample, dense, y, ~out).prob_rows(sample, dense, out)
            dense = np.column_stack([dense, early])
    return models


class Chain:
    """Scores texts; keeps the scores of words it has met."""

    def __init__(self, models: list[Linear]) -> None:
        self.models, self.words = models, {}
        self.known = {f: np.array([m.weights.get(f, 0.0) for m in models]) for m in models for f in m.weights}

    def hits(self, w: str) -> tuple[int, ...]:
        found = self.words.get(w)
        if found is None:
            if len(self.words) >= CACHED_WORDS:
                self.words.clear()
            found = self.words[w] = tuple(f for f in word_features(w) if f in self.known)
        return found

    def score(self, text: str | None) -> list[float]:
        text = text or ""
        words = letter_runs(text.lower())
        present = {f for w in set(words) for f in self.hits(w)}
        total = np.zeros(len(self.models))
        for f in sorted(present):
            total += self.known[f]
        dense, out = measures(text, len(words)), []
        for m, t in zip(self.models, total, strict=True):
            out.append(m.prob(float(t), np.array(dense + out)))
        return out


def train(docs: DataFrame, labels: DataFrame, chain: tuple = CHAIN, train_docs: int = TRAIN_DOCS) -> list[Linear]:
    cols = [c for _, c, _ in chain]
    given = labels.select("doc_id", *cols).dropna().groupBy("doc_id").agg(*[F.max(c).alias(c) for c in cols])
    sample = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [_features(t) for t in b["text"].to_pylist()]
            new = [pa.array([w.tobytes() for w, _ in got], pa.binary()), pa.array([d for _, d in got], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *new, *[b[c] for c in cols]], names=["doc_id", "words", "dense", *cols])
        give_back()

    kinds = {f.name: f.dataType for f in given.schema.fields}
    fields = [T.StructField("doc_id", kinds["doc_id"]), T.StructField("words", T.BinaryType()), T.StructField("dense", T.ArrayType(T.DoubleType())), *[T.StructField(c, kinds[c]) for c in cols]]
    # once for each id, the first text of equal ids
    d = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", *cols).agg(F.min("text").alias("text"))
    got = sorted(d.select("doc_id", "text", *cols).mapInArrow(run, T.StructType(fields)).collect(), key=lambda r: r["doc_id"])
    if not got:
        return []
    y = np.array([[float(r[c] == v) for _, c, v in chain] for r in got])
    return fit_chain([np.frombuffer(r["words"], dtype=np.int64) for r in got], np.array([r["dense"] for r in got]), y)


def score(df: DataFrame, models: list[Linear], chain: tuple = CHAIN, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add p_<category> for each category of the chain and `toxic` for the last one."""
    names = [f"p_{n}" for n, _, _ in chain]
    df = df.drop(*names, "toxic")
    shared = df.sparkSession.sparkContext.broadcast(models)
    fields = [*[T.StructField(n, T.DoubleType()) for n in names], T.StructField("toxic", T.BooleanType())]

    def make() -> Callable:
        c = Chain(shared.value)

        def columns(texts: list[str | None]) -> list[pa.Array]:
            p = np.array([c.score(t) if c.models else [0.0] * len(names) for t in texts]).reshape(-1, len(names))
            return [*[pa.array(p[:, i].copy()) for i in range(len(names))], pa.array(p[:, -1] >= threshold)]

        return columns

    return with_columns(df, text, fields, make)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "p_low_quality", "p_toxic", "toxic")


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE: dict[str, str] = {}
