"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another; each model sees which words and byte n-grams a text has, and the
probabilities of the categories before it.  Only features that pass a likelihood-ratio test have weights.  In training these come from models fitted without the row's fold, so a
later model meets the same kind of input as in use.  A model is a logistic regression with sparse weights
(follow-the-regularised-leader steps with an L1 term): long texts gather no noise from many small weights.

The labels know one category, ``toxic``.  Two graded ones come before it in the chain, made from the training rows:
``dense``, toxic with at least one marker in fifty words, and ``repeated``, toxic with three markers or more, where
markers are words that toxic rows hold far more often than others.  ``fit`` takes any list of categories.

Training reads at most ``MOST_ROWS`` labelled rows, chosen by a hash of the key, in one task; scoring reads whole
texts.  Null and empty texts have no feature and get the models' bias.  A category with fewer than ``LEAST`` rows on
either side is a constant, its share.  Rows with equal texts score alike; null keys are scored, not learned from.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.llm import subwords, texts

BITS = 18
HALF = 1 << (BITS - 1)  # words below, n-grams above
SIZES = (5,)
MOST_ROWS = 8000
FOLDS = 3
EPOCHS = 6
LEAST = 4
SEEN = 3  # rows a feature must be seen in
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.1, 0.1
CATEGORIES = ("dense", "repeated", "toxic")
THRESHOLD = 0.3


class Linear(NamedTuple):
    weight: np.ndarray  # by feature
    earlier: np.ndarray  # by category before
    bias: float


def features(spaced: subwords.Spaced) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield spaced.words(BITS - 1)
    for n in SIZES:
        start, f = spaced.grams(n, BITS - 1)
        yield start, f | HALF


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def telling(rows: subwords.Rows, y: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Features that the category's rows hold more often, by a likelihood ratio that about one of all features
    would reach by chance."""
    used = np.zeros(len(rows), bool)
    used[use] = True
    row = np.repeat(np.arange(len(rows)), rows.size)
    part = used[row]
    with_it = np.bincount(rows.feature[part], weights=y[row[part]], minlength=1 << BITS)
    seen = np.bincount(rows.feature[part], minlength=1 << BITS)
    share = y[use].mean()
    rest = seen - with_it
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = 2 * (np.nan_to_num(with_it * np.log(with_it / seen / share)) + np.nan_to_num(rest * np.log(rest / seen / (1 - share))))
    usable = seen >= SEEN
    return np.flatnonzero(usable & (with_it > share * seen) & (ratio >= 2 * np.log(max(usable.sum(), 1))))


def linear(rows: subwords.Rows, earlier: np.ndarray, y: np.ndarray, use: np.ndarray, seed: int) -> Linear:
    """Fit on the rows ``use``."""
    k = earlier.shape[1]
    share = float(y[use].mean()) if len(use) else 0.0
    if min(y[use].sum(), (1 - y[use]).sum()) < LEAST:
        return Linear(np.zeros(1 << BITS, np.float32), np.zeros(k), float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    chosen = telling(rows, y, use)
    known = np.full(1 << BITS, -1)
    known[chosen] = np.arange(len(chosen))
    keep = known[rows.feature] >= 0
    feature = known[rows.feature[keep]]
    at = np.concatenate([[0], np.cumsum(keep)])[rows.at]
    z, n, w = (np.zeros(len(chosen)) for _ in range(3))
    v, b = np.zeros(k), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(use):
            f = feature[at[i] : at[i + 1]]
            error = sigmoid(w[f].sum() + earlier[i] @ v + b) - y[i]
            grown = np.sqrt(n[f] + error * error)
            z[f] += error - (grown - np.sqrt(n[f])) / ALPHA * w[f]
            n[f] += error * error
            w[f] = np.where(np.abs(z[f]) <= L1, 0, -(z[f] - np.sign(z[f]) * L1) / ((BETA + grown) / ALPHA + L2))
            v -= 0.05 * error * earlier[i]
            b -= 0.02 * error
    weight = np.zeros(1 << BITS, np.float32)
    weight[chosen] = w
    return Linear(weight, v, b)


def logits(model: Linear, rows: subwords.Rows, earlier: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(rows)), rows.size)
    return np.bincount(row, weights=model.weight[rows.feature], minlength=len(rows)) + earlier @ model.earlier + model.bias


def chain(rows: subwords.Rows, categories: list[np.ndarray], fold: np.ndarray) -> list[Linear]:
    """One model per category, in order."""
    every, earlier, models = np.arange(len(rows)), np.zeros((len(rows), 0)), []
    for y in categories:
        models.append(linear(rows, earlier, y, every, 1))
        apart = np.zeros(len(rows))
        for k in range(FOLDS):
            out = fold == k
            apart[out] = sigmoid(logits(linear(rows, earlier, y, every[~out], 2 + k), rows, earlier))[out]
        earlier = np.column_stack([earlier, apart])
    return models


def graded(rows: subwords.Rows) -> list[np.ndarray]:
    """``dense``, ``repeated``, ``toxic`` of the training rows."""
    toxic = rows.label
    row = np.repeat(np.arange(len(rows)), rows.size)
    word = rows.feature < HALF
    with_it = np.bincount(rows.feature[word], weights=toxic[row[word]], minlength=1 << BITS)
    without = rows.rows_with - with_it
    odds = (with_it + 0.1) / (without + 0.1) * ((1 - toxic).sum() + 1) / (toxic.sum() + 1)
    marker = (odds >= 20) & (with_it >= SEEN) & (np.arange(1 << BITS) < HALF)
    markers = np.bincount(row, weights=rows.often * marker[rows.feature], minlength=len(rows))
    words = np.bincount(row[word], weights=rows.often[word], minlength=len(rows))
    return [toxic * (markers > 0) * (50 * markers >= words), toxic * (markers >= 3), toxic]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", categories=graded, most_rows: int = MOST_ROWS) -> list[Linear]:
    """``categories`` makes the targets of the chain, the last being the verdict, from the labelled rows."""
    counted = subwords.counted(subwords.labelled(docs, labels, label, most_rows), BITS, features, True, ["doc_id", "label"])

    def learn(table: pa.Table) -> pa.Table:
        rows = subwords.Rows(table, BITS)
        fold = np.array([zlib.crc32(rows.feature[a:b].tobytes()) % FOLDS for a, b in zip(rows.at[:-1], rows.at[1:])])
        models = chain(rows, categories(rows), fold)
        return pa.table(
            {
                "at": range(len(models)),
                "weight": [m.weight.astype("<f4").tobytes() for m in models],
                "earlier": [m.earlier.tolist() for m in models],
                "bias": [float(m.bias) for m in models],
            },
            schema=pa.schema([("at", pa.int64()), ("weight", pa.binary()), ("earlier", pa.list_(pa.float64())), ("bias", pa.float64())]),
        )

    schema = "at long, weight binary, earlier array<double>, bias double"
    found = counted.groupBy(F.lit(True).alias("all")).applyInArrow(learn, schema).collect()  # one row per category
    return [Linear(np.frombuffer(r["weight"], "<f4"), np.array(r["earlier"], float), r["bias"]) for r in sorted(found, key=lambda r: r["at"])]


def probabilities(s: texts.Slice, models: list[Linear]) -> np.ndarray:
    """By text and category; only features with a weight in some model are looked at."""
    spaced = subwords.Spaced(s, True)
    counts = np.zeros(1 << BITS, bool)
    for m in models:
        counts |= m.weight != 0
    keys = []
    for start, f in features(spaced):
        hit = counts[f]
        keys.append((spaced.owner(start[hit]).astype(np.int64) << BITS) | f[hit])
    key = np.unique(np.concatenate(keys))
    row, f = key >> BITS, key & ((1 << BITS) - 1)
    out = np.zeros((len(s), len(models)))
    for j, m in enumerate(models):
        out[:, j] = sigmoid(np.bincount(row, weights=m.weight[f], minlength=len(s)) + out[:, :j] @ m.earlier + m.bias)
    return out


def scored(docs: DataFrame, models: list[Linear], key: str = "doc_id", names=CATEGORIES, threshold: float = THRESHOLD) -> DataFrame:
    """The key, ``p_<category>`` of every category, and ``rejected``: the last one reaches the threshold.  Without
    models, as there are no labels, every probability is 0."""
    kind = docs.schema[key].dataType.simpleString()
    columns = [key, *(f"p_{c}" for c in names), "rejected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in texts.slices(batches):
            p = probabilities(s, models) if models else np.zeros((len(s), len(names)))
            yield pa.record_batch([s.batch.column(s.batch.schema.get_field_index(key)), *p.T.copy(), p[:, -1] >= threshold], columns)

    schema = ", ".join([f"{key} {kind}", *(f"{c} double" for c in columns[1:-1]), "rejected boolean"])
    return docs.select(key, "text").mapInArrow(run, schema)


def clean_rows(docs: DataFrame, models: list[Linear], threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the chain does not reject, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in texts.slices(batches):
            clean = probabilities(s, models)[:, -1] < threshold if models else np.ones(len(s), bool)
            yield s.batch.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
