"""Quality by supervised subword embeddings.

Words, byte n-grams and pairs of equal words are hashed to vectors; the mean of a text's vectors goes through a softmax over the two
labels; numpy trains both by stochastic gradient descent.  The softmax sees a mean, so after training every
feature folds into one number, its vector times the difference of the two output rows: a text scores the logistic
of the mean of these numbers.  They are whole numbers of 2^-20, so equal texts score the same on any machine.

Training reads at most ``MOST_ROWS`` labelled rows, chosen by a hash of the key, in one task; its result has
``2^BITS`` numbers.  Scoring reads every text to its end.  Null and empty texts have no feature and score the
bias.  Without labels, or with one label only, the score is the share of label 1, or 0.5.  Repeated rows score
alike; null keys are scored and never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.llm import subwords, texts

BITS = 18
SIZES = (3, 5)
BACK = 2  # pairs of equal words, next to each other or with one word between, have vectors too
MOST_ROWS = 6000
WIDTH = 12
EPOCHS = 6
BATCH = 16
RATE = 0.5
ONE = 1 << 20
THRESHOLD = 0.7


def features(spaced: subwords.Spaced) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return spaced.features(BITS, SIZES, BACK)


def trained(rows: subwords.Rows) -> tuple[np.ndarray, float]:
    """One number per feature, and the bias."""
    n, share = len(rows), float(rows.label.mean()) if len(rows) else 0.5
    if not n or share in (0.0, 1.0):
        return np.zeros(1 << BITS), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    rng = np.random.default_rng(11)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    vectors[rows.rows_with < 2] = 0
    out, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    total = np.maximum(np.add.reduceat(np.append(rows.often, 0), np.minimum(rows.at[:-1], len(rows.often))) * (rows.size > 0), 1)
    target = np.stack([1 - rows.label, rows.label], 1).astype(np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(n)
        for low in range(0, n, BATCH):
            batch = order[low : low + BATCH]
            entry, row = rows.pick(batch)
            f = rows.feature[entry]
            share_of = (rows.often[entry] / total[batch][row]).astype(np.float32)
            edge = np.searchsorted(row, np.arange(len(batch)))
            weighted = vectors[f] * share_of[:, None]
            hidden = np.add.reduceat(np.vstack([weighted, np.zeros((1, WIDTH), np.float32)]), edge, axis=0)
            hidden[rows.size[batch] == 0] = 0
            z = hidden @ out.T + bias
            z = np.exp(z - z.max(1, keepdims=True))
            error = z / z.sum(1, keepdims=True) - target[batch]
            back = error @ out
            out -= rate * error.T @ hidden
            bias -= rate * error.mean(0)
            seen, where = np.unique(f, return_inverse=True)
            step = np.empty((len(seen), WIDTH), np.float32)
            for d in range(WIDTH):
                step[:, d] = np.bincount(where, weights=back[row, d] * share_of, minlength=len(seen))
            vectors[seen] -= rate * 20 * step * (rows.rows_with[seen] >= 2)[:, None]
    return vectors @ (out[1] - out[0]), float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = MOST_ROWS) -> tuple[np.ndarray, float]:
    chosen = subwords.labelled(docs, labels, label, most_rows)
    counted = subwords.counted(chosen, BITS, features, False, ["doc_id", "label"])

    def learn(table: pa.Table) -> pa.Table:
        value, bias = trained(subwords.Rows(table, BITS))
        return pa.table({"value": [np.round(value * ONE).astype("<i8").tobytes()], "bias": [bias]})

    found = counted.groupBy(F.lit(True).alias("all")).applyInArrow(learn, "value binary, bias double").collect()
    if not found:
        return np.zeros(1 << BITS, np.int64), 0.0
    return np.frombuffer(found[0]["value"], "<i8").astype(np.int32), found[0]["bias"]


def scored(docs: DataFrame, model: tuple[np.ndarray, float], key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """``key, score, predicted`` of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, bias = model
        for s in texts.slices(batches):
            spaced = subwords.Spaced(s, False)
            total, n = np.zeros(len(s), np.int64), np.zeros(len(s), np.int64)
            for start, f in features(spaced):
                total += spaced.sums(start, value[f])
                n += spaced.sums(start, np.ones(len(start), np.int8))
            score = 1 / (1 + np.exp(-(total / ONE / np.maximum(n, 1) + bias)))
            predicted = (score >= threshold).astype(np.int32)
            yield pa.record_batch([s.batch.column(s.batch.schema.get_field_index(key)), score, predicted], [key, "score", "predicted"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, score double, predicted int")


def held_out(key: str):
    """The fold that training never sees: crc32 of the key as text leaves 2 when divided by 4."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def learned_and_scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    model = fit(docs, labels.where(~held_out("doc_id")))
    rows = scored(docs, model, key)
    return rows.select(key, F.coalesce(held_out(key), F.lit(False)).alias("held_out"), "score", "predicted")
