"""Hashed features of texts: words, and byte n-grams of words with one white byte at either edge."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.llm import texts


class Spaced:
    """A slice with one blank before each text and after the last, and every white byte as a blank, so that no
    n-gram joins two texts."""

    def __init__(self, s: texts.Slice, fold: bool):
        fix = np.arange(256, dtype=np.uint8)
        if fold:
            fix[65:91] += 32
        fix[list(texts.WHITE)] = 32
        self.n = len(s)
        self.at = s.at + np.arange(self.n + 1)
        self.data = np.full(len(s.data) + self.n + 1, 32, np.uint8)
        self.data[np.arange(len(s.data)) + np.repeat(np.arange(1, self.n + 1), np.diff(s.at))] = fix[s.data]
        self.ink = self.data != 32

    def words(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each word starts, and its feature."""
        step = np.diff(self.ink.astype(np.int8), prepend=0)
        start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        return start, (texts.span_hashes(self.data, start, end) >> np.uint64(64 - bits)).astype(np.int32)

    def repeats(self, start: np.ndarray, feature: np.ndarray, back: int) -> np.ndarray:
        """Which words equal the word so many places before them in their text."""
        same = np.zeros(len(start), bool)
        same[back:] = feature[back:] == feature[:-back]
        first = np.searchsorted(start, self.at[:-1])
        for k in range(back):
            same[first[first + k < len(start)] + k] = False
        return same

    def grams(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Where each n-gram starts, and its feature; n is 3 to 8."""
        size = len(self.data) - n + 1
        if size <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        inner = self.ink[1 : 1 + size].copy()
        for k in range(2, n - 1):
            inner &= self.ink[k : k + size]
        start = np.flatnonzero(inner)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray(shape=(len(self.data),), dtype="<u8", buffer=padded, strides=(1,))
        v = (eight[start] & np.uint64((1 << (8 * n)) - 1)) + np.uint64(n << 56 if n < 8 else 0)
        v = v * np.uint64(0x9E3779B97F4A7C15)
        v = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return start, (v >> np.uint64(64 - bits)).astype(np.int32)

    def features(self, bits: int, sizes: tuple[int, ...], back: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words, n-grams of these sizes, and for pairs of equal words up to ``back`` apart a feature by distance,
        whatever the word."""
        start, word = self.words(bits)
        yield start, word
        for k in range(1, back + 1):
            again = start[self.repeats(start, word, k)]
            yield again, np.full(len(again), k, np.int32)
        for n in sizes:
            yield self.grams(n, bits)

    def sums(self, start: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Whole-number sums by text of values that stand at these places."""
        total = np.concatenate([[0], np.cumsum(value, dtype=np.int64)])
        edge = np.searchsorted(start, self.at[:-1])
        edge = np.append(edge, len(start))
        return total[edge[1:]] - total[edge[:-1]]

    def owner(self, start: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at[:-1], start, "right") - 1


def counted(docs: DataFrame, bits: int, features: Callable[[Spaced], Iterator], fold: bool, keep: list[str]) -> DataFrame:
    """Per text: the columns to keep, its distinct features and how often each occurs, as packed int32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in texts.slices(batches, most=1 << 20):
            spaced = Spaced(s, fold)
            keys = [(spaced.owner(start).astype(np.int64) << bits) | f for start, f in features(spaced)]
            key, often = np.unique(np.concatenate(keys), return_counts=True)
            edge = np.searchsorted(key, np.arange(len(s) + 1, dtype=np.int64) << bits)
            f, often = (key & ((1 << bits) - 1)).astype("<i4"), often.astype("<i4")
            rows = [[x[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:])] for x in (f, often)]
            columns = [s.batch.column(s.batch.schema.get_field_index(c)) for c in keep]
            yield pa.record_batch([*columns, *(pa.array(r, pa.binary()) for r in rows)], [*keep, "feature", "often"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, feature binary, often binary")


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, key: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled rows, those with the smallest hash of the key: ``key, label, text``.  A key with
    several labels counts with the largest; null keys and labels do not count."""
    chosen = (
        labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(key)
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64(key), key)
        .limit(most)
    )
    return docs.select(key, "text").join(F.broadcast(chosen), key)  # bounded by ``most`` rows of two numbers


class Rows:
    """Training rows as one sparse matrix; features seen in one row only are left out."""

    def __init__(self, table: pa.Table, bits: int):
        table = table.sort_by([("doc_id", "ascending")])
        feature = [np.frombuffer(x, "<i4") for x in table.column("feature").to_pylist()]
        often = [np.frombuffer(x, "<i4") for x in table.column("often").to_pylist()]
        self.keys = table.column("doc_id").to_pylist()
        self.label = np.asarray(table.column("label")).astype(float)
        self.size = np.array([len(x) for x in feature], np.int64)
        self.feature = np.concatenate([*feature, np.zeros(0, "<i4")])
        self.often = np.concatenate([*often, np.zeros(0, "<i4")]).astype(np.float32)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.rows_with = np.bincount(self.feature, minlength=1 << bits)

    def __len__(self) -> int:
        return len(self.label)

    def pick(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entries of these rows, and which of the rows each belongs to."""
        size = self.size[rows]
        begin = np.cumsum(size) - size
        entry = np.arange(size.sum()) + np.repeat(self.at[:-1][rows] - begin, size)
        return entry, np.repeat(np.arange(len(rows)), size)
