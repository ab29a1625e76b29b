"""Texts inside a task: Arrow batches as byte buffers, words and their hashes as numpy arrays.

A batch is cut into slices of whole texts (``SLICE_BYTES`` or one text, if that is longer), so the memory of
a task follows its longest text and not the batch.  Hashes have 64 bits; they stand for words within one
text or one pair of texts, never for documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 4 << 20
LONG_WORD = 4096
WHITE = (9, 10, 11, 12, 13, 32)  # [\x20\x09-\x0D]


class Slice(NamedTuple):
    """Whole texts one after another; ``at`` has their first byte, and the end."""

    batch: pa.RecordBatch
    data: np.ndarray
    at: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()


class Words(NamedTuple):
    """Start and end bytes of all words of a slice; words of text i are ``first[i]:first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: later steps do not compute it again, and a lost
    executor takes nothing of it along."""
    from dossierflow.session import run_folder

    spark, folder = df.sparkSession, run_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[Slice]:
    """A null text counts as an empty one."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        if col.null_count:
            col = pc.fill_null(col, "")
        col = col.cast(pa.large_binary())
        if not len(col):
            continue
        _, offsets, body = col.buffers()
        at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
        data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
        low = 0
        while low < len(col):
            high = max(low + 1, int(np.searchsorted(at, at[low] + most, "right")) - 1)
            yield Slice(batch.slice(low, high - low), data[at[low] : at[high]], at[low : high + 1] - at[low])
            low = high


def lower_ascii(data: np.ndarray) -> np.ndarray:
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold[data]


def words(s: Slice, data: np.ndarray | None = None) -> Words:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]``."""
    data = s.data if data is None else data
    white = np.zeros(256, bool)
    white[list(WHITE)] = True
    ink = ~white[data]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:]
    edge = s.at[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = ink[edge]
    ends[edge - 1] = ink[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, s.at))


def mix(h: np.ndarray) -> np.ndarray:
    """Final step of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step over all spans that are long enough."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
    size = end - start
    h = mix(size.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live = np.flatnonzero((size > 0) & (size <= LONG_WORD))
    at = start[live]
    left = size[live]
    while len(live):
        part = eight[at] & masks[np.minimum(left, 8)]
        h[live] = mix((h[live] ^ part) * np.uint64(0x9E3779B97F4A7C15))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD):
        digest = hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest()
        h[i] = int.from_bytes(digest, "little")
    return h


def chained(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words that begin at each word; the caller drops windows that cross texts."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = hashes[:n]
    for j in range(1, k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n])
    return h


def owners(first: np.ndarray, shorten: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Index and text of every window of ``shorten + 1`` words."""
    count = np.maximum(np.diff(first) - shorten, 0)
    text = np.repeat(np.arange(len(count)), count)
    skip = np.repeat(np.cumsum(count) - count, count)
    return np.arange(len(text)) - skip + np.repeat(first[:-1], count), text


def per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Sums by text as whole numbers."""
    return np.bincount(text, weights=values, minlength=n).astype(np.int64)


def within(flag: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many bytes of each text are flagged."""
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[at[1:]] - total[at[:-1]]


def taken(s: Slice, rows: np.ndarray) -> Slice:
    """The texts at these rows as a slice of their own."""
    if len(rows) == len(s):
        return s
    size = np.diff(s.at)[rows]
    at = np.concatenate([[0], np.cumsum(size)])
    pick = np.arange(at[-1]) + np.repeat(s.at[:-1][rows] - at[:-1], size)
    return Slice(s.batch.take(pa.array(rows)), s.data[pick], at)
