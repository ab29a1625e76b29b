"""Sequences for training by vector bin packing.

An example asks for tokens, one segment and loss-bearing tokens; a sequence has a limit for each.  Among the
examples that fit, the one with the largest dot product of its demand and the room left comes next, every
dimension weighted by its mean demand.  When none fits, or one segment is left, an example is cut to fill the
sequence.  What remains of a task ends in sequences whose lengths are powers of two, which need no padding.

A task packs its own texts in blocks and carries less than one sequence from block to block: no exchange, and
memory for one block of ids.  Sequence ids are unique over the tasks of one run.

A null text is an empty one: its only id is the end id.  Ties go to the earlier row; repeated rows are examples of
their own; keys may be null.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from dossierflow.llm import texts
from dossierflow.llm.token_counts import library

MOST_TEXTS = 4096  # in a block; the choice among them takes time with its square
MEMO = 1 << 20  # words remembered before a task forgets them all


class Limits(NamedTuple):
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


class Piece(NamedTuple):
    example: int
    start: int
    length: int
    sequence: int
    offset: int


class Examples:
    """Rest of each example: ids from ``at`` to ``size``; the first ``prompt`` ids bear no loss, nor does the
    first id of a piece."""

    def __init__(self, at, size, prompt):
        self.at, self.size, self.prompt = (np.array(x, np.int64) for x in (at, size, prompt))

    def demand(self) -> np.ndarray:
        tokens = self.size - self.at
        loss = np.maximum(0, self.size - np.maximum(self.at + 1, self.prompt))
        return np.stack([tokens, np.minimum(tokens, 1), loss])

    def longest(self, room: np.ndarray) -> np.ndarray:
        """Ids that each may add to a sequence with this room."""
        by_loss = np.maximum(self.at + 1, self.prompt) - self.at + room[2]
        return np.minimum(np.minimum(self.size - self.at, room[0]), by_loss)


def fill(examples: Examples, limits: Limits, first: int, last: bool) -> tuple[list[Piece], int]:
    """Pieces of closed sequences, numbered from ``first``, and the next number.  Examples move on as they are
    used; unless it is the ``last`` block, less than a sequence of tokens stays."""
    pieces: list[Piece] = []
    scale = np.array(limits, float)[:, None]
    demand = examples.demand()
    weight = (demand / scale).mean(axis=1) if demand.shape[1] else np.zeros(3)
    left, sequence = int(demand[0].sum()), first
    while left >= limits.tokens or (last and left):
        cap = limits.tokens if left >= limits.tokens else 1 << (left.bit_length() - 1)
        room, offset = np.array([cap, limits.segments, limits.loss]), 0
        while room[0] and room[1]:
            fits = (demand <= room[:, None]).all(axis=0) & (demand[0] > 0)
            if offset == 0 and (demand[0] >= room[0]).any():
                fits[:] = False  # a long example opens the sequence
            if room[1] > 1 and fits.any():
                score = (weight * room / scale[:, 0] ** 2) @ demand
                e = int(np.argmax(np.where(fits, score, -1.0)))
                n = int(demand[0, e])
            else:
                could = np.where(demand[0] > 0, examples.longest(room), 0)
                e = int(np.argmax(could))
                n = int(could[e])
                if n <= 0:
                    break
            at = int(examples.at[e])
            loss = max(0, at + n - max(at + 1, int(examples.prompt[e])))
            pieces.append(Piece(e, at, n, sequence, offset))
            examples.at[e] += n
            room -= (n, 1, loss)
            offset, left = offset + n, left - n
            rest = int(examples.size[e]) - at - n
            demand[:, e] = (rest, min(rest, 1), max(0, int(examples.size[e]) - max(at + n + 1, int(examples.prompt[e]))))
        sequence += 1
    return pieces, sequence


# Words of printable ASCII and Latin-1 letters: composed already, one lower-case letter for each capital, and the
# same classes of characters in every Unicode version.
PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
PLAIN_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


class Ids:
    """Ids of whole texts, for a tokenizer that folds case, drops white space and maps bytes to letters.

    White space separates words, so each distinct word is encoded once in a task and remembered.  Plain words are
    cut here by the tokenizer's own pattern, and its model encodes each distinct part; other words go through the
    whole tokenizer."""

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        self.whole, self.end = library(path), np.uint32(end).tobytes()
        self.bare = Tokenizer(self.whole.model)  # no normaliser, no pattern
        self.numbers: dict[bytes, int] = defaultdict()  # of words in the order of their first use
        self.numbers.default_factory = self.numbers.__len__
        self.ids: list[bytes] = []  # by number
        self.parts: dict[str, bytes] = {}
        self.special = re.compile("|".join(re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()) or "(?!)")
        # As byte-level tokenizers do: printable bytes stand for themselves, the others for letters from 256 on.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in set(shown)]
        self.letters = {x: x for x in shown} | {x: 256 + i for i, x in enumerate(hidden)}

    def _part_ids(self, parts: list[str]) -> list[bytes]:
        """Ids of many parts from one call, cut by the word that each id belongs to."""
        if not parts:
            return []
        shown = [p.encode().decode("latin-1").translate(self.letters) for p in parts]
        found = self.bare.encode(shown, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        edge = (4 * np.searchsorted(np.array(found.word_ids), np.arange(len(parts) + 1))).tolist()
        return [ids[a:b] for a, b in zip(edge, edge[1:])]

    def _learn(self, new: list[bytes]) -> None:
        cut: list[str | list[str] | None] = []  # one part, several, or none for a word that is not plain
        other = []
        for word in map(bytes.decode, new):
            if word.isascii() and word.isalpha():
                cut.append(word.lower())
            elif PLAIN.fullmatch(word) and not ("<" in word and self.special.search(word)):
                cut.append(PLAIN_PARTS.findall(word.lower()))
            else:
                cut.append(None)
                other.append(word)
        parts = {c for c in cut if c.__class__ is str}
        parts.update(chain.from_iterable(c for c in cut if c.__class__ is list))
        parts = list(parts.difference(self.parts))
        known = self.parts
        known.update(zip(parts, self._part_ids(parts)))
        whole = iter(self.whole.encode_batch_fast(other, add_special_tokens=False))
        add = self.ids.append
        for c in cut:
            if c.__class__ is str:
                add(known[c])
            elif c is None:
                add(array("I", next(whole).ids).tobytes())
            else:
                add(b"".join([known[p] for p in c]))

    def of(self, s: texts.Slice, low: int, high: int) -> list[bytes]:
        if len(self.ids) > MEMO:
            self.numbers.clear()
            self.ids.clear()
            self.parts.clear()
        number = self.numbers.__getitem__
        numbers = [list(map(number, s.text(i).split())) for i in range(low, high)]
        new = list(islice(self.numbers, len(self.ids), None))
        for part in range(0, len(new), 1 << 15):
            self._learn(new[part : part + (1 << 15)])
        ids = self.ids.__getitem__
        return [b"".join(map(ids, ns)) + self.end for ns in numbers]


def packed(
    docs: DataFrame, path: str, end: int, key: str = "doc_id", prompt: str | None = None, limits: Limits = Limits()
) -> DataFrame:
    """One row per piece.  ``path``: a tokenizers file that drops white space; ``end``: the id closing a document;
    ``prompt``: column with the number of leading ids that bear no loss."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Ids(path, end)
        number = TaskContext.get().partitionId() << 33
        keys, ids, prompts, at = [], [], [], []

        def block(last: bool):
            nonlocal number, keys, ids, prompts, at
            examples = Examples(at, [len(x) // 4 for x in ids], prompts)
            found, number = fill(examples, limits, number, last)
            columns = [[] for _ in names]
            for p in found:
                crc = zlib.crc32(ids[p.example][4 * p.start : 4 * (p.start + p.length)])
                row = (keys[p.example], p.start, p.length, crc, len(ids[p.example]) // 4, p.sequence, p.offset)
                for column, value in zip(columns, row):
                    column.append(value)
            rest = np.flatnonzero(examples.at < examples.size)
            keys, ids, prompts = ([x[i] for i in rest] for x in (keys, ids, prompts))
            at = list(examples.at[rest])
            return pa.record_batch([pa.array(columns[0], key_type), *map(pa.array, columns[1:])], names) if found else None

        key_type = None
        for s in texts.slices(batches):
            column = s.batch.column(s.batch.schema.get_field_index(key))
            key_type = column.type
            for low in range(0, len(s), MOST_TEXTS):
                high = min(low + MOST_TEXTS, len(s))
                keys += column[low:high].to_pylist()
                ids += encode.of(s, low, high)
                at += [0] * (high - low)
                prompts += (x or 0 for x in s.batch.column(s.batch.schema.get_field_index(prompt))[low:high].to_pylist()) if prompt else [0] * (high - low)
                if (out := block(False)) is not None:
                    yield out
        if ids and (out := block(True)) is not None:
            yield out

    return docs.select(key, "text", *([prompt] if prompt else [])).mapInArrow(run, schema)
