"""Quality rules as a short-circuit cascade.

A rule is a test that rejects texts.  A sample tells what each rule costs per text and which share it rejects;
rules then run in the order of rejection per cost, each over the texts that all earlier rules let pass.  The
order changes the time only: a text is kept when no rule rejects it.

Nulls and empty texts have no word and fail ``words``.  An empty table gives an empty result.  Repeated rows
are judged one by one.  Columns of the input keep their names; verdicts are added under names the caller chooses.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.llm import texts

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
SAMPLE_TEXTS = 4000  # texts on which costs and rejections are estimated, in expectation

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


class View:
    """What the rules measure on a slice of texts; words are found once and shared."""

    def __init__(self, s: texts.Slice):
        self.slice, self._words = s, None

    @property
    def words(self) -> texts.Words:
        if self._words is None:
            self._words = texts.words(self.slice)
        return self._words

    def n_words(self) -> np.ndarray:
        return np.diff(self.words.first)

    def word_chars(self) -> np.ndarray:
        white = np.zeros(256, bool)
        white[list(texts.WHITE)] = True
        d = self.slice.data
        return texts.within(~white[d] & ((d & 0xC0) != 0x80), self.slice.at)

    def n_symbols(self) -> np.ndarray:
        hit = np.zeros(256, bool)
        hit[list(SYMBOLS)] = True
        return texts.within(hit[self.slice.data], self.slice.at)

    def lines(self, i: int) -> list[bytes]:
        """Lines with a word."""
        return [line for line in self.slice.text(i).split(b"\n") if line.strip()]

    def line_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of lines equal to an earlier one, bytes of all lines with a word."""
        out = np.zeros((2, len(self.slice)), np.int64)
        for i in range(len(self.slice)):
            found = self.lines(i)
            out[1, i] = sum(map(len, found))
            out[0, i] = out[1, i] - sum(map(len, set(found)))
        return out[0], out[1]

    def n_dup_lines(self) -> np.ndarray:
        out = np.zeros(len(self.slice), np.int64)
        for i in range(len(self.slice)):
            found = self.lines(i)
            out[i] = len(found) - len(set(found))
        return out

    def n_repeat_words(self) -> np.ndarray:
        """Words inside windows of eight words that the text has twice or more."""
        w = self.words
        start, text = texts.owners(w.first, WINDOW - 1)
        cover = np.zeros(len(w.start) + 1, np.int64)
        if len(start):
            hashes = texts.chained(texts.span_hashes(self.slice.data, w.start, w.end), WINDOW)[start]
            order = np.argsort(texts.mix(hashes + text.astype(np.uint64)), kind="stable")
            h, t = hashes[order], text[order]
            same = (h[1:] == h[:-1]) & (t[1:] == t[:-1])
            again = np.zeros(len(start), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            np.add.at(cover, start[again], 1)
            np.add.at(cover, start[again] + WINDOW, -1)
        return texts.within(np.cumsum(cover[:-1]) > 0, w.first)

    def n_stutters(self) -> np.ndarray:
        """Words equal to the word before them."""
        w = self.words
        if len(w.start) < 2:
            return np.zeros(len(self.slice), np.int64)
        h = texts.span_hashes(self.slice.data, w.start, w.end)
        same = np.concatenate([[False], h[1:] == h[:-1]])
        begin = w.first[:-1]
        same[begin[begin < len(same)]] = False
        return texts.within(same, w.first)

    def letters(self) -> tuple[np.ndarray, np.ndarray]:
        """ASCII capitals, ASCII letters."""
        d = self.slice.data
        upper = (d >= 65) & (d <= 90)
        return texts.within(upper, self.slice.at), texts.within(upper | ((d >= 97) & (d <= 122)), self.slice.at)


class Rule(NamedTuple):
    name: str
    rejects: Callable[[View], np.ndarray]


def _case(v: View) -> np.ndarray:
    upper, all_ = v.letters()
    return 100 * upper > 50 * all_


def _length(v: View) -> np.ndarray:
    chars, n = v.word_chars(), v.n_words()
    return (chars < 2 * n) | (chars > 20 * n)


def _lines(v: View) -> np.ndarray:
    again, all_ = v.line_bytes()
    return 100 * again > 50 * all_


BASE_RULES = (
    Rule("words", lambda v: v.n_words() < 20),
    Rule("repeats", lambda v: 100 * v.n_repeat_words() > 30 * v.n_words()),
)
MORE_RULES = (
    Rule("symbols", lambda v: 100 * v.n_symbols() > 30 * v.n_words()),
    Rule("lines", _lines),
    Rule("stutter", lambda v: 100 * v.n_stutters() > 20 * v.n_words()),
    Rule("capitals", _case),
    Rule("word_length", _length),
)
RULES = BASE_RULES + MORE_RULES


def measured(docs: DataFrame, rules=RULES, sample_texts: int = SAMPLE_TEXTS, seed: int = 7) -> DataFrame:
    """Per rule, over a sample: texts, rejected texts, seconds.  The sample holds about ``sample_texts`` texts."""
    share = min(1.0, sample_texts / max(docs.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in texts.slices(batches):
            seen = []
            for rule in rules:
                began = time.perf_counter()
                rejected = int(rule.rejects(View(s)).sum())
                seen.append((rule.name, len(s), rejected, time.perf_counter() - began))
            names, n, rejected, seconds = zip(*seen)
            yield pa.record_batch([list(names), list(n), list(rejected), list(seconds)], ["rule", "n", "rejected", "seconds"])

    rows = docs.select("text").sample(share, seed) if share < 1 else docs.select("text")
    return (
        rows.mapInArrow(run, "rule string, n long, rejected long, seconds double")
        .groupBy("rule")
        .agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("seconds").alias("seconds"))
    )


def ordered(docs: DataFrame, rules=RULES, sample_texts: int = SAMPLE_TEXTS) -> tuple[Rule, ...]:
    """Rules by rejection per cost, highest first; as given where the sample says nothing."""
    found = {r["rule"]: r for r in measured(docs, rules, sample_texts).collect()}  # one row per rule
    gain = lambda r: found[r.name]["rejected"] / max(found[r.name]["seconds"], 1e-9) if r.name in found else 0.0
    return tuple(sorted(rules, key=lambda r: -gain(r)))


def passing(s: texts.Slice, rules) -> np.ndarray:
    """Rows of the slice that no rule rejects; each rule sees what the earlier ones let pass."""
    alive = np.arange(len(s))
    for rule in rules:
        if not len(alive):
            break
        if len(alive) < len(s):
            part = View(texts.taken(s, alive))
        else:
            part = View(s)
        alive = alive[~rule.rejects(part)]
    return alive


def kept_rows(docs: DataFrame, rules=None) -> DataFrame:
    """The rows of ``docs`` whose text passes every rule, with all their columns."""
    rules = ordered(docs) if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in texts.slices(batches):
            yield s.batch.take(pa.array(passing(s, rules)))

    return docs.mapInArrow(run, docs.schema)


def judged(docs: DataFrame, key: str = "doc_id", more_rules=None) -> DataFrame:
    """Measures of every text, the base verdict, and ``kept``: no base rule and no further rule rejects it."""
    more_rules = ordered(docs, MORE_RULES) if more_rules is None else more_rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in texts.slices(batches):
            v = View(s)
            measures = [v.n_words(), v.word_chars(), v.n_symbols(), v.n_dup_lines(), v.n_repeat_words()]
            failed = (measures[0] < 20) | (100 * measures[4] > 30 * measures[0])
            kept = np.zeros(len(s), bool)
            left = np.flatnonzero(~failed)
            if len(left):
                kept[left[passing(texts.taken(s, left), more_rules)]] = True
            columns = [s.batch.column(s.batch.schema.get_field_index(key)), *map(pa.array, measures), pa.array(failed), pa.array(kept)]
            yield pa.record_batch(columns, [key, *(c.split()[0] for c in BASE.split(", ")), "base_failed", "kept"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, {BASE}, base_failed boolean, kept boolean")
