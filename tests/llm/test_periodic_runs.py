"""Runs of periodic words against a search over every period."""

import numpy as np
import plain
import pytest
from hypothesis import given, settings, strategies as st
from plain import ODD

from dossierflow.llm import periodic_runs


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def solved(words):
    """Runs of one document by boundaries, tiles and fragments, without Spark."""
    ids = np.unique(np.array(words, object), return_inverse=True)[1].astype(np.uint64) if words else np.zeros(0, np.uint64)
    x = np.concatenate([ids, [np.uint64(1 << 40)]])
    n = len(words)
    tiles = periodic_runs.tiles_of(x, np.zeros(n + 1, int), np.array([0]), np.array([n])).get(0, [])
    parts = {}
    for t in tiles:
        for q, low, high in periodic_runs.fragments(t["octave"], t["offset"], t["first"], t["boundaries"], np.frombuffer(t["ids"], "<i4")):
            parts.setdefault(q, []).append((low, high))
    out = []
    for q, spans in parts.items():
        whole = []
        for low, high in sorted(spans):
            if whole and low <= whole[-1][1]:
                whole[-1][1] = max(high, whole[-1][1])
            else:
                whole.append([low, high])
        out += [(low, high - low + q, q) for low, high in whole if high - low + q >= max(6, 4 * q)]
    return sorted(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=120), st.integers(1, 30), st.integers(1, 9), st.integers(0, 100))
def test_tiles_find_every_run(base, period, times, at):
    """Random words over few symbols with a repeated part put in somewhere."""
    part = (base or [0])[:period] * times
    words = [str(v) for v in base[:at] + part + base[at:]]
    assert solved(words) == plain.runs(words)


@pytest.mark.parametrize("part, times", [("a", 900), ("ab", 400), ("abaab", 300), ("abcabcd", 90), ("".join(map(chr, range(300, 700))), 5)])
def test_tiles_of_long_runs(part, times):
    words = list("xyz" + part * times + part[: len(part) // 2] + "q")
    assert solved(words) == plain.runs(words)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows(periodic_runs.found(docs))
    assert got == plain.periodic(pairs(docs))
    assert sum(r[1] > 0 for r in got) > 50


def test_odd(spark):
    repeated = ["a b c " * 40, "one two " * 3, "one two " * 4 + "x " * 6, "u " * 5, "u " * 6, "p q r s t " * 30 + "p q"]
    odd = plain.table(spark, ODD + repeated + repeated[:1]).withColumnRenamed("n_words", "tiles").repartition(3).cache()
    assert rows(periodic_runs.found(odd)) == plain.periodic(pairs(odd))
    assert rows(periodic_runs.found(plain.empty(spark))) == []
    same = odd.where("doc_id = 21").withColumn("i", plain_range(spark)).drop("i")
    assert rows(periodic_runs.found(same)) == plain.periodic(pairs(same))


def plain_range(spark):
    from pyspark.sql import functions as F

    return F.explode(F.sequence(F.lit(1), F.lit(500)))


def test_other_keys(spark):
    """Any key that can be written out; different texts of one key stay different."""
    made = [("k1", "a b " * 9), ("k1", "c " * 9), ("k1", "a b " * 9), (None, "d " * 7), ("", None)]
    df = spark.createDataFrame(made, "name string, text string")
    assert rows(periodic_runs.found(df, "name")) == plain.periodic(made)
