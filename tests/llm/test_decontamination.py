"""Benchmark passages in documents against a search for every window."""

import random

import plain
import pytest
from plain import ODD

from dossierflow.llm import decontamination


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def pairs(df, key, text="text"):
    return [(r[key], r[text]) for r in df.select(key, text).collect()]


def test_documents(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows(decontamination.scanned(docs, items))
    assert got == plain.contaminated(pairs(docs, "doc_id"), pairs(items, "item_id"))
    assert 0 < sum(r[-1] for r in got) < len(got)


def made(seed: int, symbols: int, docs: int, items: int):
    """Texts over few words, so that windows repeat, overlap and lie in several items; some items are short."""
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choice("abcdefghijklmnop"[:symbols]) for _ in range(n))
    benchmark = [(i % max(items - 2, 1), text(draw.choice([0, 1, 2, 4, 5, 6, 9, 10, 11, 14, 30]))) for i in range(items)]
    benchmark += [(None, text(12)), (7, None), (8, "!!")]
    found = [(i, " ".join([text(draw.randrange(40)), draw.choice(benchmark)[1] or "", text(draw.randrange(20))])) for i in range(docs)]
    return found + [(None, found[0][1]), (None, found[0][1]), (0, found[1][1])], benchmark


@pytest.mark.parametrize("seed, symbols, gram", [(1, 2, 4), (2, 3, 4), (3, 8, 4), (4, 16, 1), (5, 16, 8)])
def test_guarantee(spark, seed, symbols, gram):
    """Every window is met, whatever the length of the k-grams, with short items, equal windows and repeated words."""
    found, benchmark = made(seed, symbols, 40, 12)
    docs = spark.createDataFrame(found, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(benchmark, "item_id long, text string")
    assert rows(decontamination.scanned(docs, items, gram=gram)) == plain.contaminated(found, benchmark)


def test_exchanged_joins(spark, sf):
    """The same rows where nothing may be broadcast."""
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = rows(decontamination.scanned(docs, items))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert rows(decontamination.scanned(docs, items)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_odd(spark):
    passage = "Two words -- same text HERE, and nine more words of this item"
    odd = plain.table(spark, [*ODD, passage, f"before {passage} after {passage}", passage[:30]]).repartition(3).cache()
    benchmark = [(1, passage), (10, passage), (9, "two words"), (None, "one"), (2, None), (3, " .. "), (1, passage)]
    items = spark.createDataFrame([(*b, True) for b in benchmark], "item_id long, text string, kept boolean")
    assert rows(decontamination.scanned(odd, items)) == plain.contaminated(pairs(odd, "doc_id"), benchmark)
    assert rows(decontamination.scanned(plain.empty(spark), items)) == []
    for none in (items.limit(0), items.where("item_id in (2, 3)")):
        assert rows(decontamination.scanned(odd, none)) == plain.contaminated(pairs(odd, "doc_id"), [])
