"""The registered queries against their SQL, and the pipeline against its stages by brute force."""

import compare
import corpus_pipeline
import pytest
from conftest import DATA
from pyspark.sql import functions as F

import plain
from dossierflow.llm import oracles, queries, texts


@pytest.fixture(scope="module")
def con():
    return compare.connect(DATA)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_same_rows(name, spark, con, sf):
    assert compare.difference(spark, con, sf, queries.QUERIES[name], oracles.SQL[name]) is None


def test_all_queries():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, len(queries.QUERIES) + 1))


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(texts.stored(stage(spark, seen[-1], sf), name.replace(" ", "-")))
    assert all(x.columns == docs.columns and x.count() < y.count() for x, y in zip(seen[1:4], seen[:3]))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    clean = [(r.doc_id, r.text) for r in seen[2].collect()]
    assert ids(seen[3]) == {c for _, _, c in plain.joined(clean, corpus_pipeline.GRAM, corpus_pipeline.PERCENT)}
    good = ids(spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1 and toxic = 0"))
    measures = {r.doc_id: plain.measures(r.text) for r in docs.collect()}
    sound = {k for k, m in measures.items() if m[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    assert good & sound <= ids(seen[2])
    assert ids(seen[4]) == ids(seen[3])
    got, whole = (sorted(map(tuple, df.select("doc_id", "start", "length", "ids_crc32").collect())) for df in (corpus_pipeline.run(spark, sf), seen[4]))
    assert {r[0] for r in got} == {r[0] for r in whole} and sum(r[2] for r in got) == sum(r[2] for r in whole)


def test_pipeline_without_rows(spark, sf):
    docs = plain.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_pipeline_keeps_every_text_of_an_id(spark, sf):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    made = [(1, a), (1, b), (1, a), (2, a + " more"), (3, b + " more"), (-4, c), (None, d), (None, d), (None, c), (None, None), (5, None)]
    docs = spark.createDataFrame([(k, t, "en", str(i), 1) for i, (k, t) in enumerate(made)], plain.empty(spark).schema)
    want = {(1, a, "0"), (1, b, "1"), (-4, c, "5"), (None, d, "6"), (None, None, "9"), (5, None, "10")}
    for n in (1, 5):
        made = docs.withColumns({"node": F.lit("x"), "others": F.lit(1)}).repartition(n)
        found = corpus_pipeline.one_of_each_group(spark, made, sf)
        assert found.columns == made.columns
        got = found.select("doc_id", "text", "source").collect()
        assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
