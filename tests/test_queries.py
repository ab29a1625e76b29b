"""Every query against its SQL in a second engine; the rest against golden rules."""

import pytest

import __spark_entry__ as entry
import compare
from conftest import DATA
from dossierflow.operators import enrich

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = compare.connect(DATA)
    c.execute("set timezone = 'UTC'")
    return c


def test_every_statement_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, spark, con, sf):
    assert compare.difference(spark, con, sf, QUERIES[name], SQL[name]) is None


def test_entry_point(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 12 and df.count() > 0


def test_page_elements(spark, sf):
    rows = QUERIES["parse_elements"](spark, sf).collect()
    assert rows and all(r["n_elements"] > 0 and r["error_status"] is None for r in rows)
    assert not any("<script" in r["text_blocks"] or "track(" in r["text_blocks"] for r in rows)


def test_trained_labels(spark, sf):
    rows = QUERIES["classified_ml"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert {r[0] for r in rows.select("classificacio").distinct().collect()} <= {"0", "1"}


def test_trained_labels_on_held_out_rows(spark, sf):
    """Languages of documents that training did not see, far above the share of the commonest."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("n_chars > 300").selectExpr("doc_id", "text as text_blocks", "lang")
    vectors = enrich.word_vectors(docs).cache()
    model = enrich.train_classifier(vectors.where("doc_id % 4 <> 0"), "lang")
    pairs = [(r["classificacio"], r["lang"]) for r in enrich.classify_trained(vectors.where("doc_id % 4 = 0"), model).collect()]
    common = max(sum(truth == one for _, truth in pairs) for one in ("en", "fr", "de", "es"))
    assert sum(a == b for a, b in pairs) > (len(pairs) + common) / 2


def balanced(pairs):
    return sum(sum(a == b == v for a, b in pairs) / sum(b == v for _, b in pairs) for v in "01") / 2


@pytest.mark.parametrize("fold", range(4))
def test_trained_quality_on_held_out_rows(spark, sf, fold):
    """Both classes of the registered target, counted alike: always the same answer would give one half."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text as text_blocks")
    marks = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", "cast(quality as string) as quality")
    shapes = enrich.text_shapes(docs).join(marks, "doc_id").cache()
    model = enrich.train_shapes(shapes.where(f"doc_id % 4 <> {fold}"), "quality")
    pairs = [(r["classificacio"], r["quality"]) for r in enrich.classify_shapes(shapes.where(f"doc_id % 4 = {fold}"), model=model).collect()]
    assert balanced(pairs) > 0.6


def test_trained_provider(spark):
    """Registered beside the keywords, on odd texts; every row comes back with its text."""
    texts = [None, "", "One two three. Four five.", "x x x x x x", "### $$$ |||", "a\nb\nb", "Plain words stand here, and more."]
    docs = spark.createDataFrame([("c", str(i), t, str(i % 2)) for i, t in enumerate(texts * 3)], "case_id string, staged_name string, text_blocks string, mark string")
    model = enrich.train_shapes(enrich.text_shapes(docs), "mark", trees=5)
    rules = enrich.taxonomy_keywords(enrich.default_taxonomy(spark))
    got = enrich.enrich(docs, rules, label="trained", label_cfg={"model": model}).collect()
    assert len(got) == len(texts) * 3 and {r["classificacio"] for r in got} <= {"0", "1"}
    assert sorted(str(r["text_blocks"]) for r in got) == sorted(str(t) for t in texts * 3) and all(0 <= r["confidence"] <= 1 for r in got)
