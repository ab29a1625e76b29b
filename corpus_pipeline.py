"""A training corpus from ``documents``: rules, toxicity, near copies, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; it is written and read again before the next stage.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.llm import ngram_join, packing, quality_rules, texts, toxicity
from dossierflow.llm.queries import tokenizer_file

GRAM, PERCENT = 5, 80


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules.  A null text is an empty one, which fails; equal rows fare alike; other
    columns pass as they are; no rows give none."""
    return quality_rules.kept_rows(docs)


def by_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, learned from the labelled ones among them, does not reject.  Nulls, equal
    rows and other columns as above; without labelled documents nothing is rejected."""
    return toxicity.clean_rows(docs, toxicity.fit(docs, texts.table(spark, sf_dir, "labels")))


def node() -> Column:
    """A name for id and text together, which sorts by id, rows without one last."""
    number = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.unhex(F.concat(F.coalesce(number, F.lit("F" * 18)), F.coalesce(F.substring(F.sha2("text", 256), 1, 32), F.lit(""))))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near copies.  Rows equal in id and text are one document;
    different texts are different documents, whatever their ids.

    Where every row has an id of its own, that is its name in the join.  Otherwise equal rows are collapsed and rows
    are named by id and text, at three times the width.  Other columns travel as one, so they may have any name."""
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("doc_id is null or rows > 1")
    if ids.isEmpty():
        joined = ngram_join.joined(docs, "doc_id", GRAM, PERCENT)
        return docs.join(joined.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    others = F.min(F.struct(*(c for c in docs.columns if c != "text"))).alias("others")
    whole = docs.groupBy(node().alias("node")).agg(others, F.first("text").alias("text"))
    whole = texts.stored(whole, "distinct-rows")
    first = ngram_join.joined(whole, "node", GRAM, PERCENT).where("node = component_id").select("node")
    return whole.join(first, "node", "left_semi").select("others.*", "text").select(docs.columns)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.  A null text is an empty one; equal rows are packed one
    by one; other columns are not read."""
    return packing.packed(docs, tokenizer_file("word_bpe_49k.json"), end=2)


STAGES = [
    ("quality rules", by_rules),
    ("toxicity", by_toxicity),
    ("n-gram Jaccard join", one_of_each_group),
    ("packing", into_sequences),
]
ORACLE_SQL = None  # a trained classifier decides in the second stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = texts.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
