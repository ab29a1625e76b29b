"""Texts meet the manifest: usable documents, failed documents, what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dossierflow.functions import bloom
from dossierflow.operators.normalize import KEPT_KINDS, describe, narrow
from dossierflow.operators.parse import parse_document, text_blocks

# A staged name is unique only within its case.
DOCUMENT_KEY = ["case_id", "staged_name"]


def staged_entries(entries: DataFrame) -> DataFrame:
    """Entries under their staged name; of a file delivered again only the last delivery.

    Superseded deliveries are found from narrow columns.  Mostly they are few, and the join that drops them is
    left to Spark, which broadcasts them then and moves no payload."""
    named = describe(entries).filter(F.col("raw_kind").isin(*KEPT_KINDS))
    if "batch_id" in entries.columns:
        key = ["case_id", "candidate", "batch_id"]
        deliveries = describe(narrow(entries)).filter(F.col("raw_kind").isin(*KEPT_KINDS)).select(*key)
        last = deliveries.groupBy("case_id", "candidate").agg(
            F.max("batch_id").alias("last"), F.min("batch_id").alias("first")
        ).filter("last > first")
        old = deliveries.join(last, ["case_id", "candidate"]).filter("batch_id < last").select(*key).distinct()
        named = named.join(old, key, "left_anti")
    return named.withColumnRenamed("candidate", "staged_name")


def texts_of(entries: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Text of every staged entry (case_id, staged_name, text_blocks), parsed or as read; of the `wanted` keys
    only, which are picked where entries are read, before anything is parsed.

    One scan serves both kinds, and bytes become text where they are read, so what later joins move is text and
    never a payload.  The wanted keys, and which delivery of a file is the last, are found from narrow columns; a
    Bloom filter of them decides in the scan, and the few rows too many that it lets pass go with the exact join on
    the texts.  The caller writes the texts before it filters them: a filter on the text would be pushed below that
    join and take the parser along.
    """
    binary = F.col("raw_kind") == "binary"
    staged = describe(entries).filter(F.col("raw_kind").isin(*KEPT_KINDS)).withColumnRenamed("candidate", "staged_name")
    delivered = "batch_id" in entries.columns
    key = [*DOCUMENT_KEY, "batch_id"] if delivered else DOCUMENT_KEY
    keys = wanted.select(*DOCUMENT_KEY) if wanted is not None else None
    if delivered:
        names = describe(narrow(entries)).filter(F.col("raw_kind").isin(*KEPT_KINDS))
        last = names.groupBy("case_id", F.col("candidate").alias("staged_name")).agg(F.max("batch_id").alias("batch_id"))
        keys = last if keys is None else last.join(keys, DOCUMENT_KEY, "left_semi")
    if wanted is not None:
        size = bloom.size_for(wanted.count())
        staged = staged.filter(bloom.may_hold(bloom.bits_of(keys, key, size), [F.col(c) for c in key], size))
    parsed = staged.withColumn("parsed", parse_document(F.when(binary, F.col("data")), F.col("suffix")))
    blocks = F.when(binary, text_blocks(F.col("parsed"))).otherwise(F.col("text"))
    texts = parsed.select(*key, blocks.alias("text_blocks"))
    return texts if keys is None else texts.join(keys, key, "left_semi").select(*DOCUMENT_KEY, "text_blocks")


def kept(manifest: DataFrame) -> DataFrame:
    return manifest.filter(F.col("kind").isin(*KEPT_KINDS))


def both_branches(parsed: DataFrame, texts: DataFrame) -> DataFrame:
    """Parsed binaries and pre-extracted texts stacked, for artefacts staged as files."""
    columns = [*DOCUMENT_KEY, "text_blocks"]
    return parsed.select(*columns).unionByName(texts.select(*columns))


def docs_all(texts: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per staged document with usable text.

    The join carries no hint: a manifest below the broadcast threshold is broadcast, a larger
    one is merged on the document key, on which both sides are unique."""
    usable = texts.filter(F.col("text_blocks").isNotNull() & (F.length("text_blocks") > 0))
    names = kept(manifest).select(*DOCUMENT_KEY, "lineage", "original_filename", "content_hash")
    return usable.select(*DOCUMENT_KEY, "text_blocks").join(names, DOCUMENT_KEY).select(
        "case_id", "lineage", "original_filename", "staged_name", "content_hash", "text_blocks"
    )


def docs_failed(manifest: DataFrame, docs: DataFrame, include_skipped: bool = False) -> DataFrame:
    """Staged documents without usable text; on request also what staging skipped."""
    columns = ["case_id", "lineage", "original_filename", "staged_name", "kind", "content_hash"]
    failed = (
        kept(manifest)
        .select(*columns, F.lit(None).cast("string").alias("reason"))
        .join(docs.select(*DOCUMENT_KEY), DOCUMENT_KEY, "left_anti")
        .select(*columns, "reason")
    )
    if not include_skipped:
        return failed
    skipped = manifest.filter(F.col("kind") == "skipped").select(*columns, "reason")
    return failed.unionByName(skipped)


def todo(docs: DataFrame, done: DataFrame, prompt_version: str) -> DataFrame:
    """Documents whose content has not been enriched under this prompt version."""
    current = done.filter(F.col("prompt_version") == prompt_version)
    key = [*DOCUMENT_KEY, "content_hash"]
    return docs.join(current.select(*key), key, "left_anti")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Stop the run when nothing arrived; looks at one row only."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df
