"""The classify-and-merge job: staged documents into the state tables of a run."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierflow.operators import documents, enrich, state
from dossierflow.sources import runs, stages


def classify_and_merge(
    spark: SparkSession,
    previous: Mapping[str, DataFrame],
    manifest: DataFrame,
    entries: DataFrame,
    rules: DataFrame,
    work: str,
    target: str,
    owner: str,
    mode: str = "full",
    prompt_version: str = "v2.0",
    include_skipped: bool = False,
    now: Column | None = None,
    run_id: int | None = None,
    **providers,
) -> str | None:
    """Enrich the staged documents and write the new state to the folder `target`; returns it, or None when
    nothing is staged.

    `previous` holds the state before (`runs.read_state`).  `mode="full"` enriches every staged document again,
    `"incremental"` only those whose content is not classified under this prompt version: the manifest is
    narrowed first, and only what is left is parsed.  `work` is a folder of this run for results that several
    tables are computed from.
    """
    if mode not in ("full", "incremental"):
        raise ValueError(f"unknown mode {mode!r}")
    if runs.is_complete(spark, target):
        return target
    staged = documents.kept(manifest)
    if staged.isEmpty():
        return None
    now = F.lit(datetime.now(timezone.utc)) if now is None else now
    wanted = staged
    if mode == "incremental":
        read = previous["documents"].filter("status = 'CLASSIFIED'").select("doc_id", "staged_name", "content_hash")
        wanted = documents.todo(staged, previous["classifications"].join(read, "doc_id"), prompt_version)
    wanted = stages.write_folder(wanted, f"{work}/wanted")
    # Texts are written before anything filters them, so each wanted entry is parsed once and no other one is.
    texts = documents.texts_of(entries, wanted if mode == "incremental" else None)
    texts = stages.write_folder(texts, f"{work}/texts")
    docs = stages.write_folder(documents.docs_all(texts, wanted), f"{work}/docs_all")
    skipped = skipped_documents(manifest, entries).select(*wanted.columns)
    failed = documents.docs_failed(wanted.unionByName(skipped), docs, include_skipped)
    same = F.min(F.struct(*failed.columns)).alias("row")  # of a file that was delivered twice
    failed = stages.write_folder(
        failed.groupBy("case_id", "staged_name").agg(same).select("row.*"), f"{work}/docs_failed"
    )
    enriched = stages.write_folder(enrich.enrich(docs, rules, **providers), f"{work}/enriched")

    touched = state.touched_cases(enriched, failed)
    current = previous["classifications"]
    known = stages.write_folder(state.upsert_documents(previous["documents"], enriched, failed, now), f"{work}/documents")
    incoming = state.classification_rows(enriched, now).withColumn("prompt_version", F.lit(prompt_version))
    cases = state.ensure_cases(previous["cases"], touched, owner, now)
    return runs.write_state(
        spark,
        target,
        {
            "cases": state.recompute_cases(cases, known, touched, now, run_id),
            "documents": known,
            "classifications": state.replace_classifications(current, incoming),
            "classification_history": state.archive_classifications(current, incoming, now),
            "events": state.run_events(enriched, failed, F.lit(owner), now),
        },
    )


def skipped_documents(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Manifest rows of skipped entries.  They have no staged name; lineage and repeat number stand in as the key."""
    skipped = manifest.filter(F.col("kind") == "skipped")
    place = ["case_id", "source_path", "entry_path"]
    repeated = entries.filter(F.col("repeat") > 0).select(*place, "repeat").distinct()
    key = F.concat("lineage", F.coalesce(F.concat(F.lit("#"), F.col("repeat").cast("string")), F.lit("")))
    return skipped.drop("repeat").join(repeated, place, "left").withColumn("staged_name", key)
