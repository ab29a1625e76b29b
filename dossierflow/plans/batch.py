"""The batch job: a folder of files to the 12-column result, stage by stage as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierflow.operators import documents, enrich, normalize, report
from dossierflow.operators.expand import expand_containers
from dossierflow.sources import files, stages


def stage(spark: SparkSession, root: str, prefix: str, case_id: str = "batch") -> tuple[DataFrame, DataFrame]:
    """Entries and manifest of everything below a folder, with one duplicate scope for the run."""
    found = documents.require_rows(files.read_files(spark, root), f"files under {root}")
    opened = expand_containers(files.below(found, root, case_id)).withColumn("has_text", F.col("text").isNotNull())
    # Hash and staged name are written with the payload, so the manifest reads narrow columns only.  Texts move
    # once, when they are written by document key, and meet the manifest where they are.
    entries = stages.save_stage(normalize.describe(opened), f"{prefix}entries")
    manifest = stages.save_stage(normalize.manifest(entries, scope="global"), f"{prefix}manifest", documents.DOCUMENT_KEY)
    return entries, manifest


def result(spark: SparkSession, entries: DataFrame, manifest: DataFrame, rules: DataFrame, prefix: str, **providers) -> DataFrame:
    """Texts, documents, enrichment and result table; each is written once and read back."""
    texts = stages.save_stage(documents.texts_of(entries), f"{prefix}docs_text", documents.DOCUMENT_KEY)
    docs = documents.docs_all(texts, manifest)
    docs = documents.require_rows(stages.save_stage(docs, f"{prefix}docs_all"), "document with text")
    enriched = stages.save_stage(enrich.enrich(docs, rules, **providers), f"{prefix}docs_enriched")
    return stages.save_stage(report.sorted_result(report.result_table(enriched)), f"{prefix}resultat_final")


def export(spark: SparkSession, table: str, folder: str, format: str = "csv") -> DataFrame:
    """Write the report and hand back the display widths of its columns."""
    display = report.display_columns(files.read_table(spark, table))
    stages.write_report(display, folder, format)
    return report.column_widths(display)


def run(spark: SparkSession, root: str, rules: DataFrame, prefix: str = "", **providers) -> DataFrame:
    entries, manifest = stage(spark, root, prefix)
    return result(spark, entries, manifest, rules, prefix, **providers)
