"""Case-file tables derived from the given tables, as inputs of the query set.

`documents` stands for the leaves of one archive per source, `events` for case lifecycles and
the classification log, `pages` and `conversations` for further file formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierflow.functions import paths
from dossierflow.operators import documents as docs_ops, enrich, normalize, state
from dossierflow.session import spread

SUFFIXES = {1: ".docx", 2: ".xlsx", 3: ".eml", 4: ".csv", 5: ".png", 6: ".pptx"}
PROMPT_VERSION = "v2.0"

# Languages as labels whose outcome can be checked against documents.lang: code, label, keywords, order.
LANGUAGES = (
    ("en", "English", "the and of", 1),
    ("fr", "French", "le la les", 2),
    ("de", "German", "der die und", 3),
    ("es", "Spanish", "el los que", 4),
)

# Field patterns for these texts, in the subset Java and RE2 share.  Runs before a mark are
# bounded, so that a long run without the mark stays linear.
FIELD_RULES = {
    "titol_document": (r"\A([^\n]+)", 1),
    "numero_expedient": (r"([0-9]{4,})", 1),
    "data_document": (r"([0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3})", 1),
    "entitat_organisme": (r"([A-Za-z0-9._]{1,64}@[A-Za-z0-9.]+[a-z])", 1),
    "proveidor_adjudicatari": (r"@([A-Za-z0-9.]+[a-z])", 1),
    "import": (r"([$][0-9A-Za-z]+)", 1),
    "tipus_procediment": (r"Released under the ([A-Za-z0-9. -]+)", 1),
}


# Tables with long texts, and the column to spread a small one by.
_TEXT_TABLES = {"documents": "doc_id", "pages": "page_id"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(rows, _TEXT_TABLES[name]) if name in _TEXT_TABLES else rows


def _suffix(doc_id: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    return F.coalesce(F.try_element_at(kinds, (doc_id % 8).cast("int")), F.lit(".pdf"))


def _position(number: Column) -> Column:
    """A 64-bit position as two ints that sort the same way."""
    return F.array(F.shiftright(number, 31).cast("int"), number.bitwiseAND(0x7FFFFFFF).cast("int"))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    doc_id = F.col("doc_id")
    # No NULL in what documents are joined by: a filter for it would part the readers of one exchange.
    rows = table(spark, sf, "documents").withColumns(
        {"suffix": _suffix(doc_id), "source": F.coalesce("source", F.lit(paths.UNASSIGNED_CASE)), "lang": F.coalesce("lang", F.lit(""))}
    )
    name = F.concat(F.lit("d"), doc_id.cast("string"), F.col("suffix"))
    archive = F.concat(F.col("source"), F.lit(".zip"))
    return rows.select(
        F.col("source").alias("case_id"),
        archive.alias("source_path"),
        _position(doc_id).alias("entry_path"),
        paths.lineage_of(archive, F.concat(F.col("lang"), F.lit("/"), name)).alias("lineage"),
        F.lit(0).alias("repeat"),
        "suffix",
        paths.content_hash(F.col("text")).alias("content_hash"),
        F.sha1("text").alias("content_sha1"),
        "text",
        F.col("suffix").isin(".xlsx", ".eml").alias("has_text"),
        F.lit(None).cast("string").alias("reason"),
        "doc_id",
        "lang",
    )


def manifest(spark: SparkSession, sf: str, scope: str = "case") -> DataFrame:
    return normalize.manifest(entries(spark, sf), scope)


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Text of each staged entry; pictures have no text provider and give an empty one."""
    staged = docs_ops.staged_entries(entries(spark, sf))
    blocks = F.when(F.col("suffix") == ".png", "").otherwise(F.col("text"))
    return staged.select("case_id", "staged_name", "raw_kind", blocks.alias("text_blocks"))


def docs_all(spark: SparkSession, sf: str) -> DataFrame:
    return docs_ops.docs_all(texts(spark, sf), manifest(spark, sf))


def outcome(spark: SparkSession, sf: str, include_skipped: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, usable documents, failed documents), built on the same plans."""
    items = manifest(spark, sf)
    docs = docs_ops.docs_all(texts(spark, sf), items)
    return items, docs, docs_ops.docs_failed(items, docs, include_skipped)


def taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """The taxonomy table: every source is a label that is switched off, with keywords of all languages; the seed
    brings the languages that documents have."""
    docs = table(spark, sf, "documents")
    sources = docs.select(F.col("source").alias("label"), F.lit("the le der el").alias("description"), F.lit(0).alias("sort_order"), F.lit(False).alias("active"))
    listed = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(row, ("lang", "label", "description", "sort_order")))) for row in LANGUAGES))
    seed = docs.select("lang").distinct().join(spark.range(1).select(F.inline(listed)), "lang").drop("lang")
    return state.seed_taxonomy(sources.distinct(), seed)


def keyword_rules(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.taxonomy_keywords(taxonomy(spark, sf), least_word=2)


def classified(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    return enrich.classify(docs_all(spark, sf) if docs is None else docs, keyword_rules(spark, sf))


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.enrich(
        docs_all(spark, sf), keyword_rules(spark, sf), fields_cfg={"rules": FIELD_RULES}
    )


# --- events as lifecycles --------------------------------------------------------------------


def events(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    user = F.col("user_id").cast("string")
    return table(spark, sf, "events").select(
        "event_id",
        F.concat(user, F.lit("-"), F.col("ts").cast("date").cast("string")).alias("case_id"),
        F.concat(user, F.lit(":"), (F.floor("value") % 5).cast("string")).alias("doc_id"),
        "user_id",
        F.when(kind == "signup", "EXPEDIENT_CREATED")
        .when(kind.isin("view", "click"), "FILES_UPLOADED")
        .when(kind == "purchase", "DOC_CLASSIFIED")
        .otherwise("DOC_ERROR")
        .alias("type"),
        F.col("props").alias("payload_json"),
        "value",
        "ts",
    )


def opened_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases as they stand before their documents are counted."""
    per_case = events(spark, sf).groupBy("case_id").agg(
        F.min("user_id").alias("first_user"),
        F.min("ts").alias("created_at"),
        F.max("ts").alias("updated_at"),
        F.count_if(F.col("type") == "FILES_UPLOADED").alias("uploads"),
    )
    zero = F.lit(0).cast("bigint")
    closed = F.col("updated_at") < F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    return per_case.select(
        "case_id",
        F.concat(F.lit("user"), (F.col("first_user") % 7).cast("string"), F.lit("@Example.com")).alias("owner"),
        F.when(closed, "CLOSED").when(F.col("uploads") > 0, "PROCESSING").otherwise("DRAFT").alias("status"),
        zero.alias("docs_total"),
        zero.alias("docs_classified"),
        zero.alias("docs_error"),
        "created_at",
        "updated_at",
    )


def event_documents(spark: SparkSession, sf: str) -> DataFrame:
    """One document per document event, with the state that event left it in."""
    document = events(spark, sf).filter(F.col("type").isin("DOC_CLASSIFIED", "DOC_ERROR"))
    status = F.when(F.col("type") == "DOC_ERROR", "ERROR").otherwise("CLASSIFIED")
    return document.select(F.col("event_id").cast("string").alias("doc_id"), "case_id", status.alias("status"))


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Cases after a run over every case that has documents."""
    found = event_documents(spark, sf)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")
    opened = opened_cases(spark, sf)
    return state.recompute_cases(opened, found, state.touched_cases(found), now)


def classification_log(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "event_id", "doc_id", F.col("type").alias("classificacio"), F.col("ts").alias("created_at")
    )
