"""From entries to manifest: kinds, staged names, duplicates, merge, counts.

Only narrow columns are touched here; payloads stay in the entries table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.functions import paths
from dossierflow.schemas import MANIFEST

# Formats handed to the parser as they are, and formats read to text at staging.
BINARY_SUFFIXES = (".pdf", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".doc", ".docx", ".ppt", ".pptx")
SPREADSHEET_SUFFIXES = (".xlsx", ".xlsm")
CONTAINER_SUFFIXES = (".zip", ".eml") + SPREADSHEET_SUFFIXES

KEPT_KINDS = ("binary", "text")
_ORDER = ("case_id", "source_path", "entry_path")
# Rows of one group of equal contents are spread over this many join keys.
SALTS = 64


def is_supported(suffix: Column) -> Column:
    return suffix.isin(*BINARY_SUFFIXES, *CONTAINER_SUFFIXES)


def raw_kind(suffix: Column, has_text: Column, reason: Column) -> Column:
    """Kind before duplicates are known.  An entry with text is kept as text even when a
    reason is noted on it (an unreadable spreadsheet keeps its error text)."""
    return (
        F.when(has_text, "text")
        .when(reason.isNotNull(), "skipped")
        .when(suffix.isin(*BINARY_SUFFIXES), "binary")
        .otherwise("skipped")
    )


def skip_reason(suffix: Column, reason: Column) -> Column:
    shown = F.when(suffix == "", "none").otherwise(suffix)
    return F.coalesce(reason, F.concat(F.lit("unsupported-ext:"), shown))


def describe(entries: DataFrame) -> DataFrame:
    """Add raw_kind, original_filename and the candidate staged name to entries.

    Takes a boolean `has_text` when the payload columns have been dropped already.  Entries that were written
    with these columns keep them, and so the layout they were written in.
    """
    if "candidate" in entries.columns:
        return entries
    has_text = F.col("has_text") if "has_text" in entries.columns else F.col("text").isNotNull()
    repeat = F.col("repeat") if "repeat" in entries.columns else None
    suffix = F.col("suffix")
    return entries.withColumns(
        {
            "raw_kind": raw_kind(suffix, has_text, F.col("reason")),
            "original_filename": paths.leaf_of(F.col("lineage")),
            "candidate": paths.staged_name(F.col("lineage"), suffix, repeat),
        }
    )


def narrow(entries: DataFrame) -> DataFrame:
    """The columns the manifest needs, so that a scan skips both payload columns.

    Whether an entry has text is stored at expansion as has_text, or taken from the text."""
    wanted = ("batch_id", *_ORDER, "lineage", "repeat", "suffix", "content_hash", "content_sha1", "reason")
    has_text = F.col("has_text") if "has_text" in entries.columns else F.col("text").isNotNull()
    return entries.select(*[c for c in wanted if c in entries.columns], has_text.alias("has_text"))


def scope_columns(scope: str) -> tuple[str, ...]:
    scopes = {
        "case": ("case_id", "content_sha1"),
        "batch": ("case_id", "batch_id", "content_sha1"),
        "global": ("content_sha1",),
    }
    if scope not in scopes:
        raise ValueError(f"unknown duplicate scope {scope!r}; one of {sorted(scopes)}")
    return scopes[scope]


def manifest(entries: DataFrame, scope: str = "case", salts: int = SALTS) -> DataFrame:
    """One manifest row per entry; the first of equal contents in walk order is kept."""
    return _mark_copies(describe(narrow(entries)), scope, salts)


def manifest_of_batch(
    entries: DataFrame, known: DataFrame, scope: str = "case", salts: int = SALTS
) -> DataFrame:
    """Manifest rows of a new batch, where contents kept by earlier batches come first.

    Only kept rows whose content occurs again in the batch take part, so the work follows the
    batch and not the whole history.  A file delivered again under its old name stays a kept
    row; merging then drops it, as it is known already.
    """
    fresh = describe(narrow(entries))
    if scope == "batch":
        return _mark_copies(fresh, scope, salts)
    keys = scope_columns(scope)
    contents = fresh.filter(F.col("raw_kind").isin(*KEPT_KINDS)).select(*keys).distinct()
    earlier = (
        known.filter(F.col("kind").isin(*KEPT_KINDS))
        .join(contents, list(keys), "left_semi")
        .withColumns(
            {
                "raw_kind": F.col("kind"),
                "candidate": F.col("staged_name"),
                "batch_id": F.lit(-1).cast("bigint"),
            }
        )
    )
    fresh = fresh.withColumn("batch_id", F.col("batch_id").cast("bigint"))
    both = fresh.unionByName(earlier.select(*[c for c in earlier.columns if c in fresh.columns]), True)
    return _mark_copies(both, scope, salts).filter(F.col("batch_id") >= 0)


def _mark_copies(rows: DataFrame, scope: str, salts: int) -> DataFrame:
    """Keep the first entry per content, point the others at it.

    Rows are laid out once by (content, salt); the aggregate that finds the first entry and
    the join that brings it back both start from that exchange, so the entries are read and
    hashed once.  (Both compare whole rows, which keeps them on the same columns whatever a
    caller selects.)

    The aggregate combines partially, and only contents seen more than once come back.  It
    also notes which salts a content uses, so a content that makes up a third of all rows is
    met in `salts` pieces and the replicated side never outgrows the copies themselves.
    """
    batch = ("batch_id",) if "batch_id" in rows.columns else ()
    order = [*batch, *_ORDER]
    staged = F.col("raw_kind").isin(*KEPT_KINDS)
    # Skipped entries take no part: their key is their own lineage, which keeps them from
    # meeting in one partition as NULLs would.
    own = F.concat(F.lit("skipped "), F.col("lineage"))
    salt = F.pmod(F.xxhash64("lineage", F.to_json("entry_path")), F.lit(salts)).cast("int")
    # One key that is never NULL: no null filter gets between the two readers of the exchange.
    within = [F.col(k).cast("string") for k in scope_columns(scope) if k != "content_sha1"]
    match = F.concat_ws("/", F.when(staged, F.col("content_sha1")).otherwise(own), *within)
    laid_out = (
        rows.drop("has_text").withColumns({"match": match, "salt": salt}).repartition("match", "salt")
    )
    rest = [c for c in laid_out.columns if c not in order and c != "salt"]
    firsts = (
        laid_out.groupBy("match")
        .agg(
            F.min(F.struct(*order, *rest)).alias("first"),
            F.count(F.lit(1)).alias("copies"),
            F.collect_set("salt").alias("salts"),
        )
        .filter(F.col("copies") > 1)
        .select("match", "first", F.explode("salts").alias("salt"))
    )
    marked = laid_out.join(firsts, ["match", "salt"], "left")
    same_document = (F.col("case_id") == F.col("first.case_id")) & (
        F.col("candidate") == F.col("first.candidate")
    )
    copy = (
        F.col("first").isNotNull() & (F.struct(*order, *rest) != F.col("first")) & ~same_document
    )
    return marked.select(
        *batch,
        *_ORDER,
        "lineage",
        "original_filename",
        "suffix",
        "content_hash",
        "content_sha1",
        F.when(~staged, "skipped").when(copy, "duplicate").otherwise(F.col("raw_kind")).alias("kind"),
        F.when(staged & ~copy, F.col("candidate")).alias("staged_name"),
        F.when(staged & copy, F.col("first.candidate")).alias("duplicate_of"),
        F.when(~staged, skip_reason(F.col("suffix"), F.col("reason")))
        .otherwise(F.col("reason"))
        .alias("reason"),
    )


def _identity() -> Column:
    """Staged name where there is one, else kind and lineage."""
    name = F.col("staged_name")
    return F.when(name.isNotNull(), F.struct(F.lit("staged").alias("a"), name.alias("b"))).otherwise(
        F.struct(F.col("kind").alias("a"), F.col("lineage").alias("b"))
    )


def manifest_additions(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of `new` that a merge adds: one per identity within the case that is not known.

    The known side is first reduced to identities that occur in `new`, with `new` as the
    small side, so a long history is filtered where it is read and not shuffled."""
    first = F.min(F.struct(*[c for c in _ORDER if c in new.columns], F.struct(*new.columns).alias("row")))
    fresh = new.groupBy("case_id", _identity().alias("identity")).agg(first.alias("first"))
    fresh = fresh.select("case_id", "identity", "first.row")
    known = existing.select("case_id", _identity().alias("identity")).join(
        fresh.select("case_id", "identity"), ["case_id", "identity"], "left_semi"
    )
    return fresh.join(known, ["case_id", "identity"], "left_anti").select("row.*")


def merge_manifests(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing entries win; a new one is added once per identity, so a re-run adds nothing."""
    return existing.unionByName(manifest_additions(existing, new))


def manifest_rows(items: DataFrame, *also: str) -> DataFrame:
    """The exchange form: each kind carries only its own fields."""
    kept = F.col("kind").isin(*KEPT_KINDS)
    return items.select(
        *also,
        "lineage",
        "kind",
        "staged_name",
        F.when(kept, F.col("original_filename")).alias("original_filename"),
        "duplicate_of",
        F.when(F.col("kind") == "skipped", F.col("reason")).alias("reason"),
    )


def kind_counts(items: DataFrame) -> DataFrame:
    """Entries per kind and the number of landed files behind them.

    Files are counted after a per-file pre-aggregation, so no kind's files meet as a set."""
    per_file = items.groupBy("kind", "case_id", "source_path").agg(F.count(F.lit(1)).alias("entries"))
    return per_file.groupBy("kind").agg(
        F.sum("entries").alias("n"), F.count(F.lit(1)).alias("source_files")
    )


def source_file_count(items: DataFrame) -> DataFrame:
    return (
        items.groupBy("case_id", "source_path")
        .agg(F.lit(1).alias("one"))
        .agg(F.count(F.lit(1)).alias("n_source_files"))
    )


def empty_manifest(spark) -> DataFrame:
    return spark.createDataFrame([], MANIFEST)
