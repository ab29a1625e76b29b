"""State maintenance as set operations: upserts, history, events, counters, constraints.

Every function maps the current tables to new contents; nothing is changed in place.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.functions import rules
from dossierflow.operators import heavy
from dossierflow.operators.enrich import stamp
from dossierflow.schemas import (
    CASES,
    CASE_STATUSES,
    CLASSIFICATION_SOURCES,
    CLASSIFICATIONS,
    DOCUMENT_STATUSES,
    DOCUMENTS,
    EVENTS,
    HISTORY,
    TAXONOMY,
    VALUE_COLUMNS,
)

# Fixed value: message kept with a document that could not be read.
UNREADABLE = "El document no s'ha pogut llegir (format no suportat, corrupte o buit)."

Match = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def conform(df: DataFrame, schema) -> DataFrame:
    """Columns of the schema in order and type; missing ones are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str], on_match: Mapping[str, Match | str]) -> DataFrame:
    """Rows of `source` are inserted, or change the columns named in `on_match` of the row with
    their key.  A value is the string "source" or a function of (old, new) column getters.

    One full outer join on a key unique on both sides: each side is moved once, no key is
    skewed, and nothing is read twice.
    """
    columns = target.columns
    old = target.select(*[F.col(k).alias(k) for k in key], F.struct(*columns).alias("old"))
    new = source.select(*[F.col(k).alias(k) for k in key], F.struct(*source.columns).alias("new"))
    both = old.join(new, list(key), "full_outer")
    has_old, has_new = F.col("old").isNotNull(), F.col("new").isNotNull()

    def value(c: str) -> Column:
        if c in key:
            return F.col(c)
        inserted = F.col("new")[c] if c in source.columns else F.lit(None)
        kept = F.col("old")[c]
        rule = on_match.get(c)
        if rule is None:
            changed = kept
        elif rule == "source":
            changed = inserted
        else:
            changed = rule(lambda n: F.col("old")[n], lambda n: F.col("new")[n])
        return F.when(~has_new, kept).when(~has_old, inserted).otherwise(changed)

    return both.select(*[value(f.name).cast(f.dataType).alias(f.name) for f in target.schema])


# --- taxonomy ----------------------------------------------------------------------------


def seed_taxonomy(current: DataFrame, seed: DataFrame) -> DataFrame:
    """Known labels take the seed's description and order and become active again."""
    seed = conform(seed, TAXONOMY).withColumn("active", F.lit(True))
    same = {c: "source" for c in ("description", "sort_order", "active")}
    return upsert(conform(current, TAXONOMY), seed, ["label"], same)


# --- cases -------------------------------------------------------------------------------


def touched_cases(*results: DataFrame) -> DataFrame:
    """Distinct cases of the given results; each is reduced before the union."""
    parts = [r.select("case_id").distinct() for r in results]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.distinct()


def _new_cases(rows: DataFrame, status: str, now: Column) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    filled = rows.withColumns(
        {
            "status": F.lit(status),
            "docs_total": zero,
            "docs_classified": zero,
            "docs_error": zero,
            "created_at": now,
            "updated_at": now,
        }
    )
    return conform(filled, CASES)


def _unless_closed(value) -> Match:
    return lambda old, new: F.when(old("status") == "CLOSED", old("status")).otherwise(value)


def ensure_cases(cases: DataFrame, touched: DataFrame, owner: str, now: Column) -> DataFrame:
    """Every touched case exists and is PROCESSING; owners stay, closed cases stay closed."""
    wanted = _new_cases(touched.select("case_id").withColumn("owner", F.lit(owner)), "PROCESSING", now)
    changed = {"status": _unless_closed(F.lit("PROCESSING")), "updated_at": "source"}
    return upsert(cases, wanted, ["case_id"], changed)


def recompute_cases(cases: DataFrame, documents: DataFrame, touched: DataFrame, now: Column, run_id: int | None = None) -> DataFrame:
    """Counters and status of the touched cases from their documents.

    Documents are counted before they meet the touched cases, so a case with a third of all
    documents arrives as a handful of partial sums."""
    counts = document_counts(documents)
    counted = touched.join(counts, "case_id", "left").select(
        "case_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("docs_total", "docs_classified", "docs_error")],
        now.alias("updated_at"),
    )
    counted = counted.withColumn("status", status_of_counts(F.col("docs_error")))
    changed = {c: "source" for c in ("docs_total", "docs_classified", "docs_error", "updated_at")}
    changed["status"] = lambda old, new: F.when(old("status") == "CLOSED", old("status")).otherwise(new("status"))
    if run_id is not None:
        changed["last_run_id"] = lambda old, new: F.lit(run_id)
    return upsert(cases, counted, ["case_id"], changed)


def document_counts(documents: DataFrame, by: str = "case_id") -> DataFrame:
    status = F.col("status")
    return documents.groupBy(by).agg(
        F.count(F.lit(1)).alias("docs_total"),
        F.count_if(status == "CLASSIFIED").alias("docs_classified"),
        F.count_if(status == "ERROR").alias("docs_error"),
    )


def status_of_counts(errors: Column) -> Column:
    return F.when(errors > 0, "NEEDS_REVIEW").otherwise("READY")


def remember_run(cases: DataFrame, runs: DataFrame, now: Column) -> DataFrame:
    """Note the run started for each case (rows of case_id, last_run_id); unknown ones are left out."""
    known = runs.join(cases.select("case_id"), "case_id", "left_semi").withColumn("updated_at", now)
    return upsert(cases, known, ["case_id"], {"last_run_id": "source", "updated_at": "source"})


# --- documents and classifications -----------------------------------------------------------


def _with_doc_id(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", rules.document_id(F.col("case_id"), F.col("staged_name")))


def _document_rows(rows: DataFrame, status: str, message: Column, now: Column) -> DataFrame:
    filled = _with_doc_id(rows).withColumns(
        {
            "original_lineage": F.col("lineage"),
            "status": F.lit(status),
            "error_message": message,
            "created_at": now,
            "updated_at": now,
        }
    )
    if "kind" in rows.columns:
        filled = filled.withColumn("staged_kind", F.col("kind"))
    return conform(filled, DOCUMENTS)


def upsert_documents(documents: DataFrame, classified: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """Documents of a run, read and failed, in one pass.  A known document changes status,
    message and time only; success clears an older message."""
    rows = _document_rows(classified, "CLASSIFIED", F.lit(None), now).unionByName(
        _document_rows(failed, "ERROR", F.lit(UNREADABLE), now)
    )
    return upsert(documents, rows, ["doc_id"], {c: "source" for c in ("status", "error_message", "updated_at")})


def classification_rows(enriched: DataFrame, now: Column) -> DataFrame:
    """Enriched documents as classification rows: empty strings to NULL, title falls back to
    the file name."""
    field = lambda f: F.col(f"extracted.`{f}`")
    rows = stamp(_with_doc_id(enriched)).withColumns(
        {
            "titol": rules.title_or_name(field("titol_document"), F.col("original_filename")),
            "num_expedient": rules.empty_to_null(field("numero_expedient")),
            "data_document": rules.empty_to_null(field("data_document")),
            "entitat_organisme": rules.empty_to_null(field("entitat_organisme")),
            "proveidor_adjudicatari": rules.empty_to_null(field("proveidor_adjudicatari")),
            "import_": rules.empty_to_null(field("import")),
            "tipus_procediment": rules.empty_to_null(field("tipus_procediment")),
            "created_at": now,
        }
    )
    return conform(rows, CLASSIFICATIONS)


def archive_classifications(current: DataFrame, incoming: DataFrame, now: Column) -> DataFrame:
    """History rows: current classifications that are about to be replaced."""
    replaced = current.join(incoming.select("doc_id"), "doc_id", "left_semi")
    rows = replaced.withColumns(
        {
            "history_id": identity(F.col("doc_id"), F.col("created_at").cast("string")),
            "archived_at": now,
        }
    )
    return conform(rows, HISTORY)


def replace_classifications(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Latest classification per document; the whole row is replaced."""
    changed = {c: "source" for c in (*VALUE_COLUMNS, "created_at")}
    return upsert(current, incoming, ["doc_id"], changed)


# --- events ------------------------------------------------------------------------------


def identity(*parts: Column) -> Column:
    """A SHA-256 that a repeated run computes again; NULLs count as such."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)


def event_rows(rows: DataFrame, kind: str, user: Column, payload: Column, now: Column, nth: Column | None = None) -> DataFrame:
    """Events with an id that a repeated run computes again.  `nth` tells apart rows that are equal otherwise."""
    doc = F.col("doc_id") if "doc_id" in rows.columns else F.lit(None).cast("string")
    return conform(
        rows.select(
            "case_id", doc.alias("doc_id"), user.alias("user"), F.lit(kind).alias("type"),
            payload.alias("payload_json"), now.alias("ts"), (F.lit(1) if nth is None else nth).alias("nth"),
        ).withColumn("event_id", identity(*[F.col(c) for c in ("case_id", "doc_id", "user", "type", "payload_json", "ts", "nth")])),
        EVENTS,
    )


def run_events(classified: DataFrame, failed: DataFrame, user: Column, now: Column) -> DataFrame:
    good = event_rows(
        _with_doc_id(classified), "DOC_CLASSIFIED", user, rules.payload(classificacio=F.col("classificacio")), now
    )
    bad = event_rows(
        _with_doc_id(failed), "DOC_ERROR", user, rules.payload(original_filename=F.col("original_filename")), now
    )
    return good.unionByName(bad)


# --- requests ----------------------------------------------------------------------------


def create_cases(cases: DataFrame, requests: DataFrame, now: Column):
    """(new cases, their events, requests with an outcome) for rows (case_id, title,
    description, owner).  Of several requests for one id the first by owner, title and description is taken."""
    order = ["owner", *[c for c in requests.columns if c not in ("case_id", "owner")]]
    first = requests.groupBy("case_id").agg(F.min(F.struct(*order)).alias("r")).select("case_id", "r.*")
    known = cases.select("case_id", F.lit(True).alias("known"))
    judged = first.join(known, "case_id", "left").withColumn(
        "outcome",
        F.when(~rules.valid_case_id(F.col("case_id")), "invalid")
        .when(F.col("known"), "exists")
        .otherwise("created"),
    ).drop("known")
    fresh = judged.filter("outcome = 'created'")
    events = event_rows(fresh, "EXPEDIENT_CREATED", F.col("owner"), rules.payload(), now)
    return _new_cases(fresh.drop("outcome"), "DRAFT", now), events, judged


def register_uploads(cases: DataFrame, files: DataFrame, now: Column):
    """(cases, events, files with an outcome) for rows (case_id, filename, bytes, owner).

    A case has to exist and be open.  Equal rows are counted and numbered from their count, which combines partially;
    no window holds them.  The status is looked up by a join that deals the files of a heavy case to many tasks, and
    the cases to change are made distinct with partial combine."""
    status = cases.select("case_id", F.col("status").alias("case_status"))
    equal = files.groupBy(*files.columns).agg(F.count(F.lit(1)).alias("equal"))
    numbered = equal.select(*files.columns, F.explode(F.sequence(F.lit(1).cast("bigint"), "equal")).alias("nth"))
    named = numbered.withColumn("filename", rules.safe_file_name(F.col("filename")))
    judged = heavy.join(named, status, "case_id").withColumn(
        "outcome",
        F.when(~rules.valid_case_id(F.col("case_id")), "invalid")
        .when(F.col("filename").isNull(), "no-name")
        .when(F.coalesce("bytes", F.lit(0)) <= 0, "empty")
        .when(F.col("case_status").isNull(), "unknown-case")
        .when(F.col("case_status") == "CLOSED", "closed")
        .otherwise("accepted"),
    ).drop("case_status")
    accepted = judged.filter("outcome = 'accepted'")
    events = event_rows(
        accepted, "FILES_UPLOADED", F.col("owner"), rules.payload(filename=F.col("filename"), bytes=F.col("bytes")), now,
        F.col("nth"),
    )
    judged = judged.drop("nth")
    opened = accepted.select("case_id").distinct().withColumns({"status": F.lit("PROCESSING"), "updated_at": now})
    changed = upsert(cases, opened, ["case_id"], {"status": "source", "updated_at": "source"})
    return changed, events, judged


def delete_cases(ids: DataFrame, cases: DataFrame, documents: DataFrame, classifications: DataFrame):
    """The three tables without the given cases; history and events stay.  Rows of a heavy case are dealt."""
    gone = ids.select("case_id").distinct()
    return tuple(heavy.join(t, gone, "case_id", "left_anti") for t in (cases, documents, classifications))


# --- constraints -------------------------------------------------------------------------


def _violation(rows: DataFrame, rule: str, table: str, key: Column, n: Column | None = None) -> DataFrame:
    return rows.select(
        F.lit(rule).alias("rule"),
        F.lit(table).alias("table"),
        key.cast("string").alias("key"),
        (F.lit(1) if n is None else n).cast("bigint").alias("n"),
    )


def not_null(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    """Columns with NULLs and how many, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in columns])).alias("v")
    return _violation(counts.select(each).select("v.*").filter("n > 0"), "not null", table, F.col("c"), F.col("n"))


def one_of(df: DataFrame, table: str, column: str, allowed: Sequence[str]) -> DataFrame:
    bad = df.filter(~F.col(column).isin(*allowed)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return _violation(bad, "enum", table, F.col(column), F.col("n"))


def unique(df: DataFrame, table: str, columns: Sequence[str]) -> DataFrame:
    seen = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return _violation(seen, "unique", table, F.concat_ws(":", *columns), F.col("n"))


def references(df: DataFrame, table: str, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Values without a parent.  Values are counted before they meet the parent keys."""
    used = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    lost = used.join(parent.select(F.col(parent_column).alias(column)), column, "left_anti")
    return _violation(lost, "foreign key", table, F.col(column), F.col("n"))


def check_constraints(cases: DataFrame, documents: DataFrame, classifications: DataFrame) -> DataFrame:
    """All violations of the state tables; empty when they are sound."""
    checks = [
        unique(cases, "cases", ["case_id"]),
        not_null(cases, "cases", ["case_id", "owner", "status"]),
        one_of(cases, "cases", "status", CASE_STATUSES),
        unique(documents, "documents", ["doc_id"]),
        unique(documents, "documents", ["case_id", "staged_name"]),
        not_null(documents, "documents", ["doc_id", "case_id", "status"]),
        one_of(documents, "documents", "status", DOCUMENT_STATUSES),
        references(documents, "documents", "case_id", cases, "case_id"),
        unique(classifications, "classifications", ["doc_id"]),
        not_null(classifications, "classifications", ["doc_id", "source"]),
        one_of(classifications, "classifications", "source", CLASSIFICATION_SOURCES),
        references(classifications, "classifications", "doc_id", documents, "doc_id"),
    ]
    found = checks[0]
    for c in checks[1:]:
        found = found.unionByName(c)
    return found
