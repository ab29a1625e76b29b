"""The query set: each takes (spark, folder of the given tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierflow.functions import paths, rules
from dossierflow.operators import documents as docs_ops
from dossierflow.operators import enrich, normalize, parse, report, search, serving, state, versions
from dossierflow.operators.expand import expand_containers
from dossierflow.plans import base, built_files
from dossierflow.session import run_folder
from dossierflow.sources import files, stages
from dossierflow.streaming import ingest as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = "2024-02-01 00:00:00"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


# --- normalisation -------------------------------------------------------------------------

_MANIFEST = ("case_id", "lineage", "original_filename", "suffix", "content_hash", "kind", "staged_name", "duplicate_of", "reason")


@query
def manifest_by_case(spark, sf):
    return base.manifest(spark, sf).select(*_MANIFEST)


@query
def manifest_global(spark, sf):
    return base.manifest(spark, sf, "global").select(*_MANIFEST)


@query
def manifest_kind_counts(spark, sf):
    return normalize.kind_counts(base.manifest(spark, sf))


@query
def manifest_merge(spark, sf):
    """A first delivery of two languages, then everything again."""
    all_rows = base.entries(spark, sf)
    first = normalize.manifest(all_rows.filter(F.col("lang").isin("en", "fr")))
    merged = normalize.merge_manifests(first, normalize.manifest(all_rows))
    return merged.select("case_id", "lineage", "kind", "staged_name", "duplicate_of")


@query
def manifest_rows(spark, sf):
    return normalize.manifest_rows(base.manifest(spark, sf), "case_id")


@query
def path_parts(spark, sf):
    rows = base.entries(spark, sf)
    uri = F.concat(F.lit("s3:/landing/"), F.col("case_id"), F.lit("/raw/"), F.col("lang"), F.lit("/"), F.col("lineage"))
    stray = F.concat(F.lit("file:inbox/"), F.col("lineage"))
    return rows.select(
        "doc_id",
        paths.suffix_of(F.col("lineage")).alias("suffix"),
        paths.leaf_of(F.col("lineage")).alias("leaf"),
        paths.file_name(uri).alias("name"),
        paths.case_of_path(uri).alias("path_case"),
        paths.case_of_path(stray).alias("stray_case"),
        paths.case_relative_name(uri).alias("relative_name"),
        paths.case_relative_name(stray).alias("stray_name"),
        paths.without_scheme(uri).alias("bare"),
        paths.without_scheme(stray).alias("stray_bare"),
    )


def _expand_containers(spark, sf):
    """Archives, mails and sheets built from the documents inside the job, and opened again."""
    opened = expand_containers(built_files.archives(base.table(spark, sf, "documents")))
    # Opened once: the manifest reads narrow columns of the written entries, texts join back.
    entries = stages.write_folder(opened, run_folder(spark, "entries"))
    items = normalize.manifest(entries)
    texts = entries.filter(F.col("text").isNotNull()).select("case_id", "lineage", F.md5("text").alias("text_md5"))
    visible_hash = F.when(F.col("suffix") != ".xlsx", F.col("content_hash"))
    return items.join(texts, ["case_id", "lineage"], "left").select(
        "case_id", "lineage", "original_filename", "suffix", visible_hash.alias("content_hash"),
        "kind", "staged_name", "duplicate_of", "reason", "text_md5",
    )


QUERIES["expand_containers"] = _expand_containers


@query
def stream_ingest(spark, sf):
    """Archives of documents landed in five deliveries, drained as a stream of files in five micro-batches."""
    work, docs, parts = run_folder(spark, "stream"), base.table(spark, sf, "documents"), 5
    archives = max(1, docs.count() // (50 * parts))
    made = stages.write_folder(built_files.delivery(docs, archives, parts), f"{work}/made", ["part"])
    for part in range(parts):  # one after another: the stream takes the oldest files first
        rows = made.filter(F.col("part") == part).withColumn("path", F.concat(F.lit("landing/"), F.col("path")))
        stages.write_files(rows.select("path", "content"), work).write.format("noop").mode("overwrite").save()
    staging = streaming.Staging(spark, f"{work}/staging")
    landed = files.stream_files(spark, f"{work}/landing", files_per_batch=archives)
    streaming.ingest(landed, staging, f"{work}/checkpoint", archive_root="/archive")
    done = staging.archived_files().select(
        paths.case_of_path(F.col("path")).alias("case_id"), paths.case_relative_name(F.col("path")).alias("source_path"), "archive_path", "batch_id"
    )
    return staging.manifest().join(done, ["case_id", "source_path"]).select(*_MANIFEST, "archive_path", "batch_id")


# --- reading staged artefacts ------------------------------------------------------------------


@query
def read_manifest_json(spark, sf):
    folder = run_folder(spark, "manifests")
    stages.write_manifest_json(base.manifest(spark, sf), folder)
    read = files.read_manifests(spark, folder, r"/case_id=([^/]+)/", json_lines=True)
    return docs_ops.require_rows(read, "manifest entries")


@query
def read_whole_text(spark, sf):
    """Every text written as one file under its staged name, and read back whole."""
    folder = run_folder(spark, "texts")
    # Tasks write the files below one folder per case: folders of single files would pass the driver one by one.
    # Rows of one name share a file, a line each.
    lines = F.concat(F.array_join(F.sort_array(F.collect_list("text_blocks")), "\n"), F.lit("\n"))
    rows = base.docs_all(spark, sf).groupBy("case_id", "staged_name").agg(F.encode(lines, "UTF-8").alias("content"))
    path = F.concat(F.lit("case-"), _as_path_part(F.col("case_id")), F.lit("/text-"), _as_path_part(F.col("staged_name")))
    stages.write_files(rows.select(path.alias("path"), "content"), folder).write.format("noop").mode("overwrite").save()
    read = files.read_staged_texts(spark, f"{folder}/*")
    bare = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))  # the reader gives paths as URIs
    part = lambda pattern: F.url_decode(F.replace(F.regexp_extract(bare, pattern, 1), F.lit("+"), F.lit("%2B")))
    names = part("(?s)/case-([^/]*)/[^/]*$").alias("case_id"), part("(?s)/text-([^/]*)$").alias("staged_name")
    return read.select(*names, F.md5("text_blocks").alias("text_md5"))


def _as_path_part(name):
    """A name as one part of a path, which is no partition column either."""
    return reduce(lambda c, mark: F.replace(c, F.lit(mark), F.lit(f"%{ord(mark):02X}")), "%/=", name)


@query
def read_binary(spark, sf):
    """Payloads of binary entries staged as files, and read back as bytes by staged name."""
    staged = docs_ops.staged_entries(base.entries(spark, sf)).filter("raw_kind = 'binary'")
    rows = staged.withColumns({"kind": F.lit("binary"), "data": F.encode("text", "UTF-8")})
    folder = run_folder(spark, "binaries")
    stages.write_staged_files(rows, folder).write.format("noop").mode("overwrite").save()
    found = docs_ops.require_rows(files.read_staged_binaries(spark, f"{folder}/*/binary"), "files")
    case = F.regexp_extract("path", "/([^/]+)/binary/", 1)
    return found.select(case.alias("case_id"), "staged_name", "length", F.sha1("data").alias("data_sha1"))


# --- parsing -------------------------------------------------------------------------------------


@query
def parse_elements(spark, sf):
    pages = base.table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("data"), F.lit(".html").alias("suffix"))
    parsed = pages.withColumn("parsed", parse.parse_document(F.col("data"), F.col("suffix")))
    return parsed.select(
        "page_id",
        F.size("parsed.elements").alias("n_elements"),
        parse.text_blocks(F.col("parsed")).alias("text_blocks"),
        F.col("parsed.error_status").alias("error_status"),
    )


@query
def parse_office(spark, sf):
    return parse.parse_documents(built_files.office_files(base.table(spark, sf, "documents"))).select(
        "doc_id", "case_id", "suffix", "text_blocks", "parse_error"
    )


@query
def parse_variant(spark, sf):
    """A parser answer as VARIANT: path access, safe cast, element projection, newline join."""
    lines = F.transform(F.split("text", "\n"), lambda s: F.struct(F.lit("text").alias("type"), s.alias("content")))
    answer = F.parse_json(F.to_json(F.struct(F.struct(lines.alias("elements")).alias("document"))))
    rows = base.table(spark, sf, "documents").select("doc_id", answer.alias("parsed"))
    return rows.select(
        "doc_id",
        parse.variant_text_blocks(F.col("parsed")).alias("text_blocks"),
        parse.variant_error(F.col("parsed")).alias("error_status"),
    )


@query
def page_titles(spark, sf):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return base.table(spark, sf, "pages").select("page_id", title.alias("title"))


# --- documents -------------------------------------------------------------------------------------


@query
def docs_all(spark, sf):
    return base.docs_all(spark, sf)


@query
def docs_union(spark, sf):
    """The same from two branches, as artefacts staged as files are read."""
    texts = base.texts(spark, sf)
    stacked = docs_ops.both_branches(texts.filter("raw_kind = 'binary'"), texts.filter("raw_kind = 'text'"))
    return docs_ops.docs_all(stacked, base.manifest(spark, sf)).select("case_id", "staged_name", F.length("text_blocks").cast("bigint").alias("chars"))


@query
def docs_failed(spark, sf):
    return base.outcome(spark, sf)[2]


@query
def docs_failed_with_skipped(spark, sf):
    return base.outcome(spark, sf, include_skipped=True)[2]


# --- enrichment --------------------------------------------------------------------------------------


@query
def prompt_inputs(spark, sf):
    return base.docs_all(spark, sf).select("case_id", "staged_name", enrich.prompt_text(F.col("text_blocks")).alias("prompt_text"))


@query
def summaries(spark, sf):
    return enrich.summarize(base.docs_all(spark, sf)).select("case_id", "staged_name", "resum")


@query
def summaries_lead(spark, sf):
    return enrich.summarize_lead(base.docs_all(spark, sf)).select("case_id", "staged_name", "resum")


@query
def classified(spark, sf):
    return enrich.stamp(base.classified(spark, sf)).select(
        "case_id", "staged_name", "classificacio", "score", "confidence", "model", "prompt_version", "source"
    )


@query
def classified_ml(spark, sf):
    """Quality labels learnt from the labelled documents, predicted for all."""
    docs = base.table(spark, sf, "documents").select("doc_id", F.col("text").alias("text_blocks"))
    # Shapes are a few numbers per document; they are computed once, for training and for all.
    shapes = stages.write_folder(enrich.text_shapes(docs), run_folder(spark, "shapes"))
    marks = base.table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    model = enrich.train_shapes(shapes.join(marks, "doc_id"), "quality")
    return enrich.classify_shapes(shapes, model=model).select("doc_id", "classificacio")


@query
def extracted_fields(spark, sf):
    docs = enrich.extract_fields(base.docs_all(spark, sf), rules=base.FIELD_RULES)
    flat = enrich.flatten_fields(docs)
    return flat.select(
        "case_id", "staged_name", "titol_document",
        *[rules.empty_to_null(F.col(c)).alias(c) for c in ("num_expedient", "data_document", "entitat_organisme", "proveidor_adjudicatari", "import_", "tipus_procediment")],
    )


@query
def incremental_todo(spark, sf):
    """English documents are done under the current prompt version, others under an older one."""
    docs = base.docs_all(spark, sf)
    version = F.when(F.col("classificacio") == "English", base.PROMPT_VERSION).otherwise("v1.0")
    done = base.classified(spark, sf, docs).withColumn("prompt_version", version)
    return docs_ops.todo(docs, done, base.PROMPT_VERSION).select("case_id", "staged_name")


@query
def resultat_final(spark, sf):
    return report.result_table(base.enriched(spark, sf))


@query
def report_export(spark, sf):
    """Written as a report with display headers, read back."""
    folder = run_folder(spark, "report")
    stages.write_report(report.display_columns(report.result_table(base.enriched(spark, sf))), folder, "parquet")
    return spark.read.parquet(folder)


@query
def report_widths(spark, sf):
    return report.column_widths(report.display_columns(report.result_table(base.enriched(spark, sf))))


@query
def scalar_rules(spark, sf):
    rows = base.manifest(spark, sf)
    name, staged = F.col("original_filename"), F.coalesce("staged_name", F.lit(""))
    status = F.when(F.col("kind") == "skipped", "ERROR").otherwise("CLASSIFIED")
    return rows.select(
        "case_id",
        "lineage",
        rules.document_id(F.col("case_id"), F.col("content_hash")).alias("doc_id"),
        rules.content_type(staged, name).alias("content_type"),
        rules.previewable(name, status).alias("previewable"),
        rules.tree_label(F.col("duplicate_of"), name, F.col("content_hash")).alias("tree_label"),
        rules.card_label(F.col("duplicate_of"), name, F.col("content_hash")).alias("card_label"),
        rules.safe_file_name(F.concat(F.lit(".."), F.col("lineage"))).alias("safe_name"),
        rules.valid_case_id(F.col("case_id")).alias("valid_case"),
        rules.valid_case_id(F.col("lineage")).alias("valid_lineage"),
        rules.payload(filename=name, kind=F.col("kind")).alias("payload"),
    )


# --- state -----------------------------------------------------------------------------------------


@query
def case_rollup(spark, sf):
    return base.cases(spark, sf).select("case_id", "owner", "status", "docs_total", "docs_classified", "docs_error")


@query
def classification_log(spark, sf):
    return versions.numbered(base.classification_log(spark, sf))


@query
def classification_latest(spark, sf):
    return versions.latest(base.classification_log(spark, sf))


@query
def classification_history(spark, sf):
    return versions.history(base.classification_log(spark, sf)).select("doc_id", "classificacio", "version", "archived_at")


@query
def classifications_replace(spark, sf):
    """All documents classified again: the old rows go to history, the new ones replace them."""
    current, incoming = _two_runs(spark, sf)
    replaced = state.replace_classifications(current, incoming).select("doc_id", "classificacio", "model", "prompt_version", F.lit("current").alias("part"))
    moved = state.archive_classifications(current, incoming, F.lit(NOW).cast("timestamp")).select("doc_id", "classificacio", "model", "prompt_version", F.lit("history").alias("part"))
    return replaced.unionByName(moved)


def _two_runs(spark, sf):
    """An older run that knew two languages, and one over everything."""
    rows = enrich.extract_fields(base.classified(spark, sf), rules=base.FIELD_RULES).withColumn("resum", F.lit(None).cast("string"))
    incoming = state.classification_rows(rows, F.lit(NOW).cast("timestamp"))
    current = incoming.filter(F.col("classificacio").isin("English", "French")).withColumns(
        {"model": F.lit("first"), "prompt_version": F.lit("v1.0"), "created_at": F.lit("2024-01-01 00:00:00").cast("timestamp")}
    )
    return current, incoming


@query
def documents_upsert(spark, sf):
    """Known documents: every staged one in English or French, read before unless it is a page
    file, and one per benchmark item.  The run brings everything."""
    now = F.lit(NOW).cast("timestamp")
    early = F.lit("2024-01-01 00:00:00").cast("timestamp")
    entries = base.entries(spark, sf)
    staged = normalize.manifest(entries.filter(F.col("lang").isin("en", "fr")))
    staged = docs_ops.kept(staged)
    pdf = F.col("suffix") == ".pdf"
    items = base.table(spark, sf, "benchmark").select(
        F.lit("bench").alias("case_id"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("staged_name"),
        F.col("text").alias("lineage"), F.lit(None).cast("string").alias("original_filename"),
    )
    known = state.upsert_documents(
        spark.createDataFrame([], state.DOCUMENTS),
        staged.filter(~pdf).select("case_id", "staged_name", "lineage", "original_filename").unionByName(items),
        staged.filter(pdf).select("case_id", "staged_name", "lineage", "original_filename"),
        early,
    )
    _, docs, failed = base.outcome(spark, sf)
    after = state.upsert_documents(known, docs, failed, now)
    return after.select("doc_id", "case_id", "staged_name", "status", "error_message", (F.col("created_at") < now).alias("known_before"), (F.col("updated_at") == now).alias("updated"))


@query
def cases_upsert(spark, sf):
    """Every case with uploads and every document source is touched by a run."""
    uploads = base.events(spark, sf).filter("type = 'FILES_UPLOADED'")
    sources = base.table(spark, sf, "documents").select(F.col("source").alias("case_id"))
    touched = state.touched_cases(uploads, sources)
    after = state.ensure_cases(base.cases(spark, sf), touched, "pipeline", _now())
    return after.select("case_id", "owner", "status", "docs_total", "updated_at")


def _case_requests(spark, sf):
    """Requests for every case, every document source and every customer name."""
    known = base.opened_cases(spark, sf).select("case_id", F.lit("again").alias("title"), "owner")
    sources = base.table(spark, sf, "documents").select(F.col("source").alias("case_id"), F.col("lang").alias("title"), F.concat("lang", F.lit("@example.com")).alias("owner"))
    names = base.table(spark, sf, "customer").select(F.col("c_name").alias("case_id"), F.lit(None).cast("string").alias("title"), F.lit("crm").alias("owner"))
    return known.unionByName(sources).unionByName(names).withColumn("description", F.lit(None).cast("string"))


@query
def create_cases(spark, sf):
    _, _, judged = state.create_cases(base.cases(spark, sf), _case_requests(spark, sf), _now())
    return judged.select("case_id", "title", "owner", "outcome")


@query
def create_cases_events(spark, sf):
    fresh, events, _ = state.create_cases(base.cases(spark, sf), _case_requests(spark, sf), _now())
    return events.join(fresh.select("case_id", "status", "docs_total"), "case_id").select(
        "case_id", "user", "type", "payload_json", "status", "docs_total"
    )


def _uploads(spark, sf):
    """Every upload event as a file with the event's number as size, for its case, and for a
    case named after the user alone, which does not exist."""
    rows = base.events(spark, sf).filter("type = 'FILES_UPLOADED'")
    owner = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    size = F.floor("value").cast("bigint")
    name = F.concat(F.lit("../in/"), F.col("event_id").cast("string"), F.lit(".pdf"))
    own = rows.select("case_id", name.alias("filename"), size.alias("bytes"), owner.alias("owner"))
    lost = rows.select(F.col("user_id").cast("string").alias("case_id"), F.lit("..").alias("filename"), size.alias("bytes"), owner.alias("owner"))
    return own.unionByName(lost)


@query
def register_uploads(spark, sf):
    _, _, judged = state.register_uploads(base.cases(spark, sf), _uploads(spark, sf), _now())
    return judged.select("case_id", "filename", "bytes", "owner", "outcome")


@query
def register_uploads_cases(spark, sf):
    cases, events, _ = state.register_uploads(base.cases(spark, sf), _uploads(spark, sf), _now())
    told = events.groupBy("case_id").agg(F.count(F.lit(1)).alias("told"), F.min("payload_json").alias("first_payload"))
    return cases.join(told, "case_id", "left").select("case_id", "status", "updated_at", "told", "first_payload")


@query
def delete_cases(spark, sf):
    """Closed cases go, with their documents and classifications."""
    cases, documents = base.cases(spark, sf), base.event_documents(spark, sf)
    classifications = documents.filter("status = 'CLASSIFIED'")
    left = state.delete_cases(cases.filter("status = 'CLOSED'"), cases, documents, classifications)
    parts = [t.select("case_id", F.lit(n).alias("part")) for t, n in zip(left, ("case", "document", "classification"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("case_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query
def remember_run(spark, sf):
    """The last order of each case's day stands for the run started for it."""
    cases = base.cases(spark, sf).withColumn("last_run_id", F.lit(None).cast("bigint"))
    runs = base.events(spark, sf).groupBy("case_id").agg(F.max("event_id").alias("last_run_id"))
    return state.remember_run(cases, runs, _now()).select("case_id", "last_run_id", "updated_at")


@query
def taxonomy_active(spark, sf):
    """Languages as labels, ordered by how many documents they have.  The store knows all of them and has some
    switched off; the seed, the languages with any long document, is applied twice."""
    used = base.table(spark, sf, "documents").groupBy(F.col("lang").alias("label")).agg(
        F.count(F.lit(1)).cast("int").alias("sort_order"), F.max("n_chars").alias("longest")
    )
    current = used.select("label", F.lit("known").alias("description"), (-F.col("sort_order")).alias("sort_order"), (F.col("label") > "en").alias("active"))
    seed = used.filter("longest >= 10000 and label <> 'fr'").select("label", F.concat(F.lit("texts in "), F.col("label")).alias("description"), "sort_order")
    return serving.taxonomy(state.seed_taxonomy(state.seed_taxonomy(current, seed), seed))


@query
def event_log(spark, sf):
    _, docs, failed = base.outcome(spark, sf)
    rows = state.run_events(base.classified(spark, sf, docs), failed, F.lit("pipeline"), F.lit(NOW).cast("timestamp"))
    return rows.select("case_id", "doc_id", "user", "type", "payload_json")


@query
def constraint_violations(spark, sf):
    entries = base.entries(spark, sf)
    items = base.manifest(spark, sf)
    parents = base.table(spark, sf, "labels").select(F.col("doc_id"))
    checks = [
        state.unique(entries, "entries", ["case_id", "content_hash"]),
        state.one_of(items, "manifest", "kind", ("binary", "text")),
        state.not_null(items, "manifest", ("staged_name", "duplicate_of", "lineage")),
        state.references(base.table(spark, sf, "documents").select("doc_id"), "documents", "doc_id", parents, "doc_id"),
    ]
    found = checks[0]
    for c in checks[1:]:
        found = found.unionByName(c)
    return found


# --- serving ---------------------------------------------------------------------------------------


@query
def case_list(spark, sf):
    cases = serving.scope_cases(base.cases(spark, sf), "User3@Example.com ", reviewers=["boss@example.com"])
    return serving.list_cases(cases, status="NEEDS_REVIEW").select("case_id", "owner", "status", "updated_at")


@query
def case_list_reviewer(spark, sf):
    cases = serving.scope_cases(base.opened_cases(spark, sf), "boss@example.com", reviewers=["Boss@example.com"])
    return serving.list_cases(cases).select("case_id", "owner", "status", "updated_at")


@query
def case_facets(spark, sf):
    """All facets at once; the search goes through an index of trigrams."""
    cases = base.cases(spark, sf)
    found = serving.facet_cases(
        cases, statuses=("READY", "NEEDS_REVIEW"), date="7d", errors_only=True, search=" 1-2024 ",
        now=F.lit("2024-01-31 00:00:00").cast("timestamp_ntz"), index=search.write_index(cases, run_folder(spark, "trigrams")),
    )
    return found.select("case_id", "status", "docs_error")


@query
def facet_counts(spark, sf):
    return serving.facet_counts(base.cases(spark, sf))


def _state_tables(spark, sf):
    _, docs, failed = base.outcome(spark, sf)
    now = F.lit(NOW).cast("timestamp")
    documents = state.upsert_documents(spark.createDataFrame([], state.DOCUMENTS), docs, failed, now)
    rows = enrich.extract_fields(base.classified(spark, sf, docs), rules=base.FIELD_RULES).withColumn("resum", F.lit(None).cast("string"))
    return documents, state.classification_rows(rows, now)


@query
def case_detail(spark, sf):
    documents, classifications = _state_tables(spark, sf)
    cases = state.ensure_cases(base.cases(spark, sf), state.touched_cases(documents), "pipeline", _now())
    seen = serving.scope_cases(cases, "Pipeline")
    return serving.case_detail(documents, classifications, "src3", seen).select(
        "owner", "case_status", "doc_id", "original_filename", "original_lineage", "status", "error_message", "titol", "classificacio", "confidence", "entitat_organisme"
    )


@query
def case_documents(spark, sf):
    documents, classifications = _state_tables(spark, sf)
    return serving.case_documents(documents, classifications).select("doc_id", "case_id", "status", "titol", "classificacio")


@query
def document_history(spark, sf):
    log = versions.history(base.classification_log(spark, sf)).withColumns(
        {
            "history_id": F.col("event_id"),
            "titol": F.lit(None).cast("string"),
            "source": F.lit("AUTO"),
            "correction_instruction": F.lit(None).cast("string"),
        }
    )
    return serving.document_history(log, "7:3").select("history_id", "classificacio", "source", "archived_at")


@query
def stats_totals(spark, sf):
    items, _, failed = base.outcome(spark, sf)
    documents = docs_ops.kept(items).select("case_id", "staged_name")
    failed = failed.select("case_id", "staged_name", F.lit("ERROR").alias("status"))
    documents = documents.join(failed, ["case_id", "staged_name"], "left")
    return serving.stats_totals(base.opened_cases(spark, sf), documents)


@query
def stats_totals_scoped(spark, sf):
    """The totals of one owner's cases; documents here are those of the events."""
    cases = base.cases(spark, sf)
    seen = serving.scope_cases(cases, "user3@example.com")
    return serving.stats_totals(cases, base.event_documents(spark, sf), seen)


@query
def stats_by_category(spark, sf):
    return serving.stats_by_category(base.classified(spark, sf))


@query
def stats_by_category_scoped(spark, sf):
    """The breakdown of one owner's cases; each source is a case, owned by its name."""
    cases = base.table(spark, sf, "documents").select(F.col("source").alias("case_id"), F.concat("source", F.lit("@example.com")).alias("owner")).distinct()
    return serving.stats_by_category(base.classified(spark, sf), serving.scope_cases(cases, "SRC1@example.com"))


@query
def case_lifecycle(spark, sf):
    return serving.lifecycle(base.cases(spark, sf))


def _runs(spark, sf):
    """Run states of the two tasks, read off the events of each run id."""
    rows = base.events(spark, sf)
    kinds = {"EXPEDIENT_CREATED": ("PENDING", None), "FILES_UPLOADED": ("RUNNING", None), "DOC_CLASSIFIED": ("TERMINATED", "SUCCESS"), "DOC_ERROR": ("TERMINATED", "FAILED")}
    life = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[0])])[F.col("type")]
    done = F.create_map(*[F.lit(x) for k, v in kinds.items() for x in (k, v[1])])[F.col("type")]
    return rows.select(
        F.col("event_id").alias("run_id"),
        F.when(F.col("user_id") % 2 == 0, "autoloader_ingest").otherwise("classify_merge").alias("task_key"),
        life.alias("life_cycle_state"),
        done.alias("result_state"),
    )


@query
def task_steps(spark, sf):
    cases = base.opened_cases(spark, sf)
    runs = base.events(spark, sf).groupBy("case_id").agg(F.max("event_id").alias("last_run_id"))
    with_run = cases.join(runs, "case_id", "left")
    return serving.task_steps(with_run, _runs(spark, sf)).select("case_id", "task_key", "state")


@query
def case_progress(spark, sf):
    """Cases with the last run that was started for each, and the states its two tasks are in."""
    last = base.events(spark, sf).groupBy("case_id").agg(F.max("event_id").alias("last_run_id"))
    reopened = F.when((F.col("docs_total") % 2 == 0) & (F.col("status") == "READY"), "PROCESSING").otherwise(F.col("status"))
    cases = base.cases(spark, sf).join(last, "case_id", "left").withColumn("status", reopened)
    rows = serving.progress(cases, _runs(spark, sf))
    show = lambda part: F.concat_ws(",", F.transform(part, lambda s: F.concat_ws("=", s["key"], s["state"])))
    return rows.select("case_id", "status", "docs_total", "docs_error", show("lifecycle").alias("lifecycle"), show("tasks").alias("tasks"))


@query
def document_files(spark, sf):
    documents, _ = _state_tables(spark, sf)
    items = docs_ops.kept(base.manifest(spark, sf))
    # Documents of page files are staged twice, to show that the binary one is taken.
    path = lambda kind: F.concat_ws("/", F.lit("staging"), F.col("case_id"), kind, F.col("staged_name"))
    staged = items.select("case_id", "staged_name", "kind", path(F.col("kind")).alias("path")).unionByName(
        items.filter("suffix = '.pdf'").select("case_id", "staged_name", F.lit("text").alias("kind"), path(F.lit("text")).alias("path"))
    )
    owned = base.table(spark, sf, "documents").select(F.col("source").alias("case_id")).distinct()
    return serving.locate_files(documents, staged, owned)
