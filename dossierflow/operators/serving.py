"""Read queries over the state tables: `(tables, parameters) -> DataFrame`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.functions import rules
from dossierflow.operators import heavy, search as search_index

LIST_LIMIT = 500
# Case states in display order.
STATUS_ORDER = ("DRAFT", "PROCESSING", "READY", "NEEDS_REVIEW", "CLOSED")
RESULT_LABELS = {"READY": "A punt", "NEEDS_REVIEW": "Cal revisió", "CLOSED": "Tancat"}
# The two tasks of a run with key, label and hint.
TASKS = (
    ("ingest", "autoloader_ingest", "Ingesta i normalització", "Descompressió (ZIP/.eml), extracció de text i deduplicació"),
    ("classify", "classify_merge", "Classificació amb IA", "ai_parse · ai_classify · ai_extract · resum en català"),
)
_FINISHED = ("READY", "NEEDS_REVIEW", "CLOSED")
DATE_RANGES = {"today": 1, "7d": 7, "30d": 30}


def scope_cases(cases: DataFrame, user: str | None, reviewers: Sequence[str] = ()) -> DataFrame:
    """Reviewers see every case, others their own, nobody without a name sees any."""
    name = (user or "").strip().lower()
    if not name:
        return cases.filter(F.lit(False))
    if name in {r.strip().lower() for r in reviewers}:
        return cases
    return cases.filter(F.lower("owner") == name)


def list_cases(cases: DataFrame, status: str | None = None, owner: str | None = None, limit: int = LIST_LIMIT) -> DataFrame:
    """Newest first, at most `limit`; an argument left out means any."""
    if status is not None:
        cases = cases.filter(F.col("status") == status)
    if owner is not None:
        cases = cases.filter(F.lower("owner") == owner.lower())
    return cases.orderBy(F.desc("updated_at"), "case_id").limit(limit)


def facet_cases(cases: DataFrame, statuses: Sequence[str] = (), date: str = "all", errors_only: bool = False, search: str = "", now: Column | None = None, index: str | None = None) -> DataFrame:
    """Cases that pass all facets.  With `index` (`search.write_index`) a search looks at candidates only."""
    if statuses:
        cases = cases.filter(F.col("status").isin(*statuses))
    if date in DATE_RANGES:
        now = F.current_timestamp() if now is None else now
        cases = cases.filter(F.col("created_at") >= now - F.make_dt_interval(days=F.lit(DATE_RANGES[date])))
    if errors_only:
        cases = cases.filter(F.col("docs_error") > 0)
    text = search.strip().lower()
    if text:
        some = search_index.candidates(cases.sparkSession, index, text) if index else None
        cases = cases.join(some, "case_id", "left_semi") if some is not None else cases
        title = F.col("title") if "title" in cases.columns else F.lit(None).cast("string")
        cases = cases.filter(
            F.lower("case_id").contains(text) | F.lower(F.coalesce(title, F.lit(""))).contains(text)
        )
    return cases


def facet_counts(cases: DataFrame) -> DataFrame:
    """Cases per known status with its display position; absent ones are left out."""
    place = F.array_position(F.array(*[F.lit(s) for s in STATUS_ORDER]), F.col("status")).cast("int")
    return (
        cases.groupBy("status")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("position", place)
        .filter("position > 0")
        .orderBy("position")
    )


_DETAIL = (
    "titol", "resum", "classificacio", "confidence", "num_expedient", "data_document",
    "entitat_organisme", "proveidor_adjudicatari", "import_", "tipus_procediment", "source",
    "correction_instruction",
)


def case_documents(documents: DataFrame, classifications: DataFrame, case_id: str | None = None) -> DataFrame:
    """Documents with their latest classification where there is one.  The case filter is put
    on both sides, so both tables prune by it."""
    if case_id is not None:
        documents = documents.filter(F.col("case_id") == case_id)
        classifications = classifications.filter(F.col("case_id") == case_id)
    values = classifications.select("doc_id", *_DETAIL, F.col("created_at").alias("classified_at"))
    return documents.select(
        "doc_id", "case_id", "original_filename", "original_lineage", "staged_kind", "status", "error_message"
    ).join(values, "doc_id", "left")


def case_detail(documents: DataFrame, classifications: DataFrame, case_id: str, cases: DataFrame | None = None) -> DataFrame:
    """Documents of one case in order of name.  With `cases`, as the user may see them, each row also has the
    case's owner, status and counters, a case without documents gives one row, and one that is not in `cases`
    gives none."""
    found = case_documents(documents, classifications, case_id)
    if cases is not None:
        head = cases.filter(F.col("case_id") == case_id).select(
            "case_id", "owner", F.col("status").alias("case_status"), "docs_total", "docs_classified", "docs_error"
        )
        found = head.join(found, "case_id", "left")
    return found.orderBy("original_filename", "doc_id")


def document_history(history: DataFrame, doc_id: str) -> DataFrame:
    return (
        history.filter(F.col("doc_id") == doc_id)
        .select("history_id", "classificacio", "titol", "source", "correction_instruction", "archived_at")
        .orderBy(F.desc("archived_at"), "history_id")
    )


def taxonomy(categories: DataFrame) -> DataFrame:
    return categories.filter("active").orderBy("sort_order", "label")


def stats_totals(cases: DataFrame, documents: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """One row of counts from one aggregate over both tables; each is read once.  With `scope`, rows with a
    unique case_id, only its cases and their documents count."""
    if scope is not None:
        seen = scope.select("case_id")
        cases, documents = (t.join(seen, "case_id", "left_semi") for t in (cases, documents))
    none = F.lit(0)
    counted = cases.select(F.lit(1).alias("c"), none.alias("d"), none.alias("e")).unionByName(
        documents.select(none.alias("c"), F.lit(1).alias("d"), (F.col("status") == "ERROR").cast("int").alias("e"))
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0).cast("bigint"))
    return counted.agg(total("c").alias("expedients"), total("d").alias("documents"), total("e").alias("errors"))


def stats_by_category(classifications: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """Classified documents per label.  With `scope`, rows with a unique case_id, only those of its cases; labels are
    counted per case before cases are looked up."""
    if scope is not None:
        per_case = classifications.filter(F.col("classificacio").isNotNull()).groupBy("case_id", F.col("classificacio").alias("label")).agg(F.count(F.lit(1)).alias("n"))
        seen = per_case.join(scope.select("case_id"), "case_id", "left_semi")
        return seen.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label")
    return (
        classifications.filter(F.col("classificacio").isNotNull())
        .groupBy(F.col("classificacio").alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), "label")
    )


def _step(position: int, key: str, label, state: Column) -> Column:
    label = label if isinstance(label, Column) else F.lit(label)
    return F.struct(
        F.lit(position).alias("position"), F.lit(key).alias("step"), label.alias("label"), state.alias("state")
    )


def _lifecycle_steps() -> Column:
    status = F.col("status")
    result_label = F.lit("Resultats")
    for s, text in RESULT_LABELS.items():
        result_label = F.when(status == s, text).otherwise(result_label)
    return F.array(
        _step(0, "draft", "Esborrany", F.when(status == "DRAFT", "current").otherwise("done")),
        _step(1, "processing", "Processant",
              F.when(status == "DRAFT", "pending").when(status == "PROCESSING", "running").otherwise("done")),
        _step(2, "result", result_label,
              F.when(status == "NEEDS_REVIEW", "error").when(status.isin(*_FINISHED), "done").otherwise("pending")),
    )


def lifecycle(cases: DataFrame) -> DataFrame:
    """Three steps per case with their state; rows are widened in place, nothing is joined."""
    return cases.select("case_id", F.inline(_lifecycle_steps()))


def run_state(life_cycle: Column, result: Column) -> Column:
    """State of a run task as a step state; NULLs and waiting states are pending."""
    return (
        F.when(result.isin("FAILED", "TIMEDOUT") | (life_cycle == "INTERNAL_ERROR"), "error")
        .when((result == "SUCCESS") | (life_cycle == "TERMINATED"), "done")
        .when(life_cycle.isin("RUNNING", "TERMINATING"), "running")
        .when(life_cycle == "SKIPPED", "skipped")
        .otherwise("pending")
    )


def _task_steps() -> Column:
    """Two tasks: as the run tells where it is `known`, else as the status implies."""
    items = []
    for i, (key, task, label, hint) in enumerate(TASKS):
        started = "running" if i == 0 else "pending"
        inferred = (
            F.when(F.col("status").isin(*_FINISHED), "done")
            .when(F.col("status") == "PROCESSING", started)
            .otherwise("pending")
        )
        state = F.when(F.col("known"), F.coalesce(F.col(f"run_{i}"), F.lit("pending"))).otherwise(inferred)
        items.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(key).alias("key"), F.lit(task).alias("task_key"),
                F.lit(label).alias("label"), F.lit(hint).alias("hint"), state.alias("state"),
            )
        )
    return F.array(*items)


def with_run_states(cases: DataFrame, runs: DataFrame | None = None, salts: int = 16) -> DataFrame:
    """Cases with `known` and the state of each task of their run (run_id, task_key, life_cycle_state,
    result_state).

    Runs become one row each before the join, and only processing cases with a run take part in it.  Cases of a run
    that many share are dealt to `salts` parts; only the rows of such runs are replicated."""
    states = [f"run_{i}" for i in range(len(TASKS))]
    unknown = {"known": F.lit(False), **{s: F.lit(None).cast("string") for s in states}}
    if runs is None:
        return cases.withColumns(unknown)
    state = run_state(F.col("life_cycle_state"), F.col("result_state"))
    per_run = runs.groupBy("run_id").agg(
        *[F.max(F.when(F.col("task_key") == task, state)).alias(s) for s, (_, task, _, _) in zip(states, TASKS)]
    )
    per_run = per_run.filter(F.col("run_id").isNotNull()).select(F.col("run_id").alias("_run"), *states, F.lit(True).alias("found"))
    asks = F.coalesce((F.col("status") == "PROCESSING") & F.col("last_run_id").isNotNull(), F.lit(False))
    asking = cases.filter(asks).withColumn("_run", F.col("last_run_id"))
    told = heavy.join(asking, per_run, "_run", "left", salts=salts, deal_by=F.col("case_id"))
    told = told.withColumn("known", F.coalesce("found", F.lit(False)))
    return told.select(*cases.columns, "known", *states).unionByName(cases.filter(~asks).withColumns(unknown))


def task_steps(cases: DataFrame, runs: DataFrame | None = None, salts: int = 16) -> DataFrame:
    """Two tasks per case.  While a case is processing and its run is known, states come from
    `runs`; otherwise from the status."""
    return with_run_states(cases, runs, salts).select("case_id", F.inline(_task_steps()))


def progress(cases: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Counters of each case with its lifecycle and task steps as arrays, projected in place."""
    life = F.transform(
        _lifecycle_steps(), lambda s: F.struct(s["position"].alias("position"), s["step"].alias("key"), s["label"].alias("label"), s["state"].alias("state"))
    )
    tasks = F.transform(_task_steps(), lambda s: F.struct(*[s[c].alias(c) for c in ("position", "key", "label", "state")]))
    return with_run_states(cases, runs).select(
        "case_id", "status", "docs_total", "docs_classified", "docs_error", life.alias("lifecycle"), tasks.alias("tasks")
    )


def locate_files(documents: DataFrame, staged: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """Staged file of each document (rows case_id, kind, staged_name, path): of the recorded
    kind, else binary before text; the first that exists.  With `cases`, only documents whose
    case is in it."""
    if cases is not None:
        documents = heavy.join(documents, cases.select("case_id").distinct(), "case_id", "left_semi")
    rank = F.when(F.col("kind") == "binary", 0).otherwise(1)
    files = staged.filter(F.col("kind").isin("binary", "text")).select(
        "case_id", "staged_name", "kind", "path", rank.alias("rank")
    )
    options = documents.select("doc_id", "case_id", "staged_name", "staged_kind", "original_filename", "status").join(
        files, ["case_id", "staged_name"], "left"
    )
    usable = F.col("staged_kind").isNull() | (F.col("staged_kind") == F.col("kind"))
    best = options.groupBy("doc_id", "case_id", "staged_name", "original_filename", "status").agg(
        F.min(F.when(usable & F.col("path").isNotNull(), F.struct("rank", "path", "kind"))).alias("file")
    )
    return best.select(
        "doc_id",
        "case_id",
        "original_filename",
        F.col("file.kind").alias("kind"),
        F.col("file.path").alias("path"),
        rules.content_type(F.col("staged_name"), F.col("original_filename")).alias("content_type"),
        rules.previewable(F.col("original_filename"), F.col("status")).alias("previewable"),
    )
