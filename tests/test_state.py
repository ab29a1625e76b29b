"""State tables: classify-and-merge runs, re-runs, requests, and constraints."""

import pytest
from pyspark.sql import functions as F

from dossierflow.functions import bloom
from dossierflow.operators import documents, enrich, normalize, state
from dossierflow.operators.expand import expand_containers
from dossierflow.plans.built_files import docx
from dossierflow.plans.merge_run import classify_and_merge
from dossierflow.sources import runs
from samples import zipped

T1, T2 = "2024-01-01 00:00:00", "2024-02-01 00:00:00"


def at(text):
    return F.lit(text).cast("timestamp")


class State:
    """The latest run below a folder, and what the caller put in its place."""

    def __init__(self, spark, tmp_path):
        self.spark, self.root, self.folder, self.put = spark, str(tmp_path / "state"), None, {}

    def tables(self):
        return {**runs.read_state(self.spark, self.folder), **self.put}

    def read(self, table):
        return runs.read_log(self.spark, self.root, table) if table in runs.LOGS else self.tables()[table]

    def merge(self, tmp_path, run, files, **options):
        entries = expand_containers(self.spark.createDataFrame(files, "case_id string, source_path string, content binary"))
        rules = enrich.taxonomy_keywords(enrich.default_taxonomy(self.spark))
        options["now"] = at(options.get("now", T1))
        written = classify_and_merge(
            self.spark, self.tables(), normalize.manifest(entries), entries, rules,
            str(tmp_path / f"work-{run}"), f"{self.root}/{run}", "me@example.com", **options,
        )
        self.folder, self.put = written or self.folder, {}
        return written


GOOD = docx(["Resolucion que adjudica un contrato", "Expedient: AB-1"])
FILES = [("E1", "a.docx", GOOD), ("E1", "b.png", b"png"), ("E2", "a.docx", docx(["Informe, fase de preparacion (RD)"]))]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_a_run_fills_all_tables(spark, tmp_path):
    store = State(spark, tmp_path)
    assert store.merge(tmp_path, "r1", FILES, run_id=7) == f"{store.root}/r1"
    assert rows(store.read("cases"), "case_id", "owner", "status", "docs_total", "docs_classified", "docs_error", "last_run_id") == [
        ("E1", "me@example.com", "NEEDS_REVIEW", 2, 1, 1, 7),
        ("E2", "me@example.com", "READY", 1, 1, 0, 7),
    ]
    docs = {r["doc_id"]: r for r in store.read("documents").collect()}
    # Both cases hold an a.docx: equal staged names, separate documents and texts.
    assert len(docs) == 3 and sum(r["status"] == "ERROR" for r in docs.values()) == 1
    assert {r["content_hash"] == r["staged_name"] for r in docs.values()} == {False}
    labels = rows(store.read("classifications"), "case_id", "classificacio", "num_expedient", "model", "prompt_version", "source")
    assert labels == [
        ("E1", "Resolucio adjudicacio", "AB-1", "ai_functions", "v2.0", "AUTO"),
        ("E2", "Inf fiscalitza fav foc RD_prepar", None, "ai_functions", "v2.0", "AUTO"),
    ]
    assert rows(store.read("events"), "type", "payload_json") == [
        ("DOC_CLASSIFIED", '{"classificacio":"Inf fiscalitza fav foc RD_prepar"}'),
        ("DOC_CLASSIFIED", '{"classificacio":"Resolucio adjudicacio"}'),
        ("DOC_ERROR", '{"original_filename":"b.png"}'),
    ]
    assert store.read("classification_history").isEmpty()
    assert state.check_constraints(store.read("cases"), store.read("documents"), store.read("classifications")).isEmpty()


def test_runs_are_repeatable_and_keep_history(spark, tmp_path):
    store = State(spark, tmp_path)
    store.merge(tmp_path, "r1", FILES)
    before = {t: sorted(map(str, store.read(t).collect())) for t in ("cases", "documents", "classifications", "events")}
    assert store.merge(tmp_path, "r1", FILES) == f"{store.root}/r1"
    assert before == {t: sorted(map(str, store.read(t).collect())) for t in before}
    # A new full run archives every current classification and replaces it.
    assert store.merge(tmp_path, "r2", FILES[:2], now=T2) == f"{store.root}/r2"
    assert rows(store.read("classification_history"), "case_id") == [("E1",)]
    assert store.read("classifications").count() == 2
    assert store.read("events").count() == 5
    assert rows(store.read("cases").filter("case_id = 'E2'"), "docs_total") == [(1,)]


def test_incremental_run_does_only_what_is_new(spark, tmp_path):
    store = State(spark, tmp_path)
    store.merge(tmp_path, "r1", FILES, mode="incremental")
    more = FILES + [("E2", "c.docx", docx(["Notificacion oficial"]))]
    store.merge(tmp_path, "r2", more, mode="incremental", now=T2)
    assert store.read("classification_history").isEmpty()
    assert store.read("classifications").count() == 3
    store.merge(tmp_path, "r3", more, mode="incremental", now=T2, prompt_version="v3")
    assert store.read("classification_history").count() == 3


def test_failure_and_recovery(spark, tmp_path):
    store = State(spark, tmp_path)
    store.merge(tmp_path, "r1", [("E1", "a.docx", b"broken")])
    assert rows(store.read("documents"), "status", "error_message") == [("ERROR", state.UNREADABLE)]
    store.merge(tmp_path, "r2", [("E1", "a.docx", GOOD)], now=T2)
    assert rows(store.read("documents"), "status", "error_message") == [("CLASSIFIED", None)]
    assert rows(store.read("cases"), "status") == [("READY",)]


def test_skipped_entries_on_request(spark, tmp_path):
    store = State(spark, tmp_path)
    store.merge(tmp_path, "r1", [("E1", "a.docx", GOOD), ("E1", "n.txt", b"x")], include_skipped=True)
    assert rows(store.read("documents"), "status") == [("CLASSIFIED",), ("ERROR",)]


def test_skipped_members_of_equal_lineage_stay_apart(spark, tmp_path):
    store = State(spark, tmp_path)
    files = [("E1", "a.docx", GOOD), ("E1", "z.zip", zipped([("n.txt", b"x"), ("n.txt", b"y"), ("n.txt", b"x")]))]
    for run, now in (("r1", T1), ("r2", T2)):
        store.merge(tmp_path, run, files, include_skipped=True, now=now)
        keys = ["z.zip > n.txt", "z.zip > n.txt#1", "z.zip > n.txt#2"]
        assert [r[0] for r in rows(store.read("documents").where("status = 'ERROR'"), "staged_name")] == keys
        assert rows(store.read("cases"), "docs_total", "docs_error") == [(4, 3)]
    assert store.read("events").where("type = 'DOC_ERROR'").count() == 6


def test_nothing_staged_changes_nothing(spark, tmp_path):
    store = State(spark, tmp_path)
    assert store.merge(tmp_path, "r1", [("E1", "n.txt", b"x")]) is None


def test_closed_cases_stay_closed(spark, tmp_path):
    store = State(spark, tmp_path)
    store.merge(tmp_path, "r1", FILES)
    closed = store.read("cases").withColumn("status", F.when(F.col("case_id") == "E1", "CLOSED").otherwise(F.col("status")))
    store.put = {"cases": closed}
    store.merge(tmp_path, "r2", FILES, now=T2)
    assert rows(store.read("cases"), "case_id", "status") == [("E1", "CLOSED"), ("E2", "READY")]


def test_two_runs_at_once_lose_nothing(spark, tmp_path):
    first, second = State(spark, tmp_path), State(spark, tmp_path)
    first.merge(tmp_path, "base", FILES)
    second.folder = first.folder
    first.merge(tmp_path, "a", [("E3", "a.docx", GOOD)], now=T2)
    second.merge(tmp_path, "b", [("E4", "a.docx", GOOD)], now=T2)
    seen = lambda s: {r["case_id"] for r in s.read("documents").collect()}
    assert seen(first) == {"E1", "E2", "E3"} and seen(second) == {"E1", "E2", "E4"}
    assert {r["case_id"] for r in first.read("events").collect()} == {"E1", "E2", "E3", "E4"}
    # The later one is run again on what the other left.
    second.folder = first.folder
    second.merge(tmp_path, "c", [("E4", "a.docx", GOOD)], now=T2)
    assert seen(second) == {"E1", "E2", "E3", "E4"}


def test_a_run_that_broke_off_is_written_again(spark, tmp_path):
    store = State(spark, tmp_path)
    store.merge(tmp_path, "r1", FILES)
    spark.createDataFrame([], state.DOCUMENTS).write.parquet(f"{store.root}/r2/documents")
    store.merge(tmp_path, "r2", FILES[:2], now=T2)
    assert store.read("documents").count() == 3


def parser_rows(df):
    """Rows that each parser node of an executed plan has received."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.finalPhysicalPlan())
            continue
        if hasattr(node, "plan") and node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        if node.nodeName() == "ArrowEvalPython":
            found.append(node.metrics().apply("pythonNumRowsReceived").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("batches", [False, True])
def test_only_wanted_entries_are_parsed_and_no_payload_moves(spark, tmp_path, batches):
    """Broadcast off: one parser node, as many rows as are wanted, no `data` below an exchange."""
    made = [(f"E{i % 5}", f"d{i}.docx", docx([f"Resolucion {i}"])) for i in range(50)]
    entries = expand_containers(spark.createDataFrame(made, "case_id string, source_path string, content binary"))
    if batches:  # three files come twice
        again = [(c, p, docx(["Segunda entrega"])) for c, p, _ in made[:3]]
        more = expand_containers(spark.createDataFrame(again, "case_id string, source_path string, content binary"))
        entries = entries.withColumn("batch_id", F.lit(0).cast("bigint")).unionByName(more.withColumn("batch_id", F.lit(1).cast("bigint")))
    entries.write.parquet(str(tmp_path / "entries"))
    entries = spark.read.schema(entries.schema).parquet(str(tmp_path / "entries"))
    wanted = normalize.manifest(entries.drop("batch_id").limit(50)).filter("original_filename in ('d1.docx', 'd17.docx')")
    wanted.write.parquet(str(tmp_path / "wanted"))
    wanted = spark.read.schema(wanted.schema).parquet(str(tmp_path / "wanted"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        texts = documents.texts_of(entries, wanted)
        got = sorted(r["text_blocks"] for r in texts.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == (["Resolucion 17", "Segunda entrega"] if batches else ["Resolucion 1", "Resolucion 17"])
    assert parser_rows(texts) == [2]
    shown = texts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    for line in shown.split("\n"):
        assert "Exchange" not in line or "data#" not in line


def test_a_run_parses_what_is_left_once(spark, tmp_path, monkeypatch):
    store, plans = State(spark, tmp_path), []
    from dossierflow.sources import stages

    write = stages.write_folder

    def watched(df, folder, *more):
        found = write(df, folder, *more)
        if folder.endswith("/texts"):
            plans.append(df)
        return found

    monkeypatch.setattr(stages, "write_folder", watched)
    store.merge(tmp_path, "r1", FILES[::2], mode="incremental")
    more = FILES[::2] + [("E2", "c.docx", docx(["Notificacion oficial"]))]
    store.merge(tmp_path, "r2", more, mode="incremental", now=T2)
    store.merge(tmp_path, "r3", more, now=T2)
    assert [spark.read.parquet(str(tmp_path / f"work-{r}/texts")).count() for r in ("r1", "r2", "r3")] == [2, 1, 3]
    for df, n in zip(plans, (2, 1, 3)):
        df.collect()
        assert parser_rows(df) == [n]


def test_bloom_filter_loses_no_key(spark):
    keys = spark.range(3000).select((F.col("id") * 7).alias("a"), F.col("id").cast("string").alias("b"))
    others = spark.range(3000).select((F.col("id") * 7 + 1).alias("a"), F.col("id").cast("string").alias("b"))
    size = bloom.size_for(3000)
    kept = lambda df, s: df.filter(bloom.may_hold(bloom.bits_of(keys, ["a", "b"], s), [F.col("a"), F.col("b")], s)).count()
    assert kept(keys, size) == 3000 and kept(others, size) < 30
    assert kept(keys, 64) == 3000  # far too small: all pass
    none = keys.limit(0)
    assert keys.filter(bloom.may_hold(bloom.bits_of(none, ["a", "b"], 64), [F.col("a"), F.col("b")], 64)).isEmpty()


def test_a_broken_off_run_is_not_read(spark, tmp_path):
    store = State(spark, tmp_path)
    store.merge(tmp_path, "r1", FILES)
    store.merge(tmp_path, "r2", FILES, now=T2)
    events = store.read("events").count()
    (tmp_path / "state/r2/_SUCCESS").unlink()
    assert store.read("events").count() == events // 2 and store.read("classification_history").isEmpty()
    with pytest.raises(runs.IncompleteRun):
        runs.read_state(spark, f"{store.root}/r2")
    with pytest.raises(runs.IncompleteRun):
        runs.read_state(spark, f"{store.root}/r9")
    store.folder = f"{store.root}/r1"
    store.merge(tmp_path, "r2", FILES, now=T2)
    assert store.read("events").count() == events and store.read("classification_history").count() == 2
    assert runs.read_log(spark, str(tmp_path / "nothing"), "events").isEmpty()


def test_deleting_a_case(spark, tmp_path):
    store = State(spark, tmp_path)
    store.merge(tmp_path, "r1", FILES)
    names = ("cases", "documents", "classifications")
    gone = spark.createDataFrame([("E1",)], "case_id string")
    left = state.delete_cases(gone, *[store.read(t) for t in names])
    assert all({r["case_id"] for r in t.collect()} == {"E2"} for t in left)
    assert store.read("events").count() == 3


def test_requests(spark):
    cases = state.conform(
        spark.createDataFrame([("E1", "a@x", "CLOSED"), ("E2", "b@x", "DRAFT")], "case_id string, owner string, status string"), state.CASES
    )
    asked = spark.createDataFrame(
        [("E1", "t", None, "u"), ("new-1", "t", None, "u"), ("new-1", "t2", None, "a"), ("-bad", "t", None, "u")],
        "case_id string, title string, description string, owner string",
    )
    fresh, events, judged = state.create_cases(cases, asked, at(T1))
    assert rows(judged, "case_id", "outcome") == [("-bad", "invalid"), ("E1", "exists"), ("new-1", "created")]
    assert rows(fresh, "case_id", "owner", "status", "docs_total") == [("new-1", "a", "DRAFT", 0)]
    assert rows(events, "case_id", "type", "payload_json") == [("new-1", "EXPEDIENT_CREATED", "{}")]
    uploads = spark.createDataFrame(
        [("E2", "../x/a.pdf", 5, "u"), ("E1", "a.pdf", 5, "u"), ("E9", "a.pdf", 5, "u"), ("E2", "...", 5, "u"), ("E2", "b.pdf", 0, "u")],
        "case_id string, filename string, bytes bigint, owner string",
    )
    after, told, judged = state.register_uploads(cases, uploads, at(T2))
    assert sorted(r["outcome"] for r in judged.collect()) == ["accepted", "closed", "empty", "no-name", "unknown-case"]
    assert rows(after, "case_id", "status") == [("E1", "CLOSED"), ("E2", "PROCESSING")]
    assert rows(told, "payload_json") == [('{"filename":"_x_a.pdf","bytes":5}',)]
    _, twice, _ = state.register_uploads(cases, uploads.unionByName(uploads), at(T2))
    assert twice.count() == 2 == twice.select("event_id").distinct().count()


def test_constraints_find_each_kind_of_violation(spark):
    cases = state.conform(spark.createDataFrame([("E1", None, "OPEN"), ("E1", "o", "READY")], "case_id string, owner string, status string"), state.CASES)
    docs = state.conform(spark.createDataFrame([("d1", "E1", "s", "NEW"), ("d2", "E7", "s", "ERROR")], "doc_id string, case_id string, staged_name string, status string"), state.DOCUMENTS)
    cls = state.conform(spark.createDataFrame([("d9", "GUESS")], "doc_id string, source string"), state.CLASSIFICATIONS)
    got = {(r["rule"], r["table"], r["key"]) for r in state.check_constraints(cases, docs, cls).collect()}
    assert got == {
        ("unique", "cases", "E1"), ("not null", "cases", "owner"), ("enum", "cases", "OPEN"),
        ("enum", "documents", "NEW"), ("foreign key", "documents", "E7"),
        ("enum", "classifications", "GUESS"), ("foreign key", "classifications", "d9"),
    }


def test_unknown_mode(spark, tmp_path):
    with pytest.raises(ValueError):
        State(spark, tmp_path).merge(tmp_path, "r", FILES, mode="some")
