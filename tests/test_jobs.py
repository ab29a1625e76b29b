"""The batch job, readers, parameters and plan shapes."""

import gzip
import hashlib
import zlib
from email.headerregistry import HeaderRegistry
from email.message import EmailMessage

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException, PythonException
from pyspark.sql import functions as F

from dossierflow import session
from dossierflow.operators import documents, enrich, expand, heavy, normalize, parse, report, search, serving, state
from dossierflow.plans import base, batch, built_files, queries
from dossierflow.plans.built_files import docx, pdf as page_file, pptx
from dossierflow.sources import files, stages
from dossierflow.streaming import ingest
from samples import mail, sheet, zipped


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "in"
    root.mkdir()
    (root / "b.docx").write_bytes(docx(["Resolucion que adjudica", "Expedient: X-9"]))
    (root / "a.zip").write_bytes(zipped([("s.xlsx", sheet([["Informe", "preparacion"]])), ("copy.docx", docx(["Resolucion que adjudica", "Expedient: X-9"]))]))
    (root / "m.eml").write_bytes(mail("Notificacion", "oficial al adjudicatario"))
    (root / ".hidden.pdf").write_bytes(b"x")
    return root


def test_batch_job(spark, folder, tmp_path):
    rules = enrich.taxonomy_keywords(enrich.default_taxonomy(spark))
    result = batch.run(spark, str(folder), rules, prefix="t1_")
    rows = result.collect()
    assert [r["nom_del_fitxer"] for r in rows] == ["copy.docx", "m.eml (cuerpo)", "s.xlsx"]
    assert list(rows[0].asDict()) == list(report.HEADERS)
    assert rows[0]["num_expedient"] == "X-9" and rows[0]["informacio_addicional_proposta"] == "Núm. expedient: X-9"
    assert {r["kind"] for r in spark.table("t1_manifest").collect()} == {"binary", "text", "duplicate"}
    widths = {r["col"]: r["width"] for r in batch.export(spark, "t1_resultat_final", str(tmp_path / "out")).collect()}
    assert widths["Nom del fitxer"] == 16 and widths["Import"] == 8 and max(widths.values()) <= 60
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert back.columns == list(report.HEADERS.values()) and back.count() == 3


def test_underscore_names_are_read_and_dot_names_are_not(spark, tmp_path):
    for name in ("a.pdf", "_b.pdf", "_in/c.pdf", "in/_d.pdf", ".e.pdf", ".in/f.pdf", "_in/.g.pdf", "_h.txt"):
        path = tmp_path / "names" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(name.encode())
    found = files.read_files(spark, str(tmp_path / "names"), "*.pdf").collect()
    got = {bytes(r["content"]).decode(): r["length"] for r in found}
    assert got == {n: len(n) for n in ("a.pdf", "_b.pdf", "_in/c.pdf", "in/_d.pdf")}
    rows = files.below(files.read_files(spark, str(tmp_path / "names")), str(tmp_path / "names"), "E1")
    assert {r["source_path"] for r in rows.select("source_path").collect()} == {"a.pdf", "_b.pdf", "_in/c.pdf", "in/_d.pdf", "_h.txt"}


def test_batch_job_without_files(spark, tmp_path):
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        batch.stage(spark, str(tmp_path / "none"), "t2_")


def test_staged_files_are_read_by_name(spark, tmp_path):
    for kind, name, data in (("binary", "doc_1.docx", docx(["u", "dos"])), ("text", "doc_2.txt", b"un\ndos"), ("text", "doc_3.txt", b"")):
        (tmp_path / "staging/E1" / kind).mkdir(parents=True, exist_ok=True)
        (tmp_path / "staging/E1" / kind / name).write_bytes(data)
    binaries = files.read_staged_binaries(spark, str(tmp_path / "staging/*/binary"))
    parsed = parse.parse_documents(binaries.select(F.lit("E1").alias("case_id"), "staged_name", F.lit(".docx").alias("suffix"), "data"))
    texts = files.read_staged_texts(spark, str(tmp_path / "staging/*/text")).withColumn("case_id", F.lit("E1"))
    rows = {r["staged_name"]: r["text_blocks"] for r in documents.both_branches(parsed, texts).collect()}
    assert rows == {"doc_1.docx": "u\ndos", "doc_2.txt": "un\ndos"}


def test_staged_entries_written_as_files(spark, folder, tmp_path):
    entries = batch.expand_containers(files.below(files.read_files(spark, str(folder)), str(folder), "E1"))
    staged = documents.staged_entries(entries).withColumn("kind", F.col("raw_kind"))
    written = stages.write_staged_files(staged, str(tmp_path / "staging")).collect()
    assert len(written) == 4
    binaries = files.read_staged_binaries(spark, str(tmp_path / "staging/*/binary")).collect()
    assert {bytes(r["data"]) for r in binaries} == {docx(["Resolucion que adjudica", "Expedient: X-9"])}
    assert files.read_staged_texts(spark, str(tmp_path / "staging/*/text")).count() == 2


def test_parsers(spark):
    made = [(".docx", docx(["a <b>", "", "c"])), (".pptx", pptx(["x", "y"])), (".pdf", page_file(["u (1)", r"d\s"])), (".doc", b"old"), (".png", b"p"), (".docx", b"broken")]
    df = spark.createDataFrame([(i, s, d) for i, (s, d) in enumerate(made)], "i int, suffix string, data binary")
    rows = parse.parse_documents(df).orderBy("i").collect()
    assert [r["text_blocks"] for r in rows] == ["a <b>\n\nc", "x\ny", "u (1)\nd\\s", "", "", ""]
    assert [r["parse_error"] for r in rows] == [None, None, None, "unsupported-format:.doc", "unsupported-format:.png", "unreadable:BadZipFile"]


def test_page_files_of_other_writers(spark):
    """Hex strings, ToUnicode maps, gaps, escapes over lines, a picture and a stream that does not inflate."""
    cmap = b"/CMapName /X def 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0003> <0020> <0005> <00660069> endbfchar 1 beginbfrange <0024> <0026> <0041> <0030> <0031> [<00E9> <20AC>] endbfrange"
    page = b"BT /F1 12 Tf <48656C6C6F> Tj [(Hel\\\nlo) -600 (wor) 20 (ld) -100 (!)] TJ (a\\(b\\)\\051) ' /F2 9 Tf <002400250003002600300031> Tj [<0005> -300 <0024>] TJ ET"
    stream = lambda n, head, body: b"%d 0 obj\n<< %s /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (n, head, len(body), body)
    data = (
        b"%PDF-1.4\n1 0 obj\n<< /Type /Page /Resources << /Font << /F1 2 0 R /F2 3 0 R >> >> >>\nendobj\n"
        b"2 0 obj\n<< /Type /Font >>\nendobj\n3 0 obj\n<< /Type /Font /ToUnicode 4 0 R >>\nendobj\n"
        + stream(4, b"", cmap) + stream(5, b"/Filter /FlateDecode", b"broken") + stream(6, b"/Subtype /Image", b"(no) Tj")
        + stream(7, b"/Filter /FlateDecode", zlib.compress(page)) + b"%%EOF"
    )
    got = parse.parse_documents(spark.createDataFrame([(".pdf", data)], "suffix string, data binary")).first()
    assert got["text_blocks"].split("\n") == ["Hello", "Hello world!", "a(b))", "AB Cé€", "fi A"] and got["parse_error"] is None


def test_parameters(spark):
    spark.conf.set("dossierflow.volume", "v1")
    assert session.param(spark, "volume") == "v1"
    assert session.param(spark, "volume", "given") == "given"
    assert session.param(spark, "nothing", default="d") == "d"
    with pytest.raises(KeyError):
        session.param(spark, "nothing")


def test_scope_of_a_user(spark):
    cases = spark.createDataFrame([("1", "A@x.com"), ("2", "b@x.com")], "case_id string, owner string")
    seen = lambda user: sorted(r["case_id"] for r in serving.scope_cases(cases, user, ["Boss@x.com"]).collect())
    assert (seen("a@X.com"), seen(" boss@x.com"), seen("c@x.com"), seen(""), seen(None)) == (["1"], ["1", "2"], [], [], [])


def test_task_states_follow_a_known_run(spark):
    cases = spark.createDataFrame([("a", "PROCESSING", 1), ("b", "PROCESSING", 2), ("c", "READY", 1), ("d", "DRAFT", None)], "case_id string, status string, last_run_id bigint")
    runs = spark.createDataFrame([(1, "autoloader_ingest", "TERMINATED", "SUCCESS"), (1, "classify_merge", "INTERNAL_ERROR", None)], "run_id bigint, task_key string, life_cycle_state string, result_state string")
    got = {(r["case_id"], r["key"]): r["state"] for r in serving.task_steps(cases, runs).collect()}
    assert got == {
        ("a", "ingest"): "done", ("a", "classify"): "error", ("b", "ingest"): "running", ("b", "classify"): "pending",
        ("c", "ingest"): "done", ("c", "classify"): "done", ("d", "ingest"): "pending", ("d", "classify"): "pending",
    }


# --- plan shapes -------------------------------------------------------------------------------


def test_runs_are_not_replicated_for_the_join_with_cases(spark):
    """Only the rows of runs that many cases share are met in several parts."""
    cases = spark.range(4000).selectExpr("cast(id as string) AS case_id", "'PROCESSING' AS status", "if(id < 3000, 7, id) AS last_run_id")
    runs = spark.range(4000).selectExpr("id AS run_id", "'classify_merge' AS task_key", "'TERMINATED' AS life_cycle_state", "if(id = 7, 'FAILED', 'SUCCESS') AS result_state")
    told = serving.with_run_states(cases, runs)
    assert {(r["run_1"], r["known"]): r["count"] for r in told.groupBy("run_1", "known").count().collect()} == {("error", True): 3000, ("done", True): 1000}
    assert "explode(sequence(" not in told._jdf.queryExecution().analyzed().toString()  # every run in every part


def test_bucketed_stages_join_without_an_exchange(spark, sf):
    key = documents.DOCUMENT_KEY
    texts = stages.save_stage(base.texts(spark, sf).drop("raw_kind"), "t3_texts", key, 4)
    items = stages.save_stage(base.manifest(spark, sf), "t3_manifest", key, 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Exchange" not in plan(documents.docs_all(texts, items))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_payloads_of_staged_entries_are_read_once_and_texts_move_once(spark, folder):
    entries, manifest = batch.stage(spark, str(folder), "t4_")
    texts = stages.save_stage(documents.texts_of(entries), "t4_texts", documents.DOCUMENT_KEY)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        docs = documents.docs_all(texts, manifest)
        shown = plan(docs)
        derived = plan(documents.docs_all(documents.texts_of(entries), normalize.manifest(entries)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in shown and docs.count() == 3
    schemas = [part.split("\n")[0] for part in derived.split("ReadSchema: ")[1:]]
    assert sum("text:string" in s and "data:binary" in s for s in schemas) <= 1
    assert sum("data:binary" in s for s in schemas) <= 1


def test_entries_are_read_once_for_a_manifest(spark, sf):
    df = base.manifest(spark, sf)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final


def test_each_field_pattern_runs_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("text").alias("text_blocks"), F.lit("l").alias("lineage"), F.lit("n").alias("original_filename"), F.lit("r").alias("resum"), F.lit("c").alias("classificacio"))
    shown = plan(report.result_table(enrich.extract_fields(docs, rules=base.FIELD_RULES)))
    assert shown.count("regexp_extract(") == len(base.FIELD_RULES)


def test_a_filter_on_the_label_does_not_repeat_the_counting(spark, sf):
    shown = plan(serving.stats_by_category(base.classified(spark, sf)))
    assert shown.count("ArrowEvalPython") == 1
    assert "CartesianProduct" not in shown and "NestedLoop" not in shown


def test_case_queries_have_no_cross_join_and_prune_columns(spark, sf):
    shown = plan(serving.lifecycle(base.cases(spark, sf)))
    assert "CartesianProduct" not in shown and "NestedLoop" not in shown
    assert "props" not in shown
    assert "TakeOrderedAndProject" in plan(serving.list_cases(base.opened_cases(spark, sf)))


def test_listing_files_does_not_read_them(spark, tmp_path):
    """Names come from tasks, level by level; a file that cannot be read is listed all the same."""
    (tmp_path / "in/deep/_er").mkdir(parents=True)
    (tmp_path / "in/deep/_er/a b.pdf").write_bytes(b"xyz")
    (tmp_path / "in/b.pdf").symlink_to(tmp_path / "nowhere")
    found = files.list_files(spark, str(tmp_path / "in")).collect()
    assert [(r["path"], r["length"]) for r in found] == [(f"file:{tmp_path}/in/deep/_er/a b.pdf", 3)]
    assert files.list_files(spark, str(tmp_path / "none")).isEmpty()
    assert "content" not in files.list_files(spark, str(tmp_path / "in")).columns


def test_both_ways_bring_the_same_names(spark, tmp_path):
    """Underscore names arrive by batch and by stream; a second call of the stream brings what is new."""
    landing = tmp_path / "landing/E1/raw"

    def land(*names):
        for name in names:
            (landing / name).parent.mkdir(parents=True, exist_ok=True)
            (landing / name).write_bytes(name.encode())

    def drain():
        stream = files.stream_listed(spark, str(tmp_path / "landing"), str(tmp_path / "work"), "*.pdf", files_per_batch=2)
        return ingest.ingest(stream, ingest.Staging(spark, str(tmp_path / "staging")), str(tmp_path / "checkpoint"))

    land("a.pdf", "_a/b.pdf", "_c.pdf", "x/_y/d.pdf", "e.pdf", ".f.pdf", ".g/h.pdf", "i.txt")
    rows = files.landed(files.read_files(spark, str(tmp_path / "landing"), "*.pdf")).collect()
    assert {(r["case_id"], r["source_path"], bytes(r["content"]).decode()) for r in rows} == {("E1", n, n) for n in ("a.pdf", "_a/b.pdf", "_c.pdf", "x/_y/d.pdf", "e.pdf")}
    first = drain()
    assert {r["lineage"] for r in first.manifest().collect()} == {r["source_path"] for r in rows}
    assert first.entries().select("batch_id").distinct().count() == 3
    land("_j.pdf")
    assert {r["lineage"] for r in drain().manifest().collect()} == {r["source_path"] for r in rows} | {"_j.pdf"}


def test_a_heavy_case_is_met_by_many_tasks(spark):
    """A case with a third of the files, a third of them equal, spreads over eight tasks; nothing is broadcast."""
    files_of = spark.range(6000).selectExpr(
        "case when id % 3 = 0 then 'hot' else concat('c', id % 500) end as case_id",
        "case when id % 9 = 0 then 'same.pdf' else concat(id, '.pdf') end as filename", "1L as bytes", "'me' as owner",
    )
    cases = state.conform(files_of.select("case_id").distinct().withColumn("status", F.lit("DRAFT")), state.CASES)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        _, events, judged = state.register_uploads(cases, files_of, F.lit("2024-01-01 00:00:00").cast("timestamp"))
        spread = judged.filter("case_id = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()
        documents_of = files_of.withColumn("doc_id", F.monotonically_increasing_id())
        kept = state.delete_cases(cases.filter("case_id like 'c1%'"), cases, documents_of, documents_of)[1]
        left = kept.filter("case_id = 'hot'").groupBy(F.spark_partition_id().alias("task")).count().collect()
        assert judged.count() == 6000 == events.select("event_id").distinct().count()
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert len(spread) == 8 == len(left)
    for found, total in ((spread, 2000), (left, 2000)):
        assert sum(r["count"] for r in found) == total and max(r["count"] for r in found) < 0.4 * total
    assert kept.count() == files_of.filter("case_id not like 'c1%'").count()


def test_heavy_join_is_a_join(spark):
    rows = spark.range(900).selectExpr("case when id % 3 = 0 then null when id % 3 = 1 then 'h' else concat('k', id % 50) end as k", "id as v")
    other = spark.createDataFrame([("h", 1), ("k1", 2), ("k2", 3), (None, 4)], "k string, w int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plainly = rows.join(other, "k", how)
        assert sorted(map(str, heavy.join(rows, other, "k", how).collect())) == sorted(map(str, plainly.collect()))
        assert heavy.join(rows.limit(0), other, "k", how).isEmpty()


def test_a_search_reads_candidates(spark, tmp_path):
    cases = spark.range(3000).selectExpr("concat('Case-', id) as case_id", "if(id % 10 = 0, concat('Obra nº ', id % 13), null) as title", "id as docs_error")
    folder = search.write_index(cases, str(tmp_path / "index"))
    plainly = lambda text: sorted(r[0] for r in serving.facet_cases(cases, search=text).select("case_id").collect())
    for text in ("case-299", "BRA Nº 1", "e-1", "se", "zzz", " OBRA ", "-2999x"):
        found = serving.facet_cases(cases, search=text, index=folder)
        assert sorted(r[0] for r in found.select("case_id").collect()) == plainly(text)
    asked = search.candidates(spark, folder, "case-299")
    assert asked.count() == 11
    parts = plan(asked).split("PartitionFilters: [")[1].split("]")[0]
    assert "part#" in parts and "trigram" in plan(asked).split("PushedFilters: [")[1].split("]")[0]
    shown = plan(serving.facet_cases(cases, search="case-299", index=folder))
    assert "LeftSemi" in shown


# --- bounded tasks -----------------------------------------------------------------------------


def test_a_batch_is_parsed_in_slices(monkeypatch):
    done = []
    monkeypatch.setattr(parse, "_parse_one", lambda d, s: done.append(d) or {"elements": [{"type": "text", "content": d.decode()}], "error_status": None})
    data = [b"%d" % i for i in range(1000)]
    slices = parse._parsed_slices(pa.array(data, pa.binary()), pa.array([".html"] * 1000))
    first = next(slices)
    assert len(first) == len(done) < 100
    rows = pa.concat_arrays([first, *slices]).to_pylist()
    assert [r["elements"][0]["content"].encode() for r in rows] == done == data


def test_files_are_made_in_slices():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(500)), "text": [f"t{i}" for i in range(500)]})
    done = []
    made = built_files._with_made([batch], ["doc_id"], lambda r: done.append(r["doc_id"]) or r["text"].encode())
    first = next(made)
    assert first.num_rows == len(done) < 100
    rows = pa.Table.from_batches([first, *made]).to_pylist()
    assert rows == [{"doc_id": i, "content": b"t%d" % i} for i in range(500)]


def test_whole_texts_come_back_under_their_names(spark, tmp_path):
    """Names that paths write differently, rows that come twice, and no folder for each text."""
    cases = ["a/b", "k=v", "50%", "x+y z", "_hidden", "plain"]
    rows = [(i, f"text {i}\nline", "en", c, 11) for i, c in zip((8, 9, 10, 11, 14, 15), cases)]
    table = spark.createDataFrame([*rows, rows[-1]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    table.write.parquet(str(tmp_path / "documents.parquet"))
    expected = {(r["case_id"], r["staged_name"]) for r in base.docs_all(spark, str(tmp_path)).collect()}
    got = queries.read_whole_text(spark, str(tmp_path))
    found = {(r["case_id"], r["staged_name"]): r["text_md5"] for r in got.collect()}
    assert set(found) == expected and {c for c, _ in found} == set(cases)
    text = {c: hashlib.md5(f"{t}\n".encode()).hexdigest() for _, t, _, c, _ in rows}
    assert all(found[k] == text[k[0]] for k in found if k[0] != "plain")
    assert len({f.rsplit("/", 1)[0] for f in got.inputFiles()}) == len(cases)


def test_whole_texts_are_listed_and_read_by_tasks(spark, tmp_path):
    """The rows of Spark's text reader, for odd names and wildcards, from a plan that names no text."""
    names = ("a/x y.txt", "a/50%.txt", "a/é+=&;@.txt", "a/[b]{c}^.txt", "b 1/z.txt", "b 1/_no.txt", "b 1/.no.txt", "b 1/_k=v.txt", "b 1/_metadata", "b 1/deep/no.txt")
    for name in (*names, "c/k=2/in.txt", "_h/t.txt", "a/text/t1.txt", "b 1/text/t2.txt", "e/empty.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"" if name == "e/empty.txt" else name.encode() + b"\r\n\xff\xfe")
    (tmp_path / "e/g.txt.gz").write_bytes(gzip.compress(b"zipped"))
    (tmp_path / "e/h.txt.deflate").write_bytes(zlib.compress(b"deflated"))
    (tmp_path / "void").mkdir()
    for i in range(2500):
        (tmp_path / f"e/{i}.txt").write_text(f"text {i}")
    rows = lambda df: sorted((r["staged_name"], r["path"], bytes(r["body"])) for r in df.select("staged_name", "path", F.col("text_blocks").cast("binary").alias("body")).collect())
    for given in (["[ab]*"], ["a", "a", "e"], ["{a/text,e}"], ["*/text"], ["*/*.txt"], ["c"], ["a/x y.txt"], ["_h"], ["void"]):
        folders = [f"{tmp_path}/{g}" for g in given]
        plain = spark.read.text(folders, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
        expected = rows(plain.select(F.regexp_extract("path", "([^/]+)$", 1).alias("staged_name"), "path", F.col("value").alias("text_blocks")))
        got = files.read_staged_texts(spark, folders)
        assert rows(got) == expected and (expected or given == ["void"])
        assert not any(str(tmp_path) in f for f in got.inputFiles())
    assert len(files.read_staged_texts(spark, f"{tmp_path}/e").inputFiles()) < 10
    with pytest.raises(AnalysisException):
        files.read_staged_texts(spark, [f"{tmp_path}/a", f"{tmp_path}/none*"])
    (tmp_path / "void/s.txt.snappy").write_bytes(b"x")
    with pytest.raises(PythonException, match="only Hadoop"):
        files.read_staged_texts(spark, f"{tmp_path}/void").collect()


def test_mails_are_written_and_read_as_by_the_general_code(monkeypatch):
    for body in ("", "plain", "é\n\n", "a\rb\r\nc\x0b\x0c\x1c\x85", "From x\n--b\n.\n", "long " * 100 + "ü\n" + "x" * 2000):
        general = EmailMessage()
        general["Subject"], general["From"] = "en", "sender@example.com"
        general.set_content(body)
        entries = [list(expand.leaves(expand.Part("m.eml", [], ".eml", m))) for m in (general.as_bytes(), built_files.mail("en", body))]
        assert entries[0] == entries[1] and len(entries[0]) == 1
    calls = []
    monkeypatch.setattr(expand, "HeaderRegistry", lambda: lambda name, value: calls.append((name, value)) or HeaderRegistry()(name, value))
    list(expand.leaves(expand.Part("m.eml", [], ".eml", general.as_bytes())))
    assert calls and len(calls) == len(set(calls))  # no header twice
