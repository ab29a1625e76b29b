"""Normalisation from files in memory to manifest."""

import hashlib

from pyspark.sql import functions as F

from dossierflow.functions import paths
from dossierflow.operators import normalize
from dossierflow.operators.expand import expand_containers
from dossierflow.sources import files as readers, stages
from samples import landed, mail, pdf, sheet, zipped


def run(spark, files, scope="case"):
    entries = expand_containers(landed(spark, files))
    return entries, normalize.manifest(entries, scope)


def by_lineage(manifest):
    return {r["lineage"]: r for r in manifest.collect()}


def test_known_binaries_and_an_unknown_suffix(spark):
    _, m = run(spark, [("a.pdf", pdf()), ("notes.txt", b"plain text"), ("img.png", b"\x89PNG..")])
    counts = {r["kind"]: r["n"] for r in normalize.kind_counts(m).collect()}
    assert counts == {"binary": 2, "skipped": 1}
    assert by_lineage(m)["notes.txt"]["reason"] == "unsupported-ext:.txt"
    assert by_lineage(run(spark, [("README", b"x")])[1])["README"]["reason"] == "unsupported-ext:none"


def test_spreadsheet_becomes_text(spark):
    entries, m = run(spark, [("full.xlsx", sheet([["Expedient", "Import"], ["AG-2024-4", "1000"]]))])
    assert by_lineage(m)["full.xlsx"]["kind"] == "text"
    assert entries.first()["text"] == "### Hoja: Hoja1\nExpedient | Import\nAG-2024-4 | 1000"


def test_archive_is_opened_and_not_staged(spark):
    inner = [("folder/annex.pdf", pdf(b"annex")), ("sheet.xlsx", sheet([["a", "b"]]))]
    m = by_lineage(run(spark, [("docs.zip", zipped(inner))])[1])
    assert {k: r["kind"] for k, r in m.items()} == {
        "docs.zip > folder/annex.pdf": "binary",
        "docs.zip > sheet.xlsx": "text",
    }
    assert m["docs.zip > folder/annex.pdf"]["original_filename"] == "annex.pdf"


def test_nested_archive(spark):
    outer = zipped([("inner.zip", zipped([("deep.pdf", pdf(b"deep"))])), ("top.pdf", pdf(b"top"))])
    m = by_lineage(run(spark, [("outer.zip", outer)])[1])
    assert m["outer.zip > top.pdf"]["kind"] == "binary"
    assert m["outer.zip > inner.zip > deep.pdf"]["kind"] == "binary"


def test_mail_body_and_attachment(spark):
    entries, m = run(spark, [("mail.eml", mail("Prova", "Cos del correu", [("contract.pdf", pdf(b"contract"))]))])
    kinds = {k: r["kind"] for k, r in by_lineage(m).items()}
    assert kinds == {"mail.eml (cuerpo)": "text", "mail.eml > contract.pdf": "binary"}
    body = entries.filter("text is not null").first()
    assert body["text"] == "Asunto: Prova\nDe: sender@example.com\nFecha: \n\nCos del correu\n"
    assert body["suffix"] == ".txt"


def test_equal_contents(spark):
    _, m = run(spark, [("second.pdf", pdf(b"same")), ("first.pdf", pdf(b"same"))])
    rows = by_lineage(m)
    assert rows["first.pdf"]["kind"] == "binary"
    assert rows["second.pdf"]["kind"] == "duplicate"
    assert rows["second.pdf"]["duplicate_of"] == rows["first.pdf"]["staged_name"]
    assert rows["second.pdf"]["staged_name"] is None


def test_broken_archive_is_skipped(spark):
    row = run(spark, [("broken.zip", b"this is not a real zip")])[1].first()
    assert (row["kind"], row["reason"]) == ("skipped", "bad-zip")


def test_manifest_fields_per_kind(spark):
    _, m = run(spark, [("a.pdf", pdf()), ("dup.pdf", pdf()), ("x.bin", b"x")])
    present = {
        r["kind"]: {k for k, v in r.asDict().items() if v is not None} for r in normalize.manifest_rows(m).collect()
    }
    assert present == {
        "binary": {"lineage", "kind", "staged_name", "original_filename"},
        "duplicate": {"lineage", "kind", "duplicate_of"},
        "skipped": {"lineage", "kind", "reason"},
    }


def test_manifest_written_and_read_back(spark, tmp_path):
    inner = [("annex.pdf", pdf(b"annex")), ("sheet.xlsx", sheet([["x", "y"]]))]
    _, m = run(spark, [("docs.zip", zipped(inner)), ("solo.pdf", pdf(b"solo"))])
    stages.write_manifest_json(m, str(tmp_path / "staging"))
    back = readers.read_manifests(spark, str(tmp_path / "staging"), r"/case_id=([^/]+)/", json_lines=True)
    assert {(r["case_id"], r["kind"]) for r in back.collect()} == {("c", "binary"), ("c", "text")}
    assert back.filter("kind = 'binary'").count() == 2
    # The array form, with a manifest whose rows share no staged name.
    folder = tmp_path / "arrays" / "staging" / "c9"
    folder.mkdir(parents=True)
    (folder / "manifest.json").write_text('[{"lineage": "b.pdf", "kind": "duplicate", "duplicate_of": "doc_1.pdf"}]')
    one = readers.read_manifests(spark, str(folder / "manifest.json")).first()
    assert (one["case_id"], one["staged_name"], one["duplicate_of"]) == ("c9", None, "doc_1.pdf")


def test_content_hash_and_staged_name(spark):
    row = spark.range(1).select(
        paths.content_hash(F.lit("abc")).alias("h"), paths.staged_name(F.lit("a > b.pdf"), F.lit(".pdf")).alias("s")
    ).first()
    assert row["h"] == hashlib.sha1(b"abc").hexdigest()[:12] == "a9993e364706"
    assert row["s"] == "doc_" + hashlib.sha1(b"a > b.pdf").hexdigest()[:16] + ".pdf"


def test_merging_batches(spark):
    one = run(spark, [("one.pdf", pdf(b"one"))])[1]
    two = run(spark, [("two.pdf", pdf(b"two"))])[1]
    merged = normalize.merge_manifests(one, two)
    assert {r["original_filename"] for r in merged.collect()} == {"one.pdf", "two.pdf"}
    again = normalize.merge_manifests(merged, two)
    assert again.count() == 2


def test_duplicate_scopes(spark):
    rows = [("c1", "a.pdf", pdf()), ("c2", "a.pdf", pdf()), ("c2", "b.pdf", pdf())]
    entries = expand_containers(spark.createDataFrame(rows, "case_id string, source_path string, content binary"))
    per_case = normalize.manifest(entries, "case").filter("kind = 'duplicate'").count()
    overall = normalize.manifest(entries, "global").filter("kind = 'duplicate'").collect()
    assert per_case == 1
    # c2's a.pdf has the lineage of c1's, yet it is another case's document.
    assert sorted((r["case_id"], r["lineage"]) for r in overall) == [("c2", "a.pdf"), ("c2", "b.pdf")]


def test_name_expressions_follow_pathlib(spark):
    from pathlib import PurePosixPath

    names = ["a.pdf", "A.PDF", "x.tar.gz", ".hidden", "a.", "dir.d/file", "dir/.env", "a b.Docx", "noext", "x/y.zip", "..a", "é.Ü"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(
        "n", paths.suffix_of(F.col("n")).alias("s"), paths.leaf_of(F.col("n")).alias("l")
    )
    for r in got.collect():
        p = PurePosixPath(r["n"])
        if r["n"] == "..a":
            continue  # a name of dots only before its last one
        assert r["l"] == p.name, r["n"]
        assert r["s"] == (p.suffix.lower() if p.suffix != "." else ""), r["n"]


def test_paths(spark):
    uri = "s3:/store/x/landing/EXP-1/raw/sub/a b.pdf"
    row = spark.createDataFrame([(uri,)], "p string").select(
        paths.case_of_path(F.col("p")).alias("c"),
        paths.case_relative_name(F.col("p")).alias("r"),
        paths.without_scheme(F.col("p")).alias("w"),
        paths.case_of_path(F.lit("/tmp/a.pdf")).alias("none"),
        paths.case_relative_name(F.lit("/tmp/a.pdf")).alias("base"),
    ).first()
    assert tuple(row) == ("EXP-1", "sub/a b.pdf", uri[3:], "_unassigned", "a.pdf")
