"""Landing folder to staging tables as a stream."""

import shutil

import pytest

from dossierflow.sources import files
from dossierflow.streaming import ingest as streaming
from samples import mail, pdf, zipped


def land(root, case, name, data, below="raw"):
    target = root / "landing" / case / below / name
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(data)


def drain(spark, root, **options):
    stream = files.stream_files(spark, str(root / "landing"), files_per_batch=options.pop("files_per_batch", None))
    staging = streaming.Staging(spark, str(root / "staging"))
    return streaming.ingest(stream, staging, str(root / "checkpoint"), archive_root=str(root / "archive"), **options)


def kinds(staging):
    return {(r["case_id"], r["lineage"]): r["kind"] for r in staging.manifest().collect()}


def test_landing_to_manifest(spark, tmp_path):
    land(tmp_path, "E1", "a.pdf", pdf(b"a"))
    land(tmp_path, "E1", "sub/pack.zip", zipped([("b.pdf", pdf(b"b")), ("c.pdf", pdf(b"a"))]))
    land(tmp_path, "E2", "m x.eml", mail("S", "B", [("a.pdf", pdf(b"a"))]))
    land(tmp_path, "E2", "stray.pdf", pdf(b"s"), below="other")
    staging = drain(spark, tmp_path)
    assert kinds(staging) == {
        ("E1", "a.pdf"): "binary",
        ("E1", "sub/pack.zip > b.pdf"): "binary",
        ("E1", "sub/pack.zip > c.pdf"): "duplicate",
        ("E2", "m x.eml (cuerpo)"): "text",
        ("E2", "m x.eml > a.pdf"): "binary",
    }
    archived = {r["archive_path"] for r in staging.archived_files().collect()}
    assert archived == {f"{tmp_path}/archive/{p}" for p in ("E1/a.pdf", "E1/sub/pack.zip", "E2/m x.eml")}


def test_each_file_once_and_later_batches_know_earlier_ones(spark, tmp_path):
    land(tmp_path, "E1", "z.pdf", pdf(b"same"))
    first = kinds(drain(spark, tmp_path))
    assert first == {("E1", "z.pdf"): "binary"}
    again = drain(spark, tmp_path)
    assert kinds(again) == first and again.entries().count() == 1
    land(tmp_path, "E1", "a.pdf", pdf(b"same"))
    land(tmp_path, "E1", "b.pdf", pdf(b"new"))
    later = drain(spark, tmp_path)
    assert kinds(later) == {**first, ("E1", "a.pdf"): "duplicate", ("E1", "b.pdf"): "binary"}


def test_one_file_per_batch_keeps_every_document(spark, tmp_path):
    for i in range(4):
        land(tmp_path, "E1", f"{i}.pdf", pdf(str(i % 3).encode()))
    staging = drain(spark, tmp_path, files_per_batch=1)
    assert staging.entries().select("batch_id").distinct().count() == 4
    found = list(kinds(staging).values())
    assert sorted(found) == ["binary"] * 3 + ["duplicate"]


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    land(tmp_path, "E1", "a.pdf", pdf(b"a"))
    land(tmp_path, "E1", "b.pdf", pdf(b"a"))
    staging = drain(spark, tmp_path)
    before = sorted(map(str, staging.manifest_batches().collect()))
    batch = files.under_raw(files.read_files(spark, str(tmp_path / "landing")))
    streaming.process_batch(batch, 0, staging)
    streaming.process_batch(batch, 0, staging)
    streaming.update_manifest(staging)
    assert sorted(map(str, staging.manifest_batches().collect())) == before
    assert staging.entries().count() == 2


def test_glob_and_empty_landing(spark, tmp_path):
    (tmp_path / "landing").mkdir()
    staging = drain(spark, tmp_path)
    assert staging.manifest().isEmpty()
    land(tmp_path, "E1", "a.pdf", pdf(b"a"))
    land(tmp_path, "E1", "a.png", b"png")
    stream = files.stream_files(spark, str(tmp_path / "landing"), glob="*.png")
    other = streaming.ingest(stream, streaming.Staging(spark, str(tmp_path / "s2")), str(tmp_path / "c2"))
    assert set(kinds(other)) == {("E1", "a.png")}


def test_a_new_delivery_under_an_old_name_wins(spark, tmp_path):
    from dossierflow.operators.documents import staged_entries

    land(tmp_path, "E1", "a.pdf", pdf(b"old"))
    drain(spark, tmp_path)
    shutil.move(tmp_path / "landing/E1/raw/a.pdf", tmp_path / "gone.pdf")
    land(tmp_path, "E1", "x/../a.pdf", pdf(b"old"))
    batch = spark.createDataFrame([("/landing/E1/raw/a.pdf", pdf(b"new"))], "path string, content binary")
    staging = streaming.Staging(spark, str(tmp_path / "staging"))
    streaming.process_batch(batch, 7, staging)
    streaming.update_manifest(staging)
    latest = staged_entries(staging.entries()).collect()
    assert [bytes(r["data"]) for r in latest] == [pdf(b"new")]
    assert staging.manifest().count() == 1


def test_handled_files_can_be_moved_away(spark, tmp_path):
    for i in range(2):
        land(tmp_path, "E1", f"sub/{i}.pdf", pdf(str(i).encode()))
        stream = files.stream_files(spark, str(tmp_path / "landing"), archive=str(tmp_path / "done"))
        streaming.ingest(stream, streaming.Staging(spark, str(tmp_path / "staging")), str(tmp_path / "checkpoint"))
    land(tmp_path, "E1", "sub/2.pdf", pdf(b"2"))
    drain(spark, tmp_path)
    moved = sorted(p.name for p in (tmp_path / "done").rglob("*.pdf"))
    left = sorted(p.name for p in (tmp_path / "landing").rglob("*.pdf"))
    assert "0.pdf" in moved and not set(moved) & set(left) and sorted(moved + left) == ["0.pdf", "1.pdf", "2.pdf"]
    assert kinds(streaming.Staging(spark, str(tmp_path / "staging"))).keys() == {("E1", f"sub/{i}.pdf") for i in range(3)}


def test_a_micro_batch_that_spark_runs_again(spark, tmp_path):
    """Both streams lose the record of their last micro-batch, as after a crash before it was noted."""
    for i in range(5):
        land(tmp_path, "E1", f"{i}.pdf", pdf(str(i % 3).encode()))
    staging = drain(spark, tmp_path, files_per_batch=2)
    before = sorted(map(str, staging.manifest().collect()))
    assert len(before) == 5
    for folder in (tmp_path / "checkpoint", tmp_path / "staging/marked_state", tmp_path / "staging/manifest_state"):
        last = max((p for p in (folder / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
        last.unlink()
        last.with_name(f".{last.name}.crc").unlink(missing_ok=True)
    again = drain(spark, tmp_path, files_per_batch=2)
    assert sorted(map(str, again.manifest().collect())) == before and again.entries().count() == 5


def test_work_follows_the_batch_and_not_the_history(spark, tmp_path):
    """Fifty deliveries of the same make, each of one content that is known in all cases: the last costs what the
    second does, and leaves no arrivals behind."""
    staging = streaming.Staging(spark, str(tmp_path / "staging"))
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        name, content = "concat(id, '.pdf')", "sha1(if(id % 3 = 0, 'known', string(id)))"
        told = spark.range(150).selectExpr(
            "concat('E', id % 2) as case_id", f"{name} as source_path", f"{name} as lineage", f"{name} as original_filename", "'.pdf' as suffix",
            f"substring({content}, 1, 12) as content_hash", f"{content} as content_sha1", "string(null) as reason", "'binary' as raw_kind",
            f"concat('doc_', {name}) as candidate", "cast(array() as array<int>) as entry_path", "id div 3 as delivery", "id div 3 as batch_id",
        )
        told.repartition(1, "batch_id").write.partitionBy("batch_id").parquet(f"{staging.root}/arrivals")
        for start in (lambda: streaming.start_marks(staging, "global", 1), lambda: streaming.start_manifest(staging, 1)):
            running = start()
            running.awaitTermination()
            steps = [(p.numInputRows, [s.numRowsUpdated for s in p.stateOperators]) for p in running.recentProgress if p.numInputRows]
            assert len(steps) == 50 and all(x == steps[1] for x in steps[1:])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
    assert len(list((tmp_path / "staging/arrivals").rglob("*.parquet"))) <= 2
    found = staging.manifest_batches().groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in found} == {"binary": 101, "duplicate": 49}
    first = staging.manifest_batches().filter("kind = 'binary' and substring(content_sha1, 1, 8) = substring(sha1('known'), 1, 8)").first()
    assert first["delivery"] == 0


def test_a_document_delivered_again_as_a_copy(spark, tmp_path):
    """Batch scope knows nothing of other batches; identities are known in every scope."""
    staging = streaming.Staging(spark, str(tmp_path / "staging"))
    for n in range(2):
        names = [(f"/landing/E1/raw/{x}.pdf", pdf(b"same")) for x in "ab"] + [("/landing/E1/raw/n.txt", b"x"), (f"/landing/E1/raw/{n}.pdf", pdf(b"same"))]
        streaming.process_batch(spark.createDataFrame(names, "path string, content binary"), n, staging)
    streaming.update_manifest(staging, "batch")
    assert kinds(staging) == {
        ("E1", "0.pdf"): "binary", ("E1", "a.pdf"): "duplicate", ("E1", "b.pdf"): "duplicate", ("E1", "n.txt"): "skipped", ("E1", "1.pdf"): "binary",
    }


def tell(spark, staging, rows):
    """Arrivals as written by one micro-batch of files: (delivery, name, content)."""
    told = spark.createDataFrame(rows, "delivery long, name string, content string").selectExpr(
        "'E1' as case_id", "name as source_path", "name as lineage", "name as original_filename", "'.pdf' as suffix",
        "substring(sha1(content), 1, 12) as content_hash", "sha1(content) as content_sha1", "string(null) as reason", "'binary' as raw_kind",
        "concat('doc_', name) as candidate", "cast(array() as array<int>) as entry_path", "delivery", "delivery as batch_id",
    )
    told.repartition(1).write.mode("append").partitionBy("batch_id").parquet(f"{staging.root}/arrivals")


def finish(running):
    running.awaitTermination()
    return [s.operatorName for p in running.recentProgress if p.numInputRows for s in p.stateOperators]


def test_states_are_spark_operators_and_later_batches_displace_nothing(spark, tmp_path):
    """No state calls Python.  What was kept stays kept, also where a part of an earlier delivery comes later; among
    rows that wait together the first in walk order is taken, whichever file they are in."""
    staging = streaming.Staging(spark, str(tmp_path / "stag ing"))
    tell(spark, staging, [(1, "b.pdf", "x"), (1, "c.pdf", "x"), (1, "same.pdf", "late")])
    tell(spark, staging, [(0, "a.pdf", "x"), (0, "same.pdf", "early")])
    used = finish(streaming.start_marks(staging, "case", 1))
    assert len(used) == 2 and not [u for u in used if "Pandas" in u or "Groups" in u]
    used = finish(streaming.start_manifest(staging))
    assert len(used) == 1 and not [u for u in used if "Pandas" in u or "Groups" in u]
    found = {r["lineage"]: (r["delivery"], r["kind"], r["duplicate_of"]) for r in staging.manifest_batches().collect()}
    assert found == {
        "b.pdf": (1, "binary", None), "c.pdf": (1, "duplicate", "doc_b.pdf"), "a.pdf": (0, "duplicate", "doc_b.pdf"), "same.pdf": (0, "binary", None),
    }
    assert staging.manifest().count() == 4


def test_a_clock_set_back_is_refused(spark):
    schema = "file string, key array<string>, first struct<seen: bigint, entry: struct<candidate: string>>, latest bigint"
    now, known = ("f", None, (5, None), 5), (None, ["E1", "x"], (3, ("doc",)), 5)
    assert streaming._in_time(spark.createDataFrame([now, known], schema)).count() == 2
    with pytest.raises(RuntimeError, match="2 ms behind"):
        streaming._in_time(spark.createDataFrame([now, (None, ["E1", "x"], (5, ("doc",)), 7)], schema))
