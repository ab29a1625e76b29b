"""Stage tables: every step can be written once and read by several later ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierflow.operators.normalize import manifest_rows


def save_stage(df: DataFrame, name: str, bucket_by: Sequence[str] = (), buckets: int = 64) -> DataFrame:
    """Write a named table and hand back its scan.

    With `bucket_by`, rows are laid out by hash of those columns, so that joins and groupings
    on them need no exchange later: the payload is moved once, at writing.
    """
    writer = df.write
    if bucket_by:
        # One task per bucket, so each bucket is one file per writing task and not many.
        writer = df.repartition(buckets, *bucket_by).write.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    writer.format("parquet").mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def as_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def write_folder(df: DataFrame, folder: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Full rebuild of a folder that the plan does not read; hands back its scan."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def write_manifest_json(items: DataFrame, folder: str) -> None:
    """Manifests as JSON lines, one folder per case.

    Rows are gathered by case for few files, and a case with many rows is split by size again."""
    manifest_rows(items, "case_id").hint("rebalance", F.col("case_id")).write.mode("overwrite").partitionBy("case_id").json(folder)


def write_report(display: DataFrame, folder: str, format: str = "csv") -> None:
    """The report with display headers; part files, nothing passes through the driver."""
    writer = display.write.mode("overwrite")
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(folder)
    else:
        writer.format(format).save(folder)


def _store_root(spark: SparkSession, root: str) -> str:
    """A root as readers in tasks need it; without a scheme it belongs to Spark's default file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    if "://" not in root:
        root = hadoop.FileSystem.get(spark._jsc.hadoopConfiguration()).makeQualified(hadoop.Path(root)).toString()
    return "file://" + root[len("file:") :] if root.startswith("file:/") and not root.startswith("file://") else root


def write_files(rows: DataFrame, root: str) -> DataFrame:
    """Rows (path, content) as files below a folder that every executor can reach; tasks write where the rows are, and
    the returned rows (path, length) name what an action has written.

    A file is written under another name and renamed when it is whole, so a lost task leaves no cut file and a
    repeated one writes the same bytes again.
    """
    root = _store_root(rows.sparkSession, root)

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            lengths = []
            for path, body in zip(batch.column("path").to_pylist(), batch.column("content")):
                folder, _, name = f"{base.rstrip('/')}/{path}".rpartition("/")
                store.create_dir(folder, recursive=True)
                part = f"{folder}/.{name}-{uuid.uuid4().hex}"
                body = body.as_buffer() if body.is_valid else pa.py_buffer(b"")
                with store.open_output_stream(part) as out:
                    out.write(body)
                store.move(part, f"{folder}/{name}")
                lengths.append(body.size)
            yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "length": pa.array(lengths, pa.int64())})

    return rows.select("path", "content").mapInArrow(run, "path string, length bigint")


def write_staged_files(staged: DataFrame, root: str) -> DataFrame:
    """Staged entries as files <root>/<case>/<kind>/<staged name>, for readers of plain files.

    Takes rows (case_id, kind, staged_name, data, text); returns (case_id, kind, staged_name, path, length)."""
    body = F.when(F.col("kind") == "binary", F.col("data")).otherwise(F.encode("text", "UTF-8"))
    below = F.concat_ws("/", "case_id", "kind", "staged_name")
    written = write_files(staged.select(below.alias("path"), body.alias("content")), root)
    names = F.split("path", "/")
    return written.select(
        *(F.get(names, i).alias(c) for i, c in enumerate(("case_id", "kind", "staged_name"))),
        F.concat(F.lit(_store_root(staged.sparkSession, root).rstrip("/") + "/"), "path").alias("path"), "length",
    )


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def finished_below(spark: SparkSession, root: str) -> list[str]:
    """Folders right below `root` whose job has finished; names of folders only."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(status.getPath().getParent().toString() for status in found or [])


def write_batch(df: DataFrame, folder: str, batch_id: int, *within: str) -> None:
    """Replace the partition of one micro-batch; a replay writes the same place again."""
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", *within)
        .parquet(folder)
    )
