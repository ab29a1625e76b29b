"""Landed files to entries and manifest, micro-batch by micro-batch, with known contents as streaming state.

Three streams follow one another.  The first opens the files of a micro-batch and writes entries with their payload,
and the narrow columns of the same entries apart, as arrivals.  The second marks arrivals that are copies; its state
is the first entry of every content.  The third drops what the manifest holds; its state is the known identities.  So
a batch costs what it brings, however long the history is: no row that was written before is read again, and Spark
removes arrivals that are handled.  Both states are Spark's own operators, an aggregate and a distinct; what they tell
of a micro-batch is joined with the rows of its files.

The driver sees names of files and never a row.  A replayed micro-batch of the first stream replaces its own
partition of entries; its arrivals come once more, find themselves known and add nothing.  The other two keep the rows
of a micro-batch that they have finished, and so never change what the next stream may have read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from dossierflow.functions import paths
from dossierflow.operators import normalize
from dossierflow.operators.expand import expand_containers
from dossierflow.schemas import ENTRY, MANIFEST
from dossierflow.sources import files, stages

_BATCH = T.StructField("batch_id", T.LongType())
ENTRIES_TABLE = T.StructType(ENTRY.fields + [T.StructField("has_text", T.BooleanType()), _BATCH])
ARCHIVE_TABLE = T.StructType([T.StructField("path", T.StringType()), T.StructField("archive_path", T.StringType()), _BATCH])

# What an arrival says about an entry: the manifest's columns but for those that depend on other entries.
_TOLD = ("case_id", "source_path", "lineage", "original_filename", "suffix", "content_hash", "content_sha1", "reason", "raw_kind", "candidate")
# `delivery` is the micro-batch of files that brought an entry.
_DELIVERY = T.StructField("delivery", T.LongType())
ARRIVAL = T.StructType([T.StructField(c, T.StringType()) for c in _TOLD] + [MANIFEST["entry_path"], _DELIVERY])
MARKED = T.StructType(MANIFEST.fields + [_DELIVERY])
# Walk order; earlier deliveries first.
_ORDER = ("delivery", "case_id", "source_path", "entry_path")


class Staging:
    """The folders one ingest writes: entries with payload, manifest, handled files."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        folder = f"{self.root}/{name}"
        if not stages.exists(self.spark, folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder).select(*schema.fieldNames())

    def entries(self) -> DataFrame:
        return self._read("entries", ENTRIES_TABLE)

    def manifest_batches(self) -> DataFrame:
        """Manifest rows with the micro-batch of files that brought each."""
        return self._read("manifest", MARKED)

    def manifest(self) -> DataFrame:
        return self.manifest_batches().drop("delivery")

    def archived_files(self) -> DataFrame:
        return self._read("archived_files", ARCHIVE_TABLE)


def process_batch(batch: DataFrame, batch_id: int, staging: Staging, archive_root: str | None = None) -> None:
    """One micro-batch of files: entries, their narrow columns as arrivals, and where each file belongs later."""
    if batch.isEmpty():
        return
    found = expand_containers(files.landed(batch)).withColumn("has_text", F.col("text").isNotNull())
    stages.write_batch(found, f"{staging.root}/entries", batch_id)
    written = staging.entries().filter(F.col("batch_id") == batch_id)
    told = normalize.describe(normalize.narrow(written)).withColumn("delivery", F.col("batch_id")).select(*ARRIVAL.fieldNames())
    # Added and not replaced: the next stream may have planned to read what an earlier attempt wrote.
    told.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("append").partitionBy("batch_id").parquet(f"{staging.root}/arrivals")
    if archive_root:
        stages.write_batch(archive_rows(batch, archive_root), f"{staging.root}/archived_files", batch_id)


def archive_rows(batch: DataFrame, archive_root: str) -> DataFrame:
    """Where each handled file belongs in the archive; sub-folders are kept."""
    name = paths.case_relative_name(F.col("path"))
    target = F.concat_ws("/", F.lit(archive_root.rstrip("/")), paths.case_of_path(F.col("path")), name)
    return batch.select("path", target.alias("archive_path"))


# --- manifest ------------------------------------------------------------------------------


def _asked(rows: DataFrame, key: Column, **also: Column) -> DataFrame:
    """A stream of rows as what a state is asked: the key of every row that has one, and once the name of every file.

    The state answers for the keys of a micro-batch only; the names tell which files to read for its rows."""
    name = F.when(F.col("_metadata.row_index") == 0, F.col("_metadata.file_path"))
    keyed = F.struct(F.lit(None).cast("string").alias("file"), key.alias("key"), *(v.alias(c) for c, v in also.items()))
    named = F.struct(name.alias("file"), *(F.lit(None).alias(c) for c in ("key", *also)))
    both = F.array(F.when(key.isNotNull(), keyed), F.when(name.isNotNull(), named))
    return rows.select(F.explode(F.array_compact(both)).alias("asked")).select("asked.*")


def _staged() -> Column:
    return F.col("raw_kind").isin(*normalize.KEPT_KINDS)


def _content(scope: str) -> Column:
    keys = ("delivery" if k == "batch_id" else k for k in normalize.scope_columns(scope))
    return F.array(*(F.col(k).cast("string") for k in keys))


def _identity() -> Column:
    name = F.coalesce(F.concat(F.lit("staged/"), "staged_name"), F.concat("kind", F.lit("/"), "lineage"))
    return F.array("case_id", name)


def first_entries(arrivals: DataFrame, scope: str = "case") -> DataFrame:
    """A stream of arrivals to the first entry ever of their contents.

    The first is of the earliest micro-batch, by the time that Spark notes for it, and there the first in walk order.
    `latest` is when the content last came, for `_in_time`."""
    asked = _asked(arrivals, F.when(_staged(), _content(scope)), entry=F.struct(*_ORDER, "candidate"))
    seen = asked.withColumn("seen", F.unix_millis(F.current_timestamp()))
    return seen.groupBy("file", "key").agg(F.min(F.struct("seen", "entry")).alias("first"), F.max("seen").alias("latest"))


def _in_time(told: DataFrame) -> DataFrame:
    """First entries, where the clock has not been set back: a content known from a later time would lose its first."""
    now = F.max(F.when(F.col("file").isNotNull(), F.col("first.seen")))
    times = told.agg(now.alias("now"), F.max("latest").alias("latest")).first()
    if times["latest"] > times["now"]:
        raise RuntimeError(f"the clock is {times['latest'] - times['now']} ms behind an earlier micro-batch; set it and remove the offsets of the last one")
    return told.select("key", "first.entry")


def marked(arrivals: DataFrame, firsts: DataFrame, scope: str = "case") -> DataFrame:
    """Manifest rows of arrivals: the first entry of a content is kept, others are copies of it.  The same document
    delivered again stays a kept row."""
    staged = arrivals.filter(_staged()).withColumn("key", _content(scope)).join(firsts, "key", "left")
    copy = ~F.struct("case_id", "candidate").eqNullSafe(F.struct("entry.case_id", "entry.candidate"))
    told = staged.withColumns(
        {"kind": F.when(copy, "duplicate").otherwise(F.col("raw_kind")), "staged_name": F.when(~copy, F.col("candidate")), "duplicate_of": F.when(copy, F.col("entry.candidate"))}
    )
    nothing = F.lit(None).cast("string")
    skipped = arrivals.filter(~_staged()).withColumns(
        {"reason": normalize.skip_reason(F.col("suffix"), F.col("reason")), "kind": F.lit("skipped"), "staged_name": nothing, "duplicate_of": nothing}
    )
    return told.select(*MARKED.fieldNames()).unionByName(skipped.select(*MARKED.fieldNames()))


def new_identities(rows: DataFrame) -> DataFrame:
    """A stream of manifest rows to the identities that have not come before."""
    return _asked(rows, _identity()).dropDuplicates(["file", "key"])


def once(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """The first row of every identity that is not in the manifest yet."""
    wanted = rows.withColumn("key", _identity()).join(fresh.select("key"), "key")
    first = F.min(F.struct(*_ORDER, F.struct(*MARKED.fieldNames()).alias("row"))).alias("first")
    return wanted.groupBy("key").agg(first).select("first.row.*")


def _take(told: DataFrame, batch_id: int, staging: Staging, schema: T.StructType, change, target: str) -> None:
    """One micro-batch: what the state tells is written, then what becomes of the rows that it is about.

    The rows of a finished micro-batch stay as they are, as the next stream may have read them."""
    spark, folder = staging.spark, f"{staging.root}/{target}/batch_id={batch_id}"
    stages.write_folder(told, f"{staging.root}/{target}_told")
    told = spark.read.schema(told.schema).parquet(f"{staging.root}/{target}_told")
    names = [_plain(spark, r["file"]) for r in told.filter("file is not null").select("file").collect()]
    if names and not stages.exists(spark, f"{folder}/_SUCCESS"):
        change(spark.read.schema(schema).parquet(*names), told).write.mode("overwrite").parquet(folder)


def _plain(spark: SparkSession, uri: str) -> str:
    """A path as readers take it, from the URI that they give."""
    return spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(uri)).toString()


def _start(
    staging: Staging, source: str, schema: T.StructType, ask, mode: str, change, target: str, files_per_batch: int | None, clean: bool = False
) -> StreamingQuery | None:
    """Hand on what is pending in one folder to another, then stop; None where nothing has ever come."""
    if not stages.exists(staging.spark, f"{staging.root}/{source}"):
        return None
    reader = staging.spark.readStream.schema(schema)
    if clean:
        reader = reader.option("cleanSource", "delete")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        ask(reader.parquet(f"{staging.root}/{source}"))
        .writeStream.outputMode(mode)
        .foreachBatch(lambda told, batch_id: _take(told, batch_id, staging, schema, change, target))
        .option("checkpointLocation", f"{staging.root}/{target}_state")
        .trigger(availableNow=True)
        .start()
    )


def start_marks(staging: Staging, scope: str = "case", files_per_batch: int | None = None) -> StreamingQuery | None:
    """Mark the arrivals that are pending.  The scope of a staging must not change."""
    ask = lambda arrivals: first_entries(arrivals, scope)
    change = lambda arrivals, told: marked(arrivals, _in_time(told).filter("key is not null"), scope)
    return _start(staging, "arrivals", ARRIVAL, ask, "update", change, "marked", files_per_batch, True)


def start_manifest(staging: Staging, files_per_batch: int | None = None) -> StreamingQuery | None:
    """Add the marked rows that are pending to the manifest."""
    return _start(staging, "marked", MARKED, new_identities, "append", once, "manifest", files_per_batch)


def update_manifest(staging: Staging, scope: str = "case") -> Staging:
    """Bring the manifest up to the entries."""
    for start in (lambda: start_marks(staging, scope), lambda: start_manifest(staging)):
        running = start()
        if running is not None:
            running.awaitTermination()
    return staging


# --- both ------------------------------------------------------------------------------------


def start_ingest(stream: DataFrame, staging: Staging, checkpoint: str, archive_root: str | None = None) -> StreamingQuery:
    """Drain the files that are pending, then stop.  `stream` has (path, content); see `stream_files`."""
    return (
        files.under_raw(stream)
        .writeStream.foreachBatch(lambda batch, batch_id: process_batch(batch, batch_id, staging, archive_root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest(stream: DataFrame, staging: Staging, checkpoint: str, scope: str = "case", archive_root: str | None = None) -> Staging:
    """Files, then manifest."""
    start_ingest(stream, staging, checkpoint, archive_root).awaitTermination()
    return update_manifest(staging, scope)
