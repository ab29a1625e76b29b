"""Readers: landed files, staged files, manifests, named tables.  Schemas are explicit."""

from __future__ import annotations

import re
import zlib
from fnmatch import fnmatchcase
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierflow.functions import paths
from dossierflow.schemas import LANDED_FILE, MANIFEST_JSON
from dossierflow.session import run_folder
from dossierflow.sources.stages import exists


def stream_files(spark: SparkSession, landing: str, glob: str = "*", files_per_batch: int | None = None, archive: str | None = None) -> DataFrame:
    """Files landing anywhere below a folder, as a stream.

    With `archive` Spark moves handled files there under their sub-path, one batch later."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(LANDED_FILE)
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return reader.load(landing)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below a folder (path, modificationTime, length), but for those with a dot name in their path.

    Folders are rows: each level is listed by tasks, which spread its folders among them, and written; the driver
    learns whether there is a next level, and no name.  Unlike Spark's own listing this one sees names that start with
    an underscore."""
    work, found = run_folder(spark, "listing"), []
    start = qualified(spark, root)
    folders = spark.range(1).select(F.lit(start).alias("path"))
    while not folders.isEmpty():
        level = folders.repartition("path").mapInArrow(lambda batches: _children(batches, glob), _LISTED)
        level.write.parquet(f"{work}/{len(found)}")
        found.append(spark.read.schema(_LISTED).parquet(f"{work}/{len(found)}"))
        folders = found[-1].filter("folder").select("path")
    return reduce(DataFrame.unionByName, found).filter("not folder").drop("folder")


_LISTED = "path string, modificationTime timestamp, length bigint, folder boolean"
# Names that the readers in tasks have for the same stores.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def qualified(spark: SparkSession, root: str) -> str:
    """The folder with its scheme, as Spark names it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def _opened(path: str):
    """File system and bare name of a path."""
    from pyarrow import fs

    scheme, mark, rest = path.partition(":")
    if not mark or scheme == "file":
        bare = "/" + (rest if mark else path).lstrip("/")
        return fs.LocalFileSystem(), bare
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{rest}")


def _children(batches, glob: str):
    """What lies in each folder; a folder that is missing has nothing."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        for folder in batch.column("path").to_pylist():
            system, bare = _opened(folder)
            infos = system.get_file_info(fs.FileSelector(bare, allow_not_found=True))
            kept = [
                i for i in infos
                if not i.base_name.startswith(".") and (i.type == fs.FileType.Directory or i.type == fs.FileType.File and fnmatchcase(i.base_name, glob))
            ]
            for low in range(0, len(kept), 10000):
                some = kept[low : low + 10000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{folder}/{i.base_name}" for i in some], pa.string()),
                        pa.array([i.mtime for i in some], pa.timestamp("us", tz="UTC")),
                        pa.array([i.size or 0 for i in some], pa.int64()),
                        pa.array([i.type == fs.FileType.Directory for i in some], pa.bool_()),
                    ],
                    names=["path", "modificationTime", "length", "folder"],
                )


def with_content(listed: DataFrame) -> DataFrame:
    """Listed files with their content, read by the tasks that hold their names, one file at a time."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                system, bare = _opened(path)
                with system.open_input_stream(bare) as source:
                    content = pa.array([source.read()], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, content], [*batch.schema.names, "content"])

    return listed.select("path", "modificationTime", "length").mapInArrow(run, LANDED_FILE)


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """All files below a folder with their content; see `list_files`."""
    listed = list_files(spark, root, glob)
    # Names are few bytes and files many: without an exchange a few tasks would read them all.
    return with_content(listed.repartition(spark.sparkContext.defaultParallelism, "path"))


def stream_listed(spark: SparkSession, landing: str, work: str, glob: str = "*", files_per_batch: int = 1000) -> DataFrame:
    """The same files as a stream, for landing folders whose names must not pass the driver.

    What is new since the last call is listed by tasks and appended to a table of names below `work`, oldest first,
    in files of `files_per_batch` names; the stream takes one of these at a time and reads the named files."""
    names = f"{work.rstrip('/')}/landed_names"
    listed = list_files(spark, landing, glob)
    if exists(spark, names):
        listed = listed.join(spark.read.schema(_NAMES).parquet(names).select("path"), "path", "left_anti")
    ordered = listed.select("path", "modificationTime", "length").sort("modificationTime", "path")
    ordered.write.mode("append").option("maxRecordsPerFile", files_per_batch).parquet(names)
    return with_content(spark.readStream.schema(_NAMES).option("maxFilesPerTrigger", 1).parquet(names))


_NAMES = "path string, modificationTime timestamp, length bigint"


def under_raw(files: DataFrame) -> DataFrame:
    """Only files below some case's raw folder."""
    return files.filter(F.col("path").like("%" + paths.RAW_MARK + "%"))


def landed(files: DataFrame) -> DataFrame:
    """(case_id, source_path, content) of files in the landing layout <case>/raw/<name>."""
    return files.select(
        paths.case_of_path(F.col("path")).alias("case_id"),
        paths.case_relative_name(F.col("path")).alias("source_path"),
        "content",
    )


def below(files: DataFrame, root: str, case_id: str) -> DataFrame:
    """The same for a plain folder that belongs to one case; names are relative to it."""
    prefix = "/" + root.split(":", 1)[-1].strip("/") + "/"
    bare = paths.without_scheme(F.regexp_replace(F.col("path"), "^([a-zA-Z0-9]+:)/+", "$1/"))
    return files.select(
        F.lit(case_id).alias("case_id"),
        F.when(bare.startswith(prefix), F.substring(bare, len(prefix) + 1, 1 << 30)).otherwise(bare).alias("source_path"),
        "content",
    )


def read_staged_binaries(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """Staged files as (staged_name, path, length, data)."""
    files = spark.read.format("binaryFile").load(folders)
    return files.select(
        paths.file_name(F.col("path")).alias("staged_name"), "path", "length", F.col("content").alias("data")
    )


def read_staged_texts(spark: SparkSession, folders: str | list[str]) -> DataFrame:
    """Whole-file texts as (staged_name, path, text_blocks); an empty file gives no row.

    Paths are URIs.  Files are listed and read by tasks, as Spark's text reader keeps every name on the driver; like
    that one they open gz, bz2, zst and deflate by the suffix.  Snappy and lz4 in Hadoop's framing are refused."""
    read = list_named(spark, folders).filter("length > 0").select("path").mapInArrow(_whole_files, "path string, content binary")
    return read.select(paths.file_name(F.col("path")).alias("staged_name"), "path", F.col("content").cast("string").alias("text_blocks"))


def list_named(spark: SparkSession, given: str | list[str]) -> DataFrame:
    """Files (path, length) that Spark's readers take for paths, which may have wildcards: what lies right in a folder or
    in folders key=value below it, without hidden names.  A path without any file is left to Spark, which refuses a
    missing one.

    Tasks match and list.  Names are written 1,000 to a file, so that a few files are a task's work, and by the number
    of their folder, in 256 parts at most: as many folders of names as folders that were read, until there are more."""
    work, given = run_folder(spark, "listing"), [given] if isinstance(given, str) else given
    starts = [(i, 0, *_start(spark, plain)) for i, one in enumerate(given) for plain in spark._jvm.org.apache.hadoop.fs.GlobExpander.expand(one)]
    found, tasks = spark.createDataFrame(starts, _MATCHED), spark.sparkContext.defaultParallelism
    for _ in range(max((len(rest) for *_, rest in starts), default=0)):
        found = found.repartition(tasks, "path").mapInArrow(_matching, _MATCHED)
    below = found.repartition(tasks, "path").mapInArrow(_files_in, f"{_NAMED}, part int")
    below.write.option("maxRecordsPerFile", 1000).partitionBy("part").parquet(work)
    names = spark.read.schema(f"{_NAMED}, part int").parquet(work)
    filled = {r["given"] for r in names.select("given").distinct().collect()}
    if empty := [one for i, one in enumerate(given) if i not in filled]:
        spark.read.text(empty)
    return names.select("path", "length")


# A path so far, the parts of the pattern that are left (a name after "=", an expression after "~"), a running number.
_MATCHED = "given int, number int, path string, rest array<string>"
_NAMED = "given int, path string, length bigint"


def _start(spark: SparkSession, pattern: str) -> tuple[str, list[str]]:
    """What stands before the first wildcard, with its scheme, and the parts from there on."""
    glob = spark._jvm.org.apache.hadoop.fs.GlobPattern
    head, rest = [], []
    for part in qualified(spark, pattern).split("/"):
        wild = glob(part)
        name = re.sub(r"\\(.)", r"\1", part)
        if wild.hasWildcard():
            rest.append("~" + wild.compiled().pattern())
        elif rest:
            rest.append("=" + name)
        else:
            head.append(name)
    return "/".join(head), rest


def _matching(batches):
    """One part of the pattern further."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        for row in batch.to_pylist():
            part, *rest = row["rest"] or [""]
            if part[:1] != "~":
                found = [row["path"] + part.replace("=", "/", 1)]
            else:
                system, bare = _opened(row["path"] or "/")
                infos = system.get_file_info(fs.FileSelector(bare, allow_not_found=True))
                kept = (i for i in infos if re.fullmatch(part[1:], i.base_name, re.DOTALL) and (not rest or i.type == fs.FileType.Directory))
                found = sorted(f"{row['path']}/{i.base_name}" for i in kept)
            for low in range(0, len(found), 10000):
                some = found[low : low + 10000]
                numbers = [(row["number"] + low + i) % (1 << 30) for i in range(len(some))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["given"]] * len(some), pa.int32()), pa.array(numbers, pa.int32()), pa.array(some, pa.string()), pa.array([rest] * len(some), pa.list_(pa.string()))],
                    names=["given", "number", "path", "rest"],
                )


def _files_in(batches):
    """The files right in a folder and in folders key=value below it; a file is itself, a missing path nothing."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        for row in batch.select(["given", "number", "path"]).to_pylist():
            system, bare = _opened(row["path"])
            is_file = system.get_file_info(bare).type == fs.FileType.File
            folders = [] if is_file else [(row["path"], bare)]
            kept = [(row["path"], system.get_file_info(bare).size or 0)] if is_file and not _hidden(bare.rpartition("/")[2]) else []
            while folders or kept:
                if not kept:
                    folder, bare = folders.pop()
                    for i in system.get_file_info(fs.FileSelector(bare, allow_not_found=True)):
                        if not _hidden(i.base_name):
                            if i.type == fs.FileType.File:
                                kept.append((f"{folder}/{i.base_name}", i.size or 0))
                            elif "=" in i.base_name:
                                folders.append((f"{folder}/{i.base_name}", i.path))
                some, kept = kept[:10000], kept[10000:]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["given"]] * len(some), pa.int32()),
                        pa.array([path for path, _ in some], pa.string()),
                        pa.array([size for _, size in some], pa.int64()),
                        pa.array([row["number"] % 256] * len(some), pa.int32()),
                    ],
                    names=["given", "path", "length", "part"],
                )


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


# What Java's URIs write as %XX.
_QUOTED = re.compile(r"""[\x00-\x20"#%<>?\[\\\]^`{|}\x7f-\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]""")


def _as_uri(path: str) -> str:
    """A path as Spark's metadata column gives it."""
    return _QUOTED.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), path)


def _whole_files(batches):
    """Each file's content under its URI, in batches of about 1 MB."""
    import pyarrow as pa

    for batch in batches:
        names, bodies, held = [], [], 0
        for i, path in enumerate(batch.column("path").to_pylist(), 1):
            system, bare = _opened(path)
            if path.endswith((".snappy", ".lz4")):
                raise ValueError(f"compressed as only Hadoop reads it: {path}")
            with system.open_input_stream(bare) as source:
                body = source.read()
            bodies.append(zlib.decompress(body) if path.endswith(".deflate") else body)
            names.append(_as_uri(path))
            held += len(bodies[-1])
            if held >= 1 << 20 or i == batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(bodies, pa.binary())], names=["path", "content"])
                names, bodies, held = [], [], 0


def read_manifests(spark: SparkSession, location: str | list[str], case_pattern: str = r"/staging/([^/]+)/manifest.json\z", json_lines: bool = False) -> DataFrame:
    """Manifests with the case id from the file path (empty when the path has none).

    Files hold a JSON array each, or one object per line when `json_lines` is set."""
    rows = spark.read.schema(MANIFEST_JSON).option("multiLine", not json_lines).json(location)
    return rows.select(
        F.regexp_extract(F.col("_metadata.file_path"), case_pattern, 1).alias("case_id"),
        *MANIFEST_JSON.fieldNames(),
    )


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
