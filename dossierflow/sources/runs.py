"""State tables of a run, in a folder that the run names.

A run reads the tables of an earlier one and writes whole tables of its own; nothing is written where another run
writes or reads.  All tables of a run are written by one job, as partitions of one folder, so Spark's own mark of a
finished job holds for all of them or none: a run that broke off is not read, by nobody.  Rows of the logs are only
those of the run; those of all complete runs together are the log.  Which run's tables are the valid ones is for the
caller to say, or for a table format to which they are loaded.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from dossierflow.schemas import STATE_TABLES
from dossierflow.sources.stages import exists, finished_below

LOGS = ("classification_history", "events")
TABLES = ("classification_history", "events", "documents", "classifications", "cases")


class IncompleteRun(ValueError):
    """Tables were asked for that a run has not finished."""


def read_state(spark: SparkSession, folder: str | None) -> dict[str, DataFrame]:
    """The tables a complete run left; without a folder, empty ones."""
    if folder is None:
        return {t: spark.createDataFrame([], STATE_TABLES[t]) for t in TABLES}
    if not is_complete(spark, folder):
        raise IncompleteRun(f"no complete run in {folder}")
    return {t: _read(spark, t, [folder]) for t in TABLES}


def read_log(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Rows of a log from all complete runs below a folder."""
    return _read(spark, table, finished_below(spark, root))


def _read(spark: SparkSession, table: str, folders: list[str]) -> DataFrame:
    # A table without rows has no partition.
    parts = [p for p in (f"{folder}/run_table={table}" for folder in folders) if exists(spark, p)]
    schema = STATE_TABLES[table]
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)


def is_complete(spark: SparkSession, folder: str) -> bool:
    return exists(spark, f"{folder}/_SUCCESS")


def write_state(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame]) -> str:
    """Write all tables in one job, each sorted by case so that a reader of one case skips row groups.  A run that
    broke off is written again; a complete one stays as it is."""
    if not is_complete(spark, folder):
        rows = [tables[t].withColumn("run_table", F.lit(t)) for t in TABLES]
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
        every.sortWithinPartitions("run_table", "case_id").write.mode("overwrite").partitionBy("run_table").parquet(folder)
    return folder
