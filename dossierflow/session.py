"""Job parameters and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

CONF_PREFIX = "dossierflow."
_REQUIRED = object()
_local_root: str | None = None


def param(spark: SparkSession, name: str, value: str | None = None, default=_REQUIRED):
    """An explicit value wins, then the Spark conf ``dossierflow.<name>``, then the default."""
    if value:
        return value
    found = spark.conf.get(CONF_PREFIX + name, None)
    if found:
        return found
    if default is _REQUIRED:
        raise KeyError(f"no value for parameter {name!r} and no conf {CONF_PREFIX + name}")
    return default


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="dossierflow-")
    return _local_root


def run_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared root; never reused, so nothing has to be cleared."""
    return f"{shared_root(spark)}/dossierflow/{purpose}-{uuid.uuid4().hex}"


def spread(df, key: str):
    """Hash a scan that has fewer splits than the cluster has cores over all cores.  A table of one row group is
    one split; its rows are the same either way."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)
