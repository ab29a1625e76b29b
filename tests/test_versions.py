"""Numbering versions in slices gives what one window gives, hot documents included."""

from pyspark.sql import Window, functions as F

from dossierflow.operators import versions


def log(spark, n=4000):
    """A third of the log belongs to one document, with equal times among its rows."""
    rows = spark.range(n).select(
        F.col("id").alias("event_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), (F.col("id") % 97).cast("string"))).alias("doc_id"),
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("classificacio"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.xxhash64("id") % 500)).alias("created_at"),
    )
    return rows


def windowed(rows):
    by_time = Window.partitionBy("doc_id").orderBy("created_at", "event_id")
    return rows.withColumns({"version": F.row_number().over(by_time).cast("bigint"), "archived_at": F.lead("created_at").over(by_time)})


def test_slices_number_as_one_window_does(spark):
    rows = log(spark)
    sliced = versions.numbered(rows, hot_share=0.05, slices=16)
    assert sorted(map(tuple, sliced.collect())) == sorted(map(tuple, windowed(rows).collect()))
    assert sliced.columns == windowed(rows).columns


def test_every_key_hot_or_none(spark):
    rows = log(spark, 600)
    want = sorted(map(tuple, windowed(rows).collect()))
    for share in (0.0, 1.0):
        got = versions.numbered(rows, hot_share=share, slices=4)
        assert sorted(map(tuple, got.collect())) == want


def test_rows_of_one_time_are_cut_too(spark):
    rows = log(spark, 900).withColumn("created_at", F.lit("2024-01-01").cast("timestamp"))
    got = versions.numbered(rows, hot_share=0.0, slices=8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windowed(rows).collect()))


def test_latest_is_the_version_without_successor(spark):
    rows = log(spark, 900)
    latest = {r["doc_id"]: r["event_id"] for r in versions.latest(rows).collect()}
    current = versions.numbered(rows).filter("archived_at is null").collect()
    assert latest == {r["doc_id"]: r["event_id"] for r in current}
    assert versions.history(rows).count() == 900 - len(latest)
