"""Substring search by trigrams: a filter that leaves candidates, which are then searched as they are.

The index has one row per case and distinct trigram of its id and title, laid out by a hash of the trigram, so a search
reads the parts of its own trigrams only.  Of these it takes the rarest few, by counts kept beside the index: one that
every case has tells nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dossierflow.sources.stages import write_folder

SIZE = 3
PARTS = 64
RAREST = 3
INDEX = "part int, trigram string, case_id string"
COUNTS = "part int, trigram string, cases bigint"


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text in lower case; a shorter text has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    places = F.sequence(F.lit(1), F.greatest(F.length(low) - (SIZE - 1), F.lit(1)))
    cut = F.transform(places, lambda i: F.substr(low, i, F.lit(SIZE)))
    return F.array_distinct(F.filter(cut, lambda t: F.length(t) == SIZE))


def part_of(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(PARTS)).cast("int")


def write_index(cases: DataFrame, folder: str) -> str:
    """Index and counts of all cases, below a folder."""
    title = F.col("title") if "title" in cases.columns else F.lit(None).cast("string")
    every = F.array_distinct(F.concat(trigrams(F.col("case_id")), trigrams(title)))
    rows = cases.select(F.explode(every).alias("trigram"), "case_id").distinct().withColumn("part", part_of(F.col("trigram")))
    written = write_folder(rows.repartition("part", F.pmod(F.xxhash64("case_id"), F.lit(8))).sortWithinPartitions("part", "trigram"), f"{folder}/index", ["part"])
    counts = written.groupBy("part", "trigram").agg(F.count(F.lit(1)).alias("cases"))
    write_folder(counts.repartition("part").sortWithinPartitions("part", "trigram"), f"{folder}/counts", ["part"])
    return folder


def candidates(spark: SparkSession, folder: str, text: str) -> DataFrame | None:
    """Cases that hold the rarest trigrams of a text; None where the text is too short to have any."""
    asked = spark.range(1).select(F.explode(trigrams(F.lit(text))).alias("trigram")).withColumn("part", part_of(F.col("trigram")))
    wanted = [(r["part"], r["trigram"]) for r in asked.collect()]  # as many as the text has letters
    if not wanted:
        return None
    of = lambda rows: rows.filter(F.col("part").isin(*{p for p, _ in wanted}) & F.col("trigram").isin(*{t for _, t in wanted}))
    known = {r["trigram"]: r["cases"] for r in of(spark.read.schema(COUNTS).parquet(f"{folder}/counts")).collect()}
    wanted = sorted(wanted, key=lambda w: known.get(w[1], 0))[:RAREST]
    found = of(spark.read.schema(INDEX).parquet(f"{folder}/index"))
    return found.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(wanted)).select("case_id")
