"""License scan by diagonal voting, in DataFrame operations only.

Every window of ``K`` words of a text is hashed and joined to the windows of the templates.  A hit at word p of the
text and word t of a template votes for the diagonal p - t.  Votes are counted by text, template and diagonal;
diagonals at most ``GAP`` apart are one span, so that a word put in or left out does not tear it.  A span is verified
by the words of the template it covers: windows are compared as strings, not as hashes only, and the share of covered
words must reach ``COVER``.  A phrase stands whole where all its windows vote for one diagonal.

The templates are a fixed list and are broadcast; votes of a text meet in one group per template, whose size is
bounded by the text.  Null and empty texts have no word and no label.  Rows with one key and one text get equal
results, as do null keys; no vote is counted twice for them.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K = 3
GAP = 2
COVER = 0.8

# Phrases that give a label where they stand whole, and longer templates.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)
SEPARATORS = "[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(column: str):
    """Words of a text in lower case (A-Z only); a null text has none."""
    return F.expr(f"filter(split(translate(coalesce({column}, ''), '{CAPITALS}', '{SMALL}'), '{SEPARATORS}'), x -> x <> '')")


def windows(column: str):
    """All windows of K words with the place of their first word."""
    gram = ", ".join(f"get({column}, i + {j})" for j in range(K))
    return F.expr(
        f"if(size({column}) < {K}, array(), transform(sequence(0, size({column}) - {K}),"
        f" i -> struct(i as place, concat_ws(' ', {gram}) as gram)))"
    )


def template_windows(spark: SparkSession, phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    rows = [(label, text, True) for label, text in phrases] + [(label, text, False) for label, text in templates]
    listed = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(a).alias("label"), F.lit(b).alias("words"), F.lit(c).alias("base")) for i, (a, b, c) in enumerate(rows)))
    return (
        spark.range(0, 1, 1, 1)
        .select(F.inline(listed))
        .withColumn("words", F.split("words", " "))
        .select("template", "label", "base", F.size("words").alias("size"), F.inline(windows("words")))
        .select("template", "label", "base", "size", F.col("place").alias("t"), F.col("gram").alias("t_gram"), F.xxhash64("gram").alias("t_hash"))
    )


def votes(texts: DataFrame, templates: DataFrame) -> DataFrame:
    """``texts``: key, mark and words of each text.  Per text, template and diagonal, the template places hit."""
    grams = texts.select("key", "mark", F.inline(windows("words")))
    hits = grams.join(
        F.broadcast(templates), (F.xxhash64("gram") == F.col("t_hash")) & (F.col("gram") == F.col("t_gram"))
    )
    return hits.groupBy("key", "mark", "template", "label", "base", "size", (F.col("place") - F.col("t")).alias("diagonal")).agg(F.collect_set("t").alias("hit"))


def spans(votes: DataFrame) -> DataFrame:
    """Neighbouring diagonals as one span with the share of the template's words that it covers."""
    along = Window.partitionBy("key", "mark", "template").orderBy("diagonal")
    torn = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > GAP, F.lit(True))
    whole = F.col("base") & (F.size("hit") == F.col("size") - K + 1)
    covered = F.expr(f"size(array_distinct(flatten(transform(flatten(collect_set(hit)), t -> sequence(t, t + {K - 1})))))")
    return (
        votes.select("*", F.when(torn, 1).otherwise(0).alias("begins"), whole.alias("whole"))
        .select("*", F.sum("begins").over(along).alias("span"))
        .groupBy("key", "mark", "template", "label", "size", "span")
        .agg(
            (covered / F.col("size")).alias("cover"),
            F.count_if("whole").alias("places"),
            F.min(F.when(F.col("whole"), F.col("diagonal"))).alias("first_word"),
            F.max(F.when(F.col("whole"), F.col("diagonal"))).alias("last_word"),
        )
    )


def scanned(docs: DataFrame, key: str = "doc_id", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Counts, places and labels of every row."""
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), words("text").alias("words"))
    found = spans(votes(texts, template_windows(docs.sparkSession, phrases, templates)))
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    by_text = found.groupBy("key", "mark").agg(
        F.sum("places").alias("n_base"),
        F.min("first_word").cast("long").alias("first_word"),
        F.max("last_word").cast("long").alias("last_word"),
        joined(F.collect_set(F.when(F.col("places") > 0, F.col("label")))).alias("base_labels"),
        joined(F.collect_set(F.when((F.col("places") > 0) | (F.col("cover") >= COVER), F.col("label")))).alias("labels"),
        F.max("cover").alias("score"),
    )
    rows = texts.select("key", "mark", F.size("words").cast("long").alias("n_words")).alias("r")
    on = F.col("r.key").eqNullSafe(F.col("f.key")) & (F.col("r.mark") == F.col("f.mark"))
    return rows.join(by_text.alias("f"), on, "left").select(
        F.col("r.key").alias(key),
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
