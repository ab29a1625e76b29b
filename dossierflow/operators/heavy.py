"""Joins in which one key may hold a large share of the rows.

Heavy keys are found by a frequent-items sketch, which combines partially and has a fixed size whatever the number of
keys.  Their rows are dealt to several join keys, and the other side's rows of these keys, which are few, are
replicated; all other rows are joined as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SHARE = 1 / 128  # of all rows, above which a key is heavy
TRACKED = 4096  # items of the sketch; at most 1 / SHARE keys come out
SALTS = 64


def heavy_keys(rows: DataFrame, key: str, share: float = SHARE) -> Column:
    """Keys with more than `share` of the rows, as a scalar array of at most 1 / share keys."""
    most = int(1 / share)
    counted = rows.agg(F.call_function("approx_top_k", F.col(key), F.lit(most), F.lit(TRACKED)).alias("top"), F.count(F.lit(1)).alias("rows"))
    heavy = F.filter("top", lambda t: t["count"] > F.col("rows") * share)
    return counted.select(F.coalesce(F.transform(heavy, lambda t: t["item"]), F.array().cast(f"array<{rows.schema[key].dataType.simpleString()}>"))).scalar()


def join(rows: DataFrame, other: DataFrame, key: str, how: str = "left", share: float = SHARE, salts: int = SALTS, deal_by: Column | None = None) -> DataFrame:
    """`rows` joined with `other` on one key; `how` is inner, left, left_semi or left_anti.

    Rows of a heavy key are dealt by a hash of `deal_by`, or of all their columns."""
    heavy = F.coalesce(F.array_contains(heavy_keys(rows, key, share), F.col(key)), F.lit(False))
    dealt = F.pmod(F.xxhash64(*rows.columns) if deal_by is None else F.xxhash64(deal_by), F.lit(salts)).cast("int")
    places = F.when(heavy, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = rows.withColumn("_salt", F.when(heavy, dealt).otherwise(0))
    right = other.withColumn("_salt", F.explode(places))
    return left.join(right, [key, "_salt"], how).drop("_salt")
