"""Versions of a document from an append-only classification log.

The latest version is an aggregate with partial combine.  Numbering versions needs an order
within each document; a document that holds a large share of the log is cut into consecutive
slices first, so that no window ever takes a whole hot group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# A group is hot above this share of the rows, so at most 1 / HOT_SHARE groups can be hot.
HOT_SHARE = 1 / 2000
SLICES = 256


def latest(log: DataFrame, key=("doc_id",), order=("created_at", "event_id")) -> DataFrame:
    """Last row per key."""
    rest = [c for c in log.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return log.groupBy(*key).agg(newest).select(*key, "r.*")


def numbered(
    log: DataFrame,
    key: str = "doc_id",
    at: str = "created_at",
    tie: str = "event_id",
    hot_share: float = HOT_SHARE,
    slices: int = SLICES,
) -> DataFrame:
    """Add `version` (1 = oldest) and `archived_at` (when the next version came, NULL for the
    current one).

    1. Count per key (partial combine); keys above the share are hot.  There are at most
       1 / hot_share of them, so their slice bounds are a table of proven size.
    2. Bounds are about `slices` of the key's own (time, tie) pairs, picked by a hash.  Any bounds
       give the exact result, and these cut rows of one time too.
    3. Rows are numbered within (key, slice); per-slice counts and first times give each slice its
       offset and its successor.
    """
    place = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"))
    sizes = log.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    all_rows = log.agg(F.count(F.lit(1)).alias("all_rows")).scalar()
    hot_keys = sizes.filter(F.col("rows") > all_rows * hot_share).select(
        key, F.ceil(F.col("rows") / slices).cast("bigint").alias("step")
    )
    bounds = (
        log.join(F.broadcast(hot_keys), key)
        .filter(F.pmod(F.xxhash64(at, tie), F.col("step")) == 0)
        .groupBy(key)
        .agg(F.collect_set(place).alias("bounds"))
    )
    placed = log.join(F.broadcast(bounds), key, "left").withColumn(
        "slice", F.when(F.col("bounds").isNull(), 0).otherwise(F.size(F.filter("bounds", lambda b: b < place)))
    ).withColumn("hot", F.col("bounds").isNotNull()).drop("bounds")
    in_slice = Window.partitionBy(key, "slice").orderBy(at, tie)
    local = placed.withColumns(
        {"number": F.row_number().over(in_slice), "next_here": F.lead(at).over(in_slice)}
    )
    over_slices = Window.partitionBy(key).orderBy("slice")
    offsets = (
        placed.filter("hot")
        .groupBy(key, "slice")
        .agg(F.count(F.lit(1)).alias("rows"), F.min(at).alias("first_at"))
        .withColumns(
            {
                "before": F.coalesce(
                    F.sum("rows").over(over_slices.rowsBetween(Window.unboundedPreceding, -1)),
                    F.lit(0).cast("bigint"),
                ),
                "next_slice": F.lead("first_at").over(over_slices),
            }
        )
        .select(key, "slice", "before", "next_slice")
    )
    # About `slices` rows for each of at most 1 / hot_share hot keys.
    return (
        local.join(F.broadcast(offsets), [key, "slice"], "left")
        .withColumns(
            {
                "version": (F.col("number") + F.coalesce("before", F.lit(0))).cast("bigint"),
                "archived_at": F.coalesce("next_here", "next_slice"),
            }
        )
        .select(*log.columns, "version", "archived_at")
    )


def history(log: DataFrame, **options) -> DataFrame:
    """Replaced versions only."""
    return numbered(log, **options).filter(F.col("archived_at").isNotNull())
