"""A Bloom filter in column expressions: which keys may be in a set, decided where rows are read.

The bits are one array of at most 8 MB, made by Spark and used as a scalar, whatever the number of keys.  With more
keys than the bits can tell apart more rows pass; none that belongs to the set is ever lost, so an exact join has to
follow where that matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

LEAST_BITS, MOST_BITS = 1 << 14, 1 << 26
BITS_PER_KEY = 16
HASHES = 5


def size_for(keys: int, bits_per_key: int = BITS_PER_KEY, most: int = MOST_BITS) -> int:
    """A power of two, so many bits for each key within the bounds."""
    return max(LEAST_BITS, min(most, 1 << (bits_per_key * max(keys, 1) - 1).bit_length()))


def _places(columns: list[Column], size: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(i), *columns), F.lit(size)) for i in range(hashes)]


def bits_of(keys: DataFrame, columns: list[str], size: int, hashes: int = HASHES) -> Column:
    """The filter of all keys as a scalar array of 64-bit words."""
    place = F.explode(F.array(*_places([F.col(c) for c in columns], size, hashes))).alias("place")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % 64).cast("int"))
    words = keys.select(place).groupBy(F.floor(F.col("place") / 64).alias("word")).agg(F.bit_or(one).alias("bits"))
    every = keys.sparkSession.range(size // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    filled = words.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    in_order = F.array_sort(F.collect_list(F.struct("word", "bits")))
    return filled.agg(F.transform(in_order, lambda w: w["bits"]).alias("bits")).scalar()


def may_hold(bits: Column, columns: list[Column], size: int, hashes: int = HASHES) -> Column:
    """Whether a row's key may be among the keys."""
    found = F.lit(True)
    for place in _places(columns, size, hashes):
        word = F.get(bits, F.shiftright(place, 6).cast("int"))
        bit = F.call_function("shiftright", word, place.bitwiseAND(63).cast("int"))
        found = found & (bit.bitwiseAND(F.lit(1)) == 1)
    return found
