"""SimHash fingerprints and the search for near ones, in DataFrame operations only.

Terms are windows of three words (all words, if there are fewer); a term's weight is how often it occurs.  Each
occurrence votes with the bits of its hash; a bit of the fingerprint is set when more than half of the votes are.
Two bits are counted in one long, one in each half, so a fingerprint of 64 bits takes 32 sums with partial
aggregation: occurrences never leave the task that read them.  Texts without a word have the fingerprint 0.  Equal
texts share votes in proportion and so have equal fingerprints.

Near fingerprints: the 64 bits are cut into ``BLOCKS`` blocks.  Two fingerprints within ``radius`` bits agree in at
least ``BLOCKS - radius`` blocks, so for each such choice of blocks a table is keyed by their bits, and a pair is
compared where it first agrees.  Equal fingerprints are one row with a count; no list of pairs leaves the join.

The row after each row, by descending key, is found in buckets of neighbouring keys.  A bucket's last row takes
the head of the next bucket, found by two more levels of buckets, each of bounded size for any spread of keys.
Null keys come last and equal keys in the order of their texts.  Null texts count as empty; an empty table gives an
empty result.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierflow.llm import texts

WORDS = 3
BITS = 64
BUCKET = 10  # bits of a key within a bucket of rows
LEVEL = 20  # bits of a bucket within a group of buckets
BLOCKS = 5
RADIUS = 3
EVERY = 50  # keys divisible by this are the queries of the search
LANES = "4294967297L"  # lowest bit of either half of a long


def terms(column: str) -> Column:
    """Hashes of the windows of three words, with repetitions."""
    gram = ", ".join(f"get({column}, i + {j})" for j in range(WORDS))
    return F.expr(
        f"if(size({column}) = 0, cast(array() as array<bigint>),"
        f" transform(sequence(0, greatest(size({column}) - {WORDS}, 0)), i -> xxhash64({gram})))"
    )


def words(column: str) -> Column:
    return F.expr(f"filter(split({column}, '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x <> '')")


def simhash(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """``keys``, ``fingerprint`` (long) and ``copies``, the rows with these keys, which must name the text."""
    lanes = BITS // 2
    voting = rows.select(*keys, words(column).alias("words")).select(*keys, F.posexplode_outer(terms("words")).alias("place", "term"))
    voted = voting.groupBy(*keys).agg(
        F.count("term").alias("votes"),
        F.count_if(F.coalesce("place", F.lit(0)) == 0).alias("copies"),
        *(F.sum(F.expr(f"shiftrightunsigned(term, {i}) & {LANES}")).alias(f"lane{i}") for i in range(lanes)),
    )
    low = [f"if(2 * (lane{i} & 4294967295L) > votes, {1 << i}L, 0L)" for i in range(lanes)]
    high = [f"if(2 * shiftrightunsigned(lane{i}, 32) > votes, shiftleft(1L, {i + 32}), 0L)" for i in range(lanes)]
    return voted.select(*keys, F.expr("coalesce(" + " | ".join(low + high) + ", 0L)").alias("fingerprint"), "copies")


def likeness(a: str, b: str) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))


def _next(keys: DataFrame, name: str) -> DataFrame:
    """``name`` and ``after``: the next smaller of distinct numbers, and the largest after the smallest."""
    up = lambda c, bits: F.shiftright(c, bits)
    level1 = keys.select(name, up(name, LEVEL).alias("g1"))
    level2 = level1.groupBy("g1").agg(F.max(name).alias("head1")).withColumn("g2", up("g1", LEVEL))
    level3 = level2.groupBy("g2").agg(F.max_by("head1", "g1").alias("head2"))  # at most 2^14 rows
    whole = Window.partitionBy(F.lit(0)).orderBy(F.desc("g2"))
    level3 = level3.select("g2", F.coalesce(F.lead("head2").over(whole), F.first("head2").over(whole)).alias("after3"))
    within2 = Window.partitionBy("g2").orderBy(F.desc("g1"))
    level2 = level2.withColumn("after2", F.lead("head1").over(within2)).join(level3, "g2")
    level2 = level2.select("g1", F.coalesce("after2", "after3").alias("after2"))
    within1 = Window.partitionBy("g1").orderBy(F.desc(name))
    level1 = level1.withColumn("after1", F.lead(name).over(within1)).join(level2, "g1")
    return level1.select(name, F.coalesce("after1", "after2").alias("after"))


def with_next(docs: DataFrame, key: str) -> DataFrame:
    """``key, text, next_key, next_text``: the row after each by descending key, the first after the last."""
    bucket = F.coalesce(F.shiftright(F.col("key"), BUCKET), F.lit(-(1 << (63 - BUCKET)) - 1))
    rows = docs.select(F.col(key).alias("key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("bucket", bucket)
    order = [F.desc_nulls_last("key"), F.asc("text")]
    within = Window.partitionBy("bucket").orderBy(*order)
    following = rows.select(
        "bucket", "key", "text", F.row_number().over(within).alias("place"), F.lead("text").over(within).alias("next_text"), F.lead("key").over(within).alias("next_key"),
        F.lead(F.lit(True), 1, False).over(within).alias("inside"),
    )
    # The first row of each bucket; both branches start from one exchange of the texts.
    heads = following.where("place = 1").select("bucket", F.col("key").alias("head_key"), F.col("text").alias("head_text"))
    after = _next(heads.select("bucket"), "bucket")
    heads = after.join(heads.withColumnRenamed("bucket", "after"), "after").select("bucket", "head_key", "head_text")
    return following.join(heads, "bucket").select(
        "key", "text",
        F.when(F.col("inside"), F.col("next_key")).otherwise(F.col("head_key")).alias("next_key"),
        F.when(F.col("inside"), F.col("next_text")).otherwise(F.col("head_text")).alias("next_text"),
    )


def near(found: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """For each distinct ``fingerprint`` of ``queries``: ``n_within``, how many rows of ``found`` (``fingerprint``,
    ``copies``) are within ``radius`` bits."""
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    ones = lambda n: (1 << n) - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    masks = [
        signed(sum(ones(cuts[b + 1] - cuts[b]) << cuts[b] for b in chosen)) for chosen in combinations(range(blocks), blocks - radius)
    ]
    tables = F.array(*(F.struct(F.lit(i).alias("permutation"), F.lit(m).cast("long").alias("mask")) for i, m in enumerate(masks)))
    keyed = lambda df, name: df.select(F.col("fingerprint").alias(name), *(["often"] if "often" in df.columns else []), F.inline(tables)).withColumn(
        "block", F.col(name).bitwiseAND(F.col("mask"))
    )
    every = keyed(found.groupBy("fingerprint").agg(F.sum("copies").alias("often")), "other").alias("e")
    asked = keyed(queries.select("fingerprint").distinct(), "fingerprint").alias("q")
    differ = F.col("fingerprint").bitwiseXOR(F.col("other"))
    first = F.lit(True)
    for i, m in enumerate(masks):  # an earlier table has the pair already
        first = first & ((F.col("q.permutation") <= i) | (differ.bitwiseAND(F.lit(m).cast("long")) != 0))
    on = (F.col("q.permutation") == F.col("e.permutation")) & (F.col("q.block") == F.col("e.block"))
    pairs = asked.join(every, on & (F.bit_count(differ) <= radius) & first)
    return pairs.groupBy("fingerprint").agg(F.sum("often").alias("n_within"))


def fingerprinted(docs: DataFrame, key: str = "doc_id", every: int = EVERY) -> DataFrame:
    """Fingerprints of every text and of its edited form, likenesses, and for the query rows ``n_within``, the number
    of rows whose fingerprint is within the radius, itself included."""
    half = F.floor(F.length("text") / 2).cast("int")
    rows = with_next(docs, key).withColumn("n_chars", F.length("text"))
    rows = rows.withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half))
    )
    mark = lambda c: F.xxhash64(F.col(c))
    rows = rows.select(
        "key", mark("text").alias("mark"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "next_key",
        mark("next_text").alias("next_mark"),
        F.inline(F.array(F.struct(F.lit(False).alias("is_edited"), F.col("text").alias("body")), F.struct(F.lit(True).alias("is_edited"), F.col("edited").alias("body")))),
    )
    names = ["key", "mark", "n_chars", "edited_sha256", "next_key", "next_mark"]
    voted = simhash(rows, [*names, "is_edited"], "body")
    print_of = lambda edited: F.max(F.when(F.col("is_edited") == F.lit(edited), F.col("fingerprint")))
    made = voted.groupBy(*names).agg(print_of(False).alias("own"), print_of(True).alias("changed"), F.max("copies").alias("copies"))
    made = texts.stored(made, "fingerprints")  # read four times below, and narrow

    following = made.select(F.col("key").alias("k"), F.col("mark").alias("m"), F.col("own").alias("next_own")).distinct()
    asked = F.col("key") % every == 0
    within = near(made.select(F.col("own").alias("fingerprint"), "copies"), made.where(asked).select(F.col("own").alias("fingerprint")))
    hexed = lambda c: F.lpad(F.lower(F.hex(c)), BITS // 4, "0")
    return (
        made.join(following, F.col("next_key").eqNullSafe(F.col("k")) & (F.col("next_mark") == F.col("m")))
        .join(within, asked & (F.col("own") == F.col("fingerprint")), "left")
        .select(
            F.col("key").alias(key),
            F.col("n_chars").cast("long").alias("n_chars"),
            "edited_sha256",
            hexed("own").alias("fingerprint"),
            hexed("changed").alias("edited_fingerprint"),
            likeness("own", "changed").alias("near_edited"),
            likeness("own", "next_own").alias("near_next"),
            "n_within",
            F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        )
        .drop("copy")
    )
