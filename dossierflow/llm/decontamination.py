"""Benchmark passages in documents by winnowing, in DataFrame operations only.

A window is ``WINDOW`` consecutive words of an item; an item of fewer words is one window of its own length.  For
windows of ``size`` words, texts are hashed by k-grams (k a power of two, 4 where the window has as many words) and the
smallest hash of each window of ``size - k + 1`` k-grams is its fingerprint, so equal windows have equal fingerprints:
every shared span of ``size`` words is met.  Consecutive windows with one fingerprint are kept as one row, with the
words they cover.

1. Fingerprints of the items are joined to those of the documents (semi join).  A bit array of the items' (128 KB
   at most) lets a document's pass first, so that hardly any other becomes a row.
2. What is left is extended to its windows, and these are compared with the windows of the items word by word.
3. Windows met mark their words; items of a document are its distinct windows joined to the items that hold them.

Fingerprint and windows of the items are written first, so that Spark knows their size: below its threshold they are
broadcast, above it both sides are exchanged and split where a key is heavy.  Rows equal in key and text are met once
and get equal results; rows of one key with different texts are different, with a null key too.  Null and empty texts
have no word; an item without words has no window.  Items of one id count once; an item without an id marks words, but
is neither counted nor listed.  Other columns are not read, so they may have any name.  An empty table of documents
gives an empty result, an empty table of items no hits.  An array of one text's words and hashes is held at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.functions import bloom
from dossierflow.llm import texts

WINDOW, GRAM = 10, 4
BITS_PER_PRINT, MOST_BITS = 64, 1 << 20  # at most 128 KB, which every row of documents carries once
SEPARATORS = "[\\\\x00-\\\\x2F\\\\x3A-\\\\x60\\\\x7B-\\\\x7F]+"
SEPARATORS_OF_ANY_CASE = "[\\\\x00-\\\\x2F\\\\x3A-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]+"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(column: str):
    """Words of a text in lower case (A-Z only); a null text has none."""
    return F.expr(f"array_remove(split(translate(coalesce({column}, ''), '{CAPITALS}', '{SMALL}'), '{SEPARATORS}'), '')")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """A value with a name.  Within one expression arrays stay as they are; as columns each would be written out."""
    return F.get(F.transform(F.array(value), then), 0)


def with_next(values: Column, step: int, join: Callable[[Column, Column], Column]) -> Column:
    """Each value joined with the one ``step`` places on."""
    return F.transform(values, lambda x, i: join(x, F.get(values, i + step)))


def hashed(values: Column, k: int, gram: int, then: Callable[[Column, int], Column]) -> Column:
    """Hashes of ``gram`` words from hashes of ``k``, as many as make a power of two."""
    if 2 * k > gram:
        return then(values, k)
    return let(with_next(values, k, F.xxhash64), lambda grams: hashed(grams, 2 * k, gram, then))


def smallest(values: Column, p: int, width: int, then: Callable[[Column], Column]) -> Column:
    """Minima of ``width`` values from minima of ``p``."""
    if p >= width:
        return then(values)
    step = min(p, width - p)
    return let(with_next(values, step, F.least), lambda found: smallest(found, p + step, width, then))


def stretches(words: Column, size: int, gram: int, bits: int) -> Column:
    """Stretches of windows with one fingerprint: size, print, first and last window, and their words."""
    told = lambda p: F.struct(
        F.lit(size).alias("size"), p["print"].alias("print"), p["first"].alias("first"), p["last"].alias("last"),
        F.array_join(F.slice(words, p["first"] + 1, p["last"] - p["first"] + size), " ").alias("words"),
    )

    def listed(prints: Column) -> Column:
        begin = F.array_compact(F.transform(prints, lambda x, i: F.when((i == 0) | (F.get(prints, i - 1) != x), i)))
        end = lambda begins, j: F.coalesce(F.get(begins, j + 1), F.size(prints)) - 1
        found = let(begin, lambda begins: F.transform(
            begins, lambda b, j: F.struct(F.get(prints, b).alias("print"), b.alias("first"), end(begins, j).alias("last"))
        ))
        if bits:
            found = F.filter(found, lambda p: bloom.may_hold(F.col("bits"), [F.lit(size), p["print"]], bits, 1))
        return F.transform(found, told)

    # What stands at the end, where words are missing, is cut off.
    whole = lambda found: let(F.slice(found, F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(0))), listed)
    one = F.transform(words, lambda w: F.xxhash64(w)) if min(gram, size) == 1 else words
    return hashed(one, 1, min(gram, size), lambda grams, k: smallest(grams, 1, size - k + 1, whole))


def fingerprinted(rows: DataFrame, sizes: list[int], gram: int = GRAM, bits: int = 0) -> DataFrame:
    """``rows`` with their ``text``, which gives way to: size, print, first and last window that have it in a row, and
    their words.  One row for each stretch of windows with one fingerprint; with ``bits``, of those that the Bloom
    filter in the column of that name may hold.  Hashes of k words and minima over a window come from pairs of pairs,
    so each takes a few passes."""
    every = let(words("text"), lambda w: F.concat(*(stretches(w, size, gram, bits) for size in sizes)))
    return rows.select(*(c for c in rows.columns if c not in ("text", "bits")), F.inline(every))


def windows_of(stretches: DataFrame) -> DataFrame:
    """The windows of each stretch: its place in the text and its words."""
    kept = [c for c in stretches.columns if c not in ("first", "last", "words")]
    cut = stretches.select(*kept, "first", "last", F.split("words", " ").alias("cut"))
    each = "transform(sequence(0, last - first), i -> struct(first + i as place, array_join(slice(cut, i + 1, size), ' ') as window))"
    return cut.select(*kept, F.expr(f"inline({each})"))


def item_windows(items: DataFrame, key: str, window: int, gram: int) -> tuple[DataFrame, list[int]]:
    """(size, print, window, item) of all items, and the sizes that occur (at most ``window``)."""
    cut = items.select(F.col(key).cast("string").alias("item"), "text", F.least(F.size(words("text")), F.lit(window)).alias("own"))
    cut = cut.where("own > 0")
    sizes = sorted(r[0] for r in cut.select("own").distinct().collect())
    if not sizes:
        return items.sparkSession.createDataFrame([], "size int, print long, window string, item string"), sizes
    found = windows_of(fingerprinted(cut, sizes, gram).where("size = own"))
    return texts.stored(found.select("size", "print", "window", "item").distinct(), "benchmark-windows"), sizes


def hit_windows(docs: DataFrame, held: DataFrame, sizes: list[int], gram: int) -> DataFrame:
    """(key, mark, size, place, window) of all windows of documents that an item holds."""
    prints = held.select("size", "print").distinct()
    bits = bloom.size_for(prints.count(), BITS_PER_PRINT, MOST_BITS)
    known = bloom.bits_of(prints, ["size", "print"], bits, 1)
    found = fingerprinted(docs.select("key", "mark", "text", known.alias("bits")), sizes, gram, bits)
    met = found.join(prints, ["size", "print"], "left_semi")
    cut = windows_of(met).select("key", "mark", "size", "place", "window").distinct()
    return texts.stored(cut.join(held.select("size", "window").distinct(), ["size", "window"], "left_semi"), "benchmark-hits")


def scanned(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``key, n_words, n_hit, n_items, items_sha256, contaminated`` of every row."""
    named = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    held, sizes = item_windows(items, item, window, gram)
    n_words = F.expr(f"cast(size(array_remove(split(coalesce(text, ''), '{SEPARATORS_OF_ANY_CASE}'), '')) as long)")
    rows = named.select("key", "mark", n_words.alias("n_words"))
    nothing = {"n_hit": F.lit(0).cast("long"), "n_items": F.lit(0).cast("long"), "items_sha256": F.sha2(F.lit(""), 256)}
    if not sizes:
        return rows.select(F.col("key").alias(key), "n_words", *(v.alias(c) for c, v in nothing.items()), F.lit(False).alias("contaminated"))
    hits = hit_windows(named, held, sizes, gram)
    # Words under sorted windows: each adds what lies beyond those before it.
    covered = F.expr(
        "aggregate(array_sort(collect_set(struct(place, size))), struct(0 as done, 0L as n), (a, x) -> struct("
        "greatest(a.done, x.place + x.size) as done, a.n + greatest(0, x.place + x.size - greatest(a.done, x.place)) as n), a -> a.n)"
    )
    places = hits.groupBy("key", "mark").agg(covered.alias("n_hit"))
    listed = hits.select("key", "mark", "size", "window").distinct().join(held.select("size", "window", "item"), ["size", "window"])
    listed = listed.groupBy("key", "mark").agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = lambda a, b: F.col(f"{a}.key").eqNullSafe(F.col(f"{b}.key")) & (F.col(f"{a}.mark") == F.col(f"{b}.mark"))
    found = places.alias("p").join(listed.alias("l"), same("p", "l")).select(
        "p.key", "p.mark", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    )
    return rows.alias("d").join(found.alias("f"), same("d", "f"), "left").select(
        F.col("d.key").alias(key), "n_words", *(F.coalesce(c, v).alias(c) for c, v in nothing.items()), F.col("n_hit").isNotNull().alias("contaminated")
    )
