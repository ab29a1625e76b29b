"""N-gram Jaccard join: documents linked by the share of word n-grams they have in common.

The join is the product of the sparse document by n-gram matrix with its transpose, never written out:

1. Rows.  A text becomes its set of n-grams; equal sets are one row from here on.  Two fixed-size tables of
   hashed counts over all texts order the columns from rare to frequent: columns whose own count stands out of the
   table's noise last, the others by the product of their words' counts.
   A row also gets its parities, one bit per bucket of columns: two rows differ in at least as many columns as in
   parities, which bounds the overlap of a pair without its columns.
2. First block of columns.  A pair can only reach the bound if it meets in the rarest columns of both rows:
   ``size - needed + 1`` of them, where ``needed`` is the least overlap that the size allows.  Other products are
   never made, nor those whose sizes differ too much.
3. Stars.  In each column the row that shares most of its columns is the centre; the others are multiplied with it,
   which takes one product per row and not one per pair.  Pairs that their parities keep below the bound are
   dropped; for the others overlaps are counted exactly over all columns.  Links make components.
4. The rest.  Where a column still holds rows of several components, the pairs across components are multiplied
   in the same way.
   Pairs inside a component would change nothing.  So no link between different components is lost, and a group of
   near copies never becomes all its pairs.

Columns with one row are left at once, so what moves follows the copies, not the corpus.  A frequent column passes
one task as a stream; a frequent centre is dealt to several tasks with a part of its partners each.  Intermediate
tables are written to the shared folder.

Null texts, and texts without a word, have an empty set and link with nothing.  Texts of fewer than ``n`` words have
one gram, all their words.  Rows of one key are one document: their component is the same.  Rows with a null key get
their size and a null component and link with nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossierflow.llm import texts

GRAM = 3
PERCENT = 90
SLOTS = 1 << 20  # hashed counts; their number is fixed, so the tables that tasks get have 2 MB at any size
CHUNK = 1 << 14
NARROW, WIDE, LONG = 512, 4096, 1800  # parities of a set, and of one with at least so many grams
PARTNERS = 256  # partners of a centre that one task compares


def needed(size, percent: int):
    """Least overlap of a set of this size with any set it links with."""
    return (size * percent + 99) // 100


def most_differing(a, b, percent: int):
    """Most columns that two linked sets of these sizes can differ in."""
    return F.floor((a + b) * (100 - percent) / (100 + percent))


class Ranks(NamedTuple):
    """By slot of the hash, in quarter powers of two: counts of words, and of grams where they stand out, else 0."""

    words: np.ndarray
    grams: np.ndarray


def gram_sets(s: texts.Slice, n: int, by_slot: Ranks | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct gram hashes of all texts, sorted within each; their ranks, those of their words added up where their
    own does not stand out; and where each text begins."""
    data = texts.lower_ascii(s.data)
    w = texts.words(s, data)
    hashes = texts.span_hashes(data, w.start, w.end)
    ranks = np.zeros(len(hashes), np.int16) if by_slot is None else by_slot.words[slot(hashes)].astype(np.int16)
    count = np.diff(w.first)

    def of(k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(at):
            return np.zeros(0, np.uint64), np.zeros(0, np.int16)
        return texts.chained(hashes, k)[at], sum(ranks[at + j] for j in range(k))

    at, text = texts.owners(w.first, n - 1)
    grams, rank = of(n, at)
    for k in range(1, n):  # short texts
        short = np.flatnonzero(count == k)
        if len(short):
            more, its = of(k, w.first[:-1][short])
            grams, rank, text = np.concatenate([grams, more ^ np.uint64(k)]), np.concatenate([rank, its]), np.concatenate([text, short])
    order = np.lexsort((grams, text))
    grams, rank, text = grams[order], rank[order], text[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (text[1:] != text[:-1])
    grams, rank, text = grams[new], rank[new], text[new]
    if by_slot is not None:
        rank = rank + (by_slot.grams[slot(grams)].astype(np.int16) << 7)  # above any sum of word ranks that matters
    return grams, rank, np.searchsorted(text, np.arange(len(s) + 1))


def slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 20)).astype(np.int64)


def column_ranks(docs: DataFrame, n: int) -> Ranks:
    """Count words and grams of all texts by slot."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * SLOTS, np.int64)
        for s in texts.slices(batches):
            data = texts.lower_ascii(s.data)
            w = texts.words(s, data)
            hashes = texts.span_hashes(data, w.start, w.end)
            total[:SLOTS] += np.bincount(slot(hashes), minlength=SLOTS)
            total[SLOTS:] += np.bincount(slot(texts.chained(hashes, n)[texts.owners(w.first, n - 1)[0]]), minlength=SLOTS)
        parts = [pa.compress(total[low : low + CHUNK].tobytes(), codec="zstd", asbytes=True) for low in range(0, 2 * SLOTS, CHUNK)]
        yield pa.record_batch([pa.array(range(len(parts)), pa.int32()), parts], ["chunk", "counts"])

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for part in rows.column("counts").to_pylist():
            total += np.frombuffer(pa.decompress(part, 8 * CHUNK, codec="zstd"), np.int64)
        if rows.column("chunk")[0].as_py() * CHUNK >= SLOTS:
            usual = float(np.median(total))
            total[total <= usual + 8 * np.sqrt(usual) + 16] = 0
        rank = np.round(4 * np.log2(total + 1)).astype(np.uint8)
        return pa.table({"chunk": rows.column("chunk")[:1], "ranks": [rank.tobytes()]})

    counted = docs.select("text").mapInArrow(count, "chunk int, counts binary")
    found = counted.groupBy("chunk").applyInArrow(add, "chunk int, ranks binary").collect()  # 2 MB in all
    ranks = np.zeros(2 * SLOTS, np.uint8)
    for r in found:
        ranks[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["ranks"], np.uint8)
    return Ranks(ranks[:SLOTS], ranks[SLOTS:])


def parities(grams: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of each set, how often its grams fall into each bucket, modulo two, packed into longs."""
    out: list[np.ndarray] = []
    mixed = texts.mix(grams)
    for low in range(0, len(at) - 1, 2048):
        high = min(low + 2048, len(at) - 1)
        size = np.diff(at[low : high + 1])
        long = size >= LONG
        row = np.repeat(np.arange(high - low), size)
        bucket = mixed[at[low] : at[high]]
        key = row * NARROW + (bucket & np.uint64(NARROW - 1)).astype(np.int64)
        odd = (np.bincount(key, minlength=(high - low) * NARROW) & 1).astype(np.uint8)
        packed = np.packbits(odd).view("<i8").reshape(high - low, NARROW // 64)
        for i in range(high - low):
            if long[i]:
                own = (mixed[at[low + i] : at[low + i + 1]] & np.uint64(WIDE - 1)).astype(np.int64)
                out.append(np.packbits((np.bincount(own, minlength=WIDE) & 1).astype(np.uint8)).view("<i8"))
            else:
                out.append(packed[i])
    return out


def rows_of(docs: DataFrame, key: str, ranks: Ranks, n: int, percent: int) -> DataFrame:
    """``id, size, same, parity, rarest``: a name for the set, equal for equal sets, its parities, and its rarest
    grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in texts.slices(batches):
            grams, rank, at = gram_sets(s, n, ranks)
            size = np.diff(at)
            text = np.repeat(np.arange(len(s)), size)
            order = np.lexsort((grams, rank, text))
            place = np.arange(len(grams)) - np.repeat(at[:-1], size)
            front = size - needed(size, percent) + (size > 0)
            first = grams[order][place < np.repeat(front, size)].view(np.int64)
            same = [hashlib.blake2b(grams[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:])]
            bits = parities(grams, at)
            lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))
            columns = [
                s.batch.column(s.batch.schema.get_field_index(key)),
                pa.array(size, pa.int64()),
                pa.array(same, pa.binary()),
                lists(np.concatenate(bits), [len(x) for x in bits]),
                lists(first, front),
            ]
            yield pa.record_batch(columns, ["id", "size", "same", "parity", "rarest"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"id {kind}, size long, same binary, parity array<long>, rarest array<long>")


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and parities of two rows (column prefixes ``a``, ``b``) allow a link.  Parities of different
    width tell nothing."""
    size_a, size_b = F.col(f"{a}size"), F.col(f"{b}size")
    differing = F.aggregate(
        F.zip_with(f"{a}parity", f"{b}parity", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, x: total + x
    )
    fits = F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent
    return fits & ((F.size(f"{a}parity") != F.size(f"{b}parity")) | (differing <= most_differing(size_a, size_b, percent)))


def sieved(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` whose parities allow a link."""
    of = lambda name: sets.select(F.col("id").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("size", "parity")))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(may_link("a_", "b_", percent)).select("a", "b")


def shared_columns(sets: DataFrame, percent: int) -> DataFrame:
    """``gram, size, id`` of every gram that two rows of fitting sizes have among their rarest."""

    def live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, found = None, False  # the last row so far, and whether it has a neighbour
        for batch in batches:
            if not len(batch):
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            gram, size = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            near = (gram[1:] == gram[:-1]) & (size[:-1] >= needed(size[1:], percent))
            keep = np.zeros(len(gram), bool)
            keep[0] = found
            keep[1:] |= near
            keep[:-1] |= near
            held, found = batch.slice(len(batch) - 1), bool(keep[-1])
            yield batch.slice(0, len(batch) - 1).filter(pa.array(keep[:-1]))
        if held is not None and found:
            yield held

    columns = sets.select(F.explode("rarest").alias("gram"), "size", "id")
    return columns.repartition("gram").sortWithinPartitions("gram", "size", "id").mapInArrow(live, columns.schema)


def stars(columns: DataFrame, percent: int) -> DataFrame:
    """``centre, id``: each row of a column with the centre of its size band, and centres of neighbouring bands."""
    share = columns.groupBy("id").agg((F.count("*") / F.max(F.col("size") - F.floor((F.col("size") * percent + 99) / 100) + 1)).alias("share"))
    band = F.floor(F.log("size") / F.log(F.lit(100 / percent)) + 1e-9).cast("int").alias("band")
    dealt = columns.join(share, "id").select("gram", band, "share", "id")

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not len(batch):
                continue
            gram, band, row = (np.asarray(batch.column(i)) for i in (0, 1, 3))
            begins = np.ones(len(gram), bool)
            begins[1:] = (gram[1:] != gram[:-1]) | (band[1:] != band[:-1])
            if last is not None and last[:2] == (gram[0], band[0]):
                begins[0] = False
            start = np.maximum.accumulate(np.where(begins, np.arange(len(gram)), -1))
            centre = np.where(start >= 0, row[start], last[2] if last else 0)
            last = gram[-1], band[-1], centre[-1]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(centre), batch.column(3)], ["gram", "band", "centre", "id"])

    sorted_ = dealt.repartition("gram", "band").sortWithinPartitions("gram", "band", F.desc("share"), "id")
    kind = columns.schema["id"].dataType.simpleString()
    found = texts.stored(sorted_.mapInArrow(centred, f"gram long, band int, centre {kind}, id {kind}"), "stars")
    centres = found.where("centre = id").select("gram", "band", "centre").distinct()
    above = centres.select("gram", (F.col("band") - 1).alias("band"), F.col("centre").alias("id"))
    pairs = found.select("centre", "id").union(centres.join(above, ["gram", "band"]).select("centre", "id"))
    return pairs.where("centre <> id").select(F.least("centre", "id").alias("a"), F.greatest("centre", "id").alias("b")).distinct()


def linked(docs: DataFrame, key: str, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose texts link, by whole sets."""
    kind = docs.schema[key].dataType.simpleString()
    pairs = texts.stored(pairs, "pairs")
    often = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("often"))
    weighed = pairs.join(often.select(F.col("id").alias("a"), F.col("often").alias("of_a")), "a").join(
        often.select(F.col("id").alias("b"), F.col("often").alias("of_b")), "b"
    )
    turned = F.col("of_a") >= F.col("of_b")  # the more frequent one stays with the task
    placed = weighed.select(
        F.when(turned, F.col("a")).otherwise(F.col("b")).alias("centre"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("id")
    )
    parts = F.ceil(F.col("partners") / PARTNERS).cast("int")
    centres = placed.groupBy("centre").agg(F.count("*").alias("partners")).select("centre", parts.alias("parts"))
    members = placed.join(centres, "centre").select("id", "centre", F.expr("pmod(hash(id), parts)").alias("part"), F.lit(1).alias("role"))
    heads = centres.select(F.col("centre").alias("id"), "centre", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"))
    wanted = texts.stored(members.union(heads), "wanted")
    with_text = docs.select(F.col(key).alias("id"), "text").join(wanted, "id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in texts.slices(batches):
            grams, _, at = gram_sets(s, n)
            blobs = pa.array([grams[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())
            of = lambda name: s.batch.column(s.batch.schema.get_field_index(name))
            yield pa.record_batch([of("centre"), of("part"), of("role"), of("id"), blobs], ["centre", "part", "role", "id", "grams"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heads = None, []
        for batch in batches:
            a, b = [], []
            centre, part, role, row = (batch.column(i).to_pylist() for i in range(4))
            for i in range(len(batch)):
                grams = np.frombuffer(batch.column(4)[i].as_buffer(), np.uint64)
                if (centre[i], part[i]) != now:
                    now, heads = (centre[i], part[i]), []
                if role[i] == 0:
                    heads.append(grams.copy())
                    continue
                for head in heads:
                    short, long = (grams, head) if len(grams) < len(head) else (head, grams)
                    if not len(short) or len(short) < needed(len(long), percent):
                        continue
                    where = np.minimum(np.searchsorted(long, short), len(long) - 1)
                    both = int((long[where] == short).sum())
                    if 100 * both >= percent * (len(short) + len(long) - both):
                        a.append(centre[i])
                        b.append(row[i])
                        break
            yield pa.record_batch([pa.array(a, batch.column(0).type), pa.array(b, batch.column(3).type)], ["a", "b"])

    blobs = with_text.mapInArrow(sets, f"centre {kind}, part int, role int, id {kind}, grams binary")
    dealt = blobs.repartition("centre", "part").sortWithinPartitions("centre", "part", "role")
    return dealt.mapInArrow(compared, f"a {kind}, b {kind}")


def components(links: DataFrame, purpose: str) -> DataFrame:
    """``id, component`` of every linked row: the smallest id it reaches.  Each turn takes the smallest label among
    the neighbours, then that label's own label, until nothing changes."""
    both = texts.stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), f"{purpose}-links")
    label = texts.stored(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")), f"{purpose}-label")
    while True:
        heard = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("heard"))
        nearer = label.join(heard, "id").select("id", "component", F.least("component", "heard").alias("nearer"))
        jump = label.select(F.col("id").alias("nearer"), F.col("component").alias("further"))
        turned = nearer.join(jump, "nearer", "left").select("id", F.least("nearer", F.coalesce("further", "nearer")).alias("component"), F.col("component").alias("before"))
        turned = texts.stored(turned, f"{purpose}-label")
        label = turned.select("id", "component")
        if turned.where("component <> before").isEmpty():
            return label


def across(columns: DataFrame, sets: DataFrame, label: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` that share a column but no component, and that their parities allow to link."""
    labelled = columns.join(label, "id", "left").select("gram", "id", F.coalesce("component", "id").alias("component"))
    labelled = texts.stored(labelled, "labelled")
    mixed = labelled.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("gram")
    left = labelled.join(mixed, "gram", "left_semi").join(sets.select("id", "size", "parity"), "id")
    left = texts.stored(left, "mixed")
    x, y = left.alias("x"), left.alias("y")
    apart = (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))
    pairs = x.join(y, (F.col("x.gram") == F.col("y.gram")) & apart & may_link("x.", "y.", percent))
    return pairs.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def joined(docs: DataFrame, key: str = "doc_id", n: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """``key, n_shingles, component_id`` of every row."""
    rows = texts.stored(rows_of(docs, key, column_ranks(docs, n), n, percent), "gram-rows")
    named = rows.where("id is not null and size > 0")
    first = named.groupBy("same").agg(F.min("id").alias("id"), F.min_by(F.struct("size", "parity", "rarest"), "id").alias("row"))
    sets = texts.stored(first.select("same", "id", "row.*"), "sets")
    equal = sets.select("same", F.col("id").alias("first"))  # read as stored, so that a skewed join can be split
    columns = texts.stored(shared_columns(sets, percent), "columns")
    near = texts.stored(linked(docs, key, sieved(stars(columns, percent), sets, percent), n, percent), "near")
    left = across(columns, sets, components(near, "star"), percent)
    rest = texts.stored(linked(docs, key, left, n, percent), "rest")
    same = named.join(equal, "same").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    label = components(near.union(rest).union(same), "all")
    return rows.join(label, "id", "left").select(
        F.col("id").alias(key), F.col("size").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
