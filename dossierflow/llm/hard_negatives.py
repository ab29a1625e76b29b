"""Hard negatives of anchors by rotated one-bit codes.

Components become whole numbers; a score is the exact inner product of two such vectors.  Every vector is rotated (two
rounds of random signs and a Hadamard transform), scaled to length 1 and coded: the signs of its components, and its
alignment with that sign vector.  What the code leaves over is rotated and coded again, ``LEVELS`` times, and the length
r of the last remainder is kept.  An anchor z is held in each level's basis as ``PLANES`` bit planes, which leave d_l
over.  For unit vectors the estimate is a sum of popcounts, one for each level and plane, and by Cauchy-Schwarz

    |<z, y> - estimate| <= r + sum over levels of d_l * (alignment of y at level l),

an interval that holds always, not only with high probability.  Pairs whose interval cannot enter an anchor's answer
so far are dropped; the others are scored in whole numbers.

Vectors are coded once, in blocks of rows, and written.  All anchors meet all vectors in the cells of a grid: groups
of anchors by shards of vectors, each bounded in bytes, so a cell's size does not depend on the data or on labels.
Cells return their best rows per anchor, and windows merge those.  First the positives are found, then the negatives,
whose limits follow from them.

Rows with a null id, label or vector, or with a null or non-finite component, take no part.  Vectors of different
lengths are compared as if zeros followed the shorter one.  Equal rows count once; rows of one id with different
vectors are different rows.  Components beyond 2^500, and scores beyond ``SCORE_LIMIT``, are held at that bound.  Other
columns are not read, so they may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossierflow.llm import texts

LEVELS, PLANES = 6, 6
SEED = 13
BLOCK = 4096
ROW_BYTES, ANCHOR_BYTES = 24 << 20, 6 << 20  # of a cell
CHUNKS = (128, 1024, 8192)  # vectors compared at once, while an anchor's answer fills
ANCHORS = 64
SLACK = 1e-4  # rounding of estimates in single precision, for unit vectors
SCORE_LIMIT = (1 << 63) // 200
CODED = "place long, n long, ids binary, labels binary, anchor binary, small boolean, values binary, codes binary, scales binary, rest binary, norm binary"


class Codes(NamedTuple):
    """Sign bits (vector, level, word), alignments (vector, level), length of the remainder and of the vector."""

    bits: np.ndarray
    scales: np.ndarray
    rest: np.ndarray
    norm: np.ndarray


class Asked(NamedTuple):
    """Signs of an anchor's multiples (anchor, level, plane, word), their step and what is left in each level's basis."""

    bits: np.ndarray
    steps: np.ndarray
    rest: np.ndarray
    norm: np.ndarray


class Vectors(NamedTuple):
    ids: np.ndarray
    labels: np.ndarray
    values: np.ndarray
    codes: Codes | Asked


def padded(dims: int) -> int:
    """Power of two, 64 at least."""
    return max(64, 1 << max(dims - 1, 0).bit_length())


def rotated(x: np.ndarray) -> np.ndarray:
    n, dims = x.shape
    signs = np.random.default_rng(SEED).integers(0, 2, (2, dims)) * 2.0 - 1.0
    for sign in signs:
        x = x * sign
        half = 1
        while half < dims:
            pair = x.reshape(n, -1, 2, half)
            x = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(n, dims)
            half *= 2
        x /= np.sqrt(dims)
    return x


def unit(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = values.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm > 0, norm, 1.0)[:, None], norm


def packed_signs(plus: np.ndarray) -> np.ndarray:
    return np.packbits(plus, axis=1, bitorder="little").view("<u8")


def coded(values: np.ndarray) -> Codes:
    left, norm = unit(values)
    bits, scales = [], []
    for _ in range(LEVELS):
        left = rotated(left)
        plus = left >= 0
        scale = np.abs(left).mean(axis=1).astype(np.float32)
        left = left - np.where(plus, scale[:, None], -scale[:, None])
        bits.append(packed_signs(plus))
        scales.append(scale)
    rest = np.sqrt((left * left).sum(axis=1)).astype(np.float32)
    return Codes(np.stack(bits, axis=1), np.stack(scales, axis=1), rest, norm)


def asked(values: np.ndarray) -> Asked:
    """Anchors in the basis of every level, as odd multiples of a step: signs times powers of two."""
    x, norm = unit(values)
    bits, steps, rest = [], [], []
    for _ in range(LEVELS):
        x = rotated(x)
        step = np.abs(x).max(axis=1) / ((1 << PLANES) - 1)
        level = np.clip(np.floor((x / np.where(step > 0, step, 1.0)[:, None] + (1 << PLANES)) / 2), 0, (1 << PLANES) - 1).astype(np.int64)
        off = x - (2 * level - (1 << PLANES) + 1) * step[:, None]
        bits.append(np.stack([packed_signs(level >> b & 1 == 1) for b in range(PLANES)], axis=1))
        steps.append(step)
        rest.append(np.sqrt((off * off).sum(axis=1)))
    return Asked(np.stack(bits, axis=1), np.stack(steps, axis=1).astype(np.float32), np.stack(rest, axis=1).astype(np.float32), norm)


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        v = np.floor(scale * x.astype(np.float64))
    return np.clip(v, -(2.0**500), 2.0**500)


def packed(batches: Iterator[pa.RecordBatch], dims: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Blocks of coded vectors: ids, labels, whole numbers (16 bits where they fit), codes."""
    from pyspark import TaskContext

    place = TaskContext.get().partitionId() << 32
    for batch in batches:
        for low in range(0, len(batch), BLOCK):
            ids, labels, anchor, vectors = batch.slice(low, BLOCK).columns
            size = np.asarray(vectors.value_lengths())
            values = np.zeros((len(size), dims))
            row = np.repeat(np.arange(len(size)), size)
            values[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = whole(vectors.flatten().to_numpy(), scale)
            small = bool((np.abs(values) < 1 << 15).all())
            codes = coded(values)
            body = [
                ids.to_numpy(), labels.to_numpy(), anchor.to_numpy(zero_copy_only=False),
                values.astype("<i2" if small else "<f8"), codes.bits, codes.scales, codes.rest, codes.norm,
            ]
            data = [b.tobytes() for b in body]
            yield pa.RecordBatch.from_pylist([dict(zip(SHAPE.names, [place, len(size), *data[:3], small, *data[3:]]))], schema=SHAPE)
            place += 1


SHAPE = pa.schema([
    ("place", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("anchor", pa.binary()), ("small", pa.bool_()),
    *((c, pa.binary()) for c in ("values", "codes", "scales", "rest", "norm")),
])
ANCHOR = pa.schema([("anchor_id", pa.int64()), ("label", pa.int64()), ("small", pa.bool_()), ("values", pa.binary())])
BEST = pa.schema([("anchor_id", pa.int64()), ("ref", pa.int64()), ("p", pa.int32()), ("id", pa.int64()), ("score", pa.int64())])


def unpacked(body: bytes, small: bool, n: int) -> np.ndarray:
    return np.frombuffer(body, "<i2" if small else "<f8").reshape(n, -1)


def anchors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.to_pylist():
            pick = np.flatnonzero(np.frombuffer(b["anchor"], bool))
            values = unpacked(b["values"], b["small"], b["n"])[pick]
            ids, labels = (np.frombuffer(b[c], "<i8")[pick] for c in ("ids", "labels"))
            small = (np.abs(values.astype(np.float64)) < 1 << 15).all(axis=1)
            body = [v.astype("<i2" if s else "<f8").tobytes() for v, s in zip(values, small)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(labels), pa.array(small), pa.array(body, pa.binary())], schema=ANCHOR)


def vectors_of(blocks: pa.Table) -> Vectors:
    parts: list[list[np.ndarray]] = [[] for _ in range(7)]
    for b in blocks.to_pylist():
        n = b["n"]
        values = unpacked(b["values"], b["small"], n)
        own = [
            np.frombuffer(b["ids"], "<i8"), np.frombuffer(b["labels"], "<i8"), values, np.frombuffer(b["codes"], "<u8").reshape(n, LEVELS, -1),
            np.frombuffer(b["scales"], "<f4").reshape(n, LEVELS), np.frombuffer(b["rest"], "<f4"), np.frombuffer(b["norm"], "<f8"),
        ]
        for part, a in zip(parts, own):
            part.append(a)
    ids, labels, values, *codes = (np.concatenate(p) for p in parts)
    return Vectors(ids, labels, values, Codes(*codes))


def bounds(z: Asked, y: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest possible inner product of every anchor with every vector."""
    dims = 64 * y.bits.shape[2]
    estimate = np.zeros((len(z.norm), len(y.norm)), np.float32)
    for level in range(LEVELS):
        differ = np.zeros_like(estimate)
        for plane in range(PLANES):
            count = np.bitwise_count(z.bits[:, level, plane, 0, None] ^ y.bits[None, :, level, 0]).astype(np.uint8 if dims == 64 else np.uint32)
            for word in range(1, y.bits.shape[2]):
                count += np.bitwise_count(z.bits[:, level, plane, word, None] ^ y.bits[None, :, level, word])
            differ += np.float32(2 << plane) * count
        # <signs, signs> = dims - 2 * differing bits, summed over planes of weight 1, 2, 4, ...
        estimate += y.scales[:, level] * (z.steps[:, level, None] * (np.float32(dims * ((1 << PLANES) - 1)) - differ))
    off = y.rest + np.float32(np.sqrt(dims)) * (z.rest @ y.scales.T) + np.float32(SLACK)
    size = z.norm[:, None] * y.norm
    return (estimate - off) * size, (estimate + off) * size


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows in pairs, within the limit."""
    if np.abs(a).max(initial=0).astype(float) * np.abs(b).max(initial=0) * max(a.shape[1], 1) < 1 << 53:  # whole numbers that doubles hold
        return np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64)
    exact = (sum(int(x) * int(y) for x, y in zip(p, q) if x and y) for p, q in zip(a, b))
    return np.array([min(max(s, -SCORE_LIMIT), SCORE_LIMIT) for s in exact], np.int64)


class Best:
    """The first ``k`` (score, id) per slot, higher scores first, then smaller ids; equal ones once."""

    def __init__(self, slots: int, k: int):
        self.k, self.slots = k, slots
        self.slot, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.last = np.full(slots, -np.inf)

    def add(self, slot: np.ndarray, score: np.ndarray, ident: np.ndarray) -> None:
        slot, score, ident = (np.concatenate(p) for p in ((self.slot, slot), (self.score, score), (self.id, ident)))
        order = np.lexsort((ident, -score, slot))
        slot, score, ident = slot[order], score[order], ident[order]
        new = np.ones(len(slot), bool)
        new[1:] = (np.diff(slot) != 0) | (np.diff(score) != 0) | (np.diff(ident) != 0)
        slot, score, ident = slot[new], score[new], ident[new]
        first = np.searchsorted(slot, slot)
        rank = np.arange(len(slot)) - first
        keep = rank < self.k
        self.slot, self.score, self.id = slot[keep], score[keep], ident[keep]
        full = np.flatnonzero(keep & (rank == self.k - 1))
        self.last[slot[full]] = score[full]


def chunks(n: int) -> Iterator[tuple[int, int]]:
    low, step = 0, 0
    while low < n:
        size = CHUNKS[min(step, len(CHUNKS) - 1)]
        yield low, min(low + size, n)
        low, step = low + size, step + 1


def met(anchors: Vectors, vectors: Vectors, best: Best, per_anchor: int, allowed) -> None:
    """Fill ``best`` (``per_anchor`` slots for each anchor).  ``allowed(low, high)`` gives the least and the largest
    score that anchors low to high can still use, and ``allowed(low, high, i, score)`` the slots of scored pairs."""
    for low in range(0, len(anchors.ids), ANCHORS):
        high = min(low + ANCHORS, len(anchors.ids))
        z = Asked(*(c[low:high] for c in anchors.codes))
        for begin, end in chunks(len(vectors.ids)):
            least, most = bounds(z, Codes(*(c[begin:end] for c in vectors.codes)))
            floor, ceiling = allowed(low, high)
            i, j = np.nonzero((most >= floor[:, None]) & (least <= ceiling[:, None]))
            if not len(i):
                continue
            i, j = i + low, j + begin
            itself = np.flatnonzero(anchors.ids[i] == vectors.ids[j])
            itself = itself[(anchors.values[i[itself]] == vectors.values[j[itself]]).all(axis=1) & (anchors.labels[i[itself]] == vectors.labels[j[itself]])]
            i, j = np.delete(i, itself), np.delete(j, itself)
            score = np.concatenate([scores(anchors.values[i[k : k + 65536]], vectors.values[j[k : k + 65536]]) for k in range(0, max(len(i), 1), 65536)])
            for p, take in enumerate(allowed(low, high, i, score)):
                best.add(i[take] * per_anchor + p, score[take], vectors.ids[j[take]])


def of(vectors: Vectors, rows: np.ndarray) -> Vectors:
    return Vectors(vectors.ids[rows], vectors.labels[rows], vectors.values[rows], Codes(*(c[rows] for c in vectors.codes)))


def cell(anchors: pa.Table, blocks: pa.Table, same: bool, per_anchor: int, k: int, low: int, high: int) -> pa.Table:
    """The best rows of a cell's vectors for each of its anchors: of its label, or of others between the limits."""
    if not len(anchors) or not len(blocks):
        return BEST.empty_table()
    vectors = vectors_of(blocks)
    small = anchors.column("small").to_pylist()
    values = [np.frombuffer(v, "<i2" if s else "<f8") for v, s in zip(anchors.column("values").to_pylist(), small)]
    values = np.stack([v.astype(np.result_type(*values)) for v in values])
    ids, refs, labels = (np.asarray(anchors.column(c)) for c in ("anchor_id", "ref", "label"))
    limits = None if same else anchors.column("positive_scores").to_pylist()
    out = []
    for label in np.unique(labels):
        rows = np.flatnonzero(labels == label)
        others = of(vectors, np.flatnonzero((vectors.labels == label) == same))
        own = Vectors(ids[rows], labels[rows], values[rows], asked(values[rows]))
        best = Best(len(rows) * per_anchor, k)
        if same:

            def allowed(a, b, i=None, score=None, best=best):
                return (best.last[a:b], np.full(b - a, np.inf)) if i is None else [np.arange(len(i))]
        else:
            # Missing positives can use no score.
            ps = np.array([(limits[r] + [None] * per_anchor)[:per_anchor] for r in rows], object)
            there = ps != np.array(None)
            ps = np.where(there, ps, 0).astype(np.int64)

            def allowed(a, b, i=None, score=None, best=best, ps=ps, there=there):
                if i is None:
                    floor = np.maximum(ps[a:b] * (low / 100) - 1, best.last.reshape(ps.shape)[a:b])
                    ceiling = ps[a:b] * (high / 100) + 1
                    return np.where(there[a:b], floor, np.inf).min(axis=1), np.where(there[a:b], ceiling, -np.inf).max(axis=1)
                fits = there[i] & (low * ps[i] <= 100 * score[:, None]) & (100 * score[:, None] <= high * ps[i])
                return [np.flatnonzero(fits[:, p]) for p in range(per_anchor)]

        met(own, others, best, per_anchor, allowed)
        at = rows[best.slot // per_anchor]
        out.append(pa.table([ids[at], refs[at], (best.slot % per_anchor).astype(np.int32), best.id, best.score], schema=BEST))
    return pa.concat_tables(out)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of every anchor and slot, numbered from 1."""
    order = Window.partitionBy("anchor_id", "ref", "p").orderBy(F.desc("score"), "id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mined(
    rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0,
) -> DataFrame:
    """For every row that ``anchor`` selects and each of its first ``positives`` rows of the same label, the first
    ``negatives`` rows of other labels whose score is ``low`` to ``high`` per cent of the positive's."""
    spark = rows.sparkSession
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = rows.select(
        F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector).alias("vector")
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & sound)
    longest = valid.agg(F.max(F.size("vector"))).first()[0]
    dims = padded(longest or 1)
    blocks = texts.stored(valid.mapInArrow(lambda b: packed(b, dims, scale), CODED), "coded-vectors")

    own = blocks.select("n", "ids", "labels", "anchor", "small", "values").mapInArrow(anchors_of, "anchor_id long, label long, small boolean, values binary")
    own = own.distinct().withColumn("ref", F.xxhash64("label", "values"))
    own = texts.stored(own, "anchor-vectors")
    n_rows, n_anchors = blocks.agg(F.sum("n")).first()[0] or 0, own.count()
    per_row = 2 * dims + LEVELS * (dims // 8 + 4) + 28
    shards = max(1, -(-n_rows * per_row // ROW_BYTES), min(2 * spark.sparkContext.defaultParallelism, -(-n_rows // BLOCK)))
    groups = max(1, -(-n_anchors * per_row // ANCHOR_BYTES))
    tasks = 3 * shards * groups

    def grid(anchors: DataFrame, name: str, same: bool, per_anchor: int, k: int) -> DataFrame:
        """Every group of anchors with every shard of vectors."""
        group = F.pmod(F.xxhash64("anchor_id", "ref"), F.lit(groups))
        shard = F.pmod(F.xxhash64("place"), F.lit(shards))
        left = anchors.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: group * shards + s)))
        right = blocks.drop("anchor").withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g * shards + shard)))
        both = left.repartition(tasks, "cell").groupBy("cell").cogroup(right.repartition(tasks, "cell").groupBy("cell"))
        found = both.applyInArrow(lambda a, b: cell(a, b, same, per_anchor, k, low, high), "anchor_id long, ref long, p int, id long, score long")
        return texts.stored(ranked(found, k), name)

    first = grid(own, "positives", True, 1, positives)
    listed = first.groupBy("anchor_id", "ref").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("first"))
    limited = own.join(listed, ["anchor_id", "ref"]).withColumn("positive_scores", F.col("first.score")).drop("first")
    last = grid(limited, "negatives", False, positives, negatives)
    place = first.select("anchor_id", "ref", (F.col("rank") - 1).alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return last.join(place, ["anchor_id", "ref", "p"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
