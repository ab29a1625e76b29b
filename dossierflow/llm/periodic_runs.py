"""Runs of periodic words, by tiles of every period octave.

A run is a stretch of words with smallest period q, at least ``max(6, 4 q)`` long, that no neighbouring word extends.
Its places i with ``word[i] == word[i + q]`` form one interval; intervals are found in three steps.

1. ``cut``: for the octave of periods [P, 2P) every multiple of P is a boundary.  An interval of a run begins less
   than P words before some boundary from which on ``block(P)`` places lie in it, so a boundary whose block of words
   comes again P to 2P words later is kept (rolling hashes; a false hit costs time only).  Neighbouring kept
   boundaries become one tile: the words around them, overlapping the next tile.
2. ``solved``: tiles are dealt to all tasks.  In a tile the Z-function at each boundary gives how far every shift of
   the octave matches to the right; two shifts that match a block are multiples of a smaller period (Fine and Wilf), a
   single one is kept if no divisor of it matches, and is followed to the left.  Each gives a fragment.
3. ``stitched``: fragments meet by document and period; those that touch are one interval.

Only kept tiles and fragments are shuffled, and the words of documents that have tiles.  Memory of a task follows
its longest text.  Words are compared by 64-bit hashes in the tiles.

Null and empty texts have no word and no run.  A null key changes no word.  Rows equal in key and text get equal
results and are solved once; rows of one key with different texts are different.  Other columns are not read, so they
may have any name.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dossierflow.llm import texts

SHORTEST, POWER = 6, 4
BOUNDARIES = 8  # of a tile
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
TILES = "array<struct<octave: long, offset: long, first: long, boundaries: int, ids: binary>>"
TILE = pa.struct([("octave", pa.int64()), ("offset", pa.int64()), ("first", pa.int64()), ("boundaries", pa.int32()), ("ids", pa.binary())])


def block(octave: int) -> int:
    """Places that lie in a run's interval from the first boundary in it on, for any period of the octave."""
    return 5 if octave < 4 else 2 * octave + 1


def planted(key, n: int) -> tuple[int, int]:
    """From which word on words are changed, and with which period; (n, 1) if none is."""
    if key is None or n == 0:
        return n, 1
    h = zlib.crc32(str(key).encode())
    if h % 10:
        return n, 1
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def rolling(x: np.ndarray, size: int, total: np.ndarray, back: np.ndarray) -> np.ndarray:
    """Hash of the ``size`` values that begin at each place, from running totals."""
    return (total[size:] - total[:-size]) * back[: len(x) - size + 1]


def boundaries(x: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per octave the boundaries whose block of words comes again within the octave's periods."""
    powers = np.full(len(x), BASE, np.uint64)
    back = np.full(len(x), INVERSE, np.uint64)
    powers[:1] = back[:1] = 1
    np.cumprod(powers, out=powers)
    np.cumprod(back, out=back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * powers)])
    octave = 1
    while POWER * octave <= longest:
        if len(x) > block(octave) + octave:
            h = rolling(x, block(octave), total, back)
            rows = len(h) // octave
            square = h[: rows * octave].reshape(rows, octave)
            again = np.zeros(rows, bool)
            again[:-1] = (square[1:] == square[:-1, :1]).any(axis=1)
            if rows:
                again[-1] = (h[rows * octave :] == square[-1, 0]).any()
            yield octave, np.flatnonzero(again) * octave
        octave *= 2


def tiles_of(x: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray) -> dict[int, list[dict]]:
    """Tiles by document.  ``x`` holds the words of all documents with a value of its own after each; ``doc`` is the
    document of every place, ``begin`` and ``end`` its places."""
    found: dict[int, list[dict]] = {}
    for octave, kept in boundaries(x, int((end - begin).max(initial=0))):
        if not len(kept):
            continue
        of = doc[kept]
        new = np.concatenate([[True], (np.diff(kept) != octave) | (np.diff(of) != 0)])
        start = np.maximum.accumulate(np.where(new, np.arange(len(kept)), 0))
        new |= (np.arange(len(kept)) - start) % BOUNDARIES == 0
        head = np.flatnonzero(new)
        count = np.diff(np.concatenate([head, [len(kept)]]))
        for first, n, d in zip(kept[head].tolist(), count.tolist(), of[head].tolist()):
            low = max(int(begin[d]), first - octave)
            high = min(int(end[d]), first + (n - 1) * octave + block(octave) + 3 * octave)
            ids = np.unique(x[low:high], return_inverse=True)[1].astype("<i4")
            found.setdefault(d, []).append({"octave": octave, "offset": low - int(begin[d]), "first": first - low, "boundaries": n, "ids": ids.tobytes()})
    return found


def cut(batches: Iterator[pa.RecordBatch], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Per document its number of words, and either the digest of its words or its words and tiles."""
    for batch in batches:
        for s in texts.slices([batch]):
            w = texts.words(s)
            keys = s.batch.column(0).to_pylist()
            n = np.diff(w.first)
            place = np.arange(len(w.start))
            for d, key in enumerate(keys):
                a, p = planted(key, int(n[d]))
                if a < n[d]:
                    place[w.first[d] + a : w.first[d + 1]] = w.first[d] + a + np.arange(n[d] - a) % p
            begin = w.first[:-1] + np.arange(len(s))
            end = begin + n
            x = np.empty(len(place) + len(s), np.uint64)
            x[end] = texts.mix(np.arange(1, len(s) + 1, dtype=np.uint64))
            doc = np.repeat(np.arange(len(s)), n + 1)
            inside = np.ones(len(x), bool)
            inside[end] = False
            x[inside] = texts.span_hashes(s.data, w.start, w.end)[place]
            found = tiles_of(x, doc, begin, end)
            words, digest = [], []
            for d, key in enumerate(keys):
                own = s.text(d).split()
                a, p = planted(key, len(own))
                if a < len(own):
                    own[a:] = [own[a + i % p] for i in range(len(own) - a)]
                joined = b" ".join(own)
                words.append(joined if d in found else None)
                digest.append(None if d in found else hashlib.sha256(joined).hexdigest())
            tiles = pa.array([found.get(d) for d in range(len(s))], pa.list_(TILE))
            columns = [s.batch.column(0), s.batch.column(1), pa.array(n), pa.array(words, pa.binary()), pa.array(digest, pa.string()), tiles]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape)], schema=shape)


def z_function(x: array, most: int) -> array:
    """How many values from each shift below ``most`` on equal those from the start on."""
    z, left, right = array("i", bytes(4 * most)), 0, 0
    n = len(x)
    for i in range(1, min(most, n)):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def divisors(q: int) -> list[int]:
    """q divided by each of its prime factors."""
    found, rest, p = [], q, 2
    while p * p <= rest:
        if rest % p == 0:
            found.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return found + [q // rest] if rest > 1 else found


def fragments(octave: int, offset: int, first: int, count: int, ids: np.ndarray) -> list[list[int]]:
    """(period, begin, end) of the parts of run intervals around the boundaries of a tile."""
    out: list[list[int]] = []
    need = block(octave)
    for c in range(first, first + count * octave, octave):
        z = z_function(array("i", ids[c : c + need + 3 * octave].tobytes()), 2 * octave)
        shifts = [q for q in range(octave, 2 * octave) if z[q] >= need]
        if len(shifts) != 1 or any(z[d] >= shifts[0] - d for d in divisors(shifts[0])):
            continue
        q = shifts[0]
        low = max(0, c - octave)
        differs = np.flatnonzero(ids[low:c] != ids[low + q : c + q])
        begin = low + int(differs[-1]) + 1 if len(differs) else low
        end = c + min(z[q], need + octave)
        if out and out[-1][0] == q and out[-1][2] >= offset + begin:
            out[-1][2] = offset + end
        else:
            out.append([q, offset + begin, offset + end])
    return out


def solve(batches: Iterator[pa.RecordBatch], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row, found = [], []
        for i, t in enumerate(batch.select(range(2, 7)).to_pylist()):
            mine = fragments(t["octave"], t["offset"], t["first"], t["boundaries"], np.frombuffer(t["ids"], "<i4"))
            row += [i] * len(mine)
            found += mine
        own = [batch.column(c).take(pa.array(row, pa.int64())) for c in (0, 1)]
        more = [pa.array([f[c] for f in found], pa.int64()) for c in range(3)]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*own, *more], shape)], schema=shape)


def stitched(parts: DataFrame) -> DataFrame:
    """Runs (start, period, length) from fragments: those of a document and period that touch are one."""
    along = Window.partitionBy("key", "mark", "period").orderBy("low", "high")
    before = F.max("high").over(along.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.col("low") <= before, 0).otherwise(1)
    island = F.sum("apart").over(along)
    whole = (
        parts.select("*", apart.alias("apart"))
        .select("*", island.alias("island"))
        .groupBy("key", "mark", "period", "island")
        .agg(F.min("low").alias("start"), (F.max("high") - F.min("low") + F.col("period")).alias("length"))
    )
    return whole.where(F.col("length") >= F.greatest(F.lit(SHORTEST), POWER * F.col("period"))).select("key", "mark", "start", "period", "length")


def digests(batches: Iterator[pa.RecordBatch], shape: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The result of documents with tiles: their words and sorted runs are at hand."""
    for batch in batches:
        out = []
        for words, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            own, runs = words.split(b" "), runs or []
            keep = np.ones(len(own), bool)
            best = None
            for r in runs:
                keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
                if best is None or r["length"] * best["period"] > best["length"] * r["period"]:
                    best = r
            listed = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs)
            top = [None] * 4 if best is None else [best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]]
            kept = b" ".join(w for w, k in zip(own, keep) if k)
            out.append((len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
        columns = [batch.column(0), *(pa.array([r[c] for r in out]) for c in range(7))]
        yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, shape)], schema=shape)


def found(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key``, number of runs, the run of greatest length / period, and digests of all runs and of the text without
    repetitions, of every row."""
    kind = docs.schema[key].dataType.simpleString()
    keyed = docs.select(F.col(key).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")
    arrow = pa_type(docs, key)
    shape = pa.schema([("key", arrow), ("mark", pa.int64()), ("n_words", pa.int64()), ("words", pa.binary()), ("collapsed", pa.string()), ("tiles", pa.list_(TILE))])
    parted = keyed.mapInArrow(lambda b: cut(b, shape), f"key {kind}, mark long, n_words long, words binary, collapsed string, tiles {TILES}")
    parted = texts.stored(parted, "period-tiles")

    busy, calm = parted.where("tiles is not null"), parted.where("tiles is null")
    tiles = busy.select("key", "mark", F.inline("tiles")).dropDuplicates(["key", "mark", "octave", "offset", "first"])
    part = pa.schema([("key", arrow), ("mark", pa.int64()), *((c, pa.int64()) for c in ("period", "low", "high"))])
    parts = tiles.mapInArrow(lambda b: solve(b, part), f"key {kind}, mark long, period long, low long, high long")
    runs = stitched(parts).groupBy("key", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))

    on = F.col("t.key").eqNullSafe(F.col("r.key")) & (F.col("t.mark") == F.col("r.mark"))
    met = busy.select("key", "mark", "words").alias("t").join(runs.alias("r"), on, "left").select("t.key", "words", "runs")
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    out = pa.schema([(key, arrow), *((c, pa.int64()) for c in numbers), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
    schema = f"`{key}` {kind}, {', '.join(f'{c} long' for c in numbers)}, runs_sha256 string, collapsed_sha256 string"
    none = F.lit(None).cast("long")
    return met.mapInArrow(lambda b: digests(b, out), schema).unionByName(
        calm.select(
            F.col("key").alias(key), F.lit(0).cast("long").alias("n_runs"), *(none.alias(c) for c in numbers[1:]),
            F.sha2(F.lit(""), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
        )
    )


def pa_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
