"""Token counts of whole texts without their ids.

A text is cut before every single space.  The tokenizer's own pattern never joins what stands on both sides of
such a cut, so the number of tokens of a text is the sum over its parts.  The parts are the pre-tokens here:

1. Blocks of texts become sparse rows (text, pre-token, frequency) and a list of the block's distinct pre-tokens.
2. The distinct pre-tokens meet by hash; the library encodes each of them once and only the count stays.
3. The counts return to their blocks, where frequency times count is summed by text.

Only distinct pre-tokens of a block move, not occurrences; a frequent one has one row per block.  Runs of two or
more spaces are not cut.  A null text is an empty one with no token.  Repeated rows and keys, also null keys, are
counted one by one.  An empty table gives an empty result.
"""

from __future__ import annotations

import os
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierflow.llm import texts

BLOCK_BYTES = 16 << 20
MEMO = 1 << 18
LIMIT = 1024

SINGLE_SPACE = re.compile(rb"(?<! ) (?! )")


def library(path: str, parallel: bool = False):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "true" if parallel else "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pieces(tokenizer, parts: list[str]) -> list[int]:
    return [len(e) for e in tokenizer.encode_batch_fast(parts, add_special_tokens=False)]


def parts_of(text: bytes) -> list[bytes]:
    """The text cut before single spaces, without those spaces."""
    return SINGLE_SPACE.split(text) if b"  " in text else text.split(b" ")


def packed(values: np.ndarray) -> bytes:
    """Whole numbers by byte plane, compressed; read by ``unpacked``."""
    planes = np.ascontiguousarray(values.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, 4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _blob(task: int, block: int, which: np.ndarray, often: np.ndarray, rows: pa.RecordBatch | None = None) -> pa.RecordBatch:
    body = pickle.dumps((len(which), packed(which), packed(often), rows and _ipc(rows)))
    return pa.record_batch([[task], [block << PLACES], [None], [body]], schema=ROWS)


# Blocks are numbered within the task that cut them.  A pre-token has a place, 28 bits within its block; a block, and a
# list of counts for it, is a blob at place 0.
ROWS = pa.schema([("task", pa.int32()), ("place", pa.int64()), ("part", pa.string()), ("blob", pa.binary())])
PLACES = 28


def _block(s: texts.Slice, task: int, block: int, key: str) -> Iterator[pa.RecordBatch]:
    seen: dict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    new_which, new_often, per = [], [], np.zeros(len(s), np.int64)
    for i in range(len(s)):
        parts = parts_of(s.text(i))
        counts = Counter([b" " + p for p in parts[1:]])
        if parts[0]:
            counts[parts[0]] += 1
        per[i] = len(counts)
        new_which.append(np.fromiter(map(seen.__getitem__, counts), np.int32, len(counts)))
        new_often.append(np.fromiter(counts.values(), np.int32, len(counts)))
        counts.clear()
    which, often = np.concatenate(new_which), np.concatenate(new_often)
    new_which.clear()
    new_often.clear()
    edge = np.concatenate([[0], np.cumsum(per)])
    for low, high in zip(edge[:-1], edge[1:]):
        order = np.argsort(which[low:high])
        which[low:high], often[low:high] = which[low:high][order], often[low:high][order]
    step = np.diff(which, prepend=np.int32(0)).view(np.uint32)
    rows = pa.record_batch([s.batch.column(s.batch.schema.get_field_index(key)), pa.array(np.diff(s.at)), pa.array(per)], [key, "n_bytes", "parts"])
    yield _blob(task, block, step, often, rows)
    del which, often, step
    distinct = list(seen)
    seen.clear()
    for low in range(0, len(distinct), 1 << 16):
        some = pa.array(distinct[low : low + (1 << 16)], pa.binary()).cast(pa.string())
        place = (block << PLACES) + np.arange(low, low + len(some), dtype=np.int64)
        yield pa.record_batch([pa.array(np.full(len(some), task, np.int32)), pa.array(place), some, pa.nulls(len(some), pa.binary())], schema=ROWS)
    del distinct
    pa.default_memory_pool().release_unused()


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Blocks pass; pre-tokens become packed lists of (place in the block, count), one per block."""
    tokenizer, memo = library(path), {}
    for batch in batches:
        part = batch.column(2)
        if part.null_count:
            yield batch.filter(part.is_null())
            batch = batch.filter(part.is_valid())
        if not len(batch):
            continue
        coded = batch.column(2).dictionary_encode()
        new = [p for p in coded.dictionary.to_pylist() if p not in memo]
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = coded.dictionary.to_pylist()
        memo.update(zip(new, pieces(tokenizer, new)))
        count = np.array([memo[p] for p in coded.dictionary.to_pylist()], np.int64)[np.asarray(coded.indices)]
        task, place = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        order = np.lexsort((place, task))
        task, place, count = task[order], place[order], count[order]
        block, at = place >> PLACES, place & ((1 << PLACES) - 1)
        cut = np.concatenate([[0], np.flatnonzero((np.diff(block) != 0) | (np.diff(task) != 0)) + 1, [len(block)]])
        for low, high in zip(cut[:-1], cut[1:]):
            yield _blob(int(task[low]), int(block[low]), np.diff(at[low:high], prepend=0), count[low:high])


def counts(docs: DataFrame, path: str, key: str = "doc_id", block_bytes: int = BLOCK_BYTES, limit: int = LIMIT) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every row; ``path`` names a file of the tokenizers library."""
    kind = docs.schema[key].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for n, s in enumerate(texts.slices(batches, most=block_bytes)):
            yield from _block(s, task, n, key)

    def summed(rows: pa.Table) -> pa.Table:
        head, lists, size = None, [], 0
        for body in rows.column("blob").to_pylist():
            n, which, often, of = pickle.loads(body)
            if of is not None:
                head = n, which, often, of
            else:
                lists.append((np.cumsum(unpacked(which, n)), unpacked(often, n)))
                size = max(size, int(lists[-1][0][-1]) + 1)
        cost = np.zeros(size, np.int64)
        for at, count in lists:
            cost[at] = count
        out = pa.ipc.open_stream(head[3]).read_all()
        step, often = unpacked(head[1], head[0]), unpacked(head[2], head[0])
        which = (np.cumsum(step) & 0xFFFFFFFF).astype(np.int64)
        total = np.concatenate([[0], np.cumsum(cost[which] * often)]) if len(which) else np.zeros(1, np.int64)
        end = np.cumsum(np.asarray(out.column("parts")))
        n = total[end] - total[end - np.asarray(out.column("parts"))]
        return pa.table({key: out.column(key), "n_bytes": out.column("n_bytes"), "n_tokens": n, "over_limit": n > limit})

    schema = "task int, place long, part string, blob binary"
    rows = docs.select(key, "text").mapInArrow(blocks, schema)
    met = rows.repartition(F.when(F.col("part").isNull(), F.xxhash64("task", "place")).otherwise(F.xxhash64("part")))
    return (
        met.mapInArrow(lambda batches: _counted(batches, path), schema)
        .groupBy("task", F.shiftright("place", PLACES).alias("block"))
        .applyInArrow(summed, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")
    )
