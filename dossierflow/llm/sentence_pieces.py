"""SentencePiece encoding and decoding with the tokenizers library.

The model file is read as protobuf wire format; from its pieces, scores and normaliser settings a tokenizer of the
other library is built: normaliser with metaspace marker, a unigram model with the scores or a BPE model whose
merges are ranked by them, byte fallback, and the decoder.

Where no piece holds the marker behind another character and the normaliser changes nothing but spaces, a text is
cut before every run of spaces and each distinct part is encoded once in a task, in multithreaded batches; otherwise
whole texts are.  Parity: the sentencepiece library encodes the same parts; where the two differ its ids count, and
the row tells how many of its parts differed.

Null texts are empty and have no ids.  A text with the marker character itself decodes to a space in its place, so
it does not come back as it was.  Repeated rows and null keys are encoded one by one; an empty table gives an empty
result.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dossierflow.llm import texts

MARK = "▁"
MEMO = 1 << 19  # parts remembered before a task forgets them all
THREADS = 2
# Fixed values of the format: kinds of piece and of model.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNIGRAM, BPE = 1, 2
RUNS = re.compile(rb" +[^ ]*")


class Piece(NamedTuple):
    text: str
    score: float
    kind: int


class Model(NamedTuple):
    pieces: list[Piece]
    kind: int
    byte_fallback: bool
    rules: bytes  # compiled character map
    prefix: bool
    squeeze: bool
    escape: bool


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 127) << shift, shift + 7, at + 1
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Numbered values of a protobuf message."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _number(data, at)
        elif kind == 2:
            size, at = _number(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 5:
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind == 1:
            value, at = struct.unpack_from("<d", data, at)[0], at + 8
        else:
            raise ValueError(f"wire type {kind} is not part of a model file")
        yield tag >> 3, value


def parsed(path: str) -> Model:
    with open(path, "rb") as f:
        message = list(fields(f.read()))
    pieces = [dict(fields(v)) for k, v in message if k == 1]
    trainer = dict(fields(b"".join(v for k, v in message if k == 2)))
    normaliser = dict(fields(b"".join(v for k, v in message if k == 3)))
    return Model(
        [Piece(p[1].decode(), p.get(2, 0.0), p.get(3, NORMAL)) for p in pieces],
        trainer.get(3, UNIGRAM),
        bool(trainer.get(35, 0)),
        normaliser.get(2, b""),
        bool(normaliser.get(3, 1)),
        bool(normaliser.get(4, 1)),
        bool(normaliser.get(5, 1)),
    )


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two pieces, the best piece first."""
    ids = {p.text: i for i, p in enumerate(model.pieces) if p.kind in (NORMAL, USER)}
    found = []
    for p in model.pieces:
        if p.kind == NORMAL:
            cuts = [(p.text[:k], p.text[k:]) for k in range(1, len(p.text))]
            found += [(-p.score, ids[a], ids[b], a, b) for a, b in cuts if a in ids and b in ids]
    return [(a, b) for *_, a, b in sorted(found)]


def rebuilt(model: Model):
    """The model as a tokenizer of the tokenizers library."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers

    vocabulary = [(p.text, p.score) for p in model.pieces]
    unknown = next(i for i, p in enumerate(model.pieces) if p.kind == UNKNOWN)
    if model.kind == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram(vocabulary, unknown, model.byte_fallback))
    elif model.kind == BPE:
        ids = {text: i for i, (text, _) in enumerate(vocabulary)}
        tokenizer = Tokenizer(
            models.BPE(ids, merges(model), unk_token=vocabulary[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
        )
    else:
        raise ValueError("only unigram and BPE models have scores to rebuild")
    steps = [normalizers.Precompiled(model.rules)] if model.rules else []
    if model.squeeze:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        tokenizer.normalizer = normalizers.Sequence(steps)
    undo = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(undo + [decoders.Strip(" ", 1, 0)] * model.prefix)
    own = [AddedToken(p.text, normalized=False) for p in model.pieces if p.kind == USER]
    if own:
        tokenizer.add_tokens(own)
    return tokenizer


class Codec:
    """Encodes and decodes within one task."""

    def __init__(self, path: str, verify: bool = True):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        model = parsed(path)
        self.tokenizer = rebuilt(model)
        self.model, self.judge = model, SentencePieceProcessor(model_file=path) if verify else None
        inner = any(MARK in p.text.lstrip(MARK) for p in model.pieces if p.kind in (NORMAL, USER))
        self.cuts = not (inner or model.rules or model.squeeze) and model.prefix and model.escape
        self.bare = Tokenizer(self.tokenizer.model)  # for parts, which are marked here
        as_byte = lambda p: bytes([int(p.text[1:-1], 16)])
        self.bytes = [
            as_byte(p) if p.kind == BYTE else b"" if p.kind == CONTROL else p.text.replace(MARK, " ").encode() for p in model.pieces
        ]
        self.numbers: dict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.ids: list[bytes] = []
        self.differ: set[int] = set()

    def _learn(self, parts: list[str]) -> None:
        if self.cuts:
            found = self.bare.encode_batch_fast([MARK + p.replace(" ", MARK) for p in parts], add_special_tokens=False)
        else:
            found = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        mine = [array("I", e.ids) for e in found]
        theirs = self.judge.encode(parts, num_threads=THREADS) if self.judge else [None] * len(parts)
        for part, ids, other in zip(parts, mine, theirs):
            if other is not None and (part or not self.cuts) and ids.tolist() != other:
                self.differ.add(len(self.ids))  # a lone space, an empty part, cannot be asked for by itself
                ids = array("I", other)
            self.ids.append(ids.tobytes())

    def _parts(self, text: bytes) -> list[bytes]:
        """Parts without the space each begins with; the text has one more in front."""
        if not self.cuts:
            return [text]
        if not text:
            return []
        if b"  " in text or text[0] == 32:
            return [part[1:] for part in RUNS.findall(b" " + text)]
        return text.split(b" ")

    def encode(self, batch: list[bytes]) -> tuple[list[bytes], list[int]]:
        """Ids of each text as packed uint32, and how many of its parts differed between the libraries."""
        if len(self.ids) > MEMO:
            self.numbers.clear()
            self.ids.clear()
            self.differ.clear()
        number = self.numbers.__getitem__
        numbers = [list(map(number, self._parts(t))) for t in batch]
        new = list(islice(self.numbers, len(self.ids), None))
        for low in range(0, len(new), 1 << 14):
            self._learn([x.decode() for x in new[low : low + (1 << 14)]])
        ids = self.ids.__getitem__
        apart = [sum(n in self.differ for n in ns) for ns in numbers] if self.differ else [0] * len(batch)
        return [b"".join(map(ids, ns)) for ns in numbers], apart

    def decode(self, ids: bytes) -> bytes:
        """The bytes that packed ids stand for."""
        text = b"".join(map(self.bytes.__getitem__, array("I", ids)))
        return text[1:] if self.model.prefix and text[:1] == b" " else text


def encoded(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key, ids`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for s in texts.slices(batches):
            ids, _ = codec.encode([s.text(i) for i in range(len(s))])
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            yield pa.record_batch([s.batch.column(s.batch.schema.get_field_index(key)), lists], [key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(run, f"{key} {kind}, ids array<int>")


def decoded(rows: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key, text`` of every row of ``key, ids``; null ids give an empty text, broken UTF-8 is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path, verify=False)
        for batch in batches:
            found = [codec.decode(array("I", ids or []).tobytes()).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string())], [key, "text"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "ids").mapInArrow(run, f"{key} {kind}, text string")


def digested(docs: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """Encode and decode every text: ``n_bytes, n_ids, ids_crc32`` (of little-endian uint32), ``round_trip`` (the
    ids decode to the text) and ``n_differing`` parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for s in texts.slices(batches):
            whole = [s.text(i) for i in range(len(s))]
            ids, apart = codec.encode(whole)
            columns = [
                s.batch.column(s.batch.schema.get_field_index(key)),
                pa.array(np.diff(s.at)),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([codec.decode(x) == t for x, t in zip(ids, whole)]),
                pa.array(apart, pa.int64()),
            ]
            yield pa.record_batch(columns, [key, "n_bytes", "n_ids", "ids_crc32", "round_trip", "n_differing"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(
        run, f"{key} {kind}, n_bytes long, n_ids long, ids_crc32 long, round_trip boolean, n_differing long"
    )
