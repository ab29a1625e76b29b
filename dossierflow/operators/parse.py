"""Binary documents to text.  A format without a provider gives an error status and no elements."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dossierflow.schemas import PARSED

_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def _docx(data: bytes) -> list[tuple[str, str]]:
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        body = ElementTree.fromstring(package.read("word/document.xml"))
    found = []
    for paragraph in body.iter(f"{_WORD}p"):
        style = paragraph.find(f"{_WORD}pPr/{_WORD}pStyle")
        name = style.get(f"{_WORD}val", "") if style is not None else ""
        kind = "title" if name.startswith(("Title", "Heading")) else "text"
        found.append((kind, "".join(t.text or "" for t in paragraph.iter(f"{_WORD}t"))))
    return found


def _pptx(data: bytes) -> list[tuple[str, str]]:
    found = []
    with zipfile.ZipFile(io.BytesIO(data)) as package:
        slides = [(int(m[1]), m[0]) for m in map(re.compile(r"ppt/slides/slide(\d+)\.xml").fullmatch, package.namelist()) if m]
        for _, name in sorted(slides):
            for paragraph in ElementTree.fromstring(package.read(name)).iter(f"{_DRAW}p"):
                found.append(("text", "".join(t.text or "" for t in paragraph.iter(f"{_DRAW}t"))))
    return found


_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)(?=endobj|\Z)", re.S)
_STREAM = re.compile(rb"^\s*<<(.*)>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_PIECE = rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>"
_SHOWN = re.compile(
    rb"/([^\s/\[\]()<>]+)\s+[-+.\d]+\s+Tf\b|\[((?:" + _PIECE + rb"|[^\]()<>])*)\]\s*TJ|(" + _PIECE + rb")\s*(?:Tj|'|\")", re.S
)
_ITEM = re.compile(rb"(" + _PIECE + rb")|([-+]?[\d.]+)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b""}
_FONT_NAMES = re.compile(rb"/([^\s/\[\]()<>]+)\s+(\d+)\s+\d+\s+R")
_MAPPED = re.compile(rb"begin(bfchar|bfrange)(.*?)endbf", re.S)
_CODE = re.compile(rb"<([0-9A-Fa-f\s]*)>|(\[)|(\])")
# Thousandths of the font size that a gap inside a shown line must reach to count as a blank.
_BLANK = 200


def _unescape(raw: bytes) -> bytes:
    def one(m):
        token = m[1]
        return bytes([int(token, 8) & 255]) if token[:1].isdigit() else _ESCAPED.get(token, token)

    return _ESCAPE.sub(one, raw)


def _hex(digits: bytes) -> bytes:
    digits = b"".join(digits.split())
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def _text_of(code: bytes) -> str:
    return code.decode("utf-16-be", "replace")


def _unicode_map(body: bytes) -> dict[bytes, str]:
    """Character codes to text, from a font's ToUnicode stream."""
    found: dict[bytes, str] = {}
    for kind, entries in _MAPPED.findall(body):
        codes, listed = [], None
        for digits, opens, closes in _CODE.findall(entries):
            if opens:
                listed = []
            elif closes:
                codes.append(listed)
                listed = None
            elif listed is not None:
                listed.append(_hex(digits))
            else:
                codes.append(_hex(digits))
        if kind == b"bfchar":
            found.update((src, _text_of(dst)) for src, dst in zip(codes[::2], codes[1::2]))
            continue
        for low, high, dst in zip(codes[::3], codes[1::3], codes[2::3]):
            for i in range(int.from_bytes(high, "big") - int.from_bytes(low, "big") + 1):
                src = (int.from_bytes(low, "big") + i).to_bytes(len(low), "big")
                if isinstance(dst, list):
                    found[src] = _text_of(dst[i]) if i < len(dst) else ""
                else:
                    found[src] = _text_of(dst[:-2] + (int.from_bytes(dst[-2:], "big") + i).to_bytes(2, "big"))
    return found


def _decoded(raw: bytes, codes: dict[bytes, str] | None) -> str:
    if not codes:
        return raw.decode("cp1252", "replace")
    n = len(next(iter(codes)))
    return "".join(codes.get(raw[i : i + n], "") for i in range(0, len(raw), n))


def _string(piece: bytes) -> bytes:
    return _hex(piece[1:-1]) if piece[:1] == b"<" else _unescape(piece[1:-1])


def _pdf(data: bytes) -> list[tuple[str, str]]:
    """Text-showing operators of plain and deflated content streams.  Strings are literal or hex; a font's
    ToUnicode map is used where it has one.  A stream that does not inflate is left out, unless none does."""
    streams, fonts, names, broken = {}, {}, {}, None
    for number, body in _OBJECT.findall(data):
        m = _STREAM.match(body)
        if m and b"/Image" not in m[1]:
            try:
                streams[number] = zlib.decompressobj().decompress(m[2]) if b"FlateDecode" in m[1] else m[2]
            except zlib.error as e:
                broken = e
        head = m[1] if m else body
        if found := re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", head):
            fonts[number] = found[1]
        for group in re.findall(rb"/Font\s*<<(.*?)>>", head, re.S):
            names.update(_FONT_NAMES.findall(group))
    if broken is not None and not streams:
        raise broken
    maps = {name: _unicode_map(streams[fonts[font]]) for name, font in names.items() if fonts.get(font) in streams}
    found = []
    for number, stream in streams.items():
        if number in fonts.values():
            continue
        codes = None
        for font, many, single in _SHOWN.findall(stream):
            if font:
                codes = maps.get(font)
                continue
            text = ""
            for piece, gap in _ITEM.findall(many or single):
                if piece:
                    text += _decoded(_string(piece), codes)
                elif -float(gap) >= _BLANK and not text.endswith(" "):
                    text += " "
            found.append(("text", text))
    return found


class _Blocks(HTMLParser):
    kinds = {"title": "title", "h1": "heading", "h2": "heading", "h3": "heading", "p": "text",
             "li": "list", "td": "cell", "th": "cell", "pre": "text"}
    hidden = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.kind, self.text, self.skip = [], "text", [], 0

    def flush(self):
        text = " ".join("".join(self.text).split())
        if text:
            self.found.append((self.kind, text))
        self.kind, self.text = "text", []

    def handle_starttag(self, tag, attrs):
        if tag in self.hidden:
            self.skip += 1
        elif tag in self.kinds:
            self.flush()
            self.kind = self.kinds[tag]

    def handle_endtag(self, tag):
        if tag in self.hidden:
            self.skip = max(0, self.skip - 1)
        elif tag in self.kinds:
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def _html(data: bytes) -> list[tuple[str, str]]:
    reader = _Blocks()
    reader.feed(data.decode("utf-8", "replace"))
    reader.close()
    reader.flush()
    return reader.found


# Rows that are objects at one time.
_SLICE_ROWS = 32

PROVIDERS = {".docx": _docx, ".pptx": _pptx, ".pdf": _pdf, ".html": _html}


def _parse_one(data: bytes | None, sfx: str) -> dict:
    provider = PROVIDERS.get(sfx)
    if provider is None or data is None:
        return {"elements": None, "error_status": f"unsupported-format:{sfx or 'none'}"}
    try:
        found = provider(bytes(data))
    except Exception as e:
        return {"elements": None, "error_status": f"unreadable:{type(e).__name__}"}
    return {"elements": [{"type": k, "content": c} for k, c in found], "error_status": None}


def _parsed_slices(data: pa.Array, sfx: pa.Array) -> Iterator[pa.Array]:
    made = to_arrow_type(PARSED)
    for at in range(0, max(1, len(data)), _SLICE_ROWS):
        rows = zip(data.slice(at, _SLICE_ROWS), sfx.slice(at, _SLICE_ROWS))
        yield pa.array([_parse_one(d.as_py(), s.as_py()) for d, s in rows], made)


def parse_document(content: Column, suffix: Column) -> Column:
    """Parsed document as a struct.  Bytes without a provider never leave the JVM.

    A batch is parsed in slices of a few rows, which become Arrow before the next; so a task holds the objects of one
    slice, and of a batch only the buffers."""

    @F.arrow_udf(PARSED)
    def parse(data: pa.Array, sfx: pa.Array) -> pa.Array:
        return pa.concat_arrays(_parsed_slices(data, sfx))

    readable = F.when(suffix.isin(*PROVIDERS), content)
    return parse(readable, suffix)


def text_blocks(parsed: Column) -> Column:
    """Element contents, one per line; missing contents are left out, no elements give ''."""
    return F.concat_ws("\n", F.transform(parsed["elements"], lambda e: e["content"]))


def variant_text_blocks(parsed: Column) -> Column:
    """The same for a parser answer held as VARIANT (`document.elements[].content`)."""
    elements = F.try_variant_get(parsed, "$.document.elements", "array<variant>")
    return F.concat_ws(
        "\n", F.transform(elements, lambda e: F.try_variant_get(e, "$.content", "string"))
    )


def variant_error(parsed: Column) -> Column:
    return F.try_variant_get(parsed, "$.error_status", "string")


def parse_documents(binaries: DataFrame) -> DataFrame:
    """Rows with `data` and `suffix` to rows with `text_blocks` and `parse_error`."""
    rest = [c for c in binaries.columns if c != "data"]
    parsed = binaries.withColumn("parsed", parse_document(F.col("data"), F.col("suffix")))
    return parsed.select(
        *rest,
        text_blocks(F.col("parsed")).alias("text_blocks"),
        F.col("parsed.error_status").alias("parse_error"),
    )
