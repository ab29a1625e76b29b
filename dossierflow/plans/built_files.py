"""Real container and office files made from table rows inside the job, to be opened again."""

from __future__ import annotations

import base64
import io
import re
import zipfile
import zlib
from email.message import EmailMessage
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_EPOCH = (1980, 1, 1, 0, 0, 0)
_SLICE_ROWS = 64


def archive(members: list[tuple[str, bytes]]) -> bytes:
    """A zip whose bytes depend on names and contents only."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name, _EPOCH), data, zipfile.ZIP_DEFLATED, compresslevel=1)
    return out.getvalue()


def mail(subject: str, body: str, attachments: list[tuple[str, bytes]] = ()) -> bytes:
    if not attachments and subject and re.fullmatch("[A-Za-z0-9]{1,60}", subject):  # as below, without the general writer
        lines = b"\n".join(body.encode().splitlines()) + b"\n"
        head = f'Subject: {subject}\nFrom: sender@example.com\nContent-Type: text/plain; charset="utf-8"\nContent-Transfer-Encoding: base64\nMIME-Version: 1.0\n\n'
        return head.encode() + base64.encodebytes(lines)
    m = EmailMessage()
    m["Subject"] = subject
    m["From"] = "sender@example.com"
    m.set_content(body)
    for name, data in attachments:
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return m.as_bytes()


def workbook(sheet: str, rows: list[list[str]], typed: list[tuple[str, str]] = ()) -> bytes:
    """One sheet of inline strings, after a row of `typed` cells (attributes, stored value).  Style 1 shows a date."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    first = "".join(f"<c {attributes}><v>{escape(value)}</v></c>" for attributes, value in typed)
    cells = (f"<row>{first}</row>" if first else "") + "".join(
        "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(v)}</t></is></c>' for v in row) + "</row>"
        for row in rows
    )
    return archive(
        [
            ("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name={quoteattr(sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>'.encode()),
            ("xl/_rels/workbook.xml.rels", f'<Relationships><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>'.encode()),
            ("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>'.encode()),
            ("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>'.encode()),
        ]
    )


def docx(paragraphs: list[str]) -> bytes:
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in paragraphs)
    return archive([("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>'.encode())])


def pptx(paragraphs: list[str]) -> bytes:
    ns = "http://schemas.openxmlformats.org/drawingml/2006/main"
    body = "".join(f"<a:p><a:r><a:t>{escape(p)}</a:t></a:r></a:p>" for p in paragraphs)
    return archive([("ppt/slides/slide1.xml", f'<s xmlns:a="{ns}">{body}</s>'.encode())])


def pdf(lines: list[str]) -> bytes:
    escaped = (l.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)") for l in lines)
    shown = "".join(f"BT ({l}) Tj ET\n" for l in escaped).encode("cp1252", "replace")
    packed = zlib.compress(shown)
    return b"%PDF-1.4\n1 0 obj\n<< /Length " + str(len(packed)).encode() + b" /Filter /FlateDecode >>\nstream\n" + packed + b"\nendstream\nendobj\n%%EOF"


def _with_made(batches, kept: list[str], make):
    """Made from a few rows at a time, so that a task never holds the files of a whole batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, _SLICE_ROWS):
            b = batch.slice(at, _SLICE_ROWS)
            made = pa.array([make(r) for r in b.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), made], names=[*kept, "content"])


def _map_content(df: DataFrame, make) -> DataFrame:
    """Replace (lang, text) by `content` = make(row); one row in, one row out."""
    kept = [c for c in df.columns if c not in ("lang", "text")]
    schema = df.select(*kept, F.lit(b"").alias("content")).schema

    return df.mapInArrow(lambda batches: _with_made(batches, kept, make), schema)


def _one_archive(r) -> bytes:
    text = r["text"].encode()
    lines = [[l] for l in r["text"].split("\n") if l]
    chars = len(r["text"])
    cells = [("", str(chars)), ('s="1"', str(45292 + chars % 1000)), ('t="b"', "1")]  # a number, a day of 2024 or later, a truth
    return archive(
        [
            (f"texts/{r['stem']}.pdf", text),
            ("inner.zip", archive([("copy.pdf", text), ("notes.txt", b"not staged")])),
            ("mail.eml", mail(r["lang"], r["text"])),
            ("sheet.xlsx", workbook(r["lang"], lines, cells)),
        ]
    )


def archives(documents: DataFrame) -> DataFrame:
    """Per document one landed archive: the text as a file, a nested archive with a copy and an
    unsupported file, a mail and a spreadsheet."""
    stem = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    rows = documents.select(
        F.col("source").alias("case_id"), F.concat(stem, F.lit(".zip")).alias("source_path"), stem.alias("stem"), "lang", "text"
    )
    return _map_content(rows, _one_archive).drop("stem")


def _landed_member(r) -> tuple[str, bytes]:
    """One member: by the document's number a nested archive, an archive that does not open, a mail, or the text
    itself under a name that is staged, parsed or skipped."""
    name, text = f"{r['lang']}/d{r['doc_id']}{r['suffix']}", r["text"].encode()
    if r["doc_id"] % 8 == 2:
        return name, archive([("copy.pdf", text), ("notes.txt", b"not staged")])
    return name, mail(r["lang"], r["text"]) if r["suffix"] == ".eml" else text


def delivery(documents: DataFrame, archives: int, parts: int) -> DataFrame:
    """(part, path, content): the documents as `archives` archives in each of `parts` deliveries, by their number."""
    names = F.create_map(*[F.lit(x) for k, v in LANDED_SUFFIXES.items() for x in (k, v)])
    sfx = F.coalesce(F.try_element_at(names, (F.col("doc_id") % 8).cast("int")), F.lit(".pdf"))
    at = F.col("doc_id") % F.lit(archives * parts)
    rows = documents.select("doc_id", "lang", "text", sfx.alias("suffix"), at.alias("archive"))

    def pack(rows: pa.Table) -> pa.Table:
        members = sorted(rows.to_pylist(), key=lambda r: r["doc_id"])
        number = members[0]["archive"]
        path = f"case{number % 7}/raw/a{number:05d}.zip"
        return pa.table({"part": [number // archives], "path": [path], "content": [archive([_landed_member(m) for m in members])]})

    return rows.groupBy("archive").applyInArrow(pack, "part bigint, path string, content binary")


# Suffixes by document number modulo 8; the others are page files.
LANDED_SUFFIXES = {1: ".docx", 2: ".zip", 3: ".jpg", 4: ".csv", 5: ".eml", 7: ".zip"}

_MAKERS = {".docx": docx, ".pptx": pptx, ".pdf": pdf}


def office_files(documents: DataFrame) -> DataFrame:
    """Per document one text document, slide deck or page file with a paragraph per line; some are broken."""
    kind = F.col("doc_id") % 3
    sfx = F.when(kind == 0, ".docx").when(kind == 1, ".pptx").otherwise(".pdf")
    rows = documents.select("doc_id", F.col("source").alias("case_id"), sfx.alias("suffix"), "lang", "text")
    broken = lambda r: r["doc_id"] % 7 == 0 and r["suffix"] != ".pdf"
    made = _map_content(rows, lambda r: b"broken" if broken(r) else _MAKERS[r["suffix"]](r["text"].split("\n")))
    return made.withColumnRenamed("content", "data")
