"""Per-document and per-case scalar rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Content types by extension.
CONTENT_TYPES = {
    "pdf": "application/pdf",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "tif": "image/tiff",
    "tiff": "image/tiff",
    "txt": "text/plain; charset=utf-8",
    "csv": "text/csv",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
DEFAULT_CONTENT_TYPE = "application/octet-stream"
# Extensions a browser shows inline.
PREVIEW_EXTENSIONS = ("pdf", "png", "jpg", "jpeg", "gif", "tif", "tiff", "txt")
# Accepted case ids.
CASE_ID_PATTERN = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,62}\z"

# Labelled parts of the additional-information column, in order.
INFO_PARTS = (
    ("numero_expedient", "Núm. expedient: "),
    ("data_document", "Data: "),
    ("entitat_organisme", "Entitat: "),
    ("proveidor_adjudicatari", "Proveïdor/Adjudicatari: "),
    ("import", "Import: "),
    ("tipus_procediment", "Tipus procediment: "),
)


def empty_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def document_id(case_id: Column, key: Column) -> Column:
    return F.concat_ws(":", case_id, key)


def extension_of(name: Column) -> Column:
    """Extension without the dot; empty when the name has none."""
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)\z", 1))


def content_type(staged: Column, original: Column, stored: Column | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    extension = F.coalesce(empty_to_null(extension_of(staged)), empty_to_null(extension_of(original)), F.lit(""))
    choices = [F.try_element_at(table, extension)]
    if stored is not None:
        choices.append(stored)
    return F.coalesce(*choices, F.lit(DEFAULT_CONTENT_TYPE))


def previewable(name: Column, status: Column) -> Column:
    known = F.coalesce(extension_of(name).isin(*PREVIEW_EXTENSIONS), F.lit(False))
    return known & (status != "ERROR")


def tree_label(title: Column, original: Column, doc_id: Column) -> Column:
    return F.coalesce(title, original, doc_id)


def card_label(title: Column, original: Column, doc_id: Column) -> Column:
    return F.coalesce(original, title, doc_id)


def valid_case_id(case_id: Column) -> Column:
    return F.coalesce(case_id.rlike(CASE_ID_PATTERN), F.lit(False))


def safe_file_name(name: Column) -> Column:
    """Slashes become underscores, leading dots go; NULL when nothing is left."""
    flat = F.regexp_replace(name, r"[/\\]", "_")
    return empty_to_null(F.regexp_replace(flat, r"^\.+", ""))


def title_or_name(title: Column, original: Column) -> Column:
    return F.coalesce(empty_to_null(title), original)


def additional_info(field) -> Column:
    """Labelled, non-empty parts joined by a bar.  `field` maps a field name to its column."""
    parts = [F.concat(F.lit(label), empty_to_null(field(name))) for name, label in INFO_PARTS]
    return F.concat_ws(" | ", *parts)


def payload(**values: Column) -> Column:
    """A JSON object; NULL members stay as ``null``."""
    if not values:
        return F.lit("{}")
    return F.to_json(F.struct(*[v.alias(k) for k, v in values.items()]), {"ignoreNullFields": "false"})
