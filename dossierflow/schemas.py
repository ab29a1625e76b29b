"""Schemas of every dataset the library reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "binary": T.BinaryType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "array<int>": T.ArrayType(T.IntegerType()),
}


def _struct(spec: str) -> T.StructType:
    """Column list to schema without a session, as tasks import this module too."""
    columns = [c.split() for c in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns])


# What Spark's binaryFile source yields; given explicitly so a stream can start on an empty folder.
LANDED_FILE = _struct("path string, modificationTime timestamp, length bigint, content binary")

# One row per leaf found in a landed file.  `entry_path` is the position at every container
# level, so (source_path, entry_path) sorts like a depth-first walk.
ENTRY = _struct(
    "case_id string, source_path string, entry_path array<int>, lineage string, repeat int, "
    "suffix string, content_hash string, content_sha1 string, data binary, text string, reason string"
)

MANIFEST = _struct(
    "case_id string, source_path string, entry_path array<int>, lineage string, "
    "original_filename string, suffix string, content_hash string, content_sha1 string, kind string, "
    "staged_name string, duplicate_of string, reason string"
)

# The exchange form of a manifest; fields that a kind does not have are NULL.
MANIFEST_JSON = _struct(
    "lineage string, kind string, staged_name string, original_filename string, "
    "duplicate_of string, reason string"
)

ELEMENT = _struct("type string, content string")
PARSED = T.StructType(
    [
        T.StructField("elements", T.ArrayType(ELEMENT)),
        T.StructField("error_status", T.StringType()),
    ]
)

# Fields read out of a document; all strings, dates and amounts included.
EXTRACTED_FIELDS = (
    "titol_document",
    "numero_expedient",
    "data_document",
    "entitat_organisme",
    "proveidor_adjudicatari",
    "import",
    "tipus_procediment",
)

TAXONOMY = _struct("label string, description string, sort_order int, active boolean")

CASES = _struct(
    "case_id string, title string, description string, owner string, status string, "
    "docs_total bigint, docs_classified bigint, docs_error bigint, created_at timestamp, "
    "updated_at timestamp, closed_at timestamp, last_run_id bigint"
)

DOCUMENTS = _struct(
    "doc_id string, case_id string, content_hash string, original_filename string, "
    "original_lineage string, staged_kind string, staged_name string, status string, "
    "error_message string, created_at timestamp, updated_at timestamp"
)

_VALUES = (
    "titol string, resum string, classificacio string, confidence double, num_expedient string, "
    "data_document string, entitat_organisme string, proveidor_adjudicatari string, import_ string, "
    "tipus_procediment string, model string, prompt_version string, source string, "
    "correction_instruction string"
)
CLASSIFICATIONS = _struct(f"doc_id string, case_id string, {_VALUES}, created_at timestamp")
HISTORY = _struct(
    f"history_id string, doc_id string, case_id string, {_VALUES}, archived_at timestamp"
)
VALUE_COLUMNS = tuple(_struct(_VALUES).fieldNames())

EVENTS = _struct(
    "event_id string, case_id string, doc_id string, user string, type string, "
    "payload_json string, ts timestamp"
)

STATE_TABLES = {
    "taxonomy_categories": TAXONOMY,
    "cases": CASES,
    "documents": DOCUMENTS,
    "classifications": CLASSIFICATIONS,
    "classification_history": HISTORY,
    "events": EVENTS,
}

# Allowed states.
CASE_STATUSES = ("DRAFT", "PROCESSING", "READY", "NEEDS_REVIEW", "CLOSED")
DOCUMENT_STATUSES = ("LANDED", "STAGED", "PARSED", "CLASSIFIED", "ERROR")
CLASSIFICATION_SOURCES = ("AUTO", "CORRECTED")
