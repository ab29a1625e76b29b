"""Names, paths and lineages as column expressions (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LINEAGE_SEPARATOR = " > "
UNASSIGNED_CASE = "_unassigned"
LANDING_MARK = "/landing/"
RAW_MARK = "/raw/"
# Digits of a SHA-1 that are shown; contents are told apart by all of them.
SHOWN_DIGITS = 12


def suffix_of(name: Column) -> Column:
    """Last extension in lower case with its dot; empty for none or for a hidden file."""
    return F.regexp_extract(F.lower(name), r"[^/](\.[^./]+)/*\z", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\z", 1)


def leaf_of(lineage: Column) -> Column:
    """File name of the innermost entry."""
    innermost = F.element_at(F.split(lineage, LINEAGE_SEPARATOR), -1)
    return F.regexp_extract(innermost, r"([^/]+)/*\z", 1)


def lineage_of(*parts: Column) -> Column:
    return F.concat_ws(LINEAGE_SEPARATOR, *parts)


def content_hash(content: Column) -> Column:
    """Twelve hex digits of the SHA-1 of the bytes (UTF-8 bytes for text)."""
    return F.substring(F.sha1(content), 1, SHOWN_DIGITS)


def staged_name(lineage: Column, suffix: Column, repeat: Column | None = None) -> Column:
    """Deterministic, path-safe name.  The ordinal counts only where a container lists one
    name several times; the first occurrence keeps the plain name."""
    identity = lineage
    if repeat is not None:
        identity = F.when(repeat > 0, F.concat(lineage, F.lit("#"), repeat.cast("string"))).otherwise(lineage)
    return F.concat(F.lit("doc_"), F.substring(F.sha1(identity), 1, 16), suffix)


def case_of_path(path: Column) -> Column:
    found = F.regexp_extract(path, LANDING_MARK + "([^/]+)/", 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(UNASSIGNED_CASE))


def case_relative_name(path: Column) -> Column:
    """Path below the case's raw folder, else the base name."""
    prefix = F.concat(F.lit(LANDING_MARK), case_of_path(path), F.lit(RAW_MARK))
    at = F.position(prefix, path)
    below = F.when(at > 0, F.substr(path, at + F.length(prefix))).otherwise(path)
    return F.when(path.contains(RAW_MARK), below).otherwise(file_name(path))


def without_scheme(uri: Column) -> Column:
    bare = F.regexp_replace(uri, "^[a-zA-Z0-9]+:", "")
    return F.when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
