"""The result table and its display form."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dossierflow.functions import rules
from dossierflow.schemas import EXTRACTED_FIELDS

# Result columns and their display headers, in order.
HEADERS = {
    "ruta_del_fitxer": "Ruta del fitxer",
    "nom_del_fitxer": "Nom del fitxer",
    "titol": "Títol",
    "resum": "Resum",
    "classificacio": "Classificació",
    "informacio_addicional_proposta": "Informació addicional (proposta)",
    "num_expedient": "Núm. expedient",
    "data_document": "Data document",
    "entitat_organisme": "Entitat / organisme",
    "proveidor_adjudicatari": "Proveïdor / adjudicatari",
    "import_": "Import",
    "tipus_procediment": "Tipus de procediment",
}
WIDTH_MARGIN = 2
WIDTH_LIMIT = 60


def result_table(enriched: DataFrame) -> DataFrame:
    """The 12 result columns; raw fields stay as extracted, empty ones included."""
    field = {f: F.col(f"extracted.`{f}`") for f in EXTRACTED_FIELDS}
    return enriched.select(
        F.col("lineage").alias("ruta_del_fitxer"),
        F.col("original_filename").alias("nom_del_fitxer"),
        rules.title_or_name(field["titol_document"], F.col("original_filename")).alias("titol"),
        "resum",
        "classificacio",
        rules.additional_info(field.__getitem__).alias("informacio_addicional_proposta"),
        field["numero_expedient"].alias("num_expedient"),
        field["data_document"].alias("data_document"),
        field["entitat_organisme"].alias("entitat_organisme"),
        field["proveidor_adjudicatari"].alias("proveidor_adjudicatari"),
        field["import"].alias("import_"),
        field["tipus_procediment"].alias("tipus_procediment"),
    )


def sorted_result(result: DataFrame) -> DataFrame:
    return result.orderBy("nom_del_fitxer", "ruta_del_fitxer")


def display_columns(result: DataFrame) -> DataFrame:
    """Display headers in fixed order, for the columns that are there."""
    return result.select(*[F.col(c).alias(h) for c, h in HEADERS.items() if c in result.columns])


def column_widths(display: DataFrame) -> DataFrame:
    """Width per display column from one pass over the table: longest text or header, plus a
    margin, up to a limit."""
    names = display.columns
    longest = display.agg(
        *[F.max(F.length(F.col(f"`{c}`"))).cast("bigint").alias(f"c{i}") for i, c in enumerate(names)]
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("col"), F.col(f"c{i}").alias("longest"), F.lit(len(c)).alias("header")) for i, c in enumerate(names)]
    )
    one = longest.select(F.explode(pairs).alias("w")).select("w.*")
    # A column without any value shows as a four-letter word for "nothing", never wider than a header.
    width = F.least(F.greatest(F.coalesce("longest", F.lit(0)), "header") + WIDTH_MARGIN, F.lit(WIDTH_LIMIT))
    return one.select("col", width.cast("bigint").alias("width"))
