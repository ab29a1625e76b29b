"""Summary, label and fields on small Catalan texts, and both ways to score keywords."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from dossierflow.operators import enrich

RESOLUTION = (
    "Resolució d'adjudicació\nExpedient núm. AG-2024/17\nData: 12/03/2024\n"
    "Ajuntament de Vic, àrea de contractació.\nAdjudicatari: Obres Nord SL\n"
    "Import: 12.500,00 €\nProcediment: obert simplificat.\n"
    "Resolucion que adjudica el contrato al proveedor."
)


def docs(spark, *texts):
    return spark.createDataFrame([("c", f"d{i}", t) for i, t in enumerate(texts)], "case_id string, staged_name string, text_blocks string")


def test_default_field_patterns(spark):
    got = enrich.extract_fields(docs(spark, RESOLUTION)).select("extracted.*").first().asDict()
    assert got == {
        "titol_document": "Resolució d'adjudicació",
        "numero_expedient": "AG-2024/17",
        "data_document": "12/03/2024",
        "entitat_organisme": "Ajuntament de Vic",
        "proveidor_adjudicatari": "Obres Nord SL",
        "import": "12.500,00 €",
        "tipus_procediment": "obert simplificat",
    }
    empty = enrich.extract_fields(docs(spark, "res")).select("extracted.*").first().asDict()
    assert {k: v for k, v in empty.items() if k != "titol_document"} == dict.fromkeys(list(empty)[1:], "")


def test_default_taxonomy(spark):
    rules = enrich.taxonomy_keywords(enrich.default_taxonomy(spark))
    texts = (RESOLUTION, "Notificacion oficial informando al adjudicatario", "Informe, fase de preparacion (RD)", "zzz")
    got = enrich.classify(docs(spark, *texts), rules).orderBy("staged_name").collect()
    assert [r["classificacio"] for r in got] == [
        "Resolucio adjudicacio", "Notificacio adjudicatari", "Inf fiscalitza fav foc RD_prepar", None,
    ]
    assert got[3]["confidence"] is None and 0 < got[0]["confidence"] <= 1


def test_inactive_labels_are_not_used(spark):
    taxonomy = enrich.default_taxonomy(spark).withColumn("active", F.col("sort_order") > 1)
    assert "Resolucio adjudicacio" not in {r["label"] for r in enrich.taxonomy_keywords(taxonomy).collect()}


def test_joined_scores_equal_inline_scores(spark):
    rules = spark.createDataFrame(
        [("A", "u", 1), ("A", "dos", 1), ("B", "dos", 2), ("C", "tres", 3)], "label string, keyword string, sort_order int"
    )
    texts = docs(spark, "u u u dos", "dos, dos.", "tres", "", "altres", "Tres\nTRES u")
    columns = ["staged_name", "classificacio", "score", "confidence"]
    inline = enrich.classify(texts, rules).select(*columns)
    assert enrich.classify(texts, rules.limit(0)).filter("score = 0 and classificacio is null").count() == 6
    assert {r["staged_name"]: (r["classificacio"], r["score"]) for r in inline.collect()} == {
        "d0": ("A", 4), "d1": ("A", 2), "d2": ("C", 1), "d3": (None, 0), "d4": (None, 0), "d5": ("C", 2),
    }


def test_keywords_of_several_words(spark):
    rules = spark.createDataFrame(
        [("A", "acta de reunio", 1), ("A", "acta", 1), ("B", "de reunio", 2), ("B", "Acta-de-Reunio", 2), ("C", " . ", 3), ("D", "fi", None), ("D", "fi", None)],
        "label string, keyword string, sort_order int",
    )
    texts = docs(spark, "Acta de reunio. ACTA, de: reunio!", "acta de", "de reunio, acta", "reunio fi", None)
    got = {r["staged_name"]: (r["classificacio"], r["score"], r["confidence"]) for r in enrich.classify(texts, rules).collect()}
    assert got == {"d0": ("A", 4, 0.5), "d1": ("A", 1, 1.0), "d2": ("A", 1, 0.5), "d3": ("D", 1, 1.0), "d4": (None, 0, None)}


def test_many_keywords(spark):
    """A taxonomy of 60,000 keywords against counting in plain Python."""
    rules = spark.range(60000).selectExpr("concat('label', id % 700) as label", "concat('k', id) as keyword", "cast(id % 700 as int) as sort_order")
    texts = [" ".join(f"k{(i * j * 7919) % 90000}" for j in range(1, 60)) for i in range(1, 40)]
    got = {r["staged_name"]: (r["classificacio"], r["score"]) for r in enrich.classify(docs(spark, *texts), rules).collect()}
    for i, text in enumerate(texts):
        hits = Counter(int(w[1:]) % 700 for w in text.split() if int(w[1:]) < 60000)
        best = min(hits, key=lambda n: (-hits[n], n), default=None)
        assert got[f"d{i}"] == ((f"label{best}", hits[best]) if hits else (None, 0))


def test_summary_takes_the_densest_sentences_in_order(spark):
    text = "Res. El contracte parla d'obres. Un apunt. Les obres del contracte segueixen. Obres i contracte acaben! Fi"
    got = enrich.summarize(docs(spark, text, "", "\n \n")).orderBy("staged_name").collect()
    assert got[0]["resum"] == "El contracte parla d'obres. Les obres del contracte segueixen. Obres i contracte acaben!"
    assert [r["resum"] for r in got[1:]] == ["", ""]


def test_summary_sees_only_the_prompt(spark):
    got = enrich.summarize(docs(spark, "curt. " + "x" * 6000 + ". lluny lluny lluny lluny."), max_chars=6000).first()
    assert "lluny" not in got["resum"]


def test_providers_can_be_added(spark):
    enrich.register_provider("summary", "upper", lambda d: d.withColumn("resum", F.upper("text_blocks")))
    rules = enrich.taxonomy_keywords(enrich.default_taxonomy(spark))
    row = enrich.enrich(docs(spark, "hola"), rules, summary="upper").first()
    assert row["resum"] == "HOLA" and row["extracted"]["titol_document"] == "hola"
    with pytest.raises(KeyError):
        enrich.enrich(docs(spark, "hola"), rules, summary="none")
