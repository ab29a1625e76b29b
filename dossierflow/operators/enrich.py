"""Summary, label and fields for each document.

Each step takes a provider, `provider(df, text_col=..., **cfg) -> df`, which adds its columns
and keeps every row.  The defaults are deterministic column expressions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dossierflow.schemas import EXTRACTED_FIELDS

PROMPT_CHARS = 6000
SUMMARY_SENTENCES = 3

# Labels, descriptions and order of the default taxonomy.
TAXONOMY_SEED = (
    ("Resolucio adjudicacio", "Resolucion que adjudica un contrato/expediente a un proveedor", 1),
    ("Notificacio adjudicatari", "Notificacion oficial al adjudicatario informando de la adjudicacion", 2),
    ("Publicacio adj - PSCP", "Anuncio o publicacion de la adjudicacion en la Plataforma de Serveis de Contractacio Publica (PSCP)", 3),
    ("Inf fiscalitza fav doc DR_adjudic", "Informe de fiscalizacion favorable, fase de adjudicacion (DR)", 4),
    ("Inf fiscalitza fav foc RD_prepar", "Informe de fiscalizacion favorable, fase de preparacion (RD)", 5),
)

# Default field patterns for procurement papers in Catalan and Spanish: (pattern, group).
FIELD_RULES = {
    "titol_document": (r"\A\s*([^\n]*[^\s])", 1),
    "numero_expedient": (r"(?i)exp(?:edient[e]?|\.)?\s*(?:n[úu]m(?:ero)?\.?|n[º°.])?\s*[:.]?\s*([A-Z0-9][A-Z0-9/_-]*[0-9])", 1),
    "data_document": (r"([0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})", 1),
    "entitat_organisme": (r"((?:Ajuntament|Ayuntamiento|Diputació|Diputación|Generalitat|Departament|Consell|Consorci)[^\n,.;]*)", 1),
    "proveidor_adjudicatari": (r"(?i)(?:adjudicat[aà]ri[oa]?|prove[ïi]dor|proveedor|contratista)\s*:\s*([^\n,;]+)", 1),
    "import": (r"([0-9][0-9.,]{0,30}\s{0,5}(?:€|EUR|euros))", 1),
    "tipus_procediment": (r"(?i)procedim(?:ent|iento)\s*:?\s+([^\n.,;]+)", 1),
}


def default_taxonomy(spark) -> DataFrame:
    rows = [(label, text, order, True) for label, text, order in TAXONOMY_SEED]
    return spark.createDataFrame(rows, "label string, description string, sort_order int, active boolean")


def active_taxonomy(taxonomy: DataFrame) -> DataFrame:
    return taxonomy.filter("active")


def prompt_text(text: Column, max_chars: int = PROMPT_CHARS) -> Column:
    """The part of a text a summary looks at."""
    return F.substring(text, 1, max_chars)


# --- summary -----------------------------------------------------------------------------


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences: cut after . ! ? before white space, and at line ends."""
    cut = F.regexp_replace(text, r"([.!?])[ \n\t]+", "$1\n")
    return F.filter(F.transform(F.split(cut, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def words(text: Column, least: int) -> Column:
    found = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(found, lambda w: F.length(w) >= least)


_NO_WORD = re.compile(r"[\W_]+")


def _most_frequent(sentences, n: int, least: int) -> str:
    """The n sentences with the highest sum of word counts, in text order; the earlier one of
    equals is taken."""
    split = [[w for w in _NO_WORD.split(s.lower()) if len(w) >= least] for s in sentences]
    overall = Counter(w for ws in split for w in ws)
    ranked = sorted(range(len(split)), key=lambda i: (-sum(overall[w] for w in split[i]), i))
    return " ".join(sentences[i] for i in sorted(ranked[:n]))


def summarize(
    docs: DataFrame,
    text_col: str = "text_blocks",
    n: int = SUMMARY_SENTENCES,
    max_chars: int = PROMPT_CHARS,
    least_word: int = 4,
) -> DataFrame:
    """Add `resum`: the n sentences whose words are most frequent in the text, in text order.

    One projection without any exchange.  Sentences of the short prompt are cut in the JVM and
    cross to Python in Arrow batches; counting words as rows instead would move every word of
    every prompt through several exchanges.
    """

    @F.pandas_udf("string")
    def pick(found: pd.Series) -> pd.Series:
        return found.map(lambda ss: _most_frequent(list(ss), n, least_word))

    return docs.withColumn("resum", pick(sentences(prompt_text(F.coalesce(F.col(text_col), F.lit("")), max_chars))))


def summarize_lead(docs: DataFrame, text_col: str = "text_blocks", n: int = SUMMARY_SENTENCES, max_chars: int = PROMPT_CHARS) -> DataFrame:
    """Add `resum`: the first n sentences.  A projection, without any exchange."""
    first = F.slice(sentences(prompt_text(F.col(text_col), max_chars)), 1, n)
    return docs.withColumn("resum", F.concat_ws(" ", first))


# --- label -------------------------------------------------------------------------------


def taxonomy_keywords(taxonomy: DataFrame, least_word: int = 4) -> DataFrame:
    """Keyword rules (label, keyword, sort_order) from the active labels and descriptions.

    A word that every label shares tells nothing and is left out."""
    active = active_taxonomy(taxonomy)
    found = active.select(
        "label",
        "sort_order",
        F.explode(
            F.array_distinct(words(F.concat_ws(" ", "label", "description"), least_word))
        ).alias("keyword"),
    )
    shared = found.groupBy("keyword").agg(F.count(F.lit(1)).alias("labels"))
    all_labels = active.agg(F.count(F.lit(1)).alias("all_labels")).scalar()
    telling = shared.filter((F.col("labels") < all_labels) | (all_labels == 1))
    return found.join(telling.select("keyword"), "keyword").select("label", "keyword", "sort_order")


def plain_words(text: Column) -> Column:
    """Lower-case words of a text, whatever stands between them."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


class Keywords:
    """Keyword rules as a hash map: first word to (further words, label numbers).  A word is looked up once, at a cost
    that does not depend on the number of keywords; of keywords with several words only those that begin with it are
    compared."""

    word = re.compile(r"[^\W_]+")

    def __init__(self, rules: list[tuple[str, str, int | None]]):
        order = lambda r: (r[1] is None, r[1] or 0, r[0] or "")
        self.labels = sorted({(label, place) for label, _, place in rules}, key=order)
        number = {label: n for n, label in enumerate(self.labels)}
        self.by_first: dict[str, dict[tuple[str, ...], set[int]]] = {}
        for label, keyword, place in rules:
            first, *rest = self.word.findall((keyword or "").lower()) or [None]
            if first:
                self.by_first.setdefault(first, {}).setdefault(tuple(rest), set()).add(number[label, place])

    def verdict(self, text: str | None) -> tuple[str | None, int, float | None]:
        """Label with most hits (ties: lower order), its hits, and their share of all."""
        words = self.word.findall(text or "")
        hits: Counter = Counter()
        for at, word in enumerate(words):
            for rest, numbers in self.by_first.get(word, {}).items():
                if not rest or tuple(words[at + 1 : at + 1 + len(rest)]) == rest:
                    hits.update(numbers)
        if not hits:
            return None, 0, None
        best = min(hits, key=lambda n: (-hits[n], n))
        return self.labels[best][0], hits[best], hits[best] / hits.total()


# A taxonomy is kept by hand; more keywords than this are refused rather than shipped to every task.
MOST_KEYWORDS = 1 << 20


def classify(docs: DataFrame, rules: DataFrame, text_col: str = "text_blocks", most: int = MOST_KEYWORDS) -> DataFrame:
    """Add `classificacio`, `score` and `confidence`; the label with most keyword hits wins, ties go to the lower
    sort order, no hit at all gives NULL.  A keyword of several words counts where they follow one another.

    The rules become one hash map, which tasks receive once: one pass over each text, and no exchange.  The function
    is not deterministic for Spark, so a later filter on the label stays above it instead of repeating the counting.
    """
    found = [tuple(r) for r in rules.select("label", "keyword", "sort_order").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} keywords")
    keywords = docs.sparkSession.sparkContext.broadcast(Keywords(found))

    @F.pandas_udf("classificacio string, score bigint, confidence double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([keywords.value.verdict(t) for t in texts], columns=["classificacio", "score", "confidence"])

    judged = docs.withColumn("_verdict", judge.asNondeterministic()(F.lower(F.col(text_col))))
    return judged.select("*", "_verdict.*").drop("_verdict")


def word_vectors(docs: DataFrame, text_col: str = "text_blocks", features: int = 1 << 16) -> DataFrame:
    """Replace the text by hashed word counts: a projection that makes rows small before they
    are joined, cached or shuffled."""
    from pyspark.ml.feature import HashingTF

    tokens = docs.withColumn("_words", plain_words(F.col(text_col))).drop(text_col)
    return HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features).transform(tokens).drop("_words")


def train_classifier(vectors: DataFrame, label_col: str):
    """TF-IDF weights and logistic regression on word vectors with a known label."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, StringIndexer

    stages = [
        IDF(inputCol="_counts", outputCol="_features"),
        StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc"),
        LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol="_prediction",
                           probabilityCol="_probability", maxIter=20, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(vectors)


def classify_trained(vectors: DataFrame, model) -> DataFrame:
    """Add `classificacio` and `confidence` from a trained model; scoring is one projection."""
    from pyspark.ml.functions import vector_to_array

    weights, indexer, regression = model.stages
    labels = F.array(*[F.lit(x) for x in indexer.labels])
    return (
        regression.transform(weights.transform(vectors))
        .withColumns(
            {
                "classificacio": F.get(labels, F.col("_prediction").cast("int")),
                "confidence": F.array_max(vector_to_array("_probability")),
            }
        )
        .drop("_counts", "_features", "_prediction", "_probability", "rawPrediction")
    )


# What a text looks like, whatever it says.
SHAPES = (
    "log_words", "word_length", "longest_word", "distinct_words", "distinct_pairs", "letters", "upper", "digits", "marks", "symbols",
    "log_lines", "line_length", "distinct_lines", "sentence_words", "vowels", "short_words",
)


def text_shapes(docs: DataFrame, text_col: str = "text_blocks") -> DataFrame:
    """Replace the text by its shape, `SHAPES` as an array of numbers: shares, mean lengths and how much is repeated.
    A projection of built-in functions."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in docs.columns if c != text_col]
    cut = docs.select(*rest, text.alias("_text"), F.array_remove(F.split(text, r"\s+"), "").alias("_words"), F.array_remove(F.split(text, "\n"), "").alias("_lines"))
    chars, words, lines = (F.greatest(x, F.lit(1)).cast("double") for x in (F.length("_text"), F.size("_words"), F.size("_lines")))
    share = lambda pattern: F.length(F.regexp_replace("_text", f"[^{pattern}]", "")) / chars
    lengths = F.transform("_words", lambda w: F.length(w))
    pairs = F.transform("_words", lambda w, i: F.concat_ws(" ", w, F.get(F.col("_words"), i + 1)))
    shapes = {
        "log_words": F.log1p(F.size("_words")),
        "word_length": F.length(F.array_join("_words", "")) / words,
        "longest_word": F.log1p(F.coalesce(F.array_max(lengths), F.lit(0))),
        "distinct_words": F.size(F.array_distinct("_words")) / words,
        "distinct_pairs": F.size(F.array_distinct(pairs)) / words,
        "letters": share(r"\p{L}"),
        "upper": share(r"\p{Lu}"),
        "digits": share("0-9"),
        "marks": share(".,;:!?"),
        "symbols": share("#*$%&|<>{}@_=+~^"),
        "log_lines": F.log1p(F.size("_lines")),
        "line_length": F.log1p(chars / lines),
        "distinct_lines": F.size(F.array_distinct("_lines")) / lines,
        "sentence_words": F.log1p(words / (F.length(F.regexp_replace("_text", "[^.!?]", "")) + 1)),
        "vowels": share("aeiouAEIOUáéíóúàèòïüöä"),
        "short_words": F.size(F.filter("_words", lambda w: F.length(w) <= 3)) / words,
    }
    return cut.select(*rest, F.array(*(shapes[n].cast("double") for n in SHAPES)).alias("_shapes"))


def train_shapes(shapes: DataFrame, label_col: str, trees: int = 80, depth: int = 8, seed: int = 7):
    """A forest on text shapes.  Each class weighs the same in all, however few rows it has."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector

    known = shapes.filter(F.col(label_col).isNotNull())
    sizes = known.groupBy(label_col).agg(F.count(F.lit(1)).alias("_rows"))
    weighted = known.join(sizes, label_col).select(
        label_col, array_to_vector("_shapes").alias("_features"), (F.lit(1.0) / F.col("_rows")).alias("_weight")
    )
    total = sizes.agg(F.sum("_rows") / F.count(F.lit(1))).first()[0]
    weighted = weighted.withColumn("_weight", F.col("_weight") * total)
    indexer = StringIndexer(inputCol=label_col, outputCol="_label", stringOrderType="alphabetAsc").fit(weighted)
    forest = RandomForestClassifier(
        featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="_prediction", probabilityCol="_probability",
        numTrees=trees, maxDepth=depth, minInstancesPerNode=2, seed=seed,
    )
    return indexer.labels, forest.fit(indexer.transform(weighted))


def classify_shapes(docs: DataFrame, rules: DataFrame | None = None, text_col: str = "text_blocks", model=None) -> DataFrame:
    """Add `classificacio` and `confidence` from a forest (`train_shapes`); scoring is one projection."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    names, forest = model
    shapes = docs if "_shapes" in docs.columns else text_shapes(docs.withColumn("_kept", F.col(text_col)), text_col).withColumnRenamed("_kept", text_col)
    scored = forest.transform(shapes.withColumn("_features", array_to_vector("_shapes")))
    labels = F.array(*[F.lit(x) for x in names])
    return scored.withColumns(
        {"classificacio": F.get(labels, F.col("_prediction").cast("int")), "confidence": F.array_max(vector_to_array("_probability"))}
    ).drop("_shapes", "_features", "_prediction", "_probability", "rawPrediction")


# --- fields ------------------------------------------------------------------------------


def extract_fields(docs: DataFrame, text_col: str = "text_blocks", rules: Mapping[str, tuple[str, int]] | None = None) -> DataFrame:
    """Add `extracted`, a struct of seven strings; empty when the text does not say.

    The struct is built in one projection; later reads of its fields do not repeat the work."""
    rules = FIELD_RULES if rules is None else rules
    fields = [
        F.trim(F.regexp_extract(F.col(text_col), *rules[name])).alias(name) if name in rules else F.lit("").alias(name)
        for name in EXTRACTED_FIELDS
    ]
    return docs.withColumn("extracted", F.struct(*fields))


def flatten_fields(docs: DataFrame) -> DataFrame:
    """The extracted strings as columns, named as the state tables name them."""
    names = {"numero_expedient": "num_expedient", "import": "import_"}
    return docs.withColumns({names.get(f, f): F.col(f"extracted.`{f}`") for f in EXTRACTED_FIELDS})


# --- providers ---------------------------------------------------------------------------

Provider = Callable[..., DataFrame]
PROVIDERS: dict[str, dict[str, Provider]] = {
    "summary": {"frequency": summarize, "lead": summarize_lead},
    "label": {"keywords": classify, "trained": classify_shapes},
    "fields": {"patterns": extract_fields},
}


def register_provider(step: str, name: str, provider: Provider) -> None:
    PROVIDERS[step][name] = provider


def enrich(docs: DataFrame, rules: DataFrame, summary: str = "frequency", label: str = "keywords", fields: str = "patterns", **cfg) -> DataFrame:
    """All three steps; per-step settings come as `summary_cfg`, `label_cfg`, `fields_cfg`."""
    docs = PROVIDERS["label"][label](docs, rules, **cfg.get("label_cfg", {}))
    docs = PROVIDERS["fields"][fields](docs, **cfg.get("fields_cfg", {}))
    return PROVIDERS["summary"][summary](docs, **cfg.get("summary_cfg", {}))


def stamp(enriched: DataFrame, model: str = "ai_functions", prompt_version: str = "v2.0", source: str = "AUTO") -> DataFrame:
    """Where a classification came from."""
    return enriched.withColumns(
        {"model": F.lit(model), "prompt_version": F.lit(prompt_version), "source": F.lit(source)}
    )
