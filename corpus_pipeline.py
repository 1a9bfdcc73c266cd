"""From raw documents to packed sequences: five stages over the operators of polyatlas.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyatlas.llm import langid, linedup, packing, simhash, substring
from polyatlas.llm.store import last_written, materialize, table, unused

#: Columns that the judgement of languages adds.
RESULTS = ("lang_pred", "score", "noise")


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where there is such a column, of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: null and letterless texts go, and those that the network takes for noise with ``langid.REJECT`` or more.

    A doubtful choice between languages is no reason: mixed and short texts are
    clean too. Without any label there is no network, and lettered texts stay.
    """
    model = langid.fit(docs)
    renamed = docs.withColumnsRenamed(dict(zip(RESULTS, unused(docs.columns, *RESULTS), strict=True)))
    if model is None:
        return docs.where(F.col("text").cast("string").rlike(r"\p{L}"))
    judged = langid.identify(renamed, model, *renamed.columns)
    kept = judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("noise") < langid.REJECT))
    return kept.select(*(F.col(own).alias(c) for own, c in zip(renamed.columns, docs.columns, strict=True)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeats of lines that many sources share."""
    return _measured(linedup.line_dedup(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of near copies."""
    return simhash.near_deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without long word sequences that occur elsewhere too."""
    return _measured(substring.substring_dedup(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bin and place of every piece of every document."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The stages learn models and search graphs; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next, its own intermediate tables deleted after it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with last_written(spark):
            docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
