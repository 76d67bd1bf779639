"""A training corpus from the documents table: language ID, near-dedup, decontamination, secret removal and packing.

Each stage takes (spark, docs, sf_dir) and returns documents, the last one the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from takeoff.llm import decontamination, language, packing, secrets, similar
from takeoff.llm.common import documents, staged

#: Texts without a letter are rejected, and those whose best language has a lower probability than this.
MIN_LANGUAGE_SCORE = 0.35


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language. Nothing but text decides; if no row has a language to learn from, only letters count."""
    model = language.trained(docs)
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    if not model.languages:
        return rows.where(F.coalesce(F.col("_row.text").rlike(r"\p{L}"), F.lit(False))).select("_row.*")
    told = language.identified(rows, model, ("_row",), "_row.text")
    return told.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("_row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links join: SimHash fingerprints within 2 bits, and shared bands of min-hashes, both
    judged by the similarity of five-word shingles, 0.8 or more."""
    return similar.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words, or the whole, of a benchmark item."""
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    found = decontamination.contamination(rows, documents(spark, sf_dir, "benchmark"), ("_row",), text="_row.text")
    return found.where(~F.col("contaminated")).select("_row.*")


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and replaces the secrets in its text; n_chars follows the text."""
    out = secrets.redacted(docs, "source" if "source" in docs.columns else None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.packed(docs)


STAGES = [
    ("language_id", known_language),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", remove_secrets),
    ("packing", pack),
]

#: Hashing, fitted models and tokenisation aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's documents are a table in the shared folder."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
