"""From documents to packed token sequences: language ID, line dedup, near-dedup, decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsphere.llm import decontamination, language, line_dedup, near_dedup, packing
from glyphsphere.llm.common import bound_batches, materialize

#: Documents whose n-grams fit no language better than this (0 to 1) are rejected, as are those without a letter. Of 10,000
#: documents, 1 % score under 0.53 and two under 0.4: one word over and over, and a fragment in capitals.
LEAST_LANGUAGE_SCORE = 0.4


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled ones teach; a missing ``lang`` is filled with what was found.

    Null texts, empty ones and texts without a letter go. Repeated rows go or stay alike. Where no document has a
    language, none can be told and all go. Empty table: no rows.
    """
    bound_batches(spark)
    found = language.identify(docs, language.learn(docs))
    found = found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("lang_score") >= LEAST_LANGUAGE_SCORE))
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that occur earlier; ``n_chars``, if there is one, follows. Null texts, repeated
    rows and the empty table stay as they are."""
    bound_batches(spark)
    out = line_dedup.deduplicated(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the smallest doc_id; of repeated rows one. Null texts all stay."""
    bound_batches(spark)
    return near_dedup.deduplicated(docs).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null texts and rows without an id stay; repeated ids go or stay together."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens; null texts are one end id. Empty table: no rows."""
    bound_batches(spark)
    return packing.pieces(docs)


STAGES = [
    ("language_id", identified),
    ("line_dedup", without_repeated_lines),
    ("near_dedup", one_of_each),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: Language profiles and registers of a sketch can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
