"""Queries of the operators over the documents tables, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsphere.llm import decontamination, fingerprints, language, licenses, line_dedup, near_dedup, packing, quality, substring_dedup, token_files


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    profiles = language.learn(docs.filter(_crc_mod(4) != 2))
    found = language.identify(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", (_crc_mod(4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_and_next(_table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(_table(spark, sf_dir, "documents"), keep=["doc_id"]).drop("spans")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    trees = quality.learn(docs, _table(spark, sf_dir, "labels").filter(_crc_mod(5) != 0))
    found = quality.scored(docs.select("doc_id", "text"), trees).withColumnRenamed("quality_score", "score")
    return found.select("doc_id", (_crc_mod(5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(_table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op5_licenses": licenses.duckdb_sql(), "op9_decontamination": OP9}


OP9 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
l AS (SELECT item_id, w, least(len(w), 5) AS n FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS s FROM l),
ds AS (SELECT DISTINCT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS s FROM d, (SELECT DISTINCT n FROM l) WHERE len(w) >= n),
m AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY item_id),
f AS (SELECT doc_id, item_id, count(*) AS n_found FROM ds JOIN bs USING (n, s) GROUP BY ALL)
SELECT doc_id, item_id, n_shingles, n_found, round(n_found / n_shingles, 6) AS containment
FROM f JOIN m USING (item_id) WHERE n_found >= 0.8 * n_shingles - 1e-9
"""
