"""The registered query of each operator, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftspark.llm import align, backoff, decontam, langid, linedup, neargraph, pieces, quality, sharding, simhash, tokenfile, turns, urlrules
from siftspark.session import table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op1_sentencepiece(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op2_simhash(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op3_language_id(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neargraph.op4_embedding_dedup(table(spark, sf_dir, "embeddings"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op5_sharding(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.op6_lm_scoring(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op7_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.op8_token_files(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.op9_line_dedup(table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.op10_url_filters(table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.op11_conversation_repair(table(spark, sf_dir, "conversations"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op12_quality_rules(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.op13_token_alignment(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_simhash, op3_language_id, op4_embedding_dedup, op5_sharding, op6_lm_scoring, op7_decontamination, op8_token_files, op9_line_dedup, op10_url_filters, op11_conversation_repair, op12_quality_rules, op13_token_alignment)}
ORACLES = {"op7_decontamination": decontam.OP7_SQL, "op9_line_dedup": linedup.OP9_SQL, "op10_url_filters": urlrules.OP10_SQL, "op11_conversation_repair": turns.OP11_SQL, "op12_quality_rules": quality.OP12_SQL}
