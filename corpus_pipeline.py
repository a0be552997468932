"""The corpus pipeline: five operators of siftspark.llm in turn over ``documents``.

Each stage works on all that its predecessor kept, written as Parquet and read
again. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.llm import decontam, langid, linedup, pieces, simhash
from siftspark.session import shared_dir, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; null and letterless texts are rejected."""
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.keep_known(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line are taken out.

    A document that thereby loses its last word goes; a line of blanks is never a match.
    """
    out = linedup.dedup_lines(docs, removed="removed_lines")
    word = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    return out.where(word | (F.size("removed_lines") == 0)).withColumn("n_chars", F.length("text").cast("long")).drop("removed_lines")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of ``benchmark``."""
    return decontam.drop_leaked(docs, table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with a sampled segmentation of their texts, checked to decode to the text."""
    return pieces.encode(docs, lossless="lossless")


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("sentencepiece", sentencepiece)]

#: Hashed n-gram models, fingerprints and sampled pieces cannot be written in DuckDB's SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
