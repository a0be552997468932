"""The driver's tables read as report tables.

Each derivation uses integer arithmetic, rounding and string operations only, so
that any engine gets the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.session import table, table_rows, together

#: File types by number, one of them unknown.
FILE_TYPES = ("elf", "pe", "macho", "python", "javascript", "shell", "zip", "tar", "pdf", "docx", "png", "json", "apk", "mystery")


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, file_id, pos, id, crit 1..5, conf, atk, mbc: one row for each line item."""
    rows = table(spark, sf_dir, "lineitem").join(table_rows(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    top = "CASE WHEN l_partkey % 17 = 0 THEN 'third_party' WHEN l_returnflag = 'A' THEN 'objectives' WHEN l_returnflag = 'R' THEN 'well-known' ELSE 'micro-behaviors' END"
    return rows.selectExpr(
        "l_orderkey AS report_id", "l_suppkey AS file_id", "l_linenumber AS pos",
        f"concat({top}, '/', lower(p_type), '/', lower(replace(p_brand, '#', '-')), '/k', l_partkey % 5, '::r', l_linenumber) AS id",
        "CAST(floor((l_quantity - 1) / 10) AS INT) + 1 AS crit", "round(0.5 + 5 * l_discount, 2) AS conf",
        "CASE WHEN l_linestatus = 'F' THEN concat('T1', lpad(l_partkey % 40, 3, '0')) END AS atk",
        "CASE WHEN l_linestatus = 'O' THEN concat('B0', lpad(l_suppkey % 25, 3, '0')) END AS mbc",
        "l_partkey AS tie",
    )


def content_hash() -> Column:
    """The hash of a file's content, by which it is known: of its ids, so that a stored table need not have it."""
    return F.sha2(F.concat("report_id", F.lit("/"), "file_id"), 256)


def lines(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the table that findings and files come from, by the files' footers."""
    return table(spark, sf_dir, "lineitem").count()


def files(spark: SparkSession, sf_dir: str, n_parts: int | None = None) -> DataFrame:
    """report_id, file_id, file_type, size_bytes, depth, parent_id, path, sha256, risk, three metrics and mtime in seconds; ``n_parts``: in how many parts reports are dealt."""
    types = F.array(*map(F.lit, FILE_TYPES))
    rows = table(spark, sf_dir, "lineitem")
    # a line without a report is no file; said here, so that all who read files ask for the same rows and one shuffle serves them
    rows = rows.where("l_orderkey is not null").withColumnsRenamed({"l_orderkey": "report_id", "l_suppkey": "file_id"})
    # rows of a report are laid together once: they are nearly one a file, so that summing before the shuffle would only fill hash tables, and the root is found where they lie
    rows = rows.repartition(n_parts, "report_id") if n_parts else together(rows, "report_id", lines(spark, sf_dir))
    rows = rows.groupBy("report_id", "file_id").agg(
        F.expr("CAST(floor(round(sum(l_extendedprice), 2)) AS BIGINT)").alias("size_bytes"),
        F.expr("max(CAST(floor((l_quantity - 1) / 10) AS INT) + 1) * 10").alias("risk"),
        F.expr("round(avg(l_tax) * 100, 4)").alias("entropy"), F.count(F.lit(1)).alias("functions"), F.sum("l_linenumber").alias("total_lines"),
        F.expr("86400L * datediff(max(l_shipdate), DATE'1970-01-01')").alias("mtime"),
    )
    rows = rows.withColumn("root_id", F.min("file_id").over(Window.partitionBy("report_id"))).withColumn("file_type", F.get(types, (F.col("file_id") % len(FILE_TYPES)).cast("int")))
    root_type = F.get(types, (F.col("root_id") % len(FILE_TYPES)).cast("int"))
    root = F.concat(F.lit("o"), "report_id", F.lit("."), root_type)
    is_root = F.col("file_id") == F.col("root_id")
    return rows.select(
        "report_id", "file_id", "file_type", "size_bytes", F.when(is_root, 0).otherwise(1 + F.col("file_id") % 2).cast("int").alias("depth"),
        F.when(~is_root, F.col("root_id")).alias("parent_id"), F.when(is_root, root).otherwise(F.concat(root, F.lit("!!f"), "file_id", F.lit("."), "file_type")).alias("path"),
        content_hash().alias("sha256"), "risk", "entropy", "functions", "total_lines", "mtime",
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """purl, sha256, label: a pool of known parts, some of them on both sides."""
    return table(spark, sf_dir, "part").selectExpr("concat('pkg:npm/', lower(replace(p_brand, '#', '-')), '-', p_partkey % 97, '@', p_size, '.0.', p_partkey % 10) AS purl", "sha2(p_name, 256) AS sha256", "CASE WHEN p_partkey % 7 = 0 THEN 'bad' ELSE 'good' END AS label")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, file_id, pos, kind, locator, is_declared: references of files to packages."""
    rows = table(spark, sf_dir, "lineitem").join(table_rows(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.selectExpr(
        "l_orderkey AS report_id", "l_suppkey AS file_id", "l_linenumber AS pos",
        "CASE l_returnflag WHEN 'A' THEN 'url' WHEN 'R' THEN 'command' ELSE 'dependency' END AS kind",
        "lower(replace(p_brand, '#', '-')) AS package", "concat(p_size, '.', l_linenumber, '.', l_suppkey % 10) AS version",
        "concat('pkg:npm/', lower(replace(p_brand, '#', '-')), CASE WHEN l_partkey % 9 = 0 THEN '' ELSE concat('@', p_size, '.', l_linenumber, '.', l_suppkey % 10) END) AS locator",
        "l_partkey AS part_id", "CAST(floor(l_extendedprice) AS BIGINT) AS bytes",
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, file_type, raw: a sigmoid of a fixed sum over an embedding's first components."""
    raw = "round(1 / (1 + exp(-4 * (double(embedding[0]) + embedding[1] - embedding[2]))), 6)"
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS id", "CASE WHEN label % 3 = 0 THEN 'elf' WHEN label % 3 = 1 THEN 'python' ELSE 'mystery' END AS file_type", f"CAST({raw} AS DOUBLE) AS raw", "round(1 / (1 + exp(-3 * (double(embedding[3]) - embedding[4]))), 6) AS raw2", "label")
