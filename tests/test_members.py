"""Reports with more members than a run of the reference would score: none of them is left out."""

import duckdb
import pytest
from pyspark.sql import functions as F

from siftspark.operators import jobs, verdicts
from siftspark.plans import registry

TABLES = ("lineitem", "part")


@pytest.fixture(scope="module")
def wide_dir(spark, sf_dir, tmp_path_factory):
    """Every line is a file, and those of the first 300 orders are files of one report."""
    out = tmp_path_factory.mktemp("wide")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_orderkey <= 1000")
    lines = lines.withColumn("l_suppkey", F.col("l_orderkey") * 10 + F.col("l_linenumber")).withColumn("l_orderkey", F.greatest("l_orderkey", F.lit(300)).cast("long"))
    lines.write.parquet(f"{out}/lineitem.parquet")
    spark.read.parquet(f"{sf_dir}/part.parquet").write.parquet(f"{out}/part.parquet")
    return str(out)


@pytest.mark.parametrize("name", ["envelope_files", "worst_members", "elevated_verdicts"])
def test_all_members_have_verdicts(spark, wide_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{wide_dir}/{t}.parquet/*.parquet'")
    df = registry.QUERIES[name](spark, wide_dir)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_the_last_of_many_members_raises_its_report(spark):
    files = spark.range(251).select(F.lit(1).cast("long").alias("report_id"), F.col("id").alias("file_id"), F.when(F.col("id") == 0, 0).otherwise(1).alias("depth"), F.lit("elf").alias("file_type"), F.lit("f").alias("path"))
    findings = spark.createDataFrame([(1, 250, "objectives/x::r", 5, 0.9)], "report_id long, file_id long, id string, crit int, conf double")
    members = jobs.member_verdicts(files, findings)
    assert members.count() == 250
    own = spark.createDataFrame([(1, 0, 0.1, -1)], "report_id long, class int, prob double, level int")
    final, _ = jobs.rollup(own, files, findings, members)
    assert [(r["class"], r.from_member) for r in final.collect()] == [(2, 250)]
    # a caller who has a budget says so
    assert jobs.member_verdicts(files, findings, limit=100).count() == 100 and verdicts.first_members(files, 3).count() == 3
