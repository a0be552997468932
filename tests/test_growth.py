"""Plans and steps that must not grow beyond their input."""

import math

from pyspark.sql import functions as F

from siftspark.operators import features, findings
from siftspark.plans import registry
from siftspark.session import together
from siftspark.sources import adapters


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_are_summed_and_rooted_where_their_report_lies(spark, sf_dir):
    said = plan(adapters.files(spark, sf_dir))
    assert said.count("FileScan") == 1 and said.count("Exchange") == 1 and "Join" not in said


def test_rows_of_a_task_are_bounded(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    n = spark.sparkContext.defaultParallelism
    assert together(rows, "k", 1000 * n, 10).rdd.getNumPartitions() == 100 * n
    assert together(rows, "k", 10, 10).count() == 1000


def test_listing_is_appended_without_a_join(spark):
    files = spark.createDataFrame([(1, 4, "r", "a", 9, 0), (1, 7, "r!!x", None, 9, 1), (2, 1, "s", "b", 9, 0)], "report_id long, file_id long, path string, sha256 string, risk int, depth int")
    listing = spark.createDataFrame([(1, "a", "p"), (1, "c", "q"), (1, "c", "o"), (1, None, "n"), (2, "a", "m"), (3, "z", "l")], "report_id long, sha256 string, path string")
    out = findings.append_listing(files, listing)
    new = sorted((r.report_id, r.file_id, r.path, r.sha256, r.depth) for r in out.where("risk = -1").collect())
    assert new == [(1, 8, "r!!n", None, 1), (1, 9, "r!!o", "c", 1), (2, 2, "s!!m", "a", 1)]
    assert "Join" not in plan(out)


def test_weighted_paths_read_paths_once(spark, sf_dir):
    # paths, part and the files' risks, each once
    assert plan(registry.QUERIES["features_paths"](spark, sf_dir)).count("FileScan") == 3


def test_long_rows_are_no_lists(spark):
    rows = spark.createDataFrame([(1, 2), (2, None)], "report_id long, v int")
    out = features.long(rows, {"a:x": "v", "a:y": F.col("v") > 1})
    assert "Generate" not in plan(out)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, "a:x", 2.0), (1, "a:y", 1.0), (2, "a:x", None), (2, "a:y", None)]


def test_files_tiers_need_no_ids(spark, sf_dir):
    found = adapters.findings(spark, sf_dir)
    names = ["report_id", "file_id", "n_active", "notable", "suspicious", "hostile"]
    want = sorted(map(tuple, findings.file_summary(found).select(names).collect()))
    assert sorted(map(tuple, findings.file_tiers(found).select(names).collect())) == want
    assert sorted(map(tuple, findings.file_tiers(findings.by_id(found)).select(names).collect())) == want


def test_explained_reads_findings_once(spark, sf_dir):
    assert plan(registry.QUERIES["explained"](spark, sf_dir)).count("FileScan") == 2


def test_entropy_of_short_and_long_strings(spark):
    said = ["aab", "x", "", "日本日本", "ab" * 200, "z" * 65, "-~" * 32]
    out = features.char_entropy(spark.createDataFrame([(s,) for s in [*said, "aab"]], "s string"))
    got = {r.s: r.entropy for r in out.collect()}
    assert set(got) == set(said) - {""} and "Window" not in plan(out)
    for s, h in got.items():
        assert math.isclose(h, -sum(s.count(c) / len(s) * math.log2(s.count(c) / len(s)) for c in set(s)), abs_tol=1e-12)


def test_lines_without_a_report_are_no_files(spark, sf_dir, tmp_path):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(20)
    lost = lines.withColumn("l_orderkey", F.lit(None).cast("long"))
    lines.unionByName(lost).write.parquet(f"{tmp_path}/lineitem.parquet")
    assert adapters.files(spark, str(tmp_path)).where("report_id is null").count() == 0
