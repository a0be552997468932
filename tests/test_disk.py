"""What jobs leave on disk while they run."""

import os

from pyspark.sql import functions as F

from siftspark.operators import features, findings, jobs
from siftspark.plans import feature_queries
from siftspark.session import stored_by, stored_rows


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffled(spark):
    """Shuffle files of the session."""
    top = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for d in top for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_written_steps_leave_no_shuffles(spark):
    before = shuffled(spark)
    out = stored_rows(spark.range(10_000).repartition(5, "id").groupBy((F.col("id") % 7).alias("k")).count())
    by = stored_by(out, "k", 3)
    assert not shuffled(spark) - before and by.count() == 7


def test_buckets_are_not_shuffled_again(spark):
    key = F.struct((F.col("id") % 50).alias("report_id"), (F.col("id") % 2 == 0).alias("member")).alias("report_id")
    rows = spark.range(1000).select(key, (F.col("id") % 9).alias("file_id"), F.when(F.col("id") > 3, F.col("id")).alias("v"))
    a, b = stored_by(rows, "report_id", 3), stored_by(rows.where("v > 500"), "report_id", 3)
    assert sorted(map(str, a.collect())) == sorted(map(str, rows.collect()))
    for made in (a.groupBy("report_id", "file_id").agg(F.max("v")), a.join(b.hint("merge"), "report_id")):
        assert "Exchange" not in plan(made)
    plain = stored_by(rows, "report_id", None)
    assert "Exchange" in plan(plain.groupBy("report_id").count()) and plain.count() == 1000


def test_families_lay_reports_together_once(spark, sf_dir):
    t = feature_queries.report_tables(spark, sf_dir)
    ids = stored_by(findings.by_id(t.findings, dealt=True), "report_id", t.buckets, dealt=True)
    for made in (findings.report_paths(ids), findings.file_summary(ids), features.attack_codes(t.findings)):
        assert "Exchange" not in plan(made)


def test_run_keeps_its_buckets(spark, monkeypatch, sf_dir):
    seen = []
    monkeypatch.setattr(jobs, "stored_by", lambda rows, key, n, dealt=False, most=0: seen.append((n, plan(rows).count("hashpartitioning") if dealt and set(rows.columns) >= {"path", "max_crit"} else 0)) or stored_by(rows, key, n, dealt))
    from siftspark.plans import job_queries

    job_queries.job_member_verdicts(spark, sf_dir)
    assert len(seen) > 10 and all(n and not again for n, again in seen)
