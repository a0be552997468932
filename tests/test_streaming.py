"""Stream forms against the batch forms on the same events."""

from pyspark.sql import functions as F

from siftspark.plans.audit_queries import events
from siftspark.streaming import monitor


def streamed(spark, sf_dir, tmp_path, make, mode, name):
    spark.read.parquet(f"{sf_dir}/events.parquet").write.parquet(str(tmp_path / "in"))
    kind = "CASE event_type WHEN 'signup' THEN 'claim' WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'error' ELSE 'heartbeat' END AS kind"
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).selectExpr("event_id AS id", "CAST(ts AS TIMESTAMP) AS ts", "user_id AS worker", kind, "props AS message")
    q = make(rows).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    return sorted(tuple(r) for r in spark.table(name).collect())


def batch(spark, sf_dir, make):
    return sorted(tuple(r) for r in make(events(spark, sf_dir)).collect())


def test_rate(spark, sf_dir, tmp_path):
    assert streamed(spark, sf_dir, tmp_path, monitor.rate, "complete", "rate") == batch(spark, sf_dir, monitor.rate)


def test_sessions(spark, sf_dir, tmp_path):
    assert streamed(spark, sf_dir, tmp_path, monitor.sessions, "complete", "sessions") == batch(spark, sf_dir, monitor.sessions)


def test_minutes_close_behind_the_watermark(spark, sf_dir, tmp_path):
    got, want = streamed(spark, sf_dir, tmp_path, monitor.per_minute, "append", "minutes"), batch(spark, sf_dir, monitor.per_minute)
    assert set(got) <= set(want) and len(want) - len(got) <= 5


def test_claims(spark, sf_dir, tmp_path):
    make = lambda e: monitor.claim_result(e.where("kind = 'claim'"), e.where("kind = 'result'"))
    assert streamed(spark, sf_dir, tmp_path, make, "append", "claims") == batch(spark, sf_dir, make)


def test_dedupe(spark, sf_dir, tmp_path):
    got = streamed(spark, sf_dir, tmp_path, lambda e: monitor.dedupe(e.select("ts", "id"), ["id"]), "append", "dedupe")
    assert len(got) == events(spark, sf_dir).select("id").distinct().count()


def test_verdict_stream(spark):
    rows = [(1, "a", [(5, 0.9)]), (2, "b", [(4, 0.9), (4, 0.7)]), (3, "c", [(5, 0.5)]), (4, "d", [(5, 0.9)]), (5, "e", [])]
    reports = spark.createDataFrame(rows, "report_id int, sha256 string, findings array<struct<crit:int,conf:double>>").withColumn("ts", F.current_timestamp())
    known = spark.createDataFrame([("d", "good"), ("e", "bad")], "sha256 string, label string")
    assert {r.report_id: r["class"] for r in monitor.verdict_stream(reports, known).collect()} == {1: 2, 2: 1, 3: 0, 4: 0, 5: 2}
