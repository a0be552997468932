"""Monitoring an event stream: rates, errors, sessions, duplicates, and claims with their results.

Every function takes a batch or a streaming DataFrame with ``ts`` (timestamp),
``worker``, ``kind`` and, where named, further columns; on a stream a watermark
bounds the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _marked(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming else events


def per_minute(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Results in each minute and worker."""
    rows = _marked(events, late).where("kind = 'result'").groupBy(F.window("ts", "1 minute").alias("w"), "worker").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("minute"), "worker", "n")


def rate(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Results per second over trailing 15 minutes, by the minute."""
    rows = _marked(events, late).where("kind = 'result'").groupBy(F.window("ts", "15 minutes", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.end").alias("at"), "n", (F.col("n") / 900.0).alias("per_s"))


def errors(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Errors of trailing 15 minutes and the latest one's message."""
    rows = _marked(events, late).where("kind = 'error'").groupBy(F.window("ts", "15 minutes", "1 minute").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max_by("message", F.struct("ts", "message")).alias("last"))
    return rows.select(F.col("w.end").alias("at"), "n", "last")


def sessions(events: DataFrame, gap: str = "60 minutes", late: str = "10 minutes") -> DataFrame:
    """Spells in which a worker was heard of without a gap."""
    rows = _marked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "worker").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("worker", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def dedupe(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """First event of each key; on a stream within the watermark's memory."""
    return _marked(events, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def claim_result(claims: DataFrame, results: DataFrame, most: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """Results of a worker within ``most`` of its claim, by an interval join."""
    a = _marked(claims, late).select(F.col("worker").alias("cw"), F.col("ts").alias("claimed"), F.col("id").alias("claim_id"))
    b = _marked(results, late).select(F.col("worker").alias("rw"), F.col("ts").alias("resulted"), F.col("id").alias("result_id"))
    near = (F.col("cw") == F.col("rw")) & (F.col("resulted") >= F.col("claimed")) & (F.col("resulted") <= F.col("claimed") + F.expr(f"INTERVAL {most}"))
    return a.join(b, near).select(F.col("cw").alias("worker"), "claim_id", "result_id", "claimed", "resulted")


def queue_age(events: DataFrame, now) -> DataFrame:
    """Oldest claim without a later result, and the last result, of each worker; batch form."""
    last = events.groupBy("worker").agg(F.max(F.when(F.col("kind") == "result", F.col("ts"))).alias("last_result"))
    open_ = events.where("kind = 'claim'").join(last, "worker").where("last_result is null or ts > last_result")
    age = F.unix_timestamp(now) - F.unix_timestamp(F.min("ts"))
    return last.join(open_.groupBy("worker").agg(age.alias("oldest_s")), "worker", "left").select("worker", "last_result", "oldest_s")


def queue_ages(events: DataFrame, idle: str = "24 hours") -> DataFrame:
    """Stream form of :func:`queue_age`: after each batch the last result and the oldest open claim of the workers that it has.

    A worker's state is its last result and the times of the claims after it; a
    result drops the claims up to it. The reader takes ages against a clock of
    its own. A worker that is silent for ``idle`` is forgotten and shown once
    more, empty.
    """
    ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    worker = events.schema["worker"].dataType.simpleString()

    def row(key: tuple, last, oldest) -> pd.DataFrame:
        at = lambda x: pd.Series([x], dtype="datetime64[ns]")
        return pd.DataFrame({"worker": [key[0]], "last_result": at(last), "oldest": at(oldest)})

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield row(key, None, None)
            return
        last, claims = state.get if state.exists else (None, [])
        claims = set(claims)
        for df in batches:
            for at, kind in zip(df["ts"], df["kind"], strict=True):
                at = at.to_pydatetime()
                if kind == "claim":
                    claims.add(at)
                elif last is None or at > last:
                    last = at
        claims = {c for c in claims if last is None or c > last}
        state.update((last, sorted(claims)))
        state.setTimeoutDuration(ms)
        yield row(key, last, min(claims, default=None))

    rows = events.where("kind IN ('claim', 'result')").select("worker", "ts", "kind")
    return rows.groupBy("worker").applyInPandasWithState(update, f"worker {worker}, last_result timestamp, oldest timestamp", "last timestamp, claims array<timestamp>", "update", GroupStateTimeout.ProcessingTimeTimeout)


def split_late(batch: DataFrame, number: int, path: str, late: str = "10 minutes", ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """A micro-batch's rows that are in time, and those that fall behind the watermark of the batches before it.

    The greatest time of each batch is kept below ``path`` under its number, so
    a batch that is run again after a failure splits as it did before.
    """
    spark = batch.sparkSession
    batch.agg(F.max(ts).alias("most")).write.mode("overwrite").parquet(f"{path}/batch={number}")
    most = spark.read.parquet(path).where(F.col("batch") < number).agg(F.max("most")).first()[0]
    if most is None:
        return batch, batch.limit(0)
    behind = F.coalesce(F.col(ts) < F.lit(most).cast("timestamp") - F.expr(f"INTERVAL {late}"), F.lit(False))
    return batch.where(~behind), batch.where(behind)


def score_stream(reports: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, late: str = "10 minutes"):
    """A writer that scores whole reports as they arrive, by the job that scores stored ones.

    ``reports`` has a row for each report with its time ``ts``; ``score`` takes
    such rows, static model tables within, to decisions. Decisions go below
    ``path/verdicts``, rows behind the watermark below ``path/late``, each batch
    in a folder of its own that a repeated batch replaces.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            fresh, behind = split_late(batch, number, f"{path}/progress", late)
            behind.write.mode("overwrite").parquet(f"{path}/late/batch={number}")
            score(fresh).write.mode("overwrite").parquet(f"{path}/verdicts/batch={number}")
        finally:
            batch.unpersist()

    return reports.writeStream.foreachBatch(each).option("checkpointLocation", f"{path}/checkpoint")


def verdict_stream(reports: DataFrame, known: DataFrame, min_conf: float = 0.65) -> DataFrame:
    """Arriving reports ``(report_id, sha256, ts, findings array<struct<crit,conf>>)`` to verdicts.

    Stateless: counts are array functions of the row, the known set is a static
    side of the join.
    """
    grave = lambda c: F.size(F.filter("findings", lambda f: (f["conf"] >= min_conf) & (f["crit"] == c)))
    rows = reports.join(known.select("sha256", "label"), "sha256", "left")
    cls = F.when(F.col("label") == "bad", 2).when(F.col("label") == "good", 0).when(grave(5) >= 1, 2).when(grave(4) >= 2, 1).otherwise(0)
    return rows.select("report_id", "ts", cls.alias("class"))
