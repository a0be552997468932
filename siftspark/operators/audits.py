"""Run summaries, latency, batches, diffs, parity and operating tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.session import cut

MIB, GIB = 1 << 20, 1 << 30


def summary(verdicts: DataFrame) -> DataFrame:
    """Counts by class, errors apart (class null), and the exit code."""
    c = F.col("class")
    rows = verdicts.agg(F.count_if(c == 2).alias("hostile"), F.count_if(c == 1).alias("suspicious"), F.count_if(c == 0).alias("benign"), F.count_if(c.isNull()).alias("errors"), F.count(c).alias("total"))
    return rows.withColumn("exit_code", F.when(F.col("hostile") > 0, 1).when(F.col("suspicious") > 0, 2).when(F.col("errors") > 0, 3).otherwise(0))


def size_class(size: Column) -> Column:
    return F.when(size < MIB, "small").when(size < 32 * MIB, "medium").otherwise("large")


def latency(jobs: DataFrame, of: str = "ms") -> DataFrame:
    """Count, floored mean, nearest-rank percentiles and maximum of milliseconds, by size class and for ``all``.

    Values are counted first, so ranks run over distinct values and never over jobs.
    """
    each = jobs.groupBy(size_class(F.col("size")).alias("size_class"), F.col(of).alias("ms")).agg(F.count(F.lit(1)).alias("k"))
    rows = each.unionByName(each.groupBy("ms").agg(F.sum("k").alias("k")).withColumn("size_class", F.lit("all")))
    order = Window.partitionBy("size_class").orderBy("ms").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("k").over(order)).withColumn("n", F.sum("k").over(Window.partitionBy("size_class")))
    rank = lambda share: F.min(F.when(F.col("upto") >= F.ceil(F.lit(share) * F.col("n") - 1e-9), F.col("ms")))
    return rows.groupBy("size_class").agg(
        F.max("n").alias("n"), F.expr("CAST(sum(ms * k) div max(n) AS BIGINT)").alias("mean"), rank(0.5).alias("p50"), rank(0.95).alias("p95"), rank(0.99).alias("p99"), F.max("ms").alias("most"),
    )


def show(rows: DataFrame, classes: tuple[int, ...] | None = None) -> DataFrame:
    """Rows of the classes that are asked for, with failed ones (null class) always; None, as for machines, keeps all."""
    return rows if classes is None else rows.where(F.col("class").isin(*classes) | F.col("class").isNull())


def throughput(jobs: DataFrame) -> DataFrame:
    wall = (F.unix_timestamp(F.max("resulted")) - F.unix_timestamp(F.min("claimed"))).cast("double")
    return jobs.agg(F.count("resulted").alias("done"), wall.alias("wall_s")).withColumn("per_s", F.col("done") / F.greatest("wall_s", F.lit(1.0)))


def match_results(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """The k-th result of a content goes to its k-th job, whatever their times; see :func:`match_open`."""
    k = lambda t: F.row_number().over(Window.partitionBy("sha").orderBy(t, "id"))
    a = jobs.withColumn("k", k("claimed")).select("sha", "k", F.col("id").alias("job_id"), "claimed")
    b = results.withColumn("k", k("resulted")).select("sha", "k", F.col("id").alias("result_id"), "resulted")
    return a.join(b, ["sha", "k"], "left").drop("k")


def match_open(claims: DataFrame, results: DataFrame) -> DataFrame:
    """Each result goes to the first open claim of its content: ``(sha, claim_id, result_id, claimed, resulted)`` of those that have one.

    ``claims (sha, id, claimed)``, ``results (sha, id, resulted)``. As with
    brackets, a result that finds no claim open before it matches nothing; a
    claim goes before a result of the same time. The running counts of a
    content are summed by ranges of the sorted events and then over the ranges,
    so one frequent content is no task of its own.
    """
    n = max(int(claims.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    both = claims.select("sha", F.col("claimed").alias("at"), F.lit(0).alias("kind"), "id").unionByName(results.select("sha", F.col("resulted").alias("at"), F.lit(1).alias("kind"), "id"))
    order = ["sha", "at", "kind", "id"]
    rows = cut(both.where("at is not null").repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    here = Window.partitionBy("sha", "part").orderBy("at", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"c": F.sum((F.col("kind") == 0).cast("long")).over(here), "r": F.sum((F.col("kind") == 1).cast("long")).over(here)})
    rows = rows.withColumn("low", F.min(F.col("c") - F.col("r")).over(here))
    parts = rows.groupBy("sha", "part").agg(F.max("c").alias("pc"), F.max("r").alias("pr"), F.min(F.col("c") - F.col("r")).alias("pl"))
    before = Window.partitionBy("sha").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns({"bc": F.coalesce(F.sum("pc").over(before), F.lit(0)), "br": F.coalesce(F.sum("pr").over(before), F.lit(0))})
    parts = parts.withColumn("bl", F.coalesce(F.min(F.col("bc") - F.col("br") + F.col("pl")).over(before), F.lit(0)))
    rows = rows.join(parts.select("sha", "part", "bc", "br", "bl"), ["sha", "part"])
    floor = F.least(F.lit(0), F.col("bl"), F.col("bc") - F.col("br") + F.col("low"))
    # below the floor so far a result finds nothing open
    last = F.lag(floor).over(Window.partitionBy("sha", "part").orderBy("at", "kind", "id"))
    rows = rows.withColumns({"floor": floor, "was": F.coalesce(last, F.least(F.lit(0), F.col("bl")))})
    open_ = rows.where("kind = 0").select("sha", (F.col("bc") + F.col("c")).alias("k"), F.col("id").alias("claim_id"), F.col("at").alias("claimed"))
    done = rows.where("kind = 1 and floor = was").select("sha", (F.col("br") + F.col("r") + F.col("floor")).alias("k"), F.col("id").alias("result_id"), F.col("at").alias("resulted"))
    return open_.join(done, ["sha", "k"]).drop("k")


def _numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``__n``, the row's number from 0 in the given order: ranges are sorted apart and offset by what lies before them."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()))
    rows = rows.withColumn("__p", F.shiftright("__m", 33)).withColumn("__i", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__k")).select("__p", F.coalesce(F.sum("__k").over(before), F.lit(0)).alias("__o"))  # a row for each range
    return rows.join(F.broadcast(offsets), "__p").withColumn("__n", F.col("__o") + F.col("__i")).drop("__m", "__p", "__i", "__o")


def _tiles(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """Add ``batch``, 1 to ``n``: equal runs in the given order, the first ones one row longer."""
    rows = _numbered(df, *order)
    total = rows.agg(F.count(F.lit(1))).scalar()
    small, more, k = F.floor(total / n), total % n, F.col("__n")
    edge = more * (small + 1)
    batch = F.when(k < edge, F.floor(k / (small + 1))).otherwise(more + F.floor((k - edge) / F.greatest(small, F.lit(1))))
    return rows.withColumn("batch", (batch + 1).cast("int")).drop("__n")


def batches(jobs: DataFrame, how: str, n: int) -> DataFrame:
    """Add ``batch``, 1 to ``n``: fifo, big_first, small_first, shuffle, or mixed, in which each batch has its share of every size."""
    key = {"fifo": [F.col("id")], "big_first": [F.desc("size"), F.col("id")], "small_first": [F.col("size"), F.col("id")], "shuffle": [F.xxhash64(F.lit(42), "id"), F.col("id")]}
    if how != "mixed":
        return _tiles(jobs, n, *key[how])
    rows = _numbered(jobs.withColumn("size_class", size_class(F.col("size"))), F.col("size_class"), F.col("id"))
    sizes = rows.groupBy("size_class").agg(F.count(F.lit(1)).alias("__k"), F.min("__n").alias("__first"))  # three classes
    rows = rows.join(F.broadcast(sizes), "size_class").withColumn("at", (2 * (F.col("__n") - F.col("__first")) + 1) / (2 * F.col("__k")))
    return _tiles(rows.drop("__n", "__k", "__first"), n, F.col("at"), F.col("id")).drop("at", "size_class")


def est_bytes(kind: Column, size: Column) -> Column:
    """Memory estimate: archives 64 times their size plus 1.5 GiB, within 1.5 to 10 GiB; others 512 MiB."""
    archive = F.least(F.lit(10 * GIB), F.greatest(F.lit(3 * GIB // 2), 64 * size + 3 * GIB // 2))
    return F.when(kind.isin("zip", "tar", "apk"), archive).otherwise(512 * MIB).cast("long")


def validate_benign(verdicts: DataFrame, members: DataFrame) -> DataFrame:
    """False positives on a benign corpus: a file counts by its worst class, members included."""
    worst = verdicts.select("report_id", "class").unionByName(members.select("report_id", "class")).groupBy("report_id").agg(F.max("class").alias("class"))
    c = F.col("class")
    return worst.agg(F.count_if(c == 2).alias("hostile_fp"), F.count_if(c == 1).alias("suspicious_fp"), F.count_if(c == 0).alias("passed"))


def fingerprint(verdicts: DataFrame, members: DataFrame) -> DataFrame:
    """Hash of a report's level and its members' levels in order; null and missing levels differ."""
    level = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    lists = members.groupBy("report_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_id", "level"))), lambda m: F.concat(m["file_id"], F.lit(":"), level(m["level"]))), ",").alias("m"))
    rows = verdicts.join(lists, "report_id", "left")
    return rows.select("report_id", F.sha2(F.concat(level(F.col("level")), F.lit("|"), F.coalesce("m", F.lit(""))), 256).alias("fp"))


def diff_runs(a: DataFrame, b: DataFrame) -> DataFrame:
    """Reports added, removed or changed between two runs' fingerprints."""
    rows = a.withColumnRenamed("fp", "old").join(b.withColumnRenamed("fp", "new"), "report_id", "full")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return rows.withColumn("change", change).where("change is not null").select("report_id", "change")


def parity(a: DataFrame, b: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """By feature family: cells that differ, and cells that are not zero in either run; missing cells are 0."""
    rows = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), ["report_id", "name"], "full").na.fill(0.0, ["x", "y"])
    family = F.split_part("name", F.lit(":"), F.lit(1)).alias("family")
    return rows.groupBy(family).agg(F.count_if(F.abs(F.col("x") - F.col("y")) > tolerance).alias("diverging"), F.count_if((F.col("x") != 0) | (F.col("y") != 0)).alias("nonzero"))


def best_runs(runs: DataFrame) -> DataFrame:
    """The run of least wall time of each dataset and label."""
    best = runs.groupBy("dataset", "label").agg(F.min_by(F.struct("wall", "rss", "run"), F.struct("wall", "run")).alias("b"))
    return best.select("dataset", "label", "b.wall", "b.rss", "b.run")


def goal(runs: DataFrame, a: str, b: str, most: float = 1.05) -> DataFrame:
    """Ratio of the latest run of label ``a`` to the latest of ``b`` by dataset, and whether it is within the goal."""
    last = lambda x: F.max_by(F.when(F.col("label") == x, F.col("wall")), F.when(F.col("label") == x, F.col("run")))
    return runs.groupBy("dataset").agg((last(a) / last(b)).alias("ratio")).withColumn("ok", F.col("ratio") <= most)


def reuse(inputs: DataFrame, store: DataFrame, version: str) -> tuple[DataFrame, DataFrame]:
    """Inputs with a stored result of the same content and version, and those to be worked on."""
    here = store.where(F.col("version") == version).select("sha256", "result").dropDuplicates(["sha256"])
    return inputs.join(here, "sha256"), inputs.join(here, "sha256", "left_anti")


def level_report(scored: DataFrame, levels: DataFrame) -> DataFrame:
    """Precision and recall if everything fired at or below each level: ``scored (level, bad)``, level -1 never fires.

    Counts are made by level first; the running sums go over the levels only.
    """
    by = scored.where("level >= 0").groupBy("level").agg(F.count_if("bad").alias("tp"), F.count_if(~F.col("bad")).alias("fp"))
    bad = scored.agg(F.count_if("bad")).scalar()
    order = Window.orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    rows = levels.join(by, "level", "left").na.fill(0, ["tp", "fp"])
    rows = rows.select("level", F.sum("tp").over(order).alias("tp"), F.sum("fp").over(order).alias("fp")).withColumn("bad", bad)
    return rows.select("level", "tp", "fp", (F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).alias("precision"), (F.col("tp") / F.greatest(F.lit(1), F.col("bad"))).alias("recall"))


def reconcile(artifacts: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Artifacts to upload (first of each content, not yet known) and to back-fill (known ones)."""
    once = artifacts.groupBy("sha256").agg(F.min("id").alias("id"))
    return once.join(known, "sha256", "left_anti"), once.join(known, "sha256", "left_semi")
