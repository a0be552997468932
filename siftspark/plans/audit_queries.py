"""Queries on grades, run metrics, stored reports, and the event stream in batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.operators import audits as M
from siftspark.operators import features as X
from siftspark.operators import findings as B
from siftspark.operators import grades as G
from siftspark.plans.finding_queries import floor_verdicts
from siftspark.plans.register import registrar
from siftspark.plans.sqltext import FILES, FINDINGS, FLOOR, SCORES, SUMMARIES, sql
from siftspark.plans.verdict_queries import _CAL, _GRID, _MEMBERS, _SWEPT, grid, members, routed
from siftspark.operators import verdicts as S
from siftspark.session import table
from siftspark.sources import adapters as A
from siftspark.sources import reports as P
from siftspark.streaming import monitor as T

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

#: Phrases as a user lists them.
PHRASES = ["the and of", "ignore previous", "onon", "les de"]


@query(r"""WITH t AS (SELECT conv_id, turn, replace(text, '!!', '/') AS t FROM conversations), l AS (SELECT conv_id, turn, t, unnest(string_split(t, chr(10))) AS line FROM t),
  m AS (SELECT *, trim(line, E' \t\r\n\u000b\u000c') AS s, regexp_extract(line, '^\s*(?://|--|#) ([HSNBCF])(?: |$)', 1) AS mark FROM l),
  f AS (SELECT *, mark = '' AND s <> '' AS context, strlen(s) >= 16 AND ((length(s) - length(replace(replace(s, '\x', ''), '\0', ''))) / 2 >= 2 OR 100 * (length(s) - length(regexp_replace(s, '[ -~\t]', '', 'g'))) < 75 * length(s)) AS opaque FROM m),
  g AS (SELECT conv_id, turn, bool_or(mark IN ('H', 'S')) AS elevated, bool_or(mark = 'H') AS hostile, count(*) FILTER (context) = 0 OR 2 * count(*) FILTER (context AND opaque) < count(*) FILTER (context) AS readable FROM f GROUP BY ALL)
  SELECT g.*, contains(lower(t), 'the and of') OR contains(lower(t), 'ignore previous') OR contains(lower(t), 'onon') OR contains(lower(t), 'les de') AS addresses_analyzer FROM g JOIN t USING (conv_id, turn)""")
def text_guards(spark, sf_dir):
    return G.guard_texts(table(spark, sf_dir, "conversations"), PHRASES, ("conv_id", "turn"))


_GRADES = """g AS (SELECT conv_id, turn, turn % 3 AS class, round(length(text) % 100 / 100, 2) AS prob, CASE length(text) % 4 WHEN 0 THEN 'benign' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'hostile' END AS grade, length(text) % 5 > 0 AS readable, length(text) % 7 = 0 AS addresses_analyzer, length(text) % 2 = 0 AS hostile_finding, length(text) % 3 > 0 AS near FROM conversations)"""


def graded(spark, sf_dir):
    n = "length(text)"
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "turn % 3 AS class", f"round({n} % 100 / 100, 2) AS prob", f"CASE {n} % 4 WHEN 0 THEN 'benign' WHEN 1 THEN 'suspicious' WHEN 2 THEN 'hostile' END AS grade", f"{n} % 5 > 0 AS readable", f"{n} % 7 = 0 AS addresses_analyzer", f"{n} % 2 = 0 AS hostile_finding", f"{n} % 3 > 0 AS near")


@query("WITH " + _GRADES + """, w AS (SELECT *, CASE grade WHEN 'hostile' THEN 2 WHEN 'suspicious' THEN 1 WHEN 'benign' THEN 0 END AS want, readable AND NOT addresses_analyzer AS soft FROM g),
  t AS (SELECT *, CASE WHEN want > class THEN class + 1 WHEN want < class AND soft THEN class - 1 ELSE class END AS one FROM w)
  SELECT conv_id, turn, CASE WHEN want IS NULL OR one = class THEN class WHEN one < 2 AND class < 2 THEN one WHEN one > class AND hostile_finding THEN one WHEN near THEN one ELSE class END AS new_class,
  CASE WHEN want IS NULL THEN prob WHEN want > class THEN prob + (1 - prob) * 0.33 WHEN want = class AND class > 0 THEN prob + (1 - prob) * 0.33 WHEN soft THEN prob * 0.67 ELSE prob END AS new_prob FROM t""")
def blended_grades(spark, sf_dir):
    return G.blend(graded(spark, sf_dir)).select("conv_id", "turn", "new_class", "new_prob")


@query("""SELECT 'arm' || (conv_id % 3) AS arm, 'b' || (turn % 2) AS batch, count(*) AS n, count(CASE WHEN length(text) % 3 = turn % 3 THEN 1 END) AS exact, count(CASE WHEN abs(length(text) % 3 - turn % 3) <= 1 THEN 1 END) AS acceptable FROM conversations GROUP BY ROLLUP ('arm' || (conv_id % 3), 'b' || (turn % 2))""")
def grade_evaluation(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("concat('arm', conv_id % 3) AS arm", "concat('b', turn % 2) AS batch", "length(text) % 3 AS grade", "turn % 3 AS truth")
    return G.grade_eval(rows)


@query("""WITH k AS (SELECT conv_id, turn, sha256('m' || chr(0) || role || chr(0) || text) AS key FROM conversations), c AS (SELECT key, min(conv_id % 3) AS grade FROM k WHERE conv_id % 2 = 0 GROUP BY 1) SELECT conv_id, turn, k.key, grade FROM k LEFT JOIN c USING (key)""".replace("chr(0)", "'|'"))
def graded_from_cache(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("key", F.sha2(F.concat(F.lit("m|"), "role", F.lit("|"), "text"), 256))
    cache = rows.where("conv_id % 2 = 0").groupBy("key").agg(F.min(F.col("conv_id") % 3).alias("grade")).withColumn("reason", F.lit(None).cast("string"))
    return G.with_grades(rows, cache).select("conv_id", "turn", "key", "grade")


@query(sql(FINDINGS, FLOOR, """, v AS (SELECT CASE WHEN report_id % 100 = 7 THEN NULL ELSE class END AS class FROM verdicts) SELECT count(CASE WHEN class = 2 THEN 1 END) AS hostile, count(CASE WHEN class = 1 THEN 1 END) AS suspicious, count(CASE WHEN class = 0 THEN 1 END) AS benign, count(CASE WHEN class IS NULL THEN 1 END) AS errors, count(class) AS total, 1 AS exit_code FROM v"""))
def scan_summary(spark, sf_dir):
    return M.summary(floor_verdicts(spark, sf_dir).withColumn("class", F.when(F.col("report_id") % 100 != 7, F.col("class"))))


_JOBS = "jobs AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice * 200) AS BIGINT) AS size, o_orderdate AS claimed, o_custkey % 90 * 60000 + o_orderkey % 1000 AS ms, o_custkey AS sha FROM orders)"


def jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(floor(o_totalprice * 200) AS BIGINT) AS size", "CAST(o_orderdate AS TIMESTAMP) AS claimed", "o_custkey % 90 * 60000 + o_orderkey % 1000 AS ms", "o_custkey AS sha")
    return rows.withColumn("resulted", F.timestamp_millis(F.unix_millis("claimed") + F.col("ms")))


@query(sql(_JOBS, """, c AS (SELECT *, CASE WHEN size < 1048576 THEN 'small' WHEN size < 33554432 THEN 'medium' ELSE 'large' END AS size_class FROM jobs) SELECT coalesce(size_class, 'all') AS size_class, count(*) AS n, CAST(floor(avg(ms)) AS BIGINT) AS mean, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99, max(ms) AS most FROM c GROUP BY GROUPING SETS ((size_class), ())"""))
def job_latency(spark, sf_dir):
    return M.latency(jobs(spark, sf_dir))


@query(sql(_JOBS, "SELECT count(*) AS done, CAST(max(epoch_ms(claimed) + ms) // 1000 - min(epoch_ms(claimed)) // 1000 AS DOUBLE) AS wall_s, count(*) / (max(epoch_ms(claimed) + ms) // 1000 - min(epoch_ms(claimed)) // 1000) AS per_s FROM jobs"))
def job_throughput(spark, sf_dir):
    return M.throughput(jobs(spark, sf_dir))


@query(sql(_JOBS, """, a AS (SELECT sha, id, row_number() OVER (PARTITION BY sha ORDER BY claimed, id) AS k FROM jobs), b AS (SELECT sha, id, row_number() OVER (PARTITION BY sha ORDER BY epoch_ms(claimed) + ms, id) AS k FROM jobs WHERE id % 3 > 0) SELECT a.sha, a.id AS job_id, b.id AS result_id FROM a LEFT JOIN b USING (sha, k)"""))
def matched_results(spark, sf_dir):
    rows = jobs(spark, sf_dir)
    return M.match_results(rows, rows.where("id % 3 > 0")).select("sha", "job_id", "result_id")


@query(sql(_JOBS, """, c AS (SELECT *, CASE WHEN size < 1048576 THEN 'small' WHEN size < 33554432 THEN 'medium' ELSE 'large' END AS size_class FROM jobs), m AS (SELECT *, (2 * row_number() OVER (PARTITION BY size_class ORDER BY id) - 1) / (2 * count(*) OVER (PARTITION BY size_class)) AS place FROM c) SELECT id, ntile(8) OVER (ORDER BY place, id) AS batch FROM m"""))
def mixed_batches(spark, sf_dir):
    return M.batches(jobs(spark, sf_dir), "mixed", 8).select("id", "batch")


@query(sql(FILES, "SELECT report_id, file_id, CASE WHEN file_type IN ('zip', 'tar', 'apk') THEN least(10737418240, greatest(1610612736, 64 * size_bytes + 1610612736)) ELSE 536870912 END AS est FROM files"))
def memory_estimates(spark, sf_dir):
    return A.files(spark, sf_dir).select("report_id", "file_id", M.est_bytes(F.col("file_type"), F.col("size_bytes")).alias("est"))


@query(sql(FINDINGS, FILES, FLOOR, _MEMBERS + """, w AS (SELECT report_id, max(class) AS class FROM (SELECT report_id, class FROM verdicts UNION ALL SELECT report_id, class FROM m) GROUP BY 1) SELECT count(CASE WHEN class = 2 THEN 1 END) AS hostile_fp, count(CASE WHEN class = 1 THEN 1 END) AS suspicious_fp, count(CASE WHEN class = 0 THEN 1 END) AS passed FROM w"""))
def benign_corpus(spark, sf_dir):
    return M.validate_benign(floor_verdicts(spark, sf_dir), members(spark, sf_dir))


@query(sql(FINDINGS, FILES, FLOOR, _MEMBERS + """, l AS (SELECT report_id, string_agg(file_id || ':' || CASE WHEN file_id % 9 = 0 THEN 'null' ELSE CAST(class AS VARCHAR) END, ',' ORDER BY file_id) AS m FROM m GROUP BY 1) SELECT report_id, sha256(level || '|' || coalesce(m, '')) AS fp FROM verdicts LEFT JOIN l USING (report_id)"""))
def run_fingerprints(spark, sf_dir):
    inner = members(spark, sf_dir).select("report_id", "file_id", F.when(F.col("file_id") % 9 != 0, F.col("class")).alias("level"))
    return M.fingerprint(floor_verdicts(spark, sf_dir), inner)


@query(sql(FINDINGS, FLOOR, """, a AS (SELECT report_id, class AS x FROM verdicts WHERE report_id % 11 <> 0), b AS (SELECT report_id, CASE WHEN report_id % 13 = 0 THEN 9 ELSE class END AS x FROM verdicts WHERE report_id % 7 <> 0)
  SELECT * FROM (SELECT report_id, CASE WHEN a.x IS NULL THEN 'added' WHEN b.x IS NULL THEN 'removed' WHEN a.x <> b.x THEN 'changed' END AS change FROM a FULL JOIN b USING (report_id)) WHERE change IS NOT NULL"""))
def run_diff(spark, sf_dir):
    v = floor_verdicts(spark, sf_dir)
    a = v.where("report_id % 11 <> 0").select("report_id", F.col("class").alias("fp"))
    b = v.where("report_id % 7 <> 0").select("report_id", F.when(F.col("report_id") % 13 == 0, 9).otherwise(F.col("class")).alias("fp"))
    return M.diff_runs(a, b)


@query(sql(FINDINGS, SUMMARIES, """SELECT 'ext' AS family, count(CASE WHEN v <> 0 AND report_id % 5 = 0 THEN 1 END) AS diverging, count(CASE WHEN v <> 0 THEN 1 END) AS nonzero FROM (SELECT report_id, unnest([max_third_party::DOUBLE, ln(1 + n_third_party), max_well_known::DOUBLE, well_known_hostile::DOUBLE, well_known_suspicious::DOUBLE, has_yara::INT::DOUBLE]) AS v FROM report_summary)"""))
def feature_parity(spark, sf_dir):
    a = X.external(A.findings(spark, sf_dir))
    return M.parity(a, a.withColumn("value", F.when(F.col("report_id") % 5 == 0, F.col("value") * 1.01).otherwise(F.col("value"))))


_RUNS = "runs AS (SELECT s_nationkey AS dataset, CASE s_suppkey % 2 WHEN 0 THEN 'archive' ELSE 'loose' END AS label, 100 + s_acctbal AS wall, s_suppkey % 17 AS rss, s_suppkey AS run FROM supplier)"


def runs(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_nationkey AS dataset", "CASE s_suppkey % 2 WHEN 0 THEN 'archive' ELSE 'loose' END AS label", "100 + s_acctbal AS wall", "s_suppkey % 17 AS rss", "s_suppkey AS run")


@query(sql(_RUNS, "SELECT dataset, label, b.w AS wall, b.r AS rss, b.n AS run FROM (SELECT dataset, label, arg_min({'w': wall, 'r': rss, 'n': run}, (wall, run)) AS b FROM runs GROUP BY ALL)"))
def best_runs(spark, sf_dir):
    return M.best_runs(runs(spark, sf_dir))


@query(sql(_RUNS, ", l AS (SELECT dataset, arg_max(wall, run) FILTER (label = 'archive') / arg_max(wall, run) FILTER (label = 'loose') AS ratio FROM runs GROUP BY 1) SELECT dataset, ratio, ratio <= 1.05 AS ok FROM l"))
def run_goal(spark, sf_dir):
    return M.goal(runs(spark, sf_dir), "archive", "loose")


@query(sql(_CAL, _GRID, _SWEPT + """, s AS (SELECT id, coalesce(level, -1) AS level, label % 2 = 0 AS bad FROM (SELECT DISTINCT id FROM routed) LEFT JOIN swept USING (id) JOIN scores USING (id)), n AS (SELECT DISTINCT level FROM grid)
  SELECT level, tp, fp, tp / greatest(1, tp + fp) AS precision, tp / greatest(1, (SELECT count(CASE WHEN bad THEN 1 END) FROM s)) AS recall FROM (SELECT n.level, count(*) FILTER (bad) AS tp, count(*) FILTER (NOT bad) AS fp FROM n LEFT JOIN s ON s.level >= 0 AND s.level <= n.level GROUP BY 1)"""))
def operating_points(spark, sf_dir):
    fired = S.decide(routed(spark, sf_dir), grid(spark)).join(A.scores(spark, sf_dir).select("id", (F.col("label") % 2 == 0).alias("bad")), "id")
    return M.level_report(fired.select("level", "bad"), grid(spark).select("level").distinct())


@query("""WITH d AS (SELECT sha256(text) AS sha256, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT sha256, id FROM d WHERE sha256 NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL)""")
def uploads(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("id"))
    return M.reconcile(docs, docs.where("id % 3 = 0").select("sha256").distinct())[0]


@query("""SELECT sha256(text) AS sha256, doc_id AS id FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 AND doc_id % 4 = 0 AND text IS NOT NULL)""")
def reuse_work(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("sha256"), F.col("doc_id").alias("id"))
    store = docs.where("id % 2 = 0").select("sha256", F.when(F.col("id") % 4 == 0, "v1").otherwise("v0").alias("version"), F.lit("r").alias("result"))
    return M.reuse(docs, store, "v1")[1]


@query(sql(FINDINGS, FILES, _MEMBERS + """ SELECT f.report_id, string_agg(f.file_id || ' ' || file_type || ' ' || coalesce(CAST(class AS VARCHAR), '-') || ' ' || coalesce(CAST(CAST(round(prob * 100) AS INT) AS VARCHAR), '-'), ',' ORDER BY f.file_id) AS files FROM files f LEFT JOIN m USING (report_id, file_id) GROUP BY 1"""))
def envelope_files(spark, sf_dir):
    said = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    entry = lambda f: F.concat_ws(" ", f["id"].cast("string"), f["type"], said(f["v"]["cls"]), said(F.round(f["v"]["prob"] * 100).cast("int")))
    return P.ml_files(A.files(spark, sf_dir), members(spark, sf_dir)).select("report_id", F.array_join(F.transform("files", entry), ",").alias("files"))


@query(sql(FINDINGS, FILES, "SELECT f.report_id, f.file_id, count(g.id) AS n, max(crit) AS crit FROM files f LEFT JOIN findings g USING (report_id, file_id) GROUP BY ALL"))
def nested_and_flat(spark, sf_dir):
    nested = P.nest(A.files(spark, sf_dir), A.findings(spark, sf_dir))
    flat = P.flatten(nested.selectExpr("report_id", f"from_json(to_json(files), 'array<{P.FILE}>') AS files"))
    sums = flat["findings"].groupBy("report_id", "file_id").agg(F.count(F.lit(1)).alias("n"), F.max("crit").alias("crit"))
    return flat["files"].select("report_id", "file_id").join(sums, ["report_id", "file_id"], "left").na.fill(0, ["n"])


_EV = "ev AS (SELECT event_id AS id, ts, user_id AS worker, CASE event_type WHEN 'signup' THEN 'claim' WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'error' ELSE 'heartbeat' END AS kind, props AS message FROM events)"


def events(spark, sf_dir):
    kind = "CASE event_type WHEN 'signup' THEN 'claim' WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'error' ELSE 'heartbeat' END AS kind"
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "CAST(ts AS TIMESTAMP) AS ts", "user_id AS worker", kind, "props AS message")


def _seconds(rows, *cols):
    return rows.withColumns({c: F.unix_timestamp(c) for c in cols})


@query(sql(_EV, "SELECT CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS minute, worker, count(*) AS n FROM ev WHERE kind = 'result' GROUP BY ALL"))
def minute_counts(spark, sf_dir):
    return _seconds(T.per_minute(events(spark, sf_dir)), "minute")


@query(sql(_EV, "SELECT m AS at, count(*) AS n, count(*) / 900.0 AS per_s FROM (SELECT unnest(range(CAST(floor(epoch(ts) / 60) AS BIGINT) + 1, CAST(floor(epoch(ts) / 60) AS BIGINT) + 16)) * 60 AS m FROM ev WHERE kind = 'result') GROUP BY 1"))
def trailing_rate(spark, sf_dir):
    return _seconds(T.rate(events(spark, sf_dir)), "at")


@query(sql(_EV, "SELECT m AS at, count(*) AS n, arg_max(message, (ts, message)) AS last FROM (SELECT ts, message, unnest(range(CAST(floor(epoch(ts) / 60) AS BIGINT) + 1, CAST(floor(epoch(ts) / 60) AS BIGINT) + 16)) * 60 AS m FROM ev WHERE kind = 'error') GROUP BY 1"))
def trailing_errors(spark, sf_dir):
    return _seconds(T.errors(events(spark, sf_dir)), "at")


@query(sql(_EV, """, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY worker ORDER BY ts) < INTERVAL 60 MINUTES THEN 0 ELSE 1 END AS new FROM ev), s AS (SELECT *, sum(new) OVER (PARTITION BY worker ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT worker, CAST(floor(epoch(min(ts))) AS BIGINT) AS "start", CAST(floor(epoch(max(ts))) AS BIGINT) + 3600 AS "end", count(*) AS n FROM s GROUP BY worker, k"""))
def worker_sessions(spark, sf_dir):
    return _seconds(T.sessions(events(spark, sf_dir)), "start", "end")


@query(sql(_EV, "SELECT c.worker, c.id AS claim_id, r.id AS result_id FROM ev c JOIN ev r ON c.worker = r.worker AND c.kind = 'claim' AND r.kind = 'result' AND r.ts >= c.ts AND r.ts <= c.ts + INTERVAL 2 HOURS"))
def claims_with_results(spark, sf_dir):
    ev = events(spark, sf_dir)
    return T.claim_result(ev.where("kind = 'claim'"), ev.where("kind = 'result'")).select("worker", "claim_id", "result_id")


@query(sql(_EV, ", l AS (SELECT worker, max(CASE WHEN kind = 'result' THEN ts END) AS lr FROM ev GROUP BY 1), o AS (SELECT worker, min(ts) AS t FROM ev JOIN l USING (worker) WHERE kind = 'claim' AND (lr IS NULL OR ts > lr) GROUP BY 1) SELECT worker, CAST(floor(epoch(lr)) AS BIGINT) AS last_result, 1706745600 - CAST(floor(epoch(t)) AS BIGINT) AS oldest_s FROM l LEFT JOIN o USING (worker)"))
def queue_ages(spark, sf_dir):
    return _seconds(T.queue_age(events(spark, sf_dir), F.to_timestamp(F.lit("2024-02-01 00:00:00"))), "last_result")
