"""Queries of the table-level jobs and of operators on scores, references, known sets and sources."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from siftspark.operators import audits as M
from siftspark.operators import features as X
from siftspark.operators import grades as G
from siftspark.operators import jobs as J
from siftspark.operators import knownsets as K
from siftspark.operators import refs as R
from siftspark.operators import verdicts as S
from siftspark.plans.feature_queries import FEATURES, report_tables, spec, _SPEC, _VECTORS, shaped_files
from siftspark.plans.register import registrar
from siftspark.plans.sqltext import FILES, FINDINGS, POOL, REFS, SCORES, sql
from siftspark.plans.verdict_queries import _CAL, _GRID, breakpoints, grid, routed
from siftspark.session import buckets, stored_by, stored_rows, table, table_rows
from siftspark.sources import adapters as A
from siftspark.sources import reports as P

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

# ---- scores

#: One tree for each of two seeds: (feature, threshold, left, right, value).
SEEDS = [{"base": -1.0, "trees": [[(0, 0.5, 1, 2, 0.0), (-1, 0.0, 0, 0, -0.6), (-1, 0.0, 0, 0, 1.4)], [(5, 0.2, 1, 2, 0.0), (-1, 0.0, 0, 0, -0.2), (-1, 0.0, 0, 0, 0.8)]]}, {"base": -0.4, "trees": [[(2, 0.0, 1, 2, 0.0), (-1, 0.0, 0, 0, -0.5), (-1, 0.0, 0, 0, 0.9)]]}]
SPECIAL = [{"base": -0.8, "trees": [[(1, 0.3, 1, 2, 0.0), (-1, 0.0, 0, 0, -0.3), (-1, 0.0, 0, 0, 1.9)]]}]
_MODEL_GRID = ((0, 0.97), (25, 0.6), (500, 0.5), (3000, 0.42), (25000, 0.3))


def model(spark) -> J.Model:
    """Small tables as a model has them: general and elf routes are calibrated, the native group's is not, and no tree is there for python."""
    bp = [(r, x, y) for r in ("general", "filetypes/elf") for x, y in ((0.1, 0.05), (0.4, 0.3), (0.7, 0.8), (0.9, 0.98))]
    groups = spark.createDataFrame([("elf", "native", True), ("pe", "native", False), ("python", None, True)], "t string, grp string, special boolean")
    containers = spark.createDataFrame([("apk", "zip")], "t string, container string")
    rows = [("elf", r, n, p) for n, p in _MODEL_GRID for r in ("general", "filetypes/elf")]
    return J.Model(
        {"general": SEEDS, "filetypes/elf": SPECIAL, "filegroups/native": SPECIAL}, spark.createDataFrame(bp, "route string, x double, y double"), groups, containers,
        spark.createDataFrame(rows, "file_type string, route string, level int, threshold double"), spark.createDataFrame([(n, p + 0.02) for n, p in _MODEL_GRID], "level int, threshold double"),
    )


_SCORED = """, v AS (SELECT report_id, max(CASE WHEN pos = 0 THEN z END) AS z0, max(CASE WHEN pos = 1 THEN z END) AS z1, max(CASE WHEN pos = 2 THEN z END) AS z2, max(CASE WHEN pos = 5 THEN z END) AS z5 FROM cell GROUP BY 1),
rt AS (SELECT report_id, file_type FROM files_ WHERE depth = 0),
raws AS (SELECT report_id, file_type, 'general' AS route, (1 / (1 + exp(-(-1.0 + CASE WHEN z0 <= 0.5 THEN -0.6 ELSE 1.4 END + CASE WHEN z5 <= 0.2 THEN -0.2 ELSE 0.8 END))) + 1 / (1 + exp(-(-0.4 + CASE WHEN z2 <= 0 THEN -0.5 ELSE 0.9 END)))) / 2 AS raw FROM v JOIN rt USING (report_id)
  UNION ALL SELECT report_id, file_type, 'filetypes/elf', 1 / (1 + exp(-(-0.8 + CASE WHEN z1 <= 0.3 THEN -0.3 ELSE 1.9 END))) FROM v JOIN rt USING (report_id) WHERE file_type = 'elf'),
bp AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM (VALUES (0.1::DOUBLE, 0.05::DOUBLE), (0.4, 0.3), (0.7, 0.8), (0.9, 0.98)) t(x, y)),
ps AS (SELECT report_id, file_type, route, raw, CASE WHEN raw <= 0.1 THEN 0.05 WHEN raw >= 0.9 THEN 0.98 ELSE y + (raw - x) / (x2 - x) * (y2 - y) END AS p FROM raws LEFT JOIN bp ON raw >= x AND raw < x2)"""
_LEVELS = ", ".join(f"({n}, {p}::DOUBLE)" for n, p in _MODEL_GRID)
_DECIDED = _SCORED + f""", lv AS (SELECT * FROM (VALUES {_LEVELS}) t(level, threshold)),
hits AS (SELECT report_id, level, p, p - threshold AS m FROM ps, lv WHERE file_type = 'elf' AND p >= threshold UNION ALL SELECT report_id, level, p, p - threshold FROM (SELECT report_id, file_type, max(p) AS p FROM ps GROUP BY ALL), lv WHERE file_type <> 'elf' AND p >= threshold + 0.02),
low AS (SELECT report_id, min(level) AS level FROM hits GROUP BY 1), fired AS (SELECT h.report_id, h.level, arg_max(p, (m, p)) AS p FROM hits h JOIN low USING (report_id, level) GROUP BY ALL),
decided AS (SELECT g.report_id, CASE WHEN level IS NULL THEN 0 WHEN level <= 25 THEN 2 WHEN level <= 3000 THEN 1 ELSE 0 END AS class, coalesce(fired.p, g.p) AS prob, coalesce(level, -1) AS level FROM (SELECT * FROM ps WHERE route = 'general') g LEFT JOIN fired USING (report_id))"""
_FILES_ = FILES.replace("files AS (SELECT report_id, file_id, ", "files_ AS (SELECT report_id, file_id, ")
_CONF_OF = "CASE level WHEN -1 THEN 0 WHEN 0 THEN 100 WHEN 25 THEN 92 WHEN 500 THEN 78 WHEN 3000 THEN 54 ELSE 29 END"


def _scored(spark, sf_dir):
    t = report_tables(spark, sf_dir)
    return J.score_reports(J.featurize(replace(t, importing=None), spec(spark)), t.files, model(spark), buckets=t.buckets), t


@query(sql(*FEATURES, _SPEC, _FILES_, _VECTORS + _DECIDED + f" SELECT report_id, class, prob, level, {_CONF_OF} AS conf FROM decided"))
def job_score_reports(spark, sf_dir):
    return _scored(spark, sf_dir)[0][0]


@query(sql(*FEATURES, _SPEC, _FILES_, _VECTORS + _SCORED + " SELECT report_id, route, raw, p FROM ps"))
def job_route_scores(spark, sf_dir):
    return _scored(spark, sf_dir)[0][1]


@query(sql(FILES, "SELECT report_id, 'filegroups/native' AS route, CASE WHEN file_type IN ('elf', 'pe') THEN 'uncalibrated' END AS why FROM files WHERE depth = 0 AND file_type IN ('elf', 'pe') UNION ALL SELECT report_id, 'filetypes/python', 'unavailable' FROM files WHERE depth = 0 AND file_type = 'python'"))
def job_skipped_routes(spark, sf_dir):
    return _scored(spark, sf_dir)[0][2]


_OWN = """, own AS (SELECT report_id, file_id, count(CASE WHEN conf >= 0.76 AND crit = 5 THEN 1 END) AS c5, count(CASE WHEN conf >= 0.76 AND crit = 4 THEN 1 END) AS c4, max(CASE WHEN conf >= 0.76 AND crit = 5 THEN conf END) AS p5, max(CASE WHEN conf >= 0.76 AND crit = 4 THEN conf END) AS p4, count(*) AS total FROM findings GROUP BY ALL),
mem AS (SELECT f.report_id, f.file_id, CASE WHEN c5 >= 1 THEN 2 WHEN c4 >= 2 AND c4 >= 0.05 * total THEN 1 ELSE 0 END AS class, CASE WHEN c5 >= 1 THEN p5 WHEN c4 >= 2 AND c4 >= 0.05 * total THEN p4 ELSE 0.0 END AS prob FROM FILES_ f LEFT JOIN own USING (report_id, file_id) WHERE depth > 0)"""
_ROLLED = _OWN + """, fl AS (SELECT report_id, sum(c5) AS c5, sum(c4) AS c4, max(p5) AS p5, max(p4) AS p4, sum(total) AS total FROM own JOIN FILES_ USING (report_id, file_id) WHERE depth = 0 GROUP BY 1),
floored AS (SELECT d.report_id, CASE WHEN d.class > 0 THEN d.class WHEN c5 >= 1 THEN 2 WHEN c4 >= 2 AND c4 >= 0.05 * total THEN 1 ELSE 0 END AS class, CASE WHEN d.class = 0 AND c5 >= 1 THEN p5 WHEN d.class = 0 AND c4 >= 2 AND c4 >= 0.05 * total THEN p4 ELSE d.prob END AS prob,
  CASE WHEN d.class = 0 AND c5 >= 1 THEN 25 WHEN d.class = 0 AND c4 >= 2 AND c4 >= 0.05 * total THEN 3000 ELSE d.level END AS level FROM decided d LEFT JOIN fl USING (report_id)),
worst AS (SELECT report_id, arg_max({'c': class, 'p': prob, 'f': file_id}, (class, prob, -file_id)) AS w FROM mem GROUP BY 1),
rolled AS (SELECT f.report_id, CASE WHEN up THEN (w).c ELSE class END AS class, CASE WHEN up THEN (w).p ELSE prob END AS prob, CASE WHEN NOT up THEN level WHEN (w).c = 2 THEN 25 WHEN (w).c = 1 THEN 3000 ELSE -1 END AS level, CASE WHEN up THEN (w).f END AS from_member
  FROM (SELECT f.*, w, w IS NOT NULL AND ((w).c, (w).p) > (f.class, f.prob) AS up FROM floored f LEFT JOIN worst USING (report_id)) f)"""


@query(sql(*FEATURES, _SPEC, _FILES_, FINDINGS, _VECTORS + _DECIDED + _ROLLED.replace("FILES_", "files_") + f" SELECT report_id, class, prob, from_member, level, {_CONF_OF} AS conf FROM rolled"))
def job_rollup(spark, sf_dir):
    scored, t = _scored(spark, sf_dir)
    members = stored_by(J.member_verdicts(t.files, t.findings), "report_id", t.buckets, dealt=True)
    return J.rollup(scored[0], t.files, t.findings, members, buckets=t.buckets)[0]


def known_roots(spark, sf_dir):
    """Keys that know some of the root files: every fifth report's is good, every fifteenth's also bad."""
    roots = A.files(spark, sf_dir).where("depth = 0").select("report_id", F.col("sha256").alias("key"))
    good = roots.where("report_id % 5 = 0").select("key", F.lit("good").alias("label"))
    return good.unionByName(roots.where("report_id % 15 = 0").select("key", F.lit("bad").alias("label")))


# Units of two grains: a report under its number, and each of its members as "report/file".
_INNER = "SELECT DISTINCT l_orderkey AS report_id, l_suppkey AS file_id FROM lineitem QUALIFY l_suppkey > min(l_suppkey) OVER (PARTITION BY l_orderkey)"
_FINDINGS2 = FINDINGS.replace("findings AS (", "findings0 AS (", 1).replace("active AS (", f"""findings AS (SELECT CAST(report_id AS VARCHAR) AS report_id, * EXCLUDE (report_id) FROM findings0 UNION ALL SELECT report_id || '/' || file_id, * EXCLUDE (report_id) FROM findings0 WHERE (report_id, file_id) IN ({_INNER})),
active AS (""", 1)
_FILES2 = FILES.replace("\nfiles AS (", "\nfiles0 AS (", 1) + """,
files AS (SELECT CAST(report_id AS VARCHAR) AS report_id, * EXCLUDE (report_id) FROM files0 UNION ALL SELECT report_id || '/' || file_id, * EXCLUDE (report_id) REPLACE (NULL AS parent_id, 0 AS risk, regexp_replace(path, '^.*!!', '') AS path) FROM files0 WHERE depth > 0)"""
_FEATURES2 = [f.replace(FINDINGS, _FINDINGS2).replace(FILES, _FILES2) for f in FEATURES]
_FILES2_ = _FILES2.replace("\nfiles AS (", "\nfiles_ AS (")
_DECIDED2 = (_VECTORS + _DECIDED).replace("(SELECT DISTINCT l_orderkey AS report_id FROM lineitem)", "(SELECT DISTINCT report_id FROM files_)").replace("FROM files_ WHERE depth = 0", "FROM files_ WHERE depth = 0 OR contains(report_id, '/')")
_C5 = "c5 >= 1 THEN 2 WHEN c4 >= 2 AND c4 >= 0.05 * total THEN 1"
_MEMBERS2 = _DECIDED2 + f""", own AS (SELECT report_id, file_id, count(CASE WHEN conf >= 0.76 AND crit = 5 THEN 1 END) AS c5, count(CASE WHEN conf >= 0.76 AND crit = 4 THEN 1 END) AS c4, max(CASE WHEN conf >= 0.76 AND crit = 5 THEN conf END) AS p5, max(CASE WHEN conf >= 0.76 AND crit = 4 THEN conf END) AS p4, count(*) AS total FROM findings GROUP BY ALL),
units AS (SELECT CAST(split_part(report_id, '/', 1) AS BIGINT) AS report_id, coalesce(TRY_CAST(split_part(report_id, '/', 2) AS BIGINT), root_id) AS file_id, contains(report_id, '/') AS inside, class, prob, level FROM decided JOIN (SELECT l_orderkey, min(l_suppkey) AS root_id FROM lineitem GROUP BY 1) ON l_orderkey = CAST(split_part(report_id, '/', 1) AS BIGINT)),
floored AS (SELECT u.report_id, u.file_id, inside, CASE WHEN class > 0 THEN class WHEN {_C5} ELSE 0 END AS class, CASE WHEN class = 0 AND c5 >= 1 THEN p5 WHEN class = 0 AND c4 >= 2 AND c4 >= 0.05 * total THEN p4 ELSE prob END AS prob,
  CASE WHEN class = 0 AND c5 >= 1 THEN 25 WHEN class = 0 AND c4 >= 2 AND c4 >= 0.05 * total THEN 3000 ELSE level END AS level FROM units u LEFT JOIN own USING (report_id, file_id)),
scanned AS (SELECT * FROM floored WHERE report_id % 5 <> 0 OR report_id % 15 = 0),
worst AS (SELECT report_id, arg_max({{'c': class, 'p': prob, 'l': level, 'f': file_id}}, (class, prob, -file_id)) AS w FROM scanned WHERE inside GROUP BY 1),
final AS (SELECT report_id, CASE WHEN up THEN w.c ELSE class END AS class, CASE WHEN up THEN w.p ELSE prob END AS prob, CASE WHEN up THEN w.l ELSE level END AS level, CASE WHEN up THEN w.f END AS from_member
  FROM (SELECT s.*, w, w IS NOT NULL AND (w.c, w.p) > (class, prob) AS up FROM scanned s LEFT JOIN worst USING (report_id) WHERE NOT inside))"""


def _run(spark, sf_dir):
    n = buckets(spark, A.lines(spark, sf_dir))
    files = stored_by(shaped_files(spark, sf_dir, n).drop("sha256"), "report_id", n, dealt=True).withColumn("sha256", A.content_hash())
    t = J.Tables(files, stored_by(A.findings(spark, sf_dir), "report_id", n), buckets=n)
    fetched = t.files.where("depth = 1").join(t.files.select("report_id", F.col("file_id").alias("parent_id"), F.col("path").alias("at")), ["report_id", "parent_id"]).select("report_id", "sha256", F.col("at").alias("path"), F.concat(F.lit("pkg:npm/f"), "file_id").alias("locator"))
    return J.score_corpus(t, spec(spark), model(spark), known_roots(spark, sf_dir), fetched=fetched)


@query(sql(*_FEATURES2, _SPEC, _FILES2_, FINDINGS, _MEMBERS2 + """, c AS (SELECT count(*) FILTER (class = 2) AS hostile, count(*) FILTER (class = 1) AS suspicious, count(*) FILTER (class = 0) AS benign, CAST(0 AS BIGINT) AS errors, count(*) AS total FROM final)
  SELECT *, CASE WHEN hostile > 0 THEN 1 WHEN suspicious > 0 THEN 2 WHEN errors > 0 THEN 3 ELSE 0 END AS exit_code FROM c"""))
def job_score_corpus(spark, sf_dir):
    """The summary of a whole run: known-good reports are not scanned."""
    return _run(spark, sf_dir).summary


@query(sql(*_FEATURES2, _SPEC, _FILES2_, FINDINGS, _MEMBERS2 + " SELECT report_id, file_id, class, prob, level FROM scanned WHERE inside"))
def job_member_verdicts(spark, sf_dir):
    """Members by the model, each by the routes of its own type, floored by its own findings."""
    return _run(spark, sf_dir).members


@query(sql(*_FEATURES2, _SPEC, _FILES2_, FINDINGS, _MEMBERS2 + """, bad AS (SELECT s.report_id, f.parent_id AS file_id, 'pkg:npm/f' || s.file_id AS locator, class + 3 AS crit FROM scanned s JOIN files0 f USING (report_id, file_id) WHERE inside AND class > 0 AND f.depth = 1) SELECT report_id, file_id, locator, CAST(crit AS INT) AS crit FROM bad"""))
def job_backrefs(spark, sf_dir):
    """Findings that hostile and suspicious fetched members put on the files that asked for them."""
    return _run(spark, sf_dir).backrefs


@query(sql(*_FEATURES2, _SPEC, _FILES2_, FINDINGS, _MEMBERS2 + f""", m AS (SELECT report_id, count(*) AS n_files, count(*) FILTER (lvl = -1) AS benign FROM (SELECT report_id, level AS lvl FROM scanned WHERE inside UNION ALL SELECT report_id, level FROM final) GROUP BY 1),
r AS (SELECT CAST(report_id AS BIGINT) AS report_id, count(*) AS n_mods FROM ps WHERE NOT contains(report_id, '/') GROUP BY 1), k AS (SELECT report_id, file_type FROM files0 WHERE depth = 0)
  SELECT f.report_id, level AS lvl, {_CONF_OF} AS conf, n_files, benign, n_mods, CASE WHEN file_type IN ('elf', 'pe') THEN 'uncalibrated' WHEN file_type = 'python' THEN 'unavailable' END AS why FROM final f JOIN m USING (report_id) JOIN r USING (report_id) JOIN k USING (report_id)"""))
def job_envelopes(spark, sf_dir):
    """What the envelopes' lines say, read back from their text."""
    kind = "ml struct<lvl:int,conf:int,mods:array<struct<rte:string>>,skip:array<struct<why:string>>,files:array<struct<id:long,lvl:int>>>"
    ml = F.from_json("line", kind)["ml"]
    rows = _run(spark, sf_dir).envelopes.select("report_id", ml.alias("ml"))
    return rows.select("report_id", "ml.lvl", "ml.conf", F.size("ml.files").cast("long").alias("n_files"), F.size(F.filter("ml.files", lambda f: f["lvl"] == -1)).cast("long").alias("benign"), F.size("ml.mods").cast("long").alias("n_mods"), F.get("ml.skip", F.lit(0))["why"].alias("why"))


@query(sql(FILES, "SELECT report_id, CASE WHEN report_id % 15 = 0 THEN 'conflicted' WHEN report_id % 5 = 0 THEN 'skip' ELSE 'unknown' END AS decision, NOT (report_id % 5 = 0 AND report_id % 15 <> 0) AS scan FROM files WHERE depth = 0"))
def job_gate_known(spark, sf_dir):
    roots = A.files(spark, sf_dir).where("depth = 0").select("report_id", "sha256")
    return J.gate_known(roots, known_roots(spark, sf_dir))[0].select("report_id", "decision", "scan")


@query(sql(_CAL, "SELECT id, CASE WHEN max(p) >= 0.9 THEN 2 WHEN max(p) >= 0.65 THEN 1 ELSE 0 END AS class, max(p) AS prob, CASE WHEN max(p) >= 0.9 THEN 0.9 ELSE 0.65 END AS threshold FROM routed GROUP BY 1"))
def decided_without_grid(spark, sf_dir):
    return S.decide_scores(routed(spark, sf_dir))


@query(sql(_CAL, """, g AS (SELECT * FROM (VALUES (0, 0.99::DOUBLE), (10, 0.95), (100, 0.5), (500, 0.8)) v(level, threshold)), m AS (SELECT id, max(p) AS p FROM routed GROUP BY 1), l AS (SELECT id, p, min(level) AS level FROM m, g WHERE p >= threshold GROUP BY ALL) SELECT id, level, p, threshold FROM l JOIN g USING (level)"""))
def general_sweep(spark, sf_dir):
    levels = spark.createDataFrame([(0, 0.99), (10, 0.95), (100, 0.5), (500, 0.8)], "level int, threshold double")
    return S.sweep_general(routed(spark, sf_dir), levels)


@query(sql(_CAL, "SELECT id, route, p, CASE WHEN file_type = 'elf' AND p >= 0.8 THEN 2 WHEN file_type = 'elf' AND p >= 0.5 THEN 1 WHEN file_type = 'python' AND route = 'general' AND p >= 0.4 THEN 1 ELSE 0 END AS class FROM routed"))
def route_classes(spark, sf_dir):
    policy = spark.createDataFrame([("elf", "general", 0.8, 0.5), ("elf", "filetypes/elf", 0.8, 0.5), ("python", "general", None, 0.4)], "file_type string, route string, hostile double, suspicious double")
    return S.route_class(routed(spark, sf_dir), policy)


@query(sql(_CAL, ", c AS (SELECT id, p, CASE WHEN p >= 0.9 THEN 2 WHEN p >= 0.65 THEN 1 ELSE 0 END AS class FROM routed) SELECT id, max(p) AS prob, max(class) AS class FROM c GROUP BY 1"))
def routed_predictions(spark, sf_dir):
    return S.predict_for(routed(spark, sf_dir).select("id", "p", S.classify(F.col("p"), 0.65, 0.9)["class"].alias("class")))


@query(sql(_CAL, "SELECT id, max(p) AS p, CASE WHEN max(p) >= 0.9 THEN 2 ELSE 1 END AS class, CASE WHEN max(p) >= 0.9 THEN 0.9 ELSE 0.5 END AS threshold FROM routed GROUP BY 1 HAVING max(p) >= 0.5"))
def policy_decisions(spark, sf_dir):
    most = routed(spark, sf_dir).groupBy("id").agg(F.max("p").alias("p"))
    fire = lambda t: most.where(F.col("p") >= t).withColumn("threshold", F.lit(t))
    return S.policy_decide(fire(0.9), fire(0.5))


@query(sql(SCORES, "SELECT id, raw, raw2, raw2 > 0 AND abs((raw - raw2) / raw2) > 0.3 AS off FROM scores"))
def divergent_thresholds(spark, sf_dir):
    return A.scores(spark, sf_dir).select("id", "raw", "raw2", S.divergent(F.col("raw"), F.col("raw2")).alias("off"))


@query(sql(_GRID, """SELECT file_type, route, level, CASE WHEN threshold <= 0.1 THEN 0.02 WHEN threshold >= 0.95 THEN 0.99 ELSE y + (threshold - x) / (x2 - x) * (y2 - y) END AS threshold FROM grid LEFT JOIN (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM (VALUES (0.1::DOUBLE, 0.02::DOUBLE), (0.3, 0.1), (0.5, 0.4), (0.8, 0.9), (0.95, 0.99)) t(x, y)) b ON threshold >= x AND threshold < x2 WHERE (SELECT count(*) FROM embeddings) > 0"""))
def calibrated_grid(spark, sf_dir):
    some = table(spark, sf_dir, "embeddings").agg((F.count(F.lit(1)) > 0).alias("some"))
    return S.calibrate_grid(grid(spark), breakpoints(spark)).crossJoin(F.broadcast(some)).where("some").drop("some")


@query(sql(SCORES, """, l AS (SELECT file_type, id % 5 AS k, avg(raw) AS threshold FROM scores GROUP BY ALL), t AS (SELECT file_type, max(CASE WHEN k = 2 THEN threshold END) AS h, max(CASE WHEN k = 4 THEN threshold END) AS s FROM l GROUP BY 1) SELECT file_type, 'general' AS route, round(coalesce(h, 0.9), 6) AS hostile, round(least(coalesce(h, 0.9), coalesce(s, 0.65)), 6) AS suspicious FROM t"""))
def default_thresholds(spark, sf_dir):
    levels = A.scores(spark, sf_dir).groupBy("file_type", (F.col("id") % 5).alias("level")).agg(F.avg("raw").alias("threshold")).withColumn("route", F.lit("general"))
    return S.thresholds_at(levels, 2, 4)


@query(sql(FINDINGS, """, d AS (SELECT DISTINCT report_id, file_id AS dep FROM findings), v AS (SELECT report_id, CASE WHEN max(crit) >= 5 THEN 2 ELSE 0 END AS class, max(conf) AS prob FROM findings GROUP BY 1) SELECT d.report_id, d.dep, v.class, v.prob, CASE WHEN v.report_id IS NOT NULL THEN -1 END AS level FROM d LEFT JOIN v ON v.report_id = d.dep"""))
def dependency_grades(spark, sf_dir):
    findings = A.findings(spark, sf_dir)
    verdicts = findings.groupBy("report_id").agg(F.when(F.max("crit") >= 5, 2).otherwise(0).alias("class"), F.max("conf").alias("prob"), F.lit(-1).alias("level"))
    return S.grade_deps(findings.select("report_id", F.col("file_id").alias("dep")).distinct(), verdicts)


@query("SELECT o_orderkey AS id, CASE WHEN f IS NULL OR a IS NULL THEN true ELSE least(cf, ca) + (1 - least(cf, ca)) * 0.33 >= greatest(cf, ca) - 1e-9 END AS near FROM (SELECT o_orderkey, f, a, CASE f WHEN -1 THEN 0.0 WHEN 0 THEN 1.0 WHEN 25 THEN 0.92 WHEN 500 THEN 0.78 WHEN 3000 THEN 0.54 WHEN 20000 THEN 0.33 END AS cf, CASE a WHEN 25 THEN 0.92 WHEN 5 THEN 0.95 END AS ca FROM (SELECT o_orderkey, [-1, 0, 25, 500, 3000, 20000, NULL][o_orderkey % 7 + 1] AS f, [25, 5, NULL][o_orderkey % 3 + 1] AS a FROM orders))")
def near_boundaries(spark, sf_dir):
    pick = lambda values, n: F.get(F.array(*[F.lit(v).cast("int") for v in values]), (F.col("o_orderkey") % n).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), G.near_boundary(pick((-1, 0, 25, 500, 3000, 20000, None), 7), pick((25, 5, None), 3)).alias("near"))


# ---- references

_TRIAGE = REFS + """, r AS (SELECT *, CASE WHEN part_id % 13 = 0 THEN 'a/node_modules/x/i.js' ELSE 'src/i.js' END AS path, 'pkg:npm/' || package || CASE WHEN part_id % 11 = 0 THEN '-win32-x64' ELSE '' END || substr(locator, 9 + length(package)) AS loc FROM refs),
f0 AS (SELECT *, CASE WHEN kind = 'url' THEN 'kind' WHEN part_id % 13 = 0 THEN 'vendored' WHEN part_id % 11 = 0 THEN 'platform' END AS fate, regexp_extract(loc, '^(.+)@[0-9][^@]*$', 1) AS pk, contains(loc, '@') AS versioned, p_size * 1000000 + l_linenumber * 1000 + patch AS k FROM r),
f1 AS (SELECT *, coalesce(fate, CASE WHEN versioned AND k < max(CASE WHEN versioned AND (fate IS NULL OR fate = 'platform') THEN k END) OVER (PARTITION BY pk) THEN 'older' END) AS fate1 FROM f0),
f2 AS (SELECT *, coalesce(fate1, CASE WHEN row_number() OVER (PARTITION BY loc, fate1 IS NULL ORDER BY report_id, file_id, pos, part_id) > 1 THEN 'repeated' END) AS fate2 FROM f1),
f3 AS (SELECT *, coalesce(fate2, CASE WHEN length(loc) % 5 = 0 THEN 'known_good' WHEN length(loc) % 7 = 0 THEN 'removed' WHEN length(loc) % 4 = 0 THEN 'aged_out' END) AS fate3 FROM f2)
SELECT coalesce(fate3, CASE WHEN bytes > 50000 THEN 'budget:bytes' ELSE 'kept' END) AS fate, kind, count(*) AS n, count(DISTINCT loc) AS locators FROM f3 GROUP BY ALL"""


@query(sql(_TRIAGE.split(", r AS", 1)[0], ", r AS" + _TRIAGE.split(", r AS", 1)[1]))
def job_triage_refs(spark, sf_dir):
    """How many references each gate stops."""
    tail = F.expr("substr(locator, 9 + length(package))")
    locator = F.concat(F.lit("pkg:npm/"), "package", F.when(F.col("part_id") % 11 == 0, "-win32-x64").otherwise(""), tail)
    rows = A.refs(spark, sf_dir).select("report_id", "file_id", "pos", F.col("part_id").alias("tie"), "kind", locator.alias("locator"), F.when(F.col("part_id") % 13 == 0, "a/node_modules/x/i.js").otherwise("src/i.js").alias("path"), "bytes", F.lit(False).alias("cached"))
    rows = stored_rows(rows)
    names = stored_rows(rows.select("locator").distinct())
    n, now = F.length("locator"), F.lit("2024-06-01").cast("timestamp")
    registry = names.select("locator", F.when(n % 4 == 0, F.lit("2020-01-01").cast("timestamp")).otherwise(F.lit("2024-05-28").cast("timestamp")).alias("published"), (n % 7 == 0).alias("removed"), F.lit(False).alias("security_hold"), F.lit(None).cast("string").alias("deprecated"), F.lit(False).alias("known_good"))
    out = J.triage_refs(rows, registry, now, "packages,deps", good=names.where(n % 5 == 0), per_file_bytes=50_000)
    return out.groupBy("fate", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("locator").alias("locators"))


@query(sql(REFS, "SELECT locator, CASE WHEN contains(substr(locator, 5), '@') THEN locator ELSE locator || '@9.' || max(p_size) END AS purl FROM refs GROUP BY 1"))
def resolved_purls(spark, sf_dir):
    rows = A.refs(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), "p_size"), "part_id").groupBy("locator").agg(F.concat(F.lit("9."), F.max("p_size")).alias("version"))
    return rows.select("locator", R.resolved_purl(F.col("locator"), F.col("version")).alias("purl"))


_LOCAL = """p AS (SELECT l_orderkey AS report_id, l_linenumber, lower(replace(p_brand, '#', '-')) AS package, 'app/d' || (l_suppkey % 3) AS dir FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query(sql(_LOCAL, """, roots AS (SELECT DISTINCT report_id, dir, package FROM p WHERE l_linenumber = 1), imp AS (SELECT DISTINCT report_id, dir || '/sub/i.js' AS path, 'pkg:npm/' || package AS locator, dir, package FROM p)
  SELECT i.report_id, i.path, i.locator, r.package IS NOT NULL AS local FROM imp i LEFT JOIN roots r USING (report_id, dir, package)"""))
def local_resolution(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table_rows(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey AS report_id", "l_linenumber", "lower(replace(p_brand, '#', '-')) AS package", "concat('app/d', l_suppkey % 3) AS dir")
    files = rows.where("l_linenumber = 1").selectExpr("report_id", "concat(dir, '/node_modules/', package, '/package.json') AS path")
    imports = rows.selectExpr("report_id", "concat(dir, '/sub/i.js') AS path", "concat('pkg:npm/', package) AS locator").distinct()
    return R.resolve_local(imports, files)


@query(sql(REFS, """, g AS (SELECT DISTINCT report_id, file_id AS sha, locator FROM refs WHERE kind = 'dependency'), h AS (SELECT DISTINCT report_id, (SELECT min(x.file_id) FROM refs x WHERE x.report_id = r.report_id) AS sha, locator FROM refs r WHERE kind = 'command') SELECT report_id, sha, locator FROM g UNION SELECT report_id, sha, locator FROM h"""))
def merged_groups(spark, sf_dir):
    refs = A.refs(spark, sf_dir)
    roots = refs.groupBy("report_id").agg(F.min("file_id").alias("root_sha"))
    return R.merge_root(refs.where("kind = 'dependency'").withColumn("sha", F.col("file_id")), refs.where("kind = 'command'").join(roots, "report_id"))


@query(sql(REFS, """, e AS (SELECT DISTINCT report_id, file_id, pos, part_id, ['ok', 'pin_mismatch', 'budget', 'unresolved', 'skipped', 'failed'][part_id % 6 + 1] AS o, part_id % 7 = 0 AS stale, part_id % 5 = 0 AS cached, part_id % 4 = 0 AS good, CASE WHEN part_id % 3 = 0 THEN 404 END AS status FROM refs)
  SELECT CASE WHEN o = 'pin_mismatch' THEN 'pin!' WHEN o = 'ok' AND stale THEN 'stale' WHEN o = 'ok' AND good THEN 'known' WHEN o = 'ok' AND cached THEN 'cache' WHEN o = 'ok' THEN 'live' WHEN o = 'budget' THEN 'budget' WHEN o = 'failed' THEN 'fail' ELSE 'skip' END AS label,
  CASE o WHEN 'pin_mismatch' THEN 'hash mismatch' WHEN 'budget' THEN 'over fetch budget' WHEN 'unresolved' THEN 'unresolved' WHEN 'skipped' THEN 'not a target' WHEN 'failed' THEN CASE WHEN status IS NULL THEN 'timed out' ELSE 'HTTP 404' END END AS detail, count(*) AS n FROM e GROUP BY ALL"""))
def fetch_labels(spark, sf_dir):
    rows = A.refs(spark, sf_dir).select("report_id", "file_id", "pos", "part_id").distinct()
    k = lambda n: F.col("part_id") % n
    o = F.get(F.array(*map(F.lit, ("ok", "pin_mismatch", "budget", "unresolved", "skipped", "failed"))), k(6).cast("int"))
    label, detail = R.outcome_label(o, k(5) == 0, k(7) == 0, F.when(k(4) == 0, "skip").otherwise("unknown"), F.when(k(3) == 0, 404), F.lit("timed out: after 3 tries"))
    return rows.groupBy(label.alias("label"), detail.alias("detail")).agg(F.count(F.lit(1)).alias("n"))


@query(sql(FINDINGS, FILES, """, n AS (SELECT report_id, parent_id AS artifact_id, file_id AS registry_id FROM files WHERE parent_id IS NOT NULL), g AS (SELECT DISTINCT report_id, file_id FROM findings WHERE crit >= 3), c AS (SELECT DISTINCT report_id, file_id FROM findings WHERE crit >= 3 AND pos % 2 = 0)
  SELECT DISTINCT n.* FROM n WHERE EXISTS (SELECT 1 FROM g WHERE g.report_id = n.report_id AND g.file_id = n.registry_id) OR EXISTS (SELECT 1 FROM c WHERE c.report_id = n.report_id AND c.file_id = n.artifact_id)"""))
def notable_provenance(spark, sf_dir):
    findings = A.findings(spark, sf_dir)
    nodes = A.files(spark, sf_dir).where("parent_id is not null").select("report_id", F.col("parent_id").alias("artifact_id"), F.col("file_id").alias("registry_id"))
    cited = findings.where("pos % 2 = 0").select("report_id", "file_id", "id").distinct().join(nodes.select("report_id", F.col("artifact_id").alias("file_id"), F.col("registry_id").alias("cites")), ["report_id", "file_id"])
    return R.notable_provenance(nodes, findings, cited)


@query(sql(REFS, "SELECT DISTINCT report_id, file_id, pos, part_id, kind FROM refs WHERE kind IN ('url', 'dependency')"))
def selected_refs(spark, sf_dir):
    return A.refs(spark, sf_dir).where(R.select_kinds(F.col("kind"), "urls, deps")).select("report_id", "file_id", "pos", "part_id", "kind").distinct()


@query("""WITH u AS (SELECT page_id, url, regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[/?#].*$', ''), '^.*@', '')), ':[0-9]+$', '') AS host FROM pages WHERE url IS NOT NULL)
  SELECT page_id, coalesce(host = 'example.com' OR ends_with(host, '.example.com'), false) OR page_id % 10 = 0 AS exception FROM u""")
def discovery_exceptions(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.concat("url", F.lit("#"), "page_id").alias("key"), "url")
    rows = pages.withColumn("host", R.norm_host(R.host_of(F.col("url"))))
    exact = pages.where("page_id % 10 = 0").select(F.col("key").alias("url"))
    return R.discovery_exception(rows.drop("url").withColumnRenamed("key", "url"), spark.createDataFrame([("example.com",)], "domain string"), exact).select("page_id", "exception")


# ---- known sets, audits, sources


@query(sql(POOL, """, k AS (SELECT kind, key, bool_or(label = 'good') AS g, bool_or(label = 'bad') AS b FROM keys GROUP BY ALL), e AS (SELECT purl, sha256 FROM pool),
  d AS (SELECT e.*, CASE WHEN s.b AND s.g OR p.b AND p.g THEN 'conflicted' WHEN s.b OR p.b THEN 'known_bad' WHEN s.g OR p.g THEN 'skip' ELSE 'unknown' END AS known FROM e LEFT JOIN k s ON s.kind = 'sha256' AND s.key = e.sha256 LEFT JOIN k p ON p.kind = 'purl' AND p.key = e.purl) SELECT known, count(*) AS n FROM d GROUP BY 1"""))
def known_edges(spark, sf_dir):
    pool = A.pool(spark, sf_dir)
    return K.edge_known(pool.select("purl", "sha256"), K.key_sets(pool)).groupBy("known").agg(F.count(F.lit(1)).alias("n"))


@query(sql(POOL, "SELECT count(*) AS rules FROM keys"))
def known_rules(spark, sf_dir):
    return K.rule_count(K.key_sets(A.pool(spark, sf_dir)).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")))


@query(sql(POOL, """, c AS (SELECT sha256(p_name) AS key FROM part WHERE p_partkey % 50 = 0) SELECT DISTINCT kind, key, label, 'canary' AS why FROM keys WHERE label = 'good' AND key IN (SELECT key FROM c) UNION ALL SELECT DISTINCT kind, key, label, 'vouched' FROM keys WHERE label = 'bad' AND key IN (SELECT sha256(p_name) FROM part WHERE p_partkey % 3 = 0)"""))
def unsafe_keys(spark, sf_dir):
    part, keys = table(spark, sf_dir, "part"), K.key_sets(A.pool(spark, sf_dir))
    canaries = part.where("p_partkey % 50 = 0").select(F.sha2("p_name", 256).alias("key"), F.lit("good").alias("label")).distinct()
    return K.unsafe_keys(keys, canaries, part.where("p_partkey % 3 = 0").select(F.sha2("p_name", 256).alias("key")).distinct())


@query(sql(POOL, """, known AS (SELECT kind, key, label FROM keys WHERE label = 'bad' OR (kind, key) NOT IN (SELECT kind, key FROM keys WHERE label = 'bad')) SELECT kind, label, count(*) AS keys, CAST(pow(2, greatest(6, ceil(log2(-count(*) * ln(1e-4) / (ln(2) * ln(2)))))) AS BIGINT) AS n_bits FROM known GROUP BY ALL"""))
def job_known_sets(spark, sf_dir):
    """Keys and size of each filter."""
    previous = spark.createDataFrame([], "kind string, label string, n long")
    keys, words, _ = J.build_known_sets(A.pool(spark, sf_dir), previous)
    sizes = words.groupBy("kind", "label").agg(F.max("n_bits").cast("long").alias("n_bits"))
    return keys.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("keys")).join(sizes, ["kind", "label"])


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderkey % 4 AS INT) END AS class FROM orders WHERE o_orderkey % 4 >= 2")
def shown_verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 < 3, (F.col("o_orderkey") % 4).cast("int")).alias("class"))
    return M.show(rows, (2,))


def _tiles(order: str) -> str:
    return f"SELECT o_orderkey AS id, CAST(ntile(7) OVER (ORDER BY {order}) AS INT) AS batch FROM orders"


@query(_tiles("floor(o_totalprice * 200) DESC, o_orderkey"))
def big_first_batches(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(floor(o_totalprice * 200) AS BIGINT) AS size")
    return M.batches(jobs, "big_first", 7).select("id", "batch")


@query(_tiles("o_orderkey"))
def fifo_batches(spark, sf_dir):
    return M.batches(table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CAST(floor(o_totalprice * 200) AS BIGINT) AS size"), "fifo", 7).select("id", "batch")


@query(sql(FILES, "SELECT report_id, file_id FROM files WHERE file_id % 3 <> 0"))
def own_files(spark, sf_dir):
    files = A.files(spark, sf_dir)
    return P.own_files(files, files.where("file_id % 3 <> 0").select("report_id", "sha256").distinct()).select("report_id", "file_id")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'a' || o_orderkey || '.tgz' ELSE 'pkg-1.' || o_orderkey END AS filename FROM orders""")
def artifact_filenames(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 3 = 0 THEN concat('https://h/x/a', o_orderkey, '.tgz?token=1') ELSE '' END AS url", "concat('pkg:npm/s/pkg@1.', o_orderkey) AS locator")
    return rows.select("id", P.artifact_filename(F.col("url"), F.col("locator")).alias("filename"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN 'r' || o_orderkey || ' s1 s2' ELSE 's1 s2' END AS urls FROM orders""")
def provenance_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("r"), "o_orderkey")).alias("url"))
    sources = F.array(F.lit("s1"), F.lit(""), F.lit("s2"), F.lit("s1"), F.lit(None).cast("string"))
    return rows.select("id", F.array_join(P.source_urls(F.col("url"), sources), " ").alias("urls"))


@query("""SELECT doc_id AS id, sha256(text) AS sha256, CASE WHEN octet_length(encode(text)) > 262144 THEN 'partial' ELSE 'full' END AS status, CASE WHEN octet_length(encode(text)) > 262144 THEN NULL ELSE length(text) END AS kept FROM documents WHERE text IS NOT NULL""")
def sidecars(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text is not null")
    made = rows.select("doc_id", P.sidecar(F.concat(F.lit("d"), "doc_id"), F.sha2("text", 256), F.col("text")).alias("j"))
    got = F.from_json("j", "artifact struct<sha256:string>, registry struct<status:string,raw:string>")
    return made.select(F.col("doc_id").alias("id"), got["artifact"]["sha256"].alias("sha256"), got["registry"]["status"].alias("status"), F.length(got["registry"]["raw"]).cast("long").alias("kept"))


@query("""WITH r AS (SELECT p_partkey AS id, p_name AS name, CAST(p_size AS VARCHAR) AS version, p_partkey % 4 AS k FROM part) SELECT id, CASE WHEN k < 3 THEN name END AS name, CASE WHEN k < 3 THEN version END AS version FROM r""")
def registry_records(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.lit("npm").alias("ecosystem"), F.col("p_name").alias("name"), F.col("p_size").cast("string").alias("version"))).alias("bare"))
    wrapped = F.concat(F.lit('{"record":'), "bare", F.lit("}"))
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.col("bare")).when(k == 1, wrapped).when(k == 2, F.concat(F.lit('{"registry":'), wrapped, F.lit("}"))).otherwise("no record")
    record = P.read_registry(text)
    return rows.select(F.col("p_partkey").alias("id"), record["name"].alias("name"), record["version"].alias("version"))


@query("""SELECT count(*) AS records, count(*) FILTER (p_partkey % 10 = 0) AS malformed, count(*) FILTER (p_partkey % 10 = 1) AS bad_sha, count(*) FILTER (p_partkey % 10 = 2) AS other_label FROM part""")
def pool_counts(spark, sf_dir):
    k = F.col("p_partkey") % 10
    sha = F.when(k == 1, "zz").otherwise(F.sha2("p_name", 256))
    line = F.to_json(F.struct(F.col("p_name").alias("purl"), sha.alias("sha256"), F.when(k == 2, "ugly").otherwise("good").alias("label")))
    return P.read_pool(table(spark, sf_dir, "part").select(F.when(k == 0, "{no json").otherwise(line).alias("value")))[1]


@query("SELECT conv_id, turn FROM conversations WHERE (length(text) % 100 >= 1 OR turn % 2 = 0) AND trim(text) <> ''")
def grade_candidates(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "text", "length(text) % 100 / 100 AS prob", "turn % 2 = 0 AS elevated")
    return G.needs_grade(rows).select("conv_id", "turn")


@query("SELECT conv_id, turn, ['benign', 'suspicious', 'hostile', NULL][length(text) % 4 + 1] AS grade, CASE WHEN length(text) % 4 < 3 THEN 'turn ' || turn END AS reason FROM conversations")
def parsed_grades(spark, sf_dir):
    word = F.get(F.array(*map(F.lit, ("benign", "suspicious", "hostile", "odd"))), (F.length("text") % 4).cast("int"))
    reply = F.concat(F.lit('Well: {"grade":"'), word, F.lit('","reason":" turn \\n  '), F.col("turn"), F.lit('"} so'))
    got = G.parse_grade(reply)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", got["grade"].alias("grade"), got["reason"].alias("reason"))


@query(sql(REFS, "SELECT report_id, file_id, pos, part_id FROM refs WHERE part_id % 4 <> 0"))
def vendored_refs(spark, sf_dir):
    path = F.when(F.col("part_id") % 4 == 0, "a\\node_modules\\b.js").otherwise("a/node_modules_x/b.js")
    return A.refs(spark, sf_dir).where(~R.is_vendored(path)).select("report_id", "file_id", "pos", "part_id")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN CAST(epoch(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (p_partkey % 500)) AS BIGINT) END AS published FROM part")
def self_dated(spark, sf_dir):
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + 3600 * (F.col("p_partkey") % 500)), "yyyyMMddHHmmss")
    purl = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("pkg:golang/x@v0.0.0-"), stamp, F.lit("-abcdefabcdef"))).otherwise("pkg:golang/x@v1.2.3")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.unix_timestamp(R.go_published(purl)).alias("published"))
