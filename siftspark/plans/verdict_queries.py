"""Queries on scores, verdicts and roll-ups."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from siftspark.operators import features as X
from siftspark.operators import findings as B
from siftspark.operators import verdicts as S
from siftspark.plans.finding_queries import floor_verdicts
from siftspark.plans.register import registrar
from siftspark.plans.sqltext import FILES, FINDINGS, FLOOR, SCORES, SUMMARIES, sql
from siftspark.session import table
from siftspark.sources import adapters as A

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

#: A calibrator, a level grid (not monotone at 50) and a blend, as a model has them.
BREAKPOINTS = ((0.1, 0.02), (0.3, 0.1), (0.5, 0.4), (0.8, 0.9), (0.95, 0.99))
LEVELS = ((0, 0.99), (5, 0.97), (10, 0.95), (50, 0.5), (100, 0.9), (500, 0.8), (3000, 0.6), (10000, 0.4), (25000, 0.3))
_BP = "bp AS (SELECT x, y, lead(x) OVER (ORDER BY x) AS x2, lead(y) OVER (ORDER BY x) AS y2 FROM (VALUES " + ", ".join(f"({x}::DOUBLE, {y}::DOUBLE)" for x, y in BREAKPOINTS) + ") v(x, y))"
_CAL = SCORES + """, """ + _BP + """, cal AS (SELECT id, file_type, raw, raw2, label, CASE WHEN raw <= 0.1 THEN 0.02 WHEN raw >= 0.95 THEN 0.99 ELSE y + (raw - x) / (x2 - x) * (y2 - y) END AS p FROM scores LEFT JOIN bp ON raw >= x AND raw < x2),
routed AS (SELECT id, file_type, 'general' AS route, p FROM cal UNION ALL SELECT id, file_type, 'filetypes/' || file_type, raw2 FROM cal WHERE file_type <> 'mystery')"""
_GRID = "grid AS (SELECT t AS file_type, r AS route, level, threshold FROM (VALUES " + ", ".join(f"({n}, {t}::DOUBLE)" for n, t in LEVELS) + ") v(level, threshold), (VALUES ('elf', 'general'), ('elf', 'filetypes/elf'), ('python', 'general'), ('python', 'filetypes/python'), ('mystery', 'general')) w(t, r))"


def breakpoints(spark):
    return spark.createDataFrame(list(BREAKPOINTS), "x double, y double")


def grid(spark):
    rows = [(t, r, n, p) for n, p in LEVELS for t, r in (("elf", "general"), ("elf", "filetypes/elf"), ("python", "general"), ("python", "filetypes/python"), ("mystery", "general"))]
    return spark.createDataFrame(rows, "file_type string, route string, level int, threshold double")


def routed(spark, sf_dir):
    """Calibrated general score and a specialist's score of each id."""
    cal = S.calibrate(A.scores(spark, sf_dir), breakpoints(spark))
    special = cal.where("file_type <> 'mystery'").select("id", "file_type", F.concat(F.lit("filetypes/"), "file_type").alias("route"), F.col("raw2").alias("p"))
    return cal.select("id", "file_type", F.lit("general").alias("route"), "p").unionByName(special)


@query(sql(_CAL, "SELECT id, file_type, raw, raw2, label, p FROM cal"))
def calibrated_scores(spark, sf_dir):
    return S.calibrate(A.scores(spark, sf_dir), breakpoints(spark))


@query(sql(SCORES, """, b AS (SELECT label AS name, id AS pos, raw AS x, raw2 AS y, lag(raw) OVER w AS px, lag(raw2) OVER w AS py FROM scores WINDOW w AS (PARTITION BY label ORDER BY id)) SELECT name, pos, x, y FROM b WHERE NOT (y BETWEEN 0 AND 1 AND coalesce(x > px, true) AND coalesce(y >= py, true))"""))
def invalid_breakpoints(spark, sf_dir):
    rows = A.scores(spark, sf_dir).select(F.col("label").alias("name"), F.col("id").alias("pos"), F.col("raw").alias("x"), F.col("raw2").alias("y"))
    return S.invalid_breakpoints(rows)


_GROUPS3 = "grp AS (SELECT * FROM (VALUES ('elf', 'native', true), ('pe', 'native', true), ('python', 'scripts', true), ('javascript', 'scripts', false), ('zip', 'archive', true), ('tar', 'archive', false)) v(t, grp, special)), cont AS (SELECT * FROM (VALUES ('apk', 'zip'), ('docx', 'zip')) v(t, container))"


@query(sql(FILES, _GROUPS3, """, k AS (SELECT report_id, file_id, coalesce(container, regexp_replace(lower(file_type), '(.)([.](gz|bz2|xz|zst|z|lzma))+$', '\\1')) AS t FROM (SELECT report_id, file_id, file_type || CASE WHEN file_id % 3 = 0 THEN '.GZ' ELSE '' END AS file_type FROM files) LEFT JOIN cont ON cont.t = regexp_replace(lower(file_type), '(.)([.](gz|bz2|xz|zst|z|lzma))+$', '\\1')),
  r AS (SELECT k.report_id, file_id, 'general' AS route FROM k UNION ALL SELECT report_id, file_id, 'filegroups/' || grp FROM k JOIN grp USING (t) UNION ALL SELECT report_id, file_id, 'filetypes/' || t FROM k JOIN grp USING (t) WHERE special) SELECT * FROM r"""))
def file_routes(spark, sf_dir):
    g = spark.createDataFrame([("elf", "native", True), ("pe", "native", True), ("python", "scripts", True), ("javascript", "scripts", False), ("zip", "archive", True), ("tar", "archive", False)], "t string, grp string, special boolean")
    c = spark.createDataFrame([("apk", "zip"), ("docx", "zip")], "t string, container string")
    files = A.files(spark, sf_dir).withColumn("file_type", F.concat("file_type", F.when(F.col("file_id") % 3 == 0, ".GZ").otherwise("")))
    return S.routes_for(files, g, c)


_SWEPT = """, fired AS (SELECT id, level, arg_max({'p': p, 't': threshold}, (p - threshold, p)) AS b FROM routed JOIN grid USING (file_type, route) WHERE p >= threshold GROUP BY ALL),
  swept AS (SELECT id, min(level) AS level, arg_min(b, level) AS b FROM fired GROUP BY 1)"""


@query(sql(_CAL, _GRID, _SWEPT + " SELECT id, level, b.p AS p, b.t AS threshold FROM swept"))
def level_sweep(spark, sf_dir):
    return S.sweep(routed(spark, sf_dir), grid(spark))


@query(sql(_CAL, _GRID, _SWEPT + """, most AS (SELECT id, max(p) FILTER (route = 'general') AS prob FROM routed GROUP BY 1) SELECT id, coalesce(b.p, prob) AS prob, coalesce(level, -1) AS level, CASE WHEN level IS NULL THEN 0 WHEN level <= 25 THEN 2 WHEN level <= 3000 THEN 1 ELSE 0 END AS class FROM most LEFT JOIN swept USING (id)"""))
def decisions(spark, sf_dir):
    return S.decide(routed(spark, sf_dir), grid(spark))


@query(sql(_CAL, """, b AS (SELECT id, sum(w * ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p))))) AS s, count(*) AS n FROM routed JOIN (VALUES ('elf', 'general', 0.7), ('elf', 'filetypes/elf', 0.5), ('mystery', 'general', 1.0), ('mystery', 'filetypes/mystery', 1.0)) v(file_type, route, w) USING (file_type, route) GROUP BY 1)
  SELECT id, 10 AS level, round(1 / (1 + exp(-(0.1 + s))), 6) AS p, 0.4 AS threshold FROM b WHERE n = 2 AND 1 / (1 + exp(-(0.1 + s))) >= 0.4"""))
def blend_fired(spark, sf_dir):
    rows = [("elf", 10, "general", 0.7, 0.1, 0.4, 2), ("elf", 10, "filetypes/elf", 0.5, 0.1, 0.4, 2), ("mystery", 10, "general", 1.0, 0.1, 0.4, 2), ("mystery", 10, "filetypes/mystery", 1.0, 0.1, 0.4, 2)]
    blend = spark.createDataFrame(rows, "file_type string, level int, route string, weight double, intercept double, threshold double, n_routes int")
    return S.fire_blend(routed(spark, sf_dir), blend).withColumn("p", F.round("p", 6))


#: The table of confidences, written out once more.
_CONF = """CASE WHEN n IS NULL THEN NULL WHEN n < 0 THEN 0 WHEN n <= 5 THEN 100 - n WHEN n <= 10 THEN 94 WHEN n <= 100 THEN 95 - CAST(ceil(n / 10) AS INT) WHEN n <= 200 THEN 82 WHEN n <= 300 THEN 80 WHEN n <= 500 THEN 78 WHEN n <= 1000 THEN 75 WHEN n <= 2000 THEN 66 WHEN n <= 5000 THEN 54
  WHEN n <= 7500 THEN 49 WHEN n <= 10000 THEN 45 WHEN n <= 15000 THEN 38 WHEN n <= 20000 THEN 33 WHEN n <= 25000 THEN 29 WHEN n = 25001 THEN 28 WHEN n = 25002 THEN 27 WHEN n <= 49999 THEN 26 WHEN n = 50000 THEN 17 WHEN n = 50001 THEN 16 ELSE 15 END"""


@query(f"SELECT o_orderkey AS id, n AS level, CAST({_CONF} AS INT) AS conf FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderkey * 7 % 60000 AS INT) - 100 END AS n FROM orders)")
def level_confidence(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(o_orderkey * 7 % 60000 AS INT) - 100 END AS level")
    return rows.withColumn("conf", S.level_conf(F.col("level")))


_MEMBERS = """, m AS (SELECT f.report_id, f.file_id, CASE WHEN max(crit) >= 5 AND count(*) >= 2 THEN 2 WHEN max(crit) >= 4 THEN 1 ELSE 0 END AS class, max(conf) AS prob FROM findings f JOIN files g ON f.report_id = g.report_id AND f.file_id = g.file_id WHERE depth > 0 GROUP BY ALL)"""


def members(spark, sf_dir):
    """Verdicts of the files below the roots, by their own findings."""
    c = F.when((F.max("crit") >= 5) & (F.count(F.lit(1)) >= 2), 2).when(F.max("crit") >= 4, 1).otherwise(0)
    inner = S.first_members(A.files(spark, sf_dir)).select("report_id", "file_id")
    return A.findings(spark, sf_dir).join(inner, ["report_id", "file_id"]).groupBy("report_id", "file_id").agg(c.alias("class"), F.max("conf").alias("prob"))


@query(sql(FINDINGS, FILES, _MEMBERS + " SELECT report_id, (w).file_id AS worst, (w).class AS worst_class, (w).prob AS worst_prob FROM (SELECT report_id, arg_max({'file_id': file_id, 'class': class, 'prob': prob}, (class, prob, -file_id)) AS w FROM m GROUP BY 1)"))
def worst_members(spark, sf_dir):
    return S.outrank(members(spark, sf_dir))


@query(sql(FINDINGS, FILES, FLOOR, _MEMBERS + """, w AS (SELECT report_id, arg_max({'file_id': file_id, 'class': class, 'prob': prob}, (class, prob, -file_id)) AS w FROM m GROUP BY 1),
  e AS (SELECT v.*, w, w IS NOT NULL AND ((w).class, (w).prob) > (v.class, v.prob) AS up FROM verdicts v LEFT JOIN w USING (report_id))
  SELECT report_id, CASE WHEN up THEN (w).class ELSE class END AS class, CASE WHEN up THEN (w).prob ELSE prob END AS prob, CASE WHEN up THEN (w).file_id END AS from_member FROM e"""))
def elevated_verdicts(spark, sf_dir):
    return S.elevate(floor_verdicts(spark, sf_dir), members(spark, sf_dir))


#: Two small trees over the embedding: (feature, threshold, left, right, value).
TREES = {"base": -0.2, "trees": [[(0, 0.0, 1, 2, 0.0), (-1, 0.0, 0, 0, -0.5), (5, 0.1, 3, 4, 0.0), (-1, 0.0, 0, 0, 0.3), (-1, 0.0, 0, 0, 0.9)], [(2, -0.05, 1, 2, 0.0), (-1, 0.0, 0, 0, 0.4), (-1, 0.0, 0, 0, -0.1)]]}
_TREE_SQL = "SELECT vec_id AS id, round(1 / (1 + exp(-(-0.2 + CASE WHEN embedding[1] <= 0 THEN -0.5 WHEN embedding[6] <= 0.1::DOUBLE THEN 0.3 ELSE 0.9 END + CASE WHEN embedding[3] <= -0.05::DOUBLE THEN 0.4 ELSE -0.1 END))), 6) AS raw FROM embeddings"


@query(_TREE_SQL)
def tree_scores(spark, sf_dir):
    return S.score_trees(table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "features"), TREES).select(F.col("vec_id").alias("id"), F.round("raw", 6).alias("raw"))


@query(_TREE_SQL)
def tree_scores_sql(spark, sf_dir):
    return S.score_trees_sql(table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "features"), TREES).select(F.col("vec_id").alias("id"), F.round("raw", 6).alias("raw"))


@query(sql(FINDINGS, SUMMARIES, """, f AS (SELECT report_id, unnest(['ext:third_party_max_crit', 'ext:third_party_count', 'ext:well_known_max_crit', 'ext:well_known_hostile_count']) AS name, unnest([max_third_party::DOUBLE, ln(1 + n_third_party), max_well_known::DOUBLE, well_known_hostile::DOUBLE]) AS value FROM report_summary),
  g AS (SELECT f.*, row_number() OVER (PARTITION BY report_id ORDER BY importance DESC, name) AS rank FROM f JOIN (VALUES ('ext:third_party_max_crit', 3.0), ('ext:well_known_max_crit', 2.0), ('ext:well_known_hostile_count', 2.0)) v(name, importance) USING (name) WHERE value <> 0) SELECT report_id, rank, name, 'external: ' || replace(substr(name, 5), '_', ' ') AS said, value FROM g WHERE rank <= 2"""))
def explained(spark, sf_dir):
    names = ["ext:third_party_max_crit", "ext:well_known_max_crit", "ext:well_known_hostile_count"]
    importance = spark.createDataFrame([(n, w) for n, w in zip(names, (3.0, 2.0, 2.0), strict=True)], "name string, importance double")
    listed = spark.createDataFrame(list(enumerate(names)), "pos int, name string")
    digest = hashlib.sha256("\n".join(names).encode()).hexdigest()
    return S.explain(X.external(A.findings(spark, sf_dir)), S.importance_matches(importance, listed, digest), 2).withColumn("said", S.describe(F.col("name")))


@query(sql(_CAL, "SELECT id, CASE WHEN p >= 0.7 THEN (p - 0.7) / 0.3 ELSE p / 0.7 END AS progress FROM cal"))
def score_bands(spark, sf_dir):
    p, t = F.col("p"), F.lit(0.7)
    return S.calibrate(A.scores(spark, sf_dir), breakpoints(spark)).select("id", S.band_progress(p, F.when(p >= t, 1).otherwise(0), t).alias("progress"))


@query(sql(_CAL, """SELECT id, round(ln(p / (1 - p)) - ln(0.4 / 0.6), 6) AS margin, round(CASE WHEN p < 0.4 THEN 0.5 * p / 0.4 ELSE 0.5 + 0.5 * (p - 0.4) / 0.6 END, 6) AS shown FROM cal"""))
def score_margins(spark, sf_dir):
    cal = S.calibrate(A.scores(spark, sf_dir), breakpoints(spark))
    return cal.select("id", F.round(S.logit_margin(F.col("p"), F.lit(0.4)), 6).alias("margin"), F.round(S.display_p(F.col("p"), F.lit(0.4)), 6).alias("shown"))
