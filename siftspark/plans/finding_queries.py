"""Queries on findings and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.operators import findings as B
from siftspark.operators import verdicts as S
from siftspark.plans.register import registrar
from siftspark.plans.sqltext import FILES, FINDINGS, FLOOR, PATHS, RISK, SUMMARIES, sql
from siftspark.session import table
from siftspark.sources import adapters as A

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)


def floor_verdicts(spark, sf_dir):
    """Verdicts of reports that a model found benign, raised by their findings."""
    found = A.findings(spark, sf_dir)
    start = found.select("report_id").distinct().select("report_id", F.lit(0).alias("class"), F.lit(0.0).alias("prob"), F.lit(-1).alias("level"))
    return S.trait_floor(start, found)


@query(sql(FINDINGS, SUMMARIES, FLOOR, """SELECT v.report_id, coalesce(n_active, 0) AS n_active, coalesce(notable, 0) AS notable, coalesce(suspicious, 0) AS suspicious, coalesce(hostile, 0) AS hostile, class, prob, level,
  CASE WHEN level < 0 THEN 0 WHEN level = 25 THEN 92 ELSE 54 END AS conf FROM verdicts v LEFT JOIN report_summary USING (report_id)"""))
def report_verdicts(spark, sf_dir):
    sums = B.report_summary(A.findings(spark, sf_dir)).select("report_id", "n_active", "notable", "suspicious", "hostile")
    rows = floor_verdicts(spark, sf_dir).join(sums, "report_id", "left").na.fill(0, ["n_active", "notable", "suspicious", "hostile"])
    return rows.withColumn("conf", S.level_conf(F.col("level")))


@query(sql(FINDINGS, PATHS, "SELECT * FROM file_path"))
def path_stats(spark, sf_dir):
    return B.path_stats(A.findings(spark, sf_dir))


@query(sql(FINDINGS, PATHS, "SELECT * FROM report_path"))
def report_paths(spark, sf_dir):
    return B.report_paths(A.findings(spark, sf_dir))


@query(sql(FINDINGS, SUMMARIES, "SELECT * FROM file_summary"))
def file_summary(spark, sf_dir):
    return B.file_summary(A.findings(spark, sf_dir))


@query(sql(FINDINGS, SUMMARIES, "SELECT * FROM report_summary"))
def report_summary(spark, sf_dir):
    return B.report_summary(A.findings(spark, sf_dir))


@query(sql(FINDINGS, PATHS, """SELECT report_id, count(DISTINCT CASE WHEN max_crit >= 2 THEN split_part(path, '/', 1) END) AS categories,
  count(DISTINCT CASE WHEN max_crit >= 4 THEN split_part(path, '/', 1) END) AS suspicious_categories, count(DISTINCT CASE WHEN max_crit >= 5 THEN split_part(path, '/', 1) END) AS hostile_categories FROM report_path GROUP BY 1"""))
def category_breadth(spark, sf_dir):
    return B.category_breadth(B.report_paths(A.findings(spark, sf_dir)))


@query(sql(FINDINGS, FILES, SUMMARIES, RISK, "SELECT * FROM risk"))
def file_risk(spark, sf_dir):
    return B.file_risk(A.files(spark, sf_dir), A.findings(spark, sf_dir))


@query(sql(FINDINGS, FILES, SUMMARIES, RISK, """SELECT report_id,
  arg_max(file_id, (round(suspicious_ratio, 9), round(suspicious, 9), round(hostile_ratio, 9), round(hostile, 9), -file_id)) AS suspicious_file,
  arg_max(file_id, (round(hostile_ratio, 9), round(hostile, 9), round(suspicious_ratio, 9), round(suspicious, 9), -file_id)) AS hostile_file,
  arg_max(file_id, (round(hostile_density + 0.25 * suspicious_density, 9), round(hostile_density, 9), round(suspicious_density, 9), -file_id)) AS weighted_file,
  max(hostile_density + 0.25 * suspicious_density) AS weighted_density FROM risk GROUP BY 1"""))
def top_risk(spark, sf_dir):
    return B.top_risk(B.file_risk(A.files(spark, sf_dir), A.findings(spark, sf_dir)))


@query(sql(FINDINGS, "SELECT report_id, file_id, array_to_string(list_sort(list_distinct(list(split_part(id, '::', 1)))), ' ') AS paths FROM active WHERE crit >= 3 GROUP BY ALL"))
def file_paths(spark, sf_dir):
    return B.file_paths(A.findings(spark, sf_dir)).withColumn("paths", F.array_join("paths", " "))


@query(sql(FINDINGS, FILES, """SELECT report_id, count(CASE WHEN crit = 5 THEN 1 END) AS hostile, count(CASE WHEN crit = 4 THEN 1 END) AS suspicious, count(CASE WHEN crit = 3 THEN 1 END) AS notable, count(CASE WHEN crit < 3 THEN 1 END) AS baseline
  FROM files LEFT JOIN findings USING (report_id, file_id) WHERE depth = 0 GROUP BY 1"""))
def finding_counts(spark, sf_dir):
    return B.finding_counts(A.findings(spark, sf_dir), A.files(spark, sf_dir))


@query(sql(FINDINGS, FLOOR, """, f AS (SELECT f.*, class, split_part(id, '::', 1) AS base, max(crit) OVER (PARTITION BY f.report_id) AS most FROM findings f JOIN verdicts USING (report_id) WHERE crit >= 4),
  g AS (SELECT *, row_number() OVER (PARTITION BY report_id, base ORDER BY pos, tie, file_id, id) AS k FROM f WHERE class < 2 OR most < 5 OR crit >= 5),
  h AS (SELECT report_id, id, crit, row_number() OVER (PARTITION BY report_id ORDER BY crit DESC, pos, tie, file_id, id) AS rank FROM g WHERE k = 1)
  SELECT report_id, rank, id, crit FROM h WHERE rank <= 5"""))
def top_findings(spark, sf_dir):
    return B.top_findings(A.findings(spark, sf_dir), floor_verdicts(spark, sf_dir))


@query(sql(FINDINGS, """SELECT report_id, file_id, rank, id, crit FROM (SELECT *, row_number() OVER (PARTITION BY report_id, file_id ORDER BY pos, tie, id) AS rank FROM findings WHERE crit >= 4) WHERE rank <= 3"""))
def member_top(spark, sf_dir):
    return B.member_top(A.findings(spark, sf_dir))


@query(sql(FINDINGS, FILES, """, c AS (SELECT report_id, file_id, CASE WHEN tie % 11 = 0 THEN file_id + 1 ELSE file_id END AS cites FROM findings)
  SELECT c.* FROM c LEFT JOIN files f ON c.report_id = f.report_id AND c.cites = f.file_id WHERE f.file_id IS NULL"""))
def reference_integrity(spark, sf_dir):
    cited = A.findings(spark, sf_dir).selectExpr("report_id", "file_id", "CASE WHEN tie % 11 = 0 THEN file_id + 1 ELSE file_id END AS cites")
    return B.integrity(A.files(spark, sf_dir), cited)


@query(sql(FINDINGS, FILES, """, r AS (SELECT *, row_number() OVER (PARTITION BY report_id ORDER BY risk DESC, file_id) AS rank FROM files)
  SELECT report_id, file_id, rank FROM r WHERE depth = 0 OR file_id = 0 OR rank <= 3 OR (report_id, file_id) IN (SELECT report_id, file_id FROM findings WHERE crit >= 3)"""))
def retained_files(spark, sf_dir):
    return B.retain(A.files(spark, sf_dir), A.findings(spark, sf_dir))


@query(sql(FILES, """, listing AS (SELECT report_id, sha256(report_id || '/' || ((file_id + 1) % 100)) AS sha256, 'x' || ((file_id + 1) % 100) AS path FROM files),
  new AS (SELECT l.report_id, l.sha256, min(l.path) AS path FROM listing l LEFT JOIN files f ON l.report_id = f.report_id AND l.sha256 = f.sha256 WHERE f.file_id IS NULL GROUP BY ALL),
  last AS (SELECT report_id, max(file_id) AS last, max(CASE WHEN depth = 0 THEN path END) AS root FROM files GROUP BY 1)
  SELECT report_id, file_id, path, sha256, risk, depth FROM files UNION ALL
  SELECT n.report_id, last + row_number() OVER (PARTITION BY n.report_id ORDER BY n.path, sha256), root || '!!' || n.path, sha256, -1, 1 FROM new n JOIN last USING (report_id)"""))
def listing_appended(spark, sf_dir):
    files = A.files(spark, sf_dir)
    listing = files.selectExpr("report_id", "sha2(concat(report_id, '/', (file_id + 1) % 100), 256) AS sha256", "concat('x', (file_id + 1) % 100) AS path")
    return B.append_listing(files, listing)


@query("""SELECT sha256, path, len(pids) AS pids, deleted FROM (SELECT sha256(text) AS sha256, min(source || '/' || doc_id) AS path, list(doc_id) AS pids, bool_or(doc_id % 10 = 0) AS deleted FROM documents WHERE text IS NOT NULL GROUP BY 1)""")
def content_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = docs.select(F.sha2("text", 256).alias("sha256"), F.concat("source", F.lit("/"), "doc_id").alias("path"), F.col("doc_id").alias("pid"), (F.col("doc_id") % 10 == 0).alias("deleted"))
    return B.group_by_content(rows).withColumn("pids", F.size("pids"))


@query(sql(FILES, """, last AS (SELECT report_id, max(file_id) AS last FROM files GROUP BY 1),
  subs AS (SELECT report_id, root_id AS under, k AS file_id, k AS depth, CASE WHEN k > 0 THEN 0 END AS parent_id, sha256(report_id || ':' || k) AS sha256 FROM roots, (VALUES (0), (1)) v(k) WHERE report_id % 5 = 0)
  SELECT report_id, file_id, depth, parent_id, sha256 FROM files UNION ALL
  SELECT report_id, file_id + last + 1, depth + 1, coalesce(parent_id + last + 1, under), sha256 FROM subs JOIN last USING (report_id)"""))
def grafted(spark, sf_dir):
    files = A.files(spark, sf_dir)
    roots = files.where("depth = 0 and report_id % 5 = 0")
    subs = roots.select("report_id", F.col("file_id").alias("under"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    subs = subs.selectExpr("report_id", "under", "CAST(k AS BIGINT) AS file_id", "k AS depth", "CASE WHEN k > 0 THEN 0L END AS parent_id", "sha2(concat(report_id, ':', k), 256) AS sha256")
    return B.graft(files, subs)


_OFFENDERS = """, m AS (SELECT f.report_id, f.file_id, max(conf) AS prob FROM findings f JOIN files g ON f.report_id = g.report_id AND f.file_id = g.file_id WHERE depth > 0 GROUP BY ALL),
  k AS (SELECT *, CAST(row_number() OVER (PARTITION BY report_id ORDER BY prob DESC, file_id) AS INT) AS rank FROM m) SELECT report_id, rank, file_id, prob FROM k WHERE rank <= 2"""


@query(sql(FINDINGS, FILES, _OFFENDERS))
def top_offenders(spark, sf_dir):
    inner = A.files(spark, sf_dir).where("depth > 0").select("report_id", "file_id")
    members = A.findings(spark, sf_dir).join(inner, ["report_id", "file_id"]).groupBy("report_id", "file_id").agg(F.max("conf").alias("prob"))
    return B.top_offenders(members, 2)


@query(sql(FINDINGS, FILES, "SELECT coalesce(parent_id, g.file_id) AS sub, id, crit, conf FROM findings f JOIN files g ON f.report_id = g.report_id AND f.file_id = g.file_id"))
def sub_findings(spark, sf_dir):
    subs = A.files(spark, sf_dir).select("report_id", "file_id", F.coalesce("parent_id", "file_id").alias("sub"))
    return B.sub_findings(A.findings(spark, sf_dir), subs)
