"""Queries of flows over several tables: tree ensembles, matching, closures, grafts, manifests and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.operators import audits as M
from siftspark.operators import findings as B
from siftspark.operators import refs as R
from siftspark.operators import trees as T
from siftspark.plans.audit_queries import _JOBS, jobs
from siftspark.plans.register import registrar
from siftspark.plans.sqltext import FILES, POOL, sql
from siftspark.session import table
from siftspark.sources import adapters as A
from siftspark.sources import reports as P

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

#: Three trees of all six modes for three classes: (tree, node, feature, mode, threshold, yes, no, missing goes to yes), (tree, node, class, weight).
_NODES = [
    (0, 0, 0, "BRANCH_LEQ", 0.0, 1, 2, True), (0, 1, 1, "BRANCH_GT", 1.0, 3, 4, False), (0, 2, 2, "BRANCH_EQ", 0.0, 5, 6, False), *[(0, k, 0, "LEAF", 0.0, 0, 0, False) for k in (3, 4, 5, 6)],
    (1, 0, 3, "BRANCH_NEQ", 1.0, 1, 2, False), (1, 1, 0, "BRANCH_LT", 1.0, 3, 4, True), *[(1, k, 0, "LEAF", 0.0, 0, 0, False) for k in (2, 3, 4)], (2, 0, 1, "BRANCH_GTE", 0.0, 1, 2, True), *[(2, k, 0, "LEAF", 0.0, 0, 0, False) for k in (1, 2)],
]
_LEAVES = [(0, 3, 0, 0.5), (0, 4, 1, 0.7), (0, 4, 2, -0.2), (0, 5, 1, -0.4), (0, 6, 2, 0.9), (1, 2, 0, -0.3), (1, 3, 1, 1.1), (1, 4, 2, 0.2), (2, 1, 1, 0.6), (2, 2, 0, 0.8)]
_BASE = [0.1, -0.2, 0.05]
_ENSEMBLE = """WITH x AS (SELECT vec_id AS id, CASE WHEN vec_id % 5 > 0 THEN round(4 * embedding[1]::DOUBLE) END AS a, CASE WHEN vec_id % 7 > 0 THEN round(4 * embedding[2]::DOUBLE) END AS b, round(4 * embedding[3]::DOUBLE) AS c, CASE WHEN vec_id % 3 > 0 THEN round(4 * embedding[4]::DOUBLE) END AS d FROM embeddings),
l AS (SELECT id, CASE WHEN a IS NULL OR a <= 0 THEN CASE WHEN b > 1 THEN 3 ELSE 4 END ELSE CASE WHEN c = 0 THEN 5 ELSE 6 END END AS t0, CASE WHEN d <> 1 THEN CASE WHEN a IS NULL OR a < 1 THEN 3 ELSE 4 END ELSE 2 END AS t1, CASE WHEN b IS NULL OR b >= 0 THEN 1 ELSE 2 END AS t2 FROM x),
s AS (SELECT id, exp(0.1 + CASE t0 WHEN 3 THEN 0.5 ELSE 0 END + CASE t1 WHEN 2 THEN -0.3 ELSE 0 END + CASE t2 WHEN 2 THEN 0.8 ELSE 0 END) AS e0, exp(-0.2 + CASE t0 WHEN 4 THEN 0.7 WHEN 5 THEN -0.4 ELSE 0 END + CASE t1 WHEN 3 THEN 1.1 ELSE 0 END + CASE t2 WHEN 1 THEN 0.6 ELSE 0 END) AS e1,
  exp(0.05 + CASE t0 WHEN 4 THEN -0.2 WHEN 6 THEN 0.9 ELSE 0 END + CASE t1 WHEN 4 THEN 0.2 ELSE 0 END) AS e2 FROM l) SELECT id, e1 / (e0 + e1 + e2) AS raw FROM s"""


def _cells(spark, sf_dir):
    at = lambda k, n: F.when(F.col("vec_id") % n > 0, F.round(4 * F.get("embedding", F.lit(k)).cast("double")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.array(at(0, 5), at(1, 7), F.round(4 * F.get("embedding", F.lit(2)).cast("double")), at(3, 3)).alias("features"))


def _ensemble():
    return T.ensemble(_NODES, _LEAVES, 4, 3, _BASE, "SOFTMAX")


@query(_ENSEMBLE)
def ensemble_scores(spark, sf_dir):
    return T.score(_cells(spark, sf_dir), _ensemble()).select("id", "raw")


@query(_ENSEMBLE)
def ensemble_scores_by_paths(spark, sf_dir):
    return T.score_by_paths(_cells(spark, sf_dir), _ensemble())


@query(sql(_JOBS, """, e AS (SELECT sha, epoch_ms(claimed) AS tm, 0 AS kind, id FROM jobs UNION ALL SELECT sha, epoch_ms(claimed) + ms - CASE WHEN id % 4 = 0 THEN 4000000000 ELSE 0 END, 1, id FROM jobs WHERE id % 3 > 0),
  p AS (SELECT *, sum(1 - 2 * kind) OVER w AS s, count(*) FILTER (kind = 0) OVER w AS c, count(*) FILTER (kind = 1) OVER w AS r FROM e WINDOW w AS (PARTITION BY sha ORDER BY tm, kind, id ROWS UNBOUNDED PRECEDING)),
  q AS (SELECT *, least(0, min(s) OVER (PARTITION BY sha ORDER BY tm, kind, id ROWS UNBOUNDED PRECEDING)) AS low FROM p), z AS (SELECT *, coalesce(lag(low) OVER (PARTITION BY sha ORDER BY tm, kind, id), 0) AS was FROM q)
  SELECT a.sha, a.id AS claim_id, b.id AS result_id FROM z a JOIN z b ON a.sha = b.sha AND a.kind = 0 AND b.kind = 1 AND b.low = b.was AND a.c = b.r + b.low"""))
def open_matches(spark, sf_dir):
    """Results of which a fourth come long before their claims."""
    rows = jobs(spark, sf_dir)
    ms = lambda c: F.unix_millis(c)
    results = rows.where("id % 3 > 0").select("sha", "id", (ms("claimed") + F.col("ms") - F.when(F.col("id") % 4 == 0, 4_000_000_000).otherwise(0)).alias("resulted"))
    return M.match_open(rows.select("sha", "id", ms("claimed").alias("claimed")), results).select("sha", "claim_id", "result_id")


# Each part is a locator that fetches a content; contents hold others, and ask for parts.
_GRAPH = """n AS (SELECT count(*) AS n FROM part), loc AS (SELECT p_partkey AS k, 'pkg:npm/p' || p_partkey AS locator, CASE p_partkey % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'pin_mismatch' ELSE 'ok' END AS outcome, 'c' || (p_partkey % 100) AS payload FROM part),
inn AS (SELECT DISTINCT 'c' || (p_partkey % 100) AS payload, 'm' || (p_size * 3) AS file FROM part), fnd AS (SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'c' || (p_partkey % 100) ELSE 'm' || (p_size * 3) END AS file, 'pkg:npm/p' || ((p_partkey * 7 + p_size) % n) AS locator FROM part, n WHERE p_partkey % 4 < 2),
rts AS (SELECT p_partkey % 20 AS report_id, 'f' || p_partkey AS source, 'pkg:npm/p' || p_partkey AS locator FROM part WHERE p_partkey % 50 = 0)"""
_HOP = "SELECT report_id, locator, min({'path': path, 'source': source}) AS b FROM (%s) GROUP BY ALL"
_NEXT = "SELECT h.report_id, i.file AS source, f.locator, list_append(h.path, f.locator) AS path FROM %s h JOIN (SELECT payload, file FROM inn UNION SELECT payload, payload FROM loc) i ON i.payload = h.payload JOIN fnd f ON f.file = i.file WHERE outcome IN ('ok', 'pin_mismatch')"
_GOT = "SELECT w.report_id, w.locator, %d AS hop, b.source AS source, payload, outcome, b.path AS path FROM (%s) w LEFT JOIN loc ON loc.locator = w.locator%s"
_CLOSED = f""", h0 AS ({_GOT % (0, _HOP % "SELECT report_id, source, locator, [locator] AS path FROM rts", "")}),
h1 AS ({_GOT % (1, _HOP % (_NEXT % "h0"), " WHERE (w.report_id, w.locator) NOT IN (SELECT report_id, locator FROM h0)")}),
h2 AS ({_GOT % (2, _HOP % (_NEXT % "h1"), " WHERE (w.report_id, w.locator) NOT IN (SELECT report_id, locator FROM h0 UNION ALL SELECT report_id, locator FROM h1)")})
SELECT report_id, locator, hop, source, payload, outcome, array_to_string(path, ' ') AS path FROM (FROM h0 UNION ALL FROM h1 UNION ALL FROM h2)"""


@query(sql(_GRAPH, _CLOSED))
def closed_references(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    n = part.agg(F.count(F.lit(1)).alias("n"))
    catalog = part.selectExpr("concat('pkg:npm/p', p_partkey) AS locator", "CASE p_partkey % 5 WHEN 0 THEN 'fail' WHEN 1 THEN 'pin_mismatch' ELSE 'ok' END AS outcome", "concat('c', p_partkey % 100) AS payload")
    members = part.selectExpr("concat('c', p_partkey % 100) AS payload", "concat('m', p_size * 3) AS file").distinct()
    found = part.where("p_partkey % 4 < 2").withColumn("n", n.scalar()).selectExpr("CASE WHEN p_partkey % 2 = 0 THEN concat('c', p_partkey % 100) ELSE concat('m', p_size * 3) END AS file", "concat('pkg:npm/p', (p_partkey * 7 + p_size) % n) AS locator").distinct()
    roots = part.where("p_partkey % 50 = 0").selectExpr("p_partkey % 20 AS report_id", "concat('f', p_partkey) AS source", "concat('pkg:npm/p', p_partkey) AS locator")
    out = R.close_refs(roots, catalog, members, found, 3)
    return out.withColumn("path", F.array_join("path", " "))


_REACHED = """WITH RECURSIVE n AS (SELECT count(*) AS n FROM part), e AS (SELECT DISTINCT p_partkey AS src, (p_partkey * 7 + p_size) % n AS dst FROM part, n), walk AS (SELECT src AS node, 0 AS hop FROM e WHERE src % 40 = 0 UNION SELECT dst, hop + 1 FROM walk JOIN e ON src = node WHERE hop < 3) SELECT node, CAST(min(hop) AS INT) AS hop FROM walk GROUP BY 1"""


@query(_REACHED)
def reached_by_recursion(spark, sf_dir):
    """Plain reachability as a recursive query."""
    part = table(spark, sf_dir, "part")
    part.withColumn("n", part.agg(F.count(F.lit(1))).scalar()).selectExpr("CAST(p_partkey AS BIGINT) AS src", "CAST((p_partkey * 7 + p_size) % n AS BIGINT) AS dst").distinct().createOrReplaceTempView("flow_edges")
    return spark.sql("WITH RECURSIVE walk(node, hop) AS (SELECT src, 0 FROM flow_edges WHERE src % 40 = 0 UNION ALL SELECT dst, hop + 1 FROM walk JOIN flow_edges ON src = node WHERE hop < 3) SELECT node, CAST(min(hop) AS INT) AS hop FROM walk GROUP BY node")


@query(sql(FILES, """, ed AS (SELECT report_id, k AS sub_id, CASE WHEN k = 1 THEN 'registry' ELSE 'fetched' END AS kind, CASE WHEN report_id % 2 = 0 THEN root_id ELSE NULL END AS under, 'pkg:npm/s' || k || '@' || report_id AS locator FROM roots, (VALUES (0), (1), (2)) v(k) WHERE report_id % 5 = 0),
  su AS (SELECT report_id, sub_id, kind, under, locator, f AS file_id, CASE WHEN f > 0 THEN 0 END AS parent_id, CASE WHEN f > 0 THEN 1 ELSE 0 END AS depth, 'x' || CASE f WHEN 0 THEN '' WHEN 1 THEN '!!y!!x' ELSE 'z' END AS path FROM ed, (VALUES (0), (1), (2)) v(f)),
  nx AS (SELECT report_id, max(file_id) + 1 AS next FROM files GROUP BY 1)
  SELECT report_id, file_id, parent_id, depth, path, NULL AS rel, NULL AS role, NULL AS via FROM files UNION ALL
  SELECT report_id, file_id + next + 3 * sub_id, coalesce(parent_id + next + 3 * sub_id, under, 0), depth + 1, CASE WHEN kind = 'registry' OR file_id = 2 THEN path ELSE locator || substr(path, 2) END,
  CASE WHEN file_id = 0 THEN kind END, CASE WHEN file_id = 0 AND kind = 'registry' THEN 'sidecar' END, CASE WHEN file_id = 0 AND kind = 'fetched' THEN CASE WHEN sub_id = 0 THEN 'https://h/' || report_id ELSE locator END END FROM su JOIN nx USING (report_id)"""))
def grafted_subtrees(spark, sf_dir):
    none = F.lit(None).cast("string")
    files = A.files(spark, sf_dir).select("report_id", "file_id", "parent_id", "depth", "path", "sha256", none.alias("rel"), none.alias("role"), none.alias("via"))
    roots = files.where("depth = 0 and report_id % 5 = 0").select("report_id", "sha256", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("sub_id"))
    edges = roots.select("report_id", "sub_id", F.when(F.col("sub_id") == 1, "registry").otherwise("fetched").alias("kind"), F.when(F.col("report_id") % 2 == 0, F.col("sha256")).otherwise("nowhere").alias("source"), F.concat(F.lit("pkg:npm/s"), "sub_id", F.lit("@"), "report_id").alias("locator"), F.when(F.col("sub_id") == 0, F.concat(F.lit("https://h/"), "report_id")).alias("resolved_url"))
    subs = roots.select("report_id", "sub_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("f"))
    subs = subs.selectExpr("report_id", "sub_id", "CAST(f AS BIGINT) AS file_id", "CASE WHEN f > 0 THEN 0L END AS parent_id", "CASE WHEN f > 0 THEN 1 ELSE 0 END AS depth", "concat('x', CASE f WHEN 0 THEN '' WHEN 1 THEN '!!y!!x' ELSE 'z' END) AS path", "concat('s', f) AS sha256", "CAST(NULL AS STRING) AS rel", "CAST(NULL AS STRING) AS role")
    return B.graft_subtrees(files, subs, edges).drop("sha256")


@query(sql(POOL, """, w AS (SELECT label AS stem, CAST(('0x' || substr(sha256, 1, 4)) AS BIGINT) % 9000 AS word, CAST(('0x' || substr(sha256, 5, 6)) AS BIGINT) AS b FROM pool), u AS (SELECT stem, word, bit_or(b) AS bits FROM w GROUP BY ALL),
  r AS (SELECT stem, word // 4096 AS r, sha256(string_agg(word || ':' || bits, ';' ORDER BY word)) AS h, count(*) AS words, sum(bit_count(bits)) AS ones FROM u GROUP BY ALL)
  SELECT stem, 'stem=' || stem AS file, 'v7' AS version, count(*) AS n, CAST(sum(words) AS BIGINT) AS words, CAST(sum(ones) AS BIGINT) AS ones, sha256(string_agg(h, '' ORDER BY r)) AS sha256 FROM r GROUP BY 1"""))
def filter_manifest(spark, sf_dir):
    hexed = lambda a, n: F.conv(F.substring("sha256", a, n), 16, 10).cast("long")
    words = A.pool(spark, sf_dir).select(F.col("label").alias("stem"), (hexed(1, 4) % 9000).alias("word"), hexed(5, 6).alias("b")).groupBy("stem", "word").agg(F.bit_or("b").alias("bits"))
    return P.bloom_manifest(words, "v7")


_FACTS = "p AS (SELECT p_partkey AS report_id, p_name, p_type, p_size FROM part)"


def _nested(spark, sf_dir):
    """A report for each part, with facts of all shapes as JSON."""
    lists = F.to_json(F.struct(
        F.array(F.array("p_type", F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("a"), F.array(F.struct(F.col("p_name").alias("name"))).alias("b"), F.array("p_brand").alias("c"),
    ))
    part = table(spark, sf_dir, "part").select("*", F.from_json(lists, "a string, b string, c string").alias("l"))
    entry = F.struct(F.lit(1).cast("long").alias("id"), F.to_json(F.struct(F.struct(F.col("p_size").alias("n"), (F.col("p_size") % 2 == 0).alias("even"), F.col("p_name").alias("s")).alias("binary"))).alias("metrics"), F.when(F.col("p_size") % 3 == 0, F.col("l.a")).when(F.col("p_size") % 3 == 1, F.col("l.b")).otherwise(F.col("l.c")).alias("imports"))
    nested = part.select(F.col("p_partkey").alias("report_id"), F.to_json(F.array(entry)).alias("files"))
    return P.flatten(nested.select("report_id", F.from_json("files", f"array<{P.FILE}>").alias("files")))


@query(sql("p AS (SELECT p_partkey AS report_id, p_name, p_type, p_brand, p_size FROM part)", "SELECT report_id, CASE WHEN p_size % 3 = 0 THEN p_type END AS lib, CASE p_size % 3 WHEN 0 THEN split_part(p_name, ' ', 1) WHEN 1 THEN p_name ELSE p_brand END AS name FROM p"))
def flattened_imports(spark, sf_dir):
    return _nested(spark, sf_dir)["imports"].select("report_id", "lib", "name")


@query(sql(_FACTS, "SELECT report_id, 'binary' AS g, 'n' AS f, CAST(p_size AS DOUBLE) AS v FROM p UNION ALL SELECT report_id, 'binary', 'even', CASE WHEN p_size % 2 = 0 THEN 1.0 ELSE 0.0 END FROM p"))
def flattened_metrics(spark, sf_dir):
    return _nested(spark, sf_dir)["metrics"].select("report_id", "g", "f", "v")
