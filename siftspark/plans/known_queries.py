"""Queries on known sets and on references."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.operators import knownsets as K
from siftspark.operators import refs as R
from siftspark.plans.finding_queries import floor_verdicts
from siftspark.plans.register import registrar
from siftspark.plans.sqltext import FILES, FINDINGS, FLOOR, POOL, REFS, sql
from siftspark.session import table
from siftspark.sources import adapters as A

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)


@query(sql(POOL, "SELECT kind, key, label FROM keys"))
def key_sets(spark, sf_dir):
    return K.key_sets(A.pool(spark, sf_dir))


_SUB = """, known AS (SELECT kind, key, label FROM keys WHERE label = 'bad' OR (kind, key) NOT IN (SELECT kind, key FROM keys WHERE label = 'bad'))"""


@query(sql(POOL, _SUB + " SELECT * FROM known"))
def known_sets(spark, sf_dir):
    return K.subtract(K.key_sets(A.pool(spark, sf_dir)))


HASHES, BITS = 7, 1 << 16


@query(sql(POOL, """, d AS (SELECT key, sha256(key) AS h FROM keys WHERE label = 'good' GROUP BY key),
  l AS (SELECT key, (('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2))::BIGINT) & 65535 AS a, ((('0x' || substr(h, 23, 2) || substr(h, 21, 2) || substr(h, 19, 2) || substr(h, 17, 2))::BIGINT) & 65535) | 1 AS b FROM d),
  x AS (SELECT (a + i * b) & 65535 AS bit FROM l, range(7) t(i)) SELECT bit // 64 AS word, count(DISTINCT bit) AS ones FROM x GROUP BY 1"""))
def bloom_words(spark, sf_dir):
    good = K.key_sets(A.pool(spark, sf_dir)).where("label = 'good'").select("key").distinct()
    return K.bloom_build(good, HASHES, BITS).select("word", F.bit_count("bits").cast("long").alias("ones"))


_ART = "art AS (SELECT p_partkey AS id, sha256(p_name || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END) AS key FROM part)"


def artifacts(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "sha2(concat(p_name, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END), 256) AS key", "timestampadd(HOUR, CAST(p_partkey % 100 AS INT), timestamp'2024-01-01 00:00:00') AS touched")


@query(sql(POOL, _ART, "SELECT id, key, key IN (SELECT key FROM keys WHERE label = 'good' AND kind = 'sha256') AS maybe FROM art"))
def bloom_members(spark, sf_dir):
    good = K.key_sets(A.pool(spark, sf_dir)).where("label = 'good' and kind = 'sha256'").select("key").distinct()
    hashes, bits = K.bloom_params(good.count())
    return K.might_contain(artifacts(spark, sf_dir).select("id", "key"), K.bloom_build(good, hashes, bits), hashes, bits)


_DEC = """, d AS (SELECT id, key, key IN (SELECT key FROM keys WHERE label = 'good') AS g, key IN (SELECT key FROM keys WHERE label = 'bad') AS b, id % 100 AS hour FROM art),
  dec AS (SELECT id, CASE WHEN b AND g THEN 'conflicted' WHEN b THEN 'known_bad' WHEN g THEN 'skip' ELSE 'unknown' END AS decision, hour FROM d),
  gated AS (SELECT id, decision, NOT (decision = 'skip' AND hour < 51) AS scan FROM dec)"""


def gated(spark, sf_dir):
    keys = K.key_sets(A.pool(spark, sf_dir)).where("kind = 'sha256'")
    return K.gate(K.decide(artifacts(spark, sf_dir), keys), "balanced", "touched", F.to_timestamp(F.lit("2024-01-05 03:00:00")))


@query(sql(POOL, _ART, _DEC + " SELECT id, decision, scan FROM gated"))
def known_gate(spark, sf_dir):
    return gated(spark, sf_dir).select("id", "decision", "scan")


@query(sql(POOL, _ART, _DEC + " SELECT count(CASE WHEN decision = 'skip' AND NOT scan THEN 1 END) AS skipped, count(CASE WHEN decision = 'known_bad' THEN 1 END) AS flagged, count(CASE WHEN decision = 'conflicted' THEN 1 END) AS conflicted, count(CASE WHEN decision = 'unknown' AND NOT scan THEN 1 END) AS unscanned FROM gated"))
def gate_tally(spark, sf_dir):
    return K.tally(gated(spark, sf_dir))


@query(sql(POOL, """, n AS (SELECT kind, label, count(*) AS n FROM keys GROUP BY ALL), p AS (SELECT kind, label, CASE WHEN label = 'good' THEN n * 3 + 1000 ELSE n // 4 + 1000 END AS was FROM n)
  SELECT * FROM (SELECT p.kind, p.label, was, n, CASE WHEN n = 0 THEN 'empty' WHEN n < 0.5 * was THEN 'shrunk' WHEN n > 3 * was THEN 'grown' END AS why FROM p JOIN n USING (kind, label) WHERE was >= 1000) WHERE why IS NOT NULL"""))
def build_violations(spark, sf_dir):
    now = K.key_sets(A.pool(spark, sf_dir)).groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))
    before = now.select("kind", "label", F.expr("CASE WHEN label = 'good' THEN n * 3 + 1000 ELSE n div 4 + 1000 END").alias("n"))
    return K.verify_build(now, before)


_HOSTS = r"""h AS (SELECT page_id, url, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '[/?#].*$', '', 's'), '^.*@', ''), ':\d+$', ''), '\.$', '')) AS host FROM pages)"""


@query(sql(_HOSTS, """SELECT page_id, host, (host = 'example.org' OR host LIKE '%.example.org' OR host = 'example.com' OR host LIKE '%.example.com') AND NOT (host = 'www.example.com' OR host LIKE '%.www.example.com') AS publisher FROM h"""))
def url_publishers(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", R.norm_host(R.host_of(F.col("url"))).alias("host"))
    one = lambda *d: spark.createDataFrame([(x,) for x in d], "domain string")
    return R.publisher(pages, one("example.org", "example.com"), one("www.example.com")).select("page_id", "host", "publisher")


_SHAPES = ("https://a.org/releases/v1/{}", "http://b.net/x/{}.exe?y=1", "ftp://c.org/downloads/{}", "https://d.org/{}.html", "https://e.org/a/{}.PDF", "https://f.org/raw/x/p{}", "https://api.g.io/v1/d{}.bin", "https://api.h.io/file/b/d{}.bin", "https://i.org/a/.f{}", "https://j.org/dl/p{}", "https://k.org/search/d{}.tgz", "HTTPS://l.org/download", "https://m.org?x={}/a.exe")


@query(r"""WITH u AS (SELECT page_id, CASE WHEN page_id % 14 = 13 THEN url ELSE replace([""" + ", ".join(f"'{s}'" for s in _SHAPES) + r"""][page_id % 14 + 1], '{}', CAST(page_id AS VARCHAR)) END AS url FROM pages),
  p AS (SELECT page_id, url, list_filter(string_split(regexp_extract(url, '^[^:]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts, regexp_matches(url, '^(?i)https?://[^/?#]') AS web, lower(regexp_extract(url, '://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM u),
  q AS (SELECT *, lower(coalesce(parts[-1], '')) AS name, list_transform(parts, lambda x: lower(x)) AS low FROM p), r AS (SELECT *, CASE WHEN strpos(substr(name, 2), '.') > 0 THEN string_split(name, '.')[-1] ELSE '' END AS ext, list_has_any(low, ['archive', 'archives', 'attachment', 'attachments', 'blob', 'download', 'downloads', 'file', 'files', 'raw', 'release', 'releases', 'resolve']) AS said FROM q)
  SELECT page_id, url, coalesce(web AND name NOT IN ('', '.', '..') AND (regexp_full_match(ext, '[a-z0-9]{1,12}') AND ext NOT IN ('asp', 'aspx', 'atom', 'avif', 'bmp', 'cfm', 'cgi', 'css', 'csv', 'dtd', 'gif', 'htm', 'html', 'ico', 'jpeg', 'jpg', 'json', 'log', 'md', 'pdf', 'php', 'png', 'rss', 'svg', 'txt', 'webmanifest', 'webp', 'xml', 'xhtml', 'yaml', 'yml')
    OR NOT contains(name, '.') AND said AND len(parts) >= 2) AND (said OR NOT (string_split(host, '.')[1] = 'api' OR list_has_any(low, ['api', 'graphql', 'health', 'lookup', 'metrics', 'oauth', 'query', 'rpc', 'search', 'status', 'token']))), false) AS download FROM r""")
def download_urls(spark, sf_dir):
    shapes = F.array(*map(F.lit, _SHAPES))
    made = F.replace(F.get(shapes, (F.col("page_id") % 14).cast("int")), F.lit("{}"), F.col("page_id").cast("string"))
    rows = table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 14 == 13, F.col("url")).otherwise(made).alias("url"))
    return rows.withColumn("download", R.looks_like_download(F.col("url")))


@query(sql(REFS, """, v AS (SELECT *, contains(locator, '@') AS has FROM refs), m AS (SELECT package, max((p_size, l_linenumber, patch)) AS best FROM v WHERE has GROUP BY 1)
  SELECT v.locator, count(*) AS n FROM v LEFT JOIN m USING (package) WHERE NOT has OR (p_size, l_linenumber, patch) = best GROUP BY 1"""))
def newest_refs(spark, sf_dir):
    return R.newest_only(A.refs(spark, sf_dir)).groupBy("locator").agg(F.count(F.lit(1)).alias("n"))


@query(sql(REFS, "SELECT locator, o.report_id AS report_id, o.file_id AS file_id, o.pos AS pos, o.part_id AS part_id FROM (SELECT locator, min({'report_id': report_id, 'file_id': file_id, 'pos': pos, 'part_id': part_id}) AS o FROM refs GROUP BY 1)"))
def first_refs(spark, sf_dir):
    return R.first_seen(A.refs(spark, sf_dir), ["report_id", "file_id", "pos", "part_id"])


@query("""WITH r AS (SELECT o_orderkey AS id, o_orderdate AS published, o_orderkey % 29 = 0 AS removed, o_orderkey % 31 = 0 AS hold, o_orderkey % 2 = 0 AS good, (SELECT max(o_orderdate) FROM orders) + INTERVAL 1 DAY AS now FROM orders)
  SELECT id, CASE WHEN removed THEN 'removed' WHEN published <= now - INTERVAL 700 DAYS THEN 'aged_out' WHEN good AND NOT (hold OR published >= now - INTERVAL 48 HOURS) THEN 'known_good' ELSE 'keep' END AS reason FROM r""")
def age_gated(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    now = orders.agg(F.max(F.col("o_orderdate").cast("timestamp")) + F.expr("INTERVAL 1 DAY")).scalar()
    reg = orders.selectExpr("concat('o', o_orderkey) AS locator", "CAST(o_orderdate AS TIMESTAMP) AS published", "o_orderkey % 29 = 0 AS removed", "o_orderkey % 31 = 0 AS security_hold", "CAST(NULL AS STRING) AS deprecated", "o_orderkey % 2 = 0 AS known_good")
    refs = orders.selectExpr("o_orderkey AS id", "concat('o', o_orderkey) AS locator").withColumn("now", now)
    return R.age_gate(refs, reg, F.col("now"), 700).select("id", "reason")


@query(sql(REFS, "SELECT DISTINCT report_id, package FROM refs WHERE kind = 'command' AND (report_id, package) NOT IN (SELECT report_id, package FROM refs WHERE kind = 'dependency')"))
def undeclared_packages(spark, sf_dir):
    return R.undeclared(A.refs(spark, sf_dir)).select("report_id", "package")


@query(sql(REFS, """, b AS (SELECT report_id % 500 AS r, file_id % 10 AS f, kind, bytes, part_id % 5 = 0 AS cached, row_number() OVER (PARTITION BY report_id % 500, file_id % 10 ORDER BY report_id, pos, part_id, file_id, bytes) AS pos FROM refs),
  s AS (SELECT *, sum(CASE WHEN NOT cached AND kind <> 'url' THEN 1 ELSE 0 END) OVER w AS n, sum(CASE WHEN NOT cached AND kind = 'url' THEN 1 ELSE 0 END) OVER w AS u, sum(CASE WHEN NOT cached THEN bytes ELSE 0 END) OVER w AS z FROM b WINDOW w AS (PARTITION BY r, f ORDER BY pos ROWS UNBOUNDED PRECEDING))
  SELECT r AS report_id, f AS file_id, pos, CASE WHEN cached THEN NULL WHEN kind = 'url' AND u > 2 THEN 'urls' WHEN kind <> 'url' AND n > 4 THEN 'refs' WHEN z > 300000 THEN 'bytes' END AS budget FROM s"""))
def budgeted_refs(spark, sf_dir):
    rows = A.refs(spark, sf_dir).selectExpr("report_id % 500 AS r", "file_id % 10 AS f", "*")
    rows = rows.select(F.col("r"), F.col("f"), "kind", "bytes", (F.col("part_id") % 5 == 0).alias("cached"), F.lit(0).alias("tie"), F.expr("row_number() OVER (PARTITION BY r, f ORDER BY report_id, pos, part_id, file_id, bytes)").alias("pos")).withColumnsRenamed({"r": "report_id", "f": "file_id"})
    return R.apply_budget(rows, per_file=4, per_file_urls=2, per_file_bytes=300_000).select("report_id", "file_id", "pos", "budget")


_EDGES = "e AS (SELECT DISTINCT CAST(p_partkey AS BIGINT) AS src, CAST((p_partkey * 7 + p_size) % (SELECT count(*) FROM part) AS BIGINT) AS dst FROM part)"


@query(sql(_EDGES, """, r AS (SELECT DISTINCT src AS locator FROM e WHERE src % 40 = 0), h1 AS (SELECT DISTINCT dst FROM e WHERE src IN (SELECT locator FROM r) AND dst NOT IN (SELECT locator FROM r)),
  h2 AS (SELECT DISTINCT dst FROM e WHERE src IN (SELECT dst FROM h1) AND dst NOT IN (SELECT locator FROM r) AND dst NOT IN (SELECT dst FROM h1)) SELECT locator, 0 AS hop FROM r UNION ALL SELECT dst, 1 FROM h1 UNION ALL SELECT dst, 2 FROM h2"""))
def reference_closure(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    n = part.count()
    edges = part.select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + F.col("p_size")) % n).alias("dst")).distinct()
    return R.closure(edges.where("src % 40 = 0").select(F.col("src").alias("locator")), edges)


@query(sql(FINDINGS, FILES, FLOOR, """, bad AS (SELECT f.report_id, path, 2 AS class, 'dep' || (f.report_id % 7) AS locator FROM files f JOIN verdicts v USING (report_id) WHERE v.class = 2 AND depth > 0),
  up AS (SELECT report_id, path, class, locator FROM bad UNION ALL SELECT report_id, split_part(path, '!!', 1), class, locator FROM bad)
  SELECT u.report_id, file_id, locator, max(class) + 3 AS crit FROM up u JOIN files f ON u.report_id = f.report_id AND u.path = f.path GROUP BY ALL"""))
def dependency_backrefs(spark, sf_dir):
    files = A.files(spark, sf_dir)
    bad = files.join(floor_verdicts(spark, sf_dir).where("class = 2").select("report_id", "class"), "report_id").where("depth > 0")
    return R.backrefs(files, bad.select("report_id", "path", "class", F.concat(F.lit("dep"), F.col("report_id") % 7).alias("locator")))


@query(sql(FILES, """, f AS (SELECT report_id, file_id, parent_id, CASE WHEN file_id % 4 = 0 THEN 'fetched' END AS rel FROM files) SELECT a.report_id, a.file_id, CASE WHEN a.rel = 'fetched' THEN a.file_id ELSE p.file_id END AS fetched_root FROM f a LEFT JOIN f p ON a.report_id = p.report_id AND a.parent_id = p.file_id AND p.rel = 'fetched' WHERE a.rel = 'fetched' OR p.file_id IS NOT NULL"""))
def fetched_roots(spark, sf_dir):
    return R.fetched_root(A.files(spark, sf_dir).withColumn("rel", F.when(F.col("file_id") % 4 == 0, "fetched")))


@query(sql(REFS, "SELECT count(CASE WHEN part_id % 4 = 0 THEN 1 END) AS live, count(CASE WHEN part_id % 4 = 1 THEN 1 END) AS cached, count(CASE WHEN part_id % 4 = 2 THEN 1 END) AS failed, CAST(sum(CASE WHEN part_id % 4 < 2 THEN bytes END) AS BIGINT) AS bytes FROM refs"))
def fetch_summary(spark, sf_dir):
    outcome = F.get(F.array(*map(F.lit, ("live", "cache", "fail 404", "budget"))), (F.col("part_id") % 4).cast("int"))
    return R.fetch_summary(A.refs(spark, sf_dir).withColumn("outcome", outcome))


_NAMES = ("@esbuild/linux-x64", "@esbuild/darwin-arm64", "tool-x86_64-windows", "tool-linux-x86_64", "core-win32-ia32", "plain-linux", "linux-i686", "sharp-linuxmusl-x64", "linux-ppc64", "a+linux+arm64", "linux-x64-then-darwin-arm64", "amd64.linux", "x64", "wasm32-wasi")


@query("""WITH p AS (SELECT l_orderkey AS id, l_linenumber AS line, l_suppkey % 14 AS k FROM lineitem) SELECT id, line, k, k IN (1, 2, 4, 6, 7, 8, 9, 13) AS off FROM p""")
def off_platform_refs(spark, sf_dir):
    names = F.array(*map(F.lit, _NAMES))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 14).alias("k"))
    rows = rows.withColumn("purl", F.concat(F.lit("pkg:npm/"), F.get(names, F.col("k").cast("int")), F.lit("@1.0.0")))
    return rows.select("id", "line", "k", R.off_platform(F.col("purl"), "linux", "x64").alias("off"))
