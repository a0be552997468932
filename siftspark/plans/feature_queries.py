"""Queries of the feature families."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftspark.operators import features as X
from siftspark.operators import findings as B
from siftspark.operators import jobs as J
from siftspark.plans.register import registrar
from siftspark.plans.sqltext import FILES, FINDINGS, PATHS, SUMMARIES, sql
from siftspark.session import buckets, stored, stored_by, table
from siftspark.sources import adapters as A

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

#: A vocabulary as a model has it: some one- and two-level paths.
VOCAB = tuple(f"{a}/{b}" for a in ("objectives", "well-known", "micro-behaviors", "third_party") for b in ("economy", "large", "promo")) + ("objectives", "well-known")

_VOCAB = "vocab AS (SELECT unnest([" + ", ".join(f"'{v}'" for v in VOCAB) + "]) AS path)"


def vocab(spark):
    return spark.createDataFrame([(v,) for v in VOCAB], "path string")


@query(sql(FINDINGS, FILES, PATHS, _VOCAB, """, p AS (SELECT r.*, CASE WHEN risk > 0 THEN ln(1 + risk) ELSE 1 END AS w FROM report_path r JOIN vocab USING (path) JOIN (SELECT report_id, max(risk) AS risk FROM files GROUP BY 1) USING (report_id))
  SELECT report_id, 'present:' || path AS name, w * max_conf AS value FROM p WHERE max_crit >= 2 UNION ALL SELECT report_id, 'maxcrit:' || path, max_crit * w * max_conf FROM p UNION ALL
  SELECT r.report_id, 'ghost:' || v.path, 1.0 FROM (SELECT DISTINCT report_id FROM files) r, vocab v WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.report_id = r.report_id AND p.path = v.path AND max_crit >= 2)"""))
def features_paths(spark, sf_dir):
    risks = A.files(spark, sf_dir).groupBy("report_id").agg(F.max("risk").alias("risk"))
    return X.weighted_paths(B.report_paths(A.findings(spark, sf_dir)), risks, vocab(spark))


def _entries(prefix: str, pairs: str, source: str) -> str:
    """SQL of sparse rows from ``name = expression`` lines over one wide row of ``source``; nulls are absent."""
    cells = ", ".join("{'name': '" + prefix + n.strip() + "', 'value': CAST(" + e.strip() + " AS DOUBLE)}" for n, e in (line.split("=", 1) for line in pairs.strip().splitlines()))
    return f" SELECT report_id, x.name AS name, x.value AS value FROM (SELECT report_id, unnest([{cells}]) AS x FROM {source}) WHERE x.value IS NOT NULL"


#: One row by report of everything that the aggregate features need, from distinct counts over paths and ids.
_WIDE = """, fb AS (SELECT report_id, file_id, count(DISTINCT CASE WHEN max_crit >= 4 THEN split_part(path, '/', 1) END) AS sc, count(DISTINCT CASE WHEN max_crit >= 5 THEN split_part(path, '/', 1) END) AS hc FROM file_path GROUP BY ALL),
fs AS (SELECT f.report_id, f.file_id, size_bytes, coalesce(n_active, 0) AS n, coalesce(notable, 0) AS c3, coalesce(suspicious, 0) AS c4, coalesce(hostile, 0) AS c5, coalesce(max_crit, 0) AS mc, coalesce(sc, 0) AS sc, coalesce(hc, 0) AS hc,
  greatest(1.0::DOUBLE, size_bytes / 1024) AS kb FROM files f LEFT JOIN file_summary USING (report_id, file_id) LEFT JOIN fb USING (report_id, file_id)),
fr AS (SELECT *, c4 / greatest(1, n) AS sr, c5 / greatest(1, n) AS hr, c4 / kb AS sd, c5 / kb AS hd FROM fs),
ft AS (SELECT report_id, count(*) AS files, count(*) FILTER (mc >= 5) AS f5, count(*) FILTER (mc = 4) AS f4, count(*) FILTER (mc = 3) AS f3, sum(size_bytes) AS bytes, max(hd + 0.25 * sd) AS wd,
  arg_max({'r': sr, 'n': c4, 'd': sd, 'c': sc}, (sr, c4, hr, c5, -file_id)) AS s1, arg_max({'r': hr, 'n': c5, 'd': hd, 'c': hc}, (hr, c5, sr, c4, -file_id)) AS h1 FROM fr GROUP BY 1),
d AS (SELECT *, len(path) - len(replace(path, '/', '')) AS depth, split_part(path, '/', 1) AS top, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END AS two FROM report_path),
b AS (SELECT report_id, max(CASE WHEN depth >= 2 AND max_crit >= 3 THEN max_crit END) AS mc, count(DISTINCT CASE WHEN max_crit >= 2 THEN top END) AS cats, count(*) FILTER (depth >= 2 AND max_crit >= 2) AS d2, count(*) FILTER (depth >= 2 AND max_crit >= 3) AS d3,
  count(*) FILTER (depth >= 2 AND max_crit >= 4) AS d4, count(*) FILTER (depth >= 2 AND max_crit >= 5) AS d5, count(*) FILTER (depth >= 2 AND max_crit = 3) AS only3, count(DISTINCT CASE WHEN max_crit >= 4 THEN top END) AS cat4, count(DISTINCT CASE WHEN max_crit >= 5 THEN top END) AS cat5,
  count(DISTINCT CASE WHEN max_crit >= 4 THEN two END) AS s2, count(DISTINCT CASE WHEN max_crit >= 5 THEN two END) AS h2, count(DISTINCT CASE WHEN max_crit >= 2 AND top = 'objectives' THEN two END) AS o2 FROM d GROUP BY 1),
r AS (SELECT ft.*, greatest(0.1::DOUBLE, bytes / 1024) AS low, greatest(1.0::DOUBLE, bytes / 1024) AS kb, coalesce(n_active, 0) AS n, coalesce(notable, 0) AS c3, coalesce(suspicious, 0) AS c4, coalesce(hostile, 0) AS c5, coalesce(unique_suspicious, 0) AS u4, coalesce(unique_hostile, 0) AS u5,
  coalesce(mc, 0) AS mc, coalesce(cats, 0) AS cats, coalesce(d2, 0) AS d2, coalesce(d3, 0) AS d3, coalesce(d4, 0) AS d4, coalesce(d5, 0) AS d5, coalesce(only3, 0) AS only3, coalesce(cat4, 0) AS cat4, coalesce(cat5, 0) AS cat5, coalesce(s2, 0) AS s2, coalesce(h2, 0) AS h2, coalesce(o2, 0) AS o2
  FROM ft LEFT JOIN report_summary USING (report_id) LEFT JOIN b USING (report_id))"""
_AGG = _WIDE + _entries("agg:", """max_crit = mc
category_breadth = cats
path_breadth_any = ln(1 + d2)
total_active_paths = ln(1 + d3)
suspicious_concentration = d4 / greatest(1, d2)
hostile_concentration = d5 / greatest(1, d2)
escalation_rate = d4 / greatest(1, d3)
notable_only_fraction = only3 / greatest(1, d3)
notable_findings_log = ln(1 + c3)
suspicious_findings_log = ln(1 + c4)
hostile_findings_log = ln(1 + c5)
notable_finding_ratio = c3 / low
suspicious_finding_ratio = c4 / low
hostile_finding_ratio = c5 / low
unique_suspicious_ids_log = ln(1 + u4) / ln(1 + low)
unique_hostile_ids_log = ln(1 + u5) / ln(1 + low)
crit3_finding_fraction = c3 / greatest(1, n)
crit4_finding_fraction = c4 / greatest(1, n)
hostile_finding_fraction = c5 / greatest(1, n)
severe_to_mundane_ratio = c3 / greatest(1, n - c3)
crit4_present = (c4 > 0)::INT
top1_file_suspicious_ratio_sum = s1.r
top1_file_hostile_ratio_sum = h1.r
top1_file_suspicious_findings_log = ln(1 + s1.n)
top1_file_hostile_findings_log = ln(1 + h1.n)
suspicious_category_breadth = cat4
hostile_category_breadth = cat5
suspicious_category_density = cat4 / greatest(1, cats)
hostile_category_density = cat5 / greatest(1, cats)
suspicious_findings_per_kb = c4 / kb
hostile_findings_per_kb = c5 / kb
suspicious_categories_per_kb = cat4 / kb
hostile_categories_per_kb = cat5 / kb
top1_file_suspicious_density_sum = s1.d
top1_file_hostile_density_sum = h1.d
top1_file_suspicious_category_breadth_sum = s1.c
top1_file_hostile_category_breadth_sum = h1.c
hostile_escalation_rate = d5 / greatest(1, d3)
hostile_share_of_suspicious = d5 / greatest(1, d4)
suspicious_finding_escalation_rate = c4 / greatest(1, c3)
hostile_finding_escalation_rate = c5 / greatest(1, c3)
hostile_share_of_suspicious_findings = c5 / greatest(1, c4)
hostile_weighted_density = c5 / kb + 0.25 * (c4 / kb)
top1_file_hostile_weighted_density_sum = wd
suspicious_id_repeat_ratio = 1 - u4 / greatest(1, c4)
hostile_id_repeat_ratio = 1 - u5 / greatest(1, c5)
suspicious_category_repeat_ratio = 1 - cat4 / greatest(1, c4)
hostile_category_repeat_ratio = 1 - cat5 / greatest(1, c5)
file_hostile_fraction = f5 / files
file_suspicious_fraction = f4 / files
file_notable_fraction = f3 / files
file_hostile_count_log = ln(1 + f5)
file_suspicious_count_log = ln(1 + f4)
file_notable_count_log = ln(1 + f3)
hostile_depth_weight = 0
suspicious_2level_breadth = s2
hostile_2level_breadth = h2
objectives_breadth = o2""", "r")


@query(sql(FINDINGS, FILES, PATHS, SUMMARIES, _AGG))
def features_aggregates(spark, sf_dir):
    return X.aggregates(A.findings(spark, sf_dir), A.files(spark, sf_dir))


_CODES = """, codes AS (SELECT report_id, count(DISTINCT atk) AS a, count(DISTINCT mbc) AS m, count(DISTINCT CASE WHEN starts_with(atk, 'T') THEN left(atk, 4) END) AS t, coalesce(bool_or(conf >= 0.65 AND starts_with(id, 'objectives/')), false) AS o FROM findings GROUP BY 1)"""
_ATTACK = _CODES + _entries("agg:", """attack_technique_count = a
attack_tactic_count = t
mbc_behavior_count = m
attack_bigram_count = ln(1 + a * (a - 1) / 2)
attack_trigram_count = ln(1 + a * (a - 1) * (a - 2) / 6)
mbc_bigram_count = ln(1 + m * (m - 1) / 2)
has_attack_and_objective = (a > 0 AND o)::INT""", "codes")


@query(sql(FINDINGS, _ATTACK))
def features_attack(spark, sf_dir):
    return X.attack_codes(A.findings(spark, sf_dir))


_TOKENS = """, tiered AS (SELECT report_id, path, CASE max_crit WHEN 5 THEN 'h' WHEN 4 THEN 's' ELSE 'n' END || ':' || path AS token, len(path) - len(replace(path, '/', '')) AS depth FROM report_path WHERE max_crit >= 3),
crit AS (SELECT report_id, token FROM tiered WHERE depth <= 1 AND split_part(path, '/', 1) IN ('objectives', 'well-known', 'supply-chain', 'anti-analysis', 'anti-static', 'command-and-control', 'evasion', 'execution', 'exfiltration'))"""
#: Vocabularies of n-grams, as a model has them.
CRIT_PAIRS = (("h:objectives", "h:well-known"), ("s:objectives", "s:well-known"), ("h:objectives", "s:well-known"), ("n:objectives", "s:well-known"), ("h:objectives", "h:objectives/promo polished steel"))
CRIT_TRIPLES = (("h:objectives", "h:objectives/promo", "h:well-known"), ("h:objectives", "h:objectives/economy", "n:well-known"))
TIER_PAIRS = (("h:micro-behaviors", "h:well-known"), ("h:third_party", "s:micro-behaviors"), ("n:micro-behaviors", "s:well-known"), ("h:micro-behaviors", "s:micro-behaviors/small"))
TIER_TRIPLES = (("h:micro-behaviors", "h:objectives", "h:well-known"), ("h:third_party", "s:micro-behaviors", "s:objectives"), ("h:micro-behaviors", "h:third_party", "n:objectives"))
ATK_PAIRS = tuple((f"T1{k:03}", f"T1{k + 7:03}") for k in range(30))
ATK_TRIPLES = tuple((f"T1{k:03}", f"T1{k + 3:03}", f"T1{k + 9:03}") for k in range(30))
MBC_PAIRS = tuple((f"B0{k:03}", f"B0{k + 5:03}") for k in range(20))
MBC_TRIPLES = tuple((f"B0{k:03}", f"B0{k + 2:03}", f"B0{k + 5:03}") for k in range(19))


def ngram_vocab(spark, rows):
    return spark.createDataFrame(list(rows), ", ".join(f"{c} string" for c in "abc"[: len(rows[0])]))


def _ngrams(tokens: str, prefix: str, rows) -> str:
    """SQL of the n-grams of literal vocabulary ``rows`` in table ``tokens (report_id, token)``."""
    values = ", ".join("(" + ", ".join(f"'{t}'" for t in row) + ")" for row in rows)
    names = "abc"[: len(rows[0])]
    has = " AND ".join(f"EXISTS (SELECT 1 FROM {tokens} t WHERE t.report_id = r.report_id AND t.token = v.{c})" for c in names)
    return f"SELECT r.report_id, '{prefix}' || {(chr(32) + '|| ' + repr(' + ') + ' ||' + chr(32)).join(names)} AS name, 1.0 AS value FROM (SELECT DISTINCT report_id FROM {tokens}) r, (VALUES {values}) v({', '.join(names)}) WHERE {has}"


@query(sql(FINDINGS, PATHS, _TOKENS + " SELECT report_id, 'crit:' || token AS name, 1.0 AS value FROM crit"))
def features_tokens(spark, sf_dir):
    return X.token_presence(X.crit_tokens(B.report_paths(A.findings(spark, sf_dir))))


@query(sql(FINDINGS, PATHS, _TOKENS + " " + _ngrams("crit", "critbi:", CRIT_PAIRS) + " UNION ALL " + _ngrams("crit", "crittri:", CRIT_TRIPLES)))
def features_token_pairs(spark, sf_dir):
    tokens = X.crit_tokens(B.report_paths(A.findings(spark, sf_dir)))
    return X.token_ngrams(tokens, ngram_vocab(spark, CRIT_PAIRS), "critbi:").unionByName(X.token_ngrams(tokens, ngram_vocab(spark, CRIT_TRIPLES), "crittri:", X.TRIPLE_CAP))


@query(sql(FINDINGS, PATHS, _TOKENS + " " + _ngrams("tiered", "tierbi:", TIER_PAIRS) + " UNION ALL " + _ngrams("tiered", "tiertri:", TIER_TRIPLES)))
def features_tier_ngrams(spark, sf_dir):
    tokens = X.tier_tokens(B.report_paths(A.findings(spark, sf_dir)))
    return X.token_ngrams(tokens, ngram_vocab(spark, TIER_PAIRS), "tierbi:").unionByName(X.token_ngrams(tokens, ngram_vocab(spark, TIER_TRIPLES), "tiertri:"))


_CODE_TOKENS = """, a AS (SELECT DISTINCT report_id, atk AS token FROM findings WHERE atk IS NOT NULL), m AS (SELECT DISTINCT report_id, mbc AS token FROM findings WHERE mbc IS NOT NULL)"""


@query(sql(FINDINGS, _CODE_TOKENS + " " + " UNION ALL ".join((_ngrams("a", "atkbi:", ATK_PAIRS), _ngrams("a", "atktri:", ATK_TRIPLES), _ngrams("m", "mbcbi:", MBC_PAIRS), _ngrams("m", "mbctri:", MBC_TRIPLES)))))
def features_code_pairs(spark, sf_dir):
    findings, out = A.findings(spark, sf_dir), None
    for code, name, pairs, triples in (("atk", "atk", ATK_PAIRS, ATK_TRIPLES), ("mbc", "mbc", MBC_PAIRS, MBC_TRIPLES)):
        tokens = X.code_tokens(findings, code)
        mine = X.token_ngrams(tokens, ngram_vocab(spark, pairs), f"{name}bi:").unionByName(X.token_ngrams(tokens, ngram_vocab(spark, triples), f"{name}tri:", X.TRIPLE_CAP))
        out = mine if out is None else out.unionByName(mine)
    return out


@query(sql(FINDINGS, """, p AS (SELECT DISTINCT report_id, file_id, split_part(id, '::', 1) AS path FROM active WHERE crit >= 3), pair AS (SELECT a.report_id, a.path AS a, b.path AS b FROM p a JOIN p b USING (report_id, file_id) WHERE a.path < b.path),
  vocab AS (SELECT a, b FROM pair GROUP BY ALL HAVING hash_ok(a, b)) SELECT DISTINCT report_id, 'bigrams:' || a || '+' || b AS name, 1.0 AS value FROM pair JOIN vocab USING (a, b)""".replace("HAVING hash_ok(a, b)", "HAVING length(a) % 3 = length(b) % 3")))
def features_bigrams(spark, sf_dir):
    paths = B.file_paths(A.findings(spark, sf_dir))
    flat = paths.select("report_id", "file_id", F.explode("paths").alias("p"))
    a, b = flat.alias("x"), flat.alias("y")
    pairs = a.join(b, (F.col("x.report_id") == F.col("y.report_id")) & (F.col("x.file_id") == F.col("y.file_id")) & (F.col("x.p") < F.col("y.p")))
    vocab = pairs.select(F.col("x.p").alias("a"), F.col("y.p").alias("b")).distinct().where("length(a) % 3 = length(b) % 3")
    return X.path_bigrams(paths, vocab)


#: A metric vocabulary as a model has it; one of its names is a key metric.
METRIC_VOCAB = ("text_is_root", "binary_string_count", "binary_import_count", "binary_overall_entropy", "text_share_of_lines", "pe_none_such")
_KEYS = ", ".join(f"('{g}', '{f}', {str(log).lower()})" for g, f, log in X.KEY_METRICS)
_METRICS = """, m AS (SELECT report_id, 'binary' AS g, 'overall_entropy' AS f, max(entropy) AS v FROM files GROUP BY ALL UNION ALL SELECT report_id, 'binary', 'function_count', max(functions) FROM files GROUP BY ALL UNION ALL SELECT report_id, 'binary', 'string_count', max(3 * total_lines) FROM files GROUP BY ALL UNION ALL
  SELECT report_id, 'binary', 'import_count', max(file_id % 7) FROM files GROUP BY ALL UNION ALL SELECT report_id, 'binary', 'dependency_count', max(file_id % 3) FROM files GROUP BY ALL UNION ALL SELECT report_id, 'text', 'total_lines', max(total_lines) FROM files GROUP BY ALL UNION ALL SELECT report_id, 'text', 'is_root', max((depth = 0)::INT) FROM files GROUP BY ALL),
keys AS (SELECT g, f, log FROM (VALUES """ + _KEYS + """) k(g, f, log) UNION ALL VALUES ('text', 'is_root', false), ('binary', 'string_count', true), ('binary', 'import_count', true), ('text', 'share_of_lines', false), ('pe', 'none_such', false)),
reports AS (SELECT DISTINCT report_id FROM files),
x AS (SELECT report_id, g || '_' || f AS name, log, coalesce(v, 0) AS v FROM reports CROSS JOIN keys LEFT JOIN m USING (report_id, g, f)),
y AS (SELECT report_id, max(v) FILTER (name = 'binary_string_count') AS s, max(v) FILTER (name = 'binary_function_count') AS f, max(v) FILTER (name = 'binary_import_count') AS i FROM x GROUP BY 1),
z AS (SELECT y.*, m.v AS d FROM y JOIN m ON m.report_id = y.report_id AND m.f = 'dependency_count')
SELECT report_id, 'metrics:' || name AS name, CASE WHEN log THEN ln(abs(v) + 1) ELSE v END AS value FROM x UNION ALL SELECT report_id, 'metrics:derived_string_per_function', CASE WHEN f = 0 THEN 0 ELSE s / f END FROM z
UNION ALL SELECT report_id, 'metrics:derived_imports_per_dependency', CASE WHEN d = 0 THEN 0 ELSE i / d END FROM z UNION ALL SELECT report_id, 'metrics:derived_wide_string_ratio', 0 FROM z"""


def metric_files(spark, sf_dir):
    """Files with their metrics as two-level JSON of numbers, booleans and strings."""
    binary = F.struct(F.col("entropy").alias("overall_entropy"), F.col("functions").alias("function_count"), (3 * F.col("total_lines")).alias("string_count"), (F.col("file_id") % 7).alias("import_count"), (F.col("file_id") % 3).alias("dependency_count"), F.concat(F.lit(" gcc  "), F.col("file_id") % 5).alias("compiler"))
    text = F.struct("total_lines", (F.col("depth") == 0).alias("is_root"))
    return A.files(spark, sf_dir).select("report_id", F.to_json(F.struct(binary.alias("binary"), text.alias("text"))).alias("metrics"))


@query(sql(FILES, _METRICS))
def features_metrics(spark, sf_dir):
    files = metric_files(spark, sf_dir)
    vocab = spark.createDataFrame([(v,) for v in METRIC_VOCAB], "name string")
    return X.metrics(files.select("report_id").distinct(), X.merged_metrics(files), vocab)


@query(sql(FILES, """SELECT DISTINCT report_id, 'kv:binary.compiler=gcc ' || (file_id % 5) AS name, 1.0 AS value FROM files UNION ALL SELECT DISTINCT report_id, 'kv:text.is_root=' || CASE WHEN depth = 0 THEN 'true' ELSE 'false' END, 1.0 FROM files"""))
def features_key_values(spark, sf_dir):
    return X.kv_tokens(metric_files(spark, sf_dir))


_GROUP = "CASE " + " ".join(f"WHEN lower(trim(file_type)) IN ({', '.join(repr(t) for t in types)}) THEN '{g}'" for g, types in X.FORMAT_GROUPS.items()) + " END"
_FORMATS = f""", g AS (SELECT f.*, {_GROUP} AS grp, coalesce(suspicious, 0) AS sus, coalesce(hostile, 0) AS hos FROM files f LEFT JOIN file_summary USING (report_id, file_id)),
t AS (SELECT report_id, count(*) AS files, count(parent_id) AS inner_, count(grp) AS known, count(DISTINCT grp) AS kinds, bool_or(grp = 'script') AS s, bool_or(grp = 'native_binary') AS b, bool_or(grp = 'archive_package') AS a FROM g GROUP BY 1),
u AS (SELECT t.report_id, v.grp, files, inner_, count(g.grp) AS n, count(g.parent_id) AS i, count(*) FILTER (sus > 0) AS sn, count(*) FILTER (hos > 0) AS hn FROM t CROSS JOIN (VALUES {', '.join(f"('{k}')" for k in X.FORMAT_GROUPS)}) v(grp) LEFT JOIN g ON g.report_id = t.report_id AND g.grp = v.grp GROUP BY ALL)
SELECT report_id, 'format:' || grp AS name, (n > 0)::INT AS value FROM u UNION ALL SELECT report_id, 'format:' || grp || '_file_fraction', n / files FROM u UNION ALL SELECT report_id, 'format:' || grp || '_inner_fraction', i / greatest(1, inner_) FROM u
UNION ALL SELECT report_id, 'format:' || grp || '_suspicious_fraction', sn / greatest(1, n) FROM u UNION ALL SELECT report_id, 'format:' || grp || '_hostile_fraction', hn / greatest(1, n) FROM u UNION ALL SELECT report_id, 'format:group_count_log', ln(1 + kinds) FROM t
UNION ALL SELECT report_id, 'format:mixed_script_binary', coalesce(s AND b, false)::INT FROM t UNION ALL SELECT report_id, 'format:mixed_archive_script', coalesce(a AND s, false)::INT FROM t UNION ALL SELECT report_id, 'format:mixed_archive_binary', coalesce(a AND b, false)::INT FROM t
UNION ALL SELECT report_id, 'format:unknown_file_fraction', (files - known) / files FROM t"""


@query(sql(FINDINGS, FILES, SUMMARIES, _FORMATS))
def features_formats(spark, sf_dir):
    return X.formats(A.files(spark, sf_dir), B.file_tiers(A.findings(spark, sf_dir)))


def shaped_files(spark, sf_dir, n_parts=None):
    """Files, some under a text suffix."""
    return A.files(spark, sf_dir, n_parts).withColumn("path", F.concat("path", F.when(F.col("file_id") % 5 == 0, ".txt").otherwise("")))


_SHAPES = """, q AS (SELECT f.*, f.path || CASE WHEN f.file_id % 5 = 0 THEN '.txt' ELSE '' END AS named, coalesce(n_active, 0) AS na, coalesce(suspicious, 0) AS sus, coalesce(hostile, 0) AS hos, nullif(greatest(entropy, 0), 0) AS e, file_type IN ('pe', 'elf', 'macho') AS bin, f.file_id % 4 <> 0 AS imported FROM files f LEFT JOIN file_summary USING (report_id, file_id)),
pn AS (SELECT report_id, count(*) AS paths FROM report_path GROUP BY 1),
k AS (SELECT q.report_id, count(*) AS n, sum(na) AS f, sum(size_bytes) AS bytes, count(*) FILTER (sus > 0) AS s, count(*) FILTER (hos > 0) AS h, bool_or(bin AND size_bytes < 20000) AS tiny, NOT bool_or(imported) AS bare, coalesce(max(entropy), 0) AS me, count(e) AS ne, avg(e) AS ae, stddev_pop(e) AS se, max(e) AS xe,
  max(e) FILTER (file_type IN ('javascript', 'python', 'pe', 'elf', 'macho')) AS ce, count(mtime) AS nt, max(mtime) - min(mtime) AS tr, stddev_pop(mtime) AS st, median(mtime) AS mt, max(mtime) FILTER (hos > 0) AS b1, min(mtime) FILTER (hos > 0) AS b0, max(depth) AS deep, count(parent_id) AS inner_, count(parent_id) FILTER (hos > 0) AS under,
  count(*) FILTER (bin AND regexp_extract(lower(named), '[.]([^.]*)$', 1) IN ('txt', 'md', 'json', 'png', 'jpg')) AS odd, sum(total_lines) AS lines,
  coalesce(bool_or(bin AND EXISTS (SELECT 1 FROM files o WHERE o.report_id = q.report_id AND o.file_id <= q.file_id AND o.file_type IN ('javascript', 'python', 'typescript', 'ruby', 'php'))), false) AS fb FROM q GROUP BY 1),
l AS (SELECT k.*, coalesce(paths, 0) AS paths FROM k LEFT JOIN pn USING (report_id))"""
_STRUCT = _SHAPES + _entries("struct:", """tiny_executable = tiny::INT
no_imports = bare::INT
zero_findings = (f = 0)::INT
finding_count_log = ln(1 + f)
file_count_log = ln(1 + n)
inner_file_count_log = ln(n)
stealth_potential = (f < 5 AND me > 6.5)::INT
suspicious_file_fraction = s / n
hostile_file_fraction = h / n
suspicious_file_count_log = ln(1 + s)
hostile_file_count_log = ln(1 + h)
packaged_capability = paths * me
mtime_range_hours = CASE WHEN nt > 1 THEN tr / 3600 END
mtime_std_dev_hours = CASE WHEN nt > 1 THEN st / 3600 END
max_nesting_depth_log = ln(1 + deep)
inner_file_ratio = inner_ / n
entropy_std_dev = CASE WHEN ne > 1 THEN se END
entropy_max_diff = CASE WHEN ne > 1 THEN xe - ae END
air_gap_signal = (h > 0 AND under = 0)::INT
anachronistic_injection = greatest(abs(b1 - mt), abs(b0 - mt)) / 3600
code_entropy_spike = ce - ae
foreign_binary_signal = fb::INT
extension_mismatch_signal = odd
hostile_finding_density = CASE WHEN lines > 0 THEN h * 1000 / lines END
silent_packer_signal = ln(1 + bytes / 1048576) / (f + 1)""", "l")


@query(sql(FINDINGS, FILES, PATHS, SUMMARIES, _STRUCT))
def features_structure(spark, sf_dir):
    findings, files = A.findings(spark, sf_dir), shaped_files(spark, sf_dir)
    return X.structure(files, B.file_tiers(findings), B.report_paths(findings), files.where("file_id % 4 <> 0"))


_EXT = _entries("ext:", """third_party_max_crit = max_third_party
third_party_count = ln(1 + n_third_party)
well_known_max_crit = max_well_known
well_known_hostile_count = well_known_hostile
well_known_suspicious_count = well_known_suspicious
has_yara_match = has_yara::INT""", "report_summary")


@query(sql(FINDINGS, SUMMARIES, _EXT))
def features_external(spark, sf_dir):
    return X.external(A.findings(spark, sf_dir))


#: Gaps as a model has them, over imports and paths that the tables have.
GAPS = {"metal": (("standard", "economy!small"), ("micro-behaviors/promo",)), "paint": (("promo", "promo!red"), ("objectives/large", "third_party"))}
RISKS = {"network": ("objectives/promo", "micro-behaviors/large"), "crypto": ("objectives/economy",)}


@query(sql("imp AS (SELECT l_orderkey AS report_id, lower(p_type) AS lib, split_part(p_name, ' ', 1) AS name FROM lineitem JOIN part ON l_partkey = p_partkey), word AS (SELECT report_id, split_part(lib, ' ', 1) AS token FROM imp)", FINDINGS, PATHS, """, h AS (SELECT report_id, bool_or(token = 'standard') AS m, bool_or(token = 'promo') AS p FROM word GROUP BY 1),
  s AS (SELECT report_id, bool_or(starts_with(path, 'micro-behaviors/promo')) AS m, bool_or(starts_with(path, 'objectives/large') OR starts_with(path, 'third_party')) AS p FROM report_path WHERE max_crit >= 3 GROUP BY 1),
  r AS (SELECT report_id, bool_or(max_crit >= 4 AND (starts_with(path, 'objectives/promo') OR starts_with(path, 'micro-behaviors/large'))) AS n, bool_or(max_crit >= 4 AND starts_with(path, 'objectives/economy')) AS c FROM report_path GROUP BY 1)
  SELECT h.report_id, 'gap:metal' AS name, 1.0 AS value FROM h LEFT JOIN s USING (report_id) WHERE h.m AND NOT coalesce(s.m, false) UNION ALL SELECT h.report_id, 'gap:paint', 1.0 FROM h LEFT JOIN s USING (report_id) WHERE h.p AND NOT coalesce(s.p, false)
  UNION ALL SELECT report_id, 'intent_gap:network', 1.0 FROM r WHERE n UNION ALL SELECT report_id, 'intent_gap:crypto', 1.0 FROM r WHERE c"""))
def features_gaps(spark, sf_dir):
    paths = B.report_paths(A.findings(spark, sf_dir))
    words = imports(spark, sf_dir).select("report_id", F.split_part("lib", F.lit(" "), F.lit(1)).alias("token"))
    return X.logic_gaps(words, paths, GAPS).unionByName(X.intent_gaps(paths, RISKS))


_WORDS = r"""w AS (SELECT doc_id AS report_id, unnest(string_split_regex(trim(text), '[ \n\t\r]+')) AS s FROM documents WHERE text IS NOT NULL), words AS (SELECT * FROM w WHERE s <> '')"""


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("report_id"), F.explode(F.split(F.trim("text"), "[ \n\t\r]+")).alias("s")).where("s <> ''")


_TEXT = r""", c AS (SELECT s, unnest(string_split(s, '')) AS c FROM (SELECT DISTINCT s FROM words WHERE length(s) BETWEEN 4 AND 8 OR length(s) >= 24)), cn AS (SELECT s, c, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL), cp AS (SELECT s, n / sum(n) OVER (PARTITION BY s) AS p FROM cn), ent AS (SELECT s, -sum(p * log2(p)) AS h FROM cp GROUP BY 1),
t AS (SELECT w.*, length(w.s) AS n, lower(w.s) AS low, h, length(w.s) % 9 = 0 AS wide FROM words w LEFT JOIN ent ON ent.s = w.s),
a AS (SELECT report_id, count(*) AS c, avg(n) AS mean, max(n) AS most, avg((n >= 16 AND n - length(regexp_replace(s, '[\pL\pN+/=_-]', '', 'g')) > 0.92 * n AND regexp_matches(s, '[+/=]'))::INT) AS base64ish,
  avg((n >= 16 AND n - length(regexp_replace(s, '[0-9A-Fa-f]', '', 'g')) > 0.95 * n)::INT) AS hexish, avg((contains(low, '://') OR contains(low, '%2f'))::INT) AS urlish, avg((contains(s, '/') OR contains(s, '\') OR starts_with(low, 'c:'))::INT) AS pathish,
  avg((contains(s, '\x') OR contains(s, '\u') OR contains(low, '%u'))::INT) AS esc, avg(wide::INT) AS wide, avg(coalesce(n >= 24 AND h >= 4 - 1e-9, false)::INT) AS high, avg((n >= 80)::INT) AS long, avg(coalesce(n BETWEEN 4 AND 8 AND h >= 2.4 - 1e-9, false)::INT) AS junk FROM t GROUP BY 1)""" + _entries("textenc:", """string_count_log = ln(1 + c)
avg_len_log = ln(1 + mean)
max_len_log = ln(1 + most)
base64ish_ratio = base64ish
hexish_ratio = hexish
urlish_ratio = urlish
pathish_ratio = pathish
unicode_escape_ratio = esc
wide_ratio = wide
high_entropy_ratio = high
long_token_ratio = long
short_junk_ratio = junk""", "a")


@query(sql(_WORDS, _TEXT))
def features_text(spark, sf_dir):
    items = _words(spark, sf_dir).select("report_id", F.array(F.lit("0x10"), F.when(F.length("s") % 9 == 0, "UTF16LE").otherwise("ascii"), "s").alias("item"))
    return X.text_encoding(X.string_entries(items))


@query(sql(_WORDS, """, d AS (SELECT DISTINCT s FROM words), c AS (SELECT s, unnest(string_split(s, '')) AS c FROM d), n AS (SELECT s, c, count(*) AS n FROM c WHERE c <> '' GROUP BY ALL), p AS (SELECT s, n / sum(n) OVER (PARTITION BY s) AS p FROM n)
  SELECT s, round(-sum(p * log2(p)), 6) + 0 AS entropy FROM p GROUP BY 1"""))
def char_entropy(spark, sf_dir):
    return X.char_entropy(_words(spark, sf_dir)).select("s", (F.round("entropy", 6) + 0).alias("entropy"))


_IMPORTS = """imp AS (SELECT l_orderkey AS report_id, l_suppkey AS file_id, lower(p_type) AS lib, split_part(p_name, ' ', 1) AS name FROM lineitem JOIN part ON l_partkey = p_partkey),
sym AS (SELECT DISTINCT report_id, file_id, unnest([name, lib || '!' || name]) AS symbol FROM imp)"""


def imports(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.selectExpr("l_orderkey AS report_id", "l_suppkey AS file_id", "lower(p_type) AS lib", "split_part(p_name, ' ', 1) AS name")


_SYMBOLS = _IMPORTS + """, every AS (SELECT * FROM sym WHERE length(symbol) >= 2 UNION SELECT l_orderkey, l_suppkey, 'fn ' || p_size FROM lineitem JOIN part ON l_partkey = p_partkey),
ranked AS (SELECT *, row_number() OVER (PARTITION BY report_id, file_id ORDER BY symbol) AS k FROM every)"""
SYMBOL_PAIRS = (("economy!small", "small"), ("fn 11", "red"), ("blue", "fn 5"), ("large!hot", "hot"))
SYMBOL_TRIPLES = (("economy!small", "fn 11", "small"), ("fn 28", "large!red", "red"), ("fn 5", "hot", "promo!hot"))


def symbols(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    named = rows.selectExpr("l_orderkey AS report_id", "l_suppkey AS file_id", "concat(' fn  ', p_size) AS name")
    return X.symbols(imports(spark, sf_dir), named)


@query(sql(_SYMBOLS, "SELECT DISTINCT report_id, 'symbol:' || symbol AS name, 1.0 AS value FROM every"))
def features_symbols(spark, sf_dir):
    return X.symbol_presence(symbols(spark, sf_dir))


def _symbol_sql(rows, prefix: str, first: int) -> str:
    names = "abc"[: len(rows[0])]
    values = ", ".join("(" + ", ".join(f"'{t}'" for t in row) + ")" for row in rows)
    joins = " ".join(f"JOIN ranked {c}_ ON {c}_.symbol = v.{c} AND {c}_.k <= {first}" + ("" if c == "a" else f" AND {c}_.report_id = a_.report_id AND {c}_.file_id = a_.file_id") for c in names)
    return f"SELECT DISTINCT a_.report_id, '{prefix}' || {(chr(32) + '|| ' + repr('||') + ' ||' + chr(32)).join('v.' + c for c in names)} AS name, 1.0 AS value FROM (VALUES {values}) v({', '.join(names)}) {joins}"


@query(sql(_SYMBOLS, _symbol_sql(SYMBOL_PAIRS, "symbol_bi:", 64) + " UNION ALL " + _symbol_sql(SYMBOL_TRIPLES, "symbol_tri:", 24)))
def features_symbol_pairs(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    return X.symbol_ngrams(rows, ngram_vocab(spark, SYMBOL_PAIRS)).unionByName(X.symbol_ngrams(rows, ngram_vocab(spark, SYMBOL_TRIPLES), "symbol_tri:", 24))


@query(sql(FINDINGS, PATHS, """, p AS (SELECT DISTINCT report_id, file_id, split_part(id, '::', 1) AS path FROM active WHERE crit >= 3), bare AS (SELECT DISTINCT report_id FROM report_path WHERE path = 'third_party')
  SELECT DISTINCT a.report_id, 'unsigned_bigram:' || a.path || '+' || b.path AS name, 1.0 AS value FROM p a JOIN p b USING (report_id, file_id) JOIN bare USING (report_id) WHERE a.path < b.path AND length(a.path) % 3 = length(b.path) % 3"""))
def features_unsigned(spark, sf_dir):
    # no report of the tables says that it is unsigned: third-party ones stand in
    paths = B.report_paths(A.findings(spark, sf_dir)).withColumn("path", F.when(F.col("path") == "third_party", "metadata/unsigned").otherwise(F.col("path")))
    return X.unsigned_bigrams(features_bigrams(spark, sf_dir), paths)


_FORMULA = "formulas AS (SELECT o_orderkey AS report_id, 'C₂,' || left(o_orderpriority, 1) || 'H₄, ' || o_orderstatus || '₁' AS formula FROM orders)"


@query(sql(_FORMULA, FINDINGS, """, m AS (SELECT report_id, count(*) AS f, avg(conf) AS mean FROM active GROUP BY 1), w AS (SELECT x.report_id, formula, coalesce(f, 0) AS f, coalesce(mean, 1.0) AS mean, regexp_replace(formula, '[^\\pL]', '', 'g') AS skel FROM formulas x LEFT JOIN m USING (report_id)),
  b AS (SELECT DISTINCT report_id, mean, trim(unnest(string_split(translate(formula, '₀₁₂₃₄₅₆₇₈₉', ''), ','))) AS e FROM w)
  SELECT report_id, 'elements:' || e AS name, 1.0::DOUBLE AS value FROM b WHERE e <> '' UNION ALL SELECT report_id, 'rare:' || e, mean FROM b WHERE e <> '' UNION ALL SELECT report_id, 'formula:skeleton_len', length(skel) FROM w UNION ALL SELECT report_id, 'formula:unique_elements', len(list_distinct(string_split(skel, ''))) FROM w
  UNION ALL SELECT report_id, 'formula:complexity_ratio', length(formula) / f FROM w WHERE f > 0 UNION ALL SELECT report_id, 'skeleton:' || skel, 1.0 FROM w WHERE skel <> ''"""))
def features_formula(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("report_id"), F.concat(F.lit("C₂,"), F.substring("o_orderpriority", 1, 1), F.lit("H₄, "), "o_orderstatus", F.lit("₁")).alias("formula"))
    return X.formula(rows, A.findings(spark, sf_dir))


_SCORE = """, r AS (SELECT report_id, max(risk) AS risk, sum(size_bytes) AS bytes FROM files GROUP BY 1) SELECT report_id, 'score:hopper_score' AS name, risk::DOUBLE AS value FROM r UNION ALL SELECT report_id, 'score:density', CASE WHEN bytes > 0 THEN risk / ln(1 + bytes) ELSE 0 END FROM r UNION ALL SELECT DISTINCT f.report_id, 'inter:' || file_type || '*score', r.risk FROM files f JOIN r USING (report_id)"""


@query(sql(FILES, _SCORE))
def features_scores(spark, sf_dir):
    return X.type_scores(A.files(spark, sf_dir))


_EXPECTED = ", ".join(f"('{t}', '{p}')" for t, each in X.EXPECTED_PATHS.items() for p in each)


@query(sql(FINDINGS, FILES, PATHS, f""", e AS (SELECT * FROM (VALUES {_EXPECTED}, ('zip', 'well-known')) v(file_type, path)) SELECT DISTINCT f.report_id, 'missing:' || e.file_type || '*' || e.path AS name, 1.0 AS value FROM files f JOIN e USING (file_type) WHERE NOT EXISTS (SELECT 1 FROM report_path p WHERE p.report_id = f.report_id AND p.path = e.path)"""))
def features_missing(spark, sf_dir):
    return X.missing_paths(A.files(spark, sf_dir), B.report_paths(A.findings(spark, sf_dir)), X.EXPECTED_PATHS | {"zip": ("well-known",)})


@query(sql(FINDINGS, PATHS, """, p AS (SELECT DISTINCT report_id, file_id, split_part(id, '::', 1) AS path FROM active WHERE crit >= 3), v AS (SELECT DISTINCT l[1] AS a, l[2] AS b, l[3] AS c FROM (SELECT list_sort(list(path)) AS l FROM p GROUP BY report_id, file_id) WHERE len(l) >= 3)
  SELECT DISTINCT x.report_id, 'trigram:' || a || '+' || b || '+' || c AS name, 1.0 AS value FROM p x JOIN v ON x.path = a JOIN p y ON y.report_id = x.report_id AND y.file_id = x.file_id AND y.path = b JOIN p z ON z.report_id = x.report_id AND z.file_id = x.file_id AND z.path = c"""))
def features_trigrams(spark, sf_dir):
    paths = B.file_paths(A.findings(spark, sf_dir))
    vocab = paths.where(F.size("paths") >= 3).select(*[F.get("paths", k).alias(c) for k, c in enumerate("abc")]).distinct()
    return X.path_trigrams(paths, vocab)


#: Triples counted one first index at a time: for i < j the third runs from j + 1 to, and without, min(j + 20, n).
_COOC = """, co AS (SELECT report_id, count(*) FILTER (max_crit >= 4) AS s, count(*) FILTER (starts_with(path, 'objectives/') OR starts_with(path, 'well-known/')) AS o FROM report_path GROUP BY 1),
sizes AS (SELECT DISTINCT s AS n FROM co UNION SELECT o FROM co), tri AS (SELECT n, coalesce(sum(CASE WHEN i.i < j.j AND j.j < n THEN greatest(0, least(j.j + 20, n) - (j.j + 1)) END), 0) AS t FROM sizes, range(0, 400) i(i), range(0, 400) j(j) GROUP BY n)"""
_COOC_SQL = _COOC + _entries("agg:", """suspicious_bigram_count = ln(1 + s * (s - 1) / 2)
suspicious_trigram_count = ln(1 + a.t)
objective_bigram_count = ln(1 + o * (o - 1) / 2)
objective_trigram_count = ln(1 + b.t)""", "co JOIN tri a ON a.n = s JOIN tri b ON b.n = o")


@query(sql(FINDINGS, PATHS, _COOC_SQL))
def features_cooccurrence(spark, sf_dir):
    return X.path_cooccurrence(B.report_paths(A.findings(spark, sf_dir)))


#: A feature spec as a model has it: names, means and deviations; the last name is written by no family.
SPEC = (("agg:max_crit", 0.0, 1.0), ("agg:category_breadth", 0.5, 2.0), ("agg:path_breadth_any", 1.0, 0.5), ("agg:attack_technique_count", 1.5, 0.0), ("agg:escalation_rate", 2.0, 1.5), ("agg:objective_bigram_count", 1.0, 0.7), ("struct:file_count_log", 1.2, 0.4),
  ("struct:entropy_std_dev", 0.8, 0.6), ("format:script", 0.3, 0.5), ("ext:third_party_max_crit", 0.5, 1.1), ("score:hopper_score", 30.0, 12.0), ("agg:none_such", 2.5, 1.0))
_SPEC = "spec AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{n}', {m}::DOUBLE, {d}::DOUBLE)" for k, (n, m, d) in enumerate(SPEC)) + ") v(pos, name, mean, std))"


def spec(spark):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(SPEC)], "pos int, name string, mean double, std double")


def report_tables(spark, sf_dir) -> J.Tables:
    """Files and findings, written once in buckets of reports, for the families read them often."""
    n = buckets(spark, A.lines(spark, sf_dir))
    files = stored_by(shaped_files(spark, sf_dir, n).drop("sha256"), "report_id", n, dealt=True)
    return J.Tables(files, stored_by(A.findings(spark, sf_dir), "report_id", n), importing=files.where("file_id % 4 <> 0"), buckets=n)


def vectors(spark, sf_dir):
    """Standardized vectors of all reports: the families that need findings and files only."""
    return J.featurize(report_tables(spark, sf_dir), spec(spark))


def all_families(spark, sf_dir, names=None):
    return J.families(report_tables(spark, sf_dir), names, skip=("missing", "crit", "intent_gap"))


def _family(oracle: str, k: int) -> str:
    return f"f{k} AS (SELECT report_id, name, CAST(value AS DOUBLE) AS value FROM ({oracle}))"


_FAMILIES = [sql(FINDINGS, FILES, PATHS, SUMMARIES, _AGG), sql(FINDINGS, _ATTACK), sql(FINDINGS, PATHS, _COOC_SQL), sql(FINDINGS, FILES, PATHS, SUMMARIES, _STRUCT), sql(FINDINGS, FILES, SUMMARIES, _FORMATS), sql(FINDINGS, SUMMARIES, _EXT), sql(FILES, _SCORE)]
FEATURES = [*(_family(o, k) for k, o in enumerate(_FAMILIES)), "feat AS (" + " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(len(_FAMILIES))) + ")"]
_VECTORS = """, cell AS (SELECT f.report_id, s.pos, CASE WHEN abs(std) < 1e-12 OR (abs(mean) < 1e-12 AND abs(std - 1) < 1e-12) THEN 0 ELSE (coalesce(v.value, 0) - mean) / std END AS z FROM (SELECT DISTINCT l_orderkey AS report_id FROM lineitem) f CROSS JOIN spec s LEFT JOIN feat v ON v.report_id = f.report_id AND v.name = s.name)"""


@query(sql(*FEATURES, _SPEC, _VECTORS + " SELECT report_id, array_to_string(list(CAST(round(round(z, 9), 4) AS DECIMAL(12,4)) ORDER BY pos), ' ') AS vector FROM cell GROUP BY 1"))
def feature_vectors(spark, sf_dir):
    cell = lambda x: F.round(F.round(x, 9), 4).cast("decimal(12,4)").cast("string")
    return vectors(spark, sf_dir).select("report_id", F.array_join(F.transform("vector", cell), " ").alias("vector"))


@query(sql(*FEATURES, _SPEC, "SELECT name FROM spec WHERE name NOT IN (SELECT name FROM feat)"))
def feature_drift(spark, sf_dir):
    # a family that the spec does not name writes none of its names
    return X.drift(spec(spark), all_families(spark, sf_dir, [n for n, _, _ in SPEC]))


@query(sql(*FEATURES, "SELECT name, split_part(name, ':', 1) AS family, count(DISTINCT report_id) AS reports, round(sum(value), 3) AS total FROM feat GROUP BY ALL"))
def feature_catalog(spark, sf_dir):
    """Every name that the families write, with the reports that have it and the sum of its values."""
    rows = all_families(spark, sf_dir)
    # a family writes a name once for a report: rows are reports; some hundred names, written here, where rows of a report are joined as they lie
    return stored(rows.groupBy("name", F.split_part("name", F.lit(":"), F.lit(1)).alias("family")).agg(F.count(F.lit(1)).alias("reports"), F.round(F.sum("value"), 3).alias("total")), lie=True)
