"""The adapters' tables in DuckDB SQL, for the oracles."""

from siftspark.sources.adapters import FILE_TYPES

_TYPES = "[" + ", ".join(f"'{t}'" for t in FILE_TYPES) + "]"

FINDINGS = """findings AS (SELECT l_orderkey AS report_id, l_suppkey AS file_id, l_linenumber AS pos,
  (CASE WHEN l_partkey % 17 = 0 THEN 'third_party' WHEN l_returnflag = 'A' THEN 'objectives' WHEN l_returnflag = 'R' THEN 'well-known' ELSE 'micro-behaviors' END)
  || '/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '-')) || '/k' || (l_partkey % 5) || '::r' || l_linenumber AS id,
  CAST(floor((l_quantity - 1) / 10) AS INT) + 1 AS crit, round(0.5 + 5 * l_discount, 2) AS conf,
  CASE WHEN l_linestatus = 'F' THEN 'T1' || lpad(CAST(l_partkey % 40 AS VARCHAR), 3, '0') END AS atk,
  CASE WHEN l_linestatus = 'O' THEN 'B0' || lpad(CAST(l_suppkey % 25 AS VARCHAR), 3, '0') END AS mbc, l_partkey AS tie
  FROM lineitem JOIN part ON l_partkey = p_partkey),
active AS (SELECT * FROM findings WHERE id <> '' AND conf >= 0.65)"""

FILES = f"""line_files AS (SELECT l_orderkey AS report_id, l_suppkey AS file_id, CAST(floor(round(sum(l_extendedprice), 2)) AS BIGINT) AS size_bytes,
  max(CAST(floor((l_quantity - 1) / 10) AS INT) + 1) * 10 AS risk, round(avg(l_tax) * 100, 4) AS entropy, count(*) AS functions, sum(l_linenumber) AS total_lines, 86400 * date_diff('day', DATE '1970-01-01', CAST(max(l_shipdate) AS DATE)) AS mtime FROM lineitem GROUP BY 1, 2),
roots AS (SELECT report_id, min(file_id) AS root_id FROM line_files GROUP BY 1),
files AS (SELECT report_id, file_id, {_TYPES}[file_id % 14 + 1] AS file_type, size_bytes, CASE WHEN file_id = root_id THEN 0 ELSE 1 + file_id % 2 END AS depth,
  CASE WHEN file_id <> root_id THEN root_id END AS parent_id,
  'o' || report_id || '.' || {_TYPES}[root_id % 14 + 1] || CASE WHEN file_id = root_id THEN '' ELSE '!!f' || file_id || '.' || {_TYPES}[file_id % 14 + 1] END AS path,
  sha256(report_id || '/' || file_id) AS sha256, risk, entropy, functions, total_lines, mtime FROM line_files JOIN roots USING (report_id))"""

PATHS = """levels AS (SELECT report_id, file_id, string_split(split_part(id, '::', 1), '/') AS l, crit, conf FROM active),
file_path AS (SELECT report_id, file_id, array_to_string(l[1:n], '/') AS path, max(crit) AS max_crit, max(conf) AS max_conf FROM levels, (VALUES (1), (2), (3)) v(n) WHERE n <= len(l) GROUP BY ALL),
report_path AS (SELECT report_id, path, max(max_crit) AS max_crit, max(max_conf) AS max_conf FROM file_path GROUP BY ALL)"""

_TIERS = """count(*) AS n_active, count(CASE WHEN crit >= 3 THEN 1 END) AS notable, count(DISTINCT CASE WHEN crit >= 3 THEN id END) AS unique_notable,
  count(CASE WHEN crit >= 4 THEN 1 END) AS suspicious, count(DISTINCT CASE WHEN crit >= 4 THEN id END) AS unique_suspicious, count(CASE WHEN crit >= 5 THEN 1 END) AS hostile, count(DISTINCT CASE WHEN crit >= 5 THEN id END) AS unique_hostile,
  count(CASE WHEN starts_with(id, 'third_party/') THEN 1 END) AS n_third_party, coalesce(max(CASE WHEN starts_with(id, 'third_party/') THEN crit END), 0) AS max_third_party,
  count(CASE WHEN starts_with(id, 'well-known/') THEN 1 END) AS n_well_known, coalesce(max(CASE WHEN starts_with(id, 'well-known/') THEN crit END), 0) AS max_well_known, max(crit) AS max_crit,
  count(CASE WHEN starts_with(id, 'well-known/') AND crit >= 5 THEN 1 END) AS well_known_hostile, count(CASE WHEN starts_with(id, 'well-known/') AND crit = 4 THEN 1 END) AS well_known_suspicious, bool_or(starts_with(id, 'third_party/yara')) AS has_yara"""

SUMMARIES = f"""file_summary AS (SELECT report_id, file_id, {_TIERS} FROM active GROUP BY ALL),
report_summary AS (SELECT report_id, {_TIERS}, count(DISTINCT file_id) AS n_files FROM active GROUP BY ALL)"""

RISK = """risk AS (SELECT report_id, file_id, coalesce(max_crit, 0) AS max_crit, coalesce(suspicious, 0) AS suspicious, coalesce(hostile, 0) AS hostile,
  coalesce(suspicious, 0) / greatest(1, coalesce(n_active, 0)) AS suspicious_ratio, coalesce(hostile, 0) / greatest(1, coalesce(n_active, 0)) AS hostile_ratio,
  coalesce(suspicious, 0) / greatest(1.0::DOUBLE, size_bytes / 1024) AS suspicious_density, coalesce(hostile, 0) / greatest(1.0::DOUBLE, size_bytes / 1024) AS hostile_density
  FROM files LEFT JOIN file_summary USING (report_id, file_id))"""

FLOOR = """floors AS (SELECT report_id, count(CASE WHEN conf >= 0.76 AND crit = 5 THEN 1 END) AS c5, count(CASE WHEN conf >= 0.76 AND crit = 4 THEN 1 END) AS c4,
  max(CASE WHEN conf >= 0.76 AND crit = 5 THEN conf END) AS p5, max(CASE WHEN conf >= 0.76 AND crit = 4 THEN conf END) AS p4, count(*) AS total FROM findings GROUP BY 1),
verdicts AS (SELECT report_id, CASE WHEN c5 >= 1 THEN 2 WHEN c4 >= 2 AND c4 >= 0.05 * total THEN 1 ELSE 0 END AS class,
  CASE WHEN c5 >= 1 THEN p5 WHEN c4 >= 2 AND c4 >= 0.05 * total THEN p4 ELSE 0 END AS prob,
  CASE WHEN c5 >= 1 THEN 25 WHEN c4 >= 2 AND c4 >= 0.05 * total THEN 3000 ELSE -1 END AS level FROM floors)"""

SCORES = """scores AS (SELECT vec_id AS id, CASE WHEN label % 3 = 0 THEN 'elf' WHEN label % 3 = 1 THEN 'python' ELSE 'mystery' END AS file_type,
  round(1 / (1 + exp(-4 * (embedding[1]::DOUBLE + embedding[2] - embedding[3]))), 6) AS raw, round(1 / (1 + exp(-3 * (embedding[4]::DOUBLE - embedding[5]))), 6) AS raw2, label FROM embeddings)"""

REFS = """refs AS (SELECT l_orderkey AS report_id, l_suppkey AS file_id, l_linenumber AS pos, CASE l_returnflag WHEN 'A' THEN 'url' WHEN 'R' THEN 'command' ELSE 'dependency' END AS kind,
  lower(replace(p_brand, '#', '-')) AS package, p_size || '.' || l_linenumber || '.' || (l_suppkey % 10) AS version, p_size, l_linenumber, l_suppkey % 10 AS patch,
  'pkg:npm/' || lower(replace(p_brand, '#', '-')) || CASE WHEN l_partkey % 9 = 0 THEN '' ELSE '@' || p_size || '.' || l_linenumber || '.' || (l_suppkey % 10) END AS locator,
  l_partkey AS part_id, CAST(floor(l_extendedprice) AS BIGINT) AS bytes FROM lineitem JOIN part ON l_partkey = p_partkey)"""

POOL = """pool AS (SELECT 'pkg:npm/' || lower(replace(p_brand, '#', '-')) || '-' || (p_partkey % 97) || '@' || p_size || '.0.' || (p_partkey % 10) AS purl, sha256(p_name) AS sha256, CASE WHEN p_partkey % 7 = 0 THEN 'bad' ELSE 'good' END AS label FROM part),
keys AS (SELECT DISTINCT label, 'sha256' AS kind, sha256 AS key FROM pool UNION SELECT DISTINCT label, 'purl', purl FROM pool)"""


def sql(*parts: str) -> str:
    """CTEs and a final select; a part that begins with a comma goes on where the one before ends."""
    out = "WITH " + parts[0]
    for k, part in enumerate(parts[1:], 1):
        last = k == len(parts) - 1
        out += ("\n" if part.startswith(",") or (last and not part.startswith(",")) else ",\n") + part
    return out
