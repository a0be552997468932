"""URL filters by a sorted sweep over reversed-host keys.

A rule (host, path) becomes the key ``reversed.host`` + path; the urls under it
are those whose key, built at the rule's level of the host, begins with the
rule's key: an interval of the sorted keys. Intervals of prefixes are nested or
disjoint. A sweep over the sorted keys that meets a url has, as its stack of
open rules, the last rule that began and the rules around it; the deepest of
these that still holds the url is its rule at that level of the host. Each
level of a url's host is one probe, so that a rule for a host covers all of its
subdomains.

The sweep is cut into ranges of keys; each range starts with the last rule that
began before it, so no task sees more than its own range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftspark.session import cut

#: The contract's rules: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``host`` (A-Z lower-cased) and ``path``; null or no ``://``: both empty."""
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return df.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))


def _key(host, path):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), path)


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def _stacks(rules: DataFrame) -> DataFrame:
    """Each distinct rule key with its stack: itself and the rules around it, deepest first.

    Rules without host or path, or with a null in them, fit nothing and are left out;
    of two rules with one key the blocking one holds.
    """
    rules = rules.select("rule_host", "rule_path", "rule_verdict").where("rule_host <> '' and rule_path like '/%' and rule_verdict is not null")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    rules = rules.withColumn("key", _key(F.col("rule_host"), F.col("rule_path")))
    # the rules around a rule have its host and a proper prefix of its path
    size = F.length("rule_path")
    around = rules.select(F.col("key").alias("of"), "rule_host", F.explode(F.sequence(F.lit(1), size)).alias("n"), "rule_path").select("of", "rule_host", F.expr("substring(rule_path, 1, n)").alias("rule_path"))
    around = around.join(rules.select("rule_host", "rule_path", "rule_verdict", "key"), ["rule_host", "rule_path"])
    one = F.struct(F.length("key").alias("n"), F.col("key").alias("key"), F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict"))
    return around.groupBy(F.col("of").alias("key")).agg(F.sort_array(F.collect_list(one), asc=False).alias("stack"))


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", default: str = "allow") -> DataFrame:
    """``id_col``, host, path, rule and verdict of each row of ``urls`` (columns: id, ``url``).

    The longest fitting rule wins, by host and then by path. A url without
    host or without fitting rule has a null rule and the ``default`` verdict.
    Repeated ids and rows are judged one by one; a null id stays null. Other
    columns are not read. No rules: all rows get the default.
    """
    spark = urls.sparkSession
    pages = split_url(urls.select(F.col(id_col).alias("id"), "url")).select("id", "host", "path")
    same = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("times")).drop("times")
    labels = F.split("host", r"\.", -1)
    level = F.sequence(F.lit(1), F.size(labels))
    probe = same.where("host <> ''").select("host", "path", labels.alias("labels"), F.explode(level).alias("level"))
    probe = probe.select(F.concat(F.array_join(F.reverse(F.slice("labels", F.size("labels") - F.col("level") + 1, F.col("level"))), "."), F.col("path")).alias("key"), "host", "path", "level")
    empty = "array<struct<n:int,key:string,rule:string,verdict:string>>"
    events = probe.withColumn("stack", F.lit(None).cast(empty)).unionByName(_stacks(rules).select("key", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("level"), "stack"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # written once: both uses below must see the same ranges
    events = cut(events.repartitionByRange(n, "key", "level", "host").withColumn("range", F.spark_partition_id()))
    # a rule sorts before the urls with its own key
    order = Window.partitionBy("range").orderBy("key", "level", "host")
    swept = events.withColumn("open", F.last("stack", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # one row for each range
    carry = events.groupBy("range").agg(F.max_by("stack", F.when(F.col("stack").isNotNull(), F.col("key"))).alias("ending"))
    carry = carry.withColumn("carried", F.last("ending", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).select("range", "carried")
    swept = swept.where("stack is null").join(F.broadcast(carry), "range").withColumn("open", F.coalesce("open", "carried"))
    found = swept.withColumn("hit", F.get(F.expr("filter(open, r -> startswith(key, r.key))"), 0)).where("hit is not null")
    best = found.groupBy("host", "path").agg(F.max_by("hit", "level").alias("hit")).select("host", "path", F.col("hit.rule").alias("rule"), F.col("hit.verdict").alias("verdict"))
    return pages.join(best, ["host", "path"], "left").select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def op10_url_filters(pages: DataFrame) -> DataFrame:
    """Host, path, rule and verdict of every page's url; without a rule that fits it is allowed."""
    return judge(pages, rule_table(pages.sparkSession))


#: Each page against each rule; the longest rule that fits, no sweep.
OP10_SQL = """
WITH r(rule_host, rule_path, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS k, page_id,
  coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
m AS (SELECT k, rule_host || rule_path AS rule, v, row_number() OVER (PARTITION BY k ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS n
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN m ON u.k = m.k AND m.n = 1
"""
