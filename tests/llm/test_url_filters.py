import re

import duckdb

from siftspark.llm import urlrules

URLS = [None, "", "no scheme", "http://", "http:///x", "http://Com/a", "https://EXAMPLE.com/en/x?y#z", "http://www.example.com/en/", "http://a.www.example.com/en/q", "http://www.example.com/fr/", "http://notexample.com/en/", "ftp://x.net/es/1", "http://x.net/es", "http://net/fr/", "http://com", "http://com?x/en/", "http://a..com/", "http://example.com./en/", "x://y://z.com/a", "http://example.com/en/\nb", "http://h\u00e9.com/\u00e9", "http://a.org/en/"]


def plain(url, rules, default="allow"):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("", "") if not m else (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2])
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, default))


def check(spark, urls, rules, parts=3):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(parts)
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
    got = {r.page_id: tuple(r)[1:] for r in urlrules.judge(df, table).collect()}
    assert got == {k: plain(u, rules) for k, u in enumerate(urls)}


def test_contract_rules(spark):
    check(spark, URLS * 2, list(urlrules.RULES))


def test_nested_rules(spark):
    rules = [("com", "/", "allow"), ("com", "/a", "block"), ("com", "/a/b", "allow"), ("com", "/a/b/c", "block"), ("x.com", "/a", "allow"), ("y.x.com", "/", "block"), ("org", "/z", "block")]
    hosts, paths = ["com", "x.com", "y.x.com", "q.y.x.com", "org", "a.org"], ["", "/", "/a", "/ab", "/a/b", "/a/bc", "/a/b/c/d", "/z", "/zz/a"]
    check(spark, [f"http://{h}{p}" for h in hosts for p in paths], rules)


def test_no_rules_and_empty(spark):
    rules = urlrules.rule_table(spark).limit(0)
    df = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    assert [tuple(r)[1:] for r in urlrules.judge(df, rules).orderBy("host").collect()] == [("", "", None, "allow"), ("a.com", "/", None, "allow"), ("a.com", "/", None, "allow")]
    assert urlrules.op10_url_filters(df.limit(0)).count() == 0


def test_sql(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = sorted(duckdb.sql(urlrules.OP10_SQL).fetchall(), key=str)
    assert sorted((tuple(r) for r in urlrules.op10_url_filters(pages).collect()), key=str) == want
