"""Quality rules against a plain loop over words, and the DuckDB form."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from siftspark.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines),
        "n_dup_lines": sum(line in lines[:k] for k, line in enumerate(lines)), "n_repeat_words": len(inside), "n_upper": sum(c != c.lower() for c in text), "n_bangs": text.count("!"),
    }


def texts():
    pick = random.Random(5)
    made = [None, "", " \n\t ", "a", "a a a", "a a a a", "a b\x1cc\xa0d e", "İ A ß", "x\r\ny\r\n\nx\ny", "#a ## <b>|\n#a ## <b>|", "é́ É"]
    for _ in range(60):
        made.append("".join(pick.choice(["a", "B", "cé", "#", "!"]) + pick.choice([" ", " ", "\n", "\t", ""]) for _ in range(pick.randrange(160))))
    return [*made, made[-1], ("uno dos tres " * 30_000).strip(), "ab" * 1_500_000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts())], "doc_id long, text string, quality string, failed int")


def test_brute_force(docs):
    got = {r.doc_id: r for r in Q.op12_quality_rules(docs).collect()}
    for k, text in enumerate(texts()):
        if text and len(text) > 100_000:
            continue
        want = plain(text)
        assert {m: got[k][m] for m in Q.MEASURES} == want, text
        assert got[k].base_failed == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (got[k].base_failed and got[k].kept)
    long = got[len(texts()) - 2]
    assert (long.n_words, long.n_repeat_words, long.n_lines) == (90_000, 90_000, 1)
    assert got[len(texts()) - 1].word_chars == 3_000_000


def test_sql(spark, docs):
    con = duckdb.connect()
    small = docs.where("doc_id not in (7, 10) and (text is null or length(text) < 100000)").toPandas()[["doc_id", "text"]]  # DuckDB takes these two in graphemes
    con.register("documents", small)
    want = con.sql(Q.OP12_SQL).df().set_index("doc_id").sort_index()
    got = Q.op12_quality_rules(spark.createDataFrame(small)).toPandas().set_index("doc_id").sort_index()
    assert got[want.columns].equals(want)


def test_ledger_keeps_columns_and_policies(docs):
    rows = Q.apply(Q.ledger(docs, out="quality"), Q.BASE, Q.Policy("lenient", Q.DEFAULT.rules, allowed=1))
    assert rows.columns == ["doc_id", "text", "quality", "failed", "kept_base", "kept_lenient"]
    for r in rows.select("quality", "kept_base", "kept_lenient").collect():
        assert r.kept_base == (r.quality.failed & 3 == 0) and r.kept_lenient == (r.quality.failed.bit_count() <= 1)
    kept = Q.filter_quality(docs)
    assert kept.columns == docs.columns and kept.where("quality <> 'x'").count() == 0


def test_ablations(docs):
    rows = Q.ledger(docs.withColumn("half", F.col("doc_id") % 2), out="ledger")
    bits = [(r.half, r.failed) for r in rows.select("half", "ledger.failed").collect()]
    for allowed in (0, 1):
        policy = Q.Policy("p", ("few_words", "many_symbols", "exclamations"), allowed)
        got = {(r.half, r.rule): r for r in Q.ablations(rows, policy, ("half",), "ledger").collect()}
        assert len(got) == 6
        for (half, rule), r in got.items():
            bit = 1 << [n for n, _ in Q.RULES].index(rule)
            mine = [b & policy.mask for h, b in bits if h == half]
            kept, without = [b.bit_count() <= allowed for b in mine], [(b & ~bit).bit_count() <= allowed for b in mine]
            assert (r.n, r.n_kept, r.n_failed, r.n_kept_without) == (len(mine), sum(kept), sum(b & bit != 0 for b in mine), sum(without))
            assert r.n_alone == sum(w and not k for k, w in zip(kept, without, strict=True))


def test_empty(docs):
    none = docs.limit(0)
    assert Q.op12_quality_rules(none).count() == 0 and Q.ablations(Q.ledger(none), Q.DEFAULT).count() == 0
