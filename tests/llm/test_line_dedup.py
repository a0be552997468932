import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.llm import linedup


def plain(docs, t=0.8):
    """Per (id, text): the places removed, by comparing all lines."""
    order, out = [], {}
    for i, x in sorted({(d[0], d[1]) for d in docs if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0)):
        for p, line in enumerate(x.split("\n")):
            s = frozenset(line.lower().split())
            if not s:
                continue
            if any(len(s & o) >= t * len(s | o) - 1e-9 for o in order):
                out.setdefault((i, x), []).append(p)
            order.append(s)
    return out


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    vocab = ["w%d" % k for k in range(150)]
    base = [[vocab[min(int(k), 149)] for k in rng.exponential(40, rng.integers(1, 25))] for _ in range(25)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(rng.integers(1, 7)):
            b = list(base[rng.integers(25)])
            for _ in range(rng.integers(0, 3)):
                b[rng.integers(len(b))] = vocab[rng.integers(150)]
            lines.append(" ".join(b))
        docs.append((i, "\n".join(lines)))
    return docs


@pytest.mark.parametrize("seed,t", [(1, 0.8), (2, 0.8), (3, 0.6)])
def test_brute_force(spark, seed, t):
    docs = corpus(seed, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: list(r.gone) for r in linedup.dedup_lines(df, threshold=t, removed="gone").collect()}
    want = plain(docs, t)
    assert got == {d[0]: want.get(d, []) for d in docs}


def test_edges(spark):
    long = "\n".join("line number %d of a long text" % k for k in range(3000))
    rows = [(1, "Same line\n\nother words here", "p"), (2, "same LINE", "q"), (None, "other words here", "r"), (3, None, "s"), (4, "", "t"), (5, "\n\n", "u"), (6, "x", "v"), (6, "x", "v"), (7, long, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos string")
    out = linedup.dedup_lines(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id or 0, r.text) for r in out.collect() if r.doc_id != 7), key=str)
    assert got == sorted([(1, "Same line\n"), (2, ""), (0, "other words here"), (3, None), (4, ""), (5, "\n\n"), (6, "x"), (6, "x")], key=str)
    assert linedup.op9_line_dedup(df.limit(0)).count() == 0


def test_wide_path(spark, monkeypatch):
    monkeypatch.setattr(linedup, "_BROADCAST_LINES", 0)
    docs = corpus(4, 30)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = plain(docs)
    assert {r.doc_id: list(r.gone) for r in linedup.dedup_lines(df, removed="gone").collect()} == {d[0]: want.get(d, []) for d in docs}


def test_sql(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    assert sorted(tuple(r) for r in linedup.op9_line_dedup(docs).collect()) == sorted(con.sql(linedup.OP9_SQL).fetchall())


def test_own_names_in_the_table(spark):
    df = spark.createDataFrame([(1, "a b c\nd e f", "x", 5, 6), (2, "a b c", "y", 7, 8)], "doc_id long, text string, __dk string, __gone int, __DK_ int")
    got = linedup.dedup_lines(df)
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [(1, "a b c\nd e f", "x", 5, 6), (2, "", "y", 7, 8)]


def test_prefixes_tell_far_lines_apart(spark):
    rng = np.random.default_rng(7)
    made = []
    for i in range(20):
        base = ["v%d" % k for k in rng.choice(400, 120, replace=False)]
        made.append((2 * i, "common " + " ".join(base)))
        other = [w if rng.random() > 0.05 else "v%d" % rng.integers(400) for w in base]
        made.append((2 * i + 1, "common " + " ".join(other)))
    docs = spark.createDataFrame(made, "doc_id long, text string").selectExpr("doc_id AS id", "doc_id AS dk", "text")
    sets = linedup._line_sets(docs, 0.8)
    classes = sets.groupBy(*linedup._SET).agg(F.min("id").alias("c"), F.min("n").alias("n"), F.min("prefix").alias("prefix"))
    pairs = classes.select("c").crossJoin(classes.select(F.col("c").alias("first"))).where("first < c")
    near = {(r.c, r.first) for r in linedup._near_heads(pairs, classes, 0.8).collect()}
    words = {i: frozenset(t.split()) for i, t in made}
    true = {(c, f) for c in words for f in words if f < c and len(words[c] & words[f]) >= 0.8 * len(words[c] | words[f]) - 1e-9}
    # no match is lost, and of 780 pairs hardly any other is read again
    assert len(true) >= 15 and true <= near and len(near) <= 2 * len(true)


def test_repeated_documents(spark):
    rows = [(None, " \nsame words of one line here\nmore")] * 3 + [(4, "same words of one line here too"), (4, "same words of one line here too"), (5, "MORE")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.text, list(r.gone)) for r in linedup.dedup_lines(df, removed="gone").collect()), key=str)
    want = plain(rows)
    assert got == sorted(((i or 0, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want.get((i, t), [])), want.get((i, t), [])) for i, t in rows), key=str)
