from collections import Counter

import duckdb
import numpy as np

from siftspark.llm import decontam


def plain(docs, items, t=0.8, shingle=5):
    """Best window of every document for every item, by sliding over all starts."""
    out = {}
    for d, x in docs:
        w = (x or "").lower().split()
        for i, y in items:
            v = (y or "").lower().split()
            if not v:
                continue
            k = min(shingle, len(v))
            want = Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
            hs = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            mw = min(len(v) - k + 1, len(hs))
            for s in range(len(hs) - mw + 1) if hs else ():
                got = Counter(hs[s : s + mw])
                sim = sum((got & want).values()) / sum((got | want).values())
                if sim >= t - 1e-9 and sim > out.get((d, i), (0,))[0]:
                    out[d, i] = (sim, s, len(v))
    return {k: (round(a, 6), b, c) for k, (a, b, c) in out.items()}


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": decontam.F.lit("x"), "dk": decontam.F.lit(1)}).repartition(3)
    got = decontam.op7_decontamination(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): (r.similarity, r.word_start, r.n_words) for r in got}, len(got)


def test_brute_force(spark):
    rng = np.random.default_rng(0)
    word = lambda n: ["v%d" % i for i in rng.integers(0, 400, n)]
    items = [(i, " ".join(word(rng.integers(12, 70)))) for i in range(20)]
    items += [(20, "the the the the the the the the"), (21, "only three words"), (22, None), (23, ""), (24, items[3][1])]
    docs = []
    for d in range(60):
        text = word(rng.integers(0, 120))
        if d % 2:
            leak = items[rng.integers(20)][1].split()
            at = rng.integers(0, len(text) + 1)
            if d % 4 == 1 and len(leak) > 40:
                leak[rng.integers(len(leak))] = "edit"
            if d % 8 == 3:
                leak = leak[1:]
            text[at:at] = leak
        docs.append((d, " ".join(text)))
    docs += [(100, None), (101, ""), (102, "a The THE the the the the the\tthe\nthe b"), (103, "see Only three\nWORDS here"), (104, items[5][1]), (105, " ".join(items[6][1].split()[:-1])), (None, items[7][1]), (106, " ".join(x for _, x in items[:20]) * 2)]
    got, n = run(spark, docs, items)
    assert got == plain(docs, items) and n == len(got)


def test_wide_paths_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(decontam, "_BROADCAST_SHINGLES", 0)
    monkeypatch.setattr(decontam, "_BROADCAST_DOCS", 0)
    text = "one two three four five six seven eight nine ten"
    docs = [(1, "x " + text), (1, "x " + text), (2, "clean text of other words entirely yes")]
    got, n = run(spark, docs, [(7, text)])
    assert got == {(1, 7): (1.0, 1, 10)} and n == 1
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, text)], "item_id long, text string")
    assert [r.doc_id for r in decontam.drop_leaked(d, i).collect()] == [2]
    assert decontam.find_leaks(d.limit(0), i).count() == 0 and decontam.find_leaks(d, i.limit(0)).count() == 0
    assert decontam.drop_leaked(d, i.limit(0)).count() == 3


def test_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = decontam.op7_decontamination(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.sql(decontam.OP7_SQL).fetchall())


def test_no_pair_at_the_threshold_is_lost(spark):
    """400 items, each with a document at 0.80 to 0.82 of which fingerprints of 64 bits lose some."""
    rng = np.random.default_rng(4)
    items, docs, want = [], [], {}
    for k in range(400):
        words = ["k%dw%d" % (k, i) for i in rng.integers(0, 10**6, 120)]
        turned = {20 + k % 10, 60 + k % 10, 0, 119}
        items.append((k, " ".join(words)))
        docs.append((k, " ".join("x%d" % i if i in turned else w for i, w in enumerate(words))))
        want |= plain(docs[-1:], items[-1:])
    assert len(want) == 400 and max(v[0] for v in want.values()) < 0.83
    got, n = run(spark, docs, items)
    assert got == want and n == 400


def test_the_index_selects(spark):
    """Items of one length with some shingles in common: few window-item pairs meet, and none that is near is lost."""
    rng = np.random.default_rng(4)
    pool = [[f"c{j}_{k}" for k in range(12)] for j in range(6)]  # passages that many items share
    items = [(i, " ".join([*pool[rng.integers(6)], *(f"w{x}" for x in rng.integers(0, 500, 38))])) for i in range(80)]
    docs = []
    for d in range(60):
        leak = items[rng.integers(80)][1].split()
        leak[25] = "edit"  # five of 46 shingles: similarity 0.80
        docs.append((d, " ".join([f"x{x}" for x in rng.integers(0, 500, 20)] + leak)))
    seen = []
    real = decontam._candidates

    def counted(*args):
        seen.append(real(*args))
        return seen[-1]

    decontam._candidates = counted
    try:
        got, _ = run(spark, docs, items)
    finally:
        decontam._candidates = real
    assert got == plain(docs, items) and len(got) >= 60
    pairs = seen[0].select("dk", "n", "start", "ik")
    windows = pairs.select("dk", "n", "start").distinct().count()
    assert pairs.count() < 0.05 * windows * 80 * decontam._BLOCKS


def test_clashing_names(spark):
    text = " ".join(f"w{k}" for k in range(40))
    df = spark.createDataFrame([(1, text, "a", 5, 6), (2, "other words", "b", 7, 8)], "doc_id long, text string, __dk string, __DK_ int, h int")
    got = decontam.drop_leaked(df, spark.createDataFrame([(1, text)], "item_id long, text string"))
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(2, "other words", "b", 7, 8)]


def test_the_index_of_blocks_is_not_broadcast(spark):
    windows = spark.createDataFrame([(1, 6, 2, 2, 0, [5, 6], [5])], "dk long, n int, m int, mw int, start int, hs array<long>, rare array<long>")
    item = spark.createDataFrame([(9, 1, 6, 5, [5, 6])], "ik long, item_id long, n int, k int, hs array<long>")
    often = spark.createDataFrame([(5, 1), (6, 1)], "h long, c long")
    out = decontam._candidates(windows, item, often, 0.8)
    said = out._jdf.queryExecution().executedPlan().toString()
    assert min((said.index(j), j) for j in ("SortMergeJoin", "BroadcastHashJoin") if j in said)[1] == "SortMergeJoin"
    assert [tuple(r) for r in out.select("dk", "ik").distinct().collect()] == [(1, 9)]
