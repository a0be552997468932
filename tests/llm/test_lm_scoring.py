import math
import zlib
from collections import Counter

import pytest

from siftspark.llm import backoff


def plain(rows, min_count=1, d=0.75):
    """(n_tokens, n_known, N, base, score) of each (text, held) row, with dictionaries."""
    texts = [((t or "").encode().lower().split(), h) for t, h in rows]
    uni, bi = Counter(), Counter()
    n_docs = 0
    for w, h in texts:
        if not h:
            n_docs += 1
            uni.update([*w, "$"])
            bi.update(zip(["^", *w], [*w, "$"]))
    bi = Counter({k: c for k, c in bi.items() if c >= min_count})
    kept = Counter()
    for (h, _), c in bi.items():
        kept[h] += c - d
    total, size = sum(uni.values()), len(uni)
    count = lambda h: n_docs if h == "^" else uni[h]
    out = []
    for w, _ in texts:
        base = score = 0.0
        for h, x in zip(["^", *w], [*w, "$"]):
            p = (uni[x] + 1) / (total + size + 1)
            base += math.log10(p)
            fail = 1 - kept[h] / count(h) if count(h) else 1.0
            score += math.log10(fail * p + ((bi[h, x] - d) / count(h) if (h, x) in bi else 0))
        out.append((len(w) + 1, sum(uni[x] > 0 for x in [*w, "$"]), total, base, score))
    return out


@pytest.mark.parametrize("chunk_tokens", [10**6, 30])
def test_brute_force(spark, chunk_tokens):
    texts = ["a b c", "a b d", None, "", "A\tB c\x0bd é", "zzz a b c a b c a b c", "x", "x", "new words only here", " "] * 6
    rows = [(i, t, i % 5 == 3, 1, "n") for i, t in enumerate(texts)] + [(None, "a b", None, 2, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, chunk int, kind string").repartition(3)
    got = {r.doc_id: r for r in backoff.score(df, chunk_tokens=chunk_tokens).collect()}
    want = plain([(t, h is None or h) for _, t, h, _, _ in rows])
    assert len(got) == len(rows)
    for (i, _, h, _, _), w in zip(rows, want):
        g = got[i]
        assert g.held_out == (h is None or h) and (g.n_tokens, g.n_known, g.train_tokens) == w[:3]
        assert g.base_score == pytest.approx(w[3]) and g.score == pytest.approx(w[4])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, held_out boolean")
    assert backoff.score(df).count() == 0
    df = spark.createDataFrame([(1, "a b", True), (2, None, True)], "doc_id long, text string, held_out boolean")
    got = sorted(backoff.score(df).collect())
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]


def test_op6_on_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in backoff.op6_lm_scoring(docs).collect()}
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in docs.collect()]
    for (i, _, h), w in zip(rows, plain([(t, h) for _, t, h in rows])):
        assert got[i].held_out == h and (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == w[:3]
        assert got[i].base_score == pytest.approx(w[3]) and got[i].score == pytest.approx(w[4])
    held = [g for g in got.values() if g.held_out]
    assert sum(g.score for g in held) > sum(g.base_score for g in held)
