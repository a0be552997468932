import math
import zlib
from collections import Counter

import pytest

from siftspark.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.op3_language_id(docs).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    tried = right = 0
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= g.score <= 1
        if g.held_out and r.lang and g.lang_pred != "und":
            tried += 1
            right += g.lang_pred == r.lang
    assert tried > 200 and right / tried > 0.98


def test_edges(spark):
    kind = "doc_id long, text string, lang string, score string"
    rows = [(1, "the cat and the dog", "en", "x"), (2, "der hund und die katze", "de", None), (3, None, "en", None), (4, "some text", None, None), (5, "", "de", None), (6, "123 $%", "en", None), (None, "und der", None, None), (8, "the " * 300000, "en", None)]
    df = spark.createDataFrame(rows, kind)
    model = langid.fit(df.where("doc_id < 3"))
    assert model.langs == ("de", "en")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert got[3] == got[5] == got[6] == ("und", 0.0)
    assert got[1][0] == got[8][0] == "en" and got[2][0] == got[None][0] == "de"
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "8", "None"]
    none = langid.fit(df.limit(0))
    assert none.langs == () and {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}


def test_ngrams_of_slices_meet(monkeypatch):
    text = "Aé b-c döf ghi" * 50
    whole = sorted(x for b in langid.ngram_buckets(text, (1, 2, 3), 14) for x in b.tolist())
    for size in (1, 2, 3, 7, 50):
        monkeypatch.setattr(langid, "_SLICE", size)
        assert sorted(x for b in langid.ngram_buckets(text, (1, 2, 3), 14) for x in b.tolist()) == whole


def test_brute_force(spark):
    """The same model by dictionaries and loops, n-grams of a plain scan included; ties go to the first name."""
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the cat sat", "en"), ("a cat", "en"), ("die katze", "de"), ("le chat noir", "fr"), ("the dog", "en"), ("", "fr"), ("der hund, die maus 12", "de")])]
    asked = [(0, "cat"), (1, "chat"), (2, "katze und maus"), (3, "zzz"), (4, "x-y"), (5, "The  CAT"), (6, "1 2"), (7, None)]

    def grams(text):
        out, line = [], ""
        for c in text.lower():
            c = c if "a" <= c <= "z" or ord(c) >= 0xAA else " "
            line += c if c != " " or not line or line[-1] != " " else ""
        for n in (1, 2, 3):
            out += [line[k : k + n] for k in range(len(line) - n + 1)]
        return out

    def bucket(gram):
        return next(iter(b for part in langid.ngram_buckets(gram, (len(gram),), 14) for b in part.tolist()))

    langs = ["de", "en", "fr"]
    counts = {x: Counter(bucket(g) for _, t, y in rows if y == x for g in grams(t)) for x in langs}
    docs = Counter(y for _, _, y in rows)
    want = {}
    for k, t in asked:
        if not t or not any(c.isalpha() for c in t):
            want[k] = ("und", 0.0)
            continue
        total = [math.log((docs[x] + 1) / (len(rows) + 3)) + sum(math.log((counts[x][bucket(g)] + 0.5) / (sum(counts[x].values()) + 0.5 * 2**14)) for g in grams(t)) for x in langs]
        best = max(range(3), key=lambda i: (total[i], -i))
        want[k] = (langs[best], 1 / sum(math.exp(v - total[best]) for v in total))
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert got == {k: (x, pytest.approx(p, rel=1e-4)) for k, (x, p) in want.items()}


def test_other_scripts_go_and_clean_texts_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs.where(~langid.held_out()))
    lettered = docs.where("text rlike '[A-Za-z]'")
    assert langid.keep_known(lettered.where("length(text) > 40"), model).count() == lettered.where("length(text) > 40").count()
    odd = spark.createDataFrame([(1, "这是一个完全不同的文字系统里的句子"), (2, "Это предложение написано другой письменностью")], "doc_id long, text string")
    assert langid.keep_known(odd, model).count() == 0
