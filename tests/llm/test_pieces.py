import math
from collections import Counter
from functools import cache

import numpy as np
import pytest

from siftspark.llm import pieces

TEXTS = ["", " ", "a  b", "▁x ▁", "\n\t\x00é中𝄞 �", "x" * 500, "The quick brown fox.\nNaïve ça über ▁ñ  ", " lead", "trail ", "\U0001f600 ok"]


@pytest.fixture(scope="module")
def vocab():
    return pieces.vocabulary(pieces.default_model(), 1.0)


def spelt(vocab, ids):
    return b"".join(vocab.bytes_of[k] for k in ids)[1:].decode()


def test_round_trip(vocab):
    ids = pieces.encode_texts(TEXTS, list(range(len(TEXTS))), pieces.Lattices(vocab))
    assert [spelt(vocab, r) for r in ids] == TEXTS


def test_batches_do_not_matter(vocab, monkeypatch):
    texts = TEXTS * 3
    whole = pieces.encode_texts(texts, list(range(len(texts))), pieces.Lattices(vocab))
    monkeypatch.setattr(pieces, "_UNITS", 2)
    monkeypatch.setattr(pieces, "_KEPT", 3)
    monkeypatch.setattr(pieces, "_NEW", 2)
    parts = pieces.encode_texts(texts, list(range(len(texts))), pieces.Lattices(vocab))
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))
    other = pieces.encode_texts(["segmentation of words"] * 40, list(range(40)), pieces.Lattices(vocab))
    assert len({tuple(r) for r in other}) > 3


def test_probabilities_are_brute_force(vocab):
    word = "tion"
    known = {b: k for k, b in enumerate(vocab.bytes_of) if b}

    @cache
    def ways(rest):
        if not rest:
            return [((), 0.0)]
        out = []
        for n in range(1, len(rest) + 1):
            k = known.get(rest[:n].encode())
            if k is not None and vocab.log_weight[k] < 0:
                out += [((k, *ids), vocab.log_weight[k] + w) for ids, w in ways(rest[n:])]
        return out

    every = ways(" " + word)
    total = sum(math.exp(w) for _, w in every)
    n = 20_000
    drawn = Counter(tuple(r.tolist()) for r in pieces.encode_texts([word] * n, list(range(n)), pieces.Lattices(vocab)))
    assert set(drawn) <= {ids for ids, _ in every}
    for ids, w in every:
        p = math.exp(w) / total
        assert abs(drawn[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9


def test_table(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, None, None), (None, "no key", "y"), (3, "again", "z"), (3, "again", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    got = pieces.decode(pieces.encode(df), out="back").collect()
    assert all(r.back == r.text for r in got) and {r.decoded for r in got} == {"x", "y", "z", None}
    again = [tuple(r.piece_ids) for r in got if r.text == "again"]
    assert again[0] == again[1]
    out = pieces.op1_sentencepiece(df).collect()
    assert all(r.lossless for r in out) and len(out) == len(rows)
    assert pieces.op1_sentencepiece(df.limit(0)).count() == 0


def test_op1_on_table(spark, sf_dir):
    got = pieces.op1_sentencepiece(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert got.where("not lossless").count() == 0 and got.where("n_pieces < 1").count() == 0
