import numpy as np
import pytest

from siftspark.llm import setjoin, simhash


def similarity(a, b):
    a, b = (set(simhash.shingle_hashes(x, 5).tolist()) for x in (a, b))
    return len(a & b) / len(a | b) if a | b else 1.0


def kept_ids(texts, threshold=0.8):
    """Smallest id of each group, by all pairs in plain Python."""
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if similarity(texts[a], texts[b]) >= threshold:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return sorted(set(root))


def told(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    return sorted(r.doc_id for r in simhash.keep_one(df).collect())


def edited(words, at, mark):
    return " ".join(f"{mark}{i}" if i in at else w for i, w in enumerate(words))


def test_every_pair_at_the_threshold_is_met(spark):
    """200 pairs at 0.80 to 0.82, of which fingerprints in blocks lose some."""
    rng = np.random.default_rng(11)
    texts = []
    for k in range(200):
        words = [f"k{k}w{i}" for i in rng.integers(0, 10**6, 120)]
        # n = 116 shingles; an edit amid the text turns 5, the last word 1: 12 of 116 give 104 / 128 = 0.81
        texts += [" ".join(words), edited(words, {20 + k % 10, 60 + k % 10, 0, 119}, "x")]
    sims = [similarity(a, b) for a, b in zip(texts[::2], texts[1::2])]
    assert 0.8 <= min(sims) and max(sims) < 0.83
    assert told(spark, texts) == list(range(0, 400, 2))


def test_nothing_below_the_threshold_is_linked(spark):
    """Pairs at 0.70 to 0.79 stay, both of them."""
    rng = np.random.default_rng(12)
    texts = []
    for k in range(200):
        words = [f"k{k}w{i}" for i in rng.integers(0, 10**6, 120)]
        texts += [" ".join(words), edited(words, {20, 60, 90} if k % 2 else {20, 40, 60, 90}, "x")]
    sims = [similarity(a, b) for a, b in zip(texts[::2], texts[1::2])]
    assert 0.7 <= min(sims) and max(sims) < 0.8
    assert told(spark, texts) == list(range(400))


@pytest.mark.parametrize("rounds", [0, 6])
def test_groups_are_brute_force(spark, monkeypatch, rounds):
    """Large groups of near copies, chains, shared passages, short and empty texts."""
    monkeypatch.setattr(setjoin, "_ROUNDS", rounds)
    rng = np.random.default_rng(13)
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [None, "", " \n", "one", "ONE", "a b c d", "a b c d e", "A b  c d e", "a b c d e f"]
    for k in range(6):
        words = [f"k{k}w{i}" for i in rng.integers(0, 10**6, 150)]
        for _ in range(30):
            texts.append(edited(words, set(rng.choice(150, rng.integers(0, 6), replace=False).tolist()), f"e{rng.integers(3)}"))
    for k in range(40):
        texts.append(passage + " " + " ".join(f"f{k}w{i}" for i in range(int(rng.integers(1, 60)))))
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[a : a + 100]) for a in range(0, 80, 8)]
    assert told(spark, texts) == kept_ids(texts)


def test_shingles_are_counted_over_all_texts(spark):
    import numpy as np

    from siftspark.llm import setjoin

    rows = spark.range(30_000).selectExpr("id AS key", "concat_ws(' ', 'every text begins like this', id) AS text").repartition(5)
    counts = setjoin._counts(rows, 5)
    assert counts.sum() == 2 * 30_000
    assert counts[setjoin._slot(setjoin._shingles("every text begins like this", 5))][0] >= 30_000
    assert setjoin._counts(rows.limit(0), 5).tolist() == np.zeros(setjoin._SLOTS, int).tolist()
