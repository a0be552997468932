import pytest
import numpy as np

from siftspark.llm import neargraph


def plain(rows, t=0.9):
    """n_links and component of each row, by all pairs in double precision."""
    good = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[k] = x / np.sqrt(x @ x)
    root, n = list(range(len(rows))), [0] * len(rows)
    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= t:
                n[a] += 1
                n[b] += 1
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root[k]] = min(low.get(root[k], i), i)
    return [(i, n[k], low.get(root[k])) for k, (i, _) in enumerate(rows)]


def test_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(150, 16))
    rows = [b for b in base]
    for k in range(40):
        rows += [base[k] + rng.normal(size=16) * 0.05 for _ in range(int(rng.integers(1, 4)))]
    rows += [base[0]] * 5 + [base[1] * 2] + [base[2] + rng.normal(size=16) * 0.02 for _ in range(60)]
    rows = [(i, [float(x) for x in np.float32(r)]) for i, r in enumerate(rows)]
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 16), (n + 3, [float("nan")] * 16), (n + 4, [float("inf")] + [0.0] * 15), (n + 5, [None] + [1.0] * 15), (n + 6, [1.0, 2.0]), (n + 7, [2.0, 4.0]), (n + 7, [2.0, 4.0]), (None, [5.0, -5.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, node int, v string").repartition(3)
    got = neargraph.near_groups(df, shard_rows=60, overlap=3).collect()
    want = plain(rows)
    assert len(got) == len(want)
    key = lambda t: (t[0] is None, *map(str, t))
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=key) == sorted(want, key=key)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert neargraph.near_groups(df.limit(0)).count() == 0


def test_recall_with_many_centres(spark):
    """Planted pairs at 0.90 to 0.95 and a group of near but different vectors, dealt to hundreds of shards; links are looked for one by one."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(4000, 64)))
    cos = rng.uniform(0.905, 0.95, 2000)[:, None]
    side = rng.normal(size=(2000, 64))
    side = unit(side - (side * base[:2000]).sum(1, keepdims=True) * base[:2000])
    mates = cos * base[:2000] + np.sqrt(1 - cos**2) * side
    group = unit(base[:1] + 0.25 * unit(rng.normal(size=(300, 64))))
    rows = [(i, x.tolist()) for i, x in enumerate(np.concatenate((base, mates, group)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    edges = neargraph.links(neargraph.nodes_of(df), shard_rows=30).cache()
    assert neargraph.recall(df, edges, every=10) >= 0.9
    with pytest.raises(ValueError):
        neargraph.recall(df.where("vec_id between 3000 and 3999"), edges)
