"""Embedding near-dedup over a robust-pruned flat graph.

1. Equal vectors are one node. Cluster centres are fitted on a bounded sample;
   every node goes to its ``overlap`` nearest centres, so shards overlap.
2. In each shard a flat graph is built: a node's nearest members and some random
   ones are its candidates, and a candidate is left out if an already chosen
   neighbour is much nearer to it than the node is (robust pruning).
3. A node's adjacency lists from all of its shards are united.
4. In each shard every member is a query: greedy search from the medoids of the
   shard's parts, then a range expansion over all nodes above the threshold.
5. Links are verified in double precision; recall is audited against brute
   force by :func:`recall`.

A shard has about ``shard_rows * overlap`` rows: there are as many centres as
that takes, up to one for each row of the sample, and dense places get more of
them. Two vectors are compared if one of the ``overlap`` centres nearest to
each is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm.components import components
from siftspark.session import stored

#: Rows of the hash-ordered sample on which centres are fitted, for 64 doubles each about 10 MB.
FIT_ROWS = 20_000
_NEAR, _RANDOM, _DEGREE, _BEAM, _BLOCK, _ENTRIES = 32, 24, 20, 32, 256, 8
_ALPHA = 1.2


def _units(rows) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = np.stack([np.asarray(r, np.float64) for r in rows])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _centres(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from evenly spread rows."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        near = np.concatenate([(x[a : a + 4096] @ c.T).argmax(1) for a in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def build_graph(x: np.ndarray, seed: int) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row of ``x`` (unit rows, float32), as local indices."""
    n, rng = len(x), np.random.default_rng(seed)
    if n == 1:
        return [np.empty(0, np.int64)]
    lists: list[np.ndarray] = []
    near = min(_NEAR, n - 1)
    for a in range(0, n, _BLOCK):
        rows = np.arange(a, min(a + _BLOCK, n))
        sims = x[rows] @ x.T
        sims[np.arange(len(rows)), rows] = -2
        cand = np.argpartition(-sims, near - 1, axis=1)[:, :near]
        if n > near + 1:
            cand = np.concatenate((cand, rng.integers(0, n, (len(rows), _RANDOM))), axis=1)
        own = np.take_along_axis(sims, cand, 1)
        order = np.argsort(-own, axis=1, kind="stable")
        cand, own = np.take_along_axis(cand, order, 1), np.take_along_axis(own, order, 1)
        alive, vectors = own > -2, x[cand]
        chosen = np.full((len(rows), _DEGREE), -1)
        for r in range(_DEGREE):
            some = alive.any(1)
            if not some.any():
                break
            first = alive.argmax(1)
            pick = np.take_along_axis(cand, first[:, None], 1)[:, 0]
            chosen[some, r] = pick[some]
            between = np.einsum("bld,bd->bl", vectors, x[pick])
            # squared distances of unit vectors are 2 - 2 cos
            alive &= ~(_ALPHA * (1 - between) <= 1 - own) & (cand != pick[:, None])
        lists += [c[c >= 0] for c in chosen]
    return lists


def range_search(x: np.ndarray, adjacency: np.ndarray, entries: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row, other row) found at ``threshold`` or just below, a block of queries at a time.

    ``adjacency`` holds local indices, padded by -1.
    """
    n = len(x)
    slack = threshold - 1e-4
    for a in range(0, n, _BLOCK):
        q = np.arange(a, min(a + _BLOCK, n))
        b, line = len(q), np.arange(len(q))[:, None]
        seen = np.zeros((b, n + 1), bool)
        seen[:, n] = True  # the padding
        hits = [np.empty((2, 0), np.int64)]

        def look(who: np.ndarray, node: np.ndarray, q=q, hits=hits) -> np.ndarray:
            sim = np.einsum("pd,pd->p", x[q[who]], x[node])
            inside = sim >= slack
            hits.append(np.stack((who[inside], node[inside])))
            return sim

        beam = np.repeat(entries[None, :], b, 0)
        seen[line, beam] = True
        sims = x[q] @ x[entries].T
        inside = np.argwhere(sims >= slack)
        hits.append(np.stack((inside[:, 0], entries[inside[:, 1]])))
        done = np.zeros(beam.shape, bool)
        while True:
            open_ = np.where(done, -3.0, sims)
            best = open_.argmax(1)
            rows = np.flatnonzero(np.take_along_axis(open_, best[:, None], 1)[:, 0] > -2)
            if not len(rows):
                break
            done[rows, best[rows]] = True
            next_ = adjacency[beam[rows, best[rows]]]
            who, k = np.nonzero(~seen[rows[:, None], next_])
            node = next_[who, k]
            seen[rows[who], node] = True
            new_beam, new_sims = np.full((len(rows), next_.shape[1]), n), np.full((len(rows), next_.shape[1]), -3.0)
            new_beam[who, k] = node
            new_sims[who, k] = look(rows[who], node)
            if beam.shape[1] < _BEAM:
                wide = _BEAM - beam.shape[1]
                beam = np.concatenate((beam, np.full((b, wide), n)), 1)
                sims, done = np.concatenate((sims, np.full((b, wide), -3.0)), 1), np.concatenate((done, np.ones((b, wide), bool)), 1)
            both = np.concatenate((sims[rows], new_sims), 1)
            top = np.argpartition(-both, _BEAM - 1, axis=1)[:, :_BEAM]
            sims[rows] = np.take_along_axis(both, top, 1)
            beam[rows] = np.take_along_axis(np.concatenate((beam[rows], new_beam), 1), top, 1)
            done[rows] = np.take_along_axis(np.concatenate((done[rows], new_sims <= -2), 1), top, 1)
        who, node = np.concatenate(hits, 1)
        while len(who):
            hits.clear()
            for s in range(0, len(who), 1 << 15):
                w, m = who[s : s + (1 << 15)], adjacency[node[s : s + (1 << 15)]]
                flat = np.unique(np.repeat(w, m.shape[1]) * (n + 1) + m.ravel())
                w, m = flat // (n + 1), flat % (n + 1)
                new = ~seen[w, m]
                w, m = w[new], m[new]
                seen[w, m] = True
                look(w, m)
            yield q[who], node
            who, node = np.concatenate(hits, 1)


def _build(df: pd.DataFrame) -> pd.DataFrame:
    df = df.sort_values("node")
    node = df["node"].to_numpy()
    lists = build_graph(_units(df["v"]).astype(np.float32), len(df))
    # edges both ways, so that what points somewhere can be reached from there
    a = np.repeat(np.arange(len(node)), [len(x) for x in lists])
    b = np.concatenate(lists).astype(np.int64)
    pairs = np.unique(np.concatenate((a * len(node) + b, b * len(node) + a)))
    a, b = pairs // len(node), pairs % len(node)
    cuts = np.searchsorted(a, np.arange(1, len(node)))
    return pd.DataFrame({"node": node, "next": [node[p] for p in np.split(b, cuts)]})


def _search(df: pd.DataFrame, threshold: float) -> pd.DataFrame:
    df = df.sort_values("node").drop_duplicates("node")
    node, exact = df["node"].to_numpy(), _units(df["v"])
    n, x = len(node), exact.astype(np.float32)
    inner = []
    for near in df["next"]:
        at = np.minimum(np.searchsorted(node, near), n - 1)
        inner.append(at[node[at] == near])
    adjacency = np.full((n, max(1, max(map(len, inner)))), n)
    for k, near in enumerate(inner):
        adjacency[k, : len(near)] = near
    entries = []
    for part in np.array_split(np.arange(n), min(_ENTRIES, n)):
        middle = x[part].mean(0)
        entries.append(part[(x[part] @ middle).argmax()])
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in range_search(x, adjacency, np.unique(entries), threshold):
        i, j = np.minimum(i, j), np.maximum(i, j)
        ok = (i != j) & (np.einsum("pd,pd->p", exact[i], exact[j]) >= threshold)
        us.append(i[ok]), vs.append(j[ok])
    both = np.unique(np.concatenate(us) * n + np.concatenate(vs))
    return pd.DataFrame({"u": node[both // n], "v": node[both % n]})


def _plain(vec: str) -> Column:
    """The vector in doubles, with one zero only: what a node's number is made of."""
    return F.transform(F.col(vec), lambda x: x.cast("double") + F.lit(0.0))


def nodes_of(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """Distinct linkable vectors: node, v array<double>, dim, low (smallest id), times."""
    v = F.transform(F.col(vec), lambda x: x.cast("double"))
    big = F.array_max(F.transform("v", F.abs))
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (big > 0)
    rows = df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))  # one zero only
    return rows.groupBy("v").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("times")).withColumn("node", F.xxhash64("v")).withColumn("dim", F.size("v"))


def links(nodes: DataFrame, threshold: float = 0.9, overlap: int = 5, shard_rows: int = 700) -> DataFrame:
    """``(u, v)`` for distinct nodes of one dimension with cosine ``threshold`` or more, as found."""
    spark = nodes.sparkSession
    size = {r.dim: r.n for r in nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = nodes.select("dim", "v", "node").orderBy(F.xxhash64("node"), "node").limit(FIT_ROWS).toPandas()
    centres = {}
    for dim, rows in sample.groupby("dim"):
        k = min(-(-size[dim] // shard_rows), len(rows))
        centres[int(dim)] = _centres(_units(rows["v"]), k).astype(np.float32)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for dim, rows in df.groupby("dim"):
                c = shared.value.get(int(dim), np.ones((1, int(dim)), np.float32))
                sims = _units(rows["v"]).astype(np.float32) @ c.T
                k = min(overlap, len(c))
                top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                yield pd.DataFrame({"dim": dim, "shard": top.ravel(), "node": rows["node"].to_numpy().repeat(k)})

    dealt = stored(nodes.select("dim", "node", "v").mapInPandas(assign, "dim int, shard int, node long"))
    vectors = dealt.join(nodes.select("node", "v"), "node")
    lists = vectors.groupBy("dim", "shard").applyInPandas(_build, "node long, next array<long>")
    united = stored(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next")))
    found = vectors.join(united, "node").groupBy("dim", "shard").applyInPandas(lambda df: _search(df, threshold), "u long, v long")
    return found.distinct()


def near_groups(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", threshold: float = 0.9, **how) -> DataFrame:
    """Per row: id, n_links, component_id and kept (id = component_id).

    A vector that is null, empty, zero or holds a null or non-finite component
    links with nothing and is its own component; so is a vector with a null
    id, which is kept and lends no id (repeated rows and equal vectors link).
    Vectors of different dimensions do not link. Other columns are not read.
    """
    nodes = stored(nodes_of(df, id_col, vec))
    edges = stored(links(nodes, threshold, **how))
    times = nodes.select(F.col("node").alias("v"), "times")
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    degree = both.join(times, "v").groupBy("u").agg(F.sum("times").alias("others")).withColumnRenamed("u", "node")
    root = components(edges)
    nodes = nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    nodes = nodes.join(best, "root").join(degree, "node", "left").select("node", (F.coalesce("others", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    out = df.select(F.col(id_col).alias("id"), F.xxhash64(_plain(vec)).alias("node")).join(nodes, "node", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def recall(df: DataFrame, edges: DataFrame, id_col: str = "vec_id", vec: str = "embedding", threshold: float = 0.9, every: int = 50) -> float:
    """Share of the true links of every ``every``-th id that are among the ``edges (u, v)`` of :func:`links`.

    The queries, one in ``every``, meet all rows in blocks, and each true link
    is looked for by itself. Without a true link there is nothing to measure: an error.
    """
    asked = df.where(F.col(id_col) % every == 0).select(F.xxhash64(_plain(vec)).alias("q"), F.col(vec).alias("qv")).dropDuplicates(["q"]).toPandas()
    shared = df.sparkSession.sparkContext.broadcast((asked["q"].to_numpy(), _units(asked["qv"]) if len(asked) else None))

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        for b in batches:
            if len(ids):
                row, query = np.nonzero(_units(b["v"]) @ q.T >= threshold)
                node = b["node"].to_numpy()[row]
                other = node != ids[query]
                yield pd.DataFrame({"u": np.minimum(node, ids[query])[other], "v": np.maximum(node, ids[query])[other]})

    true = nodes_of(df, id_col, vec).select("node", "v").mapInPandas(pairs, "u long, v long").distinct()
    got = true.join(edges.select("u", "v", F.lit(1).alias("hit")), ["u", "v"], "left").agg(F.count("hit"), F.count(F.lit(1))).first()
    if not got[1]:
        raise ValueError("no query has a link")
    return got[0] / got[1]


def op4_embedding_dedup(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector; see :func:`near_groups`."""
    return near_groups(embeddings)
