"""Near-dedup of documents whose word-shingle sets have a Jaccard similarity of ``threshold`` or more, none missed.

1. A document is the set of its word shingles; equal sets are one node. Nodes
   whose SimHash fingerprints the trie join links are candidates, and a link if
   their sets, met in full, reach the threshold. That settles groups of near
   copies, however large, along the forests of the trie.
2. Fingerprints miss a few pairs. So a set's shingles are ordered, common ones
   last, by counts over all texts. Two sets of n and m shingles at the threshold share
   ``need(n, m)``, so they share one among the first ``n - ceil(threshold * n)
   + 1`` of each: its prefix. A join of the prefixes misses no pair, and only
   pairs of different components are left to it.
3. While more pairs wait than rows, each set is tried with one leader for each
   of its prefix shingles, and what that links is one component.
4. All pairs left across components are tried, wherever the order of the match
   and the sizes still leave room for ``need``, and verified as above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.llm.components import components
from siftspark.llm.simhash import fingerprint_of, shingle_hashes, trie_links
from siftspark.session import drop, small_batches, stored

#: Slots that shingles are counted in, and slots of one row of counts.
_SLOTS, _SLICE = 1 << 19, 1 << 13
#: Most rounds with leaders.
_ROUNDS = 6
#: Fingerprints: 64-bit words, most differing bits, and blocks of which one must be equal, with their width.
_WORDS, _BUDGET, _BLOCKS, _WIDTH = 4, 51, 21, 12
#: Texts to be verified are asked for by a broadcast of at most so many pairs of numbers; more by a shuffle.
_BROADCAST_TEXTS = 1_000_000


def _shingles(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle)).view(np.int64)


def _node(h: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes())).view(np.int64))


def _slot(h: np.ndarray) -> np.ndarray:
    return h.view(np.uint64) % np.uint64(_SLOTS)


def _counts(rows: DataFrame, shingle: int) -> np.ndarray:
    """How often the shingles of each slot are held, over all texts; a task hands on its sums, not its shingles."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_SLOTS, np.int64)
        for df in batches:
            held = [_slot(_shingles(t, shingle)) for t in df["text"]]
            if held:
                total += np.bincount(np.concatenate(held).astype(np.int64), minlength=_SLOTS)
        for at in range(0, _SLOTS, _SLICE):
            if (part := total[at : at + _SLICE]).any():
                yield pd.DataFrame({"at": [at], "n": [part.tobytes()]})

    def add(df: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(n, np.int64) for n in df["n"]], axis=0)
        return pd.DataFrame({"at": df["at"].iloc[:1], "n": [total.tobytes()]})

    out = np.zeros(_SLOTS, np.int64)
    sums = rows.select("text").mapInPandas(count, "at int, n binary").groupBy("at").applyInPandas(add, "at int, n binary")
    for r in sums.collect():  # _SLOTS numbers, whatever the texts
        out[r["at"] : r["at"] + _SLICE] = np.frombuffer(bytes(r.n), np.int64)
    return out


def _need(n: Column, m: Column, threshold: float) -> Column:
    """Shingles that two sets of the threshold share at least."""
    return F.ceil((n + m) * (threshold / (1 + threshold)) - 1e-9)


def with_prefix(rows: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """``key, text`` -> ``key, node, n, prefix, fp``: the set's number, its size, its first shingles in order, and its fingerprint."""
    shared = rows.sparkSession.sparkContext.broadcast(_counts(rows, shingle))

    def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times = shared.value
        for df in batches:
            nodes, sizes, prefixes, prints = [], [], [], []
            for text in df["text"]:
                h = _shingles(text, shingle)
                nodes.append(_node(h))
                sizes.append(len(h))
                prints.append(fingerprint_of(h.view(np.uint64), _WORDS).view(np.int64))
                h = h[np.argsort(times[_slot(h)], kind="stable")]
                prefixes.append(h[: len(h) - int(np.ceil(threshold * len(h) - 1e-9)) + 1])
            yield pd.DataFrame({"key": df["key"], "node": nodes, "n": sizes, "prefix": prefixes, "fp": prints})

    return rows.mapInPandas(of, "key long, node long, n int, prefix array<long>, fp array<long>")


def _room(a: str, b: str, threshold: float) -> Column:
    """Whether a match at these places can be the first of enough of them."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return _need(n, m, threshold) <= F.least(n - F.col(f"{a}.pos"), m - F.col(f"{b}.pos"))


def verified(pairs: DataFrame, first: DataFrame, rows: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Those of the distinct ``pairs (u, v)`` whose sets reach the threshold; only texts of nodes in pairs are read again."""
    pairs = stored(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    ends = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
    keys = stored(first.select("node", "key").join(ends, "node", "left_semi"))
    few = keys.limit(_BROADCAST_TEXTS + 1).count() <= _BROADCAST_TEXTS
    texts = rows.join(F.broadcast(keys) if few else keys, "key").select("node", "text")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            yield pd.DataFrame({"node": df["node"], "hs": [_shingles(t, shingle) for t in df["text"]]})

    sets = stored(texts.mapInPandas(whole, "node long, hs array<long>").dropDuplicates(["node"]))
    met = pairs.join(sets.select(F.col("node").alias("u"), F.col("hs").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hs").alias("b")), "v")
    out = stored(met.where(F.size(F.array_intersect("a", "b")) >= _need(F.size("a"), F.size("b"), threshold)).select("u", "v"))
    drop(pairs, keys, sets)
    return out


def near_prints(first: DataFrame) -> DataFrame:
    """Pairs ``(u, v)`` of nodes with one fingerprint or with two that the trie join links."""
    leaf = stored(first.groupBy("fp").agg(F.min("node").alias("low")).withColumn("leaf", F.xxhash64("fp")))
    near = trie_links(leaf.select(F.col("leaf").alias("node"), "fp"), _BUDGET, _BLOCKS, _WIDTH, _WORDS)
    ends = near.join(leaf.select(F.col("leaf").alias("u"), F.col("low").alias("a")), "u").join(leaf.select(F.col("leaf").alias("v"), F.col("low").alias("b")), "v")
    same = first.join(leaf.select("fp", "low"), "fp").where("node <> low").select(F.col("low").alias("u"), F.col("node").alias("v"))
    return ends.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(same)


def set_links(rows: DataFrame, marked: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """Verified ``(u, v)``: a chain of them joins two nodes iff a chain of pairs at the threshold does.

    ``rows (key, text)``; ``marked`` has :func:`with_prefix` of them.
    """
    first = stored(marked.groupBy("node").agg(F.min(F.struct("key", "n", "prefix", "fp")).alias("m")).select("node", "m.*"))
    found = verified(near_prints(first), first, rows, shingle, threshold)
    # a shingle in one prefix only leads nowhere
    every = first.select("node", "n", F.posexplode("prefix").alias("pos", "h"))
    held = every.withColumn("d", F.count(F.lit(1)).over(Window.partitionBy("h"))).where("d > 1").drop("d")
    places = stored(held.withColumn("band", F.floor(F.log(F.col("n")) / np.log(1 / threshold)).cast("int")))
    left, size = _rooted(places, found), places.count()
    for turn in range(_ROUNDS):
        # a shingle all of whose holders are one component has nothing left
        both = left.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("h")
        left = stored(left.join(both, "h"))
        held = left.groupBy("h", "band", "root").agg(F.count(F.lit(1)).cast("double").alias("c"))
        per_band = held.groupBy("h", "band").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("cc"))
        waiting = per_band.agg(F.sum(F.col("c") * F.col("c") - F.col("cc"))).first()[0] or 0.0
        if waiting <= 4 * size:
            break
        lead = left.groupBy("h", "band").agg(F.min_by(F.struct("node", "n"), F.xxhash64("node", F.lit(turn))).alias("lead"))
        lead = lead.select("h", F.explode(F.array("band", F.col("band") - 1)).alias("band"), F.col("lead.node").alias("v"), F.col("lead.n").alias("m"))
        pairs = left.join(lead, ["h", "band"]).where((F.col("node") != F.col("v")) & (_need(F.col("n"), F.col("m"), threshold) <= F.least("n", "m")))
        pairs = pairs.select(F.col("node").alias("u"), "v")
        found = stored(found.unionByName(verified(pairs, first, rows, shingle, threshold)).distinct())
        left = _rooted(left.drop("root"), found)
    x, y = left.alias("x"), left.alias("y")
    rest = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root")) & _room("x", "y", threshold))
    rest = rest.select(F.col("x.node").alias("u"), F.col("y.node").alias("v"))
    out = stored(found.unionByName(verified(rest, first, rows, shingle, threshold)))
    drop(first, places)
    return out


def _rooted(places: DataFrame, found: DataFrame) -> DataFrame:
    return places.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))


def set_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``id_col`` (a long that names the text; a repeated one gives one row) and ``group``, equal iff a chain of links joins two texts.

    Fewer words than ``shingle`` are one shingle; texts without a word are equal.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("key"), F.col(text).alias("text"))
    marked = stored(with_prefix(rows, shingle, threshold))
    root = components(set_links(rows, marked, shingle, threshold))
    keys = marked.select("key", "node").distinct()
    return keys.join(root, "node", "left").select(F.col("key").alias(id_col), F.coalesce("root", "node").alias("group"))
