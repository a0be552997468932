"""LM scoring by a weighted backoff automaton over bigrams.

States are the empty history and every word; arcs are the bigrams of the
training texts, smoothed by absolute discounting; a state's failure arc leads to
the empty history and carries what the discount took, so every state's arcs sum
to 1. Scoring walks a text once from left to right, carries the state and adds
up log-probabilities.

The automaton grows with the corpus and is never in one place. Documents are
cut into chunks of some million tokens, one row each. A chunk asks for the
counts of its words, then for those of its bigrams and of the arcs that leave
their states; what it asks goes to buckets by the hash of the word, or of the
bigram's state, as packed arrays of numbers, and the answers come back in the
order of the questions. A state with more than its share of all tokens is dealt
out by its bigrams' hashes, and the partial numbers of its arcs are added up.
Words are their XXH64, the words after a state 40 bits of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.session import small_batches, stored

#: Tokens in a chunk, about: what a task holds at once.
CHUNK_TOKENS = 1_500_000
DISCOUNT = 0.75
#: Most words of a bucket that are looked at as possible hot states, and the share of a bucket's tokens from which a state is hot.
_TOP, _HOT = 64, 1 / 8
#: Keys of the end (a token) and of the start (a state).
_END, _START = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LOW40, _MIX = np.uint64((1 << 40) - 1), np.uint64(0xBF58476D1CE4E5B9)


def _pack(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, all first bytes first: what small numbers leave empty compresses to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _dealt(bucket: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by bucket, and where each bucket begins in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _chunks(batches: Iterator[pd.DataFrame], chunk_tokens: int) -> Iterator[pd.DataFrame]:
    """Documents as numbers into their chunk's own word list, and that list with its training counts."""
    part, k = TaskContext.get().partitionId() << 20, 0
    local: dict[bytes, int] = {}
    rows: list = []
    ids: list[np.ndarray] = []
    held: list[bool] = []
    tokens = 0

    def chunk() -> pd.DataFrame:
        lens, flat = np.fromiter(map(len, ids), np.int64, len(ids)), np.concatenate(ids)
        train = np.repeat(~np.array(held, bool), lens)
        keys = np.fromiter(map(xxhash.xxh64_intdigest, local), np.uint64, len(local))
        count = np.bincount(flat[train], minlength=len(local))
        return pd.DataFrame({"chunk": part + k, "rows": [rows], "held": np.array(held, np.uint8).tobytes(), "lens": _pack(lens, 4), "flat": _pack(flat, 4), "words": _pack(keys, 8), "counts": _pack(count, 5)})

    for df in batches:
        for row, out, text in zip(df["row"].tolist(), df["held_out"], df["text"], strict=True):
            said = (text or "").encode().lower().split()
            ids.append(np.fromiter((local.setdefault(w, len(local)) for w in said), np.int32, len(said)))
            rows.append(None if row is None or row != row else row)
            held.append(bool(out))
            tokens += len(said) + 1
            if tokens >= chunk_tokens:
                yield chunk()
                k, tokens, local, rows, ids, held = k + 1, 0, {}, [], [], []
    if rows:
        yield chunk()


def _ask_words(batches: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for df in batches:
        for row in df.itertuples():
            keys, count = _unpack(row.words, 8), _unpack(row.counts, 5)
            order, at = _dealt(keys % np.uint64(buckets), buckets)
            for b in np.flatnonzero(np.diff(at)):
                mine = order[at[b] : at[b + 1]]
                yield pd.DataFrame({"bucket": [b], "chunk": row.chunk, "keys": [_pack(keys[mine], 8)], "n": [_pack(count[mine], 5)]})


def _tell_words(df: pd.DataFrame) -> pd.DataFrame:
    """Counts over all chunks for each chunk's words in its order, and, as chunk -1, sums and the most frequent words."""
    keys, n = [_unpack(k, 8) for k in df["keys"]], np.concatenate([_unpack(x, 5) for x in df["n"]])
    word, which = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.bincount(which, n, len(word)).astype(np.int64)
    top = np.argsort(-count, kind="stable")[:_TOP]
    each = np.split(count[which], np.cumsum([len(k) for k in keys])[:-1])
    told = pd.DataFrame({"chunk": df["chunk"].to_numpy(), "kind": 1, "bucket": df["bucket"].to_numpy(), "c": [_pack(c, 5) for c in each], "arcs": b"", "keys": None, "ns": None, "tokens": 0, "words": 0})
    sums = pd.DataFrame({"chunk": [-1], "kind": 1, "bucket": df["bucket"].iloc[:1].to_numpy(), "c": b"", "arcs": b"", "keys": [word[top].view(np.int64).tolist()], "ns": [count[top].tolist()], "tokens": count.sum(), "words": (count > 0).sum()})
    return pd.concat((told, sums), ignore_index=True)


def _places(flat: np.ndarray, lens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State and token of all places of all texts in turn, and the number of places by text; the end is ``size``, the start ``size + 1``."""
    n = lens + 1
    token = np.full(n.sum(), size, np.int64)
    ends = np.cumsum(n) - 1
    inside = np.ones(len(token), bool)
    inside[ends] = False
    token[inside] = flat
    state = np.concatenate(([size + 1], token[:-1]))
    state[ends[:-1] + 1] = size + 1
    return state, token, n


class _Arcs:
    """A chunk's bigrams, dealt out by bucket: the same whenever it is made, so that answers fit."""

    def __init__(self, row, hot: np.ndarray, buckets: int):
        lens, flat = _unpack(row.lens, 4).astype(np.int64), _unpack(row.flat, 4).astype(np.int64)
        words = _unpack(row.words, 8)
        self.size, self.lens = len(words), lens
        self.held = np.frombuffer(row.held, np.uint8).astype(bool)
        self.state, self.token, self.n = _places(flat, lens, self.size)
        pair, self.which = np.unique(self.state * (self.size + 2) + self.token, return_inverse=True)
        self.count = np.bincount(self.which, np.repeat(~self.held, self.n), len(pair)).astype(np.int64)
        key = np.concatenate((words, np.array([_END, _START], np.uint64)))
        self.of = pair // (self.size + 2)
        state, after = key[self.of], key[pair % (self.size + 2)] & _LOW40
        self.hot = np.isin(state, hot)
        bucket = np.where(self.hot, (state ^ after * _MIX) >> np.uint64(8), state) % np.uint64(buckets)
        # pairs are in order of their states' numbers, and so within a bucket
        self.order, self.at = _dealt(bucket, buckets)
        self.keys, self.after = state, after


def _ask_pairs(batches: Iterator[pd.DataFrame], hot: np.ndarray, buckets: int) -> Iterator[pd.DataFrame]:
    for df in batches:
        for row in df.itertuples():
            arcs = _Arcs(row, hot, buckets)
            for b in np.flatnonzero(np.diff(arcs.at)):
                mine = arcs.order[arcs.at[b] : arcs.at[b + 1]]
                first = np.flatnonzero(np.diff(arcs.of[mine], prepend=-1))
                runs = np.diff(np.append(first, len(mine)))
                yield pd.DataFrame({"bucket": [b], "chunk": row.chunk, "states": [_pack(arcs.keys[mine[first]], 8)], "runs": [_pack(runs, 4)], "after": [_pack(arcs.after[mine], 5)], "n": [_pack(arcs.count[mine], 4)]})


def _tell_pairs(df: pd.DataFrame, hot: np.ndarray) -> pd.DataFrame:
    """For each chunk, in its order, the bigrams' counts and the numbers of arcs that leave the states; as chunk -1 the numbers of arcs of hot states in this bucket."""
    states, runs = [_unpack(x, 8) for x in df["states"]], [_unpack(x, 4).astype(np.int64) for x in df["runs"]]
    state = np.concatenate([np.repeat(s, r) for s, r in zip(states, runs, strict=True)])
    after = np.concatenate([_unpack(x, 5) for x in df["after"]])
    n = np.concatenate([_unpack(x, 4) for x in df["n"]])
    code = (state * _MIX) ^ (after * _START)
    pair, first, which = np.unique(code, return_index=True, return_inverse=True)
    count = np.bincount(which, n, len(pair)).astype(np.int64)
    leaving, arcs = np.unique(state[first[count > 0]], return_counts=True)
    told, done = [], 0
    for chunk, s, r in zip(df["chunk"], states, runs, strict=True):
        at = np.minimum(np.searchsorted(leaving, s), max(len(leaving) - 1, 0))
        mine = np.where(leaving[at] == s, arcs[at], 0) if len(leaving) else np.zeros(len(s), np.int64)
        told.append((chunk, _pack(count[which[done : done + r.sum()]], 5), _pack(mine, 5)))
        done += r.sum()
    some = np.isin(leaving, hot)
    rows = [(c, 2, int(df["bucket"].iloc[0]), x, y, None, None, 0, 0) for c, x, y in told]
    rows.append((-1, 2, int(df["bucket"].iloc[0]), b"", b"", leaving[some].view(np.int64).tolist(), arcs[some].tolist(), 0, 0))
    return pd.DataFrame(rows, columns=["chunk", "kind", "bucket", "c", "arcs", "keys", "ns", "tokens", "words"])


def _scores(docs: pd.DataFrame, told: pd.DataFrame, hot: np.ndarray, hot_arcs: np.ndarray, total: dict, buckets: int) -> pd.DataFrame:
    """Walk each text of a chunk: arcs where the automaton has them, else the failure arc."""
    out = []
    for row in docs.itertuples():
        arcs = _Arcs(row, hot, buckets)
        size = arcs.size
        word_c, pair_c, leaving = np.zeros(size + 2, np.int64), np.zeros(len(arcs.of), np.int64), np.zeros(size + 2, np.int64)
        word_c[size:] = total["docs"]
        order, at = _dealt(_unpack(row.words, 8) % np.uint64(buckets), buckets)
        for t in told.itertuples():
            b = t.bucket
            if t.kind == 1:
                word_c[order[at[b] : at[b + 1]]] = _unpack(t.c, 5)
                continue
            mine = arcs.order[arcs.at[b] : arcs.at[b + 1]]
            pair_c[mine] = _unpack(t.c, 5)
            leaving[arcs.of[mine[np.flatnonzero(np.diff(arcs.of[mine], prepend=-1))]]] = _unpack(t.arcs, 5)
        where = np.flatnonzero(arcs.hot)
        leaving[arcs.of[where]] = hot_arcs[np.searchsorted(hot, arcs.keys[where])] if len(where) else 0
        seen = np.maximum(word_c, 1)
        # the failure arc's weight; a state never seen has nothing but that arc
        fail = np.where(word_c > 0, DISCOUNT * leaving / seen, 1.0)
        base = (word_c + 1) / (total["tokens"] + total["words"] + 1)
        gain = np.maximum(pair_c - DISCOUNT, 0.0)
        p = fail[arcs.state] * base[arcs.token] + gain[arcs.which] / seen[arcs.state]
        first = np.cumsum(arcs.n) - arcs.n
        sums = [np.add.reduceat(x, first) for x in ((word_c[arcs.token] > 0).astype(np.int64), np.log10(base)[arcs.token], np.log10(p))]
        out.append(pd.DataFrame({"row": list(row.rows), "held_out": arcs.held, "n_tokens": arcs.n, **dict(zip(("n_known", "base_score", "score"), sums, strict=True))}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"row": [], "held_out": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []})


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", held_out: str = "held_out", chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Train on the rows that are not held out, score all; one row for each row of ``docs``.

    Tokens are the words of the text, A-Z lower-cased and cut at ASCII white
    space, and one end. Columns: ``id_col``, ``held_out``, n_tokens, n_known,
    train_tokens, base_score and score (log10). Null texts are empty; a null
    ``held_out`` counts as held out; null and repeated ids are rows like any
    others. Without training rows every token has probability 1. A text of any
    length is in one chunk. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("row"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    kind = f"chunk long, rows array<{id_type}>, held binary, lens binary, flat binary, words binary, counts binary"
    chunks = stored(rows.mapInPandas(lambda it: _chunks(it, chunk_tokens), kind))
    answer = "chunk long, kind int, bucket int, c binary, arcs binary, keys array<long>, ns array<long>, tokens long, words long"
    asked = chunks.select("chunk", "words", "counts").mapInPandas(lambda it: _ask_words(it, buckets), "bucket int, chunk long, keys binary, n binary")
    words = stored(asked.groupBy("bucket").applyInPandas(_tell_words, answer))
    n_docs = rows.where("not held_out").count()
    sums = words.where("chunk = -1")
    size = sums.agg(F.sum("tokens").alias("n"), F.sum("words").alias("v")).first()
    total = {"tokens": (size.n or 0) + n_docs, "words": (size.v or 0) + (n_docs > 0), "docs": n_docs}
    # at most a few states for each bucket
    limit = max(1, int(_HOT * total["tokens"] / buckets))
    top = sums.select(F.explode(F.arrays_zip("keys", "ns")).alias("t")).where(F.col("t.ns") > limit).select("t.keys").collect()
    hot = np.unique(np.array([r[0] for r in top] + [_START.view(np.int64)], np.int64).view(np.uint64))
    asked = chunks.select("chunk", "held", "lens", "flat", "words").mapInPandas(lambda it: _ask_pairs(it, hot, buckets), "bucket int, chunk long, states binary, runs binary, after binary, n binary")
    pairs = stored(asked.groupBy("bucket").applyInPandas(lambda df: _tell_pairs(df, hot), answer))
    arcs = {r.k: r.n for r in pairs.where("chunk = -1").select(F.explode(F.arrays_zip("keys", "ns")).alias("t")).groupBy(F.col("t.keys").alias("k")).agg(F.sum("t.ns").alias("n")).collect()}
    hot_arcs = np.array([arcs.get(k, 0) for k in hot.view(np.int64).tolist()], np.int64)
    told = words.unionByName(pairs).where("chunk >= 0").select("chunk", "kind", "bucket", "c", "arcs")
    texts = chunks.select("chunk", "rows", "held", "lens", "flat", "words")
    out = texts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(lambda d, t: _scores(d, t, hot, hot_arcs, total, buckets), f"row {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("row").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(total["tokens"]).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(id_col: str = "doc_id", fold: int = 2, folds: int = 7):
    """crc32 of the id as text, modulo ``folds``, equals ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op6_lm_scoring(docs: DataFrame) -> DataFrame:
    """Scores of every document; learnt from the folds that are not held out. See :func:`score`."""
    return score(docs.select("doc_id", "text", held_out().alias("held_out")))
