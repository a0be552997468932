"""SentencePiece encoding and decoding with sampled segmentations.

A text is cut at its spaces into units, each led by the space mark. No piece
that we use spans two units, so the lattice of a text is a chain of unit
lattices. For each distinct unit, forward filtering gives the log-weight of all
segmentations of each of its prefixes; backward sampling then walks from the
unit's end, choosing each last piece with its exact probability. The random
numbers are a hash of (row key, unit's place, position), so a row's
segmentation does not depend on partitions, batches or retries.

Pieces' weights follow Zipf's law in the piece's rank, for the model file has
merge ranks and no probabilities. Characters without a piece, and a literal
space mark, become byte pieces; decoding is the inverse on all texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftspark.session import small_batches

MARK = "▁"
#: Units sampled at a time, distinct units filtered at a time, and edges that a task keeps.
_UNITS, _NEW, _KEPT = 100_000, 16_000, 10_000_000
_LITERAL = 0x110000


class Vocabulary:
    """Pieces of a SentencePiece model as a trie in sorted arrays."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.byte = np.full(256, -1, np.int64)
        self.bytes_of: list[bytes] = [b""] * size
        log_weight = np.zeros(size)
        children: dict[tuple[int, int], int] = {}
        piece_at = {}
        for k in range(size):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte[int(piece[1:-1], 16)] = k
                self.bytes_of[k] = bytes([int(piece[1:-1], 16)])
                continue
            if sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
                continue
            self.bytes_of[k] = piece.replace(MARK, " ").encode()
            if MARK in piece[1:]:
                continue  # runs of spaces: never sampled
            log_weight[k] = -alpha * np.log(2 - max(sp.get_score(k), -size))
            state = 0
            for c in map(ord, piece):
                state = children.setdefault((state, c), len(children) + 1)
            piece_at[state] = k
        if (self.byte < 0).any():
            raise ValueError("the model has no byte pieces")
        arcs = sorted((s << 21 | c, t) for (s, c), t in children.items())
        self.arc = np.array([a for a, _ in arcs], np.int64)
        self.to = np.array([t for _, t in arcs], np.int64)
        self.piece = np.full(len(children) + 1, -1, np.int64)
        self.piece[list(piece_at)] = list(piece_at.values())
        self.log_weight = log_weight
        #: Also true at -1 - code point, whose index counts from the end.
        self.is_byte = np.zeros(size + 0x110001, bool)
        self.is_byte[self.byte] = self.is_byte[size:] = True
        #: A byte piece weighs less than any other piece.
        self.byte_weight = float(log_weight.min() - alpha)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Next trie state, -1 where there is none."""
        want = state << 21 | code
        at = np.minimum(np.searchsorted(self.arc, want), len(self.arc) - 1)
        return np.where(self.arc[at] == want, self.to[at], -1)


@cache
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattices:
    """Filtered lattices of the distinct units seen so far, in flat arrays.

    Node = one position in one unit; its incoming edges lie side by side, with
    the running sum of their probabilities.
    """

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.nodes = self.edges = 0
        # pages of these are touched only as they fill
        self.run = np.empty(_KEPT * 2, np.float32)
        self.src, self.tok = np.empty(_KEPT * 2, np.int32), np.empty(_KEPT * 2, np.int32)
        self.edge_of = np.empty(_KEPT, np.int32)

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        array = getattr(self, name)
        if at + len(values) > len(array):
            array = np.concatenate((array[:at], np.empty(at + 2 * len(values), array.dtype)))
            setattr(self, name, array)
        array[at : at + len(values)] = values

    def places(self, units: list[str]) -> np.ndarray:
        """End node of each unit; lattices of new units are filtered first."""
        if self.edges > _KEPT:
            self.clear()
        found = list(map(self.index.get, units))
        missing = [k for k, x in enumerate(found) if x is None]
        new = list(dict.fromkeys(map(units.__getitem__, missing)))
        for at in range(0, len(new), _NEW):
            self.add(new[at : at + _NEW])
        for k in missing:
            found[k] = self.index[units[k]]
        return np.array(found, np.int32)

    def add(self, units: list[str]) -> None:
        """Forward-filter the lattices of new distinct units."""
        v = self.vocab
        size = np.fromiter(map(len, units), np.int64, len(units)) + 1
        code = np.frombuffer((MARK + MARK.join(units)).encode("utf-32-le"), np.uint32).astype(np.int64)
        head = np.cumsum(size) - size
        lead = np.zeros(len(code), bool)
        lead[head] = True
        code[(code == ord(MARK)) & ~lead] = _LITERAL
        stop = np.repeat(head + size, size)
        pos, state = np.arange(len(code)), np.zeros(len(code), np.int64)
        src, dst, tok = [], [], []
        single = np.zeros(len(code), bool)
        length = 0
        while len(pos):
            state = v.step(state, code[pos + length])
            length += 1
            alive = state >= 0
            pos, state = pos[alive], state[alive]
            piece = v.piece[state]
            hit = piece >= 0
            src.append(pos[hit]), dst.append(pos[hit] + length), tok.append(piece[hit])
            if length == 1:
                single[pos[hit]] = True
            more = pos + length < stop[pos]
            pos, state = pos[more], state[more]
        bare = np.flatnonzero(~single)
        src.append(bare), dst.append(bare + 1)
        plain = code[bare] < 128
        tok.append(np.where(plain, v.byte[np.minimum(code[bare], 127)], -1 - np.where(code[bare] == _LITERAL, ord(MARK), code[bare])))
        # the longest piece first: it is the likeliest
        src, dst, tok = (np.concatenate(x[::-1]) for x in (src, dst, tok))
        width = np.where(tok >= 0, 1, 1 + (-1 - tok > 0x7F) + (-1 - tok > 0x7FF) + (-1 - tok > 0xFFFF))
        weight = np.where(~v.is_byte[tok], v.log_weight[np.maximum(tok, 0)], v.byte_weight * width)
        # node numbers: a unit of n codes has n + 1 positions
        unit = np.repeat(np.arange(len(units)), size)
        base = head + np.arange(len(units))
        src_node, dst_node, depth = src + unit[src], dst - 1 + unit[dst - 1] + 1, dst - head[unit[src]]
        order = np.argsort(depth * (len(code) + len(units) + 1) + dst_node, kind="stable")
        src_node, dst_node, tok, weight, depth = (x[order] for x in (src_node, dst_node, tok, weight, depth))
        log_sum = np.zeros(len(code) + len(units))
        prob = np.empty(len(tok))
        bounds = np.concatenate((np.flatnonzero(np.concatenate(([True], depth[1:] != depth[:-1]))), [len(depth)]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            value, to = log_sum[src_node[a:b]] + weight[a:b], dst_node[a:b]
            first = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            top = np.maximum.reduceat(value, first)
            n = np.diff(np.append(first, b - a))
            part = np.exp(value - np.repeat(top, n))
            whole = np.add.reduceat(part, first)
            log_sum[to[first]] = top + np.log(whole)
            prob[a:b] = part / np.repeat(whole, n)
        run = np.cumsum(prob)
        first = np.flatnonzero(np.concatenate(([True], dst_node[1:] != dst_node[:-1])))
        n = np.diff(np.append(first, len(prob)))
        run = np.minimum(run - np.repeat(run[first] - prob[first], n), 1.0)
        run[first + n - 1] = 1.0
        edge_of = np.full(len(code) + len(units), -1, np.int32)
        edge_of[dst_node[first]] = first
        for k, u in enumerate(units):
            self.index[u] = self.nodes + int(base[k] + size[k])
        # a unit's first node has no incoming edge
        edge_of[edge_of >= 0] += self.edges
        self._put("run", self.edges, run)
        self._put("src", self.edges, src_node + self.nodes)
        self._put("tok", self.edges, tok)
        self._put("edge_of", self.nodes, edge_of)
        self.nodes += len(edge_of)
        self.edges += len(tok)

    def sample(self, ends: np.ndarray, seed: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of each unit in order, flat, and their number by unit."""
        run, src, tok, edge_of = self.run, self.src, self.tok, self.edge_of
        salt = seed ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        who, node, taken, owner = np.arange(len(ends), dtype=np.int32), ends.copy(), [], []
        depth = 0
        while len(who):
            z = salt[who] + np.uint64(depth * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            drawn = ((z ^ (z >> np.uint64(31))) >> np.uint64(12)) * 2.0**-52
            edge = edge_of[node]
            late = np.flatnonzero(run[edge] <= drawn)
            while len(late):
                edge[late] += 1
                late = late[run[edge[late]] <= drawn[late]]
            taken.append(tok[edge]), owner.append(who)
            node = src[edge]
            more = edge_of[node] >= 0
            who, node = who[more], node[more]
            depth += 1
        count = np.bincount(np.concatenate(owner), minlength=len(ends)) if owner else np.zeros(len(ends), np.int64)
        last = np.cumsum(count) - 1
        out = np.empty(count.sum(), np.int64)
        for k, (w, t) in enumerate(zip(owner, taken, strict=True)):
            out[last[w] - k] = t
        return out, count


def _spelled(vocab: Vocabulary, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Replace -1 - code point by the character's byte pieces."""
    odd = np.flatnonzero(ids < 0)
    if not len(odd):
        return ids, count
    spelt = [vocab.byte[np.frombuffer(chr(-1 - int(c)).encode(), np.uint8)] for c in ids[odd]]
    extra = np.array([len(s) - 1 for s in spelt])
    unit = np.repeat(np.arange(len(count)), count)
    count = count + np.bincount(unit[odd], extra, len(count)).astype(np.int64)
    parts, at = [], 0
    for k, s in zip(odd, spelt, strict=True):
        parts += [ids[at:k], s]
        at = k + 1
    return np.concatenate([*parts, ids[at:]]), count


def encode_texts(texts: list[str | None], keys: list[int], lattices: Lattices) -> list[np.ndarray | None]:
    out: list[np.ndarray | None] = [None if t is None else np.empty(0, np.int32) for t in texts]
    units: list[str] = []
    spans: list[tuple[int, int, int]] = []  # row, first place, units

    def flush() -> None:
        nonlocal units, spans
        if not units:
            return
        ends = lattices.places(units)
        n = np.array([s[2] for s in spans])
        seed = np.repeat(np.array([keys[s[0]] for s in spans], np.int64).view(np.uint64), n)
        place = np.concatenate([np.arange(s[1], s[1] + s[2]) for s in spans])
        ids, count = _spelled(lattices.vocab, *lattices.sample(ends, seed, place))
        stops = np.cumsum(np.add.reduceat(count, np.cumsum(n) - n))
        for (row, _, _), a, b in zip(spans, np.concatenate(([0], stops[:-1])), stops, strict=True):
            part = ids[a:b].astype(np.int32)
            out[row] = part if not len(out[row]) else np.concatenate((out[row], part))
        units, spans = [], []

    for row, text in enumerate(texts):
        if text is None:
            continue
        words = text.split(" ")
        for at in range(0, len(words), _UNITS):
            part = words[at : at + _UNITS]
            units += part
            spans.append((row, at, len(part)))
            if len(units) >= _UNITS:
                flush()
    flush()
    return out


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _spell(vocab: Vocabulary, ids: np.ndarray) -> str:
    return b"".join(map(vocab.bytes_of.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "piece_ids", model: str | None = None, alpha: float = 1.0, seed: int = 0, lossless: str | None = None) -> DataFrame:
    """Add ``out`` array<int>, a sampled segmentation of ``text``.

    Seeded by ``key`` and ``seed`` alone: repeated rows get equal ids, and so
    does any re-run. Null text: null; empty text: the piece of the leading
    mark; a null key is a key. ``alpha`` 0 draws all segmentations alike, a
    large one the heaviest. ``model`` is a path that every executor can open.
    ``lossless`` names a boolean column to add: whether the ids, decoded, are
    the text again (null for a null text). Columns of these names are
    replaced, all others stay.
    """
    path = model or default_model()
    small_batches(df.sparkSession)
    kind = "ids array<int>, lossless boolean"

    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(path, alpha)
        lattices = Lattices(vocab)
        for keys, texts in batches:
            ids = encode_texts(texts.to_list(), keys.to_list(), lattices)
            same = [None if r is None or not lossless else _spell(vocab, r) == t for r, t in zip(ids, texts, strict=True)]
            yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "lossless": pd.Series(same, dtype=object)})

    of.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    said = df.withColumn("__pieces", F.pandas_udf(of, kind)(F.xxhash64(F.col(key), F.lit(seed)), F.col(text)))
    said = said.withColumn(out, F.col("__pieces.ids"))
    return (said.withColumn(lossless, F.col("__pieces.lossless")) if lossless else said).drop("__pieces")


def decode(df: DataFrame, ids: str = "piece_ids", out: str = "decoded", model: str | None = None) -> DataFrame:
    """Add ``out`` string, the text that ``ids`` spell; null ids: null; no ids: empty."""
    path = model or default_model()
    small_batches(df.sparkSession)

    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(path, 1.0)
        for rows in batches:
            yield pd.Series([None if r is None else _spell(vocab, r) for r in rows], dtype=object)

    of.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(of, T.StringType())(F.col(ids)))


def op1_sentencepiece(docs: DataFrame) -> DataFrame:
    """Per document: number and hash of its sampled pieces, and whether they decode to its text."""
    both = encode(docs.select("doc_id", "text"), lossless="lossless")
    return both.select("doc_id", F.coalesce(F.size("piece_ids"), F.lit(0)).alias("n_pieces"), F.xxhash64("piece_ids").alias("ids_hash"), F.coalesce("lossless", F.lit(True)).alias("lossless"))
