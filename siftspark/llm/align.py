"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Both tokenizers cut the same bytes, so their token ends are two ascending lists,
and the ends that both have cut a text into groups. The lists of many texts, one
behind the other, are merged along a merge path: on every diagonal of the
(A, B) grid a binary search finds how many ends of each list lie before it, so
the path falls into pieces of equal work that know nothing of one another. The
pieces are merged side by side, one lane of numpy arrays each; each numbers its
groups from zero, and a running sum over the pieces stitches the group that
crosses a border.

At a single blank between two other characters both tokenizers start a token
and neither sees what lies beyond, so a text is a row of units that are aligned
once each. An alignment is a table of chunks: the units that some texts use,
with their ids and the sizes of their groups, the texts as unit numbers, and
each linked id pair with the number of its texts. Only distinct pairs of chunks
are shuffled as rows, never links.
"""


from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.llm.tokenfile import Words, default_tokenizer
from siftspark.session import shared_dir, small_batches

#: Ends that a piece merges, units after which a chunk is closed, units that a worker keeps, and links of a group that are put out one by one.
WORK, CHUNK, KEPT, _PLAIN = 256, 1_000_000, 300_000, 4096
#: Units of texts whose pairs are at hand at once.
_SPAN = 100_000
_FAR = np.iinfo(np.int64).max


def merge_path(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """Ends of ``a`` among the first ``diagonals`` of both lists merged; of equal ends that of ``a`` comes first."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) // 2
        before = a[mid] <= b[diagonals[open_] - 1 - mid]
        low[open_] = np.where(before, mid + 1, low[open_])
        high[open_] = np.where(before, high[open_], mid)


def groups_of(a: np.ndarray, b: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token, given the ascending ends of both lists; the last ends are equal."""
    of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    total = len(a) + len(b)
    if not total:
        return of_a, of_b
    starts = np.arange(0, total, work)
    i = merge_path(a, b, starts)
    j, first = starts - i, i.copy()
    closed = np.zeros(len(starts), np.int64)
    ends_a, ends_b, last = np.append(a, _FAR), np.append(b, _FAR), np.concatenate(([-1], a))
    for step in range(min(work, total)):
        # only the last piece can be shorter
        k = len(starts) - (starts[-1] + step >= total)
        i_, j_, closed_ = i[:k], j[:k], closed[:k]
        end = ends_b[j_]
        take = ends_a[i_] <= end
        of_a[i_[take]] = closed_[take]
        of_b[j_[~take]] = closed_[~take]
        # a group closes where an end of b equals the end of a before it, be that in the piece before
        closed_ += ~take & (end == last[i_])
        i_ += take
        j_ += ~take
    before = np.cumsum(closed) - closed
    of_a += np.repeat(before, np.diff(np.append(first, len(a))))
    of_b += np.repeat(before, np.diff(np.append(starts - first, len(b))))
    return of_a, of_b


def _byte_level(token: str) -> bytes:
    return bytes(_SHOWN.get(c, 63) for c in token)


def _shown() -> dict[str, int]:
    """The characters by which byte-level BPE shows bytes: printable Latin-1 as itself, the others in turn from U+0100."""
    out, other = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            out[chr(b)] = b
        else:
            out[chr(other)] = b
            other += 1
    return out


_SHOWN = _shown()


class _Flat:
    """Rows of whole numbers of different lengths, one behind the other."""

    def __init__(self):
        self.values, self.first, self.size = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)

    def add(self, values: np.ndarray, size: np.ndarray) -> None:
        first = len(self.values) + np.cumsum(size) - size
        self.first = np.concatenate((self.first, first.astype(np.int32)))
        self.values, self.size = np.concatenate((self.values, values.astype(np.int32))), np.concatenate((self.size, size.astype(np.int32)))

    def take(self, rows: np.ndarray) -> np.ndarray:
        n = self.size[rows]
        return self.values[np.arange(n.sum()) + np.repeat(self.first[rows] - (np.cumsum(n) - n), n)].astype(np.int64)


class Units:
    """Both tokenizers, and the aligned units that a worker has met."""

    def __init__(self, path_a: str, path_b: str, kept: int = KEPT):
        import sentencepiece

        # special tokens' strings in a text are plain text
        self.words = Words(path_a)
        self.words.tokenizer.encode_special_tokens, self.words.added = True, []
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece goes on behind a blank or a line feed: texts cannot be cut into units")
        self.blank, self.base, self.kept = self.b.piece_to_id("▁"), len(pieces), kept
        token = self.words.tokenizer.id_to_token
        self.bytes_a = [_byte_level(token(k) or "") for k in range(self.words.size)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.array(list(map(len, b)), np.int64) for b in (self.bytes_a, self.bytes_b))
        # a token's number and what follows it: within a group, between its two halves, behind it
        self.most = max(self.words.size, self.base)
        self.said = [b"%d%b" % (k, sep) for sep in (b",", b"|", b";") for k in range(self.most)]
        self.clear()

    def clear(self) -> None:
        self.known: dict = {}
        self.a, self.b_, self.in_a, self.in_b = _Flat(), _Flat(), _Flat(), _Flat()
        self.good, self.n_links, self.text = np.empty(0, bool), np.empty(0, np.int64), []

    def _learn(self, keys: list) -> None:
        """Align the keys not met before. A string is a unit behind a blank, or one that a line feed begins; a tuple has a unit of any kind behind a blank."""
        fresh = [k for k in dict.fromkeys(keys) if k not in self.known]
        self.known.update((k, -1) for k in fresh)
        fresh = [k for k in fresh if isinstance(k, tuple) or not self.words._open(k)]
        if not fresh:
            return
        self.known.update(zip(fresh, range(len(self.text), len(self.text) + len(fresh)), strict=True))
        words = self.words
        words.clear()
        named = [(words._AFTER, k[0]) if isinstance(k, tuple) else k for k in fresh]
        words._learn(named)
        which = np.fromiter(map(words.known.__getitem__, named), np.int64, len(named))
        n_a = words.length[which]
        a = words.ids[np.arange(n_a.sum()) + np.repeat(words.first[which] - (np.cumsum(n_a) - n_a), n_a)].astype(np.int64)
        plain = [k[0] if isinstance(k, tuple) else k for k in fresh]
        # the model puts a blank before a text; a line feed is in no piece, so there the blank stands alone
        fed = [isinstance(k, str) and k[0] == "\n" for k in fresh]
        rows = [r[1:] if f and r[0] == self.blank else r for r, f in zip(self.b.encode(plain, num_threads=1), fed, strict=True)]
        n_b = np.fromiter(map(len, rows), np.int64, len(rows))
        b = np.fromiter((i for r in rows for i in r), np.int64, n_b.sum())
        said_a, said_b = b"".join(map(self.bytes_a.__getitem__, a.tolist())), b"".join(map(self.bytes_b.__getitem__, b.tolist()))
        end_a, end_b = (np.cumsum(np.bincount(np.repeat(np.arange(len(n)), n), length[x], len(n)).astype(np.int64)) for n, length, x in ((n_a, self.len_a, a), (n_b, self.len_b, b)))
        want = [(t if f else " " + t).encode() for t, f in zip(plain, fed, strict=True)]
        end = np.cumsum(list(map(len, want)))
        good = np.ones(len(fresh), bool)
        if not (said_a == said_b == b"".join(want) and (end_a == end).all() and (end_b == end).all()):
            bounds = zip(np.append(0, end_a), end_a, np.append(0, end_b), end_b, strict=False)
            good[:] = [said_a[a0:a1] == w == said_b[b0:b1] for w, (a0, a1, b0, b1) in zip(want, bounds, strict=True)]
        # units that do not give back their bytes have no tokens, so the ends of all others ascend and meet at each unit's end
        keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
        a, b, n_a, n_b = a[keep_a], b[keep_b], n_a * good, n_b * good
        of_a, of_b = groups_of(np.cumsum(self.len_a[a]), np.cumsum(self.len_b[b]))
        in_a, in_b = np.bincount(of_a), np.bincount(of_b)
        unit = np.repeat(np.arange(len(fresh)), n_a)
        groups = np.bincount(unit[np.flatnonzero(np.diff(of_a, prepend=-1))], minlength=len(fresh))
        self.a.add(a, n_a)
        self.b_.add(b, n_b)
        self.in_a.add(in_a, groups)
        self.in_b.add(in_b, groups)
        self.good = np.concatenate((self.good, good))
        links = np.bincount(np.repeat(np.arange(len(fresh)), groups), in_a * in_b, len(fresh)).astype(np.int64)
        self.n_links = np.concatenate((self.n_links, links))
        self.text += self._texts(a, b, in_a, in_b, n_a + n_b)

    def _texts(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, tokens: np.ndarray) -> list[bytes]:
        """The groups of each unit written out, each with its closing mark."""
        end_a, end_b = np.cumsum(in_a), np.cumsum(in_b)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[end_a - 1], last_b[end_b - 1] = 1, 2
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + np.repeat(end_b - in_b, in_a)] = last_a * self.most + a
        order[np.arange(len(b)) + np.repeat(end_a, in_b)] = last_b * self.most + b
        said, at = list(map(self.said.__getitem__, order.tolist())), np.concatenate(([0], np.cumsum(tokens))).tolist()
        return [b"".join(said[s:e]) for s, e in zip(at, at[1:], strict=False)]

    def _numbers(self, flat: list) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        except KeyError:
            self._learn(flat)
            return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))

    def cut(self, texts: list[str | None]) -> list[np.ndarray]:
        """The unit numbers of each text; none where it is null or empty, or a unit does not give back its bytes."""
        none = np.empty(0, np.int64)
        out = [none] * len(texts)
        full = [k for k, t in enumerate(texts) if t]
        if not full:
            return out
        parts = [texts[k].replace("\n", " \n").split(" ") for k in full]
        which = self._numbers([p for row in parts for p in row])
        begin = np.cumsum([0, *map(len, parts[:-1])])
        unsure = np.flatnonzero(np.minimum.reduceat(which, begin) < 0)
        if len(unsure):
            for k in unsure:
                parts[k] = [(p,) for p in self.words.single.split(texts[full[k]])]
            which = self._numbers([p for row in parts for p in row])
            begin = np.cumsum([0, *map(len, parts[:-1])])
        good = np.logical_and.reduceat(self.good[which], begin)
        for k, g, row in zip(full, good.tolist(), np.split(which, begin[1:]), strict=True):
            if g:
                out[k] = row
        return out


_AT_HAND: dict[tuple[str, str], Units] = {}


def _units(path_a: str, path_b: str) -> Units:
    if (path_a, path_b) not in _AT_HAND:
        _AT_HAND[path_a, path_b] = Units(path_a, path_b)
    return _AT_HAND[path_a, path_b]


def _forget() -> None:
    """Of the module, not of a function sent to a worker, whose globals are copies."""
    _AT_HAND.clear()


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _links(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, base: int, plain: int = _PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pair (``a * base + b``), group and number of all links; ``in_a``, ``in_b``: tokens in each group.

    The links of a large group are those of its distinct ids, with how often each pair occurs.
    """
    at_a, at_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    large = in_a * in_b > plain
    group = np.repeat(np.arange(len(in_a)), in_a)
    small = np.flatnonzero(~large[group])
    fan = in_b[group[small]]
    to = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(at_b[group[small]], fan)
    keys, groups = [np.repeat(a[small].astype(np.int64), fan) * base + b[to]], [np.repeat(group[small], fan)]
    times = [np.ones(len(to), np.int64)]
    for g in np.flatnonzero(large).tolist():
        ids_a, n_a = np.unique(a[at_a[g] : at_a[g] + in_a[g]], return_counts=True)
        ids_b, n_b = np.unique(b[at_b[g] : at_b[g] + in_b[g]], return_counts=True)
        keys.append((ids_a.astype(np.int64)[:, None] * base + ids_b).ravel())
        times.append((n_a[:, None] * n_b).ravel())
        groups.append(np.full(len(keys[-1]), g))
    return np.concatenate(keys), np.concatenate(groups), np.concatenate(times)


def _pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x, "<i4").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), "<i4").astype(np.int64)


def _sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of rows that lie one behind the other."""
    total = np.concatenate(([0], np.cumsum(values)))
    end = np.cumsum(size)
    return total[end] - total[end - size]


def _holders(size: np.ndarray, code: np.ndarray, has: np.ndarray, once: np.ndarray, keys: int, span: int) -> np.ndarray:
    """In how many texts each pair occurs: the texts are rows of units (``size``, ``code``), the units rows of distinct pairs (``has``, ``once``).

    Some texts with ``span`` units in all are looked at at once.
    """
    out = np.zeros(keys, np.int64)
    end, first = np.cumsum(size), np.cumsum(has) - has
    borders = np.unique([0, *np.searchsorted(end, np.arange(span, len(code), span)), len(size)])
    for s, e in zip(borders, borders[1:], strict=False):
        doc = np.repeat(np.arange(e - s), size[s:e])
        held = pd.unique(doc * max(len(has), 1) + code[end[s] - size[s] : end[e - 1]])
        doc, unit = held // max(len(has), 1), held % max(len(has), 1)
        n = has[unit]
        at = np.arange(n.sum()) + np.repeat(first[unit] - (np.cumsum(n) - n), n)
        held = pd.unique(np.repeat(doc, n) * max(keys, 1) + once[at])
        out += np.bincount(held % max(keys, 1), minlength=keys)
    return out


def _chunk(number: int, ids: pa.Array, texts: list[np.ndarray], units: Units) -> pa.RecordBatch:
    size = np.array(list(map(len, texts)), np.int64)
    flat = np.concatenate(texts)
    times = np.bincount(flat, minlength=len(units.text))
    # frequent units get small numbers
    mine = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
    rank = np.zeros(len(times), np.int64)
    rank[mine] = np.arange(len(mine))
    code = rank[flat]
    a, b, in_a, in_b = (x.take(mine) for x in (units.a, units.b_, units.in_a, units.in_b))
    key, group, _ = _links(a, b, in_a, in_b, units.base)
    pair, keys = pd.factorize(key, sort=True)
    # the distinct pairs of each unit
    groups = units.in_a.size[mine]
    unit = np.repeat(np.arange(len(mine)), groups)[group]
    once = np.sort(pd.unique(unit * max(len(keys), 1) + pair))
    has = np.bincount(once // max(len(keys), 1), minlength=len(mine))
    del key, group, pair, unit
    holders = _holders(size, code, has, once % max(len(keys), 1), len(keys), _SPAN)
    digests = []
    for row in texts:
        digests.append(hashlib.sha256(b"".join(map(units.text.__getitem__, row.tolist()))[:-1]).hexdigest() if len(row) else "")
    each = [_sums(x[flat], size) for x in (units.a.size, units.b_.size, units.in_a.size, units.n_links)]
    lists = {"ids": ids, **dict(zip(("n_a", "n_b", "n_groups", "n_links"), (pa.array(x, pa.int64()) for x in each), strict=True)), "groups_sha256": pa.array(digests, pa.string()), "keys": pa.array(keys, pa.int64()), "holders": pa.array(holders, pa.int64())}
    packed = {"sizes": size, "codes": code, "a": a, "b": b, "unit_a": units.a.size[mine], "unit_b": units.b_.size[mine], "unit_groups": groups, "in_a": in_a, "in_b": in_b}
    columns = {"chunk": pa.array([number], pa.int64())} | {k: pa.ListArray.from_arrays([0, len(v)], v) for k, v in lists.items()} | {k: pa.array([_pack(v)], pa.binary()) for k, v in packed.items()}
    return pa.RecordBatch.from_pydict(columns)


_PACKED = ("sizes", "codes", "a", "b", "unit_a", "unit_b", "unit_groups", "in_a", "in_b")
_DIGEST = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"


def align(df: DataFrame, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, pieces: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """The alignment of every text, stored, a row for each chunk; see :func:`groups`, :func:`pair_counts` and :func:`summaries`.

    A reads the text behind a space, B adds its own. A text that is null or
    empty, or that either tokenizer does not give back byte for byte, has no
    tokens. Columns other than ``id_col`` and ``text`` are not read, equal ids
    are texts of their own. A text of any length is in one chunk.
    """
    path_a, path_b = tokenizer or default_tokenizer(), pieces or default_pieces()
    spark = df.sparkSession
    small_batches(spark)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, number = _units(path_a, path_b), TaskContext.get().partitionId() << 32
        ids, texts, held = [], [], 0

        def close() -> pa.RecordBatch:
            return _chunk(number, pa.concat_arrays(ids), texts, units)

        for batch in batches:
            for begin in range(0, batch.num_rows, 100):
                part = batch.slice(begin, 100)
                if len(units.text) > units.kept:
                    # numbers of units hold for one chunk only
                    if ids:
                        yield close()
                        number, ids, texts, held = number + 1, [], [], 0
                    units.clear()
                texts += units.cut(part.column(1).to_pylist())
                ids.append(part.column(0))
                held = sum(map(len, texts[-part.num_rows :])) + held
                if held > chunk:
                    yield close()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield close()

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"chunk bigint, ids array<{kind}>, " + ", ".join(f"{c} array<bigint>" for c in ("n_a", "n_b", "n_groups", "n_links")) + ", groups_sha256 array<string>, keys array<bigint>, holders array<bigint>, " + ", ".join(f"{c} binary" for c in _PACKED)
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(chunks, schema)
    path = f"{shared_dir(spark)}/alignment-{uuid.uuid4().hex}"
    # a chunk is large: readers take one row group at a time
    rows.write.option("compression", "zstd").option("parquet.block.row.count.limit", "1").parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(rows.schema).parquet(path)


def groups(alignment: DataFrame) -> DataFrame:
    """``(id, groups)``, a group being the ids ``a`` and ``b`` that cover the same bytes."""
    kind = alignment.schema["ids"].dataType.elementType.simpleString()
    field = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: _unpack(batch.column(c)[r].as_py()) for c in _PACKED}
                a, b, g = (np.concatenate(([0], np.cumsum(row[c]))).tolist() for c in ("in_a", "in_b", "unit_groups"))
                ids_a, ids_b = row["a"].tolist(), row["b"].tolist()
                unit = [[{"a": ids_a[a[k] : a[k + 1]], "b": ids_b[b[k] : b[k + 1]]} for k in range(s, e)] for s, e in zip(g, g[1:], strict=False)]
                texts = np.split(row["codes"], np.cumsum(row["sizes"])[:-1])
                out = [[x for u in t.tolist() for x in unit[u]] for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("ids")[r].values, pa.array(out, field)], ["id", "groups"])

    return alignment.select("ids", *_PACKED).mapInArrow(each, f"id {kind}, groups array<struct<a: array<int>, b: array<int>>>")


def pair_counts(alignment: DataFrame, pieces: str | None = None) -> DataFrame:
    """``(key, a, b, documents, best)``: the texts in which a pair is linked, and whether no pair of its ``a`` has more.

    Only distinct pairs of chunks are shuffled. The table of each ``a``'s
    highest count has at most a row for each id of the vocabulary.
    """
    import sentencepiece

    base = sentencepiece.SentencePieceProcessor(model_file=pieces or default_pieces()).get_piece_size()
    rows = alignment.select(F.explode(F.arrays_zip("keys", "holders")).alias("p")).select("p.keys", "p.holders")
    counts = rows.groupBy(F.col("keys").alias("key")).agg(F.sum("holders").alias("documents"))
    counts = counts.select("key", F.expr(f"key div {base}").cast("int").alias("a"), F.expr(f"key % {base}").cast("int").alias("b"), "documents")
    most = counts.groupBy("a").agg(F.max("documents").alias("most"))
    return counts.join(F.broadcast(most), "a").select("key", "a", "b", "documents", (F.col("documents") == F.col("most")).alias("best"))


def summaries(alignment: DataFrame, pieces: str | None = None) -> DataFrame:
    """Per text: tokens, groups, links, links whose pair is the best of its ``a``, the pairs' counts in sum, and a digest of the groups."""
    import sentencepiece

    kind = alignment.schema["ids"].dataType.elementType.simpleString()
    base = sentencepiece.SentencePieceProcessor(model_file=pieces or default_pieces()).get_piece_size()
    names = ["n_a", "n_b", "n_groups", "n_links"]
    counts = pair_counts(alignment, pieces).select("key", "documents", "best")
    told = alignment.select("chunk", F.explode("keys").alias("key")).join(counts, "key").select(F.col("chunk").alias("of"), "key", "documents", "best")

    def each(chunk: pa.Table, told: pa.Table) -> pa.Table:
        # no text is aligned any more
        _forget()
        keys = told.column("key").to_numpy()
        order = np.argsort(keys)
        keys, documents, best = keys[order], told.column("documents").to_numpy()[order], told.column("best").to_numpy()[order].astype(np.int64)
        out = []
        for r in range(chunk.num_rows):
            row = {c: _unpack(chunk.column(c)[r].as_py()) for c in _PACKED}
            key, group, times = _links(row["a"], row["b"], row["in_a"], row["in_b"], base)
            at = np.searchsorted(keys, key)
            unit = np.repeat(np.arange(len(row["unit_groups"])), row["unit_groups"])[group]
            per_unit = []
            for value in (best, documents):
                sums = np.zeros(len(row["unit_groups"]), np.int64)
                np.add.at(sums, unit, times * value[at])
                per_unit.append(_sums(sums[row["codes"]], row["sizes"]))
            columns = [chunk.column("ids")[r].values, *[chunk.column(c)[r].values for c in names], *[pa.array(x, pa.int64()) for x in per_unit], chunk.column("groups_sha256")[r].values]
            out.append(pa.table(columns, ["id", *names, "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out)

    chunks = alignment.select("chunk", "ids", *names, "groups_sha256", *_PACKED)
    return chunks.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(each, f"id {kind}, {_DIGEST}")


def op13_token_alignment(docs: DataFrame) -> DataFrame:
    """Tokens, groups, links, counts and the digest of the groups of every document."""
    return summaries(align(docs)).withColumnRenamed("id", "doc_id")
