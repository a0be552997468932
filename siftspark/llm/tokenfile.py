"""Token-ID files: an adaptive context-mixing range coder over independent blocks.

Ids are predicted from the two ids before (order 2), the one before (order 1)
and by their frequency so far (order 0). The first two each name an id and how
sure they are of it; a block mixes what they say with order 0 by weights that it
learns for each pair of certainties. Order 0 is two tables of counts, of the id's
high bits and of its low byte by the size of the high bits, made anew whenever
the block has doubled. The mix drives a carry-less range coder. Every block
starts from nothing and has its own checksum, so any block can be read alone.
All blocks of a segment are coded side by side, one lane of numpy arrays each.

A segment is one row of the file: its blocks, the ids of its documents and
their lengths. Segments lie in Parquet files, the container that every store
that Spark can reach can hold, numbered in document order.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.session import shared_dir, small_batches

MAGIC = b"CMR1"
#: Ids in a block, blocks in a segment at most (unless one document needs more), and slots of the order-1 and order-2 tables.
BLOCK, LANES, _SLOTS = 4096, 1024, 1024
#: Parts of one for the mix, and for the tables of order 0.
_UNIT, _TABLE = 1 << 16, 1 << 12
_MOST = 15 * _UNIT // 32
_BELOW, _TOP, _WORD = np.uint64(1 << 32), np.uint64(1 << 48), np.uint64(16)


class _Counts:
    """Order 0 for one part of an id: in each lane and class, parts of ``_TABLE`` for each symbol."""

    def __init__(self, lanes: int, classes: int, width: int, prior: np.ndarray, inverse: bool):
        self.shape, self.width = (lanes, classes), width
        self.count = np.zeros(lanes * classes * width, np.int32)
        self.prior, self.inverse = prior, inverse
        self.base = np.arange(lanes) * classes
        self.build()

    def build(self) -> None:
        weight = self.count.reshape(-1, self.width) * 16 + self.prior
        freq = weight * ((_TABLE - self.width) / weight.sum(1, keepdims=True))
        freq = freq.astype(np.int32) + 1
        freq[:, 0] += _TABLE - freq.sum(1, dtype=np.int32)
        start = np.cumsum(freq, 1, dtype=np.int32) - freq
        self.packed = (start << 13 | freq).ravel()
        if self.inverse:
            symbols = np.broadcast_to(np.arange(self.width, dtype=np.uint16), freq.shape).ravel()
            self.symbol = np.repeat(symbols, freq.ravel())

    def add(self, row: np.ndarray, symbol: np.ndarray) -> None:
        self.count += np.bincount(row * self.width + symbol, minlength=len(self.count)).astype(np.int32)


class _Model:
    """The predictions of all lanes; ``k`` is the number of lanes still going."""

    def __init__(self, lanes: int, size: int, inverse: bool):
        if not 0 < size <= 1 << 18:
            raise ValueError(f"ids up to {size} are too many")
        high = (size - 1 >> 8) + 1
        self.step, self.built = 0, 0
        # an id plus one and how sure the order is of it, 0 to 3
        self.guess = [np.zeros(lanes * _SLOTS, np.int32) for _ in range(2)]
        self.weight = np.full((lanes * 16, 2), _UNIT // 4, np.int32)
        self.last = np.zeros((2, lanes), np.int64)
        self.lane = np.arange(lanes)
        self.past = np.zeros((BLOCK, lanes), np.int32)
        self.kind = np.minimum(np.array([h.bit_length() + 1 >> 1 for h in range(high)]), 3)
        # ranks of merges: the low ones are the frequent ones
        self.high = _Counts(lanes, 1, high, 64 // (np.arange(high) + 1) + 1, inverse)
        self.low = _Counts(lanes, 4, 256, np.ones(256, np.int64), inverse)

    def predict(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Parts of ``_UNIT`` for the order-2 and the order-1 guess; the rest is order 0."""
        one, two = self.last[0, :k], self.last[1, :k]
        row = self.lane[:k] * _SLOTS
        h = one * 0x9E3779B1
        self.slot = (row + ((two * 0x85EBCA6B + h >> 9) & (_SLOTS - 1)), row + ((h >> 9) & (_SLOTS - 1)))
        self.seen = tuple(g[s] for g, s in zip(self.guess, self.slot, strict=True))
        a, b = self.seen
        self.a, self.b = (a >> 2) - 1, (b >> 2) - 1
        self.cell = self.lane[:k] * 16 + ((a & 3) << 2 | b & 3)
        self.w = self.weight[self.cell]
        same = self.a == self.b
        f1 = self.w[:, 1] * (b > 0)
        f2 = self.w[:, 0] * (a > 0) + f1 * same
        return f2, f1 * ~same

    def update(self, k: int, ids: np.ndarray) -> None:
        fresh = ids + 1 << 2
        for n, (guess, slot, seen, named) in enumerate(zip(self.guess, self.slot, self.seen, (self.a, self.b), strict=True)):
            hit, sure = named == ids, seen & 3
            guess[slot] = np.where(hit, seen + (sure < 3), np.where(sure > 0, seen - 1, fresh))
            # both weights stay below 15/32, so that order 0 keeps a share
            w = self.w[:, n]
            w += (hit * (_MOST - 8) + 8 - w) >> 4
        self.weight[self.cell] = self.w
        self.last[1, :k], self.last[0, :k] = self.last[0, :k], ids
        self.past[self.step, :k] = ids
        self.step += 1
        if self.step >= 32 and self.step & (self.step - 1) == 0:
            new = self.past[self.built : self.step, :k]
            self.built = self.step
            hi = new >> 8
            self.high.add((hi * 0 + self.high.base[:k]).ravel(), hi.ravel())
            self.low.add((self.low.base[:k] + self.kind[hi]).ravel(), (new & 255).ravel())
            self.high.build()
            self.low.build()


class _Coder:
    """Carry-less range coder, 64-bit state and 16-bit words, one lane for each block."""

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes, np.uint64), np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)
        self.pos = np.zeros(lanes, np.int64)
        self.row = np.arange(lanes)

    def narrow(self, start: np.ndarray, freq: np.ndarray, bits: int) -> None:
        """Each of the first lanes to its part of the 2**bits; all of them: next to nothing changes."""
        low, size = self.low[: len(start)], self.range[: len(start)]
        size >>= np.uint64(bits)
        low += start.astype(np.uint64) * size
        size *= freq.astype(np.uint64)
        at = np.flatnonzero(size < _BELOW)
        while len(at):
            lo, r = low[at], size[at]
            # the first word is not yet certain: end the range where it would change
            r = np.where((lo ^ (lo + r)) >= _TOP, -lo & (_BELOW - np.uint64(1)), r)
            self.word(at, lo)
            lo <<= _WORD
            r <<= _WORD
            low[at], size[at] = lo, r
            at = at[r < _BELOW]


class _Writer(_Coder):
    def __init__(self, lanes: int):
        super().__init__(lanes)
        self.words = np.zeros((lanes, 1024), np.uint16)

    def word(self, at: np.ndarray, lo: np.ndarray) -> None:
        pos = self.pos[at]
        if pos.max() >= self.words.shape[1]:
            self.words = np.concatenate((self.words, np.zeros_like(self.words)), 1)
        self.words[at, pos] = lo >> np.uint64(48)
        self.pos[at] = pos + 1

    def close(self) -> list[bytes]:
        for _ in range(4):
            self.word(self.row, self.low)
            self.low <<= _WORD
        return [w[:n].astype("<u2").tobytes() for w, n in zip(self.words, self.pos, strict=True)]


class _Reader(_Coder):
    def __init__(self, blocks: list[bytes]):
        super().__init__(len(blocks))
        self.words = np.zeros((len(blocks), max(map(len, blocks)) // 2 + 8), np.uint16)
        for k, b in enumerate(blocks):
            self.words[k, : len(b) // 2] = np.frombuffer(b[: len(b) // 2 * 2], "<u2")
        self.code = np.zeros(len(blocks), np.uint64)
        for _ in range(4):
            self.word(self.row, self.low)

    def word(self, at: np.ndarray, lo: np.ndarray) -> None:
        pos = self.pos[at]
        self.code[at] = self.code[at] << _WORD | self.words[at, np.minimum(pos, self.words.shape[1] - 1)]  # past the end: damaged
        self.pos[at] = pos + 1

    def get(self, k: int, bits: int) -> np.ndarray:
        at = (self.code[:k] - self.low[:k]) // (self.range[:k] >> np.uint64(bits))
        return np.minimum(at, np.uint64((1 << bits) - 1)).astype(np.int32)


def _halves(f2: np.ndarray, f1: np.ndarray, two: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the part of the order-2 guess, the order-1 guess, or order 0."""
    start = np.where(two, 0, f2 + np.where(one, 0, f1))
    return start, np.where(two, f2, np.where(one, f1, _UNIT - f2 - f1))


def _part(packed: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size in a table of order 0; everything where the id is known already."""
    return np.where(known, 0, packed >> 13), np.where(known, _TABLE, packed & (1 << 13) - 1)


def encode_ids(ids: np.ndarray, size: int) -> bytes:
    """Blocks of ids in 0 ... size - 1, each with magic, number of ids, of bytes, and CRC-32 of its ids."""
    ids = np.asarray(ids, np.int32)
    out: list[bytes] = []
    for a in range(0, len(ids), BLOCK * LANES):
        part = ids[a : a + BLOCK * LANES]
        lanes = -(-len(part) // BLOCK)
        longest, last = min(len(part), BLOCK), len(part) - (lanes - 1) * BLOCK
        table = np.zeros(lanes * BLOCK, np.int32)
        table[: len(part)] = part
        table = np.ascontiguousarray(table.reshape(lanes, BLOCK).T)
        model, coder = _Model(lanes, size, inverse=False), _Writer(lanes)
        for t in range(longest):
            # only the last block can be shorter, so the lanes still going are always the first ones
            k = lanes - (t >= last)
            now = table[t, :k]
            f2, f1 = model.predict(k)
            two = (now == model.a) & (f2 > 0)
            one = (now == model.b) & (f1 > 0) & ~two
            coder.narrow(*_halves(f2, f1, two, one), 16)
            known, hi = two | one, now >> 8
            coder.narrow(*_part(model.high.packed[model.high.base[:k] * model.high.width + hi], known), 12)
            coder.narrow(*_part(model.low.packed[(model.low.base[:k] + model.kind[hi]) * 256 + (now & 255)], known), 12)
            model.update(k, now)
        for k, w in enumerate(coder.close()):
            b = part[k * BLOCK : (k + 1) * BLOCK]
            out += [MAGIC, struct.pack("<III", len(b), len(w), zlib.crc32(b.astype("<u4").tobytes())), w]
    return b"".join(out)


def decode_ids(data: bytes, size: int) -> np.ndarray:
    """Inverse of :func:`encode_ids`; a block that is damaged is an error."""
    heads, at = [], 0
    while at < len(data):
        if data[at : at + 4] != MAGIC or at + 16 > len(data):
            raise ValueError(f"no block at byte {at}")
        n, length, crc = struct.unpack_from("<III", data, at + 4)
        if not 0 < n <= BLOCK or at + 16 + length > len(data):
            raise ValueError(f"no whole block at byte {at}")
        heads.append((n, data[at + 16 : at + 16 + length], crc))
        at += 16 + length
    out = []
    for a in range(0, len(heads), LANES):
        # longest blocks first, so that the lanes still going are always the first ones
        part = sorted(range(a, min(a + LANES, len(heads))), key=lambda k: -heads[k][0])
        lengths = np.array([heads[k][0] for k in part])
        model, coder = _Model(len(part), size, inverse=True), _Reader([heads[k][1] for k in part])
        table = np.zeros((lengths[0], len(part)), np.int32)
        going = np.searchsorted(-lengths, -np.arange(lengths[0]), "left")
        for t, k in enumerate(going):
            f2, f1 = model.predict(k)
            v = coder.get(k, 16)
            two, one = v < f2, (v >= f2) & (v < f2 + f1)
            coder.narrow(*_halves(f2, f1, two, one), 16)
            known = two | one
            hi = model.high.symbol[model.high.base[:k] * _TABLE + coder.get(k, 12)]
            coder.narrow(*_part(model.high.packed[model.high.base[:k] * model.high.width + hi], known), 12)
            row = model.low.base[:k] + model.kind[hi]
            lo = model.low.symbol[row * _TABLE + coder.get(k, 12)]
            coder.narrow(*_part(model.low.packed[row * 256 + lo], known), 12)
            now = np.where(two, model.a, np.where(one, model.b, hi.astype(np.int32) << 8 | lo))
            table[t, :k] = now
            model.update(k, now)
        rows = np.ascontiguousarray(table.T)
        for k in range(a, a + len(part)):
            row, (n, _, crc) = rows[part.index(k)], heads[k]
            if zlib.crc32(row[:n].astype("<u4").tobytes()) != crc:
                raise ValueError("a block's checksum is wrong")
            out.append(row[:n])
    return np.concatenate(out) if out else np.empty(0, np.int32)


#: The characters by which byte-level BPE shows a blank and bytes of 128 and more that it does not show as themselves.
_BLANK, _SHOWN = "\u0120", {b: 290 + b - 128 for b in range(128, 161)} | {173: 323}


class Words:
    """The tokenizer, with the ids of pieces of text that were seen before kept at hand.

    Byte-level BPE never joins two pre-tokens, and none reaches over a single
    blank between two other characters, or over a line feed between two: cut
    there, a text's ids are those of its pieces in turn, the blank or line feed
    going with what follows it. A text is cut by a plain split if it has no
    other white space, else at its single blanks; a text that holds an added
    token goes to the library whole.
    """

    #: What a key stands for: text itself, text after a blank, and the end of a row.
    _SELF, _AFTER, _STOP = "self", "after", ("stop",)

    def __init__(self, path: str, end: int = 0, kept: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.end = Tokenizer.from_file(path), kept, end
        self.size = self.tokenizer.get_vocab_size()
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.single = re.compile(r"(?<=\S) (?=\S)")
        plain = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.feed, self.marks = plain("\n"), {m: plain(m) for m in ".,;:!?"}
        self.clear()

    def clear(self) -> None:
        self.known: dict = {self._STOP: 0}
        self.ids, self.first, self.length = np.array([self.end], np.int32), np.zeros(1, np.int64), np.ones(1, np.int64)

    def _open(self, key: str) -> bool:
        """Whether white space at a piece's edge may belong with its neighbour's."""
        at = 1 if key[:1] == "\n" else 0
        return len(key) <= at or key[at].isspace() or key[-1].isspace()

    def _word(self, key) -> list[int] | None:
        """Ids of letters, with a mark behind them at most: one or two pre-tokens, straight from the model."""
        if isinstance(key, tuple):
            return None
        head, lead, word = ([], _BLANK, key) if key[0] != "\n" else (self.feed, "", key[1:])
        tail = self.marks.get(word[-1], [])
        core = word[:-1] if tail else word
        if not core.isalpha():
            return None
        said = core if core.isascii() else core.encode().decode("latin1").translate(_SHOWN)
        return [*head, *[t.id for t in self.tokenizer.model.tokenize(lead + said)], *tail]

    def _learn(self, keys: list) -> None:
        fresh = [k for k in dict.fromkeys(keys) if k not in self.known]
        whole = [k for k in fresh if not (isinstance(k, str) and self._open(k))]
        self.known.update((k, -1) for k in fresh)
        got = [self._word(k) for k in whole]
        left = [n for n, g in enumerate(got) if g is None]
        texts = [(k[1] if k[0] is self._SELF else " " + k[1]) if isinstance(k, tuple) else k if k[0] == "\n" else " " + k for k in (whole[n] for n in left)]
        for n, e in zip(left, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            got[n] = e.ids
        self.known.update(zip(whole, range(len(self.length), len(self.length) + len(whole)), strict=True))
        length = np.fromiter(map(len, got), np.int64, len(got))
        self.first = np.concatenate((self.first, len(self.ids) + np.cumsum(length) - length))
        self.length = np.concatenate((self.length, length))
        self.ids = np.concatenate((self.ids, np.fromiter((i for g in got for i in g), np.int32, length.sum())))

    def _cut(self, text: str, closely: bool) -> list:
        if any(t in text for t in self.added):
            return [(self._SELF, text), self._STOP]
        if closely:
            head, *rest = self.single.split(text)
            return [(self._SELF, head), *[(self._AFTER, p) for p in rest], self._STOP]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = (self._SELF, parts[0])
        parts.append(self._STOP)
        return parts

    def _numbers(self, flat: list) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        except KeyError:
            self._learn(flat)
            return np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, each with the end, and how many each has."""
        if len(self.known) > self.kept:
            self.clear()
        if not texts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        parts = [self._cut(t, closely=t[:1].isspace()) for t in texts]
        which = self._numbers([p for row in parts for p in row])
        begin = np.cumsum([0, *map(len, parts[:-1])])
        unsure = np.flatnonzero(np.minimum.reduceat(which, begin) < 0)
        if len(unsure):
            for k in unsure:
                parts[k] = self._cut(texts[k], closely=True)
            which = self._numbers([p for row in parts for p in row])
            begin = np.cumsum([0, *map(len, parts[:-1])])
        n = self.length[which]
        out = self.ids[np.arange(n.sum()) + np.repeat(self.first[which] - (np.cumsum(n) - n), n)]
        return out, np.add.reduceat(n, begin)


#: A worker's tokenizer, kept from task to task.
_AT_HAND: dict[tuple[str, int], Words] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_SEGMENT = "part int, seg int, docs array<{id}>, counts array<int>, n long, size int, blocks binary"


def write_tokens(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = 0) -> None:
    """Tokenize ``text`` (null: empty), put ``end`` behind each row, and write segments in ascending id order.

    Null ids come first; rows with equal ids keep the order of their texts. Other columns are not read.
    """
    where = tokenizer or default_tokenizer()
    small_batches(df.sparkSession)
    limit = BLOCK * LANES

    def segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if (where, end) not in _AT_HAND:
            _AT_HAND[where, end] = Words(where, end)
        words = _AT_HAND[where, end]
        part, seg = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs: list = []
        counts: list[int] = []

        def flush() -> pd.DataFrame:
            data = encode_ids(np.concatenate(ids), words.size)
            return pd.DataFrame({"part": part, "seg": seg, "docs": [docs], "counts": [counts], "n": sum(counts), "size": words.size, "blocks": [data]})

        size = 0
        for df in batches:
            flat, each = words.encode(df["text"].to_list())
            at = 0
            for doc, n in zip(df["id"].tolist(), each.tolist(), strict=True):
                if docs and size + n > limit:
                    yield flush()
                    ids, docs, counts, size, seg = [], [], [], 0, seg + 1
                ids.append(flat[at : at + n])
                docs.append(None if doc is None or doc != doc else doc)
                counts.append(n)
                at, size = at + n, size + n
        if docs:
            yield flush()

    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = rows.repartitionByRange(parts, "id", F.xxhash64("text")).sortWithinPartitions("id", "text")
    kind = _SEGMENT.format(id=df.schema[id_col].dataType.simpleString())
    rows.mapInPandas(segments, kind).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """Per document: id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    segments = spark.read.parquet(path)
    id_type = segments.schema["docs"].dataType.elementType.simpleString()
    small_batches(spark, 50)
    sizes = segments.select("part", "seg", "n")
    # one row for each part, then one for each segment of a part
    parts = sizes.groupBy("part").agg(F.sum("n").alias("all"))
    parts = parts.withColumn("before", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("all")
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.withColumn("inner", inner).join(parts, "part").select("part", "seg", (F.col("before") + F.col("inner")).alias("start"))

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for row in df.itertuples():
                flat, n = decode_ids(row.blocks, row.size).astype("<u4"), np.asarray(row.counts, np.int64)
                each = np.split(flat, np.cumsum(n)[:-1])
                yield pd.DataFrame({"part": row.part, "seg": row.seg, "doc": list(row.docs), "inner": np.cumsum(n) - n, "n_tokens": n, "ids_crc32": [zlib.crc32(e.tobytes()) for e in each], "ids": [e.astype(np.int32) if ids else None for e in each]})

    docs = segments.mapInPandas(documents, f"part int, seg int, doc {id_type}, inner long, n_tokens long, ids_crc32 long, ids array<int>")
    out = docs.join(starts, ["part", "seg"]).select("doc", (F.col("start") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "ids")
    return out if ids else out.drop("ids")


def op8_token_files(docs: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read back from the files that were written."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return read_tokens(spark, path, ids=False).withColumnRenamed("doc", "doc_id")
