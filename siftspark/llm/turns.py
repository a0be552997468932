"""Conversation repair: the cheapest edits that make the turns alternate.

A conversation is a lattice: a layer for each turn, a node for each thing its
roles may end with so far (nothing, a system turn, a user turn, an assistant
turn), and an arc for each edit with its whole-number cost. Shortest paths are
found by the auction algorithm (Bertsekas, 1991): a path grows from the origin
along arcs whose cost equals the drop in price, and where there is none the
last node's price rises and the path shrinks. The prices that remain are dual
values: every arc of every cheapest path is tight under them, so the first
cheapest sequence of letters is read off by following tight arcs in the order
of their letters.

A long conversation is dealt out in chunks of ``TURNS`` turns. The auction gives
each chunk's costs from state to state; a tree of min-plus products carries the
prices of what follows back to every chunk, and a tree of state maps carries the
states forward. No task sees more than a chunk's turns or ``FAN`` chunks. Only
SHA-256 must read a conversation in one go; it does so as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.session import stored

#: Turns of a chunk, and chunks (or groups of chunks) that a task multiplies at once.
TURNS, FAN = 32, 64
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: What the roles so far end with.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may come next, if it is inserted or given to a turn; and by which edits an end is reached behind the last turn.
_NEXT = (USER, USER, ASSISTANT, USER)
_TAIL = ("", "II", "I", "")
_END = tuple(INSERT * len(t) for t in _TAIL)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_NEVER = 1 << 40

#: A turn is one letter: its fault (none, blank, duplicate, truncated) and its role's initial (s, u, a, other).
_LETTERS = "abcdefghijklmnop"
_INITIALS = "sua"


def _kept(role: int, state: int) -> int | None:
    """The state after keeping a turn, if it may be kept."""
    if role == 0:
        return SYSTEM if state == START else None
    if role == 1:
        return USER if state != USER else None
    return ASSISTANT if role == 2 and state == USER else None


def _lattice(shape: str, end: tuple[int, ...], low: int = START) -> tuple[list[list[tuple[str, int, int]]], list[int]]:
    """Arcs ``(letter, cost, node)`` of each node in letters' order, and prices to begin with; the target is the last node.

    ``end``: cost from each state behind the last turn on. Nodes from which no end of finite cost can follow get no arcs.
    """
    n = len(shape)
    target = 4 * (n + 1)
    open_ = [q for q in range(4) if end[q] < _NEVER]
    # nothing leads back to the start or to a system turn
    alive = [q <= max(open_) for q in range(4)] if max(open_) <= SYSTEM else [True] * 4
    arcs: list[list[tuple[str, int, int]]] = []
    for i, letter in enumerate(shape):
        fault, role = divmod(_LETTERS.index(letter), 4)
        last = i + 1 == n
        for q in range(4):
            mine = [("D", DELETE, 4 * (i + 1) + q), ("I", INSERT, 4 * i + _NEXT[q])]
            if fault not in (1, 2):
                more, to = TRUNCATED * (fault == 3), _kept(role, q)
                if to is not None:
                    mine.append(("K", KEEP + more, 4 * (i + 1) + to))
                mine.append(("R", REROLE + more, 4 * (i + 1) + _NEXT[q]))
            arcs.append([a for a in mine if alive[a[2] % 4] and not (last and a[0] != "I" and end[a[2] % 4] >= _NEVER)] if alive[q] else [])
    arcs += [[("", end[q], target)] if end[q] < _NEVER else [] for q in range(4)]
    # what the faults still ahead cost at least: no arc is cheaper than the drop in price along it
    price, ahead = [0] * (target + 1), min(end)
    for i in range(n, -1, -1):
        if i < n:
            ahead += (0, DELETE, DELETE, TRUNCATED)[_LETTERS.index(shape[i]) // 4]
        price[4 * i : 4 * i + 4] = [ahead] * 4
    price[target] = 0
    return arcs, price


def auction(arcs: list[list[tuple[str, int, int]]], price: list[int], origin: int) -> int:
    """Cost of the cheapest path from ``origin`` to the last node; ``price`` is raised until it is dual optimal for it.

    The prices may come from another origin's run. Without a path the cost is ``_NEVER`` or more.
    """
    target, path = len(price) - 1, [origin]
    while (at := path[-1]) != target:
        best, to = _NEVER, -1
        for _, cost, node in arcs[at]:
            if cost + price[node] < best:
                best, to = cost + price[node], node
        if price[at] < best:
            price[at] = best
            if at != origin:
                path.pop()
            elif best == _NEVER:
                return _NEVER
        elif to < 0:
            return _NEVER
        else:
            path.append(to)
    return price[origin]


def _trace(arcs: list[list[tuple[str, int, int]]], price: list[int], origin: int) -> tuple[str, int]:
    """The least letters among the cheapest paths, and the state in which they end."""
    target = len(price) - 1
    good = [False] * target + [True]
    for layer in range(target // 4 - 1, -1, -1):
        for _ in range(3):  # inserts lead from node to node of a layer
            for node in range(4 * layer, 4 * layer + 4):
                good[node] = any(good[to] and price[node] == cost + price[to] for _, cost, to in arcs[node])
    letters, at = [], origin
    while True:
        letter, to = next((a, to) for a, cost, to in arcs[at] if good[to] and price[at] == cost + price[to])
        if to == target:
            return "".join(letters), at % 4
        letters.append(letter)
        at = to


@lru_cache(100_000)
def _matrix(shape: str) -> tuple[int, ...]:
    """Costs from each state before a chunk (rows) to each state behind it."""
    out = [_NEVER] * 16
    for to in range(4):
        arcs, price = _lattice(shape, tuple(0 if q == to else _NEVER for q in range(4)))
        for q in range(4):
            out[4 * q + to] = min(auction(arcs, price, q), _NEVER)
    return tuple(out)


@lru_cache(100_000)
def _solved(shape: str, end: tuple[int, ...], entries: int) -> tuple[list[str], list[int]]:
    """Edits of a chunk and the state behind it, from each of the first ``entries`` states before it."""
    arcs, price = _lattice(shape, end)
    for q in range(entries):
        auction(arcs, price, q)
    return tuple(zip(*[_trace(arcs, price, q) for q in range(entries)], strict=True))


def _solve(shape: Column, end: Column, entries: int) -> Column:
    def of(shapes: pd.Series, ends: pd.Series) -> pd.DataFrame:
        rows = [_solved(s, tuple(map(int, e)), entries) for s, e in zip(shapes, ends, strict=True)]
        return pd.DataFrame({"audits": [list(r[0]) for r in rows], "exits": [list(r[1]) for r in rows]})

    return F.pandas_udf(of, "audits array<string>, exits array<bigint>")(shape, end)


def _costs_before(parts: list, after: np.ndarray) -> np.ndarray:
    return (np.asarray(parts, np.int64).reshape(4, 4) + after).min(1)


def _product(parts) -> list[int]:
    out = np.asarray(parts[0], np.int64).reshape(4, 4)
    for p in parts[1:]:
        out = (out[:, :, None] + np.asarray(p, np.int64).reshape(1, 4, 4)).min(1)
    return np.minimum(out, _NEVER).ravel().tolist()


def _suffixes(parts, end) -> list[list[int]]:
    out = [np.asarray(end, np.int64)]
    for p in reversed(parts[1:]):
        out.append(_costs_before(p, out[-1]))
    return [o.tolist() for o in reversed(out)]


def _composed(parts) -> list[int]:
    out = [0, 1, 2, 3]
    for p in parts:
        out = [int(p[q]) for q in out]
    return out


def _entered(parts, first) -> list[list[int]]:
    out = [int(first[0])]
    for p in parts[:-1]:
        out.append(int(p[out[-1]]))
    return [[q] for q in out]


def _tree(items: DataFrame, most: int, fold, spread, seed: tuple[int, ...]) -> DataFrame:
    """``items (cid, k, m)``, k from 0 -> ``(cid, k, v)``: ``fold`` joins the m of up to ``FAN`` neighbours on the way up, ``spread`` deals a group's v out to them on the way down."""
    up = F.pandas_udf(lambda s: s.map(fold), "array<bigint>")
    down = F.pandas_udf(lambda s, v: pd.Series([spread(p, x) for p, x in zip(s, v, strict=True)]), "array<array<bigint>>")
    levels, now = [], items
    while most > 1:
        group = now.groupBy("cid", F.expr(f"k div {FAN}").alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "m"))).alias("parts"))
        levels.append(stored(group.select("cid", "k", F.col("parts.k").alias("ks"), F.col("parts.m").alias("ms"))))
        now, most = levels[-1].select("cid", "k", up("ms").alias("m")), -(-most // FAN)
    out = now.select("cid", "k", F.array(*map(F.lit, seed)).cast("array<bigint>").alias("v"))
    for group in reversed(levels):
        dealt = group.join(out, ["cid", "k"]).withColumn("vs", down("ms", "v"))
        out = dealt.select("cid", F.explode(F.arrays_zip("ks", "vs")).alias("p")).select("cid", F.col("p.ks").alias("k"), F.col("p.vs").alias("v"))
    return out


def _word(col: Column) -> Column:
    return col.rlike(r"[^\x20\x09-\x0D]")


def _ordered(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` -> stored with ``pos``, a number that ascends in the order of conversations and turns, and ``part``.

    Turns of one number are ordered by role, their first 64 characters and a
    hash. The range of one conversation, or of rows that are all alike, is
    split like any other.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    order = ["conv", "turn", "role", "__head", "__hash"]
    keyed = rows.withColumns({"__head": F.substring("text", 1, 64), "__hash": F.xxhash64("text"), "__from": F.spark_partition_id()})
    sorted_ = keyed.repartitionByRange(n, *order, "__from").sortWithinPartitions(*order)
    return stored(sorted_.select("conv", "turn", "role", "text", F.monotonically_increasing_id().alias("pos"), F.spark_partition_id().alias("part")))


def _chunks(rows: DataFrame) -> DataFrame:
    """Chunks ``(cid, conv, k, total, first, shape)`` of ordered rows; nothing here reads a conversation as a whole."""
    same = [F.xxhash64("role", "text"), F.xxhash64(F.lit(7), "text", "role")]
    firsts = rows.groupBy("conv", *[h.alias(f"h{k}") for k, h in enumerate(same)]).agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(~_word(F.col("text")), 1).when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), 3).otherwise(0)
    role = F.instr(F.lit(_INITIALS), F.substring("role", 1, 1))
    role = F.when((F.col("role") == "") | (role == 0), 3).otherwise(role - 1)
    thin = rows.select("conv", "part", "pos", fault.alias("fault"), role.alias("role")).join(firsts, "pos", "left")
    fault = F.when((F.col("fault") != 1) & F.col("first").isNull(), 2).otherwise(F.col("fault"))
    thin = thin.select("conv", "part", "pos", F.substring(F.lit(_LETTERS), 4 * fault + F.col("role") + 1, F.lit(1)).alias("letter"))
    # one row for each part that a conversation reaches into
    spans = rows.groupBy("conv", "part").agg(F.min("pos").alias("low"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("conv")
    spans = spans.select(
        F.col("conv").alias("conv_"), F.col("part").alias("part_"), "low", F.min("low").over(whole).alias("cid"), F.sum("n").over(whole).alias("total"),
        F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    placed = thin.join(spans, F.col("conv").eqNullSafe(F.col("conv_")) & (F.col("part") == F.col("part_")))
    placed = placed.withColumn("k", F.expr(f"(before + pos - low) div {TURNS}"))
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "")
    return stored(placed.groupBy("cid", "k", "total", "conv").agg(F.min("pos").alias("first"), letters.alias("shape")))


def plan_edits(rows: DataFrame) -> DataFrame:
    """Ordered rows -> ``(conv, first, shape, entry, audit)`` of each chunk: the edits from its first turn on, and the state before it."""
    chunks = _chunks(rows)
    end = F.array(*map(F.lit, _END)).cast("array<bigint>")
    most = -(-(chunks.agg(F.max("total")).first()[0] or 0) // TURNS)
    short = chunks.where(F.col("total") <= TURNS).select("conv", "first", "shape", F.lit(START).cast("long").alias("entry"), F.get(_solve(F.col("shape"), end, 1)["audits"], F.lit(0)).alias("audit"))
    if most <= 1:
        return short
    long = chunks.where(F.col("total") > TURNS)
    costs = F.pandas_udf(lambda s: s.map(lambda x: list(_matrix(x))), "array<bigint>")
    ends = _tree(long.select("cid", "k", costs("shape").alias("m")), most, _product, _suffixes, _END)
    solved = stored(long.join(ends, ["cid", "k"]).withColumn("s", _solve(F.col("shape"), F.col("v"), 4)).select("cid", "k", "conv", "first", "shape", "s.audits", "s.exits"))
    entries = _tree(solved.select("cid", "k", F.col("exits").alias("m")), most, _composed, _entered, (START,))
    entered = solved.join(entries, ["cid", "k"]).withColumn("entry", F.get("v", F.lit(0)))
    return short.unionByName(entered.select("conv", "first", "shape", "entry", F.get("audits", F.col("entry").cast("int")).alias("audit")))


class _Reader:
    """Applies the edits of a conversation to its turns, in order."""

    def __init__(self, conv):
        self.conv, self.state, self.edits, self.shape = conv, START, "", ""
        self.audit: list[str] = []
        self.counts, self.cost, self.illegal, self.last, self.turns = [0] * 4, 0, 0, None, []
        self.hash, self.lines = hashlib.sha256(), 0

    def chunk(self, shape: str, entry: int, audit: str) -> None:
        self.edits, self.at, self.shape, self.row, self.state = audit, 0, shape, 0, entry
        self.audit.append(audit)
        for letter in shape:
            fault, role = divmod(_LETTERS.index(letter), 4)
            self.counts[fault] += 1
            self.illegal += self.last is not None and (self.last, role) not in ((0, 1), (1, 2), (2, 1))
            self.last = role

    def _put(self, edit: str, role: str, text: str):
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1
        return edit, role, text

    def _insert(self):
        self.cost, self.state = self.cost + INSERT, _NEXT[self.state]
        return self._put("I", _ROLE[self.state], "")

    def turn(self, turn, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """What stands for the turn: the inserted ones before it, and itself if it is kept."""
        if turn is not None and (not self.turns or self.turns[1] != turn):
            self.turns = [self.turns[0] if self.turns else turn, turn, (self.turns[2] if self.turns else 0) + 1]
        while self.edits[self.at] == "I":
            self.at += 1
            yield self._insert()
        edit, fault = self.edits[self.at], _LETTERS.index(self.shape[self.row]) // 4
        self.at, self.row = self.at + 1, self.row + 1
        if edit == "D":
            self.cost += DELETE
            return
        self.cost += (REROLE if edit == "R" else KEEP) + TRUNCATED * (fault == 3)
        self.state = _NEXT[self.state] if edit == "R" else _kept(_LETTERS.index(self.shape[self.row - 1]) % 4, self.state)
        yield self._put(edit, _ROLE[self.state] if edit == "R" else role, text)

    def close(self) -> Iterator[tuple[str, str, str]]:
        for _ in _TAIL[self.state]:
            self.audit.append("I")
            yield self._insert()

    def digest(self) -> dict:
        gaps = self.turns[1] - self.turns[0] + 1 - self.turns[2] if self.turns else 0
        return {"conv": self.conv, "gaps": gaps, "blank": self.counts[1], "duplicate": self.counts[2], "truncated": self.counts[3], "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


def _applied(rows: DataFrame, edits: DataFrame, seen: DataFrame, out: str) -> DataFrame:
    """A pass over conversations in order. ``out``: ``rows`` or ``digest``; ``seen``: conversations that may have no row."""
    kind = rows.schema["conv"].dataType.simpleString()
    columns = "conv: , pos:bigint, kind:int, turn:bigint, role:string, text:string, shape:string, entry:bigint, audit:string".replace(": ", f":{kind}", 1)
    null = F.lit(None)
    tables = [
        rows.select("conv", "pos", F.lit(2).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", null.alias("shape"), null.alias("entry"), null.alias("audit")),
        edits.select("conv", F.col("first").alias("pos"), F.lit(1).alias("kind"), null.alias("turn"), null.alias("role"), null.alias("text"), "shape", "entry", "audit"),
        seen.select("conv", F.lit(-1).alias("pos"), F.lit(0).alias("kind"), *[null.alias(c) for c in ("turn", "role", "text", "shape", "entry", "audit")]),
    ]
    types = dict(c.strip().split(":", 1) for c in columns.split(", "))
    tables = [t.select(*[F.col(c).cast(k).alias(c) for c, k in types.items()]) for t in tables]
    together = tables[0].unionByName(tables[1]).unionByName(tables[2])
    digest = "conv {}, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string".format(kind)
    schema = digest if out == "digest" else f"conv {kind}, at bigint, turn bigint, edit string, role string, text string"
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, done, types = None, [], None

        def put(edits, turn=None):
            for edit, role, text in edits:
                if out == "rows":
                    done.append({"conv": reader.conv, "at": reader.lines - 1, "turn": turn if edit != "I" else None, "edit": edit, "role": role, "text": text})

        def finish():
            put(reader.close())
            if out == "digest":
                done.append(reader.digest())

        for batch in batches:
            types = types or {"conv": batch.schema.field("conv").type}
            for row in batch.to_pylist():
                if reader is None or reader.conv != row["conv"]:
                    if reader is not None:
                        finish()
                    reader = _Reader(row["conv"])
                if row["kind"] == 1:
                    reader.chunk(row["shape"], row["entry"], row["audit"])
                elif row["kind"] == 2:
                    put(reader.turn(row["turn"], row["role"], row["text"]), row["turn"])
            if done:
                yield _record(done, names, types)
                done.clear()
        if reader is not None:
            finish()
            if done:
                yield _record(done, names, types)

    return together.repartition("conv").sortWithinPartitions("conv", "pos", "kind").mapInArrow(read, schema)


def _record(rows: list[dict], names: list[str], types: dict) -> pa.RecordBatch:
    text = {"audit", "repaired_sha256", "edit", "role", "text"}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string() if c in text else pa.int64())) for c in names], names)


def _taken(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The four columns under fixed names; a null role or text is one space."""
    return df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Repaired conversations ``(conv, at, turn, edit, role, text)``, ``at`` counting from 0.

    ``edit``: K kept, R given the role that was due, I inserted with empty text
    (and null turn); deleted turns are left out. Null turns come first; null
    roles and texts are one space; null conversations are one conversation.
    Turns of one number are ordered by role, then by the text's first 64
    characters and a hash. Other columns are not read.
    """
    rows = _ordered(_taken(df, conv, turn, role, text))
    return _applied(rows, plan_edits(rows), rows.select("conv").limit(0), "rows").withColumnRenamed("conv", conv)


def digest(df: DataFrame, seen: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Faults, cost, edits and a hash of the repaired text of each conversation, also of those that only ``seen`` has."""
    rows = _ordered(_taken(df, conv, turn, role, text))
    others = seen.select(F.col(conv).alias("conv")).distinct() if seen is not None else rows.select("conv").limit(0)
    return _applied(rows, plan_edits(rows), others, "digest").withColumnRenamed("conv", conv)


def damaged(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's damage: rows that are left, and rows that were dropped."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).cast("int")
    rows = df.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1)))
    left = rows.where("fault <> 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy"))
    return left.drop("copy"), rows.where("fault = 0")


def op11_conversation_repair(conversations: DataFrame) -> DataFrame:
    """Every conversation of the damaged table: its faults, the cheapest edits and the repaired text's hash."""
    left, dropped = damaged(conversations)
    return digest(left, dropped)




#: Dynamic programming from each conversation's end, whole strings of edits compared; CRC-32 bit by bit.
OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT i AS c0, """ + ", ".join(f"xor(c{k} >> 1, 3988292384 * (c{k} & 1)) AS c{k + 1}" for k in range(8)) + r""" FROM (SELECT range AS i FROM range(256))),
crc AS (SELECT list(c8 ORDER BY c0) AS t FROM bits),
conv AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
keyed AS (SELECT k, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ord(x)::BIGINT) AS b
  FROM conversations c JOIN conv ON c.conv_id IS NOT DISTINCT FROM conv.conv_id),
hit AS (SELECT k, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 AS d FROM keyed, crc),
damaged AS (SELECT k, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hit, range(2) n WHERE n.range < CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
f AS (SELECT *, left(role, 1) AS c, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY k, role, text ORDER BY i) > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM placed),
follow AS (SELECT *, c || lead(c) OVER (PARTITION BY k ORDER BY i) AS two, lead(i) OVER (PARTITION BY k ORDER BY i) IS NOT NULL AS more FROM f),
sums AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
  count(*) FILTER (more AND two NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM follow GROUP BY k),
ways(q, ins, st) AS (VALUES ('', '', ''), ('', 'I', 'u'), ('', 'II', 'a'), ('s', '', 's'), ('s', 'I', 'u'), ('s', 'II', 'a'), ('u', '', 'u'), ('u', 'I', 'a'), ('u', 'II', 'u'), ('a', '', 'a'), ('a', 'I', 'u'), ('a', 'II', 'a')),
edits AS (SELECT k, i, q, ins, e, 2 * length(ins) + CASE e WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 3 THEN 1 ELSE 0 END AS cost,
  CASE e WHEN 'D' THEN st WHEN 'K' THEN c ELSE CASE WHEN st = 'u' THEN 'a' ELSE 'u' END END AS upto FROM f, ways, (VALUES ('D'), ('K'), ('R')) v(e)
  WHERE e = 'D' OR fault NOT IN (1, 2) AND (e = 'R' OR c = 's' AND st = '' OR c = 'u' AND st <> 'u' OR c = 'a' AND st = 'u')),
best AS (SELECT k, n + 1 AS i, q, {'cost': CAST(2 * length(t) AS BIGINT), 'audit': t} AS b FROM sums, (VALUES ('', ''), ('s', 'II'), ('u', 'I'), ('a', '')) v(q, t)
  UNION ALL SELECT edits.k, edits.i, edits.q, min({'cost': CAST(edits.cost + b.cost AS BIGINT), 'audit': ins || e || b.audit}) FROM best JOIN edits ON edits.k = best.k AND edits.i = best.i - 1 AND upto = best.q GROUP BY ALL),
found AS (SELECT k, b.cost AS cost, b.audit AS audit FROM best WHERE i = 1 AND q = ''),
letters AS (SELECT k, unnest(string_split(audit, '')) AS e, generate_subscripts(string_split(audit, ''), 1) AS p FROM found),
spots AS (SELECT k, p, e, count(*) FILTER (e <> 'I') OVER (PARTITION BY k ORDER BY p) AS i FROM letters),
kept AS (SELECT spots.k, p, e, role, text, row_number() OVER (PARTITION BY spots.k ORDER BY p) - 1 AS m, first_value(e = 'K' AND c = 's') OVER (PARTITION BY spots.k ORDER BY p) AS sys
  FROM spots LEFT JOIN f ON f.k = spots.k AND f.i = spots.i WHERE e <> 'D'),
lines AS (SELECT k, p, CASE WHEN e = 'K' THEN role WHEN (m - CASE WHEN sys THEN 1 ELSE 0 END) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END AS line FROM kept),
said AS (SELECT k, string_agg(line, chr(10) ORDER BY p) AS line FROM lines GROUP BY k)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(line, '')) AS repaired_sha256
FROM conv LEFT JOIN sums USING (k) LEFT JOIN found USING (k) LEFT JOIN said USING (k)"""
