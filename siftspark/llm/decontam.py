"""Benchmark decontamination: item-sized windows of documents against benchmark items.

1. Places in documents whose word shingle occurs in an item are found by one join.
2. A window as long as an item can reach the threshold only if enough of its
   shingles are such places; all windows of that kind are taken, wherever they
   start.
3. Windows and items get 64-bit SimHash fingerprints. Those within ``RADIUS``
   bits are found by a multi-index: of 8 blocks of 8 bits, at least one differs
   in at most two bits, so an equi-join of blocks with the items' blocks, as
   they are and with one or two bits flipped, misses none. Fingerprints of
   windows at similarity 0.8 differ in 10 bits on average, with a deviation of
   3: the radius is more than four deviations beyond. So wide a radius selects
   little by itself; the index is therefore kept apart for each rare shingle.
   With shingles in order of the number of items that have them, a window and
   an item that share enough of them share one among the first few of both,
   and only there their blocks are compared.
4. Candidates are verified by weighted Jaccard similarity: shingles weigh as
   often as they occur.

Built-in functions only; documents are never grouped together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.llm.linedup import _ceil
from siftspark.session import cut, unused

RADIUS, _BLOCKS = 23, 8
#: Each value of a block, and with one or two bits turned: 8 blocks within 23 bits cannot all differ in three.
_MASKS = tuple(m for m in range(256) if m.bit_count() <= 2)
#: Broadcast sides are at most so many rows (of 12 bytes, and of a list of places); larger ones are joined by a shuffle.
_BROADCAST_SHINGLES, _BROADCAST_DOCS = 1_000_000, 200_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def _shingles(words: str, k: int) -> Column:
    """Hashes of the k-word shingles of array column ``words``, in order; too few words: none."""
    at = lambda i: F.xxhash64(F.lit(k), *[F.get(F.col(words), i + j) for j in range(k)])
    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), at)).otherwise(F.array().cast("array<bigint>"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and array ``hs`` -> ``keys`` and ``fp``; a bit is 1 if set in over half of ``hs``."""
    one = F.lit(1).cast("long")
    counts = rows.select(*keys, F.explode("hs").alias("h")).groupBy(*keys).agg(F.count(F.lit(1)).alias("hashes"), *[F.sum(F.shiftrightunsigned("h", b).bitwiseAND(one)).alias(f"b{b}") for b in range(64)])
    fp = F.lit(0).cast("long")
    for b in range(64):
        fp = fp.bitwiseOR(F.when(F.col(f"b{b}") * 2 > F.col("hashes"), F.shiftleft(one, b)).otherwise(F.lit(0).cast("long")))
    return counts.select(*keys, fp.alias("fp"))


def _block_rows(fp: str) -> Column:
    """A row for each block: its number and value."""
    of = lambda k: F.shiftrightunsigned(fp, 8 * k).bitwiseAND(F.lit(255).cast("long")).cast("int")
    return F.posexplode(F.array(*[of(k) for k in range(_BLOCKS)])).alias("k", "v")


def _masks() -> Column:
    """A row for each mask of at most two bits; a list of numbers, not of expressions, so that the plan stays small."""
    return F.explode(F.array(*map(F.lit, _MASKS))).alias("mask")


def _weighted(a: str, b: str) -> Column:
    """Size of the multiset intersection of two arrays."""
    plain = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    times = lambda x, col: F.size(F.filter(F.col(col), lambda y: y == x))
    counted = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(times(x, a), times(x, b)))
    return F.when(plain, F.size(F.array_intersect(a, b))).otherwise(counted)


def _candidates(windows: DataFrame, item: DataFrame, often: DataFrame, threshold: float) -> DataFrame:
    """Windows and items that meet in a block of the index of a rare shingle: their keys, and their fingerprints ``x`` and ``y``.

    A window of an item's m shingles has at least ``threshold`` times m, so that
    an item's first m - ceil(threshold * m) + 1 shingles are enough for all.
    """
    wkey, ikey = ["dk", "n", "start"], ["ik", "n"]
    wfp, ifp = _fingerprints(windows, wkey), _fingerprints(item, ikey)
    m = F.col("n") - F.col("k") + 1
    ranked = item.select("ik", "n", m.alias("m"), F.explode("hs").alias("h")).join(often, "h").groupBy("ik", "n", "m").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("r"))
    first = ranked.select("ik", "n", F.explode(F.array_distinct(F.transform(F.slice("r", F.lit(1), F.col("m") - _ceil(threshold, F.col("m")) + 1), lambda x: x["h"]))).alias("h"))
    x = wfp.join(windows.select(*wkey, "rare"), wkey).select(*wkey, F.explode("rare").alias("h"), F.col("fp").alias("x")).select("*", _block_rows("x"))
    y = ifp.join(first, ikey).select(*ikey, "h", F.col("fp").alias("y")).select("*", _block_rows("y")).select("*", _masks())
    y = y.select(*ikey, "h", "y", "k", F.col("v").bitwiseXOR(F.col("mask")).alias("v"))
    # by a shuffle: a block's values make dozens of rows of each item's shingle, too many to be held and sent out by the driver
    return x.join(y.hint("merge"), ["n", "h", "k", "v"])


def leaks(docs: DataFrame, items: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """``docs (dk, text)``, ``items (item_id, text)`` -> one row for each document and item that match.

    Columns dk, item_id, similarity, word_start, n_words: the best window, the
    first on ties. An item of n < ``shingle`` words is one shingle of n words;
    a document shorter than an item is one window. Null or wordless texts match
    nothing. Repeated items match each under its own id; rows with one ``dk``
    must have one text.
    """
    item = items.select("item_id", _words(F.col("text")).alias("w")).where("size(w) > 0").withColumn("n", F.size("w"))
    item = item.withColumn("k", F.least("n", F.lit(shingle)))
    sizes = sorted(r[0] for r in item.select("k").distinct().collect())  # at most ``shingle`` values
    hs = F.array().cast("array<bigint>")
    for k in sizes:
        hs = F.when(F.col("k") == k, _shingles("w", k)).otherwise(hs)
    item = cut(item.select(F.xxhash64("item_id", "w").alias("ik"), "item_id", "n", "k", hs.alias("hs")))
    often = item.select(F.explode(F.array_distinct("hs")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    known = cut(item.select(F.explode("hs").alias("h"), "n", "k").distinct().join(often, "h"))

    def hashed(rows: DataFrame) -> DataFrame:
        said = rows.select(*[c for c in rows.columns if c != "text"], _words(F.col("text")).alias("w"))
        return said.withColumn("by_k", F.array(*[F.struct(F.lit(k).alias("k"), _shingles("w", k).alias("hs")) for k in sizes])).drop("w")

    if not sizes:
        return docs.select("dk").join(items.select("item_id"), F.lit(False)).selectExpr("dk", "item_id", "cast(0 as double) similarity", "0 word_start", "0 n_words")
    # outer: a plain explode would add a filter that hashes each document twice
    places = hashed(docs).select("dk", F.inline_outer("by_k")).select("dk", F.posexplode_outer("hs").alias("pos", "h"))
    places = places.join(_small(known, _BROADCAST_SHINGLES), "h").select("dk", "n", "k", "pos", "c")
    at = cut(places.groupBy("dk", "n", "k").agg(F.sort_array(F.collect_set(F.struct("pos", "c"))).alias("marks")))
    per_doc = at.groupBy("dk").agg(F.collect_list(F.struct("n", "k", F.col("marks.pos").alias("at"), "marks")).alias("sizes"))
    seen = hashed(docs).join(_small(per_doc, _BROADCAST_DOCS), "dk").select("dk", "by_k", F.inline_outer("sizes"))
    seen = seen.select("dk", "n", "at", "marks", F.get(F.expr("filter(by_k, x -> x.k = k)"), 0)["hs"].alias("hs"), (F.col("n") - F.col("k") + 1).alias("m"))
    seen = seen.withColumn("mw", F.least("m", F.size("hs"))).withColumn("need", _ceil(threshold / (1 + threshold), F.col("m") + F.col("mw")))
    # the first and the last of ``need`` places next to each other, if one window holds them
    starts = F.transform(F.sequence(F.lit(0), F.size("at") - F.col("need")), lambda i: F.struct(F.greatest(F.lit(0), F.get("at", i + F.col("need") - 1) - F.col("mw") + 1).alias("a"), F.least(F.get("at", i), F.size("hs") - F.col("mw")).alias("b")))
    spans = F.filter(starts, lambda s: s["a"] <= s["b"])
    every = F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["a"], s["b"]))))
    windows = seen.where(F.size("at") >= F.col("need")).select("dk", "n", "m", "mw", "need", "hs", "marks", F.explode(every).alias("start"))
    # in order of rarity a window begins with what no item has; of its first mw - need + 1 shingles those that items have
    inside = F.filter("marks", lambda x: (x["pos"] >= F.col("start")) & (x["pos"] < F.col("start") + F.col("mw")))
    rare = F.array_sort(F.transform(inside, lambda x: F.struct(x["c"].alias("c"), F.get("hs", x["pos"]).alias("h"))))
    rare = F.transform(F.slice(rare, F.lit(1), F.greatest(F.size(rare) - F.col("need") + 1, F.lit(0))), lambda x: x["h"])
    # in a step of its own: places are those of the whole text, not of the slice
    windows = windows.withColumn("rare", F.array_distinct(rare))
    windows = cut(windows.select("dk", "n", "m", "mw", "start", F.slice("hs", F.col("start") + 1, F.col("mw")).alias("part"), "rare").withColumnRenamed("part", "hs").dropDuplicates(["dk", "n", "start"]))
    wkey, ikey = ["dk", "n", "start"], ["ik", "n"]
    near = _candidates(windows, item, often, threshold).where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= RADIUS).select(*wkey, "ik").distinct()
    pairs = near.join(windows.drop("rare"), wkey).join(item.select("ik", "n", "item_id", F.col("hs").alias("ihs")), ikey)
    shared = _weighted("hs", "ihs")
    scored = pairs.withColumn("similarity", shared / (F.col("m") + F.col("mw") - shared)).where(F.col("similarity") >= threshold - 1e-9)
    best = scored.groupBy("dk", "item_id").agg(F.max_by(F.struct("similarity", "start", "n"), F.struct("similarity", -F.col("start"))).alias("b"))
    return best.select("dk", "item_id", F.col("b.similarity").alias("similarity"), F.col("b.start").alias("word_start"), F.col("b.n").alias("n_words"))


def _keyed(df: DataFrame, id_col: str, text: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text))


def find_leaks(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row for each document and benchmark item that match; see :func:`leaks`.

    Repeated rows (equal id and text) give one row; a null id is reported as null.
    """
    docs = df.select(F.col(id_col).alias(id_col), F.col(text).alias("text"), _keyed(df, id_col, text).alias("dk"))
    found = cut(leaks(docs.select("dk", "text"), items, **how))
    ids = docs.select("dk", id_col).join(_small(found.select("dk").distinct(), _BROADCAST_DOCS), "dk", "left_semi").distinct()
    return ids.join(found, "dk").drop("dk")


def drop_leaked(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Rows of ``df`` that match no benchmark item; all columns as they are."""
    name = unused(df, "dk")
    key = df.withColumn(name, _keyed(df, id_col, text))
    found = cut(leaks(key.select(F.col(name).alias("dk"), F.col(text).alias("text")), items, **how).select(F.col("dk").alias(name)).distinct())
    return key.join(_small(found, _BROADCAST_SHINGLES), name, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def op7_decontamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and benchmark item that match, with the best window. See :func:`leaks`."""
    return find_leaks(docs, items).select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "word_start", "n_words")


#: All windows that share a shingle with an item, compared with it directly; no fingerprints.
OP7_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '') AS w FROM benchmark),
dp AS (SELECT doc_id, w, len(w) - 4 AS hs, unnest(range(len(w) - 4)) AS pos FROM dw WHERE len(w) >= 5),
ds AS (SELECT doc_id, hs, pos, array_to_string(w[pos + 1:pos + 5], ' ') AS s FROM dp),
ip AS (SELECT item_id, w, len(w) - 4 AS m, unnest(range(len(w) - 4)) AS pos FROM iw WHERE len(w) >= 5),
it AS (SELECT item_id, m, array_to_string(w[pos + 1:pos + 5], ' ') AS s, count(*) AS c FROM ip GROUP BY ALL),
st AS (SELECT DISTINCT doc_id, item_id, m, least(m, hs) AS mw, unnest(range(greatest(pos - least(m, hs) + 1, 0), least(pos, hs - least(m, hs)) + 1)) AS start FROM ds JOIN it ON ds.s = it.s),
wc AS (SELECT st.doc_id, item_id, m, mw, start, s, count(*) AS c FROM st JOIN ds ON st.doc_id = ds.doc_id AND ds.pos BETWEEN start AND start + mw - 1 GROUP BY ALL),
sc AS (SELECT doc_id, wc.item_id, start, wc.m + 4 AS n, sum(least(wc.c, it.c)) AS inter, any_value(wc.m + mw) AS total FROM wc JOIN it ON wc.item_id = it.item_id AND wc.s = it.s GROUP BY doc_id, wc.item_id, start, wc.m),
best AS (SELECT *, inter / (total - inter) AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY inter / (total - inter) DESC, start) AS k FROM sc)
SELECT doc_id, item_id, round(similarity, 6) AS similarity, CAST(start AS INT) AS word_start, CAST(n AS INT) AS n_words FROM best WHERE k = 1 AND similarity >= 0.8 - 1e-9
"""
