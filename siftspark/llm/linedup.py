"""Line dedup: an exact set-similarity join of all lines, later matches removed.

A line is its set of lower-cased words. Words are ordered by rarity. Two lines
of Jaccard similarity t or more share a word among the first
``n - ceil(t n) + 1`` of each (prefix filter), and the first word that they
share in that order has enough words behind it on both sides (positional
filter). Pairs that meet so are tested by length and by the parity bits of both
sets, whose differing bits never outnumber the words in which the sets differ,
then by their prefixes in full, of which few words can be apart; what is left
is verified on the words themselves.

Rarity is taken from a table of 2**20 counts, one for each hash bucket of words:
any fixed order of words gives the same pairs, and this one is small however
large the vocabulary. A word alone in a bucket of count one is in no other
line and meets nothing. Equal sets are one class from the start.

Only the existence of an earlier match matters. So each line is first tried
with a few leaders for each frequent word in its prefix, at most ``_LEADERS`` a
word, which settles nearly every line of a large group of near copies; only
lines without such a match go on to meet all others. Lines, pairs and words
stay in Spark's shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.session import cut, drop, stored, unused

_BUCKETS = 1 << 20
#: At most so many keys of lines, 12 bytes each, are broadcast; more are joined by a shuffle.
_BROADCAST_LINES = 2_000_000
_SET = ("sig", "parity")
#: Counts are kept as four times their logarithm; words from this one on (64 occurrences) are frequent.
_FREQUENT = 24
_LEADERS = 4
#: Of the table that tells which lines are verified, where they are too many to be broadcast.
_BITS = 1 << 23


def _plain(text: Column) -> Column:
    """Lower-cased, with blanks for all other white space but the line feed: a split by a blank needs no pattern."""
    for c in "\t\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.lower(text)


def _split(plain: Column) -> Column:
    return F.array_remove(F.split(plain, " "), "")


def _lines(docs: DataFrame) -> DataFrame:
    """Lines, made plain, with their places. Outer: a plain explode would add a filter that splits each text twice."""
    return docs.select("id", "dk", F.posexplode_outer(F.split(_plain(F.col("text")), "\n", -1)).alias("pos", "line"))


def _ceil(share: float, n: Column) -> Column:
    return F.ceil(F.lit(share) * n - F.lit(1e-9)).cast("int")


def _rarity(docs: DataFrame) -> Column:
    """A scalar subquery: for each bucket four times the logarithm of the number of its words in all texts."""
    bucket = F.pmod(F.xxhash64("w"), F.lit(_BUCKETS)).alias("b")
    words = docs.select(F.explode_outer(F.split(F.replace(_plain(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    count = words.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    every = docs.sparkSession.range(_BUCKETS).withColumnRenamed("id", "b").join(count, "b", "left")
    entry = F.struct("b", F.floor(4 * F.log2(F.coalesce("n", F.lit(1)))).cast("byte").alias("c"))
    # one row of a fixed size
    return cut(every.agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["c"]).alias("rarity"))).scalar()


def _line_sets(docs: DataFrame, threshold: float) -> DataFrame:
    """Per line: place, set hash, parity bits, size, and its prefix in order of rarity.

    A word in the prefix is 31 bits of its hash, less than zero if the word is frequent, and null if no other line has it.
    """
    low56, one = F.lit((1 << 56) - 1), F.lit(1).cast("long")
    lines = _lines(docs).withColumn("rarity", _rarity(docs))

    def rank(w: Column) -> Column:
        h = F.xxhash64(w)
        return F.shiftleft(F.get(F.col("rarity"), F.pmod(h, F.lit(_BUCKETS)).cast("int")).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8).bitwiseAND(low56))

    def token(x: Column) -> Column:
        low = x.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int")
        return F.when(x >= F.lit(_FREQUENT << 56), F.bitwise_not(low)).when(x > low56, low)

    lines = lines.select("id", "dk", "pos", F.sort_array(F.array_distinct(F.transform(_split(F.col("line")), rank))).alias("ids"))
    n = F.size("ids")
    # 64 bits, each the parity of the number of words that hash to it
    parity = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(F.lit(63).cast("long")).cast("int"))))
    prefix = F.transform(F.slice("ids", F.lit(1), n - _ceil(threshold, n) + 1), token)
    sets = lines.select("id", "dk", "pos", F.xxhash64("ids").alias("sig"), parity.alias("parity"), n.alias("n"), prefix.alias("prefix"))
    # lines without words are dropped after writing: a filter here would compute each set twice
    return stored(sets)


def _may_match(x: str, y: str, t: float) -> Column:
    """Length, positional and parity filters for rows that meet in a word."""
    c = lambda side, name: F.col(f"{side}.{name}")
    nx, ny, ix, iy = c(x, "n"), c(y, "n"), c(x, "i"), c(y, "i")
    need = F.lit(t / (1 + t)) * (nx + ny) - F.lit(1e-9)
    # as if this were the first word shared; of a true pair's words one is
    place = F.lit(1) + F.least(nx - ix - 1, ny - iy - 1)
    bits = (nx + ny - F.bit_count(c(x, "parity").bitwiseXOR(c(y, "parity")))) / F.lit(2.0)
    return (F.least(nx, ny) >= F.lit(t) * F.greatest(nx, ny) - F.lit(1e-9)) & (place >= need) & (bits >= need)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has so many rows at most."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _place() -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64("dk", "pos"), F.lit(_BITS))
    return (h / 64).cast("int"), h.bitwiseAND(F.lit(63).cast("long")).cast("int")


def _bits(ends: DataFrame) -> Column:
    """A scalar subquery: a table of 2**23 bits, those set to which the hash of a line's place leads."""
    word, bit = _place()
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    every = ends.sparkSession.range(_BITS // 64).select(F.col("id").cast("int").alias("b"))
    said = every.join(ends.groupBy(word.alias("b")).agg(F.bit_or(one).alias("v")), "b", "left")
    entry = F.struct("b", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return cut(said.agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["v"]).alias("bits"))).scalar()


def _bit_of(bits: str) -> Column:
    word, bit = _place()
    return F.call_function("shiftrightunsigned", F.get(F.col(bits), word), bit).bitwiseAND(F.lit(1).cast("long")) == 1


def _near_heads(pairs: DataFrame, classes: DataFrame, t: float) -> DataFrame:
    """Those of the ``(c, first)`` pairs whose prefixes leave room for a match.

    Of two prefixes one ends first in the order of rarity. What the other set
    has of its words lies in the other prefix, so all of them but those in
    which its set may differ are in both. Words that fall on one token, and
    words that no other line has, only make the difference seem smaller.
    """
    ends = pairs.select("c").union(pairs.select("first")).distinct()
    heads = classes.select("c", "n", "prefix").join(_small(ends, _BROADCAST_LINES), "c", "left_semi")
    a, b = heads.toDF("c", "an", "ap"), heads.toDF("first", "bn", "bp")
    need = F.lit(t / (1 + t)) * (F.col("an") + F.col("bn")) - F.lit(1e-9)
    near = (F.size(F.array_except("ap", "bp")) <= F.col("an") - need) | (F.size(F.array_except("bp", "ap")) <= F.col("bn") - need)
    return pairs.join(a, "c").join(b, "first").where(near).select("c", "first")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, t: float, repeated: bool) -> DataFrame:
    """Numbers ``c`` of the later classes of those ``(c, first)`` pairs whose words match; ``repeated``: a key of ``docs`` may occur twice."""
    met = stored(pairs.distinct())
    pairs = stored(_near_heads(met, classes, t))
    drop(met)
    ends = pairs.select("c").union(pairs.select("first")).distinct()
    ends = stored(classes.select("c", "at.dk", "at.pos").join(_small(ends, _BROADCAST_LINES), "c", "left_semi"))
    asked, said = _small(ends, _BROADCAST_LINES // 4), _lines(docs).select("dk", "pos", "line")
    if asked is ends:
        # before the shuffle: only lines whose bit is set can be asked for
        said = said.withColumn("bits", _bits(ends)).where(_bit_of("bits"))
    said = said.join(asked, ["dk", "pos"]).select("c", F.array_distinct(_split(F.col("line"))).alias("words"))
    said = stored(said.dropDuplicates(["c"]) if repeated else said)
    a, b = said.withColumnRenamed("words", "aw"), said.select(F.col("c").alias("first"), F.col("words").alias("bw"))
    both = pairs.join(a, "c").join(b, "first")
    shared = F.size(F.array_intersect("aw", "bw"))
    out = stored(both.where(shared >= F.lit(t) * (F.size("aw") + F.size("bw") - shared) - F.lit(1e-9)).select("c").distinct())
    drop(pairs, ends, said)
    return out


def matched_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(id, dk, text)`` -> ``(dk, pos)`` of every line that an earlier line matches.

    Lines are ordered by (id, place), null ids first. A line goes if any
    earlier line, kept or not, has a Jaccard similarity of ``threshold`` or
    more to it; which lines go so does not depend on the order of removal.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    every = _line_sets(docs, threshold)
    repeated = bool(every.where("pos = 0").groupBy("dk").count().where("count > 1").take(1))
    sets = every.where("n > 0")
    at = F.struct("id", "pos", "dk")
    classes = sets.groupBy(*_SET).agg(F.min(at).alias("at"), F.min("n").alias("n"), F.min("prefix").alias("prefix"))
    # numbers in the order of the classes' first lines; written, so that they stay
    classes = stored(classes.repartitionByRange(parts, "at", "sig").sortWithinPartitions("at", "sig").withColumn("c", F.monotonically_increasing_id()))
    places = classes.select("c", "n", "parity", F.posexplode("prefix").alias("i", "tok")).where("tok is not null")

    def meet(left: DataFrame, right: DataFrame) -> DataFrame:
        x, y = left.alias("x"), right.alias("y")
        near = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("y.c") < F.col("x.c")) & _may_match("x", "y", threshold))
        return near.select("x.c", F.col("y.c").alias("first"))

    some = places.where("tok < 0")
    leaders = some.groupBy("tok", F.pmod("c", F.lit(_LEADERS)).alias("k")).agg(F.min(F.struct("c", "n", "parity", "i")).alias("p")).select("tok", "p.*")
    done = _verified(meet(some, leaders), classes, docs, threshold, repeated)
    # the lines that this has not settled against all, from one shuffle; an anti join would be moved before it, and make it two
    dealt = places.repartition(parts, "tok")
    settled = _small(done.withColumn("settled", F.lit(True)), _BROADCAST_LINES)
    later = _verified(meet(dealt.join(settled, "c", "left").where("settled is null"), dealt), classes, docs, threshold, repeated)
    gone = _small(done.unionByName(later).withColumn("gone", F.lit(True)), _BROADCAST_LINES)
    verdict = classes.select(*_SET, "at", "c").join(gone, "c", "left").drop("c")
    lines = sets.select(*_SET, "dk", "pos").join(verdict, list(_SET))
    out = stored(lines.where("gone or dk <> at.dk or pos <> at.pos").select("dk", "pos"))
    drop(sets, classes, done, later)
    return out


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8, removed: str | None = None) -> DataFrame:
    """``df`` with the matched lines taken out of ``text``.

    ``removed`` names a column to add, the sorted places of the lines removed.
    Null texts stay null, lines without words stay. Rows with equal id and
    text count as one document and are treated alike; a null id comes before
    all others. Other columns are untouched, whatever their names.
    """
    key, out_ = unused(df, "dk"), unused(df, "gone")
    keyed = df.withColumn(key, F.xxhash64(F.col(id_col), F.col(text)))
    docs = keyed.select(F.col(id_col).alias("id"), F.col(key).alias("dk"), F.col(text).alias("text"))
    gone = stored(matched_lines(docs, threshold).groupBy(F.col("dk").alias(key)).agg(F.collect_set("pos").alias(out_)))
    size = gone.agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size(out_)).alias("lines")).first()
    if size.docs * 8 + (size.lines or 0) <= _BROADCAST_LINES:
        gone = F.broadcast(gone)
    joined = keyed.join(gone, key, "left")
    lines = F.split(F.col(text), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(out_))
    new = F.when(F.col(out_).isNull(), F.col(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn(text, new)
    if removed:
        out = out.withColumn(removed, F.sort_array(F.coalesce(out_, F.array().cast("array<int>"))))
    return out.drop(key, out_).select(*[F.col(f"`{c}`") for c in df.columns if c != removed], *([removed] if removed else []))


def op9_line_dedup(docs: DataFrame) -> DataFrame:
    """Per document: the number of its lines, and how many and which are removed."""
    out = dedup_lines(docs.select("doc_id", "text", F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n", -1))).alias("n_lines")), removed="gone")
    return out.select("doc_id", "n_lines", F.size("gone").alias("n_removed"), F.array_join(F.col("gone").cast("array<string>"), ",").alias("removed"))


#: The same join with exact counts as rarity, the prefix filter alone, and all lines at once.
OP9_SQL = r"""
WITH line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
tok AS (SELECT doc_id, pos, list_sort(list_distinct(list_filter(string_split_regex(lower(line), '\s+'), lambda w: w <> ''))) AS words FROM line),
class AS (SELECT words, len(words) AS n, min((doc_id, pos)) AS place FROM tok WHERE len(words) > 0 GROUP BY words),
word AS (SELECT place, n, unnest(words) AS w FROM class),
df AS (SELECT w, count(*) AS c FROM word GROUP BY w),
ranked AS (SELECT place, n, word.w, row_number() OVER (PARTITION BY place ORDER BY c, word.w) AS i FROM word JOIN df ON word.w = df.w),
prefix AS (SELECT place, n, w FROM ranked WHERE i <= n - CAST(ceil(0.8 * n - 1e-9) AS INT) + 1),
pair AS (SELECT DISTINCT x.place AS late, y.place AS early FROM prefix x JOIN prefix y ON x.w = y.w AND y.place < x.place AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1e-9),
gone AS (SELECT DISTINCT late FROM pair JOIN class a ON a.place = late JOIN class b ON b.place = early
  WHERE len(list_intersect(a.words, b.words)) >= 0.8 * (a.n + b.n - len(list_intersect(a.words, b.words))) - 1e-9),
verdict AS (SELECT tok.doc_id, tok.pos, late IS NOT NULL OR class.place <> (tok.doc_id, tok.pos) AS out FROM tok JOIN class ON tok.words = class.words LEFT JOIN gone ON late = class.place),
kept AS (SELECT line.doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(out, false)) AS n_removed,
  coalesce(string_agg(CAST(line.pos AS VARCHAR), ',' ORDER BY line.pos) FILTER (coalesce(out, false)), '') AS removed
  FROM line LEFT JOIN verdict ON line.doc_id = verdict.doc_id AND line.pos = verdict.pos GROUP BY line.doc_id)
SELECT doc_id, CAST(n_lines AS INT) AS n_lines, CAST(coalesce(n_removed, 0) AS INT) AS n_removed, coalesce(removed, '') AS removed
FROM documents LEFT JOIN kept USING (doc_id)
"""
