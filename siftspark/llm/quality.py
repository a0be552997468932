"""Quality rules as a ledger: measurements and one bit for each rule that a text fails.

Every text is read once. What was measured and the bits stay in the ledger, so
a policy (a version and the rules it asks for) is a bitwise "and" over longs,
and its ablations are counts of bit patterns: neither reads a text again.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.session import small_batches

#: Measurements of a text, in the order of :func:`measure`.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs")
_KIND = "struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">"
_SYMBOLS, _BLANKS = "#*$%&|<>", " \t\n\x0b\x0c\r"
#: Words whose windows are counted at a time.
_WORDS = 1_000_000

#: Rules by bit: the name and when a text fails. A bit is never given to another rule, so old ledgers stay readable.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("many_symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    ("upper_case", "2 * n_upper > word_chars"),
    ("exclamations", "2 * n_bangs > n_words"),
]


@dataclass(frozen=True)
class Policy:
    """A version, the rules that count, and how many of them a kept text may fail."""

    version: str
    rules: tuple[str, ...]
    allowed: int = 0

    @property
    def mask(self) -> int:
        names = [name for name, _ in RULES]
        return sum(1 << names.index(r) for r in set(self.rules))


BASE = Policy("base", ("few_words", "repeated_words"))
DEFAULT = Policy("v1", tuple(name for name, _ in RULES))


def _upper(text: str) -> int:
    """Characters that lower-casing changes."""
    low = text.lower()
    if len(low) != len(text):
        return sum(c != c.lower() for c in text)
    if text.isascii():
        return int((np.frombuffer(text.encode(), np.uint8) != np.frombuffer(low.encode(), np.uint8)).sum())
    return int((np.frombuffer(text.encode("utf-32-le"), np.uint32) != np.frombuffer(low.encode("utf-32-le"), np.uint32)).sum())


def _repeated(texts: list[list[bytes]]) -> np.ndarray:
    """For each text, words inside three-word windows that it holds twice or more."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    word = pd.factorize(np.array([w for t in texts for w in t], object))[0].astype(np.int64)
    if len(word) < 3:
        return np.zeros(len(texts), np.int64)
    of = np.repeat(np.arange(len(texts)), n)
    at = np.flatnonzero(of[2:] == of[:-2])
    # numbers of pairs, of windows, and of windows within their texts
    pair = pd.factorize(word[at] * len(word) + word[at + 1])[0].astype(np.int64)
    window = pd.factorize(pair * len(word) + word[at + 2])[0].astype(np.int64)
    window = pd.factorize(of[at] * len(word) + window)[0]
    again = at[np.bincount(window, minlength=1)[window] > 1]
    inside = np.zeros(len(word), bool)
    for k in range(3):
        inside[again + k] = True
    return np.bincount(of[inside], minlength=len(texts))


def _measured(texts: list[str]) -> pd.DataFrame:
    rows, repeated, split, held = [], [], [], 0
    for t in texts:
        words = t.encode().split()  # bytes: white space is the six ASCII blanks
        lines = [line for line in t.split("\n") if line.strip(_BLANKS)]
        rows.append((len(words), len(t) - sum(map(t.count, _BLANKS)), sum(map(t.count, _SYMBOLS)), len(lines), len(lines) - len(set(lines)), _upper(t), t.count("!")))
        split.append(words)
        held += len(words)
        if held > _WORDS:
            repeated.append(_repeated(split))
            split, held = [], 0
    repeated.append(_repeated(split))
    out = pd.DataFrame(rows, columns=[m for m in MEASURES if m != "n_repeat_words"], dtype="int64")
    out["n_repeat_words"] = np.concatenate(repeated)
    return out[list(MEASURES)]


def measure(df: DataFrame, text: str = "text") -> Column:
    """A struct of :data:`MEASURES` for each text (null: empty)."""
    small_batches(df.sparkSession)
    return F.pandas_udf(lambda s: _measured(s.fillna("").tolist()), _KIND)(F.col(text))


def ledger(df: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """Add the struct ``out``: :data:`MEASURES` and ``failed``, bit k set if rule k fails.

    Nothing is shuffled. A null or empty text measures zero and fails
    ``few_words``; a text of any length is measured whole. Other columns are
    untouched, whatever their names; one named ``out`` is replaced.
    """
    df = df.withColumn(out, measure(df, text))
    fields = F.col(out)
    bits = F.lit(0).cast("long")
    for k, (_, test) in enumerate(RULES):
        bits = bits.bitwiseOR(F.shiftleft(F.expr(_within(test, out)).cast("long"), k))
    return df.withColumn(out, fields.withField("failed", bits))


def _within(test: str, out: str) -> str:
    return " ".join(f"`{out}`.{w}" if w in MEASURES else w for w in test.split(" "))


def keeps(policy: Policy, failed: Column) -> Column:
    """Whether the policy keeps a text with these bits."""
    return F.bit_count(failed.bitwiseAND(F.lit(policy.mask))) <= policy.allowed


def apply(df: DataFrame, *policies: Policy, quality: str = "quality") -> DataFrame:
    """Add ``kept_<version>`` for each policy; only the ledger is read."""
    return df.withColumns({f"kept_{p.version}": keeps(p, F.col(f"{quality}.failed")) for p in policies})


def ablations(df: DataFrame, policy: Policy, by: tuple[str, ...] = (), quality: str = "quality") -> DataFrame:
    """What each rule of the policy does: ``(*by, rule, n, n_kept, n_failed, n_alone, n_kept_without)``.

    ``n_alone``: texts that this rule decides, which the policy would keep
    without it. Rows are first counted by bit pattern, of which there are at
    most 2 to the power of the rules in each group, so what is exploded does
    not grow with the table. A group without rows has no row.
    """
    bits = F.col(f"{quality}.failed").bitwiseAND(F.lit(policy.mask))
    patterns = df.groupBy(*by, bits.alias("__bits")).agg(F.count(F.lit(1)).alias("__n"))
    rules = F.array(*[F.struct(F.lit(1 << k).cast("long").alias("bit"), F.lit(name).alias("rule")) for k, (name, _) in enumerate(RULES) if name in policy.rules])
    each = patterns.select(*by, "__bits", "__n", F.explode(rules).alias("__r"))
    has = F.col("__bits").bitwiseAND(F.col("__r.bit")) != 0
    kept, without = F.bit_count("__bits") <= policy.allowed, F.bit_count("__bits") - has.cast("int") <= policy.allowed
    count = lambda when: F.coalesce(F.sum(F.when(when, F.col("__n"))), F.lit(0))
    out = each.groupBy(*by, F.col("__r.rule").alias("rule")).agg(
        F.sum("__n").alias("n"), count(kept).alias("n_kept"), count(has).alias("n_failed"), count(without & ~kept).alias("n_alone"), count(without).alias("n_kept_without")
    )
    return out


def filter_quality(df: DataFrame, policy: Policy = DEFAULT, text: str = "text") -> DataFrame:
    """The rows that the policy keeps, with all their columns."""
    name = "quality"
    while name in df.columns:
        name = "_" + name
    rows = ledger(df, text, name)
    return rows.where(keeps(policy, F.col(f"{name}.failed"))).drop(name)


def op12_quality_rules(docs: DataFrame) -> DataFrame:
    """Measurements, failure bits, the base rules' verdict and that of :data:`DEFAULT` for every document."""
    rows = ledger(docs.select("doc_id", "text")).drop("text")
    failed = F.col("quality.failed")
    base = ~keeps(BASE, failed)
    return rows.select("doc_id", *[F.col(f"quality.{m}") for m in MEASURES], failed.alias("failed_rules"), F.lit(DEFAULT.version).alias("policy"), base.alias("base_failed"), (~base & keeps(DEFAULT, failed)).alias("kept"))


OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
w AS (SELECT k, unnest(words) AS w, generate_subscripts(words, 1) AS p FROM (SELECT k, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t)),
windows AS (SELECT k, p, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY k ORDER BY p)),
again AS (SELECT k, p FROM windows WHERE w3 IS NOT NULL QUALIFY count(*) OVER (PARTITION BY k, w, w2, w3) > 1),
repeated AS (SELECT k, count(DISTINCT p + d) AS n_repeat_words FROM again, (VALUES (0), (1), (2)) v(d) GROUP BY k),
counted AS (SELECT k, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY k),
lines AS (SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
m AS (SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  len(list_filter(string_split(text, ''), lambda c: c <> lower(c)))::BIGINT AS n_upper, length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_bangs
  FROM t LEFT JOIN counted USING (k) LEFT JOIN lines USING (k) LEFT JOIN repeated USING (k)),
f AS (SELECT *, n_words < 50 AS r0, 100 * n_repeat_words > 50 * n_words AS r1, 10 * n_symbols > n_words AS r2, 2 * n_dup_lines > n_lines AS r3,
  word_chars < 2 * n_words OR word_chars > 20 * n_words AS r4, 2 * n_upper > word_chars AS r5, 2 * n_bangs > n_words AS r6 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_bangs,
  (r0::INT + 2 * r1::INT + 4 * r2::INT + 8 * r3::INT + 16 * r4::INT + 32 * r5::INT + 64 * r6::INT)::BIGINT AS failed_rules, 'v1' AS policy,
  r0 OR r1 AS base_failed, NOT (r0 OR r1 OR r2 OR r3 OR r4 OR r5 OR r6) AS kept FROM f"""
