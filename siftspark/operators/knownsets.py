"""Known-good and known-bad sets: keys, Bloom filters as word tables, and the gate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse_sha256(c: Column) -> Column:
    """64 hex digits as 32 bytes, else null."""
    t = F.trim(c)
    return F.when(t.rlike("^[0-9A-Fa-f]{64}$"), F.unhex(t))


def norm_purl(c: Column) -> Column:
    """Lower-cased type, no qualifiers or subpath; null unless ``pkg:type/name``."""
    bare = F.regexp_replace(F.trim(c), r"[?#].*$", "")
    ok = bare.rlike(r"^(?i)pkg:[a-z0-9.+-]+/.+")
    kind = F.lower(F.regexp_extract(bare, r"^([^/]+)/", 1))
    return F.when(ok, F.concat(kind, F.lit("/"), F.regexp_extract(bare, r"^[^/]+/(.+)$", 1)))


def key_sets(pool: DataFrame) -> DataFrame:
    """Distinct keys ``(kind, key, label)``; a key that cannot be read gives none."""
    sha = F.lower(F.hex(parse_sha256(F.col("sha256"))))
    both = F.array(F.struct(F.lit("sha256").alias("kind"), sha.alias("key")), F.struct(F.lit("purl").alias("kind"), norm_purl(F.col("purl")).alias("key")))
    return pool.where(F.col("label").isin("good", "bad")).select("label", F.inline(both)).where("key is not null").distinct()


def subtract(keys: DataFrame) -> DataFrame:
    """Good keys that are not bad, and all bad keys."""
    bad = keys.where("label = 'bad'")
    good = keys.where("label = 'good'").join(bad.select("kind", "key"), ["kind", "key"], "left_anti")
    return good.select("kind", "key", "label").unionByName(bad.select("kind", "key", "label"))


def bloom_params(n: int, p: float = 1e-9) -> tuple[int, int]:
    """(hashes, bits): bits a power of two of at least 64, hashes 1 to 64; a bad ``p`` is 1e-9."""
    p = p if 0 < p < 1 else 1e-9
    bits = 64
    while bits < -n * math.log(p) / math.log(2) ** 2:
        bits *= 2
    return min(64, max(1, round(bits / max(1, n) * math.log(2)))), bits


def bit_indices(key: Column, hashes: int, bits: int, seed: int = 0) -> Column:
    """Bits of a key from the two first little-endian lanes of its SHA-256, masked before arithmetic so that nothing overflows."""
    digest = F.sha2(key, 256)

    def lane(at: int) -> Column:
        # only the low bits count: the first bytes, reversed
        hexed = F.concat(*[F.substring(digest, at * 16 + 1 + 2 * b, 2) for b in reversed(range(-(-bits.bit_length() // 8)))])
        return F.conv(hexed, 16, 10).cast("long").bitwiseAND(F.lit(bits - 1).cast("long"))

    if bits > 1 << 54:
        raise ValueError("a filter has at most 2**54 bits")
    h1, h2 = lane(0).bitwiseXOR(F.lit(seed & (bits - 1)).cast("long")), lane(1).bitwiseOR(F.lit(1).cast("long"))
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (h1 + i * h2).bitwiseAND(F.lit(bits - 1).cast("long")))


def bloom_build(keys: DataFrame, hashes: int, bits: int, key: str = "key") -> DataFrame:
    """``(word, bits)``: set bits by 64-bit word. Partial ORs merge; no task holds the set."""
    at = keys.select(F.explode(bit_indices(F.col(key), hashes, bits)).alias("b"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))
    return at.groupBy(F.expr("b div 64").alias("word")).agg(F.bit_or(one).alias("bits"))


def might_contain(rows: DataFrame, filter_: DataFrame, hashes: int, bits: int, key: str = "key", out: str = "maybe") -> DataFrame:
    """Add ``out``: false is certain. One row for each distinct key is asked."""
    at = rows.select(key).distinct().select(key, F.explode(bit_indices(F.col(key), hashes, bits)).alias("b")).withColumn("word", F.expr("b div 64"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))
    hit = F.coalesce(F.col("bits").bitwiseAND(one) != 0, F.lit(False))
    asked = at.join(filter_, "word", "left").groupBy(key).agg(F.bool_and(hit).alias(out))
    return rows.join(asked, key, "left")


def decide(rows: DataFrame, keys: DataFrame, key: str = "key", bad_loaded: bool = True) -> DataFrame:
    """conflicted, known_bad, skip or unknown for each row."""
    side = lambda label: keys.where(F.col("label") == label).select("key").distinct().withColumn(label, F.lit(True))
    good, bad = (side(x).withColumnRenamed("key", key) for x in ("good", "bad"))
    said = rows.join(good, key, "left").join(bad, key, "left")
    decision = F.when(F.col("bad") & F.col("good"), "conflicted").when(F.col("bad"), "known_bad").when(F.col("good") & F.lit(bad_loaded), "skip").otherwise("unknown")
    return said.withColumn("decision", decision).drop("good", "bad")


def gate(decided: DataFrame, mode: str = "balanced", touched: str | None = None, now: Column | None = None) -> DataFrame:
    """Add ``scan``: fast leaves unknown ones, balanced skips known-good ones unless touched within 48 hours, slow scans all."""
    if mode not in ("fast", "balanced", "slow"):
        raise ValueError(mode)
    fresh = F.coalesce(F.col(touched) >= now - F.expr("INTERVAL 48 HOURS"), F.lit(False)) if touched else F.lit(False)
    skip = (F.col("decision") == "skip") & ~fresh
    scan = F.lit(True) if mode == "slow" else ~skip if mode == "balanced" else ~skip & (F.col("decision") != "unknown")
    return decided.withColumn("scan", scan)


def tally(gated: DataFrame) -> DataFrame:
    d = F.col("decision")
    return gated.agg(F.count_if((d == "skip") & ~F.col("scan")).alias("skipped"), F.count_if(d == "known_bad").alias("flagged"), F.count_if(d == "conflicted").alias("conflicted"), F.count_if((d == "unknown") & ~F.col("scan")).alias("unscanned"))


def verify_build(now: DataFrame, previous: DataFrame, least: int = 1000) -> DataFrame:
    """Filters ``(kind, label, n)`` that collapsed to nothing, shrank below half, or grew beyond three times."""
    rows = previous.withColumnRenamed("n", "was").join(now, ["kind", "label"], "left").na.fill(0, ["n"])
    why = F.when(F.col("n") == 0, "empty").when(F.col("n") < 0.5 * F.col("was"), "shrunk").when(F.col("n") > 3 * F.col("was"), "grown")
    return rows.where(F.col("was") >= least).withColumn("why", why).where("why is not null").select("kind", "label", "was", "n", "why")


def edge_known(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Verdict of each edge ``(sha256, purl)`` by either key: conflicted > known_bad > skip > unknown."""
    by_sha = decide(edges, keys.where("kind = 'sha256'").select(F.col("key"), "label"), "sha256").withColumnRenamed("decision", "__s")
    both = decide(by_sha, keys.where("kind = 'purl'").select(F.col("key"), "label"), "purl").withColumnRenamed("decision", "__p")
    has = lambda d: (F.col("__s") == d) | (F.col("__p") == d)
    return both.withColumn("known", F.when(has("conflicted"), "conflicted").when(has("known_bad"), "known_bad").when(has("skip"), "skip").otherwise("unknown")).drop("__s", "__p")


def rule_count(filters: DataFrame) -> DataFrame:
    """Keys in all loaded filters ``(kind, label, n)``."""
    return filters.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rules"))


def unsafe_keys(keys: DataFrame, canaries: DataFrame, vouched: DataFrame) -> DataFrame:
    """Keys that must not be where they are: canaries ``(key, label)`` in a tier that is forbidden to them, vouched digests ``(key)`` among the bad."""
    caught = keys.join(canaries, ["key", "label"], "left_semi").withColumn("why", F.lit("canary"))
    return caught.unionByName(keys.where("label = 'bad'").join(vouched, "key", "left_semi").withColumn("why", F.lit("vouched"))).select("kind", "key", "label", "why")
