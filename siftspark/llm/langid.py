"""Language ID: multinomial naive Bayes over hashed character n-grams.

Fitting is one pass that counts hashed n-grams per language in each task and
adds the counts up in Spark; the counts that reach the driver are one row for
each (language, bucket), at most ``max_langs * 2**bits`` of them whatever the
input. The log-probability matrix of that size is broadcast; scoring is a
sparse gather and sum over a document's n-grams in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "und"
#: Characters that are hashed at a time.
_SLICE = 1 << 18


@dataclass(frozen=True)
class Model:
    """Languages in sorted order and their log-probabilities, (2**bits, languages)."""

    langs: tuple[str, ...]
    logp: np.ndarray
    prior: np.ndarray
    orders: tuple[int, ...]
    bits: int


def ngram_buckets(text: str, orders: tuple[int, ...], bits: int) -> Iterator[np.ndarray]:
    """Buckets of all character n-grams of the lower-cased text, a slice at a time.

    White space, digits and punctuation all count as one separator, so that
    the letters of words and their edges are what is counted.
    """
    most, low = max(orders), text.lower()
    seam, word = np.empty(0, np.uint64), True
    for at in range(0, len(low), _SLICE):
        part = np.frombuffer(low[at : at + _SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = (part >= 0xAA) | ((part >= 97) & (part <= 122))
        runs = letter | np.concatenate(([word], letter[:-1]))
        word = bool(letter[-1])
        new = np.where(letter, part, 32)[runs].astype(np.uint64)
        part = np.concatenate((seam, new))
        for n in orders:
            # those that end in this slice
            mine = part[max(0, len(seam) - n + 1) :]
            m = len(mine) - n + 1
            if m < 1:
                continue
            h = np.full(m, n, np.uint64)
            for k in range(n):
                h = (h ^ mine[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)
        seam = part[len(part) - most + 1 :] if most > 1 and len(part) >= most else part[: len(part) * (most > 1)]


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", orders: tuple[int, ...] = (1, 2, 3), bits: int = 14, alpha: float = 0.5, max_langs: int = 256) -> Model:
    """Learn from every row with a non-null text and language.

    Null texts or languages teach nothing; an empty table gives a model
    without languages. More than ``max_langs`` languages is an error, for
    they bound what reaches the driver and what is broadcast.
    """
    seen = [r[0] for r in rows.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang).distinct().limit(max_langs + 1).collect()]
    if len(seen) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    langs = sorted(seen)
    at = {x: k for k, x in enumerate(langs)}
    size = 1 << bits

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, docs = np.zeros((len(langs), size), np.int64), np.zeros(len(langs), np.int64)
        for df in batches:
            for x, y in zip(df["lang"], df["text"], strict=True):
                docs[at[x]] += 1
                for b in ngram_buckets(y, orders, bits):
                    total[at[x]] += np.bincount(b, minlength=size)
        i, j = np.nonzero(total)
        yield pd.DataFrame({"l": i, "b": j, "n": total[i, j]})
        yield pd.DataFrame({"l": np.arange(len(langs)), "b": -1, "n": docs})

    counts = np.zeros((len(langs), size))
    prior = np.zeros(len(langs))
    if langs:
        known = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
        got = known.mapInPandas(count, "l long, b long, n long").groupBy("l", "b").agg(F.sum("n").alias("n")).toPandas()
        inside = got["b"] >= 0
        counts[got["l"][inside], got["b"][inside]] = got["n"][inside]
        prior[got["l"][~inside]] = got["n"][~inside]
    logp = np.log((counts + alpha) / (counts + alpha).sum(1, keepdims=True)).T.astype(np.float32)
    return Model(tuple(langs), np.ascontiguousarray(logp), np.log((prior + 1) / (prior + 1).sum()) if langs else prior, orders, bits)


def _score(model: Model, text: str | None) -> tuple[str, float, float]:
    """Language, posterior, and by how much an n-gram is likelier, on average and in logarithms, than if all buckets were alike."""
    if not text or not model.langs or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0
    total, n = np.zeros(len(model.langs)), 0
    for b in ngram_buckets(text, model.orders, model.bits):
        n += len(b)
        for at in range(0, len(b), 1 << 16):
            total += model.logp[b[at : at + (1 << 16)]].sum(0, dtype=np.float64)
    fit = total / max(n, 1) + model.bits * np.log(2)
    total = total + model.prior
    best = int(total.argmax())
    return model.langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum()), float(fit[best])


def predict(df: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (or the given names), the posterior of the predicted language (0 to 1).

    ``und`` and 0.0 for a text that is null, empty or without a letter, and
    for a model without languages; ties go to the first language by name. A
    text of any length counts whole. Only ``text`` is read; columns of these
    two names are replaced.
    """
    return _said(df, model, text).withColumns({lang_out: F.col(f"{_SAID}.lang_pred"), score_out: F.col(f"{_SAID}.score")}).drop(_SAID)


#: Name of a column that no table has.
_SAID = "__langid_said"


def _said(df: DataFrame, model: Model, text: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)

    def of(texts: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame([_score(m, x) for x in texts], columns=["lang_pred", "score", "fit"])

    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("fit", T.DoubleType())])
    return df.withColumn(_SAID, F.pandas_udf(of, kind)(F.col(text)))


def keep_known(df: DataFrame, model: Model, text: str = "text", min_fit: float = -1.0) -> DataFrame:
    """Rows in a language of the model; the columns of ``df``.

    The posterior says which language is likeliest and not whether it is one of
    them. So a text goes whose n-grams are on average less likely in its best
    language, by a factor of e (``min_fit``, in natural logarithms), than if all
    buckets were alike: that of a script never seen. Texts that are null, empty
    or without a letter go as well.
    """
    said = _said(df, model, text)
    return said.where((F.col(f"{_SAID}.lang_pred") != UNKNOWN) & (F.col(f"{_SAID}.fit") > min_fit)).drop(_SAID)


def held_out(id_col: str = "doc_id", fold: int = 1, folds: int = 3):
    """crc32 of the id as text, modulo ``folds``, equals ``fold``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def op3_language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document; learnt from the folds that are not held out."""
    docs = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    model = fit(docs.where("not held_out"))
    return predict(docs, model).select("doc_id", "held_out", "lang_pred", "score")
