import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siftspark.llm import tokenfile


@pytest.mark.parametrize("n,size", [(0, 10), (1, 1), (1, 50257), (5000, 3), (4096 * 3 + 7, 1000), (4096, 50257), (9000, 200_000)])
def test_round_trip(n, size):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n) - 1, size - 1).astype(np.int32)
    ids[n // 2 :] = ids[: n - n // 2]
    data = tokenfile.encode_ids(ids, size)
    assert np.array_equal(tokenfile.decode_ids(data, size), ids)


def test_it_compresses_and_finds_damage():
    ids = np.tile(np.arange(50, dtype=np.int32), 300)
    data = tokenfile.encode_ids(ids, 50257)
    assert len(data) < len(ids)
    bad = bytearray(data)
    bad[40] ^= 1
    with pytest.raises(ValueError):
        tokenfile.decode_ids(bytes(bad), 50257)
    with pytest.raises(ValueError):
        tokenfile.decode_ids(data[5:], 50257)
    # blocks stand alone
    second = data.index(tokenfile.MAGIC, 4)
    assert np.array_equal(tokenfile.decode_ids(data[second:], 50257), ids[tokenfile.BLOCK :])


def plain(texts):
    t = Tokenizer.from_file(tokenfile.default_tokenizer())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 0] for x in texts]


def check(rows, got):
    want = plain([t for _, t in rows])
    start = 0
    for (i, _), w in zip(rows, want):
        assert got[i] == (start, len(w), zlib.crc32(np.array(w, "<u4").tobytes()))
        start += len(w)


def test_pieces_are_the_librarys():
    words = tokenfile.Words(tokenfile.default_tokenizer(), kept=50)
    rng = np.random.default_rng(5)
    bits = [" ", " ", " ", "\n", "\t", "  ", "a", "Don't", "é", "中", "12", "!", ".", "\u00a0", "\x1c", "\u3000", "'s", "<|endoftext|>", "\r\n", "word", "x" * 40]
    texts = ["".join(rng.choice(bits, rng.integers(0, 30))) for _ in range(3000)]
    texts += ["a b", "a\nb", "a\n\nb", "a\n", "\n", " ", "\na", "a \nb", "a\n b", "a <|endoftext|> b"]
    for k in range(0, len(texts), 300):
        part = texts[k : k + 300]
        flat, n = words.encode(part)
        assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == plain(part)


def test_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    check(rows, {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.op8_token_files(docs).collect()})


def test_edges(spark, tmp_path):
    texts = [None, "", " ", "<|endoftext|> a  b\n\n c\t", "don't  x's é中\U0001f600 12345 !!?", "word " * 30000, "▁ \x00", "   lead", "trail   "]
    rows = [(k - 3, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, start int, part int").repartition(4)
    check(rows, {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in tokenfile.op8_token_files(df).collect()})
    twice = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b c")], "doc_id long, text string")
    tokenfile.write_tokens(twice, str(tmp_path / "t"))
    back = tokenfile.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [(r.doc, r.start, list(r.ids)) for r in back] == [(None, 0, plain(["b c"])[0]), (1, 3, plain(["a"])[0]), (1, 5, plain(["a"])[0])]
    assert tokenfile.op8_token_files(df.limit(0)).count() == 0
