"""Cross-tokenizer alignment against a loop over bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siftspark.llm import align as A


def texts():
    pick = random.Random(3)
    words = ["the", "Straße", "naïve", "日本語", "aaaa", "😀", "<|endoftext|>", "<s>", "<0x41>", "Don't", "1234567", "▁", "x" * 40, " ", "é"]
    made = [None, "", " ", "  ", "\n", "a", "▁a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "😀" * 50, "日本語" * 30, "tab\tand  two\n\nlines ", "\x00\x01\x7f", "<unk>", "\r\n\r\n"]
    for _ in range(120):
        made.append("".join(pick.choice(words) + pick.choice([" ", "", " ", "\n", "  ", ", "]) for _ in range(pick.randrange(60))))
    return [*made, made[-1], made[20]]


def plain(all_texts):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = {c: k for k, c in enumerate(sorted(range(256), key=lambda x: not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174)))}
    order = [x for x in range(256) if 33 <= x <= 126 or 161 <= x <= 172 or x >= 174]
    back = {chr(x): x for x in order} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in set(order))}
    assert len(shown) == len(back) == 256
    out, links = [], []
    for text in all_texts:
        groups = []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
            bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                start = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    groups.append(([i for i, e in zip(ids_a, ends_a, strict=True) if start < e <= cut], [i for i, e in zip(ids_b, ends_b, strict=True) if start < e <= cut]))
                    start = cut
        out.append(groups)
        links.append(Counter((x, y) for g in groups for x in g[0] for y in g[1]))
    count = Counter(p for one in links for p in one)
    top = {}
    for (x, _), c in count.items():
        top[x] = max(top.get(x, 0), c)
    rows = []
    for groups, one in zip(out, links, strict=True):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(one.values()), sum(n for p, n in one.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in one.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return rows, out, count


@pytest.mark.parametrize("work", [1, 2, 3, 7, 256])
def test_merge_path(work):
    pick = np.random.default_rng(work)
    for _ in range(60):
        size = int(pick.integers(1, 400))
        a, b = (np.unique(np.append(pick.integers(1, size + 1, int(pick.integers(0, size))), size)) for _ in range(2))
        of_a, of_b = A.groups_of(a, b, work)
        cuts = np.intersect1d(a, b)
        assert of_a.tolist() == np.searchsorted(cuts, a).tolist() and of_b.tolist() == np.searchsorted(cuts, b).tolist()


def test_large_groups():
    pick = np.random.default_rng(1)
    in_a, in_b = pick.integers(1, 9, 50), pick.integers(1, 9, 50)
    a, b = pick.integers(0, 5, in_a.sum()), pick.integers(0, 5, in_b.sum())

    def table(plain):
        out = Counter()
        for k, g, n in zip(*A._links(a, b, in_a, in_b, 10, plain), strict=True):
            out[int(g), int(k)] += int(n)
        return out

    assert table(1) == table(10) == table(1000)


def test_brute_force(spark):
    made = texts()
    docs = spark.createDataFrame([(k if k != 5 else None, t, "x", 1) for k, t in enumerate(made)], "doc_id long, text string, chunk string, a int").repartition(7)
    want, groups, count = plain(made)
    alignment = A.align(docs, chunk=60)
    assert alignment.count() > 3
    columns = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    got = {r.id if r.id is not None else 5: tuple(r[c] for c in columns) for r in A.summaries(alignment).collect()}
    assert len(got) == len(made)
    for k, row in enumerate(want):
        assert got[k] == row, made[k]
    real = {r.id if r.id is not None else 5: [(g.a, g.b) for g in r.groups] for r in A.groups(alignment).collect()}
    assert all(real[k] == g for k, g in enumerate(groups))
    assert {(r.a, r.b): r.documents for r in A.pair_counts(alignment).collect()} == dict(count)


def test_long_and_empty(spark):
    text = "Don't stop 日本 " * 60_000
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in A.op13_token_alignment(docs).collect()}
    (short,), _, _ = plain([text[: len(text) // 200]])
    assert [(n - 1) * 200 + 1 for n in short[:3]] == [got[1].n_a, got[1].n_b, got[1].n_groups] and got[1].n_links >= got[1].n_groups
    assert tuple(got[2])[1:] == (0, 0, 0, 0, 0, 0, "")
    none = A.op13_token_alignment(docs.limit(0))
    assert none.count() == 0 and none.columns[0] == "doc_id"


def test_chunk_needs_little_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    pick = random.Random(5)
    words = ["".join(pick.choice("abcdefghij") for _ in range(12)) for _ in range(5000)]
    made = [" ".join(pick.choice(words) for _ in range(400)) for _ in range(1000)]
    units = A.Units(A.default_tokenizer(), A.default_pieces())
    cut = units.cut(made)
    tracemalloc.start()
    one = A._chunk(0, pa.array(range(len(made))), cut, units)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # pairs of all texts at once would need more
    assert peak < 60e6, peak
    monkeypatch.setattr(A, "_SPAN", 1)
    other = A._chunk(0, pa.array(range(len(made))), cut, units)
    assert one == other
    # what a worker knows stays until the counts are looked up
    A._AT_HAND["a", "b"] = units
    A._forget()
    assert not A._AT_HAND
