import zlib

import numpy as np
import pytest

from siftspark.llm import sharding


def plain(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 40, 41, 1000])
def test_jump_is_plain(n):
    keys = np.random.default_rng(n).integers(0, 2**64, 500, dtype=np.uint64)
    assert sharding.jump(keys, n).tolist() == [plain(int(k), n) for k in keys]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sharding.op5_sharding(docs).collect()
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(got) == len(text)
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert 0 <= r["shard"] < 40 and r.grown_shard in (r["shard"], 40)
    for s in range(40):
        mine = sorted(r.slot for r in got if r["shard"] == s)
        assert mine == list(range(len(mine)))


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "x", "b"), (2, "é", "c")], "doc_id long, text string, __part string")
    got = sharding.op5_sharding(df.drop("__part")).collect()
    assert sorted((r.size, r.law) for r in got) == [(16, "key"), (16, "key"), (17, "key"), (18, "key")]
    assert sharding.op5_sharding(df.limit(0)).count() == 0
    parts = sharding.with_slots(sharding.assign(spark.range(1000).withColumnRenamed("id", "doc_id"), 3), 3, rows_per_part=20)
    for s in range(3):
        mine = sorted(r.slot for r in parts.where(f"shard = {s}").collect())
        assert mine == list(range(len(mine)))
    with pytest.raises(ValueError):
        sharding.assign(df, 0)


def test_write(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "doc_id")
    sharding.write_shards(df, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and {r[0] for r in back.select("shard").distinct().collect()} <= set(range(5))
