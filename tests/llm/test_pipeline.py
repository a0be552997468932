"""The pipeline against plain Python on the smallest tables."""

import corpus_pipeline
from siftspark.llm import simhash
from tests.llm.test_decontamination import plain as leaked
from tests.llm.test_line_dedup import plain as line_matches


def test_run(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "text", "lang", "source", "n_chars", "piece_ids", "lossless"} == set(out.columns)
    rows = out.collect()
    got = {r.doc_id: r.text for r in rows}
    assert len(got) == len(rows) and all(r.lossless and r.n_chars == len(r.text) for r in rows)
    # language ID rejects what has no letter
    docs = [(i, x) for i, x in docs if x and any(map(str.isalpha, x))]
    gone = line_matches(docs)
    kept = []
    for i, x in docs:
        out_ = set(gone.get((i, x), ()))
        new = "\n".join(line for k, line in enumerate(x.split("\n")) if k not in out_)
        if new.strip() or not out_:
            kept.append((i, new))
    # sets of five-word shingles with a Jaccard similarity of 0.8 or more
    sets = [set(simhash.shingle_hashes(x, 5).tolist()) for _, x in kept]
    root = list(range(len(kept)))
    for a in range(len(kept)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                x, y = root[a], root[b]
                root = [min(x, y) if r in (x, y) else r for r in root]
    best = {}
    for k, (i, _) in enumerate(kept):
        best[root[k]] = min(best.get(root[k], i), i)
    kept = [(i, x) for i, x in kept if i in set(best.values())]
    bad = {i for i, _ in leaked(kept, items)}
    assert got == {i: x for i, x in kept if i not in bad}


def test_stages(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    docs = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (2, "1 2 3", "en", "s", 5), (3, "one clean line of text", "en", "s", 22), (3, "one clean line of text", "en", "s", 22)], "doc_id long, text string, lang string, source string, n_chars long")
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() >= 1
        if name != "sentencepiece":
            assert out.columns == docs.columns
        assert stage(spark, empty, sf_dir).count() == 0
