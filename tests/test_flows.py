"""Flows that keep state or walk graphs, against plain loops."""

import datetime
import hashlib
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from siftspark.operators import audits, findings, refs
from siftspark.sources import reports
from siftspark.streaming import monitor


def loop_matches(claims, results):
    open_, out = {}, set()
    for at, kind, sha, i in sorted([(t, 0, s, i) for s, i, t in claims] + [(t, 1, s, i) for s, i, t in results], key=lambda e: (e[0], e[1], e[3])):
        if kind == 0:
            open_.setdefault(sha, []).append(i)
        elif open_.get(sha):
            out.add((sha, open_[sha].pop(0), i))
    return out


def test_results_go_to_the_first_open_claim(spark):
    pick = random.Random(8)
    claims = [(f"s{pick.randrange(4) if k % 3 else 0}", k, pick.randrange(120)) for k in range(300)]
    done = [(f"s{pick.randrange(5) if k % 3 else 0}", k, pick.randrange(120)) for k in range(300)]
    a, b = spark.createDataFrame(claims, "sha string, id long, claimed long"), spark.createDataFrame(done, "sha string, id long, resulted long")
    got = {(r.sha, r.claim_id, r.result_id) for r in audits.match_open(a, b).collect()}
    assert got == loop_matches(claims, done) and 100 < len(got) < 300
    early = audits.match_open(spark.createDataFrame([("x", 1, 5)], a.schema), spark.createDataFrame([("x", 1, 4), ("x", 2, 6)], b.schema)).collect()
    assert [(r.claim_id, r.result_id) for r in early] == [(1, 2)]
    assert audits.match_open(a.limit(0), b).count() == 0


def key_of(v):
    return [int(p) for p in v.split(".")]


def loop_closure(roots, catalog, members, found, depth):
    out = []
    for report in sorted({r[0] for r in roots}):
        work, seen, newest = [(src, loc, (loc,)) for rep, src, loc in roots if rep == report], set(), {}
        for hop in range(depth):
            best = {}
            for src, loc, path in work:
                best[loc] = min(best.get(loc, (path, src)), (path, src))
            for loc in best:
                if "@" in loc:
                    p, v = loc.split("@")
                    newest[p] = max(newest.get(p, v), v, key=key_of)
            work = []
            for loc, (path, src) in best.items():
                if loc in seen or ("@" in loc and key_of(loc.split("@")[1]) < key_of(newest[loc.split("@")[0]])):
                    continue
                seen.add(loc)
                outcome, payload = catalog.get(loc, (None, None))
                out.append((report, loc, hop, src, payload, outcome, list(path)))
                if outcome in ("ok", "pin_mismatch") and payload is not None:
                    for f in {payload, *members.get(payload, [])}:
                        work += [(f, n, (*path, n)) for n in found.get(f, [])]
    return sorted(map(str, out))


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_closure_with_payloads_and_versions(spark, depth):
    pick = random.Random(depth)
    locators = [f"p{k % 12}@{1 + k // 12}.{k % 3}" for k in range(40)] + [f"https://h/{k}" for k in range(15)]
    catalog = {loc: (pick.choice(["ok", "ok", "ok", "pin_mismatch", "fail", "skipped"]), f"c{pick.randrange(30)}") for loc in locators if pick.random() < 0.9}
    catalog[locators[0]] = ("ok", None)
    members = {f"c{k}": [f"m{pick.randrange(40)}" for _ in range(pick.randrange(3))] for k in range(0, 30, 2)}
    found = {f: pick.sample(locators, 2) for f in [*(f"c{k}" for k in range(30)), *(f"m{k}" for k in range(40))] if pick.random() < 0.6}
    roots = [(pick.randrange(5), f"f{k}", pick.choice(locators)) for k in range(25)]
    got = refs.close_refs(
        spark.createDataFrame(roots, "report_id long, source string, locator string"), spark.createDataFrame([(k, *v) for k, v in catalog.items()], "locator string, outcome string, payload string"),
        spark.createDataFrame([(k, f) for k, v in members.items() for f in v], "payload string, file string"), spark.createDataFrame([(f, n) for f, v in found.items() for n in v], "file string, locator string"), depth,
    )
    rows = sorted(str((r.report_id, r.locator, r.hop, r.source, r.payload, r.outcome, list(r.path))) for r in got.collect())
    assert rows == loop_closure(roots, catalog, members, found, depth)


def test_grafts_rename_whole_subtrees(spark):
    columns = "report_id long, file_id long, parent_id long, depth int, path string, sha256 string, rel string, role string, via string"
    files = spark.createDataFrame([(1, 0, None, 0, "a.tgz", "A", None, None, None), (1, 3, 0, 1, "a.tgz!!m", "M", "member", None, None), (2, 0, None, 0, "b", "B", None, None, None)], columns)
    subs = [
        (1, 0, 0, None, 0, "x.tgz", "X", None, None), (1, 0, 2, 0, 1, "x.tgz!!in/x.tgz", "Y", "member", None), (1, 0, 1, 0, 1, "x.tgz2", "Q", "member", None),
        (1, 1, 0, None, 0, "p@1.registry.json", "R", None, None), (1, 2, 0, None, 0, "x.tgz", "X", None, None), (2, 0, 0, None, 0, "", "E", None, None),
    ]
    edges = [(1, 0, "fetched", "M", "pkg:npm/x@1", "https://h/x.tgz"), (1, 1, "registry", "M", "pkg:npm/p@1", None), (1, 2, "fetched", "nowhere", "pkg:npm/x@2", ""), (2, 0, "fetched", "B", "pkg:npm/e", None)]
    got = findings.graft_subtrees(files, spark.createDataFrame(subs, "report_id long, sub_id long, file_id long, parent_id long, depth int, path string, sha256 string, rel string, role string"), spark.createDataFrame(edges, "report_id long, sub_id long, kind string, source string, locator string, resolved_url string"))
    new = {(r.report_id, r.file_id): tuple(r)[2:] for r in got.collect()}
    assert len(new) == got.count() == 9
    assert new[1, 4] == (3, 2, "pkg:npm/x@1", "X", "fetched", None, "https://h/x.tgz")
    assert new[1, 6] == (4, 3, "pkg:npm/x@1!!in/x.tgz", "Y", "member", None, None)
    assert new[1, 5] == (4, 3, "x.tgz2", "Q", "member", None, None)
    assert new[1, 7] == (3, 2, "p@1.registry.json", "R", "registry", "sidecar", None)
    assert new[1, 8] == (0, 1, "pkg:npm/x@2", "X", "fetched", None, "pkg:npm/x@2")
    assert new[2, 1] == (0, 1, "", "E", "fetched", None, "pkg:npm/e")
    assert findings.lone_sidecars(got).count() == 0
    assert [tuple(r) for r in findings.lone_sidecars(got.where("file_id <> 3")).collect()] == [(1, 7)]


def test_retention(spark):
    files = spark.createDataFrame([(1, k, t, d, r) for k, t, d, r in ((0, "zip", 0, 0), (1, "elf", 1, 1), (2, "elf", 1, 2), (3, "", 1, 0), (4, "registry", 1, 0), (5, "elf", 1, 0), (6, "elf", 1, 0), (7, "elf", 1, 0))], "report_id long, file_id long, file_type string, depth int, risk long")
    found = spark.createDataFrame([(1, 5, "a", 3), (1, 1, "b", 2), (1, 5, "c", 2)], "report_id long, file_id long, id string, crit int")
    cited = spark.createDataFrame([(1, 5, "a", 6), (1, 5, "c", 7), (1, 1, "b", 7)], "report_id long, file_id long, id string, cites long")
    assert {r.file_id for r in findings.retain(files, found, 1, cited).collect()} == {0, 2, 3, 4, 5, 6}


def test_corpus_with_large_files(spark, tmp_path):
    root = tmp_path / "a corpus"
    (root / ".git" / "x").mkdir(parents=True)
    (root / "d").mkdir()
    (root / ".git" / "x" / "y").write_bytes(b"no")
    (root / ".gitignore").write_bytes(b"no")
    content = {"small": b"abc", "d/large": random.Random(1).randbytes(30 << 20)}
    for name, data in content.items():
        (root / name).write_bytes(data)
    got = {r.path.split("a%20corpus/")[-1].split("a corpus/")[-1]: (r.length, r.sha256) for r in reports.read_corpus(spark, str(root), whole=1 << 20).collect()}
    assert got == {n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in content.items()}


def test_manifest_changes_by_one_row(spark, tmp_path):
    words = [("good", k, k * 7) for k in range(20)] + [("bad", k, k) for k in range(9)]
    kind = "stem string, word long, bits long"
    a = {r.stem: r for r in reports.write_bloom(spark.createDataFrame(words, kind).repartition(3), str(tmp_path / "f"), "v2").collect()}
    assert (a["good"].version, a["good"].words, a["bad"].file) == ("v2", 20, "stem=bad")
    ranges = [";".join(f"{k}:{k * 7}" for k in range(s, min(s + 8, 20))) for s in (0, 8, 16)]
    whole = "".join(hashlib.sha256(r.encode()).hexdigest() for r in ranges)
    by8 = {r.stem: r.sha256 for r in reports.bloom_manifest(spark.createDataFrame(words, kind), "v2", 8).collect()}
    assert by8["good"] == hashlib.sha256(whole.encode()).hexdigest()
    words[3] = ("good", 3, 22)
    b = {r.stem: r.sha256 for r in reports.bloom_manifest(spark.createDataFrame(words, kind), "v2").collect()}
    assert b["bad"] == a["bad"].sha256 and b["good"] != a["good"].sha256


def test_flatten_facts(spark, tmp_path):
    file = {
        "id": 1, "path": "p", "type": "elf", "findings": [{"id": "a/b", "crit": 5, "conf": 0.9}], "metrics": {"binary": {"n": 3, "ok": True, "name": "x", "list": [1]}, "text": {"r": 0.5}},
        "imports": [["libc", "open"], ["", "read"], {"name": "dl"}, "plain", 7, ["", ""]], "exports": [["main", 1]], "targets": ["eval"], "strings": [["0x1", "wide", "hello"], "no"], "refs": [{"kind": "url", "locator": "https://h"}, {"kind": "url"}],
    }
    (tmp_path / "r.json").write_text(json.dumps({"report_id": 1, "files": [file, {"id": 2, "imports": "odd", "metrics": 7}]}) + "\n{broken\n")
    good, bad = reports.quarantine(reports.read_reports(spark, str(tmp_path)).cache())
    t = reports.flatten(good)
    assert bad.count() == 1 and t["files"].count() == 2 and t["findings"].count() == 1
    assert {(r.lib, r.name) for r in t["imports"].collect()} == {("libc", "open"), ("", "read"), (None, "dl"), (None, "plain")}
    assert {(r.g, r.f, r.v) for r in t["metrics"].collect()} == {("binary", "n", 3.0), ("binary", "ok", 1.0), ("text", "r", 0.5)}
    assert [r.item for r in t["strings"].collect()] == [["0x1", "wide", "hello"]]
    assert [(r.pos, r.kind, r.locator) for r in t["refs"].collect()] == [(0, "url", "https://h")]
    assert sorted(r.kind for r in t["symbols"].collect()) == ["export", *["import"] * 6, "target"]


def feed(spark, folder, rows, schema, parts):
    for k in range(parts):
        spark.createDataFrame(rows[k::parts] if parts > 1 else rows, schema).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_queue_ages_on_a_stream(spark, tmp_path):
    pick = random.Random(6)
    rows = [(pick.randrange(6), pick.choice(["claim", "claim", "result", "error"]), f"2024-01-01 {pick.randrange(24):02}:{pick.randrange(60):02}:00") for _ in range(150)]
    schema = "worker long, kind string, ts timestamp"
    rows = [(w, k, datetime.datetime.fromisoformat(t)) for w, k, t in rows]
    q = monitor.queue_ages(feed(spark, tmp_path / "in", rows, schema, 3)).writeStream.outputMode("update").format("memory").queryName("ages").option("checkpointLocation", str(tmp_path / "cp")).start()
    # a stream with timeouts goes on without new data: wait for the batches' rows
    for _ in range(80):
        time.sleep(0.5)
        if sum(p["numInputRows"] for p in q.recentProgress) >= len(rows):
            break
    q.stop()
    # rows of a later batch replace those of an earlier one: a worker's state only moves on
    last = {}
    for r in spark.table("ages").collect():
        last.setdefault(r.worker, []).append((r.last_result, r.oldest))
    now = F.lit("2024-01-03").cast("timestamp")
    for r in monitor.queue_age(spark.createDataFrame(rows, schema).where("kind <> 'error'"), now).collect():
        want = (r.last_result, r.oldest_s)
        ages = [(a, None if o is None else int((datetime.datetime(2024, 1, 3) - o).total_seconds())) for a, o in last[r.worker]]
        assert want in ages


def test_stream_of_reports_is_scored_as_stored_ones(spark, tmp_path):
    from siftspark.operators import jobs, verdicts
    from siftspark.plans.job_queries import model

    spec = spark.createDataFrame([(0, "agg:max_crit", 0.0, 1.5), (1, "struct:file_count_log", 0.2, 0.5), (2, "ext:third_party_max_crit", 0.0, 2.0), (3, "present:objectives", 0.0, 1.2), (4, "score:density", 1.0, 3.0), (5, "agg:category_breadth", 1.0, 2.0)], "pos int, name string, mean double, std double")
    pick = random.Random(2)
    schema = "report_id long, ts timestamp, files array<struct<file_id:long,file_type:string,size_bytes:long,depth:int,parent_id:long,path:string,risk:long,entropy:double,total_lines:long,mtime:long>>, findings array<struct<file_id:long,id:string,crit:int,conf:double,atk:string,mbc:string>>"
    rows = []
    for k in range(24):
        kinds = [(f, pick.choice(["elf", "zip", "python"]), 100 * f + 5, int(f > 0), 0 if f else None, f"r{k}" + (f"!!{f}" if f else ""), 3 * k, 4.0 + f, 10, None) for f in range(1 + k % 3)]
        found = [(pick.randrange(1 + k % 3), pick.choice(["objectives/a/b::r", "third_party/y", "well-known/z/q"]), pick.randrange(1, 6), pick.choice([0.5, 0.7, 0.9]), None, None) for _ in range(k % 6)]
        # the last ones are hours behind what came before them
        rows.append((k, datetime.datetime(2024, 1, 1, 12 if k < 20 else 9, k), kinds, found))

    def score(batch):
        files = batch.select("report_id", F.inline("files"))
        t = jobs.Tables(files, batch.select("report_id", F.inline("findings")))
        return jobs.score_reports(jobs.featurize(t, spec), files, model(spark))[0]

    for k, part in enumerate((rows[:10], rows[10:20], rows[20:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = monitor.score_stream(stream, score, str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    late = {r.report_id for r in spark.read.parquet(str(tmp_path / "out" / "late")).collect()}
    assert late == set(range(20, 24))
    got = {r.report_id: (r["class"], round(r.prob, 9), r.level) for r in spark.read.parquet(str(tmp_path / "out" / "verdicts")).collect()}
    want = {r.report_id: (r["class"], round(r.prob, 9), r.level) for r in score(spark.createDataFrame(rows[:20], schema)).collect()}
    assert got == want and len(got) == 20
    assert verdicts.DEFAULT_LEVEL == 25


def test_a_repeated_batch_splits_as_before(spark, tmp_path):
    rows = lambda *hours: spark.createDataFrame([(h, f"2024-01-01 {h:02}:00:00") for h in hours], "id int, t string").select("id", F.col("t").cast("timestamp").alias("ts"))
    path = str(tmp_path / "p")
    for _ in range(2):
        assert [d.count() for d in monitor.split_late(rows(5, 9), 0, path)] == [2, 0]
        assert [sorted(r.id for r in d.collect()) for d in monitor.split_late(rows(3, 12), 1, path)] == [[12], [3]]
        assert [d.count() for d in monitor.split_late(rows(11, 12), 2, path)] == [1, 1]
