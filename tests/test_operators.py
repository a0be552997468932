"""Boundary cases of the reference's operators on small literals."""

import itertools

import pytest
from pyspark.sql import functions as F

from siftspark.operators import audits, findings, grades, knownsets, refs, verdicts
from siftspark.sources import reports


def one(spark, expr, *values, kind="string"):
    """Value of a column expression over a literal."""
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{k} {kind if isinstance(kind, str) else kind[k]}" for k in range(len(values))))
    return df.select(expr(*[F.col(f"c{k}") for k in range(len(values))]).alias("x")).first()[0]


@pytest.mark.parametrize("id_,want", [("a", ["a"]), ("a/b", ["a", "a/b"]), ("a/b/c::r", ["a", "a/b", "a/b/c"]), ("a/b/c/d::r", ["a", "a/b", "a/b/c"])])
def test_paths(spark, id_, want):
    assert one(spark, findings.finding_paths, id_) == want


@pytest.mark.parametrize("level,conf", [(None, None), (-1, 0), (0, 100), (5, 95), (6, 94), (25, 92), (26, 92), (31, 91), (100, 85), (101, 82), (3000, 54), (25000, 29), (25001, 28), (25002, 27), (25003, 26), (49999, 26), (50000, 17), (50002, 15), (60000, 15)])
def test_level_conf(spark, level, conf):
    assert one(spark, verdicts.level_conf, level, kind="int") == conf


@pytest.mark.parametrize("t,want", [("TAR.gz", "tar"), ("tar.bz2.xz", "tar"), ("gz", "gz"), ("elf", "elf"), ("a.zst", "a")])
def test_norm_type(spark, t, want):
    assert one(spark, verdicts.norm_type, t) == want


@pytest.mark.parametrize("raw,want", [(0.05, 0.02), (0.1, 0.02), (0.2, 0.06), (0.5, 0.4), (0.95, 0.99), (2.0, 0.99), (None, None)])
def test_calibrate(spark, raw, want):
    bp = spark.createDataFrame([(0.1, 0.02), (0.3, 0.1), (0.5, 0.4), (0.8, 0.9), (0.95, 0.99)], "x double, y double")
    got = verdicts.calibrate(spark.createDataFrame([(raw,)], "raw double"), bp).first().p
    assert got == pytest.approx(want)


@pytest.mark.parametrize("url,want", [("https://u:p@Example.COM:8080/a?b", "example.com"), ("example.org.", "example.org"), ("http://a.b?x", "a.b"), ("word", "word")])
def test_host(spark, url, want):
    assert one(spark, lambda c: refs.norm_host(refs.host_of(c)), url) == want


def test_domains_match_at_labels(spark):
    rows = spark.createDataFrame([("a.example.org",), ("example.org",), ("notexample.org",), ("cdn.example.org",), ("x.cdn.example.org",)], "host string")
    listed = spark.createDataFrame([("example.org",)], "domain string")
    carved = spark.createDataFrame([("cdn.example.org",)], "domain string")
    got = {r.host: r.publisher for r in refs.publisher(rows, listed, carved).collect()}
    assert got == {"a.example.org": True, "example.org": True, "notexample.org": False, "cdn.example.org": False, "x.cdn.example.org": False}


def test_version_order(spark):
    order = ["1.0", "1.0-beta", "1.2", "1.2.rc1", "1.2.1", "1.2.3", "1.9", "1.10", "9.9", "10.0"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r.v for r in df.orderBy(refs.version_key(F.col("v"))).collect()] == order


@pytest.mark.parametrize("purl,want", [("pkg:golang/x@v0.0.0-20240229123456-abcdefabcdef", "2024-02-29 12:34:56"), ("pkg:golang/x@v0.0.0-20230229123456-abcdefabcdef", None), ("pkg:golang/x@v1.0", None)])
def test_go_published(spark, purl, want):
    got = one(spark, refs.go_published, purl)
    assert (got and str(got)) == want


def test_bloom_has_no_false_negatives(spark):
    keys = spark.range(500).select(F.concat(F.lit("k"), "id").alias("key"))
    k, m = knownsets.bloom_params(500, 0.01)
    words = knownsets.bloom_build(keys, k, m)
    assert knownsets.might_contain(keys, words, k, m).where("not maybe").count() == 0
    other = spark.range(500, 2500).select(F.concat(F.lit("k"), "id").alias("key"))
    assert knownsets.might_contain(other, words, k, m).where("maybe").count() < 60


@pytest.mark.parametrize("n,p,want", [(0, 0.01, 64), (1000, 0.01, 16384), (1000, -1, 65536)])
def test_bloom_params(n, p, want):
    k, m = knownsets.bloom_params(n, p)
    assert m == want and 1 <= k <= 64


def test_untrusted_text_never_softens(spark):
    rows = list(itertools.product((0, 1, 2), ("benign", "suspicious", "hostile", None), *[(False, True)] * 4))
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "class int, grade string, readable boolean, addresses_analyzer boolean, hostile_finding boolean, near boolean, prob double")
    for r in grades.blend(df).collect():
        if not r.readable or r.addresses_analyzer or r.grade is None:
            assert r.new_class >= r["class"] and r.new_prob >= r.prob
        assert abs(r.new_class - r["class"]) <= 1
        if r.new_class == 2 and r["class"] < 2:
            assert r.near or r.hostile_finding


@pytest.mark.parametrize("reply,want", [('so {"grade":"benign","reason":" a  b "} done', ("benign", "a b")), ('{"grade":"odd"}', None), ("none", None), (None, None)])
def test_parse_grade(spark, reply, want):
    got = one(spark, grades.parse_grade, reply)
    assert (got and tuple(got)) == want


def test_blend_with_a_missing_route_does_not_fire(spark):
    blend = spark.createDataFrame([("elf", 1, r, 1.0, 5.0, 0.1, 2) for r in ("a", "b")], "file_type string, level int, route string, weight double, intercept double, threshold double, n_routes int")
    scores = spark.createDataFrame([(1, "elf", "a", 0.9), (1, "elf", "b", 0.9), (2, "elf", "a", 0.9)], "id int, file_type string, route string, p double")
    assert [r.id for r in verdicts.fire_blend(scores, blend).collect()] == [1]


def test_sweep_scans_all_levels(spark):
    grid = spark.createDataFrame([("t", "g", n, p) for n, p in ((1, 0.9), (2, 0.3), (3, 0.6))], "file_type string, route string, level int, threshold double")
    scores = spark.createDataFrame([(1, "t", "g", 0.5), (2, "t", "g", 0.1)], "id int, file_type string, route string, p double")
    got = {r.id: (r.level, r["class"]) for r in verdicts.decide(scores, grid, n=1).collect()}
    assert got == {1: (2, 1), 2: (-1, 0)}


def test_reports_round_trip(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"report_id": 1, "files": [{"id": 0, "path": "a", "findings": [{"id": "x/y::r", "crit": 5, "conf": 0.9}]}]}\nnot json\n')
    good, bad = reports.quarantine(reports.read_reports(spark, str(tmp_path / "r.json")).cache())
    assert bad.count() == 1
    assert [(r.report_id, r.id, r.crit) for r in reports.flatten(good)["findings"].collect()] == [(1, "x/y::r", 5)]


def test_pool_is_never_fatal(spark):
    lines = ['{"sha256": "%s", "label": "good"}' % ("a" * 64), '{"sha256": "zz", "label": "bad"}', "broken", '{"purl": "pkg:npm/a@1", "label": "odd"}']
    pool, stats = reports.read_pool(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert pool.count() == 2 and tuple(stats.first()) == (4, 1, 1, 1)
    assert knownsets.key_sets(pool).count() == 1


def test_registry_shapes(spark):
    shapes = ['{"registry": {"record": {"name": "n"}}}', '{"record": {"name": "n"}}', '{"name": "n"}', "{}", "x"]
    df = spark.createDataFrame([(x,) for x in shapes], "j string").select(reports.read_registry(F.col("j")).alias("r"))
    assert [r.r and r.r["name"] for r in df.collect()] == ["n", "n", "n", None, None]


def test_artifact_filename(spark):
    assert one(spark, reports.artifact_filename, "https://a/b/c.tgz?x", "pkg:npm/a@1") == "c.tgz"
    assert one(spark, reports.artifact_filename, "https://a/", "pkg:npm/a@1") == "a-1"


def test_batches(spark):
    df = spark.range(100).withColumn("size", F.when(F.col("id") < 10, 1 << 26).otherwise(10))
    big = audits.batches(df, "mixed", 10).where(F.col("size") > 100).groupBy("batch").count().collect()
    assert len(big) == 10 and {r["count"] for r in big} == {1}
    for how in ("fifo", "big_first", "small_first", "shuffle"):
        assert audits.batches(df, how, 4).groupBy("batch").count().where("count = 25").count() == 4


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")], "src string, dst string")
    got = {r.locator: r.hop for r in refs.closure(spark.createDataFrame([("a",)], "locator string"), edges, depth=2).collect()}
    assert got == {"a": 0, "b": 1, "c": 2}


def test_thresholds_at(spark):
    rows = [("elf", "g", 25, 0.8), ("elf", "g", 3000, 0.95), ("pe", "g", 25, 0.7)]
    got = {r.file_type: (r.hostile, r.suspicious) for r in verdicts.thresholds_at(spark.createDataFrame(rows, "file_type string, route string, level int, threshold double"), 25).collect()}
    assert got == {"elf": (0.8, 0.8), "pe": (0.7, 0.65)}


def test_calibrated_grid(spark):
    bp = spark.createDataFrame([(0.0, 0.0), (1.0, 0.5)], "x double, y double")
    grid = spark.createDataFrame([("elf", "g", 1, 0.6)], "file_type string, route string, level int, threshold double")
    assert verdicts.calibrate_grid(grid, bp).first().threshold == pytest.approx(0.3)


@pytest.mark.parametrize("p,t,low,high", [(0.99955, 0.99954, 0.0, 0.1), (1.031e-05, 8.072e-06, 0.2, 0.3), (0.0, 0.5, -104, -103), (1.0, 0.5, 15.9, 16.0)])
def test_margin_is_finite_and_keeps_small_odds_apart(spark, p, t, low, high):
    assert low < one(spark, verdicts.logit_margin, p, t, kind="double") < high


def test_blend_truth_table(spark):
    flags = list(itertools.product((False, True), repeat=4))
    rows = [(c, 0.4, g, *f) for c in (0, 1, 2) for g in ("benign", "suspicious", "hostile", None) for f in flags]
    df = spark.createDataFrame(rows, "class int, prob double, grade string, readable boolean, addresses_analyzer boolean, hostile_finding boolean, near boolean")
    up, down = 0.4 + 0.6 * 0.33, 0.4 * 0.67
    for r in grades.blend(df).collect():
        want = {"benign": 0, "suspicious": 1, "hostile": 2, None: None}[r.grade]
        soft = r.readable and not r.addresses_analyzer
        cls, prob = r["class"], 0.4
        if want is not None and want > cls:
            prob = up
            cls += 1 if cls + 1 < 2 or r.hostile_finding or r.near else 0
        elif want is not None and want == cls:
            prob = up if cls else down if soft else 0.4
        elif want is not None and soft:
            prob = down
            cls -= 1 if cls < 2 or r.near else 0
        assert (r.new_class, r.new_prob) == (cls, pytest.approx(prob)), r
        # an untrusted read never softens
        assert soft or (r.new_class >= r["class"] and r.new_prob >= 0.4)


@pytest.mark.parametrize("n,want", [(2, 0), (3, 1), (4, 4), (22, 1539), (60, 23560)])
def test_capped_triples(spark, n, want):
    from siftspark.operators import features

    assert one(spark, features.capped_triples, n, kind="long") == want


def test_tokens_and_ngrams(spark):
    from siftspark.operators import features

    paths = spark.createDataFrame([(1, "objectives", 5), (1, "objectives/a", 4), (1, "objectives/a/b", 4), (1, "metadata/x", 5), (1, "well-known", 2), (1, "evasion/y", 3)], "report_id long, path string, max_crit int")
    tokens = features.crit_tokens(paths)
    assert sorted(r.token for r in tokens.collect()) == ["h:objectives", "n:evasion/y", "s:objectives/a"]
    vocab = spark.createDataFrame([("h:objectives", "n:evasion/y"), ("h:objectives", "h:well-known")], "a string, b string")
    assert [r.name for r in features.token_ngrams(tokens, vocab, "critbi:").collect()] == ["critbi:h:objectives + n:evasion/y"]
    assert features.token_ngrams(tokens, vocab, "critbi:", cap=2).count() == 0
    assert "n:evasion/y" in {r.token for r in features.tier_tokens(paths).collect()}


def test_reports_without_known_features_keep_a_vector(spark):
    from siftspark.operators import features

    spec = spark.createDataFrame([(0, "a", 0.0, 2.0), (1, "b", 3.0, 1.5)], "pos int, name string, mean double, std double")
    rows = spark.createDataFrame([(1, "a", 4.0), (2, "other", 1.0)], "report_id long, name string, value double")
    reports = spark.createDataFrame([(1,), (2,), (3,)], "report_id long")
    got = {r.report_id: list(r.vector) for r in features.assemble(rows, spec, reports).collect()}
    assert got == {1: [2.0, -2.0], 2: [0.0, -2.0], 3: [0.0, -2.0]}
    paths = spark.createDataFrame([(1, "p", 3, 0.9)], "report_id long, path string, max_crit int, max_conf double")
    risks = spark.createDataFrame([(1, 0), (2, 10)], "report_id long, risk int")
    ghosts = features.weighted_paths(paths, risks, spark.createDataFrame([("p",), ("q",)], "path string")).where("name like 'ghost:%'")
    assert sorted((r.report_id, r.name) for r in ghosts.collect()) == [(1, "ghost:q"), (2, "ghost:p"), (2, "ghost:q")]


def test_fetched_root_of_deep_trees_and_rings(spark):
    deep = [(1, k, k - 1 if k else None, "fetched" if k == 2 else None) for k in range(45)]
    files = spark.createDataFrame(deep, "report_id long, file_id long, parent_id long, rel string")
    got = {r.file_id: r.fetched_root for r in refs.fetched_root(files).collect()}
    assert got == {k: 2 for k in range(2, 45)}
    ring = spark.createDataFrame([(1, 0, 1, None), (1, 1, 0, None)], "report_id long, file_id long, parent_id long, rel string")
    with pytest.raises(ValueError):
        refs.fetched_root(ring)


def test_policies(spark):
    with pytest.raises(ValueError):
        refs.select_kinds(F.lit("url"), "urls,typo")
    with pytest.raises(ValueError):
        refs.select_kinds(F.lit("url"), " , ")
    assert one(spark, lambda c: refs.select_kinds(c, "none"), "url") is False
    assert one(spark, lambda c: refs.select_kinds(c, "urls, deps"), "dependency") is True


@pytest.mark.parametrize("name,want", [("path:objectives/evasion/process:hostile", "evasion > process [hostile]"), ("path:a/b", "path: a > b"), ("agg:max_crit", "aggregate: max crit"), ("filetype:elf", "file type: elf"), ("kv:x=y", "kv:x=y")])
def test_describe(spark, name, want):
    assert one(spark, verdicts.describe, name) == want


def test_budget_of_a_run(spark):
    rows = [(1, f, p, 0, "command", 10, False) for f in (1, 2) for p in (1, 2, 3)]
    df = spark.createDataFrame(rows, "report_id long, file_id long, pos int, tie int, kind string, bytes long, cached boolean")
    got = {(r.file_id, r.pos): r.budget for r in refs.apply_budget(df, per_file=2, run_refs=3).collect()}
    assert got == {(1, 1): None, (1, 2): None, (1, 3): "refs", (2, 1): None, (2, 2): "run_refs", (2, 3): "refs"}


def test_known_good_goes_before_its_record(spark):
    refs_df = spark.createDataFrame([("pkg:npm/a@1",), ("pkg:golang/x@v0.0.0-20200101000000-abcdefabcdef",), ("pkg:npm/c@1",)], "locator string")
    reg = spark.createDataFrame([("pkg:npm/a@1", True), ("pkg:npm/c@1", True)], "locator string, removed boolean").selectExpr("locator", "CAST(NULL AS TIMESTAMP) AS published", "removed", "false AS security_hold", "CAST(NULL AS STRING) AS deprecated", "false AS known_good")
    good = spark.createDataFrame([("pkg:npm/a@1",)], "locator string")
    got = {r.locator: r.reason for r in refs.age_gate(refs_df, reg, F.lit("2024-01-01").cast("timestamp"), good=good).collect()}
    assert got == {"pkg:npm/a@1": "known_good", "pkg:golang/x@v0.0.0-20200101000000-abcdefabcdef": "aged_out", "pkg:npm/c@1": "removed"}


@pytest.mark.parametrize("url,want", [
    ("https://h/a/b.json", False), ("https://h/a/b.pdf", False), ("https://h/raw/x/payload", True), ("https://h/dl/payload", False), ("https://api.h.io/v1/data.bin", False), ("https://api.h.io/files/data.bin", True), ("https://h/a/.foo", False),
    ("https://h/" + "a/" * 20 + "releases/x", True), ("https://h/download", False), ("https://h/x/a.tar.gz", True), ("ftp://h/a.exe", False), ("https://h", False), ("https:///a.exe", False), ("https://h/graphql/a.exe", False), ("https://h/a.averyverylongone", False), ("https://h/files/..", False), (None, False),
])
def test_download_shapes(spark, url, want):
    assert one(spark, refs.looks_like_download, url) == want


@pytest.mark.parametrize("name,want", [
    ("linux-i686", True), ("linuxmusl-x64", True), ("linux-ppc64", True), ("a+linux+arm64", True), ("linux-x64", False), ("x86_64_linux", False), ("linux-x64-and-darwin-arm64", False), ("darwin-arm64-and-linux-x64", True), ("linux", False), ("%40biomejs/cli-darwin-arm64", True), ("x86-64-windows", True),
])
def test_platforms(spark, name, want):
    assert one(spark, lambda c: refs.off_platform(c, "linux", "x64"), f"pkg:npm/{name}@1.0.0") == want
    assert one(spark, lambda c: refs.off_platform(c, "", "x64"), f"pkg:npm/{name}@1.0.0") is False
    assert one(spark, lambda c: refs.off_platform(c, "linux", "x64"), f"https://h/{name}") is False


def test_age_gate_ages_pulled_versions_out(spark):
    refs_df = spark.createDataFrame([(c,) for c in "abcde"], "locator string")
    rows = [("a", "2023-06-01", "yanked", True), ("b", "2023-12-25 00:00:00", None, False), ("c", "2023-12-26", "yanked", True), ("d", "2023-12-26", None, True), ("e", "2023-12-31", None, True)]
    reg = spark.createDataFrame(rows, "locator string, at string, deprecated string, known_good boolean").selectExpr("locator", "CAST(at AS TIMESTAMP) AS published", "false AS removed", "false AS security_hold", "deprecated", "known_good")
    got = {r.locator: r.reason for r in refs.age_gate(refs_df, reg, F.lit("2024-01-01").cast("timestamp")).collect()}
    # b is of the very last moment; a pulled or new version is not skipped as known good
    assert got == {"a": "aged_out", "b": "aged_out", "c": "keep", "d": "known_good", "e": "keep"}


def test_triage(spark):
    from siftspark.operators import jobs

    rows = [
        (1, 1, 0, 0, "dependency", "pkg:npm/p@1.0", "a"), (1, 1, 1, 0, "command", "pkg:npm/p@2.0", "a"), (1, 1, 2, 0, "dependency", "pkg:npm/q@1.0", "a"), (1, 1, 3, 0, "dependency", "pkg:npm/q@1.1", "a"), (2, None, None, None, "dependency", "pkg:npm/n", "a"),
        (3, 1, 0, 0, "dependency", "pkg:npm/r@1.0", "a"), (3, 2, 0, 0, "dependency", "pkg:npm/r@1.0", "a"), (3, 3, 0, 0, "dependency", "pkg:npm/v@9", "x/node_modules/y"), (3, 4, 0, 0, "dependency", "pkg:npm/v@1", None), (4, 1, 0, 0, "url", "https://h/x", "a"),
    ]
    df = spark.createDataFrame([(*r, 1, False) for r in rows], "report_id long, file_id long, pos long, tie long, kind string, locator string, path string, bytes long, cached boolean")
    reg = spark.createDataFrame([("pkg:npm/r@1.0", "2020-01-01")], "locator string, at string").selectExpr("locator", "CAST(at AS TIMESTAMP) AS published", "false AS removed", "false AS security_hold", "CAST(NULL AS STRING) AS deprecated", "false AS known_good")
    got = {(r.report_id, r.file_id, r.pos): r.fate for r in jobs.triage_refs(df, reg, F.lit("2024-01-01").cast("timestamp"), "deps").collect()}
    assert got == {(1, 1, 0): "kept", (1, 1, 1): "kind", (1, 1, 2): "older", (1, 1, 3): "kept", (2, None, None): "kept", (3, 1, 0): "aged_out", (3, 2, 0): "repeated", (3, 3, 0): "vendored", (3, 4, 0): "kept", (4, 1, 0): "kind"}
    urls = jobs.triage_refs(df, reg, F.lit("2024-01-01").cast("timestamp"), "urls").where("kind = 'url'").collect()
    assert [r.fate for r in urls] == ["not_download"]


@pytest.mark.parametrize("text,readable", [
    ("// H one\n\\x01\\x02 and some more\n// S two", False), ("日本語日本語日本語日本語日本語日本語", False), ("plain text of a line\n\\x01\\x02 and some more", False), ("a\nb\n\\x01\\x02 and some more", True), ("", True), ("\n\n", True), ("// H x\n\n", True), ("\ttabs\tand words here", True), ("  \\x1\\x2  ", True),
])
def test_readable(spark, text, readable):
    df = spark.createDataFrame([(1, text)], "id long, text string")
    assert grades.guard_texts(df, ["x y"]).first().readable == readable


@pytest.mark.parametrize("lib,name,want", [("", "open", ["open"]), ("c", "open", ["open", "c!open"]), ("libc", "", ["libc"]), ("libc", None, ["libc"]), (None, "é", ["é"]), ("a", "b", ["a!b"]), ("", "", [])])
def test_import_tokens(spark, lib, name, want):
    from siftspark.operators import features

    assert one(spark, features.import_tokens, lib, name, kind=["string", "string"]) == want


def test_symbols_of_all_kinds_of_entries(spark):
    from siftspark.operators import features

    rows = [("import", '["libc", " open  it "]'), ("import", '["", "read"]'), ("import", '{"name": "dlsym"}'), ("import", '{"n": "", "name": "no"}'), ("import", '"plain"'), ("import", "7"), ("export", '["main", 1]'), ("function", '"fn"'), ("export", '{"name": "not"}'), ("target", '"eval"'), ("member", '["x"]'), ("target", '"q"')]
    df = spark.createDataFrame([(1, 1, *r) for r in rows], "report_id long, file_id long, kind string, t string").withColumn("v", F.parse_json("t"))
    assert {r.symbol for r in features.fact_symbols(df).collect()} == {"open it", "libc! open it", "read", "dlsym", "plain", "main", "fn", "eval"}


def test_categories_and_imports_of_structures(spark):
    from siftspark.operators import features

    found = spark.createDataFrame([(1, 1, "a::x", 5, 0.9), (1, 1, "a::y", 5, 0.9), (1, 1, "b/c::z", 5, 0.9)], "report_id long, file_id long, id string, crit int, conf double")
    files = spark.createDataFrame([(1, 1, "elf", 10, None, 0, "p", 1.0, None, 5, 0, False)], "report_id long, file_id long, file_type string, size_bytes long, parent_id long, depth int, path string, entropy double, mtime long, total_lines long, risk long, has_imports boolean")
    got = {r.name: r.value for r in features.aggregates(found, files).collect()}
    assert got["agg:top1_file_hostile_category_breadth_sum"] == 2
    bare = lambda f, i: {r.name: r.value for r in features.structure(f, findings.file_summary(found), findings.report_paths(found), i).collect()}["struct:no_imports"]
    none = files.select("report_id", "file_id").limit(0)
    assert bare(files, none) == 0 and bare(files.withColumn("has_imports", F.lit(True)), none) == 1 and bare(files.drop("has_imports"), None) == 0


def test_confidences_are_compared_as_given(spark):
    df = spark.createDataFrame([(1, 1, "a", 5, 0.64996), (1, 1, "b", 5, 0.65)], "report_id long, file_id long, id string, crit int, conf double")
    assert [r.id for r in findings.active(df).collect()] == ["b"]


def test_families_compute_the_names_of_a_spec_only(spark):
    from siftspark.operators import features, jobs

    found = [(1, 10, "objectives/a/b::r", 5, 0.9, "T1001", None), (1, 11, "well-known/c", 3, 0.8, None, "B0001"), (2, 20, "third_party/x", 4, 0.7, None, None)]
    rows = spark.createDataFrame(found, "report_id long, file_id long, id string, crit int, conf double, atk string, mbc string")
    files = spark.createDataFrame([(1, 10, "elf", 100, 0, None, "o.elf", 50, 1.0, 3, 7), (1, 11, "python", 9, 1, 10, "o.elf!!b.py", 30, 2.0, 4, 8), (2, 20, "zip", 5, 0, None, "p.zip", 40, 0.0, 1, 9)], "report_id long, file_id long, file_type string, size_bytes long, depth int, parent_id long, path string, risk int, entropy double, total_lines long, mtime long")
    t = jobs.Tables(files, rows)
    every = {(r.report_id, r.name): r.value for r in jobs.families(t).collect()}
    for names in (["agg:max_crit", "agg:attack_technique_count", "struct:file_count_log"], ["agg:files", "agg:suspicious_findings_log", "agg:objective_bigram_count", "format:script", "ext:has_yara_match", "score:hopper_score"]):
        got = {(r.report_id, r.name): r.value for r in jobs.families(t, names).collect()}
        assert got == {k: v for k, v in every.items() if k[1] in names} and got
    assert not {n for _, n in every if n.startswith(("missing:", "crit:"))} & {r.name for r in jobs.families(t, skip=("missing", "crit")).collect()}
    codes = {(r.report_id, r.name): r.value for r in features.attack_codes(rows).collect()}
    assert codes[1, "agg:attack_technique_count"] == codes[1, "agg:mbc_behavior_count"] == codes[1, "agg:has_attack_and_objective"] == 1.0 and codes[2, "agg:attack_technique_count"] == 0.0


def test_mean_of_seeds_leaves_nulls_out(spark):
    row = spark.createDataFrame([(0.25, 0.75, None)], "a double, b double, c double")
    assert row.select(verdicts.mean_of(F.col("a"), F.col("b"), F.col("c")), verdicts.mean_of(F.col("c"))).first()[:] == (0.5, None)


def test_file_entries_have_the_class(spark):
    files = spark.createDataFrame([(1, 10, "elf", 0, 5), (1, 11, "pe", 1, 5), (1, 12, "pe", 1, 5)], "report_id long, file_id long, file_type string, depth int, risk int")
    members = spark.createDataFrame([(1, 11, 2, 0.9)], "report_id long, file_id long, class int, prob double")
    final = spark.createDataFrame([(1, 1, 0.5, 25)], "report_id long, class int, prob double, level int")
    entry = lambda *verdicts: [f["v"]["cls"] if f["v"] else None for f in reports.ml_files(files, members, *verdicts).first()["files"]]
    assert entry() == [None, 2, None] and entry(final) == [1, 2, None]


def test_gates_of_triage_do_not_double_the_plan(spark):
    from siftspark.operators import jobs

    df = spark.createDataFrame([(1, 1, 0, 0, "dependency", "pkg:npm/p@1.0", "a", 1, False)], "report_id long, file_id long, pos long, tie long, kind string, locator string, path string, bytes long, cached boolean")
    reg = spark.createDataFrame([], "locator string, published timestamp, removed boolean, security_hold boolean, deprecated string, known_good boolean")
    out = jobs.triage_refs(df, reg, F.lit("2024-01-01").cast("timestamp"), "deps")
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation") + plan.count("LogicalRDD") <= 4 and [r.fate for r in out.collect()] == ["kept"]


def test_rows_of_a_run_are_not_broadcast_by_the_bytes_of_their_files(spark):
    from siftspark.session import stored_rows

    few = stored_rows(spark.range(50))
    many = stored_rows(spark.range(100), most=0)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(few.join(few.withColumnRenamed("id", "k"), F.col("id") == F.col("k")))
    assert "BroadcastHashJoin" not in plan(many.select("id").where("id > 3").join(few.withColumnRenamed("id", "k"), F.col("id") == F.col("k")))
    # what a model bounds is broadcast all the same
    scores = stored_rows(spark.createDataFrame([(1, "elf", "general", 0.7)], "id long, file_type string, route string, p double"), most=0)
    grid = spark.createDataFrame([("elf", "general", 25, 0.6)], "file_type string, route string, level int, threshold double")
    fired = verdicts.fire_or(scores, grid)
    assert "BroadcastHashJoin" in plan(fired) and [tuple(r) for r in fired.collect()] == [(1, 25, 0.7, 0.6)]


def test_metrics_are_looked_up_in_one_pass(spark):
    from siftspark.operators import features

    files = spark.createDataFrame([(1, '{"binary":{"string_count":6,"function_count":3,"import_count":4}}'), (1, '{"binary":{"string_count":2,"dependency_count":0}}'), (2, None)], "report_id long, metrics string")
    vocab = spark.createDataFrame([("binary_odd",)], "name string")
    out = features.metrics(files.select("report_id").distinct(), features.merged_metrics(files), vocab)
    got = {(r.report_id, r.name): r.value for r in out.collect()}
    names = {n for r, n in got if r == 1}
    assert len(got) == 2 * len(names) == out.count() and {n for r, n in got if r == 2} == names and "metrics:binary_odd" in names
    assert [got[1, f"metrics:derived_{n}"] for n in ("string_per_function", "imports_per_dependency", "wide_string_ratio")] == [2.0, 0.0, 0.0]
    assert not any(v for (r, _), v in got.items() if r == 2)
    # before, an array function over all names, and the files were read once more for the ratios
    assert out._jdf.queryExecution().optimizedPlan().toString().lower().count("from_json") == 1
