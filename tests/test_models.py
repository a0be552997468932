"""Model folders read back from files, rules that each have a violating row, and tree ensembles in both forms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftspark.operators import jobs, trees, verdicts
from siftspark.sources import models


def put(root, file, content):
    path = root / file
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


def onnx(n_features=3, **other):
    """Two trees: x0 <= 0.5 and x2 > 0, two classes."""
    return {
        "n_features": n_features, "n_classes": 2, "nodes_treeids": [0, 0, 0, 1, 1, 1], "nodes_nodeids": [0, 1, 2, 0, 1, 2], "nodes_featureids": [0, 0, 0, 2, 0, 0], "nodes_modes": ["BRANCH_LEQ", "LEAF", "LEAF", "BRANCH_GT", "LEAF", "LEAF"],
        "nodes_values": [0.5, 0, 0, 0.0, 0, 0], "nodes_truenodeids": [1, 0, 0, 1, 0, 0], "nodes_falsenodeids": [2, 0, 0, 2, 0, 0], "nodes_missing_value_tracks_true": [1, 0, 0, 0, 0, 0],
        "class_treeids": [0, 0, 1, 1], "class_nodeids": [1, 2, 1, 2], "class_ids": [0, 0, 0, 0], "class_weights": [-1.0, 1.0, 2.0, -0.5], "base_values": [0.25, 0.0], "post_transform": "LOGISTIC",
    } | other


def spec(**other):
    return {"version": 18, "presence_vocab": ["a/b", "objectives/x"], "symbol_vocab": ["open"], "feature_names": ["agg:max_crit", "present:a/b", "struct:file_count_log"], "total_features": 3, "feature_means": [0.0, 1.0, 0.5], "feature_stds": [1.0, 2.0, 0.1]} | other


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "a model"
    put(root, "config.json", {
        "filetype_to_group": {"elf": "native", "pe": "native"}, "required_routes": ["general", "filetypes/gone"], "default_severity_level": 25,
        "levels": [{"level": 0, "hostile": {"thresholds": {"general": 0.99}}}, {"level": 25, "hostile": {"thresholds": {"general": 0.9, "filetypes/elf": 0.8, "odd": 1.5}}}, {"level": 5000, "hostile": {"thresholds": {"general": 0.3}}}, {"level": 3000, "hostile": {"thresholds": {"general": 0.5, "filetypes/elf": 0.85}}}],
    })
    best = lambda **b: {"best": b}
    blend = {"routes": ["general", "filetypes/elf"], "weights": [0.5, 1.5], "intercept": -0.1, "threshold": 0.6, "transform": "logit"}
    put(root, "route_policies.json", {"routes": {"x": {"filetype": "elf", "levels": [
        {"level": 25, "hostile": best(thresholds={"general": 0.4, "filetypes/elf": 2.0})}, {"level": 50, "hostile": best(blend=blend)}, {"level": 60, "hostile": best(blend=blend | {"weights": [1.0]})},
        {"level": 70, "hostile": best(blend=blend | {"transform": "cube"})}, {"level": 80, "hostile": best(blend=blend | {"routes": [], "weights": []})}, {"level": 90, "hostile": best(blend=blend | {"threshold": -1})}, {"level": 100, "hostile": {}},
    ]}}})
    put(root, "general/feature_spec.json", spec())
    put(root, "general/calibrator.json", {"schema": "x.calibrator.isotonic.v1", "x": [0.1, 0.5, 0.9], "y": [0.0, 0.4, 1.0]})
    put(root, "general/models/seed_1.json", onnx())
    put(root, "general/models/seed_2.json", onnx(base_values=[0.5, 0.0]))
    put(root, "general/config.json", {"hostile": 0.8, "severity_levels": [{"level": 25, "hostile": {"threshold": 0.7}}, {"level": 100, "hostile": {"threshold": 0.2}}]})
    put(root, "general/importance.json", {"feature_names_sha256": "d", "top_features": [{"name": "agg:max_crit", "importance": 2.5}, {"name": "x"}]})
    put(root, "filetypes/elf/feature_spec.json", spec())
    put(root, "filetypes/elf/trees.json", onnx(n_classes=3, class_ids=[0, 1, 1, 2], base_values=[], post_transform="SOFTMAX"))
    put(root, "filetypes/elf/evaluation.json", {"model_abi_version": 18, "recommended_thresholds": {"hostile": 0.7, "suspicious": 0.6}})
    return root


def test_read_back(spark, folder):
    m = models.read_model(spark, str(folder))
    assert {r.route for r in m.routes.collect()} == {"general", "filetypes/elf"} and m.default_level == 25
    assert {tuple(r) for r in m.groups.collect()} == {("elf", "native"), ("pe", "native")}
    assert {(r.file_type, r.level, r.route, r.threshold) for r in m.policies.collect()} == {("elf", 25, "general", 0.4)}
    assert {(r.level, r.route, r.weight, r.intercept, r.n_routes) for r in m.blends.collect()} == {(50, "general", 0.5, -0.1, 2), (50, "filetypes/elf", 1.5, -0.1, 2)}
    assert [(r.x, r.y) for r in m.calibrators.orderBy("pos").collect()] == [(0.1, 0.0), (0.5, 0.4), (0.9, 1.0)]
    assert [(r.name, r["mean"], r.std) for r in m.spec.where("route = 'general'").orderBy("pos").collect()] == [("agg:max_crit", 0.0, 1.0), ("present:a/b", 1.0, 2.0), ("struct:file_count_log", 0.5, 0.1)]
    assert {(r.vocabulary, r.value) for r in m.vocabularies.where("route = 'general'").collect()} == {("presence", "a/b"), ("presence", "objectives/x"), ("symbol", "open")}
    assert [tuple(r) for r in m.importances.collect()] == [("general", "agg:max_crit", 2.5, "d")]
    assert {tuple(r) for r in m.thresholds.collect()} == {("general", 0.8, 0.8, "config"), ("filetypes/elf", 0.7, 0.6, "evaluation")}
    assert {tuple(r) for r in models.severity_thresholds(m.severities, 25).collect()} == {("general", "config", 0.7, 0.2)}
    good, bad = models.route_thresholds(m.levels, 25)
    assert {tuple(r) for r in good.collect()} == {("general", 0.9, 0.5), ("filetypes/elf", 0.8, 0.8)} and [r.route for r in bad.collect()] == ["odd"]
    found = {(r.rule, r.item) for r in m.violations.collect()}
    assert found == {
        ("level threshold is outside 0 to 1", "25/hostile/odd"), ("policy threshold is outside 0 to 1", "elf/25/hostile/filetypes/elf"), ("blend has other numbers of routes and weights", "elf/60/hostile"), ("blend transform is not known", "elf/70/hostile"),
        ("blend has no routes", "elf/80/hostile"), ("blend threshold is outside 0 to 1", "elf/90/hostile"), ("required route has no trees", "filetypes/gone"), *[("policy has neither a threshold nor a blend", f"elf/{n}/hostile") for n in (60, 70, 80, 90, 100)],
    }
    ready = trees.from_tables(m.nodes, m.leaves, m.ensembles)
    assert [len(ready[r]) for r in ("general", "filetypes/elf")] == [2, 1]
    x = [[0.4, 0.0, 1.0], [0.6, 0.0, -1.0], [np.nan, 0.0, np.nan]]
    assert trees.predict(ready["general"][0], x) == pytest.approx(1 / (1 + np.exp(-np.array([-1 + 2, 1 - 0.5, -1 - 0.5]) - 0.25)))
    soft = np.exp([[-1, 2, 0], [0, 1, -0.5], [-1, 0, -0.5]])
    assert trees.predict(ready["filetypes/elf"][0], x) == pytest.approx(soft[:, 1] / soft.sum(1))


def test_suspicious_blocks(spark, tmp_path):
    put(tmp_path, "config.json", {"levels": [{"level": 1, "hostile": {"thresholds": {"a": 0.9, "b": 0.5, "c": 0.7}}, "suspicious": {"thresholds": {"a": 0.4, "b": 0.6, "only": 0.3}}}, {"level": 2, "hostile": {"thresholds": {"a": 0.2}}}, {"level": 3, "hostile": {"thresholds": {"a": 0.9}}, "suspicious": {}}]})
    m = models.read_model(spark, str(tmp_path))
    good, bad = models.route_thresholds(m.levels, 1)
    assert {tuple(r) for r in good.collect()} == {("a", 0.9, 0.4), ("c", 0.7, 0.7), ("only", 1.0, 0.3)}
    assert [tuple(r) for r in bad.collect()] == [("b", "suspicious threshold is above the hostile one")]
    assert [tuple(r) for r in models.route_thresholds(m.levels, 3)[0].collect()] == [("a", 0.9, 0.9)]
    assert models.route_thresholds(m.levels, 7)[0].count() == 0


RULES = [
    ("broken.json", "{no", "file is no JSON"),
    ("general/calibrator.json", {"schema": "calibrator.isotonic.v2", "x": [0.1], "y": [0.1]}, "calibrator schema is not known"),
    ("general/calibrator.json", {"x": [0.1], "y": []}, "calibrator has other numbers of x and y, or none"),
    ("general/calibrator.json", {"x": [], "y": []}, "calibrator has other numbers of x and y, or none"),
    ("general/calibrator.json", {"x": [0.1, None], "y": [0.1, 0.2]}, "calibrator has a value that is not finite"),
    ("general/calibrator.json", {"x": [0.1, 0.1], "y": [0.1, 0.2]}, "calibrator x does not ascend"),
    ("general/calibrator.json", {"x": [0.1, 0.2], "y": [0.3, 0.2]}, "calibrator y descends"),
    ("general/calibrator.json", {"x": [0.1, 0.2], "y": [0.3, 1.2]}, "calibrator y is outside 0 to 1"),
    ("general/config.json", {"hostile": 1.2, "suspicious": 0.1}, "hostile threshold is outside 0 to 1"),
    ("general/config.json", {"hostile": 0.2, "suspicious": -0.1}, "suspicious threshold is outside 0 to 1"),
    ("general/config.json", {"hostile": 0.2, "suspicious": 0.3}, "suspicious threshold is above the hostile one"),
    ("general/evaluation.json", {"model_abi_version": 3}, "evaluation is of another ABI"),
    ("general/feature_spec.json", spec(version=15), "spec version is not read"),
    ("general/feature_spec.json", spec(abi_version=17), "spec is of another ABI"),
    ("general/feature_spec.json", spec(presence_vocab=[]), "spec has no presence vocabulary"),
    ("general/feature_spec.json", spec(total_features=4), "spec has other numbers of names and features"),
    ("general/feature_spec.json", spec(feature_stds=None), "spec has only one of means and deviations"),
    ("general/feature_spec.json", spec(feature_stds=None, feature_means=None), "spec is standardized without means"),
    ("general/feature_spec.json", spec(feature_stds=[1.0]), "spec has other numbers of means or deviations and features"),
    ("general/trees.json", onnx(nodes_featureids=[]), "trees have no nodes"),
    ("general/trees.json", onnx(class_nodeids=[]), "trees have no leaves"),
    ("general/trees.json", onnx(nodes_values=[1.0]), "trees have attributes of different lengths"),
    ("general/trees.json", onnx(nodes_modes=["BRANCH_LEQ", "LEAF", "LEAF", "BRANCH_IN", "LEAF", "LEAF"]), "trees have a mode that is not known"),
    ("general/trees.json", onnx(nodes_treeids=[1, 1, 1, 2, 2, 2]), "tree numbers do not begin at 0"),
    ("general/trees.json", onnx(class_treeids=[0, 0, 0, 0]), "trees and leaves are of different numbers"),
    ("general/trees.json", onnx(class_nodeids=[1, 2, 0, 2]), "trees have a leaf without a node"),
    ("general/trees.json", onnx(nodes_truenodeids=[7, 0, 0, 1, 0, 0]), "trees have a branch to no node"),
    ("general/trees.json", onnx(n_features=None), "trees do not say how many features"),
    ("general/trees.json", onnx(n_features=2), "trees use a feature beyond the last"),
    ("general/trees.json", onnx(class_ids=[0, 0, 0, 2]), "trees have a class beyond the last"),
    ("general/trees.json", onnx(base_values=[1.0]), "trees have other numbers of base values and classes"),
    ("general/trees.json", onnx(post_transform="PROBIT"), "trees have a transform that is not known"),
]


def test_every_rule_has_a_violating_row(spark, tmp_path):
    """One folder for each rule below one root would be one model: read them in turn, a few files each."""
    for k, (file, content, rule) in enumerate(RULES):
        put(tmp_path / str(k), file, content)
        files = models.read_files(spark, str(tmp_path / str(k)))
        assert [r.file for r in files.collect()] == [file]
    # all at once: each rule's files are routes of their own
    root = tmp_path / "all"
    for k, (file, content, _) in enumerate(RULES):
        put(root, file.replace("general", f"filetypes/t{k}") if "/" in file else file, content)
    m = models.read_model(spark, str(root))
    found = {(r.file, r.rule) for r in m.violations.collect()}
    assert {(file.replace("general", f"filetypes/t{k}"), rule) for k, (file, _, rule) in enumerate(RULES)} <= found
    assert m.calibrators.count() == m.nodes.count() == m.spec.count() == 0


def test_bundles_and_sizes(spark, tmp_path):
    put(tmp_path, "general/trees.json", onnx())
    put(tmp_path, "general/models/seed_1.json", onnx())
    put(tmp_path, "filetypes/a/models/seed_1.json", onnx())
    put(tmp_path, "filetypes/a/models/seed_2.json", onnx(n_features=4))
    put(tmp_path, "filetypes/b/trees.json", onnx(n_features=5))
    put(tmp_path, "filetypes/b/feature_spec.json", spec())
    m = models.read_model(spark, str(tmp_path))
    assert {(r.rule, r.item) for r in m.violations.collect()} == {("bundle has both one ensemble and seeds", "general"), ("members have different numbers of features", "filetypes/a"), ("trees and spec have different numbers of features", "filetypes/b")}
    assert m.ensembles.count() == 0


def test_both_tree_forms_agree(spark):
    pick = np.random.default_rng(3)
    modes = list(trees._TESTS)
    for post, n_classes in (("NONE", 1), ("LOGISTIC", 2), ("SOFTMAX", 3)):
        nodes, leaves = [(0, 0, 0, "LEAF", 0.0, 0, 0, False)], [(0, 0, n_classes - 1, 0.3)]
        for t in range(1, 7):
            for k in range(7):
                leaf = k >= 3
                nodes.append((t, k, int(pick.integers(4)), "LEAF" if leaf else modes[(t + k) % 6], float(pick.integers(-1, 2)), 2 * k + 1, 2 * k + 2, bool(pick.integers(2))))
                leaves += [(t, k, int(pick.integers(n_classes)), float(pick.normal()))] * leaf
        e = trees.ensemble(nodes, leaves, 4, n_classes, [0.1] * n_classes, post)
        rows = [(k, [None if pick.random() < 0.1 else float("nan") if pick.random() < 0.1 else float(pick.integers(-2, 3)) for _ in range(4)]) for k in range(120)]
        df = spark.createDataFrame(rows, "id long, features array<double>")
        a = {r.id: r.raw for r in trees.score(df, e).collect()}
        b = {r.id: r.raw for r in trees.score_by_paths(df, e).collect()}
        assert a == pytest.approx(b) and len(set(a.values())) > 10


def test_no_grid_and_manual(spark):
    rows = spark.createDataFrame([(1, "elf", "general", 0.1), (1, "elf", "filetypes/elf", 0.5), (2, "zip", "general", 0.7), (2, "zip", "x", 0.95), (3, "pe", "general", 0.2), (3, "pe", "x", 0.8)], "id long, file_type string, route string, p double")
    got = {r.id: (r["class"], r.prob, r.threshold) for r in verdicts.decide_scores(rows).collect()}
    assert got == {1: (0, 0.5, 0.65), 2: (2, 0.95, 0.9), 3: (1, 0.8, 0.65)}
    none = spark.createDataFrame([], "file_type string, route string, level int, threshold double")
    assert {r.level for r in verdicts.swept_decision(rows, none).collect()} == {None}
    policy = spark.createDataFrame([("pe", "hostile", "x", 0.9), ("pe", "suspicious", "x", 0.7), ("elf", "hostile", "general", 0.9)], "file_type string, severity string, route string, threshold double")
    got = {r.id: (r["class"], r.prob, r.level) for r in verdicts.manual_decision(rows, policy).collect()}
    assert got == {1: (0, 0.1, None), 2: (2, 0.95, None), 3: (1, 0.8, None)}
    assert spark.range(1).select(verdicts.interpreted_level(F.lit(2), None).alias("x")).first().x is None


def test_thresholds_by_route(spark):
    grid = spark.createDataFrame([("elf", "general", 1, 0.3), ("elf", "other", 1, 0.3)], "file_type string, route string, level int, threshold double")
    points = spark.createDataFrame([("general", 0.1, 0.0), ("general", 0.5, 0.4)], "route string, x double, y double")
    assert {(r.route, round(r.threshold, 6)) for r in verdicts.calibrate_grid(grid, points).collect()} == {("general", 0.2), ("other", 0.3)}


def test_model_for_jobs(spark, folder):
    tables = models.read_model(spark, str(folder))
    model, spec_ = jobs.model_of(tables)
    assert set(model.trees) == {"general", "filetypes/elf"} and spec_.count() == 3
    assert {(r.file_type, r.route, r.level, round(r.threshold, 6)) for r in model.grid.collect()} == {("elf", "general", 25, 0.3)}
    assert [(r.level, r.threshold) for r in model.general.orderBy("level").collect()] == [(0, 0.99), (25, 0.9), (3000, 0.5), (5000, 0.3)]
    assert (model.hostile, model.suspicious) == (pytest.approx(0.85), pytest.approx(0.85))
    files = spark.createDataFrame([(1, 1, "elf", 0), (2, 1, "zip", 0)], "report_id long, file_id long, file_type string, depth int")
    vectors = spark.createDataFrame([(1, [0.6, 0.0, 1.0]), (2, [0.0, 0.0, -1.0])], "report_id long, vector array<double>")
    decided, scores, _ = jobs.score_reports(vectors, files, model)
    assert {r.report_id for r in decided.collect()} == {1, 2} and scores.where("route = 'general'").count() == 2
