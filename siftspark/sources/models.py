"""Model folders: every JSON file of a model as typed tables, and what is wrong with them.

A folder holds ``config.json`` and ``route_policies.json``, and a folder for each
route (``general``, ``filegroups/<name>``, ``filetypes/<name>``) with
``feature_spec.json``, ``calibrator.json``, ``evaluation.json``, importances, and
tree ensembles (``trees.json`` or ``models/seed_*.json``) that carry the
attributes of ONNX' TreeEnsembleClassifier by their public names.

All files are read as VARIANT in one pass; maps with unknown keys become rows.
What breaks a rule is left out of the tables and is a row of ``violations``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftspark.session import stored

#: Versions of a feature spec that are read, and vocabularies that it may have.
SPEC_VERSIONS, ABI = (16, 18), 18
VOCABULARIES = ("presence", "filetype", "element", "bigram", "ghost", "skeleton", "rare_element", "trigram", "metric", "crit_unigram", "crit_bigram", "crit_trigram", "attack_bigram", "attack_trigram", "mbc_bigram", "mbc_trigram", "tiered_bigram", "tiered_trigram", "kv", "symbol", "symbol_bigram", "symbol_trigram")
#: Thresholds where no file has any, and the ceiling of the suspicious band.
SUSPICIOUS, HOSTILE, CEILING = 0.65, 0.9, 3000

_THRESHOLDS = "struct<thresholds:map<string,double>>"
_LEVELS = f"array<struct<level:int,hostile:{_THRESHOLDS},suspicious:{_THRESHOLDS}>>"
_BLEND = "struct<routes:array<string>,weights:array<double>,intercept:double,threshold:double,transform:string>"
_BEST = f"struct<best:struct<thresholds:map<string,double>,blend:{_BLEND}>>"
_ROUTES = f"map<string,struct<filetype:string,levels:array<struct<level:int,hostile:{_BEST},suspicious:{_BEST}>>>>"
_METRIC = "struct<threshold:double>"
_SEVERITY = f"array<struct<level:int,suspicious:{_METRIC},hostile:{_METRIC}>>"
#: ONNX' names of the attributes of a tree ensemble.
_NODES = {"nodes_treeids": "int", "nodes_nodeids": "int", "nodes_featureids": "int", "nodes_modes": "string", "nodes_values": "double", "nodes_truenodeids": "int", "nodes_falsenodeids": "int"}
_LEAVES = {"class_treeids": "int", "class_nodeids": "int", "class_ids": "int", "class_weights": "double"}
MODES = ("BRANCH_LEQ", "BRANCH_LT", "BRANCH_GTE", "BRANCH_GT", "BRANCH_EQ", "BRANCH_NEQ", "LEAF")


@dataclass
class ModelTables:
    """The tables of a model; all are bounded by the model's own size.

    ``routes``: route. ``groups``: t, grp. ``levels``: level, severity, route,
    threshold. ``thresholds``: route, hostile, suspicious, source.
    ``severities``: route, source, level, hostile, suspicious. ``policies``:
    file_type, level, severity, route, threshold. ``blends``: the same with
    weight, intercept, threshold, n_routes. ``policy_levels``: file_type,
    level, explicit. ``calibrators``: route, pos, x, y. ``spec``: route, pos,
    name, mean, std. ``vocabularies``: route, vocabulary, pos, value.
    ``importances``: route, name, importance, digest. ``nodes`` and ``leaves``
    of trees, by route and seed, and ``ensembles``: route, seed, n_features,
    n_classes, base_values, post_transform. ``violations``: file, rule, item.
    """

    routes: DataFrame
    groups: DataFrame
    required: DataFrame
    default_level: int | None
    levels: DataFrame
    thresholds: DataFrame
    severities: DataFrame
    policies: DataFrame
    blends: DataFrame
    policy_levels: DataFrame
    calibrators: DataFrame
    spec: DataFrame
    vocabularies: DataFrame
    importances: DataFrame
    nodes: DataFrame
    leaves: DataFrame
    ensembles: DataFrame
    violations: DataFrame


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(file, route, name, v)`` of each JSON file below ``path``; ``v`` is null where the text is no JSON."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath()
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    # schemes are written with one slash or three
    whole = F.regexp_replace(F.url_decode("_metadata.file_path"), "^[A-Za-z0-9+.-]+:(//[^/]*)?", "")
    rows = rows.select(F.substring(whole, len(root.rstrip("/")) + 2, 1 << 20).alias("file"), F.try_parse_json("value").alias("v"))
    folder = F.regexp_replace(F.col("file"), "/?[^/]*$", "")
    return rows.select("file", F.regexp_replace(folder, "/?models$", "").alias("route"), F.element_at(F.split("file", "/"), -1).alias("name"), "v")


def _get(path: str, kind: str) -> Column:
    return F.try_variant_get("v", path, kind)


def _unit(c: Column) -> Column:
    """In 0 to 1; null and NaN are not."""
    return F.coalesce(c.between(0, 1) & ~F.isnan(c), F.lit(False))


def _bad(rows: DataFrame, rule: str, item: Column | str = "") -> DataFrame:
    said = item if isinstance(item, Column) else F.lit(item)
    return rows.select("file", F.lit(rule).alias("rule"), said.cast("string").alias("item"))


def _config(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Levels ``(file, level, severity, route, threshold)``, groups, required routes and the default level."""
    top = files.where("file = 'config.json'")
    rows = top.select("file", F.explode(_get("$.levels", _LEVELS)).alias("l"))
    one = lambda s: rows.select("file", F.col("l.level").alias("level"), F.lit(s).alias("severity"), F.explode(F.col(f"l.{s}.thresholds")).alias("route", "threshold"))
    levels = one("hostile").unionByName(one("suspicious"))
    # a level may have a suspicious block without thresholds, which is not the same as none
    blocks = rows.where("l.suspicious is not null").select("file", F.col("l.level").alias("level"), F.lit("suspicious").alias("severity"), F.lit(None).cast("string").alias("route"), F.lit(None).cast("double").alias("threshold"))
    groups = top.select(F.explode(_get("$.filetype_to_group", "map<string,string>")).alias("t", "grp"))
    return levels.unionByName(blocks), groups, top.select(F.explode(_get("$.required_routes", "array<string>")).alias("route")), top.select(_get("$.default_severity_level", "int").alias("level"))


def _policies(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """OR rules, blends (a row for each route) and the levels that have either, of ``route_policies.json``."""
    entry = files.where("file = 'route_policies.json'").select("file", F.explode(_get("$.routes", _ROUTES)).alias("key", "r"))
    entry = entry.select("file", F.col("r.filetype").alias("file_type"), F.explode("r.levels").alias("l"))
    one = lambda s: entry.select("file", "file_type", F.col("l.level").alias("level"), F.lit(s).alias("severity"), F.col(f"l.{s}.best").alias("best"), F.col(f"l.{s}").isNotNull().alias("given"))
    rows = one("hostile").unionByName(one("suspicious")).where("given or severity = 'hostile'")
    key = ["file", "file_type", "level", "severity"]
    named = F.concat_ws("/", "file_type", F.col("level").cast("string"), "severity")
    rules = rows.select(*key, F.explode("best.thresholds").alias("route", "threshold"))
    b = F.col("best.blend")
    same, transform = F.size(b["routes"]) == F.size(b["weights"]), F.coalesce(b["transform"], F.lit("logit")) == "logit"
    wrong = F.when(~transform, "blend transform is not known").when(~F.coalesce(same, F.lit(False)), "blend has other numbers of routes and weights").when(F.size(b["routes"]) == 0, "blend has no routes").when(~_unit(F.coalesce(b["threshold"], F.lit(0.0))), "blend threshold is outside 0 to 1")
    blended = rows.where("best.blend is not null").withColumn("wrong", wrong)
    fine = blended.where("wrong is null").select(*key, F.coalesce(b["intercept"], F.lit(0.0)).alias("intercept"), F.coalesce(b["threshold"], F.lit(0.0)).alias("threshold"), F.size(b["routes"]).alias("n_routes"), F.inline(F.arrays_zip(b["routes"].alias("route"), b["weights"].alias("weight"))))
    good = rules.where(_unit(F.col("threshold")))
    usable = good.select(*key).unionByName(fine.select(*key)).distinct()
    nothing = rows.join(usable, key, "left_anti")
    bad = [_bad(rules.where(~_unit(F.col("threshold"))), "policy threshold is outside 0 to 1", F.concat_ws("/", named, "route")), blended.where("wrong is not null").select("file", F.col("wrong").alias("rule"), named.alias("item")), _bad(nothing, "policy has neither a threshold nor a blend", named)]
    # a blend decides where there is one
    good = good.join(fine.select(*key).distinct(), key, "left_anti")
    return good.drop("file"), fine.drop("file"), usable.drop("file"), bad


def _calibrators(files: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    rows = files.where("name = 'calibrator.json'").select("file", "route", _get("$.schema", "string").alias("schema"), _get("$.x", "array<double>").alias("x"), _get("$.y", "array<double>").alias("y"))
    steps = lambda a: F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a)), lambda p, q: q - p)
    finite = lambda a: F.forall(a, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    wrong = F.when(F.col("schema").isNotNull() & ~F.col("schema").rlike(r"(^|\.)calibrator\.isotonic\.v1$"), "calibrator schema is not known")
    wrong = wrong.when(F.col("x").isNull() | F.col("y").isNull() | (F.size("x") != F.size("y")) | (F.size("x") == 0), "calibrator has other numbers of x and y, or none")
    wrong = wrong.when(~finite("x") | ~finite("y"), "calibrator has a value that is not finite").when(F.exists(steps("x"), lambda d: d <= 0), "calibrator x does not ascend").when(F.exists(steps("y"), lambda d: d < 0), "calibrator y descends").when(F.exists("y", lambda e: ~e.between(0, 1)), "calibrator y is outside 0 to 1")
    rows = rows.withColumn("wrong", wrong)
    points = rows.where("wrong is null").select("route", F.posexplode(F.arrays_zip("x", "y")).alias("pos", "p")).select("route", "pos", "p.x", "p.y")
    return points, [rows.where("wrong is not null").select("file", F.col("wrong").alias("rule"), F.col("route").alias("item"))]


def _specs(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """Spec rows, vocabularies and totals by route; a spec that breaks a rule is left out whole."""
    rows = files.where("name = 'feature_spec.json'")
    rows = rows.select("file", "route", "v", F.coalesce(_get("$.version", "int"), F.lit(0)).alias("version"), F.coalesce(_get("$.abi_version", "int"), F.lit(ABI)).alias("abi"), F.coalesce(_get("$.feature_names", "array<string>"), F.array().cast("array<string>")).alias("names"), F.coalesce(_get("$.total_features", "int"), F.lit(0)).alias("total"), _get("$.feature_means", "array<double>").alias("means"), _get("$.feature_stds", "array<double>").alias("stds"), F.coalesce(_get("$.standardized", "boolean"), F.lit(True)).alias("standardized"), F.coalesce(F.size(_get("$.presence_vocab", "array<string>")), F.lit(0)).alias("presence"))
    means, stds = F.col("means"), F.col("stds")
    wrong = F.when(~F.col("version").between(*SPEC_VERSIONS), "spec version is not read").when(F.col("presence") <= 0, "spec has no presence vocabulary").when(F.size("names") != F.col("total"), "spec has other numbers of names and features").when(F.col("abi") != ABI, "spec is of another ABI")
    wrong = wrong.when(means.isNotNull() != stds.isNotNull(), "spec has only one of means and deviations").when(means.isNull() & F.col("standardized"), "spec is standardized without means").when((F.size(means) != F.col("total")) | (F.size(stds) != F.col("total")), "spec has other numbers of means or deviations and features")
    rows = rows.withColumn("wrong", wrong)
    fine = rows.where("wrong is null")
    plain = ~F.col("standardized") | means.isNull()
    # what is not standardized keeps its value under mean 0 and a deviation that is not taken for "no spread"
    spec = fine.select("route", plain.alias("plain"), "means", "stds", F.posexplode("names").alias("pos", "name")).select("route", "pos", "name", F.when(F.col("plain"), 0.0).otherwise(F.get("means", F.col("pos"))).alias("mean"), F.when(F.col("plain"), None).otherwise(F.get("stds", F.col("pos"))).alias("std"))
    vocabulary = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.coalesce(_get(f"$.{n}_vocab", "array<string>"), F.array().cast("array<string>"))) for n in VOCABULARIES]))
    words = fine.select("route", F.explode(vocabulary).alias("vocabulary", "values")).select("route", "vocabulary", F.posexplode("values").alias("pos", "value"))
    return spec, words, fine.select("file", "route", "total"), [rows.where("wrong is not null").select("file", F.col("wrong").alias("rule"), F.col("route").alias("item"))]


def _thresholds(files: DataFrame, routes: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """A route's own thresholds by their source, and the levels of its severity table.

    ``config.json`` goes before ``evaluation.json``, and that before the
    defaults; a file of another ABI or with invalid thresholds has none.
    """
    both = files.where("name IN ('config.json', 'evaluation.json')").withColumn("source", F.regexp_replace("name", r"\.json$", ""))
    both = both.withColumn("old", (F.col("source") == "evaluation") & (F.coalesce(_get("$.model_abi_version", "int"), F.lit(ABI)) != ABI))
    kept = both.where("not old")
    hostile = F.when(F.col("source") == "config", _get("$.hostile", "double")).otherwise(_get("$.recommended_thresholds.hostile", "double"))
    suspicious = F.when(F.col("source") == "config", _get("$.suspicious", "double")).otherwise(_get("$.recommended_thresholds.suspicious", "double"))
    own = kept.select("file", "route", "source", hostile.alias("hostile"), suspicious.alias("s")).where("hostile is not null").withColumn("suspicious", F.coalesce("s", "hostile")).drop("s")
    h, s = F.col("hostile"), F.col("suspicious")
    wrong = F.when(~_unit(s), "suspicious threshold is outside 0 to 1").when(~_unit(h), "hostile threshold is outside 0 to 1").when(s > h, "suspicious threshold is above the hostile one")
    own = own.withColumn("wrong", wrong)
    best = own.where("wrong is null").groupBy("route").agg(F.min_by(F.struct("hostile", "suspicious", "source"), "source").alias("b"))
    default = F.struct(F.lit(HOSTILE).alias("hostile"), F.lit(SUSPICIOUS).alias("suspicious"), F.lit("default").alias("source"))
    out = routes.join(best, "route", "left").select("route", F.inline(F.array(F.coalesce("b", default))))
    severities = kept.select("route", "source", F.inline(_get("$.severity_levels", _SEVERITY))).select("route", "source", "level", F.col("hostile.threshold").alias("hostile"), F.col("suspicious.threshold").alias("suspicious"))
    return out, severities, [own.where("wrong is not null").select("file", F.col("wrong").alias("rule"), F.col("route").alias("item")), _bad(both.where("old"), "evaluation is of another ABI", F.col("route"))]


def _trees(files: DataFrame, totals: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    rows = files.where("name = 'trees.json' OR file RLIKE '(^|/)models/seed_[^/]*[.]json$'").select("file", "route", F.regexp_replace("name", r"\.json$", "").alias("seed"), "v")
    one = {c: _get(f"$.{c}", f"array<{t}>") for c, t in (_NODES | _LEAVES).items()}
    rows = rows.select("file", "route", "seed", *[c.alias(k) for k, c in one.items()], _get("$.nodes_missing_value_tracks_true", "array<int>").alias("nan_true"), F.coalesce(_get("$.base_values", "array<double>"), F.array().cast("array<double>")).alias("base_values"), F.coalesce(_get("$.post_transform", "string"), F.lit("NONE")).alias("post_transform"), _get("$.n_features", "int").alias("n_features"), _get("$.n_classes", "int").alias("n_classes"))
    n, m = F.size("nodes_featureids"), F.size("class_nodeids")
    odd = lambda names, size: F.array(*[F.coalesce(F.size(c), F.lit(-1)) != size for c in names])
    any_ = lambda a: F.exists(a, lambda x: x)
    leafed = F.array_distinct(F.transform(F.arrays_zip("class_treeids", "class_nodeids"), lambda x: F.struct(x["class_treeids"].alias("t"), x["class_nodeids"].alias("k"))))
    nodes = F.transform(F.filter(F.arrays_zip("nodes_treeids", "nodes_nodeids", "nodes_modes"), lambda x: x["nodes_modes"] == "LEAF"), lambda x: F.struct(x["nodes_treeids"].alias("t"), x["nodes_nodeids"].alias("k")))
    every = F.transform(F.arrays_zip("nodes_treeids", "nodes_nodeids"), lambda x: F.struct(x["nodes_treeids"].alias("t"), x["nodes_nodeids"].alias("k")))
    targets = F.transform(F.filter(F.arrays_zip("nodes_treeids", "nodes_truenodeids", "nodes_falsenodeids", "nodes_modes"), lambda x: x["nodes_modes"] != "LEAF"), lambda x: F.array(F.struct(x["nodes_treeids"].alias("t"), x["nodes_truenodeids"].alias("k")), F.struct(x["nodes_treeids"].alias("t"), x["nodes_falsenodeids"].alias("k"))))
    wrong = F.when(F.coalesce(n, F.lit(0)) <= 0, "trees have no nodes").when(F.coalesce(m, F.lit(0)) <= 0, "trees have no leaves").when(any_(odd(_NODES, n)) | any_(odd(_LEAVES, m)) | (F.col("nan_true").isNotNull() & (F.size("nan_true") != n)), "trees have attributes of different lengths")
    wrong = wrong.when(~F.forall("nodes_modes", lambda x: x.isin(*MODES)), "trees have a mode that is not known").when((F.array_min("nodes_treeids") != 0) | (F.array_min("class_treeids") != 0), "tree numbers do not begin at 0").when(F.array_max("nodes_treeids") != F.array_max("class_treeids"), "trees and leaves are of different numbers")
    wrong = wrong.when(F.size(F.array_except(leafed, nodes)) > 0, "trees have a leaf without a node").when(F.size(F.array_except(F.flatten(targets), every)) > 0, "trees have a branch to no node").when(F.coalesce(F.col("n_features"), F.lit(0)) <= 0, "trees do not say how many features").when(F.array_max("nodes_featureids") >= F.col("n_features"), "trees use a feature beyond the last").when(F.coalesce(F.col("n_classes"), F.lit(0)) <= 0, "trees have no classes").when(F.array_max("class_ids") >= F.col("n_classes"), "trees have a class beyond the last")
    wrong = wrong.when(~F.size("base_values").isin(0) & (F.size("base_values") != F.col("n_classes")), "trees have other numbers of base values and classes").when(~F.col("post_transform").isin("NONE", "LOGISTIC", "SOFTMAX"), "trees have a transform that is not known")
    rows = rows.join(totals.select("route", "total"), "route", "left")
    # a bundle is one ensemble or seeds, and all of its members and its spec have the same features
    sizes = rows.groupBy("route").agg(F.min("n_features").alias("low"), F.max("n_features").alias("high"), F.count_if(F.col("seed") == "trees").alias("single"), F.count(F.lit(1)).alias("members"))
    rows = rows.join(sizes, "route").withColumn("wrong", wrong.when(F.col("low") != F.col("high"), "members have different numbers of features").when(F.col("total").isNotNull() & (F.col("total") != F.col("n_features")), "trees and spec have different numbers of features").when((F.col("single") > 0) & (F.col("members") > F.col("single")), "bundle has both one ensemble and seeds"))
    fine = rows.where("wrong is null")
    cells = F.arrays_zip(*[F.col(c).alias(c) for c in _NODES], F.coalesce("nan_true", F.array_repeat(F.lit(0), n)).alias("nan_true"))
    node = fine.select("route", "seed", F.inline(cells)).select("route", "seed", F.col("nodes_treeids").alias("tree"), F.col("nodes_nodeids").alias("node"), F.col("nodes_featureids").alias("feature"), F.col("nodes_modes").alias("mode"), F.col("nodes_values").alias("threshold"), F.col("nodes_truenodeids").alias("yes"), F.col("nodes_falsenodeids").alias("no"), (F.col("nan_true") != 0).alias("nan_yes"))
    leaf = fine.select("route", "seed", F.inline(F.arrays_zip(*_LEAVES))).select("route", "seed", F.col("class_treeids").alias("tree"), F.col("class_nodeids").alias("node"), F.col("class_ids").alias("class"), F.col("class_weights").alias("weight"))
    base = F.when(F.size("base_values") == 0, F.array_repeat(F.lit(0.0), F.col("n_classes"))).otherwise(F.col("base_values"))
    return node, leaf, fine.select("route", "seed", "n_features", "n_classes", base.alias("base_values"), "post_transform"), [rows.where("wrong is not null").select("file", F.col("wrong").alias("rule"), F.col("route").alias("item"))]


def read_model(spark: SparkSession, path: str) -> ModelTables:
    """Read a model's folder; see :class:`ModelTables`. Nothing in it is fatal but an absent folder."""
    files = stored(read_files(spark, path).withColumn("text", F.to_json("v")).drop("v")).withColumn("v", F.try_parse_json("text"))
    readable = files.where("v is not null")
    levels, groups, required, default = _config(readable)
    policies, blends, policy_levels, bad = _policies(readable)
    points, bad2 = _calibrators(readable)
    spec, words, totals, bad3 = _specs(readable)
    routes = files.where("route RLIKE '^(general|filegroups/[^/]+|filetypes/[^/]+)$'").select("route").distinct()
    thresholds, severities, bad4 = _thresholds(readable, routes)
    nodes, leaves, ensembles, bad5 = _trees(readable, totals)
    says = readable.where("name LIKE '%importance%.json'").select("route", _get("$.feature_names_sha256", "string").alias("digest"), F.inline(_get("$.top_features", "array<struct<name:string,importance:double>>")))
    # importances of the general route hold for a model; a file beside its folder does where that has none
    says = says.withColumn("first", F.max(F.col("route") == "general").over(Window.partitionBy(F.lit(0)))).where("route = 'general' OR (route = '' AND NOT first)").select("route", "name", "importance", "digest").where("name is not null and importance is not null")
    wide = _bad(levels.where(F.col("route").isNotNull() & ~_unit(F.col("threshold"))), "level threshold is outside 0 to 1", F.concat_ws("/", F.col("level").cast("string"), "severity", "route"))
    lacking = required.join(ensembles.select("route").distinct(), "route", "left_anti").select(F.lit("config.json").alias("file"), F.lit("required route has no trees").alias("rule"), F.col("route").alias("item"))
    violations = _bad(files.where("v is null"), "file is no JSON").unionByName(wide).unionByName(lacking)
    for more in [*bad, *bad2, *bad3, *bad4, *bad5]:
        violations = violations.unionByName(more)
    first = default.first()
    kept = [stored(t) for t in (thresholds, severities, policies, blends, policy_levels, points, spec, words, says, nodes, leaves, ensembles, violations)]
    return ModelTables(routes, groups, required, first and first.level, levels.drop("file"), *kept)


def route_thresholds(levels: DataFrame, n: int, ceiling: int = CEILING) -> tuple[DataFrame, DataFrame]:
    """Routes' ``(route, hostile, suspicious)`` at level ``n`` of a model's levels, and those that are invalid with ``rule``.

    Without a suspicious block the hostile threshold at the ceiling (the last
    level, or ``ceiling`` if that is lower) is the suspicious one, never above
    the hostile one. With a block, a route that it lacks is hostile only, and
    one that only the block has is suspicious only (hostile at 1). A level
    that the table lacks gives no rows.
    """
    top = levels.agg(F.max("level")).first()[0]
    loose = min(top, ceiling) if top is not None else n
    mine = levels.where(F.col("level") == n)
    block = mine.where("severity = 'suspicious'").agg(F.count(F.lit(1)) > 0).first()[0]
    at = mine.where("route is not null").groupBy("route").agg(F.max(F.when(F.col("severity") == "hostile", F.col("threshold"))).alias("h"), F.max(F.when(F.col("severity") == "suspicious", F.col("threshold"))).alias("s"))
    if block:
        out = at.select("route", F.coalesce("h", F.lit(1.0)).alias("hostile"), F.coalesce("s", "h").alias("suspicious"))
    else:
        far = levels.where((F.col("level") == loose) & (F.col("level") != n) & (F.col("severity") == "hostile")).select("route", F.col("threshold").alias("far"))
        out = at.where("h is not null").join(far, "route", "left").select("route", F.col("h").alias("hostile"), F.least("h", F.coalesce("far", "h")).alias("suspicious"))
    wrong = F.when(~_unit(F.col("suspicious")), "suspicious threshold is outside 0 to 1").when(~_unit(F.col("hostile")), "hostile threshold is outside 0 to 1").when(F.col("suspicious") > F.col("hostile"), "suspicious threshold is above the hostile one")
    out = out.withColumn("rule", wrong)
    return out.where("rule is null").drop("rule"), out.where("rule is not null").select("route", "rule")


def severity_thresholds(severities: DataFrame, n: int, ceiling: int = CEILING) -> DataFrame:
    """``(route, source, hostile, suspicious)`` at level ``n`` of routes' own severity tables, ``config`` before ``evaluation``; invalid ones are left out."""
    top = severities.groupBy("route", "source").agg(F.max("level").alias("top"))
    at = severities.where((F.col("level") == n) & F.col("hostile").isNotNull()).join(top, ["route", "source"]).withColumn("loose", F.least("top", F.lit(ceiling)))
    far = severities.select("route", "source", F.col("level").alias("loose"), F.col("hostile").alias("far"))
    rows = at.join(far, ["route", "source", "loose"], "left")
    s = F.least("hostile", F.coalesce("suspicious", F.when(F.col("loose") == n, F.col("hostile")).otherwise(F.coalesce("far", "hostile"))))
    rows = rows.select("route", "source", "hostile", s.alias("suspicious")).where(_unit(F.col("hostile")) & _unit(F.col("suspicious")))
    best = rows.groupBy("route").agg(F.min_by(F.struct("source", "hostile", "suspicious"), "source").alias("b"))
    return best.select("route", "b.source", "b.hostile", "b.suspicious")
