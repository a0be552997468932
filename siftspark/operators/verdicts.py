"""Scores to verdicts: calibration, routes, level sweeps, floors and roll-ups over members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.operators.trees import Ensemble, score, simple

#: Default level, ceiling of the suspicious band, trait floor.
DEFAULT_LEVEL, SUSPICIOUS_CEILING, GRID_MAX = 25, 3000, 25000
FLOOR_CONF, FLOOR_SHARE = 0.76, 0.05
#: Confidence at a level; between two levels the next looser one's holds.
LEVEL_CONF = (
    (0, 100), (1, 99), (2, 98), (3, 97), (4, 96), (5, 95), (10, 94), (20, 93), (30, 92), (40, 91), (50, 90), (60, 89), (70, 88), (80, 87), (90, 86), (100, 85), (200, 82), (300, 80),
    (500, 78), (1000, 75), (2000, 66), (5000, 54), (7500, 49), (10000, 45), (15000, 38), (20000, 33), (25000, 29), (25001, 28), (25002, 27), (49999, 26), (50000, 17), (50001, 16),
)
#: Suffixes of compressed files.
_PACKED = r"(?<=.)([.](gz|bz2|xz|zst|z|lzma))+$"


def level_conf(level: Column) -> Column:
    """Confidence of a level: null stays null, negative is 0, beyond the table 15."""
    out = F.when(level.isNull(), F.lit(None).cast("int")).when(level < 0, 0)
    for top, conf in LEVEL_CONF:
        out = out.when(level <= top, conf)
    return out.otherwise(15)


def interpreted_level(cls: Column, n: int | None = DEFAULT_LEVEL, grid_max: int = GRID_MAX, ceiling: int = SUSPICIOUS_CEILING) -> Column:
    """Level that stands for a class; null where levels are not used (``n`` is None)."""
    if n is None:
        return F.lit(None).cast("int")
    return F.when(cls == 0, -1).when(cls == 2, n).otherwise(min(grid_max, ceiling))


def trait_floor(verdicts: DataFrame, findings: DataFrame, n: int | None = DEFAULT_LEVEL, grid_max: int = GRID_MAX, keys: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """Benign reports (or what ``keys`` say) with confident grave findings are raised: one of criticality 5, or two of 4 that are not rare."""
    sure = F.col("conf") >= FLOOR_CONF
    top = lambda c: F.max(F.when(sure & (F.col("crit") == c), F.col("conf")))
    counts = findings.groupBy(*keys).agg(F.count_if(sure & (F.col("crit") == 5)).alias("c5"), F.count_if(sure & (F.col("crit") == 4)).alias("c4"), top(5).alias("p5"), top(4).alias("p4"), F.count(F.lit(1)).alias("total"))
    rows = verdicts.join(counts, list(keys), "left").na.fill(0, ["c5", "c4", "total"])
    five, four = F.col("c5") >= 1, (F.col("c4") >= 2) & (F.col("c4") >= FLOOR_SHARE * F.col("total"))
    cls = F.when(F.col("class") > 0, F.col("class")).when(five, 2).when(four, 1).otherwise(0)
    prob = F.when((F.col("class") == 0) & five, F.col("p5")).when((F.col("class") == 0) & four, F.col("p4")).otherwise(F.col("prob"))
    level = F.when((F.col("class") == 0) & (cls > 0), interpreted_level(cls, n, grid_max)).otherwise(F.col("level"))
    return rows.select(*keys, cls.alias("class"), prob.alias("prob"), level.alias("level"))


def calibrate(rows: DataFrame, breakpoints: DataFrame, raw: str = "raw", out: str = "p") -> DataFrame:
    """Isotonic calibration: clip outside the ``(x, y)`` breakpoints, interpolate inside; null and NaN pass."""
    points = breakpoints.agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("__bp"))  # a model's few hundred points
    return _interpolated(rows.withColumn("__bp", points.scalar()), raw, out)


def _interpolated(rows: DataFrame, raw: str, out: str) -> DataFrame:
    x = F.col(raw)
    below = F.filter("__bp", lambda p: p["x"] <= x)
    above = F.filter("__bp", lambda p: p["x"] > x)
    a, b = F.get(below, F.size(below) - 1), F.get(above, F.lit(0))
    inside = a["y"] + (x - a["x"]) / (b["x"] - a["x"]) * (b["y"] - a["y"])
    value = F.when(x.isNull() | F.isnan(x), x).when(F.size(below) == 0, b["y"]).when(F.size(above) == 0, a["y"]).otherwise(inside)
    return rows.withColumn(out, value).drop("__bp")


def calibrate_routes(rows: DataFrame, calibrators: DataFrame, raw: str = "raw", out: str = "p") -> DataFrame:
    """As :func:`calibrate`, each row by its route's breakpoints ``(route, x, y)``; rows of other routes drop."""
    points = calibrators.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("__bp"))
    return _interpolated(rows.join(F.broadcast(points), "route"), raw, out)


def invalid_breakpoints(breakpoints: DataFrame) -> DataFrame:
    """Breakpoints out of order, out of range or not finite, by calibrator ``name``."""
    order = Window.partitionBy("name").orderBy("pos")
    rows = breakpoints.withColumn("px", F.lag("x").over(order)).withColumn("py", F.lag("y").over(order))
    fine = ~F.isnan("x") & ~F.isnan("y") & F.col("y").between(0, 1) & (F.coalesce(F.col("x") > F.col("px"), F.lit(True))) & (F.coalesce(F.col("y") >= F.col("py"), F.lit(True)))
    return rows.where(~F.coalesce(fine, F.lit(False))).select("name", "pos", "x", "y")


def norm_type(t: Column) -> Column:
    """Lower-cased type without the suffixes of compression."""
    return F.regexp_replace(F.lower(t), _PACKED, "")


def routes_for(files: DataFrame, groups: DataFrame, containers: DataFrame) -> DataFrame:
    """General route, specialist by exact or container type, and group; one row for each file and route."""
    kind = files.withColumn("t", norm_type(F.col("file_type"))).join(F.broadcast(containers), "t", "left").withColumn("t", F.coalesce("container", "t"))
    kind = kind.join(F.broadcast(groups), "t", "left")
    every = F.array_compact(F.array(F.lit("general"), F.when(F.col("grp").isNotNull(), F.concat(F.lit("filegroups/"), "grp")), F.when(F.col("special"), F.concat(F.lit("filetypes/"), "t"))))
    return kind.select("report_id", "file_id", F.explode(every).alias("route"))


def fire_or(scores: DataFrame, grid: DataFrame) -> DataFrame:
    """For each level the deciding route of an OR rule: the one with the largest margin; rows ``(id, level, p, threshold)``."""
    hit = scores.join(F.broadcast(grid), ["file_type", "route"]).where("p >= threshold")
    best = hit.groupBy("id", "level").agg(F.max_by(F.struct("p", "threshold"), F.struct(F.col("p") - F.col("threshold"), "p")).alias("b"))
    return best.select("id", "level", "b.p", "b.threshold")


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.greatest(F.lit(eps), F.least(F.lit(1 - eps), p))
    return F.log(q / (1 - q))


def fire_blend(scores: DataFrame, blend: DataFrame) -> DataFrame:
    """For each level whether a logistic blend of routes reaches its threshold; a missing route never fires.

    ``blend``: file_type, level, route, weight, intercept, threshold, n_routes.
    """
    rows = scores.join(F.broadcast(blend), ["file_type", "route"])
    total = rows.groupBy("id", "level", "intercept", "threshold", "n_routes").agg(F.sum(F.col("weight") * logit(F.col("p"))).alias("s"), F.count(F.lit(1)).alias("n"))
    p = 1 / (1 + F.exp(-(F.col("intercept") + F.col("s"))))
    return total.where("n = n_routes").withColumn("p", p).where(F.col("p") >= F.col("threshold")).select("id", "level", "p", "threshold")


def sweep(scores: DataFrame, grid: DataFrame, blend: DataFrame | None = None) -> DataFrame:
    """Lowest level that fires, over all levels (thresholds need not be monotone), with its p and threshold."""
    fired = fire_or(scores, grid)
    if blend is not None:
        fired = fired.unionByName(fire_blend(scores, blend))
    best = fired.groupBy("id").agg(F.min_by(F.struct("level", "p", "threshold"), F.struct("level", -F.col("p"))).alias("b"))
    return best.select("id", "b.level", "b.p", "b.threshold")


def sweep_general(scores: DataFrame, general: DataFrame) -> DataFrame:
    """Lowest level of a grid ``(level, threshold)`` for all types at which a report's greatest p reaches the threshold."""
    most = scores.groupBy("id").agg(F.max("p").alias("p"))
    grid = general.agg(F.array_sort(F.collect_list(F.struct("level", "threshold")))).scalar()  # a model's levels
    rows = most.withColumn("__g", grid)
    rows = rows.withColumn("hit", F.get(F.filter("__g", lambda g: g["threshold"] <= F.col("p")), F.lit(0))).where("hit is not null")
    return rows.select("id", "hit.level", "p", "hit.threshold")


def classify(p: Column, suspicious: Column | float, hostile: Column | float) -> Column:
    """``{class, threshold}``: 2 from the hostile cutoff on, 1 from the suspicious one on, else 0; the threshold is the cutoff that decided."""
    s, h = (x if isinstance(x, Column) else F.lit(float(x)) for x in (suspicious, hostile))
    return F.struct(F.when(p >= h, 2).when(p >= s, 1).otherwise(0).alias("class"), F.when(p >= h, h).otherwise(s).alias("threshold"))


def decide_scores(scores: DataFrame, suspicious: float = 0.65, hostile: float = 0.9) -> DataFrame:
    """Without a grid: a report's strongest class over its routes, and of these the highest p, also where all are benign."""
    rows = scores.withColumn("d", classify(F.col("p"), suspicious, hostile))
    best = rows.groupBy("id").agg(F.max(F.struct("d.class", "p", "d.threshold")).alias("b"))
    return best.select("id", "b.class", F.col("b.p").alias("prob"), "b.threshold")


def manual_decision(scores: DataFrame, policy: DataFrame, blend: DataFrame | None = None, suspicious: float = 0.65, hostile: float = 0.9) -> DataFrame:
    """Decisions without levels: ``(id, class, prob, threshold, level)``, the level always null.

    ``policy``: file_type, severity, route, threshold; ``blend`` likewise with
    weight, intercept and n_routes: a type's own rules at the default level. A
    type with rules of which none fires is benign with its general route's p;
    types without rules go by the thresholds alone.
    """
    types = policy.select("file_type") if blend is None else policy.select("file_type").unionByName(blend.select("file_type"))
    kind = scores.join(types.distinct().withColumn("own", F.lit(True)), "file_type", "left")
    mine, rest = kind.where("own").drop("own"), kind.where("own is null").drop("own")
    fired = {}
    for severity in ("hostile", "suspicious"):
        rules = policy.where(F.col("severity") == severity).withColumn("level", F.lit(0))
        hit = fire_or(mine, rules.select("file_type", "route", "level", "threshold"))
        if blend is not None:
            hit = hit.unionByName(fire_blend(mine, blend.where(F.col("severity") == severity).withColumn("level", F.lit(0))))
        fired[severity] = hit.groupBy("id").agg(F.max_by(F.struct("p", "threshold"), F.struct(F.col("p") - F.col("threshold"), "p")).alias("b")).select("id", "b.p", "b.threshold")
    decided = policy_decide(fired["hostile"], fired["suspicious"])
    calm = mine.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("route") == "general", F.col("p"))), F.lit(0.0)).alias("general"))
    ruled = calm.join(decided, "id", "left").select("id", F.coalesce("class", F.lit(0)).alias("class"), F.coalesce("p", "general").alias("prob"), F.coalesce("threshold", F.lit(suspicious)).alias("threshold"))
    return ruled.unionByName(decide_scores(rest, suspicious, hostile)).withColumn("level", F.lit(None).cast("int"))


def swept_decision(scores: DataFrame, grid: DataFrame, general: DataFrame | None = None, blend: DataFrame | None = None, n: int = DEFAULT_LEVEL, grid_max: int = GRID_MAX, ceiling: int = SUSPICIOUS_CEILING, suspicious: float = 0.65, hostile: float = 0.9) -> DataFrame:
    """Decision of each id: types with a grid are swept over it, others over the general grid, and without one their classes decide.

    What fires nowhere is benign at level -1, with the p of its general route; a decision without a grid has no level.
    """
    typed = grid.select("file_type").unionByName(blend.select("file_type")) if blend is not None else grid.select("file_type")
    kind = scores.join(F.broadcast(typed.distinct().withColumn("own", F.lit(True))), "file_type", "left")
    mine, rest = kind.where("own").drop("own"), kind.where("own is null").drop("own")
    fired = sweep(mine, grid, blend)
    if general is not None:
        fired = fired.unionByName(sweep_general(rest, general))
        ids = scores
    else:
        ids = mine
    calm = ids.groupBy("id").agg(F.coalesce(F.max(F.when(F.col("route") == "general", F.col("p"))), F.lit(0.0)).alias("general"))
    rows = calm.join(fired, "id", "left")
    cls = F.when(F.col("level").isNull(), 0).when(F.col("level") <= n, 2).when(F.col("level") <= min(grid_max, ceiling), 1).otherwise(0)
    out = rows.select("id", cls.alias("class"), F.coalesce("p", "general").alias("prob"), F.coalesce("level", F.lit(-1)).alias("level"))
    if general is None:
        plain = decide_scores(rest, suspicious, hostile)
        out = out.unionByName(plain.select("id", "class", "prob", F.lit(None).cast("int").alias("level")))
    return out


def decide(scores: DataFrame, grid: DataFrame, n: int = DEFAULT_LEVEL, grid_max: int = GRID_MAX, ceiling: int = SUSPICIOUS_CEILING, blend: DataFrame | None = None) -> DataFrame:
    """:func:`swept_decision` where every type has a grid."""
    return swept_decision(scores, grid, grid.sparkSession.createDataFrame([], "level int, threshold double"), blend, n, grid_max, ceiling)


def mean_members(scores: DataFrame) -> DataFrame:
    """Mean p of a route's seeds: ``(id, route, p)`` with a row for each seed -> ``(id, route, raw)``."""
    return scores.groupBy("id", "route").agg(F.avg("p").alias("raw"))


def mean_of(*scores: Column) -> Column:
    """Mean of a row's seeds, nulls left out, as :func:`mean_members` of rows."""
    known = F.array_compact(F.array(*scores))
    return F.aggregate(known, F.lit(0.0), lambda a, p: a + p) / F.nullif(F.size(known), F.lit(0))


def route_scores(wanted: DataFrame, scored: DataFrame, calibrators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes ``(id, route)`` that apply -> calibrated scores ``(id, route, raw, p)``, and skipped ones with ``why``.

    ``unavailable``: no model scored it; ``uncalibrated``: ``calibrators (route, x, y)`` has nothing for it.
    """
    return calibrated_scores(wanted.join(scored.select("id", "route", "raw"), ["id", "route"], "left"), calibrators)


def calibrated_scores(rows: DataFrame, calibrators: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As :func:`route_scores` of rows ``(id, route, raw)``, raw being null where no model scored."""
    rows = rows.join(F.broadcast(calibrators.select("route").distinct().withColumn("sure", F.lit(True))), "route", "left")
    why = F.when(F.col("raw").isNull(), "unavailable").when(F.col("sure").isNull(), "uncalibrated")
    rows = rows.withColumn("why", why)
    good = calibrate_routes(rows.where("why is null").select("id", "route", "raw"), calibrators)
    return good, rows.where("why is not null").select("id", "route", "why")


def policy_decide(hostile: DataFrame, suspicious: DataFrame) -> DataFrame:
    """Ids whose hostile policy fires are 2, others whose suspicious policy fires 1: ``(id, p, threshold)`` twice -> with ``class``."""
    rest = suspicious.join(hostile.select("id"), "id", "left_anti")
    return hostile.select("id", "p", "threshold", F.lit(2).alias("class")).unionByName(rest.select("id", "p", "threshold", F.lit(1).alias("class")))


def route_class(scores: DataFrame, policy: DataFrame) -> DataFrame:
    """Class of each route on its own: ``policy`` has file_type, route and the OR-rule thresholds ``hostile`` and ``suspicious``, null where a blend decides; those say benign."""
    rows = scores.join(policy, ["file_type", "route"], "left")
    cls = F.when(F.col("p") >= F.col("hostile"), 2).when(F.col("p") >= F.col("suspicious"), 1).otherwise(0)
    return rows.select("id", "route", "p", cls.alias("class"))


def predict_for(classes: DataFrame) -> DataFrame:
    """Greatest p and greatest class over the routes ``(id, p, class)``."""
    return classes.groupBy("id").agg(F.max("p").alias("prob"), F.max("class").alias("class"))


def grade_deps(edges: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each dependency edge ``(report_id, dep)`` with the verdict of its own report; one without a verdict stays null, never benign."""
    return edges.join(verdicts.select(F.col("report_id").alias("dep"), "class", "prob", "level"), "dep", "left").select("report_id", "dep", "class", "prob", "level")


def outrank(members: DataFrame) -> DataFrame:
    """Worst member of each report: class, then p; ties keep the earliest id."""
    best = members.groupBy("report_id").agg(F.max_by(F.struct("file_id", "class", "prob"), F.struct("class", "prob", -F.col("file_id"))).alias("w"))
    return best.select("report_id", F.col("w.file_id").alias("worst"), F.col("w.class").alias("worst_class"), F.col("w.prob").alias("worst_prob"))


def elevate(verdicts: DataFrame, members: DataFrame) -> DataFrame:
    """A report takes its worst member's verdict if that outranks its own."""
    rows = verdicts.join(outrank(members), "report_id", "left")
    up = F.coalesce(F.struct("worst_class", "worst_prob") > F.struct("class", "prob"), F.lit(False)) & F.col("worst").isNotNull()
    return rows.select("report_id", F.when(up, F.col("worst_class")).otherwise(F.col("class")).alias("class"), F.when(up, F.col("worst_prob")).otherwise(F.col("prob")).alias("prob"), F.when(up, F.col("worst")).alias("from_member"))


def first_members(files: DataFrame, limit: int | None = None) -> DataFrame:
    """The members that are scored: all files below the root, or with ``limit`` a report's first ones."""
    inner = files.where("depth > 0")
    if limit is None:
        return inner
    k = F.row_number().over(Window.partitionBy("report_id").orderBy("file_id"))
    return inner.withColumn("k", k).where(F.col("k") <= limit).drop("k")


def score_trees(rows: DataFrame, trees: dict | Ensemble, vec: str = "features", out: str = "raw") -> DataFrame:
    """Scores of an ensemble, or of a dict for :func:`.trees.simple`."""
    return score(rows, simple(trees) if isinstance(trees, dict) else trees, vec, out)


def score_trees_sql(rows: DataFrame, trees: dict, vec: str = "features", out: str = "raw") -> DataFrame:
    """The same as one expression; for small trees."""

    def expr(nodes, k: int = 0) -> Column:
        f, t, left, right, value = nodes[k]
        if f < 0:
            return F.lit(float(value))
        x = F.get(F.col(vec), int(f)).cast("double")
        return F.when((x <= t) | x.isNull() | F.isnan(x), expr(nodes, left)).otherwise(expr(nodes, right))

    total = F.lit(float(trees["base"]))
    for nodes in trees["trees"]:
        total = total + expr(nodes)
    return rows.withColumn(out, 1 / (1 + F.exp(-total)))


def explain(features: DataFrame, importance: DataFrame, limit: int = 5) -> DataFrame:
    """The most important features that a report has, with their values."""
    rows = features.where("value <> 0").join(importance, "name")
    k = F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("importance"), "name"))
    return rows.withColumn("rank", k).where(F.col("rank") <= limit).select("report_id", "rank", "name", "value")


def logit_margin(p: Column, t: Column) -> Column:
    """Log-odds of ``p`` over those of the threshold, both held inside what single precision can tell from 0 and 1."""
    low, high = F.lit(1e-45), F.lit(1 - 2.0**-23)

    def odds(x: Column) -> Column:
        q = F.greatest(low, F.least(high, x))
        return F.log(q / (1 - q))

    return odds(p) - odds(t)


def display_p(p: Column, t: Column) -> Column:
    """Below the cutoff 0 to 50 %, above it 50 to 100 %."""
    return F.when(p < t, 0.5 * p / F.greatest(t, F.lit(1e-9))).otherwise(0.5 + 0.5 * (p - t) / F.greatest(1 - t, F.lit(1e-9)))


def band_progress(p: Column, cls: Column, t: Column) -> Column:
    """How far a score is through its band, 0 to 1: from the cutoff to 1, or for benign ones from 0 to the cutoff."""
    least = F.lit(2.0**-23)
    share = F.when(cls > 0, (p - t) / F.greatest(1 - t, least)).otherwise(p / F.greatest(t, least))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))


def calibrate_grid(grid: DataFrame, breakpoints: DataFrame) -> DataFrame:
    """OR-rule thresholds through their route's calibrator ``(route, x, y)``, or through one ``(x, y)`` for all; those of routes without one stay."""
    if "route" not in breakpoints.columns:
        return calibrate(grid, breakpoints, "threshold", "calibrated").withColumn("threshold", F.col("calibrated")).drop("calibrated")
    points = breakpoints.groupBy("route").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("__bp"))
    rows = _interpolated(grid.join(points, "route", "left").withColumn("__has", F.col("__bp").isNotNull()), "threshold", "__c")
    return rows.withColumn("threshold", F.when(F.col("__has"), F.col("__c")).otherwise(F.col("threshold"))).select(*grid.columns)


def thresholds_at(levels: DataFrame, n: int, ceiling: int = SUSPICIOUS_CEILING, hostile: float = 0.9, suspicious: float = 0.65) -> DataFrame:
    """Per file type and route: hostile threshold at level ``n``, suspicious one at the ceiling, the latter never above; defaults where a level is absent."""
    at = lambda k: F.max(F.when(F.col("level") == k, F.col("threshold")))
    rows = levels.groupBy("file_type", "route").agg(at(n).alias("h"), at(ceiling).alias("s"))
    h = F.coalesce("h", F.lit(hostile))
    return rows.select("file_type", "route", h.alias("hostile"), F.least(h, F.coalesce("s", F.lit(suspicious))).alias("suspicious"))


#: What a feature's prefix says, and path heads that a description leaves out.
_SAYS = {"agg:": "aggregate: ", "ext:": "external: ", "metrics:": "metric: ", "struct:": "structural: "}
_HEADS = "^(objectives|micro-behaviors|well-known|metadata)/"


def describe(name: Column) -> Column:
    """A feature's name in words."""
    rest = F.regexp_replace(name, "^path:", "")
    path, tier = F.regexp_extract(rest, "^(.*):[^:]*$", 1), F.regexp_extract(rest, "([^:]*)$", 1)
    tiered = F.concat(F.replace(F.regexp_replace(path, _HEADS, ""), F.lit("/"), F.lit(" > ")), F.lit(" ["), tier, F.lit("]"))
    out = F.when(name.startswith("path:") & F.contains(rest, F.lit(":")), tiered).when(name.startswith("path:"), F.concat(F.lit("path: "), F.replace(rest, F.lit("/"), F.lit(" > "))))
    for prefix, said in _SAYS.items():
        out = out.when(name.startswith(prefix), F.concat(F.lit(said), F.translate(F.substring(name, len(prefix) + 1, 1000), "_", " ")))
    return out.when(name.startswith("filetype:"), F.concat(F.lit("file type: "), F.substring(name, 10, 1000))).otherwise(name)


def divergent(custom: Column, recommended: Column, most: float = 0.3) -> Column:
    """Whether a custom threshold is off the recommended one by more than a share of it."""
    return F.coalesce((recommended > 0) & (F.abs((custom - recommended) / recommended) > most), F.lit(False))


def importance_matches(importance: DataFrame, names: DataFrame, digest: str) -> DataFrame:
    """``importance`` if ``digest`` is the SHA-256 of the model's feature names ``(pos, name)`` in order, a line each; else none of it."""
    said = names.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda n: n["name"]), "\n"), 256)).scalar()
    return importance.where(said == digest)
