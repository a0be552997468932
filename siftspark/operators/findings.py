"""Findings: filter, paths, summaries by file and by report, and short lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least confidence of an active finding.
MIN_CONF = 0.65


def active(findings: DataFrame, min_conf: float = MIN_CONF) -> DataFrame:
    """Findings with an id and enough confidence, compared as given."""
    return findings.where((F.col("id") != "") & (F.col("conf") >= min_conf))


def base_id(id_: Column) -> Column:
    """The id before ``::``."""
    return F.split_part(id_, F.lit("::"), F.lit(1))


def finding_paths(id_: Column) -> Column:
    """Distinct prefixes of one, two and three levels of the id before ``::``."""
    base = base_id(id_)
    return F.array_distinct(F.array(*[F.substring_index(base, "/", n) for n in (1, 2, 3)]))


def _graded(findings: DataFrame) -> DataFrame:
    """Active findings, or what :func:`by_id` has kept of them: id, crit and conf."""
    if "n_active" in findings.columns:
        return findings.select("report_id", "file_id", "id", F.col("max_crit").alias("crit"), F.col("max_conf").alias("conf"))
    return active(findings)


def path_stats(findings: DataFrame) -> DataFrame:
    """Greatest criticality and confidence of each path of a file."""
    paths = _graded(findings).select("report_id", "file_id", F.explode(finding_paths(F.col("id"))).alias("path"), "crit", "conf")
    return paths.groupBy("report_id", "file_id", "path").agg(F.max("crit").alias("max_crit"), F.max("conf").alias("max_conf"))


def by_id(findings: DataFrame, dealt: bool = False) -> DataFrame:
    """Active findings of a file summed up by id: the one grain from which files and reports are rolled up.

    A table that is of this grain already stays as it is, so that it can be written once and rolled up often.
    ``dealt``: rows of a report lie together already.
    """
    if "n_active" in findings.columns:
        return findings
    count = lambda c: F.count_if(F.col("crit") >= c)
    # rows of a report lie together, so that what is rolled up from here shuffles no more than its result
    rows = active(findings) if dealt else active(findings).repartition("report_id")
    return rows.groupBy("report_id", "file_id", "id").agg(
        F.count(F.lit(1)).alias("n_active"), count(3).alias("notable"), count(4).alias("suspicious"), count(5).alias("hostile"),
        F.max("crit").alias("max_crit"), F.max("conf").alias("max_conf"), F.sum("conf").alias("conf"),
    )


def _tier_counts() -> list[Column]:
    """Of rows with one id each, so that distinct ids are rows."""
    out = [F.sum("n_active").alias("n_active"), F.max("max_crit").alias("max_crit")]
    for name in ("notable", "suspicious", "hostile"):
        out += [F.sum(name).alias(name), F.count_if(F.col(name) > 0).alias(f"unique_{name}")]
    for name, prefix in (("third_party", "third_party/"), ("well_known", "well-known/")):
        mine = F.col("id").startswith(prefix)
        out += [F.sum(F.when(mine, F.col("n_active")).otherwise(0)).alias(f"n_{name}"), F.coalesce(F.max(F.when(mine, F.col("max_crit"))), F.lit(0)).alias(f"max_{name}")]
    known = F.col("id").startswith("well-known/")
    out += [F.sum(F.when(known, F.col("hostile")).otherwise(0)).alias("well_known_hostile"), F.sum(F.when(known, F.col("suspicious") - F.col("hostile")).otherwise(0)).alias("well_known_suspicious")]
    return [*out, F.bool_or(F.col("id").startswith("third_party/yara")).alias("has_yara")]


def file_summary(findings: DataFrame) -> DataFrame:
    """Counts by tier, distinct ids by tier, third-party and well-known findings, and whether a rule file matched, of each file."""
    return by_id(findings).groupBy("report_id", "file_id").agg(*_tier_counts())


def report_tiers(findings: DataFrame) -> DataFrame:
    """As :func:`file_summary` for whole reports; an id in several files is one id."""
    ids = by_id(findings).groupBy("report_id", "id").agg(*[F.sum(c).alias(c) for c in ("n_active", "notable", "suspicious", "hostile")], F.max("max_crit").alias("max_crit"))
    return ids.groupBy("report_id").agg(*_tier_counts())


def report_summary(findings: DataFrame) -> DataFrame:
    """:func:`report_tiers` with ``n_files``, the number of files that have active findings."""
    files = by_id(findings).groupBy("report_id", "file_id").agg(F.lit(1)).groupBy("report_id").agg(F.count(F.lit(1)).alias("n_files"))
    return report_tiers(findings).join(files, "report_id")


def file_tiers(findings: DataFrame) -> DataFrame:
    """Active findings of each file and those of its tiers: what of :func:`file_summary` needs no ids."""
    rows = by_id(findings) if "n_active" in findings.columns else active(findings).select(
        "report_id", "file_id", F.lit(1).cast("long").alias("n_active"), *[(F.col("crit") >= c).cast("long").alias(n) for n, c in (("notable", 3), ("suspicious", 4), ("hostile", 5))])
    return rows.groupBy("report_id", "file_id").agg(*[F.sum(c).alias(c) for c in ("n_active", "notable", "suspicious", "hostile")])


def report_paths(findings: DataFrame) -> DataFrame:
    """Greatest criticality and confidence of each path of a report."""
    paths = _graded(findings).select("report_id", F.explode(finding_paths(F.col("id"))).alias("path"), "crit", "conf")
    return paths.groupBy("report_id", "path").agg(F.max("crit").alias("max_crit"), F.max("conf").alias("max_conf"))


def category_breadth(paths: DataFrame, keys: tuple[str, ...] = ("report_id",)) -> DataFrame:
    """Top-level categories that reach criticality 2, 4 and 5: a path of one level has the greatest of all below it."""
    top = ~F.contains("path", F.lit("/"))
    return paths.groupBy(*keys).agg(*[F.count_if(top & (F.col("max_crit") >= c)).alias(n) for n, c in (("categories", 2), ("suspicious_categories", 4), ("hostile_categories", 5))])


def file_risk(files: DataFrame, findings: DataFrame) -> DataFrame:
    """Shares of a file's active findings and densities by KB (at least 1); files without findings have zeros."""
    n, kb = F.greatest(F.lit(1), "n_active"), F.greatest(F.lit(1.0), F.col("size_bytes") / 1024)
    rows = files.join(file_summary(findings), ["report_id", "file_id"], "left").na.fill(0, ["n_active", "suspicious", "hostile", "max_crit"])
    return rows.select(
        "report_id", "file_id", "max_crit", "suspicious", "hostile", (F.col("suspicious") / n).alias("suspicious_ratio"), (F.col("hostile") / n).alias("hostile_ratio"),
        (F.col("suspicious") / kb).alias("suspicious_density"), (F.col("hostile") / kb).alias("hostile_density"),
    )


def top_risk(risk: DataFrame) -> DataFrame:
    """A report's riskiest file by suspicion, by hostility, and by weighted density; ties go to the smallest file id."""
    first = -F.col("file_id")
    weighted = F.col("hostile_density") + 0.25 * F.col("suspicious_density")
    pick = lambda *key: F.max_by("file_id", F.struct(*[F.round(k, 9) for k in key], first))
    return risk.groupBy("report_id").agg(
        pick("suspicious_ratio", "suspicious", "hostile_ratio", "hostile").alias("suspicious_file"), pick("hostile_ratio", "hostile", "suspicious_ratio", "suspicious").alias("hostile_file"),
        pick(weighted, "hostile_density", "suspicious_density").alias("weighted_file"), F.max(weighted).alias("weighted_density"),
    )


def file_paths(findings: DataFrame) -> DataFrame:
    """Sorted distinct base ids, at full depth, of a file's active findings of criticality 3 or more."""
    rows = _graded(findings).where("crit >= 3")
    return rows.groupBy("report_id", "file_id").agg(F.array_sort(F.collect_set(base_id(F.col("id")))).alias("paths"))


def finding_counts(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Counts by criticality in a report's root file, whatever the confidence."""
    root = files.where("depth = 0").select("report_id", "file_id")
    rows = root.join(findings, ["report_id", "file_id"], "left")
    tier = lambda c: F.count_if(F.col("crit") == c)
    return rows.groupBy("report_id").agg(tier(5).alias("hostile"), tier(4).alias("suspicious"), tier(3).alias("notable"), F.count_if(F.col("crit") < 3).alias("baseline"))


def top_findings(findings: DataFrame, verdicts: DataFrame, limit: int = 5) -> DataFrame:
    """The first finding of each base id, most critical first.

    Hostile reports show criticality 5, or 4 if they have none of 5; others show 4 and more.
    """
    rows = findings.join(verdicts.select("report_id", "class"), "report_id").where("crit >= 4").withColumn("base", base_id(F.col("id")))
    most = F.max("crit").over(Window.partitionBy("report_id"))
    rows = rows.withColumn("most", most).where((F.col("class") < 2) | (F.col("most") < 5) | (F.col("crit") >= 5))
    order = ["pos", "tie", "file_id", "id"]
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("report_id", "base").orderBy(*order))).where("k = 1")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("crit"), *order)))
    return rows.where(F.col("rank") <= limit).select("report_id", "rank", "id", "crit")


def member_top(findings: DataFrame, limit: int = 3) -> DataFrame:
    """A file's first findings of criticality 4 or more."""
    order = Window.partitionBy("report_id", "file_id").orderBy("pos", "tie", "id")
    return findings.where("crit >= 4").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("report_id", "file_id", "rank", "id", "crit")


def integrity(files: DataFrame, cited: DataFrame) -> DataFrame:
    """Citations ``(report_id, file_id, cites)`` of files that the report does not have."""
    there = files.select("report_id", F.col("file_id").alias("cites"))
    return cited.join(there, ["report_id", "cites"], "left_anti").select("report_id", "file_id", "cites")


def lone_sidecars(files: DataFrame) -> DataFrame:
    """Sidecars ``(report_id, file_id)`` that hang on no file."""
    there = files.select("report_id", F.col("file_id").alias("parent_id")).withColumn("__there", F.lit(True))
    return files.where("role = 'sidecar'").join(there, ["report_id", "parent_id"], "left").where("__there is null").select("report_id", "file_id")


def retain(files: DataFrame, findings: DataFrame, top: int = 3, cited: DataFrame | None = None) -> DataFrame:
    """Files worth keeping: root, the riskiest few, those with a finding of criticality 3 or more, and those of no type or of the registry's.

    ``cited (report_id, file_id, id, cites)``: files that a finding refers to
    are kept as well if it has that criticality.
    """
    grave = findings.where("crit >= 3").select("report_id", "file_id").distinct().withColumn("grave", F.lit(True))
    rank = F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("risk"), "file_id"))
    rows = files.withColumn("rank", rank).join(grave, ["report_id", "file_id"], "left")
    keep = (F.col("depth") == 0) | (F.col("file_id") == 0) | (F.col("rank") <= top) | F.coalesce("grave", F.lit(False))
    if "file_type" in files.columns:
        keep = keep | F.coalesce("file_type", F.lit("")).isin("", "registry")
    if cited is not None:
        by = findings.where("crit >= 3").select("report_id", "file_id", "id").distinct()
        named = by.join(cited, ["report_id", "file_id", "id"]).select("report_id", F.col("cites").alias("file_id")).distinct().withColumn("named", F.lit(True))
        rows = rows.join(named, ["report_id", "file_id"], "left")
        keep = keep | F.coalesce("named", F.lit(False))
    return rows.where(keep).select("report_id", "file_id", "rank")


def append_listing(files: DataFrame, listing: DataFrame) -> DataFrame:
    """Members known by name only ``(report_id, sha256, path)`` join the files with risk -1 and new ids."""
    root = F.when(F.col("depth") == 0, F.col("path"))
    none = F.lit(None).cast("string")
    # names and files by content in one grouping: hashes do not compress, so that each is shuffled once
    named = listing.select("report_id", "sha256", "path", F.lit(None).cast("long").alias("last"), none.alias("root"))
    known = files.select("report_id", "sha256", none.alias("path"), F.col("file_id").cast("long").alias("last"), root.alias("root"), F.lit(True).alias("there"))
    # an unknown content is that of no other file
    rows = named.withColumn("there", F.lit(False)).unionByName(known).groupBy("report_id", "sha256").agg(
        F.min("path").alias("path"), F.bool_or(~F.col("there")).alias("listed"), F.bool_or(F.col("there") & F.col("sha256").isNotNull()).alias("there"), F.max("last").alias("last"), F.max("root").alias("root"))
    report = Window.partitionBy("report_id")
    rows = rows.withColumn("last", F.max("last").over(report)).withColumn("root", F.max("root").over(report)).where("listed and not there and last is not null")
    k = F.row_number().over(report.orderBy("path", "sha256"))
    path = F.concat("root", F.lit("!!"), "path")
    new = rows.select("report_id", (F.col("last") + k).alias("file_id"), path.alias("path"), "sha256", F.lit(-1).alias("risk"), F.regexp_count(path, F.lit("!!")).alias("depth"))
    return files.select("report_id", "file_id", "path", "sha256", "risk", "depth").unionByName(new)


def group_by_content(entries: DataFrame) -> DataFrame:
    """``(sha256, path, pid, deleted)`` by content: first path, sorted ids, whether any is deleted."""
    return entries.groupBy("sha256").agg(F.min("path").alias("path"), F.array_sort(F.collect_list("pid")).alias("pids"), F.bool_or("deleted").alias("deleted"))


def graft_subtrees(files: DataFrame, subs: DataFrame, edges: DataFrame) -> DataFrame:
    """Files of fetched payloads and registry records appended to their reports, whole subtrees renamed.

    ``edges (report_id, sub_id, kind, source, locator, resolved_url)``: what was
    fetched, in order of ``sub_id``, for the file whose content is ``source``.
    ``subs (report_id, sub_id, file_id, parent_id, depth, path, sha256, rel,
    role)`` has their files. Ids go on behind those of the report and of the
    subtrees before. A subtree hangs on the first file of its source, or on file
    0. The root of a ``fetched`` one has rel ``fetched`` and ``via``, the url or
    else the locator, and its path, and those behind it and ``!!``, begin with
    the locator; that of a ``registry`` one has rel ``registry`` and role
    ``sidecar``. ``files`` needs rel, role and via too.
    """
    key = ["report_id", "sub_id"]
    sizes = subs.groupBy(*key).agg((F.max("file_id") + 1).alias("n"), F.min_by("path", F.when(F.col("parent_id").isNull(), F.col("file_id"))).alias("old"))
    # one row for each thing that a report fetched, of which its budget allows a thousand
    before = Window.partitionBy("report_id").orderBy("sub_id").rowsBetween(Window.unboundedPreceding, -1)
    last = files.groupBy("report_id").agg((F.max("file_id") + 1).alias("next"))
    sizes = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(last, "report_id", "left").withColumn("base", F.coalesce("next", F.lit(0)) + F.col("before"))
    at = files.groupBy("report_id", F.col("sha256").alias("source")).agg(F.min(F.struct("file_id", "depth")).alias("at"))
    way = edges.join(at, ["report_id", "source"], "left").join(sizes, key)
    way = way.select(*key, "kind", "base", "old", F.coalesce("at.file_id", F.lit(0)).alias("under"), F.coalesce("at.depth", F.lit(0)).alias("deep"), "locator", F.coalesce(F.nullif("resolved_url", F.lit("")), F.nullif("locator", F.lit(""))).alias("url"))
    rows = subs.join(way, key)
    root, fetched = F.col("parent_id").isNull(), F.col("kind") == "fetched"
    named = fetched & (F.coalesce("old", F.lit("")) != "") & (F.coalesce("locator", F.lit("")) != "")
    tail = F.expr("substring(path, length(old) + 1)")
    path = F.when(named & ((F.col("path") == F.col("old")) | F.col("path").startswith(F.concat("old", F.lit("!!")))), F.concat("locator", tail)).otherwise(F.col("path"))
    moved = rows.select(
        "report_id", (F.col("file_id") + F.col("base")).alias("file_id"), F.coalesce(F.col("parent_id") + F.col("base"), F.col("under")).alias("parent_id"), (F.col("depth") + F.col("deep") + 1).alias("depth"), path.alias("path"), "sha256",
        F.when(root & fetched, "fetched").when(root & (F.col("kind") == "registry"), "registry").otherwise(F.col("rel")).alias("rel"), F.when(root & (F.col("kind") == "registry"), "sidecar").otherwise(F.col("role")).alias("role"), F.when(root & fetched, F.col("url")).alias("via"),
    )
    return files.select(*moved.columns).unionByName(moved)


def graft(parents: DataFrame, subs: DataFrame) -> DataFrame:
    """Files of sub-reports ``(report_id, under, ...)`` appended below file ``under`` of their parents.

    Ids move behind the parent's largest, depths below the parent file, roots hang on ``under``.
    """
    last = parents.groupBy("report_id").agg(F.max("file_id").alias("last"))
    at = parents.select("report_id", F.col("file_id").alias("under"), F.col("depth").alias("base"))
    moved = subs.join(last, "report_id").join(at, ["report_id", "under"]).select(
        "report_id", (F.col("file_id") + F.col("last") + 1).alias("file_id"), (F.col("depth") + F.col("base") + 1).alias("depth"),
        F.coalesce(F.col("parent_id") + F.col("last") + 1, F.col("under")).alias("parent_id"), "sha256",
    )
    return parents.select("report_id", "file_id", "depth", "parent_id", "sha256").unionByName(moved)


def top_offenders(members: DataFrame, n: int) -> DataFrame:
    """A report's ``n`` members of highest probability; ties go to the smallest file id."""
    k = F.row_number().over(Window.partitionBy("report_id").orderBy(F.desc("prob"), "file_id"))
    return members.withColumn("rank", k).where(F.col("rank") <= n).select("report_id", "rank", "file_id", "prob")


def sub_findings(findings: DataFrame, subs: DataFrame) -> DataFrame:
    """All findings of the files of each sub-report ``(report_id, file_id, sub)``, whichever file has them."""
    return findings.join(subs, ["report_id", "file_id"]).select("sub", "id", "crit", "conf")
