"""Table-level jobs: whole flows over reports, composed of the operators."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators import audits as M
from siftspark.operators import features as X
from siftspark.operators import findings as B
from siftspark.operators import knownsets as K
from siftspark.operators import refs as R
from siftspark.operators import trees as T
from siftspark.operators import verdicts as S
from siftspark.session import drop, stored_by, stored_rows
from siftspark.sources import reports as P
from siftspark.sources.models import ModelTables
from siftspark.sources.reports import envelopes


@dataclass
class Tables:
    """What a run's reports are featurized from; of what is absent, the families are.

    ``files``: report_id, file_id, file_type, size_bytes, depth, parent_id, path,
    risk, entropy, total_lines, mtime, and ``metrics`` (two-level JSON) if there
    are any. ``findings``: report_id, file_id, id, crit, conf, atk, mbc.
    ``imports``: report_id, file_id, lib, name; ``importing``: report_id and
    file_id of the files with imports, if ``imports`` does not say.
    ``symbols``: report_id, file_id, symbol. ``strings``: report_id, file_id, s,
    wide. ``formulas``: report_id, formula (of root files). ``buckets``: all tables are
    :func:`.session.stored_by` report_id in so many buckets, and what is made of
    them is kept likewise.
    """

    files: DataFrame
    findings: DataFrame
    imports: DataFrame | None = None
    importing: DataFrame | None = None
    symbols: DataFrame | None = None
    strings: DataFrame | None = None
    formulas: DataFrame | None = None
    buckets: int | None = None

    def tables(self) -> dict[str, DataFrame | None]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "buckets"}


#: What families read of files.
_FILE_COLUMNS = ("report_id", "file_id", "file_type", "size_bytes", "depth", "parent_id", "path", "risk", "entropy", "total_lines", "mtime", "metrics", "has_imports")


def _vocabulary(spark: SparkSession, names: list[str], prefix: str, sep: str, parts: int) -> DataFrame | None:
    """The n-grams that a spec names under ``prefix``."""
    rows = [tuple(n[len(prefix) :].split(sep)) for n in names if n.startswith(prefix)]
    rows = sorted({r for r in rows if len(r) == parts})
    return F.broadcast(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in "abc"[:parts]))) if rows else None


#: Families whose names come from a vocabulary: without a spec they are not made.
_BY_NAME = ("present", "maxcrit", "ghost", "critbi", "crittri", "tierbi", "tiertri", "atkbi", "atktri", "mbcbi", "mbctri", "bigrams", "unsigned_bigram", "trigram", "symbol_bi", "symbol_tri")


def families(t: Tables, names: list[str] | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """Feature families that the tables allow, as sparse rows ``(report_id, name, value)``.

    ``names`` are those of a spec: families that it does not name are not made,
    and its n-grams and paths are the vocabularies. Those with a prefix of ``skip`` are not made either. Active findings are summed up
    by file and id once, and paths by report; these are written, for every family
    is rolled up from there. ``files`` is read by several families: hand over a
    stored table. Of families with fixed names only those of ``names`` are computed.
    """
    spark = t.files.sparkSession
    wanted = None if names is None else {n.split(":", 1)[0] for n in names}
    want = lambda *prefixes: bool(set(prefixes) - set(skip)) and (bool(set(prefixes) & wanted) if wanted is not None else not set(prefixes) & set(_BY_NAME))
    asked = names or []
    only = None if names is None else set(names)
    files, findings = t.files, t.findings
    keep = lambda rows: stored_by(rows, "report_id", t.buckets, dealt=True)
    ids = findings if "n_active" in findings.columns else keep(B.by_id(findings, bool(t.buckets)))
    paths = keep(B.report_paths(ids))
    per_file = keep(B.file_summary(ids)) if want("struct", "format") else None
    out: list[DataFrame] = []
    if want("agg"):
        out += [X.aggregates(ids, files, paths, only), X.path_cooccurrence(paths, only)]
        if "atk" in findings.columns:
            out.append(X.attack_codes(findings, only))
    if want("struct"):
        importing = t.importing if t.importing is not None else t.imports
        out.append(X.structure(files, per_file, paths, importing, only))
    if want("format"):
        out.append(X.formats(files, per_file, only))
    if want("ext"):
        out.append(X.external(ids, only))
    if want("score", "inter"):
        out.append(X.type_scores(files, only))
    if want("missing"):
        out.append(X.missing_paths(files, paths))
    if want("crit"):
        out.append(X.token_presence(X.crit_tokens(paths)))
    if want("intent_gap"):
        out.append(X.intent_gaps(paths))
    if want("present", "maxcrit", "ghost"):
        words = sorted({n.split(":", 1)[1] for n in asked if n.startswith(("present:", "maxcrit:", "ghost:"))})
        risks = files.groupBy("report_id").agg(F.coalesce(F.max(F.when(F.col("depth") == 0, F.col("risk"))), F.lit(0)).alias("risk"))
        out.append(X.weighted_paths(paths, risks, F.broadcast(spark.createDataFrame([(w,) for w in words], "path string"))))
    grams = [("critbi:", " + ", 2, lambda v: X.token_ngrams(X.crit_tokens(paths), v, "critbi:")), ("crittri:", " + ", 3, lambda v: X.token_ngrams(X.crit_tokens(paths), v, "crittri:", X.TRIPLE_CAP)), ("tierbi:", " + ", 2, lambda v: X.token_ngrams(X.tier_tokens(paths), v, "tierbi:")), ("tiertri:", " + ", 3, lambda v: X.token_ngrams(X.tier_tokens(paths), v, "tiertri:"))]
    grams += [("bigrams:", "+", 2, lambda v: X.path_bigrams(B.file_paths(ids), v)), ("unsigned_bigram:", "+", 2, lambda v: X.unsigned_bigrams(X.path_bigrams(B.file_paths(ids), v), paths)), ("trigram:", "+", 3, lambda v: X.path_trigrams(B.file_paths(ids), v))]
    if "atk" in findings.columns:
        for code in ("atk", "mbc"):
            grams += [(f"{code}bi:", " + ", 2, lambda v, c=code: X.token_ngrams(X.code_tokens(findings, c), v, f"{c}bi:")), (f"{code}tri:", " + ", 3, lambda v, c=code: X.token_ngrams(X.code_tokens(findings, c), v, f"{c}tri:", X.TRIPLE_CAP))]
    if t.symbols is not None:
        grams += [("symbol_bi:", "||", 2, lambda v: X.symbol_ngrams(t.symbols, v)), ("symbol_tri:", "||", 3, lambda v: X.symbol_ngrams(t.symbols, v, "symbol_tri:", 24))]
        if want("symbol"):
            out.append(X.symbol_presence(t.symbols))
    for prefix, sep, parts, make in grams:
        vocab = _vocabulary(spark, asked, prefix, sep, parts)
        if vocab is not None:
            out.append(make(vocab))
    if t.imports is not None and want("gap"):
        tokens = t.imports.select("report_id", F.explode(X.import_tokens(F.col("lib"), F.col("name"))).alias("token"))
        out.append(X.logic_gaps(tokens, paths))
    if "metrics" in files.columns and want("metrics"):
        vocab = spark.createDataFrame([(n.split(":", 1)[1],) for n in asked if n.startswith("metrics:") and not n.startswith("metrics:derived_")], "name string")
        out.append(X.metrics(files.select("report_id").distinct(), X.merged_metrics(files), vocab))
    if "metrics" in files.columns and want("kv"):
        out.append(X.kv_tokens(files))
    if t.strings is not None and want("textenc"):
        out.append(X.text_encoding(t.strings))
    if t.formulas is not None and want("formula", "elements", "rare", "skeleton"):
        out.append(X.formula(t.formulas, ids))
    if not out:
        raise ValueError(f"no family of {sorted(wanted)} can be made from these tables")
    return reduce(DataFrame.unionByName, out)


#: A featurized unit: a report (``file_id`` 0 and not a member), or one of its members alone.
def _unit(member: bool) -> Column:
    return F.struct(F.col("report_id").alias("report_id"), F.lit(member).alias("member"), (F.col("file_id") if member else F.lit(0).cast("long")).cast("long").alias("file_id")).alias("report_id")


def with_members(t: Tables, members: DataFrame) -> Tables:
    """The tables at two grains in one: whole reports, and each of ``members (report_id, file_id)`` alone.

    ``report_id`` becomes a struct of report_id, member and file_id. A member is
    a report of one file: no parent, the path behind the last ``!!``, and neither
    risk nor formula, which belong to root files.
    """

    def both(rows: DataFrame | None, change: dict[str, Column] | None = None, member_rows: bool = True) -> DataFrame | None:
        if rows is None:
            return None
        rest = [c for c in rows.columns if c != "report_id"]
        whole = rows.select(_unit(False), *rest) if "file_id" in rows.columns else rows.select(F.struct(F.col("report_id").alias("report_id"), F.lit(False).alias("member"), F.lit(0).cast("long").alias("file_id")).alias("report_id"), *rest)
        if not member_rows or "file_id" not in rows.columns:
            return whole
        own = rows.join(members.select("report_id", "file_id"), ["report_id", "file_id"], "left_semi")
        own = own.withColumns({c: v for c, v in (change or {}).items() if c in rows.columns})
        return whole.unionByName(own.select(_unit(True), *rest))

    alone = {"parent_id": F.lit(None).cast("long"), "risk": F.lit(0).cast("long"), "path": F.element_at(F.split("path", "!!"), -1)}
    files = t.files.withColumn("risk", F.col("risk").cast("long")) if "risk" in t.files.columns else t.files
    return Tables(both(files, alone), both(t.findings), both(t.imports), both(t.importing), both(t.symbols), both(t.strings), both(t.formulas, member_rows=False))


def featurize(t: Tables, spec: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Reports -> standardized vectors ``(report_id, vector)`` in the order of ``spec``; families that it does not name are not made.

    ``ids``: :func:`.findings.by_id` of the findings, stored, if it is there
    already; of ``t.findings`` codes alone are read then.
    """
    names = [r.name for r in spec.select("name").distinct().collect()]  # a model's names
    codes = [c for c in ("atk", "mbc") if c in t.findings.columns and any(n.startswith((f"{c}bi:", f"{c}tri:")) or n in X.CODE_NAMES for n in names)]
    ids = ids if ids is not None else stored_by(B.by_id(t.findings, bool(t.buckets)), "report_id", t.buckets, dealt=True)
    parts = replace(t, findings=ids)
    made = families(parts, [n for n in names if not n.startswith(("atkbi:", "atktri:", "mbcbi:", "mbctri:"))]) if any(not n.startswith(("atkbi:", "atktri:", "mbcbi:", "mbctri:")) for n in names) else None
    if codes:
        # codes are those of all findings, whatever their confidence
        thin = t.findings.where("atk is not null or mbc is not null or id LIKE 'objectives/%'").select("report_id", "file_id", "id", "conf", "atk", "mbc")
        more = [X.attack_codes(thin, set(names))] if any(n in X.CODE_NAMES for n in names) else []
        for code in ("atk", "mbc"):
            for suffix, parts_, cap in (("bi:", 2, X.PAIR_CAP), ("tri:", 3, X.TRIPLE_CAP)):
                vocab = _vocabulary(t.files.sparkSession, names, code + suffix, " + ", parts_)
                if vocab is not None:
                    more.append(X.token_ngrams(X.code_tokens(thin, code), vocab, code + suffix, cap))
        for rows in more:
            made = rows if made is None else made.unionByName(rows)
    return X.assemble(made, spec, t.files)


@dataclass
class Model:
    """A scoring model: trees by route (one entry for each seed) and its tables.

    ``calibrators``: route, x, y. ``groups``: t, grp, special; ``containers``: t,
    container. ``grid``: file_type, route, level, threshold; ``general``: level,
    threshold, for types without a grid of their own. ``blend`` as in
    :func:`.verdicts.fire_blend`.
    """

    trees: dict[str, list[dict | T.Ensemble]]
    calibrators: DataFrame
    groups: DataFrame
    containers: DataFrame
    grid: DataFrame
    general: DataFrame | None = None
    blend: DataFrame | None = None
    hostile: float = 0.9
    suspicious: float = 0.65


def model_of(tables: ModelTables, containers: DataFrame | None = None, route: str = "general") -> tuple[Model, DataFrame]:
    """A model's tables as a :class:`Model`, and the spec of one route.

    Thresholds of OR rules, and the general route's own, go through their
    route's calibrator, for scores do too; blends and the general levels are
    calibrated already. ``containers``: t, container.
    """
    spark = tables.spec.sparkSession
    special = tables.routes.where("route LIKE 'filetypes/%'").select(F.regexp_replace("route", "^filetypes/", "").alias("t"), F.lit(True).alias("special"))
    groups = tables.groups.join(special, "t", "full").select("t", "grp", F.coalesce("special", F.lit(False)).alias("special"))
    grid = S.calibrate_grid(tables.policies.where("severity = 'hostile'").select("file_type", "route", "level", "threshold"), tables.calibrators)
    blend = tables.blends.where("severity = 'hostile'").drop("severity")
    general = tables.levels.where("severity = 'hostile' and route = 'general'").select("level", "threshold")
    own = S.calibrate_grid(tables.thresholds.where("route = 'general'").selectExpr("route", "inline(array(struct('h' AS k, hostile AS threshold), struct('s' AS k, suspicious AS threshold)))"), tables.calibrators)
    cut = {r.k: r.threshold for r in own.collect()}
    if containers is None:
        containers = spark.createDataFrame([], "t string, container string")
    model = Model(T.from_tables(tables.nodes, tables.leaves, tables.ensembles), tables.calibrators.select("route", "x", "y"), groups, containers, grid, general if general.take(1) else None, blend if blend.take(1) else None, cut.get("h", 0.9), cut.get("s", 0.65))
    return model, tables.spec.where(F.col("route") == route).select("pos", "name", "mean", "std")


def score_reports(vectors: DataFrame, files: DataFrame, model: Model, n: int = S.DEFAULT_LEVEL, buckets: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors -> decisions, route scores and skipped routes.

    ``vectors``: report_id, vector; the root file's type picks the routes.
    Decisions: report_id, class, prob, level, conf. Vectors with their routes
    and scores are written once, for every route and rule reads them again;
    ``buckets`` as in :class:`Tables`.
    """
    keep = lambda rows, key="id": stored_by(rows, key, buckets, dealt=True)
    roots = keep(files.where("depth = 0").select("report_id", "file_id", "file_type"), "report_id")
    routes = S.routes_for(roots, model.groups, model.containers).groupBy("report_id").agg(F.collect_set("route").alias("routes"))
    # a report's vector lies beside its routes once: no route shuffles it again
    each = keep(routes.join(vectors, "report_id", "left").withColumnRenamed("report_id", "id"))
    none = F.filter("routes", lambda r: F.col("vector").isNull() | ~r.isin(*model.trees))
    raw = each.select("id", F.explode(none).alias("route"), F.lit(None).cast("double").alias("raw"))
    for route, seeds in model.trees.items():
        mine = each.where(F.array_contains("routes", route) & F.col("vector").isNotNull())
        for k, trees in enumerate(seeds):
            mine = S.score_trees(mine, trees, "vector", f"s{k}")
        raw = raw.unionByName(mine.select("id", F.lit(route).alias("route"), S.mean_of(*[F.col(f"s{k}") for k in range(len(seeds))]).alias("raw")))
    raw = keep(raw)
    scores, skipped = S.calibrated_scores(raw, model.calibrators)
    scores = keep(scores)
    typed = scores.join(roots.select(F.col("report_id").alias("id"), S.norm_type(F.col("file_type")).alias("file_type")), "id")
    decided = S.swept_decision(typed, model.grid, model.general, model.blend, n, hostile=model.hostile, suspicious=model.suspicious)
    out = decided.select(F.col("id").alias("report_id"), "class", "prob", "level", S.level_conf(F.col("level")).alias("conf"))
    return out, scores.withColumnRenamed("id", "report_id"), skipped.withColumnRenamed("id", "report_id")


def rollup(verdicts: DataFrame, files: DataFrame, findings: DataFrame, members: DataFrame, bad_refs: DataFrame | None = None, n: int | None = S.DEFAULT_LEVEL, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Floor by the root file's findings, then by the worst member -> final verdicts; and the findings that bad dependencies add to files and their ancestors.

    ``members``: report_id, file_id, class, prob, level; ``bad_refs``: report_id, path, class, locator.
    """
    own = findings.join(files.where("depth = 0").select("report_id", "file_id"), ["report_id", "file_id"], "left_semi")
    floored = stored_by(S.trait_floor(verdicts.select("report_id", "class", "prob", "level"), own, n), "report_id", buckets, dealt=True)
    raised = S.elevate(floored, members).join(floored.select("report_id", F.col("level").alias("own_level")), "report_id")
    levels = members.select("report_id", F.col("file_id").alias("from_member"), F.col("level").alias("member_level"))
    level = F.when(F.col("from_member").isNotNull(), F.col("member_level")).otherwise(F.col("own_level"))
    final = raised.join(levels, ["report_id", "from_member"], "left").select("report_id", "class", "prob", "from_member", level.alias("level"))
    extra = R.backrefs(files, bad_refs) if bad_refs is not None else files.sparkSession.createDataFrame([], "report_id long, file_id long, locator string, crit int")
    return final.withColumn("conf", S.level_conf(F.col("level"))), extra


def member_verdicts(files: DataFrame, findings: DataFrame, decided: DataFrame | None = None, limit: int | None = None, n: int | None = S.DEFAULT_LEVEL) -> DataFrame:
    """Verdicts of a report's files below its root: the model's (``decided``: report_id, file_id, class, prob, level), floored by the member's own findings.

    A member that the model did not reach starts benign. With ``limit`` only a
    report's first members have verdicts.
    """
    inner = S.first_members(files, limit).select("report_id", "file_id")
    own = findings.join(inner, ["report_id", "file_id"], "left_semi").select("report_id", "file_id", "crit", "conf")
    start = inner.withColumns({"class": F.lit(0), "prob": F.lit(0.0), "level": F.lit(-1) if n is not None else F.lit(None).cast("int")})
    if decided is not None:
        known = decided.select("report_id", "file_id", *[F.col(c).alias(f"m_{c}") for c in ("class", "prob", "level")], F.lit(True).alias("known"))
        rows = inner.join(known, ["report_id", "file_id"], "left")
        start = rows.select("report_id", "file_id", F.coalesce("m_class", F.lit(0)).alias("class"), F.coalesce("m_prob", F.lit(0.0)).alias("prob"), F.when(F.col("known"), F.col("m_level")).otherwise(F.lit(-1) if n is not None else F.lit(None).cast("int")).alias("level"))
    return S.trait_floor(start, own, n, keys=("report_id", "file_id"))


def gate_known(artifacts: DataFrame, keys: DataFrame, mode: str = "balanced", key: str = "sha256", **fresh) -> tuple[DataFrame, DataFrame]:
    """Artifacts with their decision and whether they are scanned, and the tally."""
    gated = K.gate(K.decide(artifacts, keys, key), mode, **fresh)
    return gated, K.tally(gated)


class Run(NamedTuple):
    """What a run over a corpus gives: final verdicts of the reports that were scanned, the summary, members' verdicts, the findings that bad dependencies add, and envelopes."""

    verdicts: DataFrame
    summary: DataFrame
    members: DataFrame
    backrefs: DataFrame
    envelopes: DataFrame


def score_corpus(t: Tables, spec: DataFrame, model: Model, keys: DataFrame, n: int = S.DEFAULT_LEVEL, fetched: DataFrame | None = None, raw: DataFrame | None = None, llm: DataFrame | None = None, limit: int | None = None) -> Run:
    """Gate, featurize, score and roll up.

    Reports and their members (with ``limit`` their first ones) are featurized and scored in one
    pass, each member by the routes of its own type. ``fetched``: report_id,
    sha256, path, locator, the content that a reference of the file at ``path``
    fetched; where a member with that content is suspicious or hostile, the
    file and its ancestors get a finding. ``raw (report_id, raw)`` and
    ``llm (report_id, llm)`` are JSON for the envelopes.
    """
    roots = t.files.where("depth = 0").select("report_id", "sha256")
    gated, _ = gate_known(roots, keys)
    keep = lambda rows, dealt=True: stored_by(rows, "report_id", t.buckets, dealt)
    scanned = keep(gated.where("scan").select("report_id"), False)
    # tables in buckets are stored already and are told apart where they are read
    mine_only = lambda rows: rows.join(scanned, "report_id", "left_semi") if t.buckets else stored_rows(rows.join(scanned, "report_id", "left_semi"))
    t = Tables(**{k: None if rows is None else mine_only(rows) for k, rows in t.tables().items()}, buckets=t.buckets)
    inner = keep(S.first_members(t.files, limit).select("report_id", "file_id"))
    # findings are summed up by id before each stands for a report and for a member; of the others, codes are read, and of their ids whether they are objectives
    ids = keep(B.by_id(t.findings, bool(t.buckets)))
    codes = t.findings.select("report_id", "file_id", F.substring("id", 1, len("objectives/")).alias("id"), *[c for c in ("conf", "atk", "mbc") if c in t.findings.columns])
    two, two_ids = with_members(replace(t, findings=codes), inner), with_members(Tables(t.files, ids), inner).findings
    # of paths the families read the suffix
    shape = two.files.withColumn("path", F.regexp_extract("path", r"\.[^.]*$", 0)) if "path" in two.files.columns else two.files
    two = replace(two, files=keep(shape.select(*[c for c in _FILE_COLUMNS if c in shape.columns]), False), findings=keep(two.findings, False), buckets=t.buckets)
    two_ids = keep(two_ids, False)
    drop(ids)
    decided, scores, skipped = score_reports(featurize(two, spec, two_ids), two.files.withColumn("depth", F.when(F.col("report_id.member"), 0).otherwise(F.col("depth"))), model, n, t.buckets)
    flat = keep(decided.select("report_id.report_id", "report_id.member", "report_id.file_id", "class", "prob", "level", "conf"), False)
    drop(two_ids, two.findings)
    whole = flat.where("not member").drop("member", "file_id")
    members = flat.where("member").select("report_id", "file_id", "class", "prob", "level")
    members = keep(member_verdicts(t.files, t.findings, members, limit, n))
    bad = None
    if fetched is not None:
        shas = members.where("class > 0").join(t.files.select("report_id", "file_id", "sha256"), ["report_id", "file_id"])
        # few rows, kept for hashes are wide and are not shuffled for them
        bad = keep(shas.select("report_id", "sha256", "class").join(fetched, ["report_id", "sha256"]).groupBy("report_id", "path", "locator").agg(F.max("class").alias("class")))
    final, extra = rollup(whole, t.files, t.findings, members, bad, n, t.buckets)
    final = keep(final)
    mine = lambda rows: rows.where("not report_id.member").withColumn("report_id", F.col("report_id.report_id"))
    lines = envelopes(final, P.ml_files(t.files, members, final), mine(scores), mine(skipped), raw, llm)
    return Run(final, M.summary(final), members, extra, lines)


def build_known_sets(pool: DataFrame, previous: DataFrame, rate: float = 1e-4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pool -> key sets with what is known bad taken out of the good, filter words by kind and label, and violations against the previous counts."""
    keys = K.subtract(K.key_sets(pool))
    sizes = keys.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n"))
    words = None
    for r in sizes.collect():  # two kinds, two labels
        hashes, bits = K.bloom_params(r.n, rate)
        mine = K.bloom_build(keys.where((F.col("kind") == r.kind) & (F.col("label") == r.label)).select("key"), hashes, bits)
        mine = mine.select(F.lit(r.kind).alias("kind"), F.lit(r.label).alias("label"), F.lit(hashes).alias("hashes"), F.lit(bits).alias("n_bits"), "word", "bits")
        words = mine if words is None else words.unionByName(mine)
    if words is None:
        words = pool.sparkSession.createDataFrame([], "kind string, label string, hashes int, n_bits long, word long, bits long")
    return keys, words, K.verify_build(sizes, previous)


def triage_refs(refs: DataFrame, registry: DataFrame, now: Column, policy: str = "all", os: str = "linux", arch: str = "x64", good: DataFrame | None = None, boilerplate: DataFrame | None = None, **caps: int) -> DataFrame:
    """Every reference with what becomes of it: ``fate`` is kept, or the first gate that stops it.

    ``refs``: report_id, file_id, pos, tie, kind, locator, path, bytes, cached.
    Gates in order: kind, vendored, boilerplate (``boilerplate (locator)`` lists
    publishers' own urls), not_download (a url that has no payload's shape),
    platform, older (a newer version of the package is asked for by a reference
    that the policy takes), repeated (the locator was seen before), known_good,
    removed, aged_out, and the budget caps; a capped reference is marked, not
    dropped. Null ids and positions are values like any others.
    """
    wanted = R.select_kinds(F.col("kind"), policy)
    listed = F.lit(False)
    rows = refs
    if boilerplate is not None:
        rows, listed = rows.join(boilerplate.select("locator").distinct().withColumn("__own", F.lit(True)), "locator", "left"), F.coalesce("__own", F.lit(False))
    first = F.when(~wanted, "kind").when(F.coalesce(R.is_vendored(F.col("path")), F.lit(False)), "vendored").when(listed, "boilerplate").when((F.col("kind") == "url") & ~R.looks_like_download(F.col("locator")), "not_download").when(R.off_platform(F.col("locator"), os, arch), "platform")
    # each gate reads what the one before let by more than once: it is written, or every gate would double the plan
    rows = stored_rows(rows.withColumn("fate", first).select(*refs.columns, "fate"))
    # what is not asked for does not bid for the newest version
    bids = F.col("fate").isNull() | (F.col("fate") == "platform")
    bid = R.newest_flag(rows.where(bids)).withColumn("fate", F.coalesce("fate", F.when(~F.col("newest"), "older"))).drop("newest").select(*refs.columns, "fate")
    rows = stored_rows(rows.where(~bids).unionByName(bid))
    order = ["report_id", "file_id", "pos", "tie"]
    open_ = rows.where("fate is null").drop("fate")
    seen = R.first_seen(open_, order).select("locator", *[F.col(c).alias(f"__{c}") for c in order], F.lit(True).alias("__first"))
    same = [F.col("o.locator").eqNullSafe(F.col("s.locator")), *[F.col(f"o.{c}").eqNullSafe(F.col(f"s.__{c}")) for c in order]]
    open_ = stored_rows(open_.alias("o").join(seen.alias("s"), reduce(lambda x, y: x & y, same), "left").select("o.*", F.when(F.col("s.__first").isNull(), "repeated").alias("fate")))
    aged = R.age_gate(open_.where("fate is null").drop("fate"), registry, now, good=good)
    aged = stored_rows(aged.withColumn("fate", F.when(F.col("reason") != "keep", F.col("reason"))).drop("reason"))
    capped = R.apply_budget(aged.where("fate is null").drop("fate"), **caps)
    kept = capped.withColumn("fate", F.coalesce(F.concat(F.lit("budget:"), "budget"), F.lit("kept"))).drop("budget")
    columns = [*refs.columns, "fate"]
    parts = [rows.where("fate is not null"), open_.where("fate is not null"), aged.where("fate is not null"), kept]
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def evaluate(decisions: DataFrame, truth: DataFrame, levels: DataFrame) -> DataFrame:
    """Operating table: decisions ``(report_id, level)`` against ``truth (report_id, bad)`` at each level."""
    return M.level_report(decisions.join(truth, "report_id").select("level", "bad"), levels)


def audit_runs(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Reports whose fingerprint differs between two runs, each ``(verdicts, members)``."""
    return M.diff_runs(M.fingerprint(*a), M.fingerprint(*b))
