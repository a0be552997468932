"""References to packages and urls: classes, versions, gates, budgets and closure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.session import cut

#: Budgets of a file and of a run.
FILE_REFS, FILE_URLS, FILE_BYTES, RUN_REFS, RUN_BYTES = 100, 4, 2 << 30, 1000, 10 << 30
#: What a registry says of a version that was pulled.
_PULLED = "(?i)yank|withdrawn|unpublish"


def host_of(url: Column) -> Column:
    """Host with port: no scheme, user, path, query or fragment."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://", ""), r"[/?#].*$", "")
    return F.regexp_replace(rest, r"^.*@", "")


def norm_host(host: Column) -> Column:
    """Lower case, no port, no trailing dot."""
    return F.lower(F.regexp_replace(F.regexp_replace(host, r":\d+$", ""), r"\.$", ""))


def under(rows: DataFrame, domains: DataFrame, host: str = "host", out: str = "under") -> DataFrame:
    """Add ``out``: the host is a domain of the list or below one, found by an equi-join of its suffixes."""
    labels = F.split(host, r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    hosts = rows.select(host).distinct().select(host, F.explode(suffix).alias("domain"))
    hit = hosts.join(domains.select("domain").distinct(), "domain").select(host).distinct().withColumn(out, F.lit(True))
    return rows.join(hit, host, "left").na.fill(False, [out])


def publisher(rows: DataFrame, domains: DataFrame, carve_outs: DataFrame, host: str = "host") -> DataFrame:
    """Add ``publisher``: under a listed domain and under none of the carve-outs."""
    said = under(under(rows, domains, host, "__in"), carve_outs, host, "__out")
    return said.withColumn("publisher", F.col("__in") & ~F.col("__out")).drop("__in", "__out")


#: Endings of urls that are pages or site resources.
PAGE_ENDINGS = (
    "asp", "aspx", "atom", "avif", "bmp", "cfm", "cgi", "css", "csv", "dtd", "gif", "htm", "html", "ico", "jpeg", "jpg", "json", "log", "md", "pdf", "php", "png", "rss", "svg", "txt", "webmanifest", "webp", "xml", "xhtml", "yaml", "yml",
)
#: Path components that say that a file is fetched.
DOWNLOAD_PARTS = ("archive", "archives", "attachment", "attachments", "blob", "download", "downloads", "file", "files", "raw", "release", "releases", "resolve")
#: Path components of services.
API_PARTS = ("api", "graphql", "health", "lookup", "metrics", "oauth", "query", "rpc", "search", "status", "token")


def looks_like_download(url: Column) -> Column:
    """An http(s) url that has the shape of a payload's.

    Its last component has a payload's ending, or none and a download component
    among two or more; a service's url must have a download component.
    """
    web = url.rlike(r"^(?i)https?://[^/?#]")
    path = F.regexp_extract(url, r"^[^:]*://[^/?#]*([^?#]*)", 1)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    name = F.lower(F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")))
    ending = F.regexp_extract(name, r"^(?s).+\.([^.]+)$", 1)
    payload = ending.rlike("^[a-z0-9]{1,12}$") & ~ending.isin(*PAGE_ENDINGS)
    explicit = F.exists(parts, lambda p: F.lower(p).isin(*DOWNLOAD_PARTS))
    bare = ~F.contains(name, F.lit(".")) & explicit & (F.size(parts) >= 2)
    service = (F.split_part(norm_host(host_of(url)), F.lit("."), F.lit(1)) == "api") | F.exists(parts, lambda p: F.lower(p).isin(*API_PARTS))
    return F.coalesce(web & ~name.isin("", ".", "..") & (payload | bare) & (~service | explicit), F.lit(False))


def split_purl(locator: Column) -> tuple[Column, Column]:
    """Package and version (null unless it starts with a digit)."""
    v = F.regexp_extract(locator, r"^.+@([0-9][^@]*)$", 1)
    return F.when(v != "", F.regexp_extract(locator, r"^(.+)@[0-9][^@]*$", 1)).otherwise(locator), F.when(v != "", v)


def version_key(version: Column) -> Column:
    """Array that orders as versions do: parts by ``. - _ +``, a number before its rest, numbers above words."""
    parts = F.split(version, r"[.\-_+]")

    def part(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^(\d+)", 1)
        return F.struct((digits != "").cast("int").alias("n"), F.when(digits != "", F.substring(digits, 1, 38).cast("decimal(38,0)")).alias("d"), F.regexp_replace(p, r"^\d+", "").alias("rest"))

    return F.transform(parts, part)


def newest_flag(refs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Add ``newest``: no newer version of its package is asked for; those without a version always are.

    ``seen (package, version)`` has the newest versions of earlier hops, below which nothing is new.
    Keys are made for distinct versions only.
    """
    package, version = split_purl(F.col("locator"))
    rows = refs.withColumn("__p", package).withColumn("__v", version)
    every = rows.select("__p", "__v").where("__v is not null")
    if seen is not None:
        every = every.unionByName(seen.select(F.col("package").alias("__p"), F.col("version").alias("__v")))
    keyed = every.distinct().withColumn("__k", version_key(F.col("__v")))
    best = keyed.groupBy("__p").agg(F.max("__k").alias("__best"))
    # versions that are spelt apart and order alike are both newest
    top = keyed.join(best, "__p").where("__k = __best").select("__p", "__v", F.lit(True).alias("newest"))
    return rows.join(top, ["__p", "__v"], "left").withColumn("newest", F.coalesce("newest", F.col("__v").isNull())).drop("__p", "__v")


def newest_only(refs: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """References to the newest version of their package, and those without a version."""
    return newest_flag(refs, seen).where("newest").select(*refs.columns)


def first_seen(refs: DataFrame, order: list[str]) -> DataFrame:
    """The first reference to each locator."""
    first = refs.groupBy("locator").agg(F.min(F.struct(*order)).alias("o"))
    return first.select("locator", *[F.col(f"o.{c}").alias(c) for c in order])


def go_published(purl: Column) -> Column:
    """Time in a Go pseudo-version's first field of 14 digits; null if it has none."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(purl, r"^pkg:golang/[^@]*@(?:.*?[.-])??(\d{14})(?=[.-]|$)", 1), F.lit("")), F.lit("yyyyMMddHHmmss"))


def age_gate(refs: DataFrame, registry: DataFrame, now: Column, max_age_days: int = 7, rescan_hours: int = 48, good: DataFrame | None = None) -> DataFrame:
    """Add ``reason``, the first that holds: known_good by its own locator, before any record is asked; aged_out by its own date;
    by the record removed, or aged_out, or known_good, unless it was pulled or is new; else keep.

    ``registry``: locator, published, removed, security_hold, deprecated, known_good. ``good (locator)`` has the
    known-good locators. Unknown age keeps.
    """
    rows = refs.join(registry, "locator", "left")
    listed = F.lit(False)
    if good is not None:
        rows, listed = rows.join(good.select("locator").distinct().withColumn("__good", F.lit(True)), "locator", "left"), F.coalesce("__good", F.lit(False))
    limit = now - F.make_interval(days=F.lit(max_age_days))
    pulled = F.coalesce(F.col("security_hold"), F.lit(False)) | F.coalesce(F.col("deprecated").rlike(_PULLED), F.lit(False))
    rescan = pulled | F.coalesce(F.col("published") >= now - F.make_interval(hours=F.lit(rescan_hours)), F.lit(False))
    old, own_old = (F.coalesce(at <= limit, F.lit(False)) for at in (F.col("published"), go_published(F.col("locator"))))
    reason = F.when(listed, "known_good").when(own_old, "aged_out").when(F.coalesce("removed", F.lit(False)), "removed").when(old, "aged_out").when(F.coalesce("known_good", F.lit(False)) & ~rescan, "known_good").otherwise("keep")
    return rows.withColumn("reason", reason).select(*refs.columns, "reason")


def undeclared(refs: DataFrame) -> DataFrame:
    """Packages that a report uses by command and declares nowhere."""
    used = refs.where("kind = 'command'").select("report_id", "package").distinct()
    return used.join(refs.where("kind = 'dependency'").select("report_id", "package"), ["report_id", "package"], "left_anti")


def is_vendored(path: Column) -> Column:
    return F.array_contains(F.split(path, r"[/\\]"), "node_modules")


def apply_budget(refs: DataFrame, per_file: int = FILE_REFS, per_file_urls: int = FILE_URLS, per_file_bytes: int = FILE_BYTES, run_refs: int | None = None, run_bytes: int | None = None) -> DataFrame:
    """Add ``budget``: null within the caps, else which one is over. Nothing is dropped; cached rows are free.

    ``refs``: report_id, file_id, pos, tie, kind, bytes, cached. The caps of a
    run, if given, are those of a report: they count what its files' caps let by.
    """
    live = ~F.col("cached")
    order = Window.partitionBy("report_id", "file_id").orderBy("pos", "tie").rowsBetween(Window.unboundedPreceding, 0)
    n, urls, size = (F.sum(F.when(live & c, v).otherwise(0)).over(order) for c, v in ((F.col("kind") != "url", F.lit(1)), (F.col("kind") == "url", F.lit(1)), (F.lit(True), F.col("bytes"))))
    over = F.when((F.col("kind") == "url") & (urls > per_file_urls), "urls").when((F.col("kind") != "url") & (n > per_file), "refs").when(size > per_file_bytes, "bytes")
    rows = refs.withColumn("budget", F.when(live, over))
    if run_refs is None and run_bytes is None:
        return rows
    paid = live & F.col("budget").isNull()
    run = Window.partitionBy("report_id").orderBy("file_id", "pos", "tie").rowsBetween(Window.unboundedPreceding, 0)
    total, weight = F.sum(paid.cast("int")).over(run), F.sum(F.when(paid, F.col("bytes")).otherwise(0)).over(run)
    late = F.when(total > F.lit(run_refs if run_refs is not None else 1 << 62), "run_refs").when(weight > F.lit(run_bytes if run_bytes is not None else 1 << 62), "run_bytes")
    return rows.withColumn("budget", F.coalesce("budget", F.when(paid, late)))


def closure(roots: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """``roots (locator)``, ``edges (src, dst)`` -> every locator reached and its first hop, up to ``depth``.

    One equi-join for each hop; what was seen is not followed again, so cycles
    end. If edges have an ``outcome``, only those that were fetched (``ok``) or
    whose content differs from its pin (``pin_mismatch``) are followed.
    """
    if "outcome" in edges.columns:
        edges = edges.where("outcome IN ('ok', 'pin_mismatch')")
    seen = cut(roots.select("locator", F.lit(0).alias("hop")).distinct())
    front = seen
    for hop in range(1, depth + 1):
        new = edges.join(front.select(F.col("locator").alias("src")), "src", "left_semi").select(F.col("dst").alias("locator")).distinct()
        front = cut(new.join(seen, "locator", "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.unionByName(front)
    return seen


def close_refs(roots: DataFrame, catalog: DataFrame, members: DataFrame, refs: DataFrame, depth: int = 2, newest: bool = True) -> DataFrame:
    """Everything that reports' references lead to: ``(report_id, locator, hop, source, payload, outcome, path)``.

    ``roots (report_id, source, locator)``: references of the files of a report,
    by content. ``catalog (locator, outcome, payload)``: what fetching a locator
    gives. ``members (payload, file)``: contents within a payload, itself
    included or not. ``refs (file, locator)``: references found in a content.

    A payload that was fetched (``ok``) or differs from its pin
    (``pin_mismatch``) is searched, and each of its member files, for the
    references of the next hop. A locator is followed once in a report, by the
    least path. Only the newest version of a package that the hops so far have
    asked for is followed, within each report. ``path`` has the locators from the
    report on. A locator that the catalog lacks has a null outcome and ends there.
    """
    found = refs.select("file", "locator").distinct()
    inner = members.select("payload", "file").unionByName(members.select("payload", F.col("payload").alias("file"))).distinct()
    own = refs.select(F.col("file").alias("payload"), "file").distinct()
    inner = inner.unionByName(own).distinct()
    work = roots.select("report_id", "source", "locator", F.array("locator").alias("path")).where("locator is not null")
    out, versions = None, None
    for hop in range(depth):
        work = work.groupBy("report_id", "locator").agg(F.min(F.struct("path", "source")).alias("b")).select("report_id", "locator", "b.path", "b.source")
        if newest:
            package, version = split_purl(F.col("locator"))
            bids = work.select("report_id", package.alias("package"), version.alias("version")).where("version is not null").distinct()
            every = bids if versions is None else bids.unionByName(versions)
            keyed = every.distinct().withColumn("k", version_key(F.col("version")))
            best = keyed.groupBy("report_id", "package").agg(F.max("k").alias("best"))
            versions = cut(keyed.join(best, ["report_id", "package"]).where("k = best").select("report_id", "package", "version"))
            kept = versions.withColumn("top", F.lit(True))
            work = work.withColumns({"package": package, "version": version}).join(kept, ["report_id", "package", "version"], "left").where("version is null or top").drop("package", "version", "top")
        if out is not None:
            work = work.join(out, ["report_id", "locator"], "left_anti")
        new = cut(work.join(catalog.select("locator", "outcome", "payload"), "locator", "left").select("report_id", "locator", F.lit(hop).alias("hop"), "source", "payload", "outcome", "path"))
        out = new if out is None else out.unionByName(new)
        if hop + 1 == depth:
            break
        fetched = new.where("outcome IN ('ok', 'pin_mismatch') and payload is not null").select("report_id", "payload", "path")
        nexts = fetched.join(inner, "payload").join(found, "file")
        work = nexts.select("report_id", F.col("file").alias("source"), "locator", F.concat("path", F.array("locator")).alias("path"))
    return out


def backrefs(files: DataFrame, bad: DataFrame) -> DataFrame:
    """Findings on a declaring file and on all of its ``!!`` ancestors for a bad dependency.

    ``bad``: report_id, path (of the declaring file), class, locator.
    """
    parts = F.split("path", "!!")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "!!"))
    rows = bad.select("report_id", F.explode(up).alias("path"), "class", "locator")
    hit = rows.join(files.select("report_id", "path", "file_id"), ["report_id", "path"])
    return hit.groupBy("report_id", "file_id", "locator").agg((F.max("class") + 3).alias("crit"))


def fetched_root(files: DataFrame) -> DataFrame:
    """Nearest ancestor (or self) whose ``rel`` is ``fetched``, walking ``parent_id`` up all rows at once.

    As many rounds as the tree is deep; a file whose ancestors form a ring is an error.
    """
    at = cut(files.select("report_id", "file_id", F.col("file_id").alias("at")))
    known = files.select("report_id", F.col("file_id").alias("at"), "parent_id", "rel")
    most = files.groupBy("report_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    found = [at.limit(0).withColumnRenamed("at", "fetched_root")]
    for _ in range(most + 1):
        rows = cut(at.join(known, ["report_id", "at"]))
        found.append(rows.where("rel = 'fetched'").select("report_id", "file_id", F.col("at").alias("fetched_root")))
        at = rows.where("coalesce(rel, '') <> 'fetched' and parent_id is not null").select("report_id", "file_id", F.col("parent_id").alias("at"))
        if not at.take(1):
            return reduce(DataFrame.unionByName, found)
    raise ValueError("files whose parents form a ring")


def fetch_summary(edges: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return edges.agg(F.count_if(o == "live").alias("live"), F.count_if(o == "cache").alias("cached"), F.count_if(o.startswith("fail")).alias("failed"), F.sum(F.when(o.isin("live", "cache"), F.col("bytes"))).alias("bytes"))

#: Systems and processors by the words for them in package names.
_OS = {
    "darwin": "darwin", "macos": "darwin", "win32": "win32", "windows": "win32", "sunos": "sunos", "solaris": "sunos", "illumos": "sunos", "linux": "linux", "linuxmusl": "linuxmusl", "musllinux": "linuxmusl",
    "webcontainers": "webcontainers", "wasi": "webcontainers", "freebsd": "freebsd", "openbsd": "openbsd", "netbsd": "netbsd", "android": "android", "aix": "aix",
}
_ARCH = {
    "x64": "x64", "x8664": "x64", "amd64": "x64", "arm64": "arm64", "aarch64": "arm64", "ia32": "ia32", "i686": "ia32", "i386": "ia32", "x86": "ia32", "arm": "arm", "ppc64": "ppc64", "s390x": "s390x", "riscv64": "riscv64",
    "loong64": "loong64", "mips64el": "mips64el", "wasm32": "wasm32", "wasm64": "wasm32",
}


def off_platform(purl: Column, os: str, arch: str) -> Column:
    """The first system and processor that stand side by side in a package's name, in either order, are not the target's.

    Names are cut at all that is no letter or digit. A name without such a pair,
    a locator that is no purl, and a target that is not named are never off.
    """
    if not os or not arch:
        return F.lit(False)
    name = F.lower(F.regexp_replace(purl, "(?s)@[^@]*$", ""))
    name = F.regexp_replace(name, "(?<![a-z0-9])x86[^a-z0-9]+64(?![a-z0-9])", "x8664")
    parts = F.filter(F.split(name, "[^a-z0-9]+"), lambda p: p != "")
    kind = lambda words: F.create_map(*[F.lit(x) for pair in words.items() for x in pair])
    system, processor = kind(_OS), kind(_ARCH)
    known = F.transform(parts, lambda p: F.struct(F.element_at(system, p).alias("os"), F.element_at(processor, p).alias("arch")))
    pairs = F.zip_with(known, F.slice(known, F.lit(2), F.greatest(F.size(known), F.lit(1))), lambda a, b: F.when(a["os"].isNotNull() & b["arch"].isNotNull(), F.struct(a["os"].alias("os"), b["arch"].alias("arch"))).when(a["arch"].isNotNull() & b["os"].isNotNull(), F.struct(b["os"].alias("os"), a["arch"].alias("arch"))))
    first = F.get(F.filter(pairs, lambda p: p.isNotNull()), F.lit(0))
    return F.coalesce(purl.startswith("pkg:") & ((first["os"] != os) | (first["arch"] != arch)), F.lit(False))


#: The kinds of reference that each word of a policy selects.
_POLICY = {"urls": ("url",), "packages": ("command",), "deps": ("dependency",), "all": ("url", "command", "dependency"), "none": ()}


def select_kinds(kind: Column, policy: str) -> Column:
    """Whether a policy (``all``, ``none``, or a list of ``urls``, ``packages``, ``deps``) takes a kind; an unknown or empty one is an error."""
    words = [w for w in map(str.strip, policy.split(",")) if w]
    if policy.strip() != "none" and (not words or any(w not in _POLICY or w == "none" for w in words)):
        raise ValueError(f"no fetch selection: {policy!r}")
    return kind.isin(*{k for w in words for k in _POLICY[w]}) if words != ["none"] else F.lit(False)


def discovery_exception(rows: DataFrame, domains: DataFrame, urls: DataFrame, host: str = "host", url: str = "url", out: str = "exception") -> DataFrame:
    """Add ``out``: the host is below one of the extra domains, or the url is one of the exact ones."""
    rows = under(rows, domains, host, "__in").join(urls.select(F.col("url").alias(url)).distinct().withColumn("__exact", F.lit(True)), url, "left")
    return rows.withColumn(out, F.col("__in") | F.coalesce("__exact", F.lit(False))).drop("__in", "__exact")


def resolved_purl(locator: Column, version: Column) -> Column:
    """The locator with the registry's version if it has none; null if it is no purl or there is no version."""
    purl = locator.startswith("pkg:") & (F.length(version) > 0)
    return F.when(purl, F.when(F.contains(F.substring(locator, 5, 10_000), F.lit("@")), locator).otherwise(F.concat(locator, F.lit("@"), version)))


def local_packages(files: DataFrame) -> DataFrame:
    """Roots ``(report_id, root)`` of packages below ``node_modules`` that have their own package.json."""
    root = F.regexp_extract(F.translate("path", "\\", "/"), r"^(.*/node_modules/(?:@[^/]+/[^/]+|[^@/][^/]*))/package\.json$", 1)
    return files.select("report_id", root.alias("root")).where("root <> ''").distinct()


def resolve_local(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``local``: an npm package that a file ``(report_id, path, locator)`` imports lies in ``node_modules`` of one of its folders."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_extract("locator", r"^pkg:npm/([^?]*)", 1), r"(?<=.)@[^@]*$", ""), "%40", "@")
    name = F.regexp_replace(name, "(?i)%2f", "/")
    parts = F.split(F.translate("path", "\\", "/"), "/")
    rows = imports.withColumn("__k", F.xxhash64("report_id", "path", "locator"))
    dirs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    asked = rows.select("report_id", "__k", "path", name.alias("name"), parts.alias("parts")).where("name <> '' and size(parts) > 1").distinct()
    asked = asked.select("report_id", "__k", "name", F.explode(dirs).alias("dir"))
    hit = asked.select("report_id", "__k", F.concat("dir", F.lit("/node_modules/"), "name").alias("root")).join(local_packages(files), ["report_id", "root"], "left_semi")
    return rows.join(hit.select("__k").distinct().withColumn("local", F.lit(True)), "__k", "left").drop("__k").na.fill(False, ["local"])


def merge_root(groups: DataFrame, hunted: DataFrame) -> DataFrame:
    """References ``(report_id, sha, locator)`` of each group, and the hunted ones ``(report_id, locator)`` that the root's group ``(report_id, root_sha)`` in ``hunted`` lacks."""
    new = hunted.select("report_id", F.col("root_sha").alias("sha"), "locator").distinct()
    return groups.select("report_id", "sha", "locator").distinct().unionByName(new.join(groups, ["report_id", "sha", "locator"], "left_anti"))


def outcome_label(outcome: Column, cached: Column, stale: Column, known: Column, status: Column, why: Column) -> tuple[Column, Column]:
    """Label and detail of a fetch: pin!, stale, known, cache, live, budget, skip or fail, the latter with the HTTP status or the first words of the reason."""
    label = F.when(outcome == "pin_mismatch", "pin!").when((outcome == "ok") & stale, "stale").when((outcome == "ok") & known.isin("conflicted", "known_bad", "skip"), "known").when((outcome == "ok") & cached, "cache").when(outcome == "ok", "live")
    label = label.when(outcome == "budget", "budget").when(outcome.isin("unresolved", "skipped"), "skip").otherwise("fail")
    first = F.trim(F.regexp_extract(why, r"^([^\n:]*)", 1))
    detail = F.when(outcome == "pin_mismatch", "hash mismatch").when(outcome == "budget", "over fetch budget").when(outcome == "unresolved", "unresolved").when(outcome == "skipped", "not a target")
    return label, detail.when(label == "fail", F.when(status.isNotNull(), F.concat(F.lit("HTTP "), status)).otherwise(first))


def notable_provenance(nodes: DataFrame, findings: DataFrame, cited: DataFrame) -> DataFrame:
    """Registry nodes ``(report_id, artifact_id, registry_id)`` with a finding of criticality 3 or more, or one on the artifact that cites them ``(report_id, file_id, id, cites)``."""
    grave = findings.where("crit >= 3").select("report_id", "file_id", "id").distinct()
    own = grave.select("report_id", F.col("file_id").alias("registry_id")).distinct()
    said = grave.join(cited, ["report_id", "file_id", "id"]).select("report_id", F.col("file_id").alias("artifact_id"), F.col("cites").alias("registry_id")).distinct()
    return nodes.join(own, ["report_id", "registry_id"], "left_semi").select("report_id", "artifact_id", "registry_id").unionByName(nodes.join(said, ["report_id", "artifact_id", "registry_id"], "left_semi").select("report_id", "artifact_id", "registry_id")).distinct()
