"""Stored reports: reading, flattening, envelopes, pools, provenance and bad input."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftspark.operators.knownsets import parse_sha256
from siftspark.operators.verdicts import level_conf

FINDING = "struct<id:string,crit:int,conf:double,desc:string,atk:string,mbc:string,from:array<int>>"
FILE = f"struct<id:bigint,path:string,type:string,sha:string,size:bigint,risk:bigint,depth:int,parent:bigint,rel:string,role:string,findings:array<{FINDING}>,metrics:string,imports:string,exports:string,functions:string,targets:string,members:string,strings:string,refs:string>"
REPORT = f"report_id bigint, files array<{FILE}>, _corrupt_record string"
#: Fixed value: most bytes of a registry record kept in a sidecar.
RAW_LIMIT = 256 << 10


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON reports with a fixed schema; unreadable lines are kept in ``_corrupt_record``."""
    return spark.read.schema(REPORT).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def quarantine(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Readable reports, and the failed lines as records of their own."""
    bad = F.col("_corrupt_record").isNotNull()
    return reports.where(~bad).drop("_corrupt_record"), reports.where(bad).select("_corrupt_record")


#: Lists of a file's facts, by the kind that their entries have in the table of symbols.
FACTS = {"imports": "import", "exports": "export", "functions": "function", "targets": "target", "members": "member"}


def flatten(reports: DataFrame) -> dict[str, DataFrame]:
    """Nested reports as tables ``files``, ``findings``, ``imports``, ``symbols``, ``metrics``, ``strings`` and ``refs``.

    Facts are JSON of any shape, read as VARIANT. ``imports (report_id, file_id,
    lib, name)``: entries ``[library, name]``, and objects and strings, which
    have a name only. ``symbols (report_id, file_id, kind, v)``: all entries of
    the lists in :data:`FACTS` as they are. ``metrics (report_id, file_id, g, f,
    v)``: numbers, booleans as 1 and 0. ``strings (report_id, file_id, item)``:
    arrays as text. ``refs (report_id, file_id, pos, kind, locator)``. What
    cannot be read is no row.
    """
    files = reports.select("report_id", F.inline("files")).withColumnsRenamed({"id": "file_id", "type": "file_type", "sha": "sha256", "size": "size_bytes", "parent": "parent_id"})
    inner = files.select("report_id", "file_id", F.posexplode("findings").alias("pos", "f")).select("report_id", "file_id", "pos", "f.*")
    key = ["report_id", "file_id"]
    listed = lambda c: F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    facts = reduce(DataFrame.unionByName, [files.select(*key, F.lit(kind).alias("kind"), F.explode(listed(c)).alias("v")) for c, kind in FACTS.items()])
    v = F.col("v")
    said = lambda path: F.try_variant_get(v, path, "string")
    kind = F.schema_of_variant("v")
    single = F.when(kind == "STRING", said("$")).when(kind.startswith("OBJECT"), F.coalesce(said("$.n"), said("$.name"), said("$.symbol")))
    imports = facts.where("kind = 'import'").select(*key, F.when(kind.startswith("ARRAY"), said("$[0]")).alias("lib"), F.when(kind.startswith("ARRAY"), said("$[1]")).otherwise(single).alias("name")).where("coalesce(lib, '') <> '' or coalesce(name, '') <> ''")
    groups = files.select(*key, F.explode(F.try_variant_get(F.try_parse_json("metrics"), "$", "map<string,variant>")).alias("g", "fields"))
    cells = groups.select(*key, "g", F.explode(F.try_variant_get("fields", "$", "map<string,variant>")).alias("f", "v"))
    number = F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(~kind.isin("STRING", "VOID"), F.try_variant_get(v, "$", "double"))
    metrics = cells.select(*key, "g", "f", number.alias("v")).where("v is not null")
    strings = files.select(*key, F.explode(listed("strings")).alias("v")).select(*key, F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.coalesce(F.try_variant_get(e, "$", "string"), F.to_json(e))).alias("item")).where("item is not null")
    refs = files.select(*key, F.posexplode(listed("refs")).alias("pos", "v")).select(*key, "pos", said("$.kind").alias("kind"), said("$.locator").alias("locator")).where("locator is not null")
    return {"files": files.drop("findings", *FACTS, "strings", "refs"), "findings": inner, "imports": imports, "symbols": facts, "metrics": metrics, "strings": strings, "refs": refs}


def nest(files: DataFrame, findings: DataFrame) -> DataFrame:
    """The inverse of :func:`flatten` for the columns that both have."""
    per_file = findings.groupBy("report_id", "file_id").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "crit", "conf"))).alias("findings"))
    rows = files.join(per_file, ["report_id", "file_id"], "left")
    entry = F.struct(F.col("file_id").alias("id"), "path", F.col("file_type").alias("type"), F.col("sha256").alias("sha"), F.col("size_bytes").alias("size"), "depth", F.col("parent_id").alias("parent"), F.transform("findings", lambda f: F.struct(f["id"].alias("id"), f["crit"].alias("crit"), f["conf"].alias("conf"))).alias("findings"))
    return rows.groupBy("report_id").agg(F.array_sort(F.collect_list(entry)).alias("files"))


def own_files(files: DataFrame, own: DataFrame) -> DataFrame:
    """Files whose content is the artifact's own, fetched payloads left out."""
    return files.join(own, ["report_id", "sha256"], "left_semi")


def ml_files(files: DataFrame, members: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Per report a list of file entries in order of their ids.

    The root has the report's verdict (``verdicts``: report_id, prob, level), a
    member its own; an unevaluated file has id and type only, and listing-only
    ones (risk below 0) are left out. Where members (and verdicts) have a class,
    the entry has it as ``cls``.
    """
    cls = F.col("class") if "class" in members.columns else F.lit(None).cast("int")
    level = F.col("level") if "level" in members.columns else F.lit(None).cast("int")
    rows = files.where("risk >= 0").join(members.select("report_id", "file_id", F.col("prob").alias("p"), level.alias("l"), cls.alias("c"), F.lit(True).alias("known")), ["report_id", "file_id"], "left")
    if verdicts is not None:
        root_cls = F.col("class") if "class" in verdicts.columns else F.lit(None).cast("int")
        rows = rows.join(verdicts.select("report_id", F.col("prob").alias("root_p"), F.col("level").alias("root_l"), root_cls.alias("root_c")), "report_id", "left")
        root = F.col("depth") == 0
        rows = rows.withColumns({"p": F.when(root, F.col("root_p")).otherwise(F.col("p")), "l": F.when(root, F.col("root_l")).otherwise(F.col("l")), "c": F.when(root, F.col("root_c")).otherwise(F.col("c")), "known": root | F.coalesce("known", F.lit(False))})
    entry = F.struct(F.col("file_id").alias("id"), F.col("file_type").alias("type"), F.when(F.col("known"), F.struct(F.col("p").alias("prob"), F.col("l").alias("lvl"), level_conf(F.col("l")).alias("conf"), F.col("c").alias("cls"))).alias("v"))
    return rows.groupBy("report_id").agg(F.array_sort(F.collect_list(entry)).alias("files"))


def envelopes(verdicts: DataFrame, files: DataFrame, scores: DataFrame | None = None, skipped: DataFrame | None = None, raw: DataFrame | None = None, llm: DataFrame | None = None) -> DataFrame:
    """``(report_id, line)``: an envelope ``{"ml": {...}, "llm"?: {...}, "raw"?: {...}}`` of each verdict.

    Level and confidence are there even when null, in the report's and in its
    files' entries; ``mods`` (``scores``: report_id, route, p, raw) and ``skip``
    (``skipped``: report_id, route, why) are left out when empty, as ``llm`` and
    ``raw``, JSON by report, are.
    """
    rows = verdicts.join(files, "report_id", "left")
    parts = {"mods": (scores, lambda r: F.struct(F.col("route").alias("rte"), F.col("p").alias("prob"), "raw")), "skip": (skipped, lambda r: F.struct(F.col("route").alias("rte"), "why"))}
    for name, (table, entry) in parts.items():
        if table is None:
            rows = rows.withColumn(name, F.lit(None).cast("string"))
            continue
        rows = rows.join(table.groupBy("report_id").agg(F.to_json(F.array_sort(F.collect_list(entry(table)))).alias(name)), "report_id", "left")
    for name, table in (("raw", raw), ("llm", llm)):
        rows = rows.join(table.select("report_id", name), "report_id", "left") if table is not None else rows.withColumn(name, F.lit(None).cast("string"))
    shown = {"ignoreNullFields": "false"}

    def inside(json: Column) -> Column:
        """An object's text without its braces."""
        return F.substring(json, 2, F.length(json) - 2)

    def file_(f: Column) -> Column:
        known = F.to_json(F.struct(f["id"].alias("id"), f["type"].alias("type"), f["v"]["prob"].alias("prob"), f["v"]["lvl"].alias("lvl"), f["v"]["conf"].alias("conf")), shown)
        return F.when(f["v"].isNotNull(), known).otherwise(F.to_json(F.struct(f["id"].alias("id"), f["type"].alias("type"))))

    head = inside(F.to_json(F.struct("prob", F.col("level").alias("lvl"), "conf"), shown))
    listed = F.concat(F.lit('"files":['), F.array_join(F.transform("files", file_), ","), F.lit("]"))
    ml = F.concat_ws(",", head, *[F.concat(F.lit(f'"{n}":'), F.col(n)) for n in parts], listed)
    line = F.concat(F.lit("{"), F.concat_ws(",", F.concat(F.lit('"ml":{'), ml, F.lit("}")), F.concat(F.lit('"llm":'), "llm"), F.concat(F.lit('"raw":'), "raw")), F.lit("}"))
    return rows.select("report_id", line.alias("line"))


def read_corpus(spark: SparkSession, path: str, whole: int = 64 << 20) -> DataFrame:
    """Regular files below ``path`` without ``.git*``: path, length, content hash. Spark lists no empty files.

    Files of up to ``whole`` bytes are hashed where Spark reads them. Larger ones
    are listed without their content and hashed in blocks by the workers, through
    the file system that their url names, for no row could hold them.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(~F.col("path").rlike(r"/\.git[^/]*(/|$)"))
    small = rows.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = rows.where(F.col("length") > whole).select("path", "length")
    # a large file is a unit of work: deal them out one by one
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    return small.unionByName(large.repartition(n, "path").mapInPandas(_hashed, "path string, length long, sha256 string"))


def _hashed(batches: Iterator[pd.DataFrame], block: int = 8 << 20) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    for df in batches:
        digests = []
        for path in df["path"]:
            # Spark writes file:/x and leaves blanks as they are
            store, name = fs.FileSystem.from_uri(quote(re.sub("^([A-Za-z0-9+.-]+):/(?!/)", r"\1:///", path), safe=":/%"))
            digest = hashlib.sha256()
            with store.open_input_stream(name) as f:
                while data := f.read(block):
                    digest.update(data)
            digests.append(digest.hexdigest())
        yield df.assign(sha256=digests)


def read_pool(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines ``value`` of NDJSON -> pool rows and one row of counts; nothing is fatal."""
    rows = lines.withColumn("r", F.from_json("value", "purl string, sha256 string, label string"))
    label = F.col("r.label")
    bad_sha = F.col("r.sha256").isNotNull() & parse_sha256(F.col("r.sha256")).isNull()
    malformed = F.col("r.label").isNull() & F.col("r.purl").isNull() & F.col("r.sha256").isNull()
    stats = rows.agg(F.count(F.lit(1)).alias("records"), F.count_if(malformed).alias("malformed"), F.count_if(bad_sha).alias("bad_sha"), F.count_if(~malformed & ~F.coalesce(label.isin("good", "bad"), F.lit(False))).alias("other_label"))
    return rows.where(label.isin("good", "bad")).select("r.*"), stats


def read_registry(json: Column) -> Column:
    """A registry record from a full sidecar, a ``{record}`` or a bare record; null if it is none."""
    record = "struct<ecosystem:string,name:string,version:string,deprecated:string,version_removed:boolean>"
    full = F.from_json(json, f"registry struct<record:{record}>")["registry"]["record"]
    some, bare = F.from_json(json, f"record {record}")["record"], F.from_json(json, record)
    return F.coalesce(full, some, F.when(bare["name"].isNotNull(), bare))


def artifact_filename(url: Column, locator: Column) -> Column:
    """Last segment of the url without its query, else the locator's tail with ``@`` and ``:`` as ``-``."""
    last = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)
    tail = F.translate(F.element_at(F.split(locator, "/"), -1), "@:", "--")
    return F.coalesce(F.nullif(last, F.lit("")), tail)


def sidecar(filename: Column, sha256: Column, raw: Column) -> Column:
    """Provenance sidecar as JSON; a raw record above the limit is dropped and the status is ``partial``."""
    big = F.octet_length(raw) > RAW_LIMIT
    return F.to_json(F.struct(F.lit(1).alias("schema_version"), F.struct(filename.alias("filename"), sha256.alias("sha256")).alias("artifact"), F.struct(F.when(big, "partial").otherwise("full").alias("status"), F.when(~big, raw).alias("raw")).alias("registry")))


def source_urls(registry_url: Column, sources: Column) -> Column:
    """The registry's url, then each distinct source url in first-seen order."""
    return F.array_distinct(F.filter(F.concat(F.array(registry_url), F.coalesce(sources, F.array().cast("array<string>"))), lambda u: u.isNotNull() & (u != "")))


def bloom_manifest(filters: DataFrame, version: str, words: int = 4096) -> DataFrame:
    """``(stem, file, version, n, words, ones, sha256)`` of each filter of word tables ``(stem, word, bits)``.

    ``sha256`` is the hash of the hashes of ranges of ``words`` words, in order:
    ranges are hashed apart, so no task sees a filter whole, and a changed bit
    changes one row.
    """
    said = F.concat("word", F.lit(":"), "bits")
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word", said.alias("s")))), lambda w: w["s"]), ";")
    ranges = filters.groupBy("stem", F.expr(f"word div {words}").alias("r")).agg(F.sha2(part, 256).alias("h"), F.count(F.lit(1)).alias("words"), F.sum(F.bit_count("bits")).alias("ones"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "h"))), lambda x: x["h"]), "")
    return ranges.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("words"), F.sum("ones").alias("ones"), F.sha2(whole, 256).alias("sha256")).select("stem", F.concat(F.lit("stem="), "stem").alias("file"), F.lit(version).alias("version"), "n", "words", "ones", "sha256")


def write_bloom(filters: DataFrame, path: str, version: str = "1") -> DataFrame:
    """Word tables ``(stem, word, bits)`` as Parquet by stem below ``path/filters``, and their manifest, written to ``path/manifest`` and returned."""
    filters.write.partitionBy("stem").parquet(f"{path}/filters")
    manifest = bloom_manifest(filters.sparkSession.read.parquet(f"{path}/filters"), version)
    manifest.write.parquet(f"{path}/manifest")
    return filters.sparkSession.read.parquet(f"{path}/manifest")
