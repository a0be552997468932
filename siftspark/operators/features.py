"""Feature families of a report, as sparse rows ``(report_id, name, value)``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.operators import findings as B

#: Categories whose findings make tier tokens, letters of the tiers, and the caps beyond which no n-grams are made.
TOKEN_CATEGORIES = ("objectives", "well-known", "supply-chain", "anti-analysis", "anti-static", "command-and-control", "evasion", "execution", "exfiltration")
PAIR_CAP, TRIPLE_CAP = 512, 128
#: Fixed value: most names of a spec whose vectors are put together as columns.
WIDE = 100
#: Fixed value: most characters of a string whose characters are counted in place.
SHORT = 64
#: Fixed value: least difference of single precision, below which a spread is none.
FLAT = 2.0**-23


def long(rows: DataFrame, columns: dict[str, Column | str], only: set[str] | None = None) -> DataFrame:
    """Wide aggregates as sparse rows; of the names, those in ``only``, so that no other is computed."""
    columns = {k: v for k, v in columns.items() if only is None or k in only}
    if not columns:
        return rows.select("report_id", F.lit("").alias("name"), F.lit(0.0).alias("value")).where("false")
    # each value is a column once; the rows are copies of it, and no list of structs is made for a report
    wide = rows.select("report_id", *[(F.col(v) if isinstance(v, str) else v).cast("double").alias(k) for k, v in columns.items()])
    return wide.unpivot("report_id", [F.col(f"`{k}`") for k in columns], "name", "value")


def weighted_paths(paths: DataFrame, risks: DataFrame, vocab: DataFrame) -> DataFrame:
    """``present:``, ``maxcrit:`` and ``ghost:`` of each vocabulary path; ``risks`` has a row for every report, findings or not."""
    w = F.when(F.col("risk") > 0, F.log1p("risk")).otherwise(1.0)
    names = [r.path for r in vocab.select("path").distinct().where("path is not null").collect()]  # a model's vocabulary
    # a condition on the path alone reaches below the grouping that made the paths; a report's known paths are one list, read once
    known = paths.where(F.col("path").isin(names)).join(F.broadcast(vocab.select("path")), "path")
    found = known.groupBy("report_id").agg(F.collect_list(F.struct("path", "max_crit", "max_conf")).alias("found"))
    rows = risks.join(found, "report_id", "left").select("report_id", w.alias("w"), F.coalesce("found", F.array().cast(found.schema["found"].dataType)).alias("found"))
    entry = lambda prefix, path, value: F.struct(F.concat(F.lit(prefix), path).alias("name"), value.cast("double").alias("value"))
    there = F.filter("found", lambda p: p["max_crit"] >= 2)
    present = F.transform(there, lambda p: entry("present:", p["path"], F.col("w") * p["max_conf"]))
    most = F.transform("found", lambda p: entry("maxcrit:", p["path"], p["max_crit"] * F.col("w") * p["max_conf"]))
    absent = F.array_except(F.array(*map(F.lit, names)).cast("array<string>"), there["path"])
    ghosts = F.transform(absent, lambda p: entry("ghost:", p, F.lit(1.0)))
    return rows.select("report_id", F.inline(F.concat(present, most, ghosts)))


#: Fixed values: ``agg:`` features that paths alone give.
_OF_PATHS = frozenset(
    f"agg:{n}" for n in ("max_crit", "category_breadth", "path_breadth_any", "total_active_paths", "suspicious_concentration", "hostile_concentration", "escalation_rate", "notable_only_fraction", "suspicious_category_breadth", "hostile_category_breadth",
    "suspicious_category_density", "hostile_category_density", "hostile_escalation_rate", "hostile_share_of_suspicious", "suspicious_2level_breadth", "hostile_2level_breadth", "objectives_breadth")
)


def aggregates(findings: DataFrame, files: DataFrame, paths: DataFrame | None = None, only: set[str] | None = None) -> DataFrame:
    """All ``agg:`` features of findings, paths and files; every report in ``files`` has a row for each.

    Distinct paths, categories and ids are rows of one level or another, so
    every count is a plain one and no column is expanded for distinct counts.
    ``paths``: :func:`.findings.report_paths` of the findings, if they are there
    already; ``only``: names that are asked for. If paths alone give these,
    findings are not read.
    """
    depth, crit = F.regexp_count("path", F.lit("/")), F.col("max_crit")
    at = lambda level, c: F.count_if(level & (crit >= c))
    breadth = (B.report_paths(findings) if paths is None else paths).groupBy("report_id").agg(
        F.coalesce(F.max(F.when((depth >= 2) & (crit >= 3), crit)), F.lit(0)).alias("top_crit"), at(depth == 0, 2).alias("categories"), F.count_if((depth >= 2) & (crit == 3)).alias("only3"),
        *[at(depth >= 2, c).alias(f"deep{c}") for c in (2, 3, 4, 5)], *[at(depth == 0, c).alias(f"cat{c}") for c in (4, 5)], *[at(depth == 1, c).alias(f"two{c}") for c in (4, 5)],
        F.count_if((depth == 1) & (crit >= 2) & F.col("path").startswith("objectives/")).alias("objectives"),
    )
    out = {f"agg:{k}": v for k, v in _aggregate_columns().items()}
    if only is not None and only & set(out) <= _OF_PATHS:
        return long(files.select("report_id").distinct().join(breadth, "report_id", "left").na.fill(0), out, only & _OF_PATHS)
    ids = B.by_id(findings)
    tops = ids.groupBy("report_id", "file_id", F.split_part(B.base_id(F.col("id")), F.lit("/"), F.lit(1)).alias("top")).agg(*[F.sum(c).alias(c) for c in ("n_active", "notable", "suspicious", "hostile")], F.max("max_crit").alias("max_crit"))
    per_file = tops.groupBy("report_id", "file_id").agg(*[F.sum(c).alias(c) for c in ("n_active", "notable", "suspicious", "hostile")], F.max("max_crit").alias("max_crit"), F.count_if(crit >= 4).alias("sc"), F.count_if(crit >= 5).alias("hc"))
    rows = files.select("report_id", "file_id", "size_bytes").join(per_file, ["report_id", "file_id"], "left").na.fill(0)
    n, kb = F.greatest(F.lit(1), "n_active"), F.greatest(F.lit(1.0), F.col("size_bytes") / 1024)
    rows = rows.withColumns({"sr": F.col("suspicious") / n, "hr": F.col("hostile") / n, "sd": F.col("suspicious") / kb, "hd": F.col("hostile") / kb}).withColumn("wd", F.col("hd") + 0.25 * F.col("sd"))
    best = lambda *key: F.max_by(F.struct("sr", "hr", "suspicious", "hostile", "sd", "hd", "sc", "hc"), F.struct(*key, -F.col("file_id")))
    rows = rows.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("files"), *[F.count_if(crit == c).alias(f"files{c}") for c in (3, 4)], F.count_if(crit >= 5).alias("files5"), F.sum("size_bytes").alias("bytes"),
        *[F.sum(c).alias(c) for c in ("n_active", "notable", "suspicious", "hostile")], best("sr", "suspicious", "hr", "hostile").alias("s"), best("hr", "hostile", "sr", "suspicious").alias("h"), F.max("wd").alias("wd"),
    )
    once = ids.where("max_crit >= 4").groupBy("report_id", "id").agg(F.max("max_crit").alias("max_crit")).groupBy("report_id").agg(F.count(F.lit(1)).alias("ids4"), F.count_if(crit >= 5).alias("ids5"))
    rows = rows.join(breadth, "report_id", "left").join(once, "report_id", "left").na.fill(0)
    return long(rows, out, only)


def _aggregate_columns() -> dict[str, Column]:
    """Expressions of :func:`aggregates` over its one row for each report."""
    raw = F.col("bytes") / 1024
    low, one_kb = F.greatest(F.lit(0.1), raw), F.greatest(F.lit(1.0), raw)
    c = F.col
    over = lambda a, b: c(a) / F.greatest(F.lit(1), c(b))
    return {
        "max_crit": c("top_crit"), "category_breadth": c("categories"), "path_breadth_any": F.log1p("deep2"), "total_active_paths": F.log1p("deep3"),
        "suspicious_concentration": over("deep4", "deep2"), "hostile_concentration": over("deep5", "deep2"), "escalation_rate": over("deep4", "deep3"), "notable_only_fraction": over("only3", "deep3"),
        "notable_findings_log": F.log1p("notable"), "suspicious_findings_log": F.log1p("suspicious"), "hostile_findings_log": F.log1p("hostile"),
        "notable_finding_ratio": c("notable") / low, "suspicious_finding_ratio": c("suspicious") / low, "hostile_finding_ratio": c("hostile") / low,
        "unique_suspicious_ids_log": F.log1p("ids4") / F.log1p(low), "unique_hostile_ids_log": F.log1p("ids5") / F.log1p(low),
        "crit3_finding_fraction": over("notable", "n_active"), "crit4_finding_fraction": over("suspicious", "n_active"), "hostile_finding_fraction": over("hostile", "n_active"),
        "severe_to_mundane_ratio": c("notable") / F.greatest(F.lit(1), c("n_active") - c("notable")), "crit4_present": c("suspicious") > 0,
        "top1_file_suspicious_ratio_sum": c("s.sr"), "top1_file_hostile_ratio_sum": c("h.hr"), "top1_file_suspicious_findings_log": F.log1p("s.suspicious"), "top1_file_hostile_findings_log": F.log1p("h.hostile"),
        "suspicious_category_breadth": c("cat4"), "hostile_category_breadth": c("cat5"), "suspicious_category_density": over("cat4", "categories"), "hostile_category_density": over("cat5", "categories"),
        "suspicious_findings_per_kb": c("suspicious") / one_kb, "hostile_findings_per_kb": c("hostile") / one_kb, "suspicious_categories_per_kb": c("cat4") / one_kb, "hostile_categories_per_kb": c("cat5") / one_kb,
        "top1_file_suspicious_density_sum": c("s.sd"), "top1_file_hostile_density_sum": c("h.hd"), "top1_file_suspicious_category_breadth_sum": c("s.sc"), "top1_file_hostile_category_breadth_sum": c("h.hc"),
        "hostile_escalation_rate": over("deep5", "deep3"), "hostile_share_of_suspicious": over("deep5", "deep4"), "suspicious_finding_escalation_rate": over("suspicious", "notable"),
        "hostile_finding_escalation_rate": over("hostile", "notable"), "hostile_share_of_suspicious_findings": over("hostile", "suspicious"),
        "hostile_weighted_density": c("hostile") / one_kb + 0.25 * c("suspicious") / one_kb, "top1_file_hostile_weighted_density_sum": c("wd"),
        "suspicious_id_repeat_ratio": 1 - over("ids4", "suspicious"), "hostile_id_repeat_ratio": 1 - over("ids5", "hostile"), "suspicious_category_repeat_ratio": 1 - over("cat4", "suspicious"), "hostile_category_repeat_ratio": 1 - over("cat5", "hostile"),
        "file_hostile_fraction": over("files5", "files"), "file_suspicious_fraction": over("files4", "files"), "file_notable_fraction": over("files3", "files"),
        "file_hostile_count_log": F.log1p("files5"), "file_suspicious_count_log": F.log1p("files4"), "file_notable_count_log": F.log1p("files3"), "hostile_depth_weight": F.lit(0.0),
        "suspicious_2level_breadth": c("two4"), "hostile_2level_breadth": c("two5"), "objectives_breadth": c("objectives"),
    }


#: The names that :func:`attack_codes` writes.
CODE_NAMES = tuple(f"agg:{n}" for n in ("attack_technique_count", "attack_tactic_count", "mbc_behavior_count", "attack_bigram_count", "attack_trigram_count", "mbc_bigram_count", "has_attack_and_objective"))


def attack_codes(findings: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Distinct ATT&CK and MBC codes of all findings, tactics, and pairs and triples of codes, by closed form.

    Codes and tactics are told apart by a number, so that one grouping gives all three counts; a report without any has its row too.
    """
    tactic = F.when(F.col("atk").startswith("T") & (F.length("atk") >= 4), F.substring("atk", 1, 4))
    sure = F.coalesce((F.col("conf") >= B.MIN_CONF) & F.col("id").startswith("objectives/"), F.lit(False))
    codes = F.array(*[F.struct(F.lit(k).alias("k"), c.alias("code")) for k, c in enumerate((F.lit(None).cast("string"), F.col("atk"), F.col("mbc"), tactic))])
    rows = findings.select("report_id", sure.alias("sure"), F.inline(F.filter(codes, lambda c: (c["k"] == 0) | c["code"].isNotNull())))
    rows = rows.groupBy("report_id", "k", "code").agg(F.bool_or("sure").alias("sure"))
    rows = rows.groupBy("report_id").agg(F.bool_or("sure").alias("o"), *[F.count_if(F.col("k") == k).alias(n) for k, n in ((1, "atk"), (2, "mbc"), (3, "tactics"))])
    n, k = F.col("atk"), F.col("mbc")
    return long(rows, {
        "agg:attack_technique_count": "atk", "agg:attack_tactic_count": "tactics", "agg:mbc_behavior_count": "mbc", "agg:attack_bigram_count": F.log1p(n * (n - 1) / 2), "agg:attack_trigram_count": F.log1p(n * (n - 1) * (n - 2) / 6),
        "agg:mbc_bigram_count": F.log1p(k * (k - 1) / 2), "agg:has_attack_and_objective": (n > 0) & F.coalesce("o", F.lit(False)),
    }, only)


def _tier(crit: Column) -> Column:
    return F.when(crit == 5, "h").when(crit == 4, "s").otherwise("n")


def _sized(tokens: DataFrame) -> DataFrame:
    """Add ``n``, the number of a report's tokens."""
    return tokens.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("report_id")))


def crit_tokens(paths: DataFrame) -> DataFrame:
    """``(report_id, token, n)``: tier and path, of one and two levels, of the token categories at criticality 3 or more."""
    rows = paths.where("max_crit >= 3").where(F.split_part("path", F.lit("/"), F.lit(1)).isin(*TOKEN_CATEGORIES)).where(F.regexp_count("path", F.lit("/")) <= 1)
    return _sized(rows.select("report_id", F.concat(_tier(F.col("max_crit")), F.lit(":"), "path").alias("token")))


def tier_tokens(paths: DataFrame) -> DataFrame:
    """``(report_id, token, n)``: tier and path of every path at criticality 3 or more."""
    return _sized(paths.where("max_crit >= 3").select("report_id", F.concat(_tier(F.col("max_crit")), F.lit(":"), "path").alias("token")))


def code_tokens(findings: DataFrame, code: str) -> DataFrame:
    """``(report_id, token, n)``: distinct codes, ``atk`` or ``mbc``, of all findings."""
    return _sized(findings.where(F.col(code).isNotNull()).select("report_id", F.col(code).alias("token")).distinct())


def token_presence(tokens: DataFrame, prefix: str = "crit:") -> DataFrame:
    return tokens.select("report_id", F.concat(F.lit(prefix), "token").alias("name"), F.lit(1.0).alias("value"))


def token_ngrams(tokens: DataFrame, vocab: DataFrame, prefix: str, cap: int = PAIR_CAP, sep: str = " + ") -> DataFrame:
    """N-grams of the vocabulary ``(a, b)`` or ``(a, b, c)`` that a report of at most ``cap`` tokens has whole, from the vocabulary: a report's pairs are never made."""
    rows = tokens.where(F.col("n") <= cap).select("report_id", "token")
    out = rows.join(vocab, F.col("token") == F.col("a")).drop("token")
    for part in vocab.columns[1:]:
        out = out.join(rows.withColumnRenamed("token", part), ["report_id", part])
    return out.select("report_id", F.concat(F.lit(prefix), F.concat_ws(sep, *vocab.columns)).alias("name"), F.lit(1.0).alias("value"))


def path_bigrams(file_paths: DataFrame, vocab: DataFrame, cap: int = 512) -> DataFrame:
    """``bigrams:`` of the vocabulary ``(a, b)``, from the vocabulary: a file's pairs are never made."""
    rows = file_paths.where(F.size("paths") <= cap).select("report_id", "file_id", F.explode("paths").alias("path"))
    first = rows.join(vocab, F.col("path") == F.col("a")).select("report_id", "file_id", "a", "b")
    both = first.join(rows, (first.report_id == rows.report_id) & (first.file_id == rows.file_id) & (first.b == rows.path))
    return both.select(first.report_id, "a", "b").distinct().select("report_id", F.concat(F.lit("bigrams:"), "a", F.lit("+"), "b").alias("name"), F.lit(1.0).alias("value"))


#: Metrics that every model may ask for, with the flag of those that are taken as ln(|v| + 1).
KEY_METRICS = (
    ("binary", "overall_entropy", False), ("binary", "code_entropy", False), ("binary", "code_to_data_ratio", False), ("binary", "function_count", True), ("binary", "complexity_per_kb", False), ("binary", "max_complexity", False),
    ("binary", "normalized_string_count", False), ("binary", "high_entropy_regions", False), ("binary", "overlay_ratio", False), ("binary", "overlay_entropy", False), ("binary", "overlay_size", True), ("binary", "has_overlay", False),
    ("text", "char_entropy", False), ("text", "unique_chars", True), ("text", "whitespace_ratio", False), ("text", "most_common_ratio", False), ("text", "total_lines", True), ("text", "non_ascii_ratio", False),
    ("text", "non_printable_ratio", False), ("text", "null_byte_count", True), ("text", "high_byte_ratio", False), ("text", "avg_line_length", True), ("text", "max_line_length", True), ("text", "line_length_stddev", True),
    ("text", "last_line_length", True), ("text", "empty_line_ratio", False), ("text", "tab_count", True), ("text", "space_count", True), ("text", "trailing_whitespace_lines", True), ("text", "unusual_whitespace", True),
    ("text", "max_inline_whitespace_run", True), ("text", "unicode_escape_count", True), ("text", "octal_escape_count", True), ("text", "escape_density", False), ("text", "invisible_chars", True), ("text", "long_token_count", True),
    ("text", "repeated_char_sequences", True), ("text", "digit_ratio", False), ("text", "mixed_indent", False), ("strings", "avg_entropy", False), ("pe", "rsrc_entropy", False), ("pe", "rsrc_size", True),
)
#: Words in the names of other metrics that are taken as ln(|v| + 1).
LOG_WORDS = "count|size|total|bytes|length"
#: Groups of file types.
FORMAT_GROUPS = {
    "script": ("batch", "javascript", "lua", "perl", "php", "powershell", "python", "ruby", "shell", "typescript", "vbscript"),
    "native_binary": ("elf", "macho", "pe"),
    "archive_package": ("7z", "apk", "cab", "deb", "egg", "gz", "jar", "msi", "rar", "rpm", "tar", "tgz", "vsix", "war", "whl", "xpi", "xz", "zip", "zst"),
    "document": ("doc", "docx", "html", "pdf", "ppt", "pptx", "rtf", "xls", "xlsx"),
    "source_code": ("c", "cpp", "csharp", "go", "java", "kotlin", "makefile", "rust", "scala", "swift"),
    "config_data": ("ini", "json", "plist", "toml", "xml", "yaml", "yml"),
    "media": ("bmp", "gif", "jpg", "jpeg", "mp3", "mp4", "png", "svg", "webp"),
}
#: Types by which the structure of a report is judged.
BINARY, SOURCE, CODE, TEXT_SUFFIXES = ("pe", "elf", "macho"), ("javascript", "python", "typescript", "ruby", "php"), ("javascript", "python", "pe", "elf", "macho"), ("txt", "md", "json", "png", "jpg")
#: Imports that announce a behaviour, and the paths that show it.
LOGIC_GAPS = {
    "crypto": (("cryptography", "Crypto", "hashlib", "CryptAcquireContext", "BCryptOpenAlgorithmProvider"), ("micro-behaviors/crypto", "metadata/encoded-payload")),
    "network": (("socket", "urllib", "requests", "http", "curl", "wininet", "winhttp"), ("micro-behaviors/network", "objectives/command-and-control")),
    "process": (("subprocess", "os.spawn", "os.system", "CreateProcess", "ShellExecute", "posix_spawn"), ("micro-behaviors/process/create", "objectives/execution")),
}
#: Risky paths, and the paths that declare an intent.
INTENT_GAPS = {
    "network": ("objectives/network", "micro-behaviors/network"), "filesystem": ("objectives/persistence", "micro-behaviors/filesystem"),
    "execution": ("objectives/execution", "micro-behaviors/process/create"), "crypto": ("objectives/crypto", "micro-behaviors/crypto"),
}
#: Paths that files of a type are expected to show.
EXPECTED_PATHS = {
    "elf": ("metadata/binary/layout", "metadata/binary/metrics", "metadata/binary/symbols", "metadata/binary/linking"),
    "javascript": ("micro-behaviors/javascript/async", "metadata/package/versioning"),
    "pe": ("metadata/binary/layout", "metadata/binary/metrics", "metadata/binary/resource", "metadata/binary/symbols", "metadata/binary/linking"),
}
INTENT_PATHS = ("metadata/package/documentation", "metadata/package/help")


def merged_metrics(files: DataFrame, col: str = "metrics") -> DataFrame:
    """Two-level JSON of numbers and booleans -> ``(report_id, g, f, v)``, the greatest value over a report's files; strings are dropped."""
    parsed = F.from_json(col, "map<string,map<string,string>>")
    rows = files.select("report_id", F.explode(parsed).alias("g", "fields")).select("report_id", "g", F.explode("fields").alias("f", "v"))
    number = F.when(F.lower("v") == "true", 1.0).when(F.lower("v") == "false", 0.0).otherwise(F.expr("try_cast(v AS double)"))
    return rows.withColumn("v", number).where("v is not null").groupBy("report_id", "g", "f").agg(F.max("v").alias("v"))


def metrics(reports: DataFrame, merged: DataFrame, vocab: DataFrame) -> DataFrame:
    """``metrics:`` of the key metrics, of the vocabulary ``(name)`` and the three derived ratios; what a report lacks is 0.

    A vocabulary name is split at its first ``_``; names among the key metrics are not written twice.
    """
    keys = [(f"{g}_{f}", g, f, log) for g, f, log in KEY_METRICS]
    base = {k[0] for k in keys}
    for (name,) in vocab.select("name").distinct().collect():  # a model's names
        if "_" in name and name not in base:
            g, f = name.split("_", 1)
            keys.append((name, g, f, re.search(LOG_WORDS, f) is not None))
    cells = merged.groupBy("report_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\n", "g", "f"), "v"))).alias("m"))
    cells = reports.select("report_id").join(cells, "report_id", "left")
    # the names are the rows, each looks its value up: one pass, and no function over an array
    entry = lambda name, key, by=None, log=False: F.struct(F.lit(f"metrics:{name}").alias("name"), F.lit(key).alias("key"), F.lit(by).cast("string").alias("by"), F.lit(log).alias("log"))
    ratios = (("string_per_function", "string_count", "function_count"), ("imports_per_dependency", "import_count", "dependency_count"), ("wide_string_ratio", "wide_string_count", "string_count"))
    named = [entry(n, f"{g}\n{f}", log=log) for n, g, f, log in sorted(keys)] + [entry(f"derived_{n}", f"binary\n{a}", f"binary\n{b}") for n, a, b in ratios]
    of = lambda key: F.coalesce(F.element_at("m", F.col(key)), F.lit(0.0))
    ratio = F.when(of("by") == 0, 0.0).otherwise(of("key") / of("by"))
    value = F.when(F.col("by").isNotNull(), ratio).when(F.col("log"), F.log1p(F.abs(of("key")))).otherwise(of("key"))
    return cells.select("report_id", "m", F.inline(F.array(*named))).select("report_id", "name", value.alias("value"))


def kv_tokens(files: DataFrame, col: str = "metrics") -> DataFrame:
    """``kv:group.key=value`` of the booleans and strings (at most 80 characters) among a report's metrics."""
    rows = files.select("report_id", F.explode(F.from_json(col, "map<string,map<string,variant>>")).alias("g", "fields")).select("report_id", "g", F.explode("fields").alias("k", "v"))
    kind = F.schema_of_variant("v")
    said = F.when(kind == "BOOLEAN", F.try_variant_get("v", "$", "boolean").cast("string")).when(kind == "STRING", normalize_token(F.try_variant_get("v", "$", "string"), 80))
    rows = rows.withColumn("said", said).where(F.length("said") > 0)
    return rows.select("report_id", F.concat(F.lit("kv:"), "g", F.lit("."), "k", F.lit("="), "said").alias("name"), F.lit(1.0).alias("value")).distinct()


def formats(files: DataFrame, per_file: DataFrame, only: set[str] | None = None) -> DataFrame:
    """``format:`` presence and shares of each group of file types, mixed flags and the share of unknown types."""
    group = F.lit(None).cast("string")
    for name, types in FORMAT_GROUPS.items():
        group = F.when(F.lower(F.trim("file_type")).isin(*types), name).otherwise(group)
    rows = files.join(per_file.select("report_id", "file_id", "suspicious", "hostile"), ["report_id", "file_id"], "left").withColumn("grp", group)
    inner = F.col("parent_id").isNotNull()
    mine = {g: F.coalesce(F.col("grp") == g, F.lit(False)) for g in FORMAT_GROUPS}
    sums = [F.count_if(mine[g] & c).alias(f"{g}_{k}") for g in mine for k, c in (("n", F.lit(True)), ("i", inner), ("s", F.col("suspicious") > 0), ("h", F.col("hostile") > 0))]
    rows = rows.groupBy("report_id").agg(F.count(F.lit(1)).alias("files"), F.count_if(inner).alias("inner"), F.count("grp").alias("known"), *sums)
    share = lambda a, b: F.col(a) / F.greatest(F.lit(1), F.col(b))
    out, there = {}, lambda g: F.col(f"{g}_n") > 0
    for g in FORMAT_GROUPS:
        out |= {g: there(g), f"{g}_file_fraction": share(f"{g}_n", "files"), f"{g}_inner_fraction": share(f"{g}_i", "inner"), f"{g}_suspicious_fraction": share(f"{g}_s", f"{g}_n"), f"{g}_hostile_fraction": share(f"{g}_h", f"{g}_n")}
    out["group_count_log"] = F.log1p(sum((there(g).cast("int") for g in FORMAT_GROUPS), F.lit(0)))
    out |= {"mixed_script_binary": there("script") & there("native_binary"), "mixed_archive_script": there("archive_package") & there("script"), "mixed_archive_binary": there("archive_package") & there("native_binary")}
    return long(rows, {f"format:{k}": v for k, v in (out | {"unknown_file_fraction": (F.col("files") - F.col("known")) / F.col("files")}).items()}, only)


def structure(files: DataFrame, per_file: DataFrame, paths: DataFrame, imports: DataFrame | None = None, only: set[str] | None = None) -> DataFrame:
    """``struct:`` of each report: sizes, entropies, times, nesting, and how its files stand to each other.

    ``files``: report_id, file_id (their order), file_type, size_bytes, parent_id,
    depth, path, entropy, mtime (seconds, may be null), total_lines. ``imports``
    ``(report_id, file_id)`` has the files with imports, and a column
    ``has_imports`` of ``files``, if there is one, says which files could have
    any; ``no_imports`` needs one that could. A feature that needs two entropies or times is absent where there are fewer.
    """
    rows = files.join(per_file.select("report_id", "file_id", "n_active", "suspicious", "hostile"), ["report_id", "file_id"], "left").na.fill(0, ["n_active", "suspicious", "hostile"])
    could = F.col("has_imports") if "has_imports" in files.columns else F.lit(imports is not None)
    if imports is None:
        rows, has = rows, F.lit(False)
    else:
        rows, has = rows.join(imports.select("report_id", "file_id").distinct().withColumn("imports", F.lit(True)), ["report_id", "file_id"], "left"), F.coalesce("imports", F.lit(False))
    could = F.coalesce(could, F.lit(False))
    binary, bad, e = F.col("file_type").isin(*BINARY), F.col("hostile") > 0, F.when(F.col("entropy") > 0, F.col("entropy"))
    suffix = F.lower(F.regexp_extract("path", r"\.([^.]*)$", 1))
    hours, at = lambda x: x / 3600, F.col("mtime").cast("double")
    first_source = F.min(F.when(F.col("file_type").isin(*SOURCE), F.col("file_id")))
    last_binary = F.max(F.when(binary, F.col("file_id")))
    rows = rows.groupBy("report_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_active").alias("f"), F.sum("size_bytes").alias("bytes"), F.count_if(F.col("suspicious") > 0).alias("s"), F.count_if(bad).alias("h"), F.bool_or(binary & (F.col("size_bytes") < 20_000)).alias("tiny"),
        (F.bool_or(could) & ~F.bool_or(could & has)).alias("bare"), F.coalesce(F.max("entropy"), F.lit(0.0)).alias("me"), F.count(e).alias("ne"), F.avg(e).alias("ae"), F.stddev_pop(e).alias("se"), F.max(e).alias("xe"),
        F.max(F.when(F.col("file_type").isin(*CODE), e)).alias("ce"), F.count(at).alias("nt"), F.max(at).alias("t1"), F.min(at).alias("t0"), F.stddev_pop(at).alias("st"), F.median(at).alias("mt"), F.max(F.when(bad, at)).alias("b1"), F.min(F.when(bad, at)).alias("b0"),
        F.max("depth").alias("deep"), F.count_if(F.col("parent_id").isNotNull()).alias("inner"), F.count_if(bad & F.col("parent_id").isNotNull()).alias("under"), F.coalesce(last_binary > first_source, F.lit(False)).alias("foreign"),
        F.count_if(binary & suffix.isin(*TEXT_SUFFIXES)).alias("odd"), F.sum("total_lines").alias("lines"),
    ).join(paths.groupBy("report_id").agg(F.count(F.lit(1)).alias("paths")), "report_id", "left").na.fill(0, ["paths"])
    c = F.col
    delta = F.greatest(F.abs(c("b1") - c("mt")), F.abs(c("b0") - c("mt")))
    two = lambda n, v: F.when(c(n) > 1, v)
    out = {
        "tiny_executable": c("tiny"), "no_imports": c("bare"), "zero_findings": c("f") == 0, "finding_count_log": F.log1p("f"), "file_count_log": F.log1p("n"), "inner_file_count_log": F.log("n"),
        "stealth_potential": (c("f") < 5) & (c("me") > 6.5), "suspicious_file_fraction": c("s") / c("n"), "hostile_file_fraction": c("h") / c("n"), "suspicious_file_count_log": F.log1p("s"), "hostile_file_count_log": F.log1p("h"),
        "packaged_capability": c("paths") * c("me"), "mtime_range_hours": two("nt", hours(c("t1") - c("t0"))), "mtime_std_dev_hours": two("nt", hours(c("st"))), "max_nesting_depth_log": F.log1p("deep"), "inner_file_ratio": c("inner") / c("n"),
        "entropy_std_dev": two("ne", c("se")), "entropy_max_diff": two("ne", c("xe") - c("ae")), "air_gap_signal": (c("h") > 0) & (c("under") == 0), "anachronistic_injection": hours(delta), "code_entropy_spike": c("ce") - c("ae"),
        "foreign_binary_signal": c("foreign"), "extension_mismatch_signal": c("odd"), "hostile_finding_density": F.when(c("lines") > 0, c("h") * 1000 / c("lines")), "silent_packer_signal": F.log1p(c("bytes") / 1048576) / (c("f") + 1),
    }
    return long(rows, {f"struct:{k}": v for k, v in out.items()}, only).where("value is not null")


def external(findings: DataFrame, only: set[str] | None = None) -> DataFrame:
    """``ext:`` third-party and well-known findings, and whether a rule file matched."""
    return long(B.report_tiers(findings), {"ext:third_party_max_crit": "max_third_party", "ext:third_party_count": F.log1p("n_third_party"), "ext:well_known_max_crit": "max_well_known", "ext:well_known_hostile_count": "well_known_hostile", "ext:well_known_suspicious_count": "well_known_suspicious", "ext:has_yara_match": "has_yara"}, only)


def _starts(path: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | path.startswith(p)
    return out


def logic_gaps(imports: DataFrame, paths: DataFrame, gaps: dict = LOGIC_GAPS) -> DataFrame:
    """``gap:`` of each category of which a report imports something and shows no behaviour at criticality 3 or more.

    ``imports``: report_id, token (names and ``lib!name``, :func:`import_tokens`).
    """
    have = imports.groupBy("report_id").agg(*[F.bool_or(F.col("token").isin(*names)).alias(g) for g, (names, _) in gaps.items()])
    show = paths.where("max_crit >= 3").groupBy("report_id").agg(*[F.bool_or(_starts(F.col("path"), prefixes)).alias(f"{g}_shown") for g, (_, prefixes) in gaps.items()])
    rows = have.join(show, "report_id", "left")
    return long(rows, {f"gap:{g}": F.col(g) & ~F.coalesce(f"{g}_shown", F.lit(False)) for g in gaps}).where("value > 0")


def intent_gaps(paths: DataFrame, gaps: dict = INTENT_GAPS) -> DataFrame:
    """``intent_gap:`` of each category with a risky path at criticality 4 or more in a report that declares no intent."""
    said = F.bool_or(F.col("path").isin(*INTENT_PATHS)).alias("said")
    rows = paths.groupBy("report_id").agg(said, *[F.bool_or((F.col("max_crit") >= 4) & _starts(F.col("path"), prefixes)).alias(g) for g, prefixes in gaps.items()])
    return long(rows, {f"intent_gap:{g}": F.col(g) & ~F.col("said") for g in gaps}).where("value > 0")


def string_entries(items: DataFrame) -> DataFrame:
    """``(report_id, item array<string>)`` -> ``(report_id, s, wide)``: the last element is the string, one between the first and it may say that it is wide."""
    value = F.element_at("item", -1)
    mark = F.exists(F.slice("item", F.lit(2), F.greatest(F.lit(0), F.size("item") - 2)), lambda m: F.coalesce(F.lower(m).isin("wide", "u16", "utf16le", "utf-16le"), F.lit(False)))
    return items.where((F.size("item") >= 2) & (F.length(value) > 0)).select("report_id", value.alias("s"), mark.alias("wide"))


def entropy_of(s: Column) -> Column:
    """Shannon entropy of a short string's characters, in bits, as one expression; for whole tables see :func:`char_entropy`."""
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    n = F.size(chars)
    share = lambda c: F.size(F.filter(chars, lambda d: d == c)) / n
    return -F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + share(c) * F.log2(share(c)))


def text_encoding(strings: DataFrame) -> DataFrame:
    """``textenc:`` logarithms and shares over the string entries ``(report_id, s, wide)``.

    Entropies are those of distinct strings of 4 to 8, or of 24 and more, characters, joined back.
    """
    n = F.length("s")
    alnum = n - F.length(F.regexp_replace("s", r"[\p{L}\p{N}+/=_-]", ""))
    b64 = (n >= 16) & (alnum > 0.92 * n) & F.col("s").rlike("[+/=]")
    bare = F.regexp_replace("s", r"\s", "")
    hexa = (F.length(bare) >= 16) & (F.length(bare) - F.length(F.regexp_replace(bare, "[0-9A-Fa-f]", "")) > 0.95 * F.length(bare))
    low = F.lower("s")
    asked = strings.where(n.between(4, 8) | (n >= 24)).select("s")
    rows = strings.join(char_entropy(asked), "s", "left")
    tests = {
        "base64ish": b64, "hexish": hexa, "urlish": F.contains(low, F.lit("://")) | F.contains(low, F.lit("%2f")), "pathish": F.col("s").rlike(r"[/\\]") | low.startswith("c:"),
        "unicode_escape": F.contains("s", F.lit("\\x")) | F.contains("s", F.lit("\\u")) | F.contains(low, F.lit("%u")), "wide": F.col("wide"), "high_entropy": (n >= 24) & (F.col("entropy") >= 4.0 - 1e-9),
        "long_token": n >= 80, "short_junk": n.between(4, 8) & (F.col("entropy") >= 2.4 - 1e-9),
    }
    rows = rows.groupBy("report_id").agg(*[F.avg(F.coalesce(t, F.lit(False)).cast("double")).alias(k) for k, t in tests.items()], F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean"), F.max(n).alias("most"))
    return long(rows, {"textenc:string_count_log": F.log1p("n"), "textenc:avg_len_log": F.log1p("mean"), "textenc:max_len_log": F.log1p("most"), **{f"textenc:{k}_ratio": k for k in tests}})


def char_entropy(strings: DataFrame) -> DataFrame:
    """Shannon entropy of the characters of each distinct string, in bits.

    Short strings count each of their characters by what is left without it, so
    that none of their characters is a row; long ones are counted as rows.
    """
    distinct = strings.select("s").distinct()
    n, short = F.length("s"), F.length("s") <= SHORT
    share = lambda c: (n - F.length(F.replace(F.col("s"), c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split("s", "")), F.lit(0.0), lambda a, c: F.when(c == "", a).otherwise(a - share(c) * F.log2(share(c))))
    rows = distinct.where(short & (n > 0)).select("s", bits.alias("entropy"))
    chars = distinct.where(~short).select("s", F.explode(F.filter(F.split("s", ""), lambda c: c != "")).alias("c"))
    counts = chars.groupBy("s", "c").agg(F.count(F.lit(1)).alias("n"))
    return rows.unionByName(counts.groupBy("s").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy")))


def assemble(features: DataFrame, spec: DataFrame, reports: DataFrame) -> DataFrame:
    """Sparse rows -> one dense vector for each of ``reports`` in the order of ``spec (pos, name, mean, std)``; unknown names drop, missing ones are 0.

    Standardized, but for a spread of 0 and the pair (0, 1), which give 0; a
    null spread keeps the value as it is.
    """
    flat = (F.abs("std") <= FLAT) | ((F.abs("mean") <= FLAT) & (F.abs(F.col("std") - 1) <= FLAT))
    rows = spec.select("pos", "name", "mean", "std").collect()  # a model's names
    zero = np.zeros(len(rows))
    for r in rows:
        spread = r.std is not None and abs(r.std) > FLAT and not (abs(r["mean"]) <= FLAT and abs(r.std - 1) <= FLAT)
        zero[r.pos] = -r["mean"] / r.std if spread else 0.0
    z = F.when(F.col("std").isNull(), F.col("value")).when(flat, 0.0).otherwise((F.col("value") - F.col("mean")) / F.col("std"))
    known = features.join(F.broadcast(spec), "name").select("report_id", "pos", z.alias("z"))
    every = reports.select("report_id").distinct()
    if len(rows) <= WIDE:
        # a column each: sums of one row by report, without lists
        cells = known.groupBy("report_id").agg(*[F.max(F.when(F.col("pos") == k, F.col("z"))).alias(f"z{k}") for k in range(len(rows))])
        vector = F.array(*[F.coalesce(f"z{k}", F.lit(float(v))) for k, v in enumerate(zero)])
        return every.join(cells, "report_id", "left").select("report_id", vector.alias("vector"))
    cells = known.groupBy("report_id").agg(F.collect_list("pos").alias("at"), F.collect_list("z").alias("z"))

    def dense(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for at, z in batches:
            out = []
            for p, v in zip(at, z, strict=True):
                row = zero.copy()
                if p is not None:
                    row[p] = v
                out.append(row)
            yield pd.Series(out)

    dense.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    cells = every.join(cells, "report_id", "left")
    return cells.select("report_id", F.pandas_udf(dense, "array<double>")("at", "z").alias("vector"))


def drift(spec: DataFrame, features: DataFrame) -> DataFrame:
    """Names that the spec has and no family wrote."""
    return spec.join(features.select("name").distinct(), "name", "left_anti").select("name")


def capped_triples(n: Column, reach: int = 19) -> Column:
    """Number of index triples i < j < k < n with k at most j + ``reach``."""
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), F.greatest(n.cast("int") - 2, F.lit(1))), F.lit(0).cast("long"), lambda a, j: a + j * F.least(F.lit(reach), n.cast("int") - 1 - j)))


def path_cooccurrence(paths: DataFrame, only: set[str] | None = None) -> DataFrame:
    """Logs of the numbers of pairs and capped triples of a report's suspicious paths, and of its objectives and well-known paths."""
    objective = F.col("path").startswith("objectives/") | F.col("path").startswith("well-known/")
    rows = paths.groupBy("report_id").agg(F.count_if(F.col("max_crit") >= 4).alias("s"), F.count_if(objective).alias("o"))
    pairs = lambda c: F.log1p(F.col(c) * (F.col(c) - 1) / 2)
    return long(rows, {"agg:suspicious_bigram_count": pairs("s"), "agg:suspicious_trigram_count": F.log1p(capped_triples(F.col("s"))), "agg:objective_bigram_count": pairs("o"), "agg:objective_trigram_count": F.log1p(capped_triples(F.col("o")))}, only)


def path_trigrams(file_paths: DataFrame, vocab: DataFrame, cap: int = 256) -> DataFrame:
    """``trigram:`` of the vocabulary ``(a, b, c)``, joined from the vocabulary."""
    rows = file_paths.where(F.size("paths") <= cap).select("report_id", "file_id", "paths")
    first = rows.select("report_id", "file_id", "paths", F.explode("paths").alias("a")).join(vocab, "a")
    hit = first.where(F.array_contains("paths", F.col("b")) & F.array_contains("paths", F.col("c")))
    return hit.select("report_id", F.concat(F.lit("trigram:"), "a", F.lit("+"), "b", F.lit("+"), "c").alias("name"), F.lit(1.0).alias("value")).distinct()


def import_tokens(lib: Column, name: Column) -> Column:
    """Bare name and ``lib!name`` (or the one of them that is not empty), each of two bytes or more."""
    lib, name = F.coalesce(lib, F.lit("")), F.coalesce(name, F.lit(""))
    both = F.when(lib == "", name).when(name == "", lib).otherwise(F.concat(lib, F.lit("!"), name))
    return F.array_distinct(F.filter(F.array(name, both), lambda t: F.octet_length(t) >= 2))


def normalize_token(c: Column, n: int) -> Column:
    """White space collapsed and trimmed, at most ``n`` characters."""
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, n)


def unsigned_bigrams(bigrams: DataFrame, paths: DataFrame) -> DataFrame:
    """``unsigned_bigram:`` of reports with the path ``metadata/unsigned``."""
    bare = paths.where("path = 'metadata/unsigned'").select("report_id").distinct()
    return bigrams.join(bare, "report_id", "left_semi").withColumn("name", F.regexp_replace("name", "^bigrams:", "unsigned_bigram:"))


def entry_symbols(entry: Column, imports: bool = True) -> Column:
    """Names in a VARIANT entry of a file's facts, not yet normalized.

    An import is ``[library, name]`` (the name, and both as ``library!name``),
    an object (its ``n``, ``name`` or ``symbol``) or a string; any other fact is
    a string or an array that begins with one.
    """
    said = lambda path: F.coalesce(F.try_variant_get(entry, path, "string"), F.lit(""))
    kind = F.schema_of_variant(entry)
    lib, name = said("$[0]"), said("$[1]")
    both = F.when(lib == "", name).when(name == "", lib).otherwise(F.concat(lib, F.lit("!"), name))
    whole = F.when(kind == "STRING", F.array(said("$")))
    if not imports:
        return whole.when(kind.startswith("ARRAY"), F.array(F.when(F.schema_of_variant(F.try_variant_get(entry, "$[0]", "variant")) == "STRING", lib)))
    named = F.coalesce(*[F.when(F.try_variant_get(entry, f"$.{n}", "variant").isNotNull(), said(f"$.{n}")) for n in ("n", "name", "symbol")], F.lit(""))
    return whole.when(kind.startswith("ARRAY"), F.array(name, both)).when(kind.startswith("OBJECT"), F.array(named))


def fact_symbols(facts: DataFrame) -> DataFrame:
    """``(report_id, file_id, kind, v variant)``, kind being import, export, function, target or member -> distinct ``(report_id, file_id, symbol)`` of two characters or more."""
    names = F.when(F.col("kind") == "import", entry_symbols(F.col("v"))).when(F.col("kind").isin("target", "member"), F.when(F.schema_of_variant("v") == "STRING", F.array(F.try_variant_get("v", "$", "string")))).otherwise(entry_symbols(F.col("v"), imports=False))
    rows = facts.select("report_id", "file_id", F.explode(names).alias("s"))
    return rows.select("report_id", "file_id", normalize_token(F.col("s"), 96).alias("symbol")).where(F.length("symbol") >= 2).distinct()


def symbols(imports: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Distinct ``(report_id, file_id, symbol)`` of imports and of ``named (report_id, file_id, name)``: exports, functions, targets and members; normalized to 96 characters."""
    lib, name = F.coalesce("lib", F.lit("")), F.coalesce("name", F.lit(""))
    both = F.when(lib == "", name).when(name == "", lib).otherwise(F.concat(lib, F.lit("!"), name))
    rows = imports.select("report_id", "file_id", F.explode(F.array(name, both)).alias("s"))
    if named is not None:
        rows = rows.unionByName(named.select("report_id", "file_id", F.col("name").alias("s")))
    return rows.select("report_id", "file_id", normalize_token(F.col("s"), 96).alias("symbol")).where(F.length("symbol") >= 2).distinct()


def symbol_presence(symbols: DataFrame) -> DataFrame:
    return symbols.select("report_id", F.concat(F.lit("symbol:"), "symbol").alias("name"), F.lit(1.0).alias("value")).distinct()


def symbol_ngrams(symbols: DataFrame, vocab: DataFrame, prefix: str = "symbol_bi:", first: int = 64) -> DataFrame:
    """``symbol_bi:`` (of a file's first 64 symbols in order) or ``symbol_tri:`` (first 24) of the vocabulary ``(a, b)`` or ``(a, b, c)``."""
    per_file = symbols.groupBy("report_id", "file_id").agg(F.slice(F.array_sort(F.collect_set("symbol")), 1, first).alias("s"))
    hit = per_file.select("report_id", "s", F.explode("s").alias("a")).join(vocab, "a")
    for part in vocab.columns[1:]:
        hit = hit.where(F.array_contains("s", F.col(part)))
    return hit.select("report_id", F.concat(F.lit(prefix), F.concat_ws("||", *vocab.columns)).alias("name"), F.lit(1.0).alias("value")).distinct()


def formula(formulas: DataFrame, findings: DataFrame) -> DataFrame:
    """``elements:``, ``rare:``, ``skeleton:`` and ``formula:`` of each report's ``formula``, a comma-separated list with subscripts.

    ``rare:`` weighs an element by the mean confidence of the report's active findings, 1 without any.
    """
    sums = B.by_id(findings).groupBy("report_id").agg(F.sum("n_active").alias("f"), (F.sum("conf") / F.sum("n_active")).alias("mean"))
    rows = formulas.join(sums, "report_id", "left").na.fill(0, ["f"])
    bare = F.translate("formula", "₀₁₂₃₄₅₆₇₈₉", "")
    parts = F.array_distinct(F.filter(F.transform(F.split(bare, ","), lambda e: F.trim(e)), lambda e: e != ""))
    each = rows.select("report_id", F.coalesce("mean", F.lit(1.0)).alias("mean"), F.explode(parts).alias("e"))
    each = each.select("report_id", F.inline(F.array(F.struct(F.concat(F.lit("elements:"), "e").alias("name"), F.lit(1.0).alias("value")), F.struct(F.concat(F.lit("rare:"), "e").alias("name"), F.col("mean").alias("value")))))
    skeleton = F.regexp_replace("formula", r"[^\p{L}]", "")
    kinds = F.size(F.array_distinct(F.filter(F.split(skeleton, ""), lambda c: c != "")))
    wide = long(rows, {"formula:skeleton_len": F.length(skeleton), "formula:unique_elements": kinds, "formula:complexity_ratio": F.when(F.col("f") > 0, F.length("formula") / F.col("f"))}).where("value is not null")
    whole = rows.where(skeleton != "").select("report_id", F.concat(F.lit("skeleton:"), skeleton).alias("name"), F.lit(1.0).alias("value"))
    return each.unionByName(wide).unionByName(whole)


def type_scores(files: DataFrame, only: set[str] | None = None) -> DataFrame:
    """``score:`` the report's risk (its root's, or its files' greatest) and risk over the logarithm of size; ``inter:type*score`` the same risk by file type."""
    rows = files.groupBy("report_id").agg(F.max("risk").alias("risk"), F.sum("size_bytes").alias("bytes"), F.collect_set("file_type").alias("types"))
    wide = long(rows, {"score:hopper_score": "risk", "score:density": F.when(F.col("bytes") > 0, F.col("risk") / F.log1p("bytes")).otherwise(0.0)}, only)
    if only is not None and not any(n.startswith("inter:") for n in only):
        return wide
    each = rows.select("report_id", F.explode("types").alias("t"), F.col("risk").cast("double").alias("value"))
    return wide.unionByName(each.select("report_id", F.concat(F.lit("inter:"), "t", F.lit("*score")).alias("name"), "value"))


def missing_paths(files: DataFrame, paths: DataFrame, expected: dict[str, tuple[str, ...]] = EXPECTED_PATHS) -> DataFrame:
    """``missing:type*path`` where the type is there and the expected path is not."""
    expected = files.sparkSession.createDataFrame([(t, p) for t, each in expected.items() for p in each], "file_type string, path string")
    want = files.select("report_id", "file_type").distinct().join(F.broadcast(expected), "file_type")
    return want.join(paths.select("report_id", "path").distinct(), ["report_id", "path"], "left_anti").select("report_id", F.concat(F.lit("missing:"), "file_type", F.lit("*"), "path").alias("name"), F.lit(1.0).alias("value"))
