"""Second-opinion grades: text guards, the grade cache, and the guarded blend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.operators.verdicts import level_conf

#: Gate, steer shares and reason length.
GATE_P, UP, DOWN, REASON = 0.01, 0.33, 0.67, 120


def sanitize(text: Column) -> Column:
    """No ANSI sequences, ``!!`` as ``/``."""
    return F.replace(F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", ""), F.lit("!!"), F.lit("/"))


def annotation(line: Column) -> Column:
    """Letter of an annotation comment, empty if the line is none."""
    return F.regexp_extract(line, r"^\s*(?://|--|#) ([HSNBCF])(?: |$)", 1)


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"(?U)^\s+|\s+$", "")


def binary_line(line: Column) -> Column:
    """Without blanks at its ends at least 16 bytes, and two escapes or under three quarters printable: blank to tilde, or tab."""
    s = _trimmed(line)
    n = F.length(s)
    printable = n - F.length(F.regexp_replace(s, r"[ -~\t]", ""))
    return (F.octet_length(s) >= 16) & ((F.regexp_count(s, F.lit(r"\\x|\\0")) >= 2) | (printable * 100 < n * 75))


def guard_texts(texts: DataFrame, phrases: list[str], id_cols: tuple[str, ...] = ("id",)) -> DataFrame:
    """Per text: elevated and hostile marks, readable, and whether it addresses its analyzer.

    A phrase counts whatever its case. A text is readable if fewer than half of
    its context lines, annotations and blank lines not among them, are binary;
    one without context lines is.
    """
    clean = texts.withColumn("t", sanitize(F.col("text")))
    lines = clean.select(*id_cols, "t", F.explode_outer(F.split("t", "\n")).alias("line"))
    said = F.exists(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower("t"), p))
    mark = annotation(F.col("line"))
    context = (mark == "") & (_trimmed(F.col("line")) != "")
    binary, total = F.count_if(context & binary_line(F.col("line"))), F.count_if(context)
    rows = lines.groupBy(*id_cols).agg(F.bool_or(mark.isin("H", "S")).alias("elevated"), F.bool_or(mark == "H").alias("hostile"), ((total == 0) | (binary * 2 < total)).alias("readable"))
    return rows.join(clean.select(*id_cols, said.alias("addresses_analyzer")).distinct(), list(id_cols))


def needs_grade(rows: DataFrame) -> DataFrame:
    return rows.where(((F.col("prob") >= GATE_P) | F.col("elevated")) & (F.trim("text") != ""))


def prompt_key(model: Column, system: Column, user: Column) -> Column:
    zero = F.lit("\x00")
    return F.sha2(F.concat(model, zero, system, zero, user), 256)


def with_grades(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Stored grades by prompt key; rows without one have a null grade: the pending work."""
    return rows.join(cache.select("key", "grade", "reason"), "key", "left")


def parse_grade(reply: Column) -> Column:
    """First ``{`` to last ``}`` as ``{grade, reason}``; an unknown grade or unreadable reply is null."""
    got = F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "grade string, reason string")
    reason = F.substring(F.trim(F.regexp_replace(got["reason"], r"\s+", " ")), 1, REASON)
    return F.when(got["grade"].isin("benign", "suspicious", "hostile"), F.struct(got["grade"].alias("grade"), reason.alias("reason")))


def steer(p: Column, up: Column) -> Column:
    return F.when(up, p + (1 - p) * UP).otherwise(p * DOWN)


def near_boundary(fired: Column, active: Column) -> Column:
    """Whether the confidences of two levels are within one steer of each other; without levels (manual mode) they are."""
    a, b = (F.coalesce(level_conf(x), F.lit(0)) / 100 for x in (fired, active))
    return F.when(fired.isNull() | active.isNull(), True).otherwise(steer(F.least(a, b), F.lit(True)) >= F.greatest(a, b) - 1e-9)


def blend(rows: DataFrame) -> DataFrame:
    """One step of class toward the grade, and a steered score.

    The score steers whether or not the class may move. A step into hostile
    needs a hostile finding or a verdict near the boundary, a step out of it the
    latter. A grade that agrees firms the score up, or down if it is benign.
    Whatever softens needs a readable text that does not address its analyzer.
    ``rows``: class, prob, grade (null: nothing changes), readable,
    addresses_analyzer, hostile_finding, near.
    """
    cls, p = F.col("class"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("prob")))
    want = F.when(F.col("grade") == "hostile", 2).when(F.col("grade") == "suspicious", 1).when(F.col("grade") == "benign", 0)
    trusted = F.col("readable") & ~F.col("addresses_analyzer")
    up, down = (want > cls) | ((want == cls) & (cls > 0)), ((want < cls) | ((want == cls) & (cls == 0))) & trusted
    to = F.when(want > cls, cls + 1).when((want < cls) & trusted, cls - 1).otherwise(cls)
    allowed = ((to == 2) == (cls == 2)) | F.col("near") | ((to == 2) & F.col("hostile_finding"))
    graded = want.isNotNull()
    prob = F.when(~graded, F.col("prob")).when(up, steer(p, F.lit(True))).when(down, steer(p, F.lit(False))).otherwise(p)
    return rows.withColumn("new_class", F.when(graded & allowed, to).otherwise(cls)).withColumn("new_prob", prob)


def grade_eval(grades: DataFrame) -> DataFrame:
    """Exact and acceptable counts by arm and batch, with totals (``rollup``)."""
    return grades.rollup("arm", "batch").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") == F.col("truth")).alias("exact"), F.count_if(F.abs(F.col("grade") - F.col("truth")) <= 1).alias("acceptable"))
