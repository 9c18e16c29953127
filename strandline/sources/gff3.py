"""Nine-column annotation text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.sources import files

ATTRIBUTES = "array<struct<key:string,values:array<string>>>"


@dataclass
class AnnotationFile:
    """rows, directives (seqid, start, end), comments (line, text), and what is wrong
    (line, rule, detail)."""

    path: str
    rows: DataFrame
    directives: DataFrame
    comments: DataFrame
    problems: DataFrame
    format: str = "gff3"


def read(spark: SparkSession, path: str, *, tolerate_inverted: bool = False) -> AnnotationFile:
    """Reads a file.  Lines after ##FASTA are no annotation; blank lines are skipped.

    Rows that break a rule are in problems and not in rows; a file without rows has one
    problem of its own, at line 0.
    """
    text = files.lines(spark, path).drop("file")
    end = text.filter(F.startswith("value", F.lit("##FASTA"))).agg(F.min("line")).first()[0]
    if end is not None:
        text = text.filter(F.col("line") < end)
    text = text.filter(F.trim("value") != "")
    comment = F.startswith("value", F.lit("#"))
    comments = text.filter(comment).select("line", F.col("value").alias("text"), "block")
    region = "^##sequence-region\\s+(\\S+)\\s+(\\d+)\\s+(\\d+)"
    found = [F.regexp_extract("text", region, i) for i in (1, 2, 3)]
    directives = comments.filter(F.col("text").rlike(region)).select("line", scalars.percent_decode(found[0]).alias("seqid"), found[1].cast("long").alias("start"), found[2].cast("long").alias("end"))

    cols = F.split("value", "\t")
    c = [F.col("c")[i] for i in range(9)]
    raw = text.filter(~comment).select("line", F.explode(F.array(cols)).alias("c"))  # split once: a filter isn't moved below an explode, where each use of c would split again
    start, stop = c[3].try_cast("long"), c[4].try_cast("long")
    score, phase = F.when(c[5] != ".", c[5].try_cast("double")), F.when(c[7] != ".", c[7].try_cast("long"))
    rules = [
        ("columns", F.size("c") != 9, F.concat(F.size("c").cast("string"), F.lit(" columns"))),
        ("number", start.isNull() | stop.isNull(), F.concat_ws("..", c[3], c[4])),
        ("start", start < 1, c[3]),
        ("inverted", (stop < start) if not tolerate_inverted else F.lit(False), F.concat_ws("..", c[3], c[4])),
        ("strand", ~c[6].isin("+", "-", ".", "?"), c[6]),
        ("phase", ~c[7].isin("0", "1", "2", "."), c[7]),
        ("score", (c[5] != ".") & score.isNull(), c[5]),
        ("attribute", scalars.attribute_without_value(c[8]), c[8]),
    ]
    rule, detail = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, bad, what in reversed(rules):
        bad = F.coalesce(bad, F.lit(False)) if name == "columns" else F.coalesce((F.size("c") == 9) & bad, F.lit(False))
        rule, detail = F.when(bad, name).otherwise(rule), F.when(bad, what).otherwise(detail)
    judged = raw.withColumn("rule", rule).withColumn("detail", detail)
    problems = judged.filter("rule is not null").select("line", "rule", "detail")
    rows = judged.filter("rule is null").select(
        F.col("line").alias("row_id"), scalars.percent_decode(c[0]).alias("seqid"), c[1].alias("program"), c[2].alias("source_type"), start.alias("start"), stop.alias("end"),
        score.alias("score"), c[6].alias("strand"), phase.alias("phase"), (stop < start).alias("inverted"), scalars.parse_attributes(c[8]).alias("attributes"),
    )
    a = F.col("attributes")
    rows = rows.withColumn("source_id", scalars.first_value(a, "ID")).withColumn("parents", scalars.all_values(a, "Parent"))
    empty = raw.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(F.lit(0).cast("long").alias("line"), F.lit("empty").alias("rule"), F.lit("no annotation rows").alias("detail"))
    return AnnotationFile(path, rows, directives, comments, problems.unionByName(empty))


def looks_like_genbank(spark: SparkSession, path: str) -> bool:
    """The first line that isn't blank starts with LOCUS."""
    return (files.first_line(spark, path) or "").startswith("LOCUS")
