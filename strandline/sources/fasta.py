"""Sequence files: lengths of the sequences, what is wrong with them, and an index of their places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.sources import files


def read_sequences(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(seqid, length, ordinal), and problems (rule, subject): no sequence, an empty one,
    a name twice.

    Lines are summed by the number of the header before them, so only headers are
    ordered.
    """
    text = files.lines(spark, path).select("line", F.trim("value").alias("value"))
    head = F.startswith("value", F.lit(">"))
    headers = text.filter(head).withColumn("ordinal", F.row_number().over(Window.orderBy("line")))  # a row for each sequence
    headers = headers.select("ordinal", F.regexp_extract("value", "^>\\s*(\\S*)", 1).alias("seqid"), F.col("line").alias("_from"))
    until = F.lead("_from").over(Window.orderBy("_from"))
    headers = headers.withColumn("_to", until)
    # the record of a line, by a running count that is partial before it is global
    block = F.floor(F.col("line") / 4096)
    body = text.withColumn("_block", block)
    counts = body.groupBy("_block").agg(F.count_if(head).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.sum(head.cast("int")).over(Window.partitionBy("_block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = body.join(before, "_block").withColumn("ordinal", inside + F.col("_before")).filter(~head & (F.col("value") != ""))
    sizes = placed.groupBy("ordinal").agg(F.sum(F.length("value")).alias("length"))
    out = headers.select("ordinal", "seqid").join(sizes, "ordinal", "left").select("seqid", F.coalesce("length", F.lit(0)).cast("long").alias("length"), F.col("ordinal").cast("long").alias("ordinal"))
    twice = out.groupBy("seqid").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("name twice").alias("rule"), F.col("seqid").alias("subject"))
    none = out.filter("length = 0").select(F.lit("empty sequence").alias("rule"), F.col("seqid").alias("subject"))
    empty = out.limit(1).agg(F.count("*").alias("n")).filter("n = 0").select(F.lit("no sequence").alias("rule"), F.lit(path).alias("subject"))
    return out, twice.unionByName(none).unionByName(empty)


def index(spark: SparkSession, path: str) -> DataFrame:
    """seqid, length, offset, line_bases, line_width, even: a row for each sequence, as an index file has it.

    offset is the byte at which the first base lies, a folder's files counting as one.  A
    base is found by arithmetic only if all lines but the last are equally long and none
    is longer or blank, which ``even`` tells.  Bytes are summed within splits, then over
    them, so a file of any size is read once in parallel.
    """
    width = F.octet_length("value") + 1
    rows = files.raw_lines(spark, path).withColumn("_head", F.startswith("value", F.lit(">")))
    rows = files.carried_sum(files.carried_sum(rows, "_after", width.cast("long")), "ordinal", F.col("_head").cast("int")).filter("ordinal > 0")
    bases = F.length(F.trim("value", F.lit(" \t\r")))
    text = ~F.col("_head") & (bases > 0)
    only = lambda c: F.when(text, c)
    out = rows.groupBy("ordinal").agg(
        F.max(F.when(F.col("_head"), F.regexp_extract("value", "^>\\s*(\\S*)", 1))).alias("seqid"), F.coalesce(F.sum(only(bases)), F.lit(0)).cast("long").alias("length"), F.max(F.when(F.col("_head"), F.col("_after"))).alias("offset"),
        F.coalesce(F.min_by(only(bases), only(F.col("line"))), F.lit(0)).cast("long").alias("line_bases"), F.coalesce(F.min_by(only(width), only(F.col("line"))), F.lit(0)).cast("long").alias("line_width"),
        F.max_by(only(bases), only(F.col("line"))).alias("_last"), F.max(only(bases)).alias("_most"), F.count_if(text).alias("_n"), F.min(only(F.col("line"))).alias("_from"), F.max(only(F.col("line"))).alias("_to"), F.max(F.when(F.col("_head"), F.col("line"))).alias("_at"),
    )
    full = (F.col("_most") == F.col("line_bases")) & (F.col("length") == (F.col("_n") - 1) * F.col("line_bases") + F.col("_last")) & (F.col("_to") - F.col("_at") == F.col("_n"))
    return out.select("ordinal", "seqid", "length", "offset", "line_bases", "line_width", F.coalesce(full, F.lit(True)).alias("even"))


def index_lines(indexed: DataFrame) -> DataFrame:
    """(ordinal, value): the lines of an index file, in the order of the sequences."""
    return indexed.select("ordinal", F.concat_ws("\t", "seqid", "length", "offset", "line_bases", "line_width").alias("value"))


def place(offset: int, line_bases: int, line_width: int, base: int) -> int:
    """The byte of a base, bases from 0."""
    return offset + base // line_bases * line_width + base % line_bases if line_bases else offset


def fetch(spark: SparkSession, path: str, indexed: DataFrame, seqid: str, start: int, end: int) -> str:
    """Bases start to end, from 1, of a sequence: only their bytes are read."""
    r = indexed.filter(F.col("seqid") == seqid).first()
    if r is None or not r.even or not 1 <= start <= end <= r.length:
        raise ValueError(f"{seqid}:{start}-{end} can't be found by the index")
    at = [place(r.offset, r.line_bases, r.line_width, x) for x in (start - 1, end - 1)]
    return "".join(files.read_range(spark, path, at[0], at[1] - at[0] + 1).decode().split())
