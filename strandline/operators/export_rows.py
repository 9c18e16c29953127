"""Text of features: nine-column rows, keys of features without an ID."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import scalars

# Fixed order of the reserved attributes; the others follow by name, the linkage last.
RESERVED = ["Name", "Alias", "Target", "Gap", "Note"]
LINKAGE_KEY = "linkage_method"


def attribute_column(linkage: Column | None = None) -> Column:
    """Column 9 from source_id, parent_id and attributes: values escaped one by one."""
    escaped = lambda a: F.concat(scalars.percent_escape(a["key"]), F.lit("="), F.array_join(F.transform(a["values"], scalars.percent_escape), ","))
    rank = lambda a: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(r) for r in RESERVED]), a["key"]).cast("int"), F.lit(0)), F.lit(len(RESERVED) + 1))
    others = F.filter("attributes", lambda a: ~a["key"].isin("ID", "Parent", LINKAGE_KEY))
    ordered = F.transform(F.array_sort(F.transform(others, lambda a: F.struct(rank(a).alias("r"), a["key"].alias("k"), escaped(a).alias("t")))), lambda x: x["t"])
    head = F.array(F.concat(F.lit("ID="), scalars.percent_escape(F.col("source_id"))), F.concat(F.lit("Parent="), scalars.percent_escape(F.col("parent_id"))))
    last = F.array(F.concat(F.lit(f"{LINKAGE_KEY}="), linkage)) if linkage is not None else F.array().cast("array<string>")
    bare = F.array_join(F.array_compact(F.concat(head, last)), ";")  # many rows have no more
    text = F.when(F.size("attributes") == 0, bare).otherwise(F.array_join(F.array_compact(F.concat(head, ordered, last)), ";"))
    return F.when(text == "", ".").otherwise(text)


def gff3_line(linkage: Column | None = None) -> Column:
    """A row as nine tab-separated columns."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    return F.concat_ws("\t", F.col("seqid"), dot("program"), F.col("source_type"), F.col("start"), F.col("end"), scalars.score_text(F.col("score")), dot("strand"), dot("phase"), attribute_column(linkage))


def numbered_keys(rows: DataFrame) -> DataFrame:
    """rows with key: that of a feature without ID, with #n from its second appearance."""
    key = scalars.anonymous_key(*[F.col(c) for c in ("seqid", "source_type", "start", "end", "strand", "parent_id")])
    rows = rows.withColumn("key", key)
    n = F.row_number().over(Window.partitionBy("key").orderBy("row_id"))
    return rows.withColumn("_n", n).withColumn("key", F.when(F.col("_n") > 1, F.concat("key", F.lit("#"), F.col("_n"))).otherwise(F.col("key"))).drop("_n")
