"""Features as groups of rows: order, ownership of attributes, and the rules that the
rows of one feature must keep.

Functions take rows with ``source_id`` and the columns they name; a row whose
source_id is null is a feature of its own and belongs to no group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def feature_count() -> Column:
    """Features among rows: distinct IDs and rows without one."""
    return (F.count_distinct("source_id") + F.sum(F.col("source_id").isNull().cast("long"))).cast("long")


def with_segment_index(rows: DataFrame, *keys: str) -> DataFrame:
    """segment_index: rank of a row in its feature by coordinates, file order on ties."""
    w = Window.partitionBy(*(keys or ("source_id",))).orderBy("start", "end", "row_id")
    index = F.when(F.col("source_id").isNull(), 0).otherwise(F.row_number().over(w) - 1)
    return rows.withColumn("segment_index", index.cast("long"))


def attributes_by_segment(rows: DataFrame, value: str) -> DataFrame:
    """own: a row's attributes where they differ from those of its feature's first row by
    coordinates, which holds the feature's (in shared)."""
    w = Window.partitionBy("source_id").orderBy("start", "end", "row_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shared = F.when(F.col("source_id").isNull(), F.col(value)).otherwise(F.first(value).over(w))
    rows = rows.withColumn("shared", shared)
    return rows.withColumn("own", F.when(~F.col(value).eqNullSafe(F.col("shared")), F.col(value)))


def overlapping_segments(rows: DataFrame, exempt: Column | None = None) -> DataFrame:
    """(source_id, row_a, row_b): rows of one feature that overlap, a before b by coordinates.

    A running maximum first finds the features in which any two rows overlap, so the pairs
    are made for those alone.
    """
    named = rows.filter("source_id is not null")
    w = Window.partitionBy("source_id").orderBy("start", "end", "row_id")
    hit = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("start")
    suspects = named.withColumn("_hit", hit).withColumn("_n", F.row_number().over(w))
    suspects = suspects.withColumn("_any", F.max("_hit").over(Window.partitionBy("source_id"))).filter("_any")
    a, b = suspects.alias("a"), suspects.alias("b")
    on = (F.col("a.source_id") == F.col("b.source_id")) & (F.col("a._n") < F.col("b._n")) & (F.col("a.end") >= F.col("b.start"))
    pairs = a.join(b, on)
    if exempt is not None:
        pairs = pairs.filter(~F.coalesce(exempt, F.lit(False)))
    return pairs.select(F.col("a.source_id").alias("source_id"), F.col("a.row_id").alias("row_a"), F.col("b.row_id").alias("row_b"))


def repeated_ids(rows: DataFrame, unique_types: list[str], shared: Column | None = None) -> DataFrame:
    """(source_id, n): IDs that rows of a type share whose IDs must be unique."""
    rows = rows.filter(F.col("source_id").isNotNull() & F.col("source_type").isin(unique_types))
    groups = rows.groupBy("source_id").agg(F.count("*").alias("n"), F.min(shared if shared is not None else F.lit(False)).alias("_shared"))
    return groups.filter((F.col("n") > 1) & ~F.col("_shared")).select("source_id", "n")


def mismatched_rows(rows: DataFrame, strand_exempt: Column | None = None) -> DataFrame:
    """(source_id, row_id, fields): rows that differ from the first row of their feature, in
    file order, in sequence, type, strand or parent; nulls are equal."""
    w = Window.partitionBy("source_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fields = []
    for c in ("seqid", "source_type", "strand", "parent_id"):
        differs = ~F.col(c).eqNullSafe(F.first(c).over(w))
        if c == "strand" and strand_exempt is not None:
            differs = differs & ~strand_exempt
        fields.append(F.when(differs, c))
    out = rows.filter("source_id is not null").withColumn("fields", F.concat_ws(",", *fields))
    return out.filter("fields <> ''").select("source_id", "row_id", "fields")


def regroup(rows: DataFrame) -> DataFrame:
    """A row for each feature: its envelope, its type and parent by the first coordinate row,
    strand '?' where its rows differ, and its segments in order; rows without ID stay alone."""
    key = F.coalesce("source_id", F.concat(F.lit("\x00"), F.col("row_id").cast("string")))
    seg = F.struct("start", "end", "row_id", "strand", "phase", "seqid", "source_type", "parent_id")
    g = rows.groupBy(key.alias("_key"), "source_id").agg(F.array_sort(F.collect_list(seg)).alias("s"))  # of one feature
    first = F.get("s", F.lit(0))
    strands = F.array_distinct(F.transform("s", lambda x: x["strand"]))
    return g.select(
        "source_id", first["row_id"].alias("first_row"), first["seqid"].alias("seqid"), first["source_type"].alias("source_type"), first["parent_id"].alias("parent_id"),
        first["start"].alias("start"), F.array_max(F.transform("s", lambda x: x["end"])).alias("end"),
        F.when(F.size(strands) > 1, "?").otherwise(F.get(strands, F.lit(0))).alias("strand"),
        F.size("s").cast("long").alias("n_segments"), F.array_join(F.transform("s", lambda x: F.concat_ws("-", x["start"], x["end"])), ",").alias("segments"),
    )
