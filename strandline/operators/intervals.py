"""Interval joins and bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.bins import bin_of, bins_overlapping
from strandline.operators import graph


COPIES = 1000  # regions of one place that are met as one


def rows_in_regions(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """(region, and the columns of rows) of rows that overlap a region.

    regions: (region, seqid, start, end), and seen_start and seen_end where a second look
    leaves out what the first found.  Regions of one place are met as one, and told apart in
    the result; an equi-join on sequence and bin prunes, the overlap decides; a row has one
    bin, so no pair appears twice.
    """
    place = [c for c in ("seqid", "start", "end", "seen_start", "seen_end") if c in regions.columns]
    nth = F.row_number().over(Window.partitionBy(*place).orderBy("region"))  # of one place
    places = regions.withColumn("_share", F.floor((nth - 1) / COPIES)).groupBy(*place, "_share").agg(F.collect_list("region").alias("_regions"))
    hit = _met(rows, graph._cut(places), "inner")
    return hit.select(F.explode("_regions").alias("region"), *rows.columns)


def touched_features(rows: DataFrame, regions: DataFrame) -> DataFrame:
    """All rows of the features that have a row in any region.  Rows meet the places of
    regions without being multiplied by them."""
    name = F.coalesce("source_id", F.concat(F.lit("\x00"), F.col("row_id").cast("string")))  # a row without ID is alone
    touched = _met(rows, graph._cut(regions.select("seqid", "start", "end").distinct()), "left_semi")
    return rows.join(touched.select(name.alias("_name")).distinct(), name == F.col("_name"), "left_semi")


def _met(rows: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """rows joined with the places that overlap them."""
    names = {"seqid": "_seq", "start": "_s", "end": "_e", "seen_start": "_s0", "seen_end": "_e0"}
    wanted = places.withColumn("_bin", F.explode(bins_overlapping(F.col("start"), F.col("end")))).withColumnsRenamed(names)
    rows = rows.withColumn("_rowbin", bin_of(F.col("start"), F.col("end")))
    on = (F.col("seqid") == F.col("_seq")) & (F.col("_rowbin") == F.col("_bin")) & (F.col("start") <= F.col("_e")) & (F.col("end") >= F.col("_s"))
    if "_s0" in wanted.columns:
        on = on & (F.col("_s0").isNull() | (F.col("start") > F.col("_e0")) | (F.col("end") < F.col("_s0")))
    return rows.join(wanted, on, how).drop("_rowbin")


def with_second_look(regions: DataFrame, sequences: DataFrame) -> DataFrame:
    """regions, and on circular sequences each again shifted by the length: rows that cross
    the origin are stored past the end.  What the first look at a region finds, the second
    leaves out."""
    shifted = regions.join(sequences.filter("circular").select("seqid", "length"), "seqid")
    shifted = shifted.select("region", "seqid", (F.col("start") + F.col("length")).alias("start"), (F.col("end") + F.col("length")).alias("end"), F.col("start").alias("seen_start"), F.col("end").alias("seen_end"))
    return regions.select("region", "seqid", "start", "end").unionByName(shifted, allowMissingColumns=True)


def clipped(regions: DataFrame, sequences: DataFrame) -> DataFrame:
    """Regions with their end clipped to the sequence, without those that start past it."""
    r = regions.join(sequences.select("seqid", "length"), "seqid")
    return r.filter(F.col("start") <= F.col("length")).select("region", "seqid", "start", F.least("end", "length").alias("end"))


def whole_features(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """All rows of the features that a selection of rows (row_id, source_id) touches."""
    names = hits.filter("source_id is not null").select(F.col("source_id").alias("_name")).distinct()
    alone = hits.filter("source_id is null").select(F.col("row_id").alias("_row")).distinct()
    named = rows.filter("source_id is not null").join(names, F.col("source_id") == F.col("_name"), "left_semi")
    return named.unionByName(rows.filter("source_id is null").join(alone, F.col("row_id") == F.col("_row"), "left_semi"))


def bounds_outcome(start: Column, end: Column, length: Column, circular: Column) -> Column:
    """ok, crosses_origin, wrapped or refused."""
    circular = F.coalesce(circular, F.lit(False))
    return (
        F.when(end <= length, "ok")
        .when(circular & (start <= length) & (end <= 2 * length), "crosses_origin")
        .when(circular & (start > length) & (end <= 2 * length), "wrapped")
        .otherwise("refused")
    )


def contains_all(child: Column, parent: Column) -> Column:
    """Every span of child lies in some span of parent; both arrays of (start, end)."""
    return F.forall(child, lambda c: F.exists(parent, lambda p: (p["start"] <= c["start"]) & (p["end"] >= c["end"])))


def unique_container(children: DataFrame, parents: DataFrame) -> DataFrame:
    """child, parent, n: the candidates of each child under the same gene that contain it.

    children, parents: (id, gene, spans).
    """
    p = parents.select(F.col("id").alias("parent"), F.col("gene").alias("_gene"), F.col("spans").alias("_spans"))
    hits = children.join(p, F.col("gene") == F.col("_gene")).filter(contains_all(F.col("spans"), F.col("_spans")))
    return hits.groupBy(F.col("id").alias("child")).agg(F.min("parent").alias("parent"), F.count("*").alias("n"))
