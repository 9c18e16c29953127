"""Functional annotation: resolving query names to features, and term questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Attributes that may hold the name under which a protein was annotated.
LOOKUP_ATTRIBUTES = ["protein_id", "transcript_id", "orig_protein_id", "orig_transcript_id", "locus_tag", "Name", "gene"]
LOOKUP_TYPES = ["CDS", "mRNA"]


def tail(name: Column) -> Column:
    """What follows the last bar of a name that has one."""
    return F.when(F.contains(name, F.lit("|")), F.substring_index(name, "|", -1))


def identifier_index(names: DataFrame) -> DataFrame:
    """(key, feature_id), distinct, from (feature_id, name): the names and their tails."""
    keys = names.select("feature_id", F.explode(F.array("name", tail(F.col("name")))).alias("key"))
    return keys.filter("key is not null and key <> ''").select("key", "feature_id").distinct()


def resolve(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query_id, feature_id, n: the whole name, else its first field, else the tail after a
    bar; the first of these that is known decides.  n is the number of features it
    names: 0 is unmatched, more than 1 ambiguous, and feature_id is then null."""
    q = queries.select("query_id").distinct()
    forms = F.array(F.col("query_id"), F.split(F.trim("query_id"), "\\s+")[0], tail(F.col("query_id")))
    tries = q.select("query_id", F.posexplode(forms).alias("turn", "_k")).filter("_k is not null")
    hits = tries.join(index, F.col("_k") == F.col("key")).groupBy("query_id", "turn").agg(F.count_distinct("feature_id").alias("n"), F.min("feature_id").alias("feature_id"))
    best = hits.groupBy("query_id").agg(F.min(F.struct("turn", "n", "feature_id")).alias("b"))
    out = q.join(best, "query_id", "left")
    return out.select("query_id", F.when(F.col("b.n") == 1, F.col("b.feature_id")).alias("feature_id"), F.coalesce("b.n", F.lit(0)).cast("long").alias("n"))


def match_rate(resolved: DataFrame) -> DataFrame:
    """One row: queries, matched, unmatched, ambiguous, rate (of all queries, to four places)."""
    total = resolved.agg(F.count("*").alias("queries"), F.count_if(F.col("n") == 1).alias("matched"), F.count_if(F.col("n") == 0).alias("unmatched"), F.count_if(F.col("n") > 1).alias("ambiguous"))
    return total.withColumn("rate", F.when(F.col("queries") > 0, F.round(F.col("matched") / F.col("queries"), 4)).otherwise(0.0))


def deduplicated(hits: DataFrame, order: list[Column]) -> DataFrame:
    """The first hit, in order, for each feature, analysis, accession and protein start."""
    w = Window.partitionBy("feature_id", "analysis", "accession", "protein_start").orderBy(*order)
    return hits.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def with_term(annotations: DataFrame, variants: list[str], analysis: str | None = None) -> DataFrame:
    """Hits whose whole accession is one of the variants, in an analysis if one is named."""
    out = annotations.filter(F.col("accession").isin(variants))
    return out.filter(F.lower("analysis") == analysis.lower()) if analysis else out


def top_accessions(annotations: DataFrame) -> DataFrame:
    """analysis, accession, features: the accession of the most features, by name on ties."""
    g = annotations.groupBy("analysis", "accession").agg(F.count_distinct("feature_id").alias("features"))
    w = Window.partitionBy("analysis").orderBy(F.desc("features"), "accession")
    return g.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
