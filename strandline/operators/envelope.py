"""Parents must span their children: the check, and the bottom-up repair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import graph
from strandline.sources import files


def envelopes(rows: DataFrame) -> DataFrame:
    """id, parent_id, start, end, n_segments of named features."""
    g = rows.filter("source_id is not null").groupBy(F.col("source_id").alias("id"))
    return g.agg(F.min("parent_id").alias("parent_id"), F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_segments"))


def violations(features: DataFrame) -> DataFrame:
    """id, parent_id, start, end, parent_start, parent_end of features outside their parent."""
    p = features.select(F.col("id").alias("_pid"), F.col("start").alias("parent_start"), F.col("end").alias("parent_end"))
    rows = features.join(p, F.col("parent_id") == F.col("_pid"))
    return rows.filter((F.col("start") < F.col("parent_start")) | (F.col("end") > F.col("parent_end"))).select("id", "parent_id", "start", "end", "parent_start", "parent_end")


def repair(features: DataFrame) -> DataFrame:
    """id, start, end, old_start, old_end: features after widening, deepest first.

    Only features of one segment change: they widen to hold their children, and one whose
    start lies after its end takes its children's extent.  A feature's children are all
    one level below it, so a level is read with the finished one below and written once;
    what is written follows the number of features, whatever their depth.
    """
    depth = graph.roots(features.select("id", "parent_id")).select(F.col("id").alias("_id"), "depth")
    spark = features.sparkSession
    path = files.scratch(spark, "levels")
    features.join(depth, F.col("id") == F.col("_id")).select("id", "parent_id", "start", "end", "n_segments", "depth").write.partitionBy("depth").parquet(path)
    levels = spark.read.parquet(path)  # a level's filter reads its folder alone
    counts = {int(r.depth) for r in levels.select("depth").distinct().collect()}  # a row for each level
    old = [F.col("start").alias("old_start"), F.col("end").alias("old_end")]
    done, below = [], None
    for d in sorted(counts, reverse=True):
        level = levels.filter(F.col("depth") == d)
        if d < 0 or below is None or d + 1 not in counts:  # on a cycle, or without children
            below = level.select("id", "parent_id", "start", "end", *old)
        else:
            child = below.groupBy(F.col("parent_id").alias("_pid")).agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"))
            rows = level.join(child, F.col("id") == F.col("_pid"), "left")
            at = (F.col("n_segments") == 1) & F.col("_lo").isNotNull()
            bad = F.col("start") > F.col("end")
            lo = F.when(at, F.when(bad, F.col("_lo")).otherwise(F.least("start", "_lo"))).otherwise(F.col("start"))
            hi = F.when(at, F.when(bad, F.col("_hi")).otherwise(F.greatest("end", "_hi"))).otherwise(F.col("end"))
            below = graph._cut(rows.select("id", "parent_id", lo.alias("start"), hi.alias("end"), *old))
        done.append(below)
    return reduce(DataFrame.unionByName, done) if done else features.select("id", "parent_id", "start", "end", *old)
