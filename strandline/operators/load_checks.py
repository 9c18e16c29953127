"""Checks over several files of one load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_file_collisions(rows: DataFrame) -> DataFrame:
    """source_id, files: IDs that more than one file uses."""
    g = rows.filter("source_id is not null").groupBy("source_id").agg(F.count_distinct("file").alias("files"))
    return g.filter("files > 1")


def unknown_sequences(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """seqid, n: rows on sequences that the assembly lacks."""
    return rows.join(sequences.select("seqid"), "seqid", "left_anti").groupBy("seqid").agg(F.count("*").alias("n"))
