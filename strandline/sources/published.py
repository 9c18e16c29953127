"""Published count tables and protein files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.reconcile import published_counts
from strandline.sources import files

# Fixed layout of the published table: seven tab-separated columns.
COLUMNS = ["feature", "class", "full_assembly", "unit_accession", "unit_name", "unique_ids", "placements"]


def read_published(spark: SparkSession, path: str, accession: str, *, unit: str | None = None) -> DataFrame:
    """feature, n of one assembly: unique ids, else placements, summed over classes.

    The components are summed where there are any, else the rollup is used; ``unit``
    selects one of them by accession or by name.
    """
    rows = files.lines(spark, path).filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).withColumn("c", F.split("value", "\t")).filter(F.size("c") >= len(COLUMNS))
    rows = rows.select(*[F.trim(F.col("c")[i]).alias(n) for i, n in enumerate(COLUMNS)]).filter(F.col("full_assembly") == accession)
    rows = rows.withColumn("unit", F.when(F.lower("unit_name") == "all", "all").otherwise(F.coalesce(F.nullif("unit_accession", F.lit("")), "unit_name")))
    if unit is not None:
        rows = rows.filter((F.col("unit_accession") == unit) | (F.col("unit_name") == unit))
    return published_counts(rows)


def protein_fasta(proteins: DataFrame, width: int = 60) -> DataFrame:
    """(gene, value): records of (gene, protein), wrapped; order by gene when writing."""
    body = F.regexp_replace(F.regexp_replace("protein", f"(.{{{width}}})", "$1\n"), "\n$", "")
    return proteins.select("gene", F.concat(F.lit(">"), "gene", F.lit("\n"), body).alias("value"))
