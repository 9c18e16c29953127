"""An independent count of nine-column text.

Imports nothing of this package: a fault of the parser must not be able to hide here.
Counts by regular expressions on the raw line: features are distinct (type, ID) and
rows without an ID.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_lines(lines: DataFrame) -> DataFrame:
    """source_type, features, n_rows, with_parent from lines (value)."""
    tabs = F.length("value") - F.length(F.replace("value", F.lit("\t"), F.lit("")))
    rows = lines.filter(~F.startswith("value", F.lit("#")) & (tabs >= 8))
    nine = F.split_part("value", F.lit("\t"), F.lit(9))
    ident = F.regexp_extract(nine, "(?:^|;)ID=([^;]*)", 1)
    parent = F.regexp_extract(nine, "(?:^|;)\\s*Parent=([^;]*)", 1)
    rows = rows.select(F.split_part("value", F.lit("\t"), F.lit(3)).alias("source_type"), F.when(ident != "", ident).alias("i"), (parent != "").alias("p"))
    return rows.groupBy("source_type").agg((F.count_distinct("i") + F.sum(F.col("i").isNull().cast("long"))).alias("features"), F.count("*").alias("n_rows"), F.count_if("p").alias("with_parent"))


def count_genbank(lines: DataFrame) -> DataFrame:
    """source_type, features of the feature tables of flat files, but for source records."""
    key = F.regexp_extract("value", "^ {5}([A-Za-z0-9_'-]+) +", 1)
    rows = lines.filter(F.startswith("value", F.lit("     ")) & (key != "") & (key != "source") & (F.length("value") > 21))
    return rows.groupBy(key.alias("source_type")).agg(F.count("*").alias("features"))
