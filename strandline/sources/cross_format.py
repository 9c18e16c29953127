"""Counts of one annotation in two formats, and what one of them states by rule alone.

Where a flat file states a gene's coding sequence and no mRNA, the nine-column text of the
same annotation gives the gene an mRNA all the same.  These are set aside before the counts
are compared; every other type and gene must agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import reconcile, segments
from strandline.sources import files

# Types that one format has and the other implies or leaves out.
STRUCTURAL = ["exon", "region", "gap", "assembly_gap", "sequence_feature", "misc_feature"]


def _keys(kind: Column, value: Column) -> Column:
    """(kind, value) of a qualifier: GeneIDs of a list of cross-references, else the value."""
    ids = F.filter(F.split(value, ","), lambda v: F.startswith(v, F.lit("GeneID:")))
    listed = F.transform(ids, lambda v: F.struct(F.lit("GeneID").alias("kind"), F.substr(v, F.lit(8)).alias("value")))
    return F.when(kind.isin("db_xref", "Dbxref"), listed).otherwise(F.array(F.struct(kind.alias("kind"), value.alias("value"))))


def genes_without_mrna(lines: DataFrame) -> DataFrame:
    """seqid, kind, value: the names of genes with a coding sequence and no mRNA in a flat file.

    lines: line, value, block.  A record is named by its LOCUS and VERSION lines.  Its
    number, whether a line lies in the feature table, and the feature's key are carried over
    the lines, by split first.
    """
    v = F.col("value")
    starts = lambda *words: v.rlike("^(" + "|".join(words) + ")")
    rows = files.carried_sum(lines.select("line", "value", "block"), "record", starts("LOCUS").cast("int"))
    rows = files.carried_last(rows, "inside", F.when(starts("FEATURES"), True).when(starts("LOCUS", "//", "ORIGIN", "CONTIG", "BASE COUNT"), False))
    key = F.regexp_extract(v, "^ {5}([A-Za-z0-9_'-]+) +", 1)
    rows = files.carried_last(rows, "key", F.when(~F.coalesce("inside", F.lit(False)), "").when((key != "") & (F.length(v) > 21), key))
    names = rows.filter(starts("LOCUS", "VERSION")).select("record", F.regexp_extract(v, "^\\S+\\s+(\\S+)", 1).alias("seqid")).filter("seqid <> ''").distinct()
    kind, value = (F.regexp_extract(v, '^ {21}/(db_xref|locus_tag|gene)="([^"]*)"?', i) for i in (1, 2))
    said = rows.filter(F.col("inside") & F.col("key").isin("CDS", "mRNA")).select("record", "key", kind.alias("k"), value.alias("w")).filter("k <> ''")
    said = said.select("record", "key", F.explode(_keys(F.col("k"), F.col("w"))).alias("n")).select("record", "key", "n.kind", "n.value")
    genes = said.groupBy("record", "kind", "value").agg(F.bool_or(F.col("key") == "CDS").alias("_cds"), F.bool_or(F.col("key") == "mRNA").alias("_mrna")).filter("_cds and not _mrna")
    return genes.join(names, "record").select("seqid", "kind", "value").distinct()


def mrna_of(names: DataFrame, genes: DataFrame) -> DataFrame:
    """n: the mRNAs of these genes, one row.  names: seqid, source_id, row_id, kind, value of mRNA rows."""
    theirs = names.join(genes, ["seqid", "kind", "value"], "left_semi").select("source_id", "row_id").distinct()
    return theirs.agg((F.count_distinct("source_id") + F.count_distinct(F.when(F.col("source_id").isNull(), F.col("row_id")))).alias("n"))


def stored_names(feature: DataFrame, attribute: DataFrame) -> DataFrame:
    """seqid, source_id, row_id, kind, value of the mRNA rows of a store."""
    rows = feature.filter("source_type = 'mRNA'").select("feature_id", "seqid", "source_id")
    said = attribute.filter(F.col("key").isin("Dbxref", "locus_tag", "gene")).select("feature_id", F.explode(_keys(F.col("key"), F.col("value"))).alias("n"))
    return rows.join(said, "feature_id").select("seqid", "source_id", F.col("feature_id").alias("row_id"), "n.kind", "n.value")


def text_names(lines: DataFrame) -> DataFrame:
    """The same from the lines of nine-column text."""
    column = lambda i: F.split_part("value", F.lit("\t"), F.lit(i))
    rows = lines.filter(~F.startswith("value", F.lit("#")) & (column(3) == "mRNA") & (column(9) != ""))
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.regexp_extract(column(9), f"(?:^|;)\\s*{k}=([^;]*)", 1).alias("w")) for k in ("Dbxref", "locus_tag", "gene")])
    ident = F.regexp_extract(column(9), "(?:^|;)ID=([^;]*)", 1)
    rows = rows.select(column(1).alias("seqid"), F.when(ident != "", ident).alias("source_id"), F.col("line").alias("row_id"), F.explode(F.filter(pairs, lambda p: p["w"] != "")).alias("p"))
    return rows.select("seqid", "source_id", "row_id", F.explode(_keys(F.col("p.k"), F.try_url_decode(F.replace("p.w", F.lit("+"), F.lit("%2B"))))).alias("n")).select("seqid", "source_id", "row_id", "n.kind", "n.value")


def compared(nine_column: DataFrame, flat: DataFrame, families: DataFrame, set_aside: int = 0) -> DataFrame:
    """family, expected, actual, delta: both counts (source_type, n) by family, a type of none by its own name, structural types left out."""
    folded = lambda counts: reconcile.folded_all(counts, families).filter(~F.col("family").isin(STRUCTURAL))
    left = folded(nine_column).withColumn("n", F.col("n") - F.when(F.col("family") == "mRNA", set_aside).otherwise(0))
    return reconcile.compare_counts(left, folded(flat), "family")


def stored_counts(feature: DataFrame) -> DataFrame:
    return feature.groupBy("source_type").agg(segments.feature_count().alias("n"))
