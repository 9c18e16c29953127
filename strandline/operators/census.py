"""Structural defects and their tallies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def protein_length_mismatches(rows: DataFrame, declared: DataFrame) -> DataFrame:
    """transcript, bases, residues, declared where coding bases / 3 - 1 is another number
    than the declared length of the protein."""
    coding = rows.filter(F.col("source_type") == "CDS").groupBy(F.col("parent_id").alias("transcript")).agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))
    j = coding.join(declared, "transcript").withColumn("residues", F.expr("bases div 3") - 1)
    return j.filter("residues <> declared").select("transcript", "bases", "residues", "declared")


def declared_proteins(rows: DataFrame, proteins: DataFrame, exempt: Column) -> DataFrame:
    """gene, problem: genes whose coding bases don't fit the protein (gene, protein) declared of them.

    The bases of all coding rows under a gene's transcripts are its protein's residues and
    a stop codon.  Genes with a coding row that is ``exempt`` aren't checked.
    """
    genes = rows.filter("feature_type = 'mRNA' and source_id is not null").select(F.col("source_id").alias("_t"), F.col("parent_id").alias("_g")).distinct()
    coding = rows.filter("feature_type = 'CDS' and parent_id is not null").select("parent_id", (F.col("end") - F.col("start") + 1).alias("_n"), F.coalesce(exempt, F.lit(False)).alias("_x"))
    by_gene = coding.join(genes, F.col("parent_id") == F.col("_t")).groupBy("_g").agg(F.sum("_n").alias("bases"), F.bool_or("_x").alias("_exempt"))
    found = proteins.join(by_gene, F.col("gene") == F.col("_g"), "left").filter(~F.coalesce("_exempt", F.lit(False)))
    residues = F.length("protein")
    problem = (
        F.when(F.col("bases").isNull(), "a protein is declared and no coding row is there").when(F.col("bases") % 3 != 0, F.concat("bases", F.lit(" coding bases are no whole number of codons")))
        .when(F.expr("bases div 3 - 1") != residues, F.concat("bases", F.lit(" coding bases make "), F.expr("bases div 3 - 1"), F.lit(" residues, declared are "), residues))
    )
    return found.select("gene", problem.alias("problem")).filter("problem is not null")


def defects(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """(row_id, seqid, kind, excused) of every structural defect of rows.

    rows: row_id, seqid, source_id, source_type, start, end, strand, parent_id, excused.
    """
    out = []

    def add(kind: str, df: DataFrame) -> None:
        out.append(df.select("row_id", "seqid", F.lit(kind).alias("kind"), "excused"))

    add("inverted", rows.filter("start > end"))
    add("strand-unknown", rows.filter("strand = '?'"))
    add("strand-invalid", rows.filter(~F.col("strand").isin("+", "-", ".", "?")))
    bounded = rows.join(sequences.select("seqid", "length", "circular"), "seqid")
    add("out-of-range", bounded.filter("(end > length and not circular) or end > 2 * length"))
    add("origin-spanning", bounded.filter("circular and end > length and end <= 2 * length"))
    first = Window.partitionBy("source_id").orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    named = rows.filter("source_id is not null")
    add("id-conflict", named.withColumn("_s", F.first("seqid").over(first)).withColumn("_d", F.first("strand").over(first)).withColumn("_t", F.first("source_type").over(first)).filter("_s <> seqid or _d <> strand or _t <> source_type"))
    parents = named.groupBy(F.col("source_id").alias("_pid")).agg(F.min("start").alias("_lo"), F.max("end").alias("_hi"), F.min("seqid").alias("_seq"))
    under = rows.join(parents, F.col("parent_id") == F.col("_pid"))
    add("escapes-parent", under.filter("_seq = seqid and (start < _lo or end > _hi)"))
    add("escapes-parent-seqid", under.filter("_seq <> seqid"))
    pseudo = named.filter("source_type = 'pseudogene'").select(F.col("source_id").alias("_pg")).distinct()
    add("pseudogene-gene-exon", rows.filter("source_type = 'exon'").join(pseudo, F.col("parent_id") == F.col("_pg"), "left_semi"))
    return reduce(DataFrame.unionByName, out)


def tally(found: DataFrame, organellar: DataFrame) -> DataFrame:
    """kind, total, organellar, excused."""
    o = organellar.select("seqid", F.lit(True).alias("_o"))
    rows = found.join(o, "seqid", "left")
    return rows.groupBy("kind").agg(F.count("*").alias("total"), F.count_if(F.coalesce("_o", F.lit(False))).alias("organellar"), F.count_if("excused").alias("excused"))


def row_class(kind: Column, excused: Column) -> Column:
    """A: breaks a coordinate rule; B: leaves its parent; C: excused; D: the rest."""
    return F.when(excused, "C").when(kind.isin("inverted", "out-of-range", "strand-invalid"), "A").when(F.startswith(kind, F.lit("escapes")), "B").otherwise("D")


# Worst first.
CLASS_RANK = {"A": 4, "B": 3, "D": 2, "C": 1}


def worst_classes(found: DataFrame) -> DataFrame:
    """class, n: rows by the worst of their defects."""
    rank = F.create_map(*[F.lit(x) for kv in CLASS_RANK.items() for x in kv])
    rows = found.withColumn("class", row_class(F.col("kind"), F.col("excused"))).withColumn("rank", rank[F.col("class")])
    return rows.groupBy("row_id").agg(F.max_by("class", "rank").alias("class")).groupBy("class").agg(F.count("*").alias("n"))
