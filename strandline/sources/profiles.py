"""Dialects of the producers, as data, and their detection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources import files
from strandline.sources.gff3 import AnnotationFile

EXPORT_PRAGMA = "##strandline-export"


def augustus_proteins(comments: DataFrame) -> DataFrame:
    """gene, protein from the comment blocks that follow "# start gene"."""
    comments = comments if "block" in comments.columns else comments.withColumn("block", F.lit(0).cast("long"))
    gene = F.regexp_extract("text", "^# start gene (\\S+)", 1)
    opens = F.contains("text", F.lit("protein sequence = ["))
    rows = files.carried_sum(files.carried_last(comments, "gene", F.when(gene != "", gene)), "chain", opens.cast("int")).filter("chain > 0 and gene is not null")
    closes = F.contains("text", F.lit("]"))
    rows = rows.withColumn("closed", F.coalesce(F.sum(closes.cast("int")).over(Window.partitionBy("chain").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("closed = 0")
    body = F.regexp_extract("text", "^#\\s*(?:protein sequence = \\[)?\\s*([A-Za-z*]*)", 1)
    g = rows.groupBy("chain", "gene").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", body.alias("b")))), lambda x: x["b"]), "").alias("protein"))
    return g.select("gene", "protein")


@dataclass(frozen=True)
class Profile:
    name: str
    sources: tuple[str, ...]
    header: str | None = None
    expected: tuple[str, ...] = ()
    unique_ids: tuple[str, ...] = ("exon",)
    anonymous: bool = False
    overlap_flags: tuple[str, ...] = ()
    overlap_exceptions: tuple[str, ...] = ()
    shared_id: tuple[str, str] | None = None
    trans_splicing: bool = False
    states_parents: bool = True
    declared: tuple[str, ...] | None = None
    extract: Callable[[DataFrame], DataFrame] | None = field(default=None, compare=False)


# What each producer writes and allows.
PROFILES = [
    Profile(
        "refseq", ("RefSeq", "Gnomon", "BestRefSeq", "tRNAscan-SE", "cmsearch"), "#!processor NCBI annotwriter|#!genome-build-accession", ("gene", "mRNA", "exon", "CDS"),
        overlap_exceptions=("ribosomal slippage", "low-quality sequence region"), shared_id=("gbkey", "exon"), trans_splicing=True,
    ),
    Profile("funannotate", ("funannotate",), None, ("gene", "mRNA", "exon", "CDS")),
    Profile("augustus", ("AUGUSTUS",), "generated with AUGUSTUS", ("gene", "transcript", "CDS"), anonymous=True, extract=augustus_proteins),
    Profile("genbank", ("GenBank",), None, unique_ids=(), anonymous=True, overlap_flags=("ribosomal_slippage",), overlap_exceptions=("low-quality sequence region",), states_parents=False),
    Profile(
        "export", ("strandline",), EXPORT_PRAGMA, anonymous=True, overlap_flags=("ribosomal_slippage",), overlap_exceptions=("ribosomal slippage", "low-quality sequence region"),
        shared_id=("gbkey", "exon"), states_parents=False, trans_splicing=True,
    ),
]


class DialectError(ValueError):
    """No dialect fits, or more than one does."""


def _producers(file: AnnotationFile) -> str:
    """The first ten producers by name, for a message."""
    return ", ".join(r[0] for r in file.rows.select("program").distinct().orderBy("program").limit(10).collect())


def detect(file: AnnotationFile, override: str | None = None, profiles: list[Profile] = PROFILES) -> tuple[Profile, str, str]:
    """(profile, confidence, evidence).  The export pragma outranks column 2; else exactly one
    profile's producers must appear in column 2, and its header makes that certain."""
    by_name = {p.name: p for p in profiles}
    if override:
        if override not in by_name:
            raise DialectError(f"unknown dialect {override!r}; known: {', '.join(sorted(by_name))}")
        return by_name[override], "HIGH", "stated"
    if not file.comments.filter(F.startswith("text", F.lit(EXPORT_PRAGMA))).isEmpty():
        return by_name["export"], "HIGH", "export header"
    if file.format == "genbank":
        return by_name["genbank"], "HIGH", "GenBank flat file"
    found = {r[0] for r in file.rows.select("program").distinct().filter(F.col("program").isin([x for p in profiles for x in p.sources])).collect()}  # at most those that profiles name
    fits = [p for p in profiles if set(p.sources) & found]
    if len(fits) != 1:
        raise DialectError(f"no dialect fits: {_producers(file)}" if not fits else f"more than one dialect fits producers {', '.join(sorted(found))}")
    p = fits[0]
    sure = p.header is not None and not file.comments.filter(F.col("text").rlike(p.header)).isEmpty()
    return p, "HIGH" if sure else "MEDIUM", f"producer {', '.join(sorted(set(p.sources) & found))}" + (" and header" if sure else "")
