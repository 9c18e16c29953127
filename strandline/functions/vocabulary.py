"""The controlled vocabulary of feature types, as data."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1

# Canonical terms, their synonyms, permitted parents.
CANONICAL = ["gene", "pseudogene", "mRNA", "tRNA", "rRNA", "ncRNA", "exon", "CDS", "five_prime_UTR", "three_prime_UTR", "repeat_region"]
SYNONYMS = {
    "mRNA": ["transcript", "primary_transcript", "pseudogenic_transcript", "pseudogenic_tRNA", "pseudogenic_rRNA", "precursor_RNA", "V_gene_segment", "C_gene_segment", "D_gene_segment", "J_gene_segment"],
    "ncRNA": [
        "miRNA", "misc_RNA", "snRNA", "snoRNA", "tmRNA", "lnc_RNA", "lncRNA", "SRP_RNA", "RNase_P_RNA", "antisense_RNA", "guide_RNA", "telomerase_RNA",
        "Y_RNA", "vault_RNA", "RNase_MRP_RNA", "scRNA", "scaRNA", "piRNA", "siRNA", "rasiRNA", "ribozyme", "hammerhead_ribozyme",
    ],
    "exon": ["pseudogenic_exon"],
    "five_prime_UTR": ["5'UTR"],
    "three_prime_UTR": ["3'UTR"],
}
PARENTS = {
    "gene": [],
    "pseudogene": [],
    "repeat_region": [],
    "mRNA": ["gene", "pseudogene"],
    "tRNA": ["gene", "pseudogene"],
    "rRNA": ["gene", "pseudogene"],
    "ncRNA": ["gene", "pseudogene", "mRNA"],
    "exon": ["mRNA", "tRNA", "rRNA", "ncRNA", "gene", "pseudogene"],
    "CDS": ["mRNA", "gene", "pseudogene"],
    "five_prime_UTR": ["mRNA", "gene", "pseudogene"],
    "three_prime_UTR": ["mRNA", "gene", "pseudogene"],
}
TRANSCRIPTS = ["mRNA", "tRNA", "rRNA", "ncRNA"]
NEED_TRANSCRIPT = ["CDS", "exon"]
LINKED = ["CDS", "exon", "mRNA", "ncRNA", "tRNA", "rRNA"]
ORGANELLES = ["mitochondrion", "plastid", "chloroplast", "apicoplast", "chromoplast", "cyanelle", "kinetoplast", "leucoplast", "proplastid", "chromatophore", "hydrogenosome"]
LINKAGE = ["explicit_parent", "locus_tag", "qualifier", "note", "structural", "positional", "synthesised"]
COMPUTED_LINKAGE = ["structural", "positional"]
EXEMPTIONS = ["pseudo", "pseudogene", "partial", "artificial_location", "ribosomal_slippage", "transl_except", "exception"]
FALSE_VALUES = ["false", "0", "no"]

LEAVES = sorted(set(CANONICAL) - {p for names in PARENTS.values() for p in names})  # types that no rule has as a parent

SYNONYM_OF = {s: c for c, names in SYNONYMS.items() for s in names}


def rows() -> list[tuple[str, str, str]]:
    """(term, canonical_term, tier): canonical terms and their synonyms, all of tier A."""
    return [(c, c, "A") for c in CANONICAL] + [(s, c, "A") for s, c in sorted(SYNONYM_OF.items())]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "term string, canonical_term string, tier string")


def content_hash() -> str:
    """SHA-256 over everything whose change would change what a load means."""
    lines = [f"version {VERSION}", *("\t".join(r) for r in sorted(rows()))]
    lines += [f"{child}<{','.join(sorted(p))}" for child, p in sorted(PARENTS.items())]
    lines += [",".join(x) for x in (LINKAGE, COMPUTED_LINKAGE, TRANSCRIPTS, NEED_TRANSCRIPT, sorted(ORGANELLES))]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def canonical(source_type: Column) -> Column:
    """The canonical term of a type; an unknown type is its own."""
    pairs = [F.lit(x) for kv in SYNONYM_OF.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[source_type], source_type)


def may_have_parent(child: Column, parent: Column) -> Column:
    """Whether a feature of one canonical type may stand under another; a type without
    a rule may stand anywhere."""
    rule = F.create_map(*[x for k, v in PARENTS.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]).cast("array<string>"))])[child]
    return F.coalesce(F.array_contains(rule, parent), F.lit(True))
