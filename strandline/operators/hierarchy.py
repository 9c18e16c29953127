"""Parent rules: what a feature may stand under, and whether it is there.

Features are rows (source_id, source_type, feature_type, seqid, parent_id, ...), one for
each feature; parent_id is the ID of the parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import vocabulary


def _parents(features: DataFrame, *columns: str) -> DataFrame:
    return features.filter("source_id is not null").select(F.col("source_id").alias("_pid"), *[F.col(c).alias(f"_p_{c}") for c in columns]).dropDuplicates(["_pid"])


def dangling(features: DataFrame) -> DataFrame:
    """Features whose parent is not among them."""
    return features.filter("parent_id is not null").join(_parents(features), F.col("parent_id") == F.col("_pid"), "left_anti")


def childless(features: DataFrame, types: list[str]) -> DataFrame:
    """Features of the types that have no child."""
    used = features.filter("parent_id is not null").select(F.col("parent_id").alias("_used")).distinct()
    return features.filter(F.col("source_type").isin(types)).join(used, F.col("source_id") == F.col("_used"), "left_anti")


def children_index(features: DataFrame) -> DataFrame:
    """parent_id, n_children, children (sorted, comma-joined)."""
    g = features.filter("parent_id is not null").groupBy("parent_id").agg(F.count_distinct("source_id").alias("n_children"), F.array_join(F.array_sort(F.collect_set("source_id")), ",").alias("children"))
    return g


def off_sequence(features: DataFrame) -> DataFrame:
    """Features on another sequence than their parent."""
    p = _parents(features, "seqid")
    return features.join(p, F.col("parent_id") == F.col("_pid")).filter(F.col("seqid") != F.col("_p_seqid")).select(features.columns)


def forbidden_parents(features: DataFrame) -> DataFrame:
    """source_id, feature_type, parent_id, parent_type of features that may not stand there."""
    p = _parents(features, "feature_type")
    rows = features.join(p, F.col("parent_id") == F.col("_pid"))
    bad = rows.filter(~vocabulary.may_have_parent(F.col("feature_type"), F.col("_p_feature_type")))
    return bad.select("source_id", "feature_type", "parent_id", F.col("_p_feature_type").alias("parent_type")).distinct()


def transcript_bypass(features: DataFrame, organellar: DataFrame | None = None) -> DataFrame:
    """CDS and exons right under a gene without transcripts, where the file has transcripts.

    organellar: sequences (seqid) on which that is usual.
    """
    types = features.select("feature_type", "parent_id", "source_id", "seqid", "source_type")
    has = types.filter(F.col("feature_type") == "mRNA").limit(1).select(F.lit(1).alias("_has"))
    with_transcript = types.filter(F.col("feature_type").isin(vocabulary.TRANSCRIPTS) & F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("_g")).distinct()
    genes = types.filter(F.col("feature_type").isin("gene", "pseudogene")).select(F.col("source_id").alias("_gene")).distinct()
    rows = types.filter(F.col("feature_type").isin(vocabulary.NEED_TRANSCRIPT))
    rows = rows.join(genes, F.col("parent_id") == F.col("_gene"), "left_semi").join(with_transcript, F.col("parent_id") == F.col("_g"), "left_anti")
    if organellar is not None:
        rows = rows.join(organellar, "seqid", "left_anti")
    return rows.join(F.broadcast(has), how="left_semi").select("source_id", "feature_type", "parent_id").distinct()  # one row


def organellar_sequences(regions: DataFrame) -> DataFrame:
    """seqid of regions (seqid, genome) whose genome value begins with an organelle's name."""
    match = F.lit(False)
    for o in vocabulary.ORGANELLES:
        match = match | F.startswith(F.lower("genome"), F.lit(o))
    return regions.filter(match).select("seqid").distinct()


def linkage_counts(features: DataFrame, *by: str) -> DataFrame:
    """linkage, n, and the columns named: how features are linked; 'unlinked', 'unrecorded' and 'top_level' tell
    of a method without parent, a parent without method, and neither."""
    kind = (
        F.when(F.col("linkage_method").isNotNull() & F.col("parent_id").isNotNull(), F.col("linkage_method"))
        .when(F.col("linkage_method").isNotNull(), "unlinked").when(F.col("parent_id").isNotNull(), "unrecorded").otherwise("top_level")
    )
    return features.groupBy(*by, kind.alias("linkage")).agg(F.count("*").alias("n"))
