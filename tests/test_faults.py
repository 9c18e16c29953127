"""A check that never fires proves nothing: faults of the store, and which tier sees them."""

import pytest
from pyspark.sql import functions as F

from strandline.operators import reconcile, segments
from strandline.operators.normalise import normalise
from strandline.sources import files, gff3, profiles, published, recount, warehouse
from test_warehouse import GFF, put

def drop(where):
    return lambda df: df.filter(f"not ({where})")


def change(column, where, value):
    return lambda df: df.withColumn(column, F.when(F.expr(where), F.lit(value)).otherwise(F.col(column)))


FAULTS = [
    ("an exon lost", drop("source_id = 'e3'"), True),
    ("a gene model lost", drop("source_id like 'G2%' or source_id in ('e3', 'cds2')"), True),
    ("one row of a feature lost", drop("source_id = 'cds1' and start = 600"), True),
    ("a link lost", change("parent_id", "source_id = 'e3'", None), True),
    ("link and method lost", lambda df: change("linkage_method", "source_id = 'e3'", None)(change("parent_id", "source_id = 'e3'", None)(df)), True),
    ("all links lost", change("parent_id", "true", None), True),
    ("an exon made a CDS", change("source_type", "source_id = 'e3'", "CDS"), True),
    ("a feature twice", lambda df: df.unionByName(df.filter("source_id = 'e3'").withColumn("source_id", F.lit("e9"))), True),
    ("a parent changed", change("parent_id", "source_id = 'e3'", "G1-T1"), False),
    ("a strand flipped", change("strand", "source_id = 'e3'", "+"), False),
    ("a start moved", change("start", "source_id = 'e3'", 2001), False),
    ("a feature renamed", change("source_id", "source_id = 'e3'", "e33"), False),
    ("nothing", lambda df: df, None),
]


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    path = put(tmp_path_factory.mktemp("f"), "a.gff3", GFF)
    naive = warehouse.Warehouse(spark, "unused")._naive(path, "gff3")
    rows = normalise(gff3.read(spark, path).rows, profiles.PROFILES[1]).rows.drop("attributes", "stored_attributes", "parents")
    return naive.cache(), rows.cache()


def whole(rows):
    return segments.regroup(rows).select(F.col("source_id").alias("key"), F.col("source_type").alias("type"), "start", "end", "strand", "parent_id", "segments")


@pytest.mark.parametrize("name,fault,counted", FAULTS)
def test_faults(loaded, name, fault, counted):
    naive, rows = loaded
    stored = fault(rows)
    ids = stored.filter("segment_index = 0").select(F.col("source_id").alias("_i"), F.col("row_id").alias("parent_feature_id"))
    stored = stored.join(ids, F.col("parent_id") == F.col("_i"), "left")
    tiers = [*warehouse._tiers(naive, stored, "a", "gff3"), warehouse._edges(stored, "a", "gff3")]
    assert ("FAIL" in {t["outcome"] for t in tiers}) == bool(counted), (name, tiers)
    # the difference by feature sees every fault
    states = {r.state for r in reconcile.fidelity(whole(rows), whole(fault(rows)), ["start", "end", "strand", "parent_id", "segments", "type"]).collect()}
    assert (states == {"kept"}) == (counted is None), (name, states)


def test_published_counts(spark, tmp_path):
    text = "# Feature\tClass\tFull Assembly\tAssembly-unit accession\tAssembly-unit name\tUnique Ids\tPlacements\n"
    for row in ("gene\tx\tGCF_1\t\tall\t9\t9", "gene\tx\tGCF_1\tU1\tPrimary\t2\t5", "gene\ty\tGCF_1\tU1\tPrimary\tna\t4", "gene\tx\tGCF_1\tU2\tMito\t1\t1", "CDS\t\tGCF_1\t\tall\t7\t8", "gene\tx\tGCF_2\t\tall\t99\t99"):
        text += row + "\n"
    path = put(tmp_path, "c.txt", text)
    read = lambda **k: {(r.feature, r.n) for r in published.read_published(spark, path, "GCF_1", **k).collect()}
    assert read() == {("gene", 7), ("CDS", 7)} and read(unit="U2") == read(unit="Mito") == {("gene", 1)}
    lines = published.protein_fasta(spark.createDataFrame([("g", "M" * 61), ("h", "K" * 60)], "gene string, protein string"))
    assert {r.value for r in lines.collect()} == {">g\n" + "M" * 60 + "\nM", ">h\n" + "K" * 60}


def test_recount_reads_raw_text(spark, tmp_path):
    path = put(tmp_path, "n.gff3", "#c\na\tb\tgene\t1\t2\t.\t+\t.\tID=x\na\tb\tgene\t3\t4\t.\t+\t.\tID=x; Parent=y\na\tb\tgene\t3\t4\t.\t+\t.\tName=z\nshort\trow\n")
    assert [tuple(r) for r in recount.count_lines(files.lines(spark, path)).collect()] == [("gene", 2, 3, 1)]
