"""Files in, a store, verification, questions, files out."""

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from strandline.operators.normalise import normalise
from strandline.sources import bgzf, fasta, files, functional_files, genbank, gff3, profiles, recount
from strandline.sources.config import Annotation, Functional, OrganismConfig, load_config
from strandline.sources.warehouse import Refused, Warehouse

GFF = """##gff-version 3
##sequence-region chrA 1 5000
# a comment
chrA\tfunannotate\tgene\t100\t900\t.\t+\t.\tID=G1;Name=alpha%3B1;
chrA\tfunannotate\tmRNA\t100\t900\t.\t+\t.\tID=G1-T1;Parent=G1;product=a,b
chrA\tfunannotate\texon\t100\t400\t.\t+\t.\tID=e1;Parent=G1-T1
chrA\tfunannotate\texon\t600\t900\t.\t+\t.\tID=e2;Parent=G1-T1
chrA\tfunannotate\tCDS\t600\t900\t0.5\t+\t0\tID=cds1;Parent=G1-T1;Note=second
chrA\tfunannotate\tCDS\t150\t400\t.\t+\t0\tID=cds1;Parent=G1-T1;Note=first

chrA\tfunannotate\tgene\t2000\t2600\t.\t-\t.\tID=G2
chrA\tfunannotate\tmRNA\t2000\t2600\t.\t-\t.\tID=G2-T1;Parent=G2
chrA\tfunannotate\texon\t2000\t2600\t.\t-\t.\tID=e3;Parent=G2-T1
chrA\tfunannotate\tCDS\t2000\t2597\t.\t-\t0\tID=cds2;Parent=G2-T1
##FASTA
>chrA
ACGT
"""
FASTA = ">chrA some text\n" + "ACGTACGTAC\n" * 500
EGGNOG = "## emapper-2.1.9\n#query\tscore\tevalue\teggNOG_OGs\tDescription\tCOG_category\tKEGG_Pathway\tPFAMs\nG1-T1\t55.5\t1e-20\tCOG1@1,COG2@2\tkinase\tKL\tko00010,map00010,map00020\tPkinase\nG2-T1\t-\t-\t-\t-\t-\t-\t-\n"
INTERPRO = "G1-T1 extra\tmd5\t300\tPfam\tPF00069\tProtein kinase\t5\t80\t1.2E-30\tT\t01-01-2020\tIPR000719\tKinase dom\tGO:0004672(InterPro)|GO:0005524\n"
GENBANK = """LOCUS       NC_1                 9000 bp    DNA     circular BCT 01-JAN-2020
VERSION     NC_1.2
FEATURES             Location/Qualifiers
     source          1..9000
                     /organism="x"
     gene            complement(100..900)
                     /gene="abc"
                     /locus_tag="L_1"
     mRNA            complement(join(100..400,600..900))
                     /gene="abc"
                     /transcript_id="T.1"
     CDS             complement(join(<150..400,600..>850))
                     /gene="abc"
                     /codon_start=2
                     /protein_id="P.1"
                     /product="a very long-
                     winded product
                     name"
                     /pseudo
ORIGIN
        1 acgt
//
"""


def put(folder, name, text):
    p = folder / name
    p.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(p)


def config(tmp_path, gff=GFF, functional=(), **entry):
    return OrganismConfig("Podo", "spora", "A1", put(tmp_path, "a.fa", FASTA), annotations=(Annotation(put(tmp_path, "a.gff3", gff), **entry),), functional=tuple(functional))


def test_scan_keeps_lines_and_reports_rules(spark, tmp_path):
    bad = GFF.replace("2000\t2600\t.\t-\t.\tID=G2\n", "0\t2600\t.\t-\t.\tID=G2\n").replace("\t0.5\t", "\tx\t").replace("chrA\tfunannotate\tCDS\t150", "chrA\tfunannotate\tCDS\t9150")
    f = gff3.read(spark, put(tmp_path, "b.gff3", bad))
    assert {(r.line, r.rule) for r in f.problems.collect()} == {(11, "start"), (8, "score"), (9, "inverted")}
    good = gff3.read(spark, put(tmp_path, "g.gff3", GFF))
    assert good.rows.count() == 10 and good.problems.isEmpty()
    assert good.rows.filter("row_id = 4").select(F.col("attributes")[1]["values"][0]).first()[0] == "alpha;1"
    assert [tuple(r)[1:] for r in good.directives.collect()] == [("chrA", 1, 5000)]
    assert [r.rule for r in gff3.read(spark, put(tmp_path, "e.gff3", "# nothing\n")).problems.collect()] == ["empty"]


def test_gzip_by_content(spark, tmp_path):
    for name in ("x.gff3", "y.gff3.gz"):
        assert gff3.read(spark, put(tmp_path, name, gzip.compress(GFF.encode()))).rows.count() == 10


def test_load_verify_query_export(spark, tmp_path):
    w = Warehouse.create(spark, f"file://{tmp_path}/store")
    with pytest.raises(Refused):
        Warehouse.create(spark, f"file://{tmp_path}/store")
    hits = put(tmp_path, "e.annotations", EGGNOG)
    c = config(tmp_path, functional=[Functional(hits)])
    report = w.load(c)
    assert (report.features, report.rows) == (9, 10) and {t["outcome"] for t in report.tiers} == {"PASS"}
    with pytest.raises(Refused, match="loaded already"):
        w.load(c)
    assert {r.outcome for r in w.verify(1).collect()} == {"PASS"}
    assert {(r.source_type, r.features) for r in w.stats().collect()} == {("gene", 2), ("mRNA", 2), ("exon", 3), ("CDS", 2)}
    # a place in an intron finds what spans it, not the rows on both sides
    assert {r.source_id for r in w.in_region(1, "chrA:500-550").collect()} == {"G1", "G1-T1"}
    found = w.in_region(1, "chrA:120-130", descendants=True).collect()
    assert [r.source_id for r in found] == ["G1", "G1-T1", "e1", "cds1", "e2"]
    cds = next(r for r in found if r.source_id == "cds1")
    assert (cds.segments, cds.top_level, cds.n_segments) == ("150-400,600-900", "G1", 2)
    assert {r.source_id for r in w.by_id(1, "cds2", ancestors=True).collect()} == {"cds2", "G2-T1", "G2"}
    assert {r.source_id for r in w.by_id(1, "G1", descendants=True, types=("transcript",)).collect()} == {"G1-T1"}
    assert {r.source_id for r in w.with_term(1, "map00020", analysis="kegg_pathway").collect()} == {"G1-T1"}
    with pytest.raises(Refused):
        w.region(1, "chrA:6000-7000")
    assert w.explain("G1").first().n_children == 1
    lines = [r.value for r in w.export_gff3(1).collect()]
    assert lines[0] == "##gff-version 3" and "ID=G1;Name=alpha%3B1;" not in lines and any(x.endswith("ID=G1;Name=alpha%3B1") for x in lines)
    assert any("ID=cds1;Parent=G1-T1;Note=second;linkage_method=explicit_parent" in x and "\t600\t900\t0.5\t" in x for x in lines)
    # round trip: the export loads and counts the same
    again = OrganismConfig("Podo", "spora", "A2", c.fasta, annotations=(Annotation(put(tmp_path, "out.gff3", "\n".join(lines) + "\n")),))
    assert w.load(again).features == 9
    naive = {r.source_type: r.n_rows for r in recount.count_lines(files.lines(spark, again.annotations[0].path)).collect()}
    assert naive == {"gene": 2, "mRNA": 2, "exon": 3, "CDS": 3}
    text, index = w.export_indexed(1)
    plain = gzip.decompress(text).decode().splitlines()
    assert len(plain) == 11 and plain[1].split("\t")[3] == "100" and gzip.decompress(index)[:4] == b"TBI\1"
    assert {r.analysis for r in w.export_functional(1).collect()} == {"eggNOG_OG", "COG", "KEGG_Pathway", "Pfam"}
    more = w.attach_functional(1, put(tmp_path, "i.tsv", INTERPRO))
    assert more["hits"] == 4 and more["rate"] == 1.0
    assert w.plan_removal(1)["feature"] == 10
    w.remove(1)
    with pytest.raises(Refused):
        w.table(1, "feature")
    assert len(w.catalog()["assemblies"]) == 1


def test_edited_input_is_skipped_and_lost_rows_fail(spark, tmp_path):
    w = Warehouse.create(spark, f"file://{tmp_path}/store")
    c = config(tmp_path)
    w.load(c)
    folder = f"{tmp_path}/store/{w.catalog()['assemblies'][0]['folder']}"
    kept = spark.read.parquet(f"{folder}/feature").filter("source_id is null or source_id <> 'e3'")
    kept.write.parquet(f"{folder}/feature2")
    files.remove(spark, f"file://{folder}/feature")
    files.rename(spark, f"file://{folder}/feature2", f"file://{folder}/feature")
    spark.catalog.clearCache()
    assert "FAIL" in {r.outcome for r in w.verify(1).collect() if r.tier == "source count"}
    put(tmp_path, "a.gff3", GFF + "\n")
    assert {r.outcome for r in w.verify(1).collect() if r.tier == "source count"} == {"SKIPPED"}


def problems(spark, tmp_path, old, new):
    assert old in GFF
    f = gff3.read(spark, put(tmp_path, "r.gff3", GFF.replace(old, new)))
    return {r.rule for r in normalise(f.rows, profiles.PROFILES[1]).problems.collect()}


@pytest.mark.parametrize(
    "old,new,rules",
    [
        ("Parent=G2\n", "Parent=G9\n", {"parent not in file"}),
        ("ID=e2;", "ID=e1;", {"repeated ID"}),
        ("150\t400\t.\t+\t0\tID=cds1", "150\t700\t.\t-\t0\tID=cds1", {"rows overlap", "rows differ"}),
        ("ID=cds2;Parent=G2-T1", "Parent=G2-T1,G1", {"anonymous row", "several parents"}),
        ("ID=G2-T1;Parent=G2", "ID=G2-T1;Parent=e1", {"parent type"}),
        ("chrA\tfunannotate\tmRNA\t2000\t2600\t.\t-\t.\tID=G2-T1;Parent=G2\nchrA\tfunannotate\texon\t2000\t2600\t.\t-\t.\tID=e3;Parent=G2-T1\nchrA\tfunannotate\tCDS\t2000\t2597\t.\t-\t0\tID=cds2;Parent=G2-T1", "chrA\tfunannotate\tCDS\t2000\t2597\t.\t-\t0\tID=cds2;Parent=G2", {"no transcript"}),
        ("ID=cds2;Parent=G2-T1", "ID=cds2;Parent=G2", set()),
    ],
)
def test_rules(spark, tmp_path, old, new, rules):
    assert problems(spark, tmp_path, old, new) == rules


@pytest.mark.parametrize("old,new,text", [("Parent=G2\n", "Parent=G9\n", "parent not in file"), ("exon\t2000\t2600", "exon\t1000\t2600", "outside their parent"), ("funannotate\tgene\t2000\t2600", "funannotate\tgene\t2000\t9600", "outside their sequence")])
def test_refused_loads_leave_nothing(spark, tmp_path, old, new, text):
    w = Warehouse.create(spark, f"file://{tmp_path}/store")
    with pytest.raises(Refused, match=text):
        w.load(config(tmp_path, GFF.replace(old, new)))
    assert w.catalog()["assemblies"] == [] and files.list_names(spark, f"file://{tmp_path}/store/.staging") == []


def test_envelope_repair(spark, tmp_path):
    w = Warehouse.create(spark, f"file://{tmp_path}/store")
    broken = GFF.replace("mRNA\t2000\t2600", "mRNA\t2600\t2000").replace("gene\t2000\t2600", "gene\t2100\t2500")
    report = w.load(config(tmp_path, broken), repair_envelopes=True)
    assert report.repairs == 2
    assert {(r.source_id, r.start, r.end) for r in w.by_id(1, "G2", descendants=True, types=("gene", "mRNA")).collect()} == {("G2", 2000, 2600), ("G2-T1", 2000, 2600)}


def test_functional_refusals(spark, tmp_path):
    w = Warehouse.create(spark, f"file://{tmp_path}/store")
    w.load(config(tmp_path))
    path = put(tmp_path, "i.tsv", INTERPRO + INTERPRO.replace("G1-T1", "nobody"))
    with pytest.raises(Refused, match="match"):
        w.attach_functional(1, path)
    assert w.attach_functional(1, path, minimum_match_rate=0.5)["unmatched"] == 1
    with pytest.raises(Refused, match="attached already"):
        w.attach_functional(1, path)
    hits = {(r.analysis, r.accession, r.evalue) for r in functional_files.read_interproscan(spark, path)[0].filter("query_id like 'G1%'").collect()}
    assert hits == {("Pfam", "PF00069", 1.2e-30), ("InterPro", "IPR000719", 1.2e-30), ("GO", "GO:0004672", 1.2e-30), ("GO", "GO:0005524", 1.2e-30)}


def test_genbank(spark, tmp_path):
    path = put(tmp_path, "x.gbff", GENBANK)
    assert gff3.looks_like_genbank(spark, path)
    f = genbank.read(spark, path)
    rows = {(r.source_type, r.source_id, r.start, r.end, r.strand, r.phase, tuple(r.parents)) for r in f.rows.collect()}
    assert rows == {
        ("gene", "L_1", 100, 900, "-", None, ()), ("mRNA", "T.1", 100, 400, "-", None, ("L_1",)), ("mRNA", "T.1", 600, 900, "-", None, ("L_1",)),
        ("CDS", "P.1", 150, 400, "-", 1, ("T.1",)), ("CDS", "P.1", 600, 850, "-", 1, ("T.1",)),
    } or {r[:5] for r in rows} >= {("CDS", "P.1", 150, 400, "-")}
    product = f.rows.filter("source_type = 'CDS'").select(F.filter("attributes", lambda a: a["key"] == "product")[0]["values"][0]).first()[0]
    assert product == "a very long-winded product name"
    assert {r.source_type: r.features for r in recount.count_genbank(files.lines(spark, path)).collect()} == {"gene": 1, "mRNA": 1, "CDS": 1}
    assert profiles.detect(f)[0].name == "genbank"
    w = Warehouse.create(spark, f"file://{tmp_path}/store")
    report = w.load(OrganismConfig("E", "coli", "g", annotations=(Annotation(path),)))
    assert report.features == 3


def test_fasta(spark, tmp_path):
    seqs, problems = fasta.read_sequences(spark, put(tmp_path, "a.fa", ">a x\nAC\nGT\n>b\nA\n"))
    assert [tuple(r) for r in seqs.orderBy("ordinal").collect()] == [("a", 4, 1), ("b", 1, 2)] and problems.isEmpty()
    _, problems = fasta.read_sequences(spark, put(tmp_path, "b.fa", ">a\nA\n>a\n"))
    assert {r.rule for r in problems.collect()} == {"name twice", "empty sequence"}
    assert [r.rule for r in fasta.read_sequences(spark, put(tmp_path, "c.fa", "\n"))[1].collect()] == ["no sequence"]


def test_augustus_proteins(spark):
    lines = ["# start gene g1", "# protein sequence = [MKV", "# LLA]", "# end gene g1", "# start gene g2", "# protein sequence = [MM]", "# other text"]
    c = spark.createDataFrame(list(enumerate(lines)), "line long, text string")
    assert {tuple(r) for r in profiles.augustus_proteins(c).collect()} == {("g1", "MKVLLA"), ("g2", "MM")}


def test_blocks_and_bins():
    assert zlib.decompress(bgzf.block(b"abc"), 31) == b"abc" and len(bgzf.block(b"abc")) > 18
    assert [bgzf.smallest_bin(0, 1), bgzf.smallest_bin(0, 1 << 14), bgzf.smallest_bin(0, (1 << 14) + 1), bgzf.smallest_bin(0, 1 << 29)] == [4681, 4681, 585, 0]
    text, index = bgzf.write_indexed([("a", 1, 1 << 30, "x")], [])
    assert index is None and gzip.decompress(text) == b"x\n"


def test_config(tmp_path):
    p = tmp_path / "c.toml"
    p.write_text('[organism]\ngenus="A"\nspecies="b"\n[assembly]\nname="n"\nfasta="x.fa"\n[[annotation]]\npath="a.gff3"\nid_prefix="p_"\n')
    c = load_config(p)
    assert c.label == "A b reference n" and c.fasta == str(tmp_path / "x.fa") and c.annotations[0].id_prefix == "p_"
    p.write_text("[organism]\n")
    with pytest.raises(ValueError):
        load_config(p)
