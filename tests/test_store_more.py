"""Registration, the origin of circles, other files and published counts, answers as text,
indexed files, proteins, two writers, and removal."""

import gzip
import struct

import pytest

from strandline.sources import bgzf, files
from strandline.sources.config import Annotation, Functional, OrganismConfig
from strandline.sources.warehouse import Refused, Warehouse
from test_warehouse import EGGNOG, FASTA, GENBANK, GFF, config, put


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("more")
    w = Warehouse.create(spark, f"file://{folder}/store")
    w.load(config(folder, functional=[Functional(put(folder, "e.annotations", EGGNOG))]))
    return w, folder


def test_answers_as_text(loaded):
    w, _ = loaded
    answer = w.by_id(1, "cds1")
    tsv = [r.value for r in w.answer_tsv(answer, description="cds1").collect()]
    assert tsv[0] == "# cds1" and tsv[2].split("\t")[:1] == ["cds1"] and tsv[2].endswith("G1-T1\tG1") and len(tsv) == 3
    terms = [r.value for r in w.answer_tsv(w.with_term(1, "map00020"), assembly_id=1, term="map00020").collect()]
    assert len(terms) == 3 and "KEGG_Pathway\tko00020" in terms[2]
    lines = {r.line.split("\t")[8].split(";")[0] for r in w.answer_gff3(1, answer).collect()}
    assert lines == {"ID=cds1", "ID=G1-T1", "ID=G1"}


def test_tiers_on_request(loaded, spark):
    w, folder = loaded
    tiers = lambda **k: {(r.tier, r.outcome) for r in w.verify(1, **k).collect()}
    assert {("cross format", "SKIPPED"), ("published counts", "SKIPPED")} <= tiers(every_tier=True)
    published = spark.createDataFrame([("gene", 2), ("CDS", 2)], "feature string, n long")
    assert ("published counts", "PASS") in tiers(published=published, sequences_in_assembly=1)
    assert ("published counts", "SKIPPED") in tiers(published=published, sequences_in_assembly=2)
    assert ("cross format", "PASS") in tiers(against=put(folder, "same.gff3", GFF))
    assert ("cross format", "FAIL") in tiers(against=put(folder, "x.gbff", GENBANK))
    assert w.stats("both").filter("source_type = feature_type").count() == 4


def test_indexed_files(loaded, spark):
    """The index leads to the rows: every chunk's offset is the start of a row that is in its bin."""
    w, folder = loaded
    assert w.write_indexed(1, f"file://{folder}/out.gff3.gz")
    data, index = (folder / "out.gff3.gz").read_bytes(), gzip.decompress((folder / "out.gff3.gz.tbi").read_bytes())
    text = gzip.decompress(data).decode().splitlines()
    rows = text[1:]
    assert text[0] == "##gff-version 3" and [int(r.split("\t")[3]) for r in rows] == sorted(int(r.split("\t")[3]) for r in rows) and len(rows) == 10
    n_ref, *_, n_names = struct.unpack_from("<8i", index, 4)
    at = 36 + n_names
    assert index[36:at] == b"chrA\0" and n_ref == 1
    (n_bins,) = struct.unpack_from("<i", index, at)
    at, seen = at + 4, 0
    for _ in range(n_bins):
        number, n = struct.unpack_from("<Ii", index, at)
        at += 8
        for k in range(n):
            low, high = struct.unpack_from("<QQ", index, at + 16 * k)
            if number != bgzf.SUMMARY_BIN:
                block = gzip.decompress(_member(data, low >> 16))
                for line in block[low & 0xFFFF :][: (high & 0xFFFF) - (low & 0xFFFF) if high >> 16 == low >> 16 else None].decode().splitlines():
                    c = line.split("\t")
                    assert bgzf.smallest_bin(int(c[3]) - 1, int(c[4])) == number
                    seen += 1
        at += 16 * n
    assert seen == 10
    (windows,) = struct.unpack_from("<i", index, at)
    assert windows == 1


def _member(data: bytes, at: int) -> bytes:
    return data[at : at + struct.unpack_from("<H", data, at + 16)[0] + 1]


def test_blocks_of_long_texts():
    rows = [("a" if i < 4000 else "b", i % 4000 * 50 + 1, i % 4000 * 50 + 90, f"row {i} " + "x" * (i % 97)) for i in range(8000)] + [("b", 300_000, 300_001, "y" * 200_000)]
    text, index = bgzf.write_indexed(rows, ["# head"])
    assert gzip.decompress(text).decode().splitlines() == ["# head", *[r[3] for r in rows]] and gzip.decompress(index).startswith(b"TBI\1")


def test_registration_and_organisms(spark, tmp_path):
    w = Warehouse.create(spark, f"file://{tmp_path}/store")
    c = config(tmp_path)
    report = w.register(c)
    assert report.rows == 0 and w.table(1, "sequence").count() == 1 and w.table(1, "feature").count() == 0
    with pytest.raises(Refused):
        w.register(OrganismConfig("A", "b", "n"))
    assert w.load(c, force=True).rows == 10
    assert [tuple(r)[:2] for r in w.organisms().collect()] == [("Podo", "spora")]
    plan = w.remove(1, dry_run=True)
    assert plan["feature"] == 10 and w.table(1, "feature").count() == 10
    folder = plan["folder"]
    w.remove(1, keep_files=True)
    assert w.organisms().count() == 0 and files.exists(spark, f"file://{tmp_path}/store/{folder}/feature")


def test_two_writers_and_a_failed_removal(spark, tmp_path, monkeypatch):
    w = Warehouse.create(spark, f"file://{tmp_path}/store")
    old = w.catalog()
    w._publish(old | {"note": "first"})
    with pytest.raises(Refused, match="another writer"):
        w._publish(old | {"note": "second"})
    assert w.catalog()["note"] == "first"
    w.load(config(tmp_path))
    monkeypatch.setattr(Warehouse, "_publish", lambda *a: (_ for _ in ()).throw(OSError("disk")))
    with pytest.raises(OSError):
        w.remove(1)
    assert w.table(1, "feature").count() == 10  # what was held is back


CIRCLE = """##gff-version 3
##sequence-region M 1 1000
M\tRefSeq\tregion\t1\t1000\t.\t+\t.\tID=r;Is_circular=true
M\tRefSeq\tgene\t100\t200\t.\t+\t.\tID=g;exception=trans-splicing
M\tRefSeq\tmRNA\t150\t1100\t.\t+\t.\tID=t;Parent=g
"""


def test_the_origin_of_a_circle_explains(spark, tmp_path):
    load = lambda text, name: Warehouse.create(spark, f"file://{tmp_path}/{name}").load(OrganismConfig("A", "b", name, annotations=(Annotation(put(tmp_path, f"{name}.gff3", text)),)))
    assert any("cross the origin" in x for x in load(CIRCLE, "one").warnings)
    for name, text in (("linear", CIRCLE.replace(";Is_circular=true", "").replace("1\t1000\t.", "1\t2000\t.").replace("M 1 1000", "M 1 2000")), ("unspliced", CIRCLE.replace(";exception=trans-splicing", "")), ("inside", CIRCLE.replace("150\t1100", "150\t900"))):
        with pytest.raises(Refused, match="outside their parent"):
            load(text, name)


def test_proteins_and_rows_twice(spark, tmp_path):
    text = "# This output was generated with AUGUSTUS\n# start gene g1\nc\tAUGUSTUS\tgene\t1\t99\t.\t+\t.\tID=g1\nc\tAUGUSTUS\ttranscript\t1\t99\t.\t+\t.\tID=g1.t1;Parent=g1\nc\tAUGUSTUS\tCDS\t1\t21\t.\t+\t0\tID=g1.c;Parent=g1.t1\n# protein sequence = [MKV\n# LLA]\n# end gene g1\n"
    w = Warehouse.create(spark, f"file://{tmp_path}/store")
    w.load(OrganismConfig("A", "b", "n", annotations=(Annotation(put(tmp_path, "a.gff3", text)),)))
    assert [r.value for r in w.export_proteins(1).collect()] == [">g1\nMKVLLA"]


AUGUSTUS = """# This output was generated with AUGUSTUS
# start gene g1
c\tAUGUSTUS\tgene\t1\t99\t.\t+\t.\tID=g1
c\tAUGUSTUS\ttranscript\t1\t99\t.\t+\t.\tID=g1.t1;Parent=g1
c\tAUGUSTUS\tCDS\t1\t12\t.\t+\t0\tID=g1.c;Parent=g1.t1
c\tAUGUSTUS\tCDS\t31\t39\t.\t+\t0\tID=g1.c;Parent=g1.t1
# protein sequence = [MKVLLA]
# end gene g1
"""


def test_declared_proteins_fit_their_coding_rows(spark, tmp_path):
    def load(text, prefix=None):
        w = Warehouse.create(spark, f"file://{tmp_path}/store", force=True)
        return w.load(OrganismConfig("A", "b", "n", annotations=(Annotation(put(tmp_path, "a.gff3", text), id_prefix=prefix),)))

    assert load(AUGUSTUS, "x_").features == 3
    with pytest.raises(Refused, match="21 coding bases make 6 residues, declared are 7"):
        load(AUGUSTUS.replace("MKVLLA", "MKVLLAA"))
    with pytest.raises(Refused, match="20 coding bases are no whole number"):
        load(AUGUSTUS.replace("31\t39", "31\t38"))
    load(AUGUSTUS.replace("31\t39", "31\t38").replace("ID=g1.c;", "ID=g1.c;partial=true;"))


def test_another_taxon_is_a_warning(spark, tmp_path):
    region = "chrA\tfunannotate\tregion\t1\t5000\t.\t+\t.\tID=r;Dbxref=taxon:{},x:1\n"
    for taxon, warns in ((7, True), (5, False)):
        w = Warehouse.create(spark, f"file://{tmp_path}/store{taxon}")
        text = GFF.replace("# a comment\n", region.format(taxon))
        report = w.load(OrganismConfig("A", "b", "n", ncbi_taxon_id=5, annotations=(Annotation(put(tmp_path, f"{taxon}.gff3", text)),)))
        assert any("declares taxon 7, the configuration 5" in x for x in report.warnings) == warns


FLAT = """LOCUS       M1                 5000 bp    DNA     linear PLN 01-JAN-2020
VERSION     M.1
FEATURES             Location/Qualifiers
     source          1..5000
     gene            100..900
                     /gene="cox"
                     /db_xref="GeneID:11"
     CDS             100..900
                     /gene="cox"
                     /db_xref="GeneID:11"
     gene            2000..2600
                     /gene="act"
     mRNA            2000..2600
                     /gene="act"
     CDS             2000..2600
                     /gene="act"
     gap             3000..3100
ORIGIN
        1 acgt
//
"""
NINE = """##gff-version 3
M.1\tRefSeq\tregion\t1\t5000\t.\t+\t.\tID=r
M.1\tRefSeq\tgene\t100\t900\t.\t+\t.\tID=g1;gene=cox;Dbxref=GeneID:11
M.1\tRefSeq\tmRNA\t100\t900\t.\t+\t.\tID=t1;Parent=g1;gene=cox;Dbxref=GeneID:11
M.1\tRefSeq\tCDS\t100\t900\t.\t+\t0\tID=c1;Parent=t1;gene=cox
M.1\tRefSeq\tgene\t2000\t2600\t.\t+\t.\tID=g2;gene=act
M.1\tRefSeq\tmRNA\t2000\t2600\t.\t+\t.\tID=t2;Parent=g2;gene=act
M.1\tRefSeq\tCDS\t2000\t2600\t.\t+\t0\tID=c2;Parent=t2;gene=act
M.1\tRefSeq\texon\t2000\t2600\t.\t+\t.\tID=e2;Parent=t2
"""


def test_mrnas_that_one_format_implies_are_set_aside(spark, tmp_path):
    w = Warehouse.create(spark, f"file://{tmp_path}/store")
    w.load(OrganismConfig("A", "b", "n", annotations=(Annotation(put(tmp_path, "nine.gff3", NINE)),)))
    tier = lambda text, name: next((r.outcome, r.detail) for r in w.verify(1, against=put(tmp_path, name, text)).collect() if r.tier == "cross format")
    assert tier(FLAT, "a.gbff") == ("PASS", "1 mRNAs of genes with a coding sequence and no mRNA in the flat file are not compared")
    lost = FLAT.replace('     mRNA            2000..2600\n                     /gene="act"\n', "")
    assert tier(lost, "b.gbff")[0] == "PASS"  # both genes state no mRNA there
    kind, text = tier(FLAT.replace("     gene            2000..2600\n", "     tRNA            2000..2600\n"), "c.gbff")
    assert kind == "FAIL" and "gene 2 1 -1" in text and "tRNA 0 1 1" in text
    # the other way round
    v = Warehouse.create(spark, f"file://{tmp_path}/flat")
    v.load(OrganismConfig("A", "b", "n", annotations=(Annotation(put(tmp_path, "flat.gbff", FLAT)),)))
    got = {r.outcome for r in v.verify(1, against=put(tmp_path, "again.gff3", NINE)).collect() if r.tier == "cross format"}
    assert got == {"PASS"}


def test_the_checksum_of_a_text(spark, tmp_path):
    text = "".join(f"line {i}\n" for i in range(9000))
    path = put(tmp_path, "long.txt", text)
    one = files.digest(spark, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    assert files.digest(spark, path) == one  # by whatever splits
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for other in (text.replace("line 8000\n", "line 8001\n"), text[:-1], text.replace("line 1\nline 2\n", "line 2\nline 1\n"), text.replace("line 5\n", "line 5\r\n"), ""):
        assert files.digest(spark, put(tmp_path, "other.txt", other)) != one


def test_answers_by_name_are_those_by_joins(loaded, monkeypatch):
    from strandline.sources import warehouse

    w = loaded[0] if isinstance(loaded, tuple) else loaded
    asks = [
        lambda: w.by_id(1, "G1", descendants=True), lambda: w.by_id(1, "cds2", ancestors=True), lambda: w.by_id(1, "G1", descendants=True, types=("exon",), ancestors=True), lambda: w.in_region(1, "chrA:1-3,000"),
        lambda: w.in_region(1, "chrA:120-130", descendants=True), lambda: w.by_id(1, "nothing", descendants=True),
    ]
    found = [[tuple(r) for r in ask().collect()] for ask in asks]
    monkeypatch.setattr(warehouse, "LOOKUP_MOST", 1)  # larger answers are found by joins
    assert [[tuple(r) for r in ask().collect()] for ask in asks] == found
    assert [len(f) for f in found][:3] == [5, 3, 4] and found[-1] == []


def test_indexed_parts_that_executors_write(loaded, spark):
    w, folder = loaded
    before = spark.conf.get("spark.sql.shuffle.partitions")
    uri = f"file://{folder}/parts"
    parts = w.write_indexed_parts(1, uri).orderBy("part").collect()
    assert sum(p.n_rows for p in parts) == w.table(1, "feature").count() and all(p.indexed for p in parts) and before
    lines = []
    for p in parts:
        data = (folder / "parts" / p.name).read_bytes()
        assert len(data) == p.n_bytes
        text = gzip.decompress(data).decode().splitlines()
        assert text[0] == "##gff-version 3" and len(text) == p.n_rows + 1
        assert gzip.decompress((folder / "parts" / f"{p.name}.tbi").read_bytes())[:4] == b"TBI\1"
        lines += text[1:]
    whole = f"{folder}/whole.gff3.gz"
    w.write_indexed(1, f"file://{whole}")
    assert lines == gzip.decompress(open(whole, "rb").read()).decode().splitlines()[1:]
    one = bgzf.write_parts(spark.createDataFrame([], "sequence int, start long, end long, line string"), [], [], f"file://{folder}/none")
    assert one.count() == 0
