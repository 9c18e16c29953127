"""Work that must be done once: rows of a load meet by ID once, lines are split once, and
what queries write for a store takes less room than what it says."""

import hashlib
import re

from pyspark.sql import functions as F

from strandline.operators import graph
from strandline.operators.normalise import _opened, _packed, normalise
from strandline.plans import graph_view, plain_queries, store_queries
from strandline.sources import files, foreign, genbank, gff3, plain_reader, profiles, warehouse
from strandline.sources.config import Annotation, OrganismConfig
from strandline.sources.warehouse import Warehouse


def put(tmp_path, *rows):
    path = tmp_path / "a.gff3"
    path.write_text("##gff-version 3\n" + "\n".join(rows) + "\n")
    return str(path)


def test_rows_meet_once_and_all_rules_read_what_was_written(spark, tmp_path):
    row = "s\tx\t{}\t{}\t{}\t.\t{}\t.\t{}".format
    path = put(
        tmp_path, row("gene", 1, 90, "+", "ID=g"), row("mRNA", 1, 90, "+", "ID=t;Parent=g"), row("CDS", 1, 20, "+", "ID=c;Parent=t;k=1"), row("CDS", 10, 30, "-", "ID=c;Parent=t;k=2"),
        row("exon", 5, 9, "+", "ID=e;Parent=t"), row("exon", 5, 9, "+", "ID=e;Parent=t"), row("exon", 5, 9, "+", "ID=lost;Parent=none"), row("exon", 6, 9, "+", "Parent=t"),
    )
    written = []

    def cut(df):
        written.append(str(tmp_path / f"cut{len(written)}"))
        df.write.parquet(written[-1])
        return spark.read.parquet(written[-1])

    found = normalise(gff3.read(spark, path).rows, profiles.PROFILES[1], cut=cut)
    rules = {(r.rule, r.subject, r.detail) for r in found.problems.collect()}
    assert len(written) == 1
    assert {("rows differ", "c", "row 5 strand"), ("rows overlap", "c", "4 5"), ("rows overlap", "e", "6 7"), ("parent not in file", "lost", "none")} <= rules
    assert [(r.source_id, r.n) for r in found.again.collect()] == [("e", 2)]
    assert sorted((r.id, r.start, r.end, r.n_segments) for r in found.envelopes.collect()) == [("c", 1, 30, 2), ("e", 5, 9, 2), ("g", 1, 90, 1), ("lost", 5, 9, 1), ("t", 1, 90, 1)]
    rows = {r.row_id: (r.segment_index, len(r.stored_attributes)) for r in found.rows.collect()}
    assert rows[4] == (0, 1) and rows[5] == (1, 1) and rows[9] == (0, 0)


def test_the_filter_of_bad_rows_does_not_split_again(spark, tmp_path):
    rows = gff3.read(spark, put(tmp_path, "s\tx\tgene\t1\t9\t.\t+\t.\tID=g")).rows
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("split(value") for line in plan.splitlines() if "Filter" in line) == 0


def test_what_is_written_for_a_store_is_compressed(spark):
    annotation, fasta, table = store_queries._inputs(spark, "/root/testdata/sf0.001")
    assert all(n.endswith(".gz") for uri in (annotation, fasta, table) for n in files.text_parts(spark, uri))
    bases = files.lines(spark, fasta).selectExpr("sum(length(value)) as n").first().n
    assert files.length(spark, fasta) * 100 < bases


def test_the_second_reader_takes_a_line_apart_once(spark, tmp_path):
    rows = plain_reader.read(spark, put(tmp_path, "s\tx\tgene\t1\t9\t.\t+\t.\tID=g;Note=a,b")).rows
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("split(line") for line in plan.splitlines()) <= 1
    r = rows.first()
    assert (r.id, r.start, r.end, r.multi_valued) == ("g", 1, 9, True)


def test_a_larger_table_is_dealt_to_more_tasks(spark, monkeypatch):
    sf, tasks = "/root/testdata/sf0.001", lambda: graph_view.parts(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in tasks()
    rows = sorted(graph_view.features(spark, sf).collect(), key=str)
    shares = files.held(spark, f"{sf}/lineitem.parquet") // 4096
    assert shares > spark.sparkContext.defaultParallelism
    monkeypatch.setattr(graph_view, "SHARE", 4096)
    assert re.search(r"RepartitionByExpression \[l_orderkey#\d+L?\], %d" % shares, tasks())
    assert sorted(graph_view.features(spark, sf).collect(), key=str) == rows


def test_records_of_a_flat_file_are_put_together_once(spark, tmp_path):
    path = tmp_path / "a.gb"
    path.write_text("LOCUS       A 90 bp DNA circular\nVERSION     A.1\nFEATURES             Location/Qualifiers\n     gene            1..9\n                     /locus_tag=\"x\"\n     mRNA            1..9\n                     /locus_tag=\"x\"\n//\nLOCUS       B 20 bp\nORIGIN\n//\n")
    found = genbank.read(spark, str(path))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan(found.rows) and "FEATURES" not in plan(found.rows)
    assert sorted((r.source_type, r.source_id) for r in found.rows.collect()) == [("gene", "x"), ("mRNA", "x:mRNA")]
    assert sorted((r.seqid, r.end) for r in genbank.directives(spark, str(path)).collect()) == [("A.1", 90), ("B", 20)]
    assert sorted((r.seqid, r.end) for r in found.directives.collect()) == [("A.1", 90), ("B", 20)]


def test_levels_and_rounds_read_edges_that_are_written(spark, monkeypatch):
    edges = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent_id string")
    cut, written = graph._cut, []
    monkeypatch.setattr(graph, "_cut", lambda df: written.append(df.columns) or cut(df))
    found = graph.depth_first(edges, edges.select("id", F.ascii("id").alias("rank")))
    assert {r.id: list(r.path.ranks) for r in found.collect()} == {"a": [97], "b": [97, 98], "c": [97, 98, 99]}
    assert ["id", "parent_id", "_rank"] in written
    above = foreign.ancestors(edges.filter("parent_id is not null").select("id", F.col("parent_id").alias("parent"), F.lit("is_a").alias("relation")))
    assert {tuple(r) for r in above.collect()} == {("b", "a", 1), ("c", "b", 1), ("c", "a", 2)}
    assert ["id", "parent_id"] in written


def test_blocks_of_a_split_are_summed_where_they_are_read(spark, tmp_path):
    lines = [f"line {i}" for i in range(10_000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    rows = files.raw_lines(spark, str(tmp_path / "a.txt")).select((F.col("line") - 1).alias("i"), F.unhex(F.sha2("value", 256)).alias("h"))
    assert {r.whole: r["count"] for r in files._leaves(rows.coalesce(1).sortWithinPartitions("i")).groupBy("whole").count().collect()} == {True: 2, False: 10_000 - 2 * 4096}
    assert {r.whole: r["count"] for r in files._leaves(rows.coalesce(1).filter("i >= 5")).groupBy("whole").count().collect()} == {True: 1, False: 10_000 - 4096 - 5}
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    blocks = "".join(sha("".join(sha(x) for x in lines[i : i + 4096])) for i in range(0, 10_000, 4096))
    assert files.digest(spark, str(tmp_path / "a.txt")) == "tree:" + sha(f"{sha(blocks)} {len(chr(10).join(lines)) + 1}")


def test_a_load_sends_and_writes_no_column_that_follows_from_others(spark, tmp_path):
    row = "s\tfunannotate\t{}\t{}\t{}\t.\t+\t.\t{}".format
    path = put(tmp_path, row("gene", 1, 90, "ID=g;Name=n"), row("mRNA", 1, 90, "ID=t;Parent=g"), row("exon", 1, 20, "ID=e;Parent=t"), row("exon", 30, 90, "ID=f;Parent=t,g"), row("CDS", 1, 20, "ID=c;Parent=t;k=1"), row("CDS", 30, 90, "ID=c;Parent=t;k=2"))
    written = []
    found = normalise(gff3.read(spark, path).rows, profiles.PROFILES[1], cut=lambda df: written.extend(df.columns) or graph._cut(df))
    assert "_keeps" in written and "stored_attributes" not in written
    assert {r.row_id: list(r.parents) for r in found.rows.collect()} == {2: [], 3: ["g"], 4: ["t"], 5: ["t", "g"], 6: ["t"], 7: ["t"]}
    assert [r.rule for r in found.problems.collect()] == ["several parents"] and found.outside.count() == 0

    path = put(tmp_path, row("gene", 1, 80, "ID=g"), row("mRNA", 1, 90, "ID=t;Parent=g"), row("exon", 1, 20, "ID=e;Parent=t"))
    strays = normalise(graph._cut(gff3.read(spark, path).rows), profiles.PROFILES[1], cut=graph._cut)
    assert [tuple(r) for r in strays.outside.collect()] == [("t", "g", 1, 90, 1, 80)] and not strays.problems.collect()

    (tmp_path / "store").mkdir()
    (tmp_path / "s.fa").write_text(">s\n" + "A" * 100 + "\n")
    path = put(tmp_path, row("gene", 1, 90, "ID=g"), row("mRNA", 1, 90, "ID=t;Parent=g"), row("exon", 1, 20, "ID=e;Parent=t"))
    w = Warehouse.create(spark, str(tmp_path / "store" / "w"))
    w.load(OrganismConfig("Genus", "species", "A1", str(tmp_path / "s.fa"), annotations=(Annotation(path),)))
    near = spark.read.parquet(f"{w.root}/{w._assembly(1)['folder']}/by_name").columns
    assert not {"source_id", "feature_type", "bin", "line", "assembly_id"} & set(near)
    assert sorted(r.source_id for r in w.by_id(1, "g", descendants=True).collect()) == ["e", "g", "t"]
    feature = {r.source_id: r for r in w.table(1, "feature").collect()}
    assert feature["e"].parent_feature_id == feature["t"].feature_id and feature["g"].parent_feature_id is None and feature["t"].feature_type == "mRNA"


def test_records_of_an_attribute_store_are_taken_apart_once(spark, monkeypatch):
    cut, written = graph._cut, []
    monkeypatch.setattr(graph, "_cut", lambda df: written.append(df.columns) or cut(df))
    records = spark.createDataFrame(
        [(1, "s", "gene", 1, 9, "+", '{"ID":["g"]}'), (2, "s", "mRNA", 1, 9, "+", '{"ID":["t"],"Note":["a "]}'), (3, "s", "mRNA", 12, 19, "+", '{"ID":["t"],"Note":["a"]}'), (4, "s", "exon", 1, 5, "+", None), (5, "s", "exon", 1, 5, "+", "{}")],
        "id long, seqid string, featuretype string, start long, end long, strand string, attributes string",
    )
    found = foreign.from_attribute_store(records, spark.createDataFrame([(1, 2, 1), (2, 4, 1), (2, 5, 1), (1, 4, 2)], "parent long, child long, level int"))
    assert "from_json" not in found._jdf.queryExecution().optimizedPlan().toString() and written == [["id", "seqid", "type", "start", "end", "strand", "_id", "digest"]]
    rows = sorted(found.collect(), key=lambda r: r.key)
    assert [(r.key[:5], r.key[-2:] == "#2", r.nseg, r.segs, r.parents) for r in rows] == [("anon:", False, 1, "1-5", "t"), ("anon:", True, 1, "1-5", "t"), ("g", False, 1, "1-9", ""), ("t", False, 2, "1-9,12-19", "g")]
    assert rows[0].key + "#2" == rows[1].key and not rows[3].attrs.startswith("rows:")


def test_links_of_records_are_made_from_rows_that_are_written(spark):
    rows, links = plain_queries._identified(spark, "/root/testdata/sf0.001")
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in rows._jdf.queryExecution().optimizedPlan().toString() and plan.count("Aggregate") == 1
    assert links.count() == links.distinct().count() > 0


def test_attributes_are_sent_as_text_wherever_it_holds_them(spark, tmp_path):
    nine = ["ID=a;Note=x,y;k=", "ID=b;Note=x%1Ey", "ID=c;Note=x%1Fy,z%1D", "ID=d;=v;k=,", "."]
    rows = gff3.read(spark, put(tmp_path, *[f"s\tx\tgene\t1\t9\t.\t+\t.\t{x}" for x in nine])).rows.select("row_id", "attributes")
    odd = spark.createDataFrame([(20, [("k", [])]), (21, [(None, ["v"])]), (22, [("k", None)]), (23, [("k", [None, "v"])]), (24, None)], rows.schema)
    rows = rows.unionByName(odd)
    assert {r.row_id for r in _packed(rows).filter("_text is null").collect()} == {3, 4, 20, 21, 22, 23, 24}
    assert sorted(_opened(_packed(rows)).collect(), key=lambda r: r.row_id) == sorted(rows.collect(), key=lambda r: r.row_id)


def test_rows_of_a_bucket_meet_once_and_leaves_are_asked_last(spark, tmp_path, monkeypatch):
    row = "s\tfunannotate\t{}\t{}\t{}\t.\t+\t.\t{}".format
    path = put(tmp_path, row("gene", 1, 90, "ID=g"), row("mRNA", 1, 90, "ID=t;Parent=g"), row("exon", 1, 20, "ID=e;Parent=t"), row("exon", 1, 95, "ID=f;Parent=e"), row("motif", 1, 5, "ID=m;Parent=e"), row("exon", 1, 20, "ID=h;Parent=none"))
    sent = []
    found = normalise(gff3.read(spark, path).rows, profiles.PROFILES[1], cut=lambda df: sent.append(df._jdf.queryExecution().executedPlan().toString()) or graph._cut(df), shares=3)
    assert "hashpartitioning(_share" in sent[0] and "hashpartitioning(source_id" not in sent[0]
    assert {(r.rule, r.subject, r.detail) for r in found.problems.collect()} == {("parent type", "f", "exon under exon"), ("parent not in file", "h", "none")}
    assert [tuple(r) for r in found.outside.collect()] == [("f", "e", 1, 95, 1, 20)]

    monkeypatch.setattr(warehouse, "BUCKET_ROWS", 2)
    path = put(tmp_path, profiles.EXPORT_PRAGMA, row("gene", 1, 90, "ID=g"), row("mRNA", 1, 90, "ID=t;Parent=g"), row("exon", 1, 20, "ID=e;Parent=t"), row("exon", 30, 90, "Parent=t"), row("CDS", 1, 20, "ID=c;Parent=t"), row("CDS", 30, 90, "ID=c;Parent=t"), row("motif", 1, 5, "ID=m;Parent=e"))
    (tmp_path / "s.fa").write_text(">s\n" + "A" * 100 + "\n")
    w = Warehouse.create(spark, str(tmp_path / "w"))
    w.load(OrganismConfig("Genus", "species", "A1", str(tmp_path / "s.fa"), annotations=(Annotation(path),)))
    by_name = spark.read.parquet(f"{w.root}/{w._assembly(1)['folder']}/by_name")
    assert by_name.filter("bucket <> crc32(name) % 3").count() == 0 and by_name.count() == w.table(1, "feature").count() == 7
    assert sorted(r.parent_feature_id - (1 << 40) for r in w.table(1, "feature").filter("parent_id is not null").collect()) == [3, 4, 4, 4, 4, 5]
    assert [r.segments for r in w.by_id(1, "c").collect()] == ["1-20,30-90"] and len(w.by_id(1, "g", descendants=True).collect()) == 6
