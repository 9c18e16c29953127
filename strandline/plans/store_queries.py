"""Queries over a store: the tables written as an annotation file, a sequence file and
functional tables, loaded, and asked.

One store is made for each session and set of tables, in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans import graph_view as g
from strandline.plans.registry import query
from strandline.sources import files, recount
from strandline.sources.config import Annotation, Functional, OrganismConfig
from strandline.sources.warehouse import Refused, Warehouse

_STORES: dict[tuple[str, str], Warehouse] = {}
PIECES = 10_000  # of 10,000 bases each, in a file of sequences

#: Genes, a transcript for each, exons and a coding feature of several rows, on the nations.
SQL = """
line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS k FROM lineitem),
gene AS (SELECT o_orderkey, 'chr'||c_nationkey AS seqid, (o_orderkey//20)*2000+1 AS lo, (o_orderkey//20)*2000+2000 AS hi, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand FROM orders JOIN customer ON o_custkey = c_custkey),
part AS (SELECT o_orderkey, k, seqid, strand, lo+60*(k-1) AS a, lo+60*(k-1)+l_quantity::BIGINT AS b, l_partkey FROM line JOIN gene ON o_orderkey = l_orderkey),
feature AS (
  SELECT seqid, 'g'||o_orderkey AS source_id, 'gene' AS source_type, lo AS "start", hi AS "end", strand, 0::BIGINT AS segment_index, NULL::VARCHAR AS parent_id FROM gene
  UNION ALL SELECT seqid, 't'||o_orderkey, 'transcript', lo, hi, strand, 0, 'g'||o_orderkey FROM gene
  UNION ALL SELECT seqid, 'e'||o_orderkey||'.'||k, 'exon', a, b, strand, 0, 't'||o_orderkey FROM part
  UNION ALL SELECT seqid, 'c'||o_orderkey, 'CDS', a, b, strand, row_number() OVER (PARTITION BY o_orderkey ORDER BY a) - 1, 't'||o_orderkey FROM part),
whole AS (SELECT source_id, min(seqid) AS seqid, min(source_type) AS source_type, min("start") AS "start", max("end") AS "end", min(strand) AS strand, count(*) AS n_segments, min(parent_id) AS parent_id,
  string_agg("start"||'-'||"end", ',' ORDER BY "start") AS segments FROM feature GROUP BY source_id)
"""


def V(sql: str) -> str:  # noqa: N802
    head, _, rest = sql.strip().partition(" ")
    return f"WITH {SQL}, {rest}" if head.upper() == "WITH" else f"WITH {SQL} {sql.strip()}"


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    """Folders of the annotation, the sequences and the functional table."""
    o, c, li = (g.read(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    lo = F.floor(F.col("o_orderkey") / 20) * 2000 + 1
    gene = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("long").alias("o"), F.concat(F.lit("chr"), "c_nationkey").alias("seqid"), lo.alias("lo"), (lo + 1999).alias("hi"), F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand")
    )
    by = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")))  # of one order
    part = F.transform("p", lambda x, k: F.struct((k + 1).cast("long").alias("k"), (F.col("lo") + 60 * k).alias("a"), (F.col("lo") + 60 * k + x["l_quantity"].cast("long")).alias("b")))
    per_order = gene.join(li.groupBy("l_orderkey").agg(by.alias("p")), F.col("o") == F.col("l_orderkey"), "left").withColumn("p", F.coalesce(part, F.array().cast("array<struct<k:bigint,a:bigint,b:bigint>>"))).drop("l_orderkey")

    def row(kind: str, a, b, phase: str, nine: F.Column) -> F.Column:
        return F.concat_ws("\t", "seqid", F.lit("funannotate"), F.lit(kind), a, b, F.lit("."), "strand", F.lit(phase), nine)

    heads = F.array(row("gene", F.col("lo"), F.col("hi"), ".", F.concat(F.lit("ID=g"), "o", F.lit(";Name=n"), "o", F.lit(";Dbxref=GeneID:"), "o", F.lit(",X:1"))), row("transcript", F.col("lo"), F.col("hi"), ".", F.concat(F.lit("ID=t"), "o", F.lit(";Parent=g"), "o", F.lit(";product=a%3Bb%2Cc"))))
    exons = F.transform("p", lambda x: row("exon", x["a"], x["b"], ".", F.concat(F.lit("ID=e"), "o", F.lit("."), x["k"], F.lit(";Parent=t"), "o")))
    coding = F.transform("p", lambda x: row("CDS", x["a"], x["b"], "0", F.concat(F.lit("ID=c"), "o", F.lit(";Parent=t"), "o", F.lit(";part="), x["k"])))
    # orders are put in order, and their lines made after that; the first line lies in a file before them
    ordered = per_order.repartitionByRange("o").sortWithinPartitions("o")
    body = ordered.select(F.explode(F.concat(heads, exons, coding)).alias("value"))
    top = spark.createDataFrame([("##gff-version 3",)], "value string").coalesce(1)
    annotation = files.write_lines(top.unionByName(body), files.scratch(spark, "load"), compression="gzip")
    # every sequence is long enough for every gene
    longest = o.agg((F.floor(F.max("o_orderkey") / 20) + 1).cast("long").alias("m"))
    n = g.read(spark, sf_dir, "nation").crossJoin(longest)  # one row
    size = 10_000
    pieces = n.select(F.col("n_nationkey").cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("m") * 2000 / size))).alias("j"))
    shares = max(1, pieces.count() // PIECES)  # by what a task reads of them, as they take next to no room
    pieces = pieces.repartitionByRange(shares, "n", "j").sortWithinPartitions("n", "j")
    fasta = files.write_lines(pieces.select(F.concat(F.when(F.col("j") == 0, F.concat(F.lit(">chr"), "n", F.lit("\n"))).otherwise(""), F.repeat(F.lit("ACGTA"), size // 5)).alias("value")), files.scratch(spark, "bases"), compression="gzip")
    k = F.col("o")
    hits = gene.select("o", F.lit(1).alias("i"), F.concat_ws("\t", F.concat(F.lit("t"), k), F.lit("1e-5"), F.concat(F.lit("GO:"), F.lpad((k % 40).cast("string"), 7, "0"), F.lit(",GO:"), F.lpad((k % 7 + 100).cast("string"), 7, "0")), F.when(k % 3 == 0, F.concat(F.lit("map0"), k % 5 + 1000)).otherwise("-")).alias("value"))
    head = spark.createDataFrame([(-1, 0, "#query\tevalue\tGOs\tKEGG_Pathway")], "o long, i int, value string")
    table = files.write_lines(head.unionByName(hits), files.scratch(spark, "terms"), "o", "i", compression="gzip")
    return annotation, fasta, table


def store(spark: SparkSession, sf_dir: str) -> Warehouse:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        annotation, fasta, table = _inputs(spark, sf_dir)
        w = Warehouse.create(spark, files.scratch(spark, "store"))
        w.load(OrganismConfig("Genus", "species", "A1", fasta, annotations=(Annotation(annotation),), functional=(Functional(table),)))
        _STORES[key] = w
    return _STORES[key]


@query(V("""SELECT f.*, (p."start")::BIGINT AS parent_start, CASE WHEN f.source_type = 'transcript' THEN 'mRNA' ELSE f.source_type END AS feature_type FROM feature f LEFT JOIN feature p ON p.source_id = f.parent_id AND p.segment_index = 0"""))
def stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored rows with the start of their parent, which the stored key leads to."""
    f = store(spark, sf_dir).table(1, "feature")
    p = f.select(F.col("feature_id").alias("_p"), F.col("start").alias("parent_start"))
    return f.join(p, F.col("parent_feature_id") == F.col("_p"), "left").select("seqid", "source_id", "source_type", "start", "end", "strand", F.col("segment_index").cast("long"), "parent_id", "parent_start", "feature_type")


@query(V("""SELECT source_id, segment_index, key, ordinal, value FROM (
  SELECT 'g'||o_orderkey AS source_id, 0::BIGINT AS segment_index, unnest(['Name','Dbxref','Dbxref']) AS key, unnest([0,0,1]) AS ordinal, unnest(['n'||o_orderkey, 'GeneID:'||o_orderkey, 'X:1']) AS value FROM gene
  UNION ALL SELECT 't'||o_orderkey, 0, 'product', 0, 'a;b,c' FROM gene UNION ALL SELECT 'c'||o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY a) - 1, 'part', 0, k::VARCHAR FROM part)"""))
def stored_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored values, joined to their rows: those of a feature's first row, and of others where they differ."""
    w = store(spark, sf_dir)
    f = w.table(1, "feature").select("feature_id", "source_id", F.col("segment_index").cast("long").alias("segment_index"))
    return w.table(1, "attribute").join(f, "feature_id").select("source_id", "segment_index", "key", "ordinal", "value")


@query("""SELECT 'gff3' AS format, 'funannotate' AS dialect, 'MEDIUM' AS confidence""")
def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files an assembly was loaded from, as they were recognised."""
    return store(spark, sf_dir).table(1, "source_file").select("format", "dialect", "confidence")


@query(V("""SELECT 'Genus species reference A1' AS label, (SELECT count(*) FROM whole) AS features, (SELECT count(*) FROM feature) AS n_rows, 0::BIGINT AS repairs, 1::BIGINT AS warnings"""))
def load_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a load says of itself; it warns that the producer's mRNA is missing, as transcripts stand for it."""
    m = store(spark, sf_dir).manifest(1)
    return spark.createDataFrame([(m["label"], m["features"], m["rows"], m["repairs"], len(m["warnings"]))], "label string, features long, n_rows long, repairs long, warnings long")


@query("""SELECT * FROM (VALUES ('source count', 'PASS'), ('row count', 'PASS'), ('stated parents', 'PASS'), ('parent edges', 'PASS'), ('assembly', 'PASS'), ('published counts', 'FAIL')) v(tier, outcome)""")
def verify_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tier on an intact store, and published counts that are not met."""
    published = spark.createDataFrame([("gene", 1)], "feature string, n long")
    return store(spark, sf_dir).verify(1, published=published).select("tier", "outcome")


@query(V("""SELECT source_type AS type, 'stated' AS kind, count(DISTINCT source_id) AS features FROM feature GROUP BY 1 UNION ALL SELECT CASE WHEN source_type = 'transcript' THEN 'mRNA' ELSE source_type END, 'canonical', count(DISTINCT source_id) FROM feature GROUP BY 1"""))
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by stated and by canonical type."""
    w = store(spark, sf_dir)
    one = lambda by, kind: w.stats(by).select(F.col(by).alias("type"), F.lit(kind).alias("kind"), "features")
    return one("source_type", "stated").unionByName(one("feature_type", "canonical"))


_EXPORT = """lines AS (
  SELECT seqid||chr(9)||'funannotate'||chr(9)||'gene'||chr(9)||lo||chr(9)||hi||chr(9)||'.'||chr(9)||strand||chr(9)||'.'||chr(9)||'ID=g'||o_orderkey||';Name=n'||o_orderkey||';Dbxref=GeneID:'||o_orderkey||',X:1' AS value FROM gene
  UNION ALL SELECT seqid||chr(9)||'funannotate'||chr(9)||'transcript'||chr(9)||lo||chr(9)||hi||chr(9)||'.'||chr(9)||strand||chr(9)||'.'||chr(9)||'ID=t'||o_orderkey||';Parent=g'||o_orderkey||';product=a%3Bb%2Cc;linkage_method=explicit_parent' FROM gene
  UNION ALL SELECT seqid||chr(9)||'funannotate'||chr(9)||'exon'||chr(9)||a||chr(9)||b||chr(9)||'.'||chr(9)||strand||chr(9)||'.'||chr(9)||'ID=e'||o_orderkey||'.'||k||';Parent=t'||o_orderkey||';linkage_method=explicit_parent' FROM part
  UNION ALL SELECT seqid||chr(9)||'funannotate'||chr(9)||'CDS'||chr(9)||a||chr(9)||b||chr(9)||'.'||chr(9)||strand||chr(9)||'0'||chr(9)||'ID=c'||o_orderkey||';Parent=t'||o_orderkey||';part='||k||';linkage_method=explicit_parent' FROM part)"""


@query(V(f"""WITH {_EXPORT} SELECT value FROM lines UNION ALL SELECT '##sequence-region chr'||n_nationkey||' 1 '||(((SELECT max(o_orderkey)//20 + 1 FROM orders) * 2000) // 10000 + 1) * 10000 FROM nation"""))
def store_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotation as it is written out, without the lines that name the program."""
    return store(spark, sf_dir).export_gff3(1).filter(~F.startswith("value", F.lit("##gff-version")) & ~F.startswith("value", F.lit("##strandline")))


@query(V("""SELECT source_type, count(DISTINCT source_id) AS features, count(*) AS n_rows, count(parent_id) AS with_parent FROM feature GROUP BY 1"""))
def export_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export counted again, from its text."""
    path = store(spark, sf_dir).write_gff3(1, files.scratch(spark, "export"))
    return recount.count_lines(files.lines(spark, path))


_TERMS = """hits AS (SELECT o_orderkey, 'GO' AS analysis, 'GO:'||lpad((o_orderkey % 40)::VARCHAR, 7, '0') AS accession FROM gene UNION SELECT o_orderkey, 'GO', 'GO:'||lpad((o_orderkey % 7 + 100)::VARCHAR, 7, '0') FROM gene
  UNION SELECT o_orderkey, 'KEGG_Pathway', 'ko0'||(o_orderkey % 5 + 1000) FROM gene WHERE o_orderkey % 3 = 0)"""


@query(V(f"""WITH {_TERMS} SELECT 't'||o_orderkey AS source_id, analysis, accession, 't'||o_orderkey AS query_id, 'eggnog' AS tool FROM hits"""))
def store_functional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functional table of an assembly, with the run each hit came from."""
    return store(spark, sf_dir).export_functional(1).select("source_id", "analysis", "accession", "query_id", "tool")


@query(V("""SELECT count(*) AS queries, count(*) AS matched, 0::BIGINT AS unmatched, count(*) * 2 + count(*) FILTER (o_orderkey % 3 = 0) - count(*) FILTER ('GO:'||lpad((o_orderkey % 40)::VARCHAR, 7, '0') = 'GO:'||lpad((o_orderkey % 7 + 100)::VARCHAR, 7, '0')) AS hits FROM gene"""))
def store_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each functional run matched."""
    return store(spark, sf_dir).table(1, "annotation_run").select("queries", "matched", "unmatched", "hits")


_ANSWER = """whole.source_id, seqid, whole.source_type, "start", "end", strand, n_segments, segments, parent_id, 'g'||regexp_extract(whole.source_id, '[0-9]+') AS top_level"""
_COLUMNS = ["source_id", "seqid", "source_type", "start", "end", "strand", "n_segments", "segments", "parent_id", "top_level"]


@query(V(f"""WITH pick AS (SELECT min(o_orderkey) AS k FROM orders) SELECT {_ANSWER} FROM whole, pick WHERE regexp_extract(source_id, '[0-9]+')::BIGINT = k"""))
def store_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gene and all under it, by its identifier."""
    k = g.read(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    return store(spark, sf_dir).by_id(1, f"g{k}", descendants=True).select(*_COLUMNS)


@query(V(f"""WITH pick AS (SELECT 'c'||min(o_orderkey) AS c, min(o_orderkey) AS k FROM orders) SELECT {_ANSWER} FROM whole, pick WHERE source_id IN (c, 't'||k, 'g'||k)"""))
def store_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coding feature and all above it."""
    k = g.read(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    return store(spark, sf_dir).by_id(1, f"c{k}", ancestors=True).select(*_COLUMNS)


@query(V(f"""WITH mid AS (SELECT (max(hi) // 2)::BIGINT AS m FROM gene), near AS (SELECT DISTINCT source_id FROM feature, mid WHERE seqid = 'chr3' AND "start" <= m + 100000 AND "end" >= m) SELECT {_ANSWER} FROM whole JOIN near USING (source_id)"""))
def store_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole features with a row in a region."""
    m = (g.read(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] // 20 * 2000 + 2000) // 2
    return store(spark, sf_dir).in_region(1, f"chr3:{m:,}-{m + 100000:,}").select(*_COLUMNS)


@query(V(f"""WITH {_TERMS} SELECT {_ANSWER} FROM whole WHERE source_id IN (SELECT 't'||o_orderkey FROM hits WHERE accession = 'ko01002')"""))
def store_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with a term, asked for in another of its forms."""
    return store(spark, sf_dir).with_term(1, "map01002", analysis="kegg_pathway").select(*_COLUMNS)


@query(V(f"""WITH {_TERMS}, pick AS (SELECT min(o_orderkey) AS k FROM orders) SELECT source_id, source_type, "start", "end", parent_id, (SELECT count(*) FROM whole c WHERE c.parent_id = 't'||k) AS n_children, (SELECT count(*) FROM hits WHERE o_orderkey = k) AS terms, 'Genus species reference A1' AS assembly FROM whole, pick WHERE source_id = 't'||k"""))
def store_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an identifier is, and what hangs on it."""
    k = g.read(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    return store(spark, sf_dir).explain(f"t{k}").select("source_id", "source_type", "start", "end", "parent_id", "n_children", "terms", "assembly")


@query(V("""SELECT 'feature' AS "table", count(*) AS n FROM feature UNION ALL SELECT 'sequence', (SELECT count(*) FROM nation) UNION ALL SELECT 'source_file', 1 UNION ALL SELECT 'annotation_run', 1"""))
def store_removal_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a removal would take away."""
    plan = store(spark, sf_dir).plan_removal(1)
    return spark.createDataFrame([(t, plan[t]) for t in ("feature", "sequence", "source_file", "annotation_run")], "table string, n long")


@query("""SELECT * FROM (VALUES ('loaded twice', 'is loaded already'), ('file named twice', 'named twice'), ('no such assembly', 'no assembly'), ('no such sequence', 'no sequence'), ('outside a sequence', 'bases'), ('table attached twice', 'attached already')) v("case", refused)""")
def store_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store refuses, and that it says why."""
    w = store(spark, sf_dir)
    entry = w.table(1, "source_file").select("path").first()[0]
    table = w.table(1, "annotation_run").select("path").first()[0]
    length = w.table(1, "sequence").agg(F.max("length")).first()[0]
    again = OrganismConfig("Genus", "species", "A1", annotations=(Annotation(entry),))
    twice = OrganismConfig("Genus", "species", "A2", annotations=(Annotation(entry), Annotation(entry)))
    cases = [
        ("loaded twice", "is loaded already", lambda: w.load(again)), ("file named twice", "named twice", lambda: w.load(twice)), ("no such assembly", "no assembly", lambda: w.table(7, "feature")),
        ("no such sequence", "no sequence", lambda: w.region(1, "chrX:1-2")), ("outside a sequence", "bases", lambda: w.region(1, f"chr1:{length + 1}-{length + 2}")), ("table attached twice", "attached already", lambda: w.attach_functional(1, table)),
    ]
    out = []
    for name, text, ask in cases:
        try:
            ask()
            out.append((name, "nothing"))
        except Refused as e:
            out.append((name, text if text in str(e) else str(e)))
    return spark.createDataFrame(out, "case string, refused string")
