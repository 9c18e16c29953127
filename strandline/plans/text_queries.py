"""Queries that write the tables as text of the formats and read it back: every result
goes through a reader."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalars, vocabulary
from strandline.functions.bins import TABIX_DEPTH, bin_of
from strandline.operators import export_rows
from strandline.operators.normalise import normalise
from strandline.plans import graph_view as g
from strandline.plans.registry import query
from strandline.sources import cross_format, fasta, files, functional_files, genbank, gff3, profiles, recount

V = g.with_view
SHIFT = 500_000  # positions of the view may lie before 1
NONE = "array<struct<key:string,values:array<string>>>"


def _heads(spark: SparkSession, lines: list[str]) -> DataFrame:
    """Lines before all others; order counts from far below any row."""
    first = -(1 << 60)
    return spark.createDataFrame([(first + i, x) for i, x in enumerate(lines)], "k long, value string")


def _put(spark: SparkSession, name: str, *parts: DataFrame, compression: str = "none") -> str:
    """A text of (k, value) rows in the order of k."""
    return files.write_lines(reduce(DataFrame.unionByName, parts), files.scratch(spark, name), "k", compression=compression)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = g.features(spark, sf_dir).withColumn("start", F.col("start") + SHIFT).withColumn("end", F.col("end") + SHIFT)
    note = F.struct(F.lit("Note").alias("key"), F.array(F.concat("program", F.lit(";=,&% \t")), F.col("file")).alias("values"))
    return f.withColumn("score", F.when(F.col("row_id") % 3 == 0, (F.col("row_id") % 7) / 2)).withColumn("attributes", F.array(note))


def gff3_text(spark: SparkSession, sf_dir: str) -> str:
    """The whole view as an annotation file: header, sequences, a comment, rows by row_id."""
    rows = _rows(spark, sf_dir).select(F.col("row_id").alias("k"), export_rows.gff3_line().alias("value"))
    regions = g.sequences(spark, sf_dir).select((F.lit(-(1 << 59)) + F.regexp_extract("seqid", "[0-9]+", 0).cast("long")).alias("k"), F.concat(F.lit("##sequence-region "), "seqid", F.lit(" 1 "), "length").alias("value"))
    return _put(spark, "annotation", _heads(spark, ["##gff-version 3"]), regions, rows, spark.createDataFrame([(-(1 << 58), "# rows"), ((1 << 60), "##FASTA"), ((1 << 60) + 1, ">seq-1"), ((1 << 60) + 2, "ACGT")], "k long, value string"))


_LINE = "27 + row_number() OVER (ORDER BY row_id)"


@query(V(f"""SELECT {_LINE} AS line, seqid, program, source_type, "start"+{SHIFT} AS "start", "end"+{SHIFT} AS "end", CASE WHEN row_id % 3 = 0 THEN (row_id % 7)/2.0::DOUBLE END AS score, strand, phase, source_id, parent_id,
  program||';=,&% '||chr(9)||'|'||file AS note FROM feature"""))
def gff3_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an annotation file, with their line numbers and decoded values."""
    rows = gff3.read(spark, gff3_text(spark, sf_dir)).rows
    return rows.select(F.col("row_id").alias("line"), "seqid", "program", "source_type", "start", "end", "score", "strand", "phase", "source_id", F.get("parents", F.lit(0)).alias("parent_id"), F.array_join(scalars.all_values(F.col("attributes"), "Note"), "|").alias("note"))


@query(V("""SELECT 1 + row_number() OVER (ORDER BY substr(seqid, 5)::BIGINT) AS line, seqid, 1::BIGINT AS "start", length AS "end" FROM seqs"""))
def gff3_directives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared sequences of an annotation file."""
    return gff3.read(spark, gff3_text(spark, sf_dir)).directives


_PART = "((row_id % 101) + 101) % 101"


@query(V(f"""SELECT rule, count(*) AS n FROM (SELECT CASE {_PART} WHEN 0 THEN 'columns' WHEN 1 THEN 'number' WHEN 2 THEN 'start' WHEN 3 THEN 'inverted' WHEN 4 THEN 'strand' WHEN 5 THEN 'phase' WHEN 6 THEN 'score' WHEN 7 THEN 'attribute' END AS rule FROM feature) WHERE rule IS NOT NULL GROUP BY rule"""))
def gff3_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break the rules of the columns and of column 9, by rule."""
    m = F.pmod("row_id", F.lit(101))
    r = _rows(spark, sf_dir)
    text = lambda c: F.col(c).cast("string")
    start = F.when(m == 1, "x").when(m == 2, "0").when(m == 3, (F.col("end") + 1).cast("string")).otherwise(text("start"))
    line = [
        F.col("seqid"), F.col("program"), F.col("source_type"), start, text("end"), F.when(m == 6, "bad").otherwise("."), F.when(m == 4, "u").otherwise(F.col("strand")), F.when(m == 5, "7").otherwise(F.coalesce(text("phase"), F.lit("."))),
    ]
    nine = F.when(m == 7, "ID=x;novalue").otherwise(F.concat(F.lit("ID="), F.coalesce("source_id", F.lit("e"))))
    value = F.when(m == 0, F.concat_ws("\t", *line)).otherwise(F.concat_ws("\t", *line, nine))
    path = _put(spark, "flawed", r.select(F.col("row_id").alias("k"), value.alias("value")))
    return gff3.read(spark, path).problems.groupBy("rule").agg(F.count("*").alias("n"))


@query(V("""SELECT source_type, count(DISTINCT source_id) + count(*) FILTER (source_id IS NULL) AS features, count(*) AS n_rows, count(*) FILTER (parent_id IS NOT NULL) AS with_parent FROM feature GROUP BY source_type"""))
def gzip_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimal pass over compressed text."""
    rows = _rows(spark, sf_dir).select(F.col("row_id").alias("k"), export_rows.gff3_line().alias("value"))
    return recount.count_lines(files.lines(spark, _put(spark, "packed", rows, compression="gzip")))


@query(V("""SELECT * FROM (SELECT 'annotation' AS "case", false AS genbank, (SELECT count(*) FROM feature) + 25 + 5 AS n_lines UNION ALL SELECT 'blank lines before LOCUS', true, 3 + count(*) FROM nation UNION ALL SELECT 'LOCUS later', false, 1 + count(*) FROM nation UNION ALL SELECT 'only blank lines', false, count(*) FROM nation)"""))
def format_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat files by their first line that isn't blank, of texts made of the tables."""
    n = g.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), "n_name")
    records = n.select("k", F.concat(F.lit("LOCUS       "), "n_name", F.lit(" 5 bp")).alias("value"))
    texts = {
        "annotation": gff3_text(spark, sf_dir), "blank lines before LOCUS": _put(spark, "sniff", _heads(spark, ["", "  ", "\t "]), records), "LOCUS later": _put(spark, "sniff", _heads(spark, ["# a comment"]), records),
        "only blank lines": _put(spark, "sniff", n.select("k", F.lit("  ").alias("value"))),
    }
    out = [files.lines(spark, path).agg(F.count("*").alias("n_lines")).select(F.lit(case).alias("case"), F.lit(gff3.looks_like_genbank(spark, path)).alias("genbank"), "n_lines") for case, path in texts.items()]
    return reduce(DataFrame.unionByName, out)


_ROW = "s\t{}\tgene\t1\t2\t.\t+\t.\tID=x"

#: What the orders of a priority write in column 2, by the order's number, and a line before them.
_PRODUCERS = {
    "1-URGENT": (("RefSeq", "Gnomon", "me"), "#!processor NCBI annotwriter"), "2-HIGH": (("AUGUSTUS", "me"), "# nothing"), "3-MEDIUM": (("funannotate", "funannotate"), "##gff-version 3"), "4-NOT SPECIFIED": (("RefSeq", "AUGUSTUS"), "##gff-version 3"),
    "5-LOW": (("me", "you"), "##gff-version 3"),
}


@query("""WITH v(priority, dialect, confidence) AS (VALUES ('1-URGENT', 'refseq', 'HIGH'), ('2-HIGH', 'augustus', 'MEDIUM'), ('3-MEDIUM', 'funannotate', 'MEDIUM'), ('4-NOT SPECIFIED', 'refused', 'more than one'), ('5-LOW', 'refused', 'no dialect'))
  SELECT o_orderpriority AS "case", any_value(dialect) AS dialect, any_value(confidence) AS confidence, count(*) AS n_rows FROM orders JOIN v ON priority = o_orderpriority GROUP BY 1
  UNION ALL SELECT '5-LOW stated', 'genbank', 'HIGH', count(*) FROM orders WHERE o_orderpriority = '5-LOW' UNION ALL SELECT '4-NOT SPECIFIED exported', 'export', 'HIGH', count(*) FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'""")
def dialect_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialects by header and producers, of a text for the orders of each priority."""
    orders, out = g.read(spark, sf_dir, "orders"), []
    for priority, (names, head) in _PRODUCERS.items():
        k = F.col("o_orderkey")
        program = F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
        rows = orders.filter(F.col("o_orderpriority") == priority).select(k.cast("long").alias("k"), F.concat_ws("\t", F.lit("s"), program, F.lit("gene"), k + 1, k + 5, F.lit("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=g"), k)).alias("value"))
        cases = {"": (head, None)} | ({" stated": (head, "genbank")} if priority == "5-LOW" else {}) | ({" exported": (profiles.EXPORT_PRAGMA, None)} if priority.startswith("4") else {})
        for more, (first, stated) in cases.items():
            text = gff3.read(spark, _put(spark, "dialect", _heads(spark, [first]), rows))
            try:
                p, sure, _ = profiles.detect(text, stated)
                found = p.name, sure
            except profiles.DialectError as e:
                found = "refused", "more than one" if str(e).startswith("more") else "no dialect"
            out.append(text.rows.agg(F.count("*").alias("n_rows")).select(F.lit(priority + more).alias("case"), F.lit(found[0]).alias("dialect"), F.lit(found[1]).alias("confidence"), "n_rows"))
    return reduce(DataFrame.unionByName, out)


# -- flat files


def genbank_text(spark: SparkSession, sf_dir: str) -> str:
    """A record for each nation, with a gene and a coding record for each order."""
    genes = g.genes(spark, sf_dir).select("o_orderkey", "seqid", "strand", (F.col("start") + SHIFT).alias("lo"), (F.col("end") + SHIFT).alias("hi"))
    parts = g.parts(spark, sf_dir).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("row_id", (F.col("start") + SHIFT).alias("a"), (F.col("end") + SHIFT).alias("b")))).alias("s"))
    spans = F.transform("s", lambda x, i: F.concat(F.when((i == 0) & (F.col("o_orderkey") % 3 == 0), "<").otherwise(""), x["a"], F.lit(".."), x["b"]))
    minus = F.col("strand") == "-"
    around = lambda x: F.when(minus, F.concat(F.lit("complement("), x, F.lit(")"))).otherwise(x)
    pad = F.lit(" " * 21)
    # a line for each span
    join = F.when(F.size("s") == 1, F.array_join(spans, "")).otherwise(F.concat(F.lit("join("), F.array_join(spans, ",\n" + " " * 21), F.lit(")")))
    n = F.regexp_extract("seqid", "[0-9]+", 0).cast("long")
    gene = genes.select(n.alias("n"), "o_orderkey", F.lit(1).alias("i"), F.concat(F.rpad(F.lit("     gene"), 21, " "), around(F.concat("lo", F.lit(".."), "hi")), F.lit("\n"), pad, F.lit('/locus_tag="L_'), "o_orderkey", F.lit('"')).alias("value"))
    cds = genes.join(parts, F.col("o_orderkey") == F.col("l_orderkey")).select(
        n.alias("n"), "o_orderkey", F.lit(2).alias("i"),
        F.concat(
            F.rpad(F.lit("     CDS"), 21, " "), around(join), F.lit("\n"), pad, F.lit('/locus_tag="L_'), "o_orderkey", F.lit('"\n'), pad, F.lit("/codon_start="), (F.col("o_orderkey") % 3 + 1), F.lit("\n"),
            pad, F.lit('/product="a long-\n'), pad, F.lit('name of\n'), pad, F.lit('many words"\n'), pad, F.lit('/protein_id="P'), "o_orderkey", F.lit('.1"'),
        ).alias("value"),
    )
    s = g.sequences(spark, sf_dir)
    s = s.select(n.alias("n"), "seqid", "length", "circular")
    head = s.select("n", F.lit(-1).cast("long").alias("o_orderkey"), F.lit(0).alias("i"), F.concat(F.lit("LOCUS       "), "seqid", F.lit("  "), "length", F.when(F.col("circular"), " bp    DNA     circular BCT").otherwise(" bp    DNA     linear BCT"), F.lit("\nVERSION     "), "seqid", F.lit(".2\nFEATURES             Location/Qualifiers")).alias("value"))
    tail = s.select("n", F.lit(1 << 60).alias("o_orderkey"), F.lit(9).alias("i"), F.lit("ORIGIN\n        1 acgt\n//").alias("value"))
    rows = reduce(DataFrame.unionByName, (head, gene, cds, tail))
    return files.write_lines(rows, files.scratch(spark, "flat"), "n", "o_orderkey", "i")


_FLAT = f"""SELECT seqid||'.2' AS seqid, 'gene' AS source_type, "start"+{SHIFT} AS "start", "end"+{SHIFT} AS "end", strand, NULL::BIGINT AS phase, 'L_'||(row_id//1000) AS source_id, NULL::VARCHAR AS parent_id, NULL::VARCHAR AS product FROM gene
UNION ALL SELECT seqid||'.2', 'CDS', "start"+{SHIFT}, "end"+{SHIFT}, gene_strand, l_orderkey % 3, 'P'||l_orderkey||'.1', 'L_'||l_orderkey, 'a long-name of many words' FROM part_all"""


@query(V(_FLAT))
def genbank_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of flat files: places, phase by codon_start, names, parents by locus tag."""
    rows = genbank.read(spark, genbank_text(spark, sf_dir)).rows
    return rows.select("seqid", "source_type", "start", "end", "strand", "phase", "source_id", F.get("parents", F.lit(0)).alias("parent_id"), scalars.first_value(F.col("attributes"), "product").alias("product"))


@query(V("""SELECT 'gene' AS source_type, count(*) AS features FROM gene UNION ALL SELECT 'CDS', count(DISTINCT l_orderkey) FROM part_all"""))
def genbank_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of flat files by a count of their key lines."""
    return recount.count_genbank(files.lines(spark, genbank_text(spark, sf_dir)))


@query(V("""WITH k AS (SELECT DISTINCT seqid, l_orderkey FROM part_all) SELECT seqid||v AS seqid, 'locus_tag' AS kind, 'L_'||l_orderkey AS value FROM k, (VALUES (''), ('.2')) t(v)"""))
def flat_genes_without_mrna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes of flat files with a coding sequence and no mRNA, under both names of their record."""
    return cross_format.genes_without_mrna(files.lines(spark, genbank_text(spark, sf_dir)))


@query(V("""SELECT seqid||'.2' AS seqid, 1::BIGINT AS "start", length AS "end" FROM seqs"""))
def genbank_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of flat files: version and length."""
    return genbank.directives(spark, genbank_text(spark, sf_dir)).select("seqid", "start", "end")


# -- functional tables


def eggnog_text(spark: SparkSession, sf_dir: str) -> str:
    p = g.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    dash = lambda c, x: F.when(c, "-").otherwise(x)
    row = F.concat_ws(
        "\t", F.concat(F.lit("q"), k), dash(k % 4 == 0, F.format_string("%.1f", k % 50 + 0.5)), F.lit("1e-20"), F.concat(F.lit("OG"), k % 10, F.lit("@1,OG"), k % 7 + 20, F.lit("@2")), dash(k % 3 == 0, F.col("p_name")),
        dash(k % 5 == 0, F.when(k % 2 == 0, "KL").otherwise("S")), dash(k % 6 == 0, F.concat(F.lit("ko0001"), k % 10, F.lit(",map0001"), k % 10, F.lit(",map00500"))), dash(k % 2 == 0, F.concat(F.lit("GO:000"), k % 9 + 1000, F.lit(", GO:0009999"))),
    )
    head = _heads(spark, ["## emapper-2.1.9", "#query\tscore\tevalue\teggNOG_OGs\tDescription\tCOG_category\tKEGG_Pathway\tGOs"])
    return _put(spark, "eggnog", head, p.select(k.cast("long").alias("k"), row.alias("value")))


_EGGNOG = """p AS (SELECT p_partkey AS k, 'q'||p_partkey AS query_id, p_name FROM part),
h AS (SELECT query_id, 'eggNOG_OG' AS analysis, 'OG'||(k%10)||'@1' AS accession, CASE WHEN k%3<>0 THEN p_name END AS description, CASE WHEN k%4<>0 THEN k%50+0.5 END::DOUBLE AS score, 1e-20::DOUBLE AS evalue FROM p
 UNION ALL SELECT query_id, 'eggNOG_OG', 'OG'||(k%7+20)||'@2', CASE WHEN k%3<>0 THEN p_name END, CASE WHEN k%4<>0 THEN k%50+0.5 END, 1e-20 FROM p
 UNION ALL SELECT query_id, 'COG', unnest(CASE WHEN k%2=0 THEN ['K','L'] ELSE ['S'] END), NULL, NULL, NULL FROM p WHERE k%5<>0
 UNION ALL SELECT query_id, 'KEGG_Pathway', unnest(['ko0001'||(k%10), 'ko00500']), NULL, NULL, NULL FROM p WHERE k%6<>0
 UNION ALL SELECT query_id, 'GO', unnest(['GO:000'||(k%9+1000), 'GO:0009999']), NULL, NULL, NULL FROM p WHERE k%2<>0)"""


@query(f"""WITH {_EGGNOG} SELECT * FROM h""")
def eggnog_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of an orthology table, columns by its header."""
    hits, _ = functional_files.read_eggnog(spark, eggnog_text(spark, sf_dir))
    return hits.select("query_id", "analysis", "accession", "description", "score", "evalue")


def interpro_text(spark: SparkSession, sf_dir: str) -> str:
    p = g.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    row = F.concat_ws(
        "\t", F.concat(F.lit("q"), k), F.lit("md5"), F.lit("300"), F.lit("Pfam"), F.concat(F.lit("PF"), k % 100), F.lit("some domain"), k % 50 + 1, k % 50 + 90, F.when(k % 3 == 0, "-").when(k % 3 == 1, "1.2E-30").otherwise("55.5"), F.lit("T"), F.lit("01-01-2020"),
        F.when(k % 2 == 0, F.concat(F.lit("IPR"), k % 20)).otherwise("-"), F.when(k % 2 == 0, "entry").otherwise("-"), F.when(k % 4 == 0, F.concat(F.lit("GO:"), k % 9, F.lit("(InterPro)|GO:9"))).otherwise("-"),
    )
    return _put(spark, "interpro", p.select(k.cast("long").alias("k"), row.alias("value")))


@query("""WITH p AS (SELECT p_partkey AS k, 'q'||p_partkey AS query_id, (p_partkey%50+1)::INT AS protein_start, (p_partkey%50+90)::INT AS protein_end, CASE WHEN p_partkey%3=2 THEN 55.5::DOUBLE END AS score, CASE WHEN p_partkey%3=1 THEN 1.2e-30::DOUBLE END AS evalue FROM part)
SELECT query_id, 'Pfam' AS analysis, 'PF'||(k%100) AS accession, 'some domain' AS description, protein_start, protein_end, score, evalue FROM p UNION ALL SELECT query_id, 'InterPro', 'IPR'||(k%20), 'entry', protein_start, protein_end, score, evalue FROM p WHERE k%2=0
UNION ALL SELECT query_id, 'GO', unnest(['GO:'||(k%9), 'GO:9']), NULL, protein_start, protein_end, score, evalue FROM p WHERE k%4=0""")
def interpro_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures, entries and terms of a signature table; small scores are e-values."""
    hits, _ = functional_files.read_interproscan(spark, interpro_text(spark, sf_dir))
    return hits.select("query_id", "analysis", "accession", "description", "protein_start", "protein_end", "score", "evalue")


@query("""SELECT * FROM (VALUES ('orthology', 'eggnog'), ('signatures', 'interproscan'), ('other', 'refused')) v("case", tool)""")
def functional_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functional tables by their content."""
    out = []
    for case, path in (("orthology", eggnog_text(spark, sf_dir)), ("signatures", interpro_text(spark, sf_dir)), ("other", _put(spark, "other", _heads(spark, ["a\tb"])))):
        try:
            out.append((case, functional_files.read(spark, path)[0]))
        except ValueError:
            out.append((case, "refused"))
    return spark.createDataFrame(out, "case string, tool string")


# -- sequences, proteins, published counts


def fasta_text(spark: SparkSession, sf_dir: str) -> str:
    """A sequence for each customer, of p lines; some are empty and some names come twice."""
    c = g.read(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("long")
    name = F.when(k % 50 == 7, F.concat(F.lit("c"), k - 1)).otherwise(F.concat(F.lit("c"), k))
    body = F.when(k % 41 == 0, "").otherwise(F.concat(F.repeat(F.lit("ACGTNACGTN\n"), (k % 9).cast("int")), F.repeat(F.lit("A"), (k % 7 + 1).cast("int")), F.lit("\n")))
    return _put(spark, "sequences", c.select(k.alias("k"), F.concat(F.lit(">"), name, F.lit(" text\n"), body).alias("value")))


_FASTA = """f AS (SELECT c_custkey AS k, 'c'||CASE WHEN c_custkey % 50 = 7 THEN c_custkey - 1 ELSE c_custkey END AS seqid, (CASE WHEN c_custkey % 41 = 0 THEN 0 ELSE (c_custkey % 9) * 10 + c_custkey % 7 + 1 END)::BIGINT AS length FROM customer)"""


@query(f"""WITH {_FASTA} SELECT seqid, length, row_number() OVER (ORDER BY k) AS ordinal FROM f""")
def fasta_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and lengths of sequences, in order."""
    return fasta.read_sequences(spark, fasta_text(spark, sf_dir))[0]


@query(f"""WITH {_FASTA}, b AS (SELECT *, length(seqid) + 7 AS head, CASE WHEN k % 41 = 0 THEN 0 ELSE (k % 9) * 11 + k % 7 + 2 END AS body, CASE WHEN length = 0 THEN 0 WHEN k % 9 > 0 THEN 10 ELSE k % 7 + 1 END::BIGINT AS line_bases FROM f)
  SELECT row_number() OVER (ORDER BY k) AS ordinal, seqid, length, (coalesce(sum(head + body + 1) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + head)::BIGINT AS "offset", line_bases, CASE WHEN length = 0 THEN 0 ELSE line_bases + 1 END AS line_width, true AS even FROM b""")
def fasta_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of sequences in a file, by byte."""
    return fasta.index(spark, fasta_text(spark, sf_dir))


@query(f"""WITH {_FASTA} SELECT 'name twice' AS rule, seqid AS subject FROM f GROUP BY seqid HAVING count(*) > 1 UNION ALL SELECT 'empty sequence', seqid FROM f WHERE length = 0""")
def fasta_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that come twice and empty sequences."""
    return fasta.read_sequences(spark, fasta_text(spark, sf_dir))[1]


@query("""SELECT 'g'||c_custkey AS gene, repeat('MKVLLA', (c_custkey % 5 + 1)::INT)||repeat('W', (c_custkey % 3)::INT) AS protein FROM customer""")
def augustus_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proteins from comment blocks of several lines."""
    c = g.read(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("long")
    text = F.concat(F.lit("# start gene g"), k, F.lit("\n# protein sequence = ["), F.array_join(F.array_repeat(F.lit("MKVLLA"), (k % 5 + 1).cast("int")), "\n# "), F.lit("\n# "), F.repeat(F.lit("W"), (k % 3).cast("int")), F.lit("]\n# end gene g"), k, F.lit("\n# other text ["))
    path = _put(spark, "augustus", c.select(k.alias("k"), text.alias("value")), spark.createDataFrame([(1 << 60, _ROW.format("AUGUSTUS"))], "k long, value string"))
    return profiles.augustus_proteins(gff3.read(spark, path).comments)


# -- rules of the graph


@query(V(f"""WITH f AS (SELECT row_id, source_type, {_PART} AS m FROM graph) SELECT rule, count(*) AS n FROM (SELECT CASE WHEN m = 0 THEN 'anonymous row' WHEN m = 1 THEN 'several parents' WHEN m = 2 THEN 'unknown linkage' END AS rule FROM f) WHERE rule IS NOT NULL GROUP BY rule"""))
def graph_rule_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without ID, with several parents, or linked by a method that isn't known."""
    m = F.pmod("row_id", F.lit(101))
    r = _rows(spark, sf_dir).filter("source_id is not null")
    # every row its own feature, under a parent of its own that is no row
    name = F.when(m != 0, F.concat(F.lit("n"), F.col("row_id")))
    parents = F.when(m == 1, F.array(F.lit("p1"), F.lit("p2"))).when(m == 2, F.array(F.lit("p1"))).otherwise(F.array().cast("array<string>"))
    attributes = F.when(m == 2, F.array(F.struct(F.lit("linkage_method").alias("key"), F.array(F.lit("guess")).alias("values")))).otherwise(F.array().cast(NONE))
    rows = r.select("row_id", "seqid", "program", "source_type", "start", "end", "score", "strand", "phase", F.lit(False).alias("inverted"), attributes.alias("attributes"), name.alias("source_id"), parents.alias("parents"))
    strict = profiles.Profile("strict", (), states_parents=False, unique_ids=())
    found = normalise(rows, strict).problems.filter(F.col("rule").isin("anonymous row", "several parents", "unknown linkage"))
    return found.groupBy("rule").agg(F.count("*").alias("n"))


@query(V("""SELECT row_id, 'p_'||source_id AS source_id, 'p_'||parent_id AS parent_id FROM tr UNION ALL SELECT row_id, 'p_'||source_id, NULL FROM gene"""))
def prefixed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file's prefix before IDs and parents."""
    r = g.features(spark, sf_dir, "gene", "transcript").withColumn("parents", F.array_compact(F.array("parent_id"))).withColumn("attributes", F.array().cast(NONE)).withColumn("score", F.lit(None).cast("double")).withColumn("inverted", F.lit(False))
    return normalise(r.drop("parent_id"), profiles.PROFILES[1], id_prefix="p_").rows.select("row_id", "source_id", "parent_id")


@query("""SELECT l_orderkey, l_linenumber, b, e, CASE WHEN b>>14 = (e-1)>>14 THEN 4681+(b>>14) WHEN b>>17 = (e-1)>>17 THEN 585+(b>>17) WHEN b>>20 = (e-1)>>20 THEN 73+(b>>20) WHEN b>>23 = (e-1)>>23 THEN 9+(b>>23) WHEN b>>26 = (e-1)>>26 THEN 1+(b>>26) ELSE 0 END AS bin
FROM (SELECT l_orderkey, l_linenumber, (l_partkey*7919 % 500000000)::BIGINT AS b, (l_partkey*7919 % 500000000 + l_quantity::BIGINT*l_quantity::BIGINT*l_suppkey + 1)::BIGINT AS e FROM lineitem)""")
def tabix_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of five levels of half-open spans."""
    b = F.col("l_partkey") * 7919 % 500000000
    q = F.col("l_quantity").cast("long")
    rows = g.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", b.cast("long").alias("b"), (b + q * q * F.col("l_suppkey") + 1).cast("long").alias("e"))
    return rows.withColumn("bin", bin_of(F.col("b") + 1, F.col("e"), TABIX_DEPTH))


_TERMS = ", ".join("('{}', '{}')".format(t.replace("'", "''"), c) for t, c in sorted([*((c, c) for c in vocabulary.CANONICAL), *vocabulary.SYNONYM_OF.items()]))


@query(V(f"""WITH v(term, canonical) AS (VALUES {_TERMS}), t AS (SELECT source_type AS term, count(*) AS n FROM feature GROUP BY 1), j AS (SELECT t.term, coalesce(canonical, t.term) AS canonical, CASE WHEN canonical IS NULL THEN '' ELSE 'A' END AS tier, n FROM t LEFT JOIN v ON v.term = t.term)
  SELECT count(*) AS terms, count(DISTINCT canonical) AS canonical_terms, count(*) FILTER (tier = 'A') AS known, sha256(string_agg(term||chr(9)||canonical||chr(9)||tier||chr(9)||n, chr(10) ORDER BY term)) AS hash FROM j"""))
def vocabulary_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the vocabulary makes of the tables' types, and its hash: terms beyond it stay as they are, without a tier."""
    known = vocabulary.table(spark)
    types = g.features(spark, sf_dir).groupBy(F.col("source_type").alias("term")).agg(F.count("*").alias("n"))
    rows = types.join(known, "term", "left").select("term", F.coalesce("canonical_term", "term").alias("canonical"), F.coalesce("tier", F.lit("")).alias("tier"), "n")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("term", "canonical", "tier", "n"))), lambda x: F.concat_ws("\t", x["term"], x["canonical"], x["tier"], x["n"])), "\n")  # a row for each type
    return rows.agg(F.count("*").alias("terms"), F.count_distinct("canonical").alias("canonical_terms"), F.count_if(F.col("tier") == "A").alias("known"), F.sha2(lines, 256).alias("hash"))
