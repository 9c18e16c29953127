"""Queries for facts about features, summaries and checks before a load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import records
from strandline.plans import graph_view as g
from strandline.plans.registry import query

V = g.with_view

#: Column 9 of a part, as text, in both languages.
_TEXT = """'ID='||source_id||';Dbxref=GeneID:'||l_partkey||',Other:'||l_suppkey||CASE WHEN l_partkey % 7 = 0 THEN ',GeneID:x'||l_suppkey ELSE '' END
  ||CASE l_linenumber % 4 WHEN 0 THEN ';exception=ribosomal slippage;partial=true' WHEN 1 THEN ';part=1/2' WHEN 2 THEN ';locus_tag=L_'||l_orderkey ELSE ';gene=abc,def' END
  ||CASE WHEN l_partkey % 5 = 0 THEN ';pseudo=True' WHEN l_partkey % 5 = 1 THEN ';gene_biotype=pseudogene' ELSE '' END||';Note=n'||(l_suppkey % 3)||CASE WHEN l_suppkey % 3 = 0 THEN '  ' ELSE '' END"""


def _text() -> Column:
    c, when = F.col, F.when
    bits = [
        F.lit("ID="), c("source_id"), F.lit(";Dbxref=GeneID:"), c("l_partkey"), F.lit(",Other:"), c("l_suppkey"), when(c("l_partkey") % 7 == 0, F.concat(F.lit(",GeneID:x"), "l_suppkey")).otherwise(""),
        when(c("l_linenumber") % 4 == 0, ";exception=ribosomal slippage;partial=true").when(c("l_linenumber") % 4 == 1, ";part=1/2").when(c("l_linenumber") % 4 == 2, F.concat(F.lit(";locus_tag=L_"), "l_orderkey")).otherwise(";gene=abc,def"),
        when(c("l_partkey") % 5 == 0, ";pseudo=True").when(c("l_partkey") % 5 == 1, ";gene_biotype=pseudogene").otherwise(""), F.lit(";Note=n"), (c("l_suppkey") % 3), when(c("l_suppkey") % 3 == 0, "  ").otherwise(""),
    ]
    return F.concat(*bits)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # parse_attributes trims a chunk; the text keeps the last value's blanks by an escape
    return g.parts(spark, sf_dir).withColumn("attributes", scalars.parse_attributes(F.regexp_replace(_text(), " +$", "%20%20")))


@query(V("""SELECT row_id, 'GeneID' AS kind, l_partkey::VARCHAR AS value FROM part_all UNION ALL SELECT row_id, 'GeneID', 'x'||l_suppkey FROM part_all WHERE l_partkey % 7 = 0
  UNION ALL SELECT row_id, 'locus_tag', 'L_'||l_orderkey FROM part_all WHERE l_linenumber % 4 = 2 UNION ALL SELECT row_id, 'gene', unnest(['abc','def']) FROM part_all WHERE l_linenumber % 4 = 3"""))
def gene_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names a gene, from cross-references, locus tags and symbols."""
    return _parts(spark, sf_dir).select("row_id", F.explode(records.gene_keys(F.col("attributes"))).alias("k")).select("row_id", "k.kind", "k.value")


@query(V("""SELECT row_id, CASE l_linenumber % 4 WHEN 0 THEN 'exception=ribosomal slippage|partial=true' WHEN 1 THEN 'part=1/2' ELSE '' END AS excuses, l_partkey % 5 < 2 AS pseudo FROM part_all"""))
def excuse_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that excuse a defect, and pseudogenes."""
    return _parts(spark, sf_dir).select("row_id", F.array_join(records.excuses(F.col("attributes")), "|").alias("excuses"), records.is_pseudo(F.col("attributes")).alias("pseudo"))


@query(V("""SELECT row_id, 'n'||(l_suppkey % 3) AS note FROM part_all"""))
def trailing_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last value of column 9 without trailing blanks."""
    return _parts(spark, sf_dir).select("row_id", scalars.first_value(records.without_trailing_space(F.col("attributes")), "Note").alias("note"))


@query(V("""SELECT row_id, l_partkey % 3 = 0 AS low, l_suppkey % 2 = 0 AS high FROM part_all"""))
def partial_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open sides of feature-table locations."""
    p = g.parts(spark, sf_dir)
    location = F.concat(F.when(F.col("strand") == "-", "complement(").otherwise(""), F.when(F.col("l_partkey") % 3 == 0, "<").otherwise(""), "start", F.lit(".."), F.when(F.col("l_suppkey") % 2 == 0, ">").otherwise(""), "end", F.when(F.col("strand") == "-", ")").otherwise(""))
    return p.select("row_id", records.partial_ends(location).alias("p")).select("row_id", "p.*")


@query(V("""WITH d AS (SELECT source_id, "start", "end", sha1('Name'||chr(31)||'n'||CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_linenumber END) AS d FROM part_all)
SELECT source_id, CASE WHEN count(DISTINCT d) = 1 THEN min(d) ELSE 'rows:'||sha1(string_agg("start"||chr(9)||"end"||chr(9)||d, chr(10) ORDER BY "start"||chr(9)||"end"||chr(9)||d)) END AS digest FROM d GROUP BY source_id"""))
def feature_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest for each feature; of all its rows where they disagree."""
    text = F.concat(F.lit("ID="), "source_id", F.lit(";Name=n"), F.when(F.col("l_orderkey") % 2 == 0, 0).otherwise(F.col("l_linenumber")))
    return records.feature_digests(g.parts(spark, sf_dir).withColumn("attributes", scalars.parse_attributes(text)))


_NAMED = """named AS (SELECT row_id, seqid, CASE WHEN seqid < 'seq-2' THEN 'mRNA:' WHEN seqid < 'seq-5' THEN 'mRNA-' WHEN row_id % 2000 = 0 THEN 'mRNA:' ELSE '' END||source_id AS name FROM gene)"""


@query(V(f"""WITH {_NAMED} SELECT row_id, CASE WHEN bool_and(starts_with(name, 'mRNA:')) OVER w OR bool_and(starts_with(name, 'mRNA-')) OVER w THEN substr(name, 6) ELSE name END AS name FROM named WINDOW w AS (PARTITION BY seqid)"""))
def names_without_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A type's prefix is taken off names where all names of a sequence have it."""
    mark = F.when(F.col("seqid") < "seq-2", "mRNA:").when(F.col("seqid") < "seq-5", "mRNA-").when(F.col("row_id") % 2000 == 0, "mRNA:").otherwise("")
    rows = g.features(spark, sf_dir, "gene").select("row_id", "seqid", F.concat(mark, "source_id").alias("name"))
    return records.drop_prefix(rows, "name", "mRNA", ["seqid"]).select("row_id", "name")


@query("""SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_seen FROM orders""")
def first_seen_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each value first occurs."""
    return records.first_seen(g.read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "first_seen")


@query(V("""SELECT source_type, n, row_number() OVER (ORDER BY n DESC, source_type) AS place FROM (SELECT source_type, count(*) AS n FROM feature GROUP BY 1)"""))
def counts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types by their counts, the most frequent first."""
    from pyspark.sql import Window

    counts = g.features(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "source_type")).cast("long"))  # a row for each type


@query(V("""SELECT source_type FROM gene WHERE seqid IN ('seq-1','seq-2') INTERSECT SELECT source_type FROM feature WHERE "start" > 1000"""))
def types_in_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that two selections have in common."""
    genes = g.features(spark, sf_dir, "gene").filter(F.col("seqid").isin("seq-1", "seq-2")).select("source_type")
    return genes.intersect(g.features(spark, sf_dir).filter("start > 1000").select("source_type"))


_ORPHAN = """held AS (SELECT DISTINCT parent_id FROM part_rows WHERE source_type IN ('CDS', 'exon')), own AS (SELECT source_id FROM gene WHERE source_type = 'gene' AND source_id IN (SELECT parent_id FROM held)),
known AS (SELECT source_id FROM tr UNION SELECT source_id FROM own)"""


@query(V(f"""WITH {_ORPHAN} SELECT source_type, count(*) AS n FROM (SELECT DISTINCT source_id, source_type, parent_id FROM part_rows WHERE source_type IN ('CDS', 'exon')) WHERE parent_id NOT IN (SELECT source_id FROM known) GROUP BY 1"""))
def orphan_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts under no transcript."""
    return records.orphan_parts(g.features(spark, sf_dir, "gene", "transcript", "part"), ["gene"], ["mRNA", "transcript"], ["CDS", "exon"])[0]


@query(V(f"""WITH {_ORPHAN} SELECT source_id FROM own"""))
def genes_as_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes whose parts hang right under them."""
    return records.orphan_parts(g.features(spark, sf_dir, "gene", "transcript", "part"), ["gene"], ["mRNA", "transcript"], ["CDS", "exon"])[1]


@query(V("""SELECT source_id, string_agg(DISTINCT strand, ',' ORDER BY strand) AS strands, coalesce(string_agg(DISTINCT parent_id, ',' ORDER BY parent_id), '') AS parents FROM graph GROUP BY source_id"""))
def merged_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct strands and parents of each feature, as text."""
    return records.merged_sets(g.features(spark, sf_dir, "gene", "transcript", "part"))


def _sequence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = g.read(spark, sf_dir, "nation")
    text = F.concat(F.lit("ID=r"), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, ";Is_circular=True").otherwise(""), F.when(F.col("n_nationkey") % 5 == 3, ";genome=Mitochondrion").when(F.col("n_nationkey") % 5 == 1, ";genome=chromosome").otherwise(""))
    return n.select(F.col("n_nationkey").cast("long").alias("row_id"), F.concat(F.lit("seq-"), "n_nationkey").alias("seqid"), F.lit("region").alias("source_type"), scalars.parse_attributes(text).alias("attributes"))


_FACTS = """facts AS (SELECT 'seq-'||n_nationkey AS seqid, n_nationkey % 2 = 0 AS circular, CASE n_nationkey % 5 WHEN 3 THEN 'mitochondrion' WHEN 1 THEN 'chromosome' ELSE 'nuclear' END AS genome FROM nation)"""


@query(f"""WITH {_FACTS} SELECT * FROM facts""")
def sequence_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circular sequences and molecules, from the region rows."""
    return records.sequence_facts(_sequence_rows(spark, sf_dir))


@query(V(f"""WITH {_FACTS}, m AS (SELECT source_id, count(DISTINCT parent_id) AS p FROM feature WHERE source_id IS NOT NULL GROUP BY 1)
SELECT 'rows' AS fact, count(*) AS n FROM feature UNION ALL SELECT 'features', (SELECT count(*) FROM m) + (SELECT count(*) FROM ev) UNION ALL SELECT 'parent_links', sum(p)::BIGINT FROM m UNION ALL SELECT 'features_with_parent', count(*) FROM m WHERE p > 0
UNION ALL SELECT 'sequences', count(*) FROM facts UNION ALL SELECT 'circular_sequences', count(*) FROM facts WHERE circular UNION ALL SELECT 'organelle_sequences', count(*) FROM facts WHERE genome = 'mitochondrion'"""))
def truth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader that follows the specification alone counts."""
    return records.truth_summary(g.features(spark, sf_dir), records.sequence_facts(_sequence_rows(spark, sf_dir)))


@query(V("""SELECT source_id, (CASE WHEN parents = '' THEN 0 ELSE len(string_split(parents, ',')) END)::BIGINT AS links FROM (SELECT source_id, coalesce(string_agg(DISTINCT parent_id, ',' ORDER BY parent_id), '') AS parents FROM graph GROUP BY source_id)"""))
def parent_list_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many parents the joined list of a feature names."""
    return records.merged_sets(g.features(spark, sf_dir, "gene", "transcript", "part")).select("source_id", records.parent_links(F.col("parents")).alias("links"))


@query(V("""WITH t AS (SELECT source_type, count(*) AS n FROM feature GROUP BY 1) SELECT source_type, n % 3 <> 0 AS announced FROM t"""))
def announced_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that a program's messages say were left out; it has a message for each type of the tables."""
    types = g.features(spark, sf_dir).groupBy("source_type").agg(F.count("*").alias("n"))
    n, t = F.col("n") % 3, F.col("source_type")
    line = F.when(n == 0, F.concat(F.lit("loaded "), "n", F.lit(" "), t)).when(n == 1, F.concat(F.lit("Skipping "), t, F.lit(" rows"))).otherwise(F.concat("n", F.lit(" rows: type "), t, F.lit(" is UNKNOWN")))
    log = types.select(line.alias("line")).unionByName(types.filter(n == 0).select(F.concat(F.lit("ignored: "), t, F.lit("s, x"), t).alias("line")))
    return records.announced(types.select("source_type"), log)


@query("""SELECT s_name AS path FROM (SELECT 'a_b%/'||s_name AS s_name FROM supplier WHERE s_suppkey % 3 = 0)""")
def paths_under_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths under a folder whose name has characters that patterns reserve."""
    folder = F.when(F.col("s_suppkey") % 3 == 0, "a_b%/").when(F.col("s_suppkey") % 3 == 1, "axbyz/").otherwise("a_b%c/")
    return records.under_folder(g.read(spark, sf_dir, "supplier").select(F.concat(folder, "s_name").alias("path")), "path", "a_b%")


@query("""SELECT p_partkey FROM part ORDER BY md5('7:'||p_partkey), p_partkey LIMIT 25""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of 25 that follows from its seed; the limit is what is asked for."""
    return records.seeded_sample(g.read(spark, sf_dir, "part").select("p_partkey"), "p_partkey", "7", 25)


_FLAWED = """flawed AS (SELECT row_id, seqid, source_type, CASE WHEN row_id % 997 = 0 THEN 'x' ELSE (CASE WHEN row_id % 991 = 0 THEN "end" + 5 ELSE "start" END)::VARCHAR END AS s, "end"::VARCHAR AS e,
  CASE WHEN row_id % 983 = 0 THEN 'u' ELSE strand END AS strand, source_id, parent_id FROM graph), good AS (SELECT *, s::BIGINT AS lo, e::BIGINT AS hi FROM flawed WHERE s <> 'x'),
  span AS (SELECT source_id AS p, min(lo) AS plo, max(hi) AS phi FROM good WHERE source_id IS NOT NULL GROUP BY 1)"""


@query(V(f"""WITH {_FLAWED} SELECT row_id, 'coordinate' AS kind, s||'..'||e AS detail FROM flawed WHERE s = 'x' UNION ALL SELECT row_id, 'inverted', lo||'..'||hi FROM good WHERE lo > hi UNION ALL SELECT row_id, 'strand', strand FROM good WHERE strand = 'u'
UNION ALL SELECT row_id, 'out-of-range', lo||'..'||hi FROM good JOIN seqs USING (seqid) WHERE lo > length OR hi > length UNION ALL SELECT row_id, 'escapes-parent', lo||'..'||hi||' outside '||p||' '||plo||'..'||phi FROM good JOIN span ON p = parent_id WHERE lo < plo OR hi > phi"""))
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural problems of a file before it is loaded."""
    rows = g.features(spark, sf_dir, "gene", "transcript", "part")
    start = F.when(F.col("row_id") % 997 == 0, "x").otherwise(F.when(F.col("row_id") % 991 == 0, F.col("end") + 5).otherwise(F.col("start")).cast("string"))
    rows = rows.withColumn("start", start).withColumn("end", F.col("end").cast("string")).withColumn("strand", F.when(F.col("row_id") % 983 == 0, "u").otherwise(F.col("strand")))
    return records.preflight(rows, g.sequences(spark, sf_dir))


@query("""WITH c AS (SELECT o_orderpriority AS subject, count(*) FILTER (o_orderstatus = 'F') AS part, count(*) AS whole FROM orders GROUP BY 1)
SELECT subject, format('{:,}', part)||' of '||format('{:,}', whole)||' ('||printf('%.1f', floor(part * 1000 / whole + 0.5) / 10)||'%)' AS text FROM c""")
def percent_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts as a report shows them."""
    c = g.read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("subject")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("part"), F.count("*").alias("whole"))
    return c.select("subject", records.percent_text(F.col("part"), F.col("whole")).alias("text"))


@query(r"""WITH t AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_partkey::VARCHAR WHEN 2 THEN ' '||l_partkey||' ' WHEN 3 THEN l_partkey||'.0' WHEN 4 THEN '-' WHEN 5 THEN '+'||l_partkey WHEN 6 THEN '1e3' ELSE 'x' END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, v, CASE WHEN l_linenumber IN (1, 2, 5) THEN trim(v)::BIGINT END AS whole, CASE WHEN l_linenumber IN (1, 2, 3, 5) THEN trim(v)::DOUBLE WHEN l_linenumber = 6 THEN 1000.0 END AS number FROM t""")
def strict_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers only where nothing but digits and a sign stand; other numbers where they parse."""
    part = F.col("l_partkey").cast("string")
    n = F.col("l_linenumber")
    v = F.when(n == 1, part).when(n == 2, F.concat(F.lit(" "), part, F.lit(" "))).when(n == 3, F.concat(part, F.lit(".0"))).when(n == 4, "-").when(n == 5, F.concat(F.lit("+"), part)).when(n == 6, "1e3").otherwise("x")
    return g.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"), scalars.strict_int(v).alias("whole"), scalars.number(v).alias("number"))
