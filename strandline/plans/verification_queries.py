"""Queries for recounts, reconciliation, fidelity, census and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import census, export_rows, graph, hierarchy, reconcile, segments
from strandline.plans import graph_view as g
from strandline.plans.registry import query
from strandline.sources import recount

V = g.with_view
_STORED = """stored AS (SELECT * FROM graph WHERE NOT (source_type = 'exon' AND strand = '-' AND coalesce(phase, 0) = 1))"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.features(spark, sf_dir, "gene", "transcript", "part")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph after a fault: some rows were lost on the way."""
    return _rows(spark, sf_dir).filter("not (source_type = 'exon' and strand = '-' and coalesce(phase, 0) = 1)")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.features(spark, sf_dir).withColumn("score", F.lit(None).cast("double")).withColumn("attributes", F.array().cast("array<struct<key:string,values:array<string>>>"))
    return rows.select(export_rows.gff3_line().alias("value"))


@query(V("""SELECT source_type, count(DISTINCT source_id) + count(*) FILTER (source_id IS NULL) AS features, count(*) AS n_rows, count(*) FILTER (parent_id IS NOT NULL) AS with_parent FROM feature GROUP BY source_type"""))
def naive_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts from the exported text by a reader that shares nothing with the parser."""
    return recount.count_lines(_lines(spark, sf_dir))


@query(V(f"""WITH {_STORED}, e AS (SELECT source_type, count(DISTINCT source_id)::BIGINT AS n FROM graph GROUP BY 1), a AS (SELECT source_type, count(DISTINCT source_id)::BIGINT AS n FROM stored GROUP BY 1)
  SELECT coalesce(e.source_type, a.source_type) AS source_type, coalesce(e.n,0) AS expected, coalesce(a.n,0) AS actual, coalesce(a.n,0)-coalesce(e.n,0) AS delta FROM e FULL JOIN a USING (source_type)"""))
def source_count_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recounted against stored features, by type."""
    count = lambda df: df.groupBy("source_type").agg(segments.feature_count().alias("n"))
    return reconcile.compare_counts(count(_rows(spark, sf_dir)), count(_stored(spark, sf_dir)))


@query(V(f"""WITH {_STORED}, e AS (SELECT source_type, count(*) AS n FROM graph GROUP BY 1), a AS (SELECT source_type, count(*) AS n FROM stored GROUP BY 1),
  d AS (SELECT coalesce(e.n,0) AS e, coalesce(a.n,0) AS a FROM e FULL JOIN a USING (source_type)) SELECT CASE WHEN sum(e)=0 AND sum(a)=0 THEN 'SKIPPED' WHEN count(*) FILTER (e<>a)=0 THEN 'PASS' ELSE 'FAIL' END AS outcome,
  count(*) FILTER (e<>a) AS mismatches, sum(e)::BIGINT AS expected, sum(a)::BIGINT AS actual FROM d"""))
def row_count_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on row counts."""
    count = lambda df: df.groupBy("source_type").agg(F.count("*").alias("n"))
    return reconcile.outcome(reconcile.compare_counts(count(_rows(spark, sf_dir)), count(_stored(spark, sf_dir))))


@query(V("""SELECT linkage, count(*) AS n FROM (SELECT CASE WHEN m IS NOT NULL AND parent_id IS NOT NULL THEN m WHEN m IS NOT NULL THEN 'unlinked' WHEN parent_id IS NOT NULL THEN 'unrecorded' ELSE 'top_level' END AS linkage
  FROM (SELECT parent_id, CASE WHEN row_id % 50 = 1 THEN NULL WHEN row_id % 1001 = 0 OR parent_id IS NOT NULL THEN CASE WHEN source_type='CDS' THEN 'structural' ELSE 'explicit_parent' END END AS m FROM graph)) GROUP BY linkage"""))
def parent_edge_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How features are linked; links without a method, methods without a link."""
    by = F.when(F.col("source_type") == "CDS", "structural").otherwise("explicit_parent")
    method = F.when(F.col("row_id") % 50 != 1, F.when((F.col("row_id") % 1001 == 0) | F.col("parent_id").isNotNull(), by))
    return hierarchy.linkage_counts(_rows(spark, sf_dir).withColumn("linkage_method", method))


@query(V("""SELECT c.source_type, count(DISTINCT c.source_id) AS stated, count(DISTINCT CASE WHEN p.source_id IS NOT NULL THEN c.source_id END) AS linked FROM graph c LEFT JOIN (SELECT DISTINCT source_id FROM graph WHERE source_type <> 'repeat_region') p ON p.source_id = c.parent_id
  WHERE c.parent_id IS NOT NULL AND c.source_type IN ('CDS','exon','mRNA') GROUP BY c.source_type"""))
def stated_link_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that the file states against those that hold, by type."""
    rows = _rows(spark, sf_dir)
    named = rows.filter(F.col("parent_id").isNotNull() & F.col("source_type").isin("CDS", "exon", "mRNA"))
    p = rows.filter("source_type <> 'repeat_region'").select(F.col("source_id").alias("_p")).distinct()
    j = named.join(p, F.col("parent_id") == F.col("_p"), "left")
    return j.groupBy("source_type").agg(F.count_distinct("source_id").alias("stated"), F.count_distinct(F.when(F.col("_p").isNotNull(), F.col("source_id"))).alias("linked"))


_FAMILIES = [("a", "gene", "gene"), ("a", "pseudogene", "gene"), ("a", "repeat_region", "repeat"), ("a", "mrna", "rna"), ("b", "gene", "gene"), ("b", "repeat_region", "repeat"), ("b", "mrna", "rna"), ("b", "transcript", "rna")]


@query(V("""SELECT family, sum(a)::BIGINT AS expected, sum(b)::BIGINT AS actual, sum(b-a)::BIGINT AS delta FROM (SELECT CASE WHEN t IN ('gene','pseudogene') THEN 'gene' WHEN t = 'repeat_region' THEN 'repeat' WHEN t IN ('mrna','transcript') THEN 'rna' END AS family,
  CASE WHEN t <> 'transcript' THEN n ELSE 0 END AS a, CASE WHEN t <> 'pseudogene' THEN n ELSE 0 END AS b FROM (SELECT lower(source_type) AS t, count(DISTINCT source_id) AS n FROM graph GROUP BY 1)) WHERE family IS NOT NULL GROUP BY family"""))
def family_fold_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of two formats folded into families, each side by its own list."""
    f = spark.createDataFrame(_FAMILIES, "side string, type string, family string")
    counts = _rows(spark, sf_dir).groupBy("source_type").agg(segments.feature_count().alias("n"))
    return reconcile.compare_counts(reconcile.folded(counts, f, "a"), reconcile.folded(counts, f, "b"), "family")


_PUBLISHED = """pub AS (SELECT o_orderpriority AS feature, CASE WHEN o_orderpriority = '5-LOW' OR o_custkey % 5 = 0 THEN 'all' ELSE 'unit'||(o_custkey % 3) END AS unit, o_orderstatus AS st, o_custkey % 11 AS u, o_orderkey % 13 AS p FROM orders)"""


@query(f"""WITH {_PUBLISHED} SELECT feature, coalesce(sum(n) FILTER (unit <> 'all'), sum(n))::BIGINT AS n FROM (SELECT feature, unit, CASE WHEN u > 0 THEN u ELSE p END AS n FROM pub) GROUP BY feature""")
def published_count_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A published table: the sum of the units, or the rollup where there are none."""
    o = g.read(spark, sf_dir, "orders")
    u = F.col("o_custkey") % 11
    rows = o.select(
        F.col("o_orderpriority").alias("feature"), F.when((F.col("o_orderpriority") == "5-LOW") | (F.col("o_custkey") % 5 == 0), "all").otherwise(F.concat(F.lit("unit"), F.col("o_custkey") % 3)).alias("unit"),
        F.when(u > 0, u.cast("string")).otherwise("na").alias("unique_ids"), (F.col("o_orderkey") % 13).cast("string").alias("placements"),
    )
    return reconcile.published_counts(rows)


@query(V("""WITH c AS (SELECT source_type, count(DISTINCT source_id)::BIGINT AS n FROM graph GROUP BY 1), e AS (SELECT CASE WHEN source_type='pseudogene' THEN 'gene' ELSE source_type END AS t, sum(n)::BIGINT AS n FROM c GROUP BY 1)
  SELECT coalesce(e.t, c.source_type) AS source_type, coalesce(e.n,0) AS expected, coalesce(c.n,0) AS actual, coalesce(c.n,0)-coalesce(e.n,0) AS delta FROM e FULL JOIN c ON e.t = c.source_type"""))
def reference_fold_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published counts fold pseudogenes into genes, on their side alone."""
    counts = _rows(spark, sf_dir).groupBy("source_type").agg(segments.feature_count().alias("n"))
    folded = counts.groupBy(F.when(F.col("source_type") == "pseudogene", "gene").otherwise(F.col("source_type")).alias("source_type")).agg(F.sum("n").alias("n"))
    return reconcile.compare_counts(folded, counts)


@query(V("""WITH k AS (SELECT DISTINCT seqid, 'g'||l_orderkey AS gene, source_type AS t FROM part_all), lone AS (SELECT seqid, gene FROM k WHERE t='CDS' EXCEPT SELECT seqid, gene FROM k WHERE t='exon')
  SELECT seqid, count(DISTINCT gene) AS genes, count(DISTINCT tr.source_id) AS transcripts FROM lone JOIN tr USING (seqid) WHERE tr.parent_id = lone.gene GROUP BY seqid"""))
def mrna_set_aside(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts of genes that have coding rows but no exons: set aside in the comparison."""
    k = g.parts(spark, sf_dir).select("seqid", F.concat(F.lit("g"), "l_orderkey").alias("gene"), "source_type").distinct()
    lone = k.filter("source_type = 'CDS'").select("seqid", "gene").subtract(k.filter("source_type = 'exon'").select("seqid", "gene"))
    t = g.features(spark, sf_dir, "transcript").select(F.col("seqid").alias("_s"), "source_id", "parent_id")
    j = lone.join(t, (F.col("seqid") == F.col("_s")) & (F.col("gene") == F.col("parent_id")))
    return j.groupBy("seqid").agg(F.count_distinct("gene").alias("genes"), F.count_distinct("source_id").alias("transcripts"))


def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = segments.regroup(_rows(spark, sf_dir))
    return whole.select(F.col("source_id").alias("key"), F.col("source_type").alias("type"), "start", "end", "strand", "segments", F.col("first_row"))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth after faults: some features lost, moved, flipped, and some renamed."""
    mixed = F.col("strand") == "?"
    t = _truth(spark, sf_dir).filter(~((F.col("type") == "exon") & mixed))
    t = t.withColumn("key", F.when((F.col("type") == "five_prime_UTR") & mixed, F.concat("key", F.lit("x"))).otherwise(F.col("key")))
    t = t.withColumn("start", F.when((F.col("type") == "CDS") & mixed, F.col("start") + 1).otherwise(F.col("start")))
    return t.withColumn("strand", F.when((F.col("type") == "transcript") & (F.col("strand") == "-"), "?").otherwise(F.col("strand")))


_FID = """w AS (SELECT source_id AS key, CASE WHEN count(DISTINCT strand) > 1 THEN '?' ELSE min(strand) END AS strand, min("start") AS s, max("end") AS e,
    first(source_type ORDER BY "start","end",row_id) AS type, string_agg("start"||'-'||"end", ',' ORDER BY "start","end",row_id) AS seg, first(row_id ORDER BY "start","end",row_id) AS r FROM graph GROUP BY source_id),
  k AS (SELECT CASE WHEN type='five_prime_UTR' AND strand='?' THEN key||'x' ELSE key END AS key, CASE WHEN type='transcript' AND strand='-' THEN '?' ELSE strand END AS strand, CASE WHEN type='CDS' AND strand='?' THEN s+1 ELSE s END AS s, e, type, seg FROM w WHERE NOT (type='exon' AND strand='?')),
  j AS (SELECT coalesce(w.key,k.key) AS key, coalesce(w.type,k.type) AS type, w.key AS a, k.key AS b, concat_ws(',', CASE WHEN w.s IS DISTINCT FROM k.s THEN 'start' END, CASE WHEN w.e IS DISTINCT FROM k.e THEN 'end' END, CASE WHEN w.strand IS DISTINCT FROM k.strand THEN 'strand' END,
    CASE WHEN w.seg IS DISTINCT FROM k.seg THEN 'segments' END) AS f FROM w FULL JOIN k ON w.key = k.key),
  fid AS (SELECT key, type, CASE WHEN b IS NULL THEN 'lost' WHEN a IS NULL THEN 'extra' WHEN f = '' THEN 'kept' ELSE 'changed' END AS state, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN f ELSE '' END AS fields FROM j)"""


@query(V(f"""WITH {_FID} SELECT * FROM fid WHERE state <> 'kept'"""))
def fidelity_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between a file and what was stored of it, feature by feature."""
    return reconcile.fidelity(_truth(spark, sf_dir), _kept(spark, sf_dir), ["start", "end", "strand", "segments"]).filter("state <> 'kept'")


@query(V(f"""WITH {_FID} SELECT type, count(*) FILTER (state='kept') AS kept, count(*) FILTER (state='changed') AS changed, count(*) FILTER (state='lost') AS lost, count(*) FILTER (state='extra') AS extra FROM fid GROUP BY type"""))
def fidelity_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = reconcile.fidelity(_truth(spark, sf_dir), _kept(spark, sf_dir), ["start", "end", "strand", "segments"])
    return f.groupBy("type").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("kept", "changed", "lost", "extra")])


def _defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.features(spark, sf_dir).withColumn("excused", F.col("row_id") % 5 == 0)
    return census.defects(rows, g.sequences(spark, sf_dir))


_DEFECTS = """r AS (SELECT *, row_id % 5 = 0 AS excused FROM feature), p AS (SELECT source_id AS pid, min("start") AS lo, max("end") AS hi FROM feature WHERE source_id IS NOT NULL GROUP BY source_id),
  fo AS (SELECT *, first_value(seqid) OVER w AS s0, first_value(strand) OVER w AS d0, first_value(source_type) OVER w AS t0 FROM r WHERE source_id IS NOT NULL WINDOW w AS (PARTITION BY source_id ORDER BY row_id)),
  defect AS (SELECT row_id, seqid, 'out-of-range' AS kind, excused FROM r JOIN seqs USING (seqid) WHERE "end">length AND NOT circular OR "end">2*length
   UNION ALL SELECT row_id, seqid, 'origin-spanning', excused FROM r JOIN seqs USING (seqid) WHERE circular AND "end">length AND "end"<=2*length
   UNION ALL SELECT row_id, seqid, 'id-conflict', excused FROM fo WHERE s0<>seqid OR d0<>strand OR t0<>source_type
   UNION ALL SELECT row_id, seqid, 'escapes-parent', excused FROM r JOIN p ON pid=parent_id WHERE "start"<lo OR "end">hi
   UNION ALL SELECT row_id, seqid, 'pseudogene-gene-exon', excused FROM r WHERE source_type='exon' AND parent_id IN (SELECT source_id FROM gene WHERE source_type='pseudogene'))"""


@query(V(f"""WITH {_DEFECTS} SELECT kind, count(*) AS total, count(*) FILTER (seqid IN ('seq-3','seq-7')) AS organellar, count(*) FILTER (excused) AS excused FROM defect GROUP BY kind"""))
def defect_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural defects by kind."""
    return census.tally(_defects(spark, sf_dir), spark.createDataFrame([("seq-3",), ("seq-7",)], "seqid string"))


@query(V(f"""WITH {_DEFECTS}, c AS (SELECT row_id, CASE WHEN excused THEN 'C' WHEN kind='out-of-range' THEN 'A' WHEN kind LIKE 'escapes%' THEN 'B' ELSE 'D' END AS class FROM defect),
  m AS (SELECT row_id, max(CASE class WHEN 'A' THEN 4 WHEN 'B' THEN 3 WHEN 'D' THEN 2 ELSE 1 END) AS k FROM c GROUP BY row_id) SELECT CASE k WHEN 4 THEN 'A' WHEN 3 THEN 'B' WHEN 2 THEN 'D' ELSE 'C' END AS class, count(*) AS n FROM m GROUP BY 1"""))
def worst_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return census.worst_classes(_defects(spark, sf_dir))


@query("""WITH a AS (SELECT c_custkey AS id, c_nationkey AS n, c_mktsegment AS m FROM customer), b AS (SELECT s_suppkey AS id, s_nationkey AS n, CASE s_suppkey%2 WHEN 0 THEN 'BUILDING' ELSE 'none' END AS m FROM supplier),
  a1 AS (SELECT *, row_number() OVER (PARTITION BY n, m ORDER BY id) AS k FROM a), b1 AS (SELECT *, row_number() OVER (PARTITION BY n, m ORDER BY id) AS k FROM b), s1 AS (SELECT a1.id AS left_id, b1.id AS right_id FROM a1 JOIN b1 USING (n, m, k)),
  a2 AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY id) AS k FROM a WHERE id NOT IN (SELECT left_id FROM s1)), b2 AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY id) AS k FROM b WHERE id NOT IN (SELECT right_id FROM s1))
  SELECT left_id, right_id, 1::BIGINT AS stage FROM s1 UNION ALL SELECT a2.id, b2.id, 2 FROM a2 JOIN b2 USING (n, k)""")
def staged_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one pairs: those that agree in two columns first, then in one."""
    a = g.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"))
    b = g.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("none").alias("m"))
    return reconcile.staged_pairs(a, b, [["n", "m"], ["n"]], graph._cut)


@query("""WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus='P' THEN 'refuse' ELSE 'load' END AS v FROM orders WHERE o_orderpriority <> '5-LOW'), e AS (SELECT o_orderkey AS id, CASE WHEN o_custkey%4=0 THEN 'refuse' ELSE 'load' END AS v FROM orders WHERE o_orderpriority <> '1-URGENT')
  SELECT coalesce(c.v,'absent') AS checker, coalesce(e.v,'absent') AS engine, count(*) AS n FROM c FULL JOIN e USING (id) GROUP BY ALL""")
def agreement_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of two checkers on the same inputs."""
    o = g.read(spark, sf_dir, "orders")
    c = o.filter("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "P", "refuse").otherwise("load").alias("verdict"))
    e = o.filter("o_orderpriority <> '1-URGENT'").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 4 == 0, "refuse").otherwise("load").alias("verdict"))
    return reconcile.agreement(c, e)


@query("""WITH m AS (SELECT user_id, event_type, median(value) AS v FROM events GROUP BY ALL) SELECT event_type, round(median(v),4) AS median_of_medians, round(min(v),4) AS least, round(max(v),4) AS most, count(*) AS n FROM m GROUP BY event_type""")
def timing_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of medians, as the timing summary takes them."""
    m = g.read(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.median("value").alias("v"))
    return m.groupBy("event_type").agg(F.round(F.median("v"), 4).alias("median_of_medians"), F.round(F.min("v"), 4).alias("least"), F.round(F.max("v"), 4).alias("most"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events)
  SELECT event_type, round(median(value) FILTER (k=1),4) AS first_ask, round(median(value) FILTER (k>1),4) AS repeated FROM e GROUP BY event_type""")
def first_and_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median of the first run of each target, and of its repeats."""
    from pyspark.sql import Window

    e = g.read(spark, sf_dir, "events").withColumn("k", F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id")))
    return e.groupBy("event_type").agg(F.round(F.median(F.when(F.col("k") == 1, F.col("value"))), 4).alias("first_ask"), F.round(F.median(F.when(F.col("k") > 1, F.col("value"))), 4).alias("repeated"))


@query(V("""SELECT seqid, count(*) AS n_rows, count(DISTINCT source_id) + count(*) FILTER (source_id IS NULL) AS features, count(parent_id) AS links, count(DISTINCT source_type) AS types, count(DISTINCT file) AS files FROM feature GROUP BY seqid"""))
def footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What removing a sequence would take away."""
    return g.features(spark, sf_dir).groupBy("seqid").agg(F.count("*").alias("n_rows"), segments.feature_count().alias("features"), F.count("parent_id").alias("links"), F.count_distinct("source_type").alias("types"), F.count_distinct("file").alias("files"))


@query("""SELECT id AS source_id, count(DISTINCT file) AS files FROM (SELECT 'k'||c_custkey AS id, 'a' AS file FROM customer UNION ALL SELECT 'k'||s_suppkey*3, 'b' FROM supplier) GROUP BY id HAVING count(DISTINCT file) > 1""")
def cross_file_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDs that more than one file uses."""
    from strandline.operators.load_checks import cross_file_collisions as collisions

    a = g.read(spark, sf_dir, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("source_id"), F.lit("a").alias("file"))
    b = g.read(spark, sf_dir, "supplier").select(F.concat(F.lit("k"), F.col("s_suppkey") * 3).alias("source_id"), F.lit("b").alias("file"))
    return collisions(a.unionByName(b))


@query(V("""WITH b AS (SELECT l_orderkey AS o, sum("end" - "start" + 1)::BIGINT AS bases FROM part_all WHERE source_type = 'CDS' AND l_linestatus = 'O' GROUP BY 1),
  p AS (SELECT o_orderkey AS o, CASE WHEN o_orderkey % 5 = 0 THEN 7 ELSE greatest(coalesce(bases // 3 - 1, 3), 0) END AS residues, bases FROM orders LEFT JOIN b ON b.o = o_orderkey WHERE o_orderkey % 3 <> 1)
  SELECT 'g'||o AS gene, CASE WHEN bases IS NULL THEN 'a protein is declared and no coding row is there' WHEN bases % 3 <> 0 THEN bases||' coding bases are no whole number of codons' ELSE bases||' coding bases make '||(bases // 3 - 1)||' residues, declared are '||residues END AS problem
  FROM p WHERE bases IS NULL OR bases % 3 <> 0 OR bases // 3 - 1 <> residues"""))
def declared_protein_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes whose coding bases don't fit the protein declared of them."""
    rows = g.features(spark, sf_dir, "transcript", "part").withColumn("feature_type", F.when(F.col("source_type").isin("mRNA", "transcript"), "mRNA").otherwise(F.col("source_type")))
    bases = g.parts(spark, sf_dir).filter("source_type = 'CDS' and l_linestatus = 'O'").groupBy("l_orderkey").agg(F.sum(F.col("end") - F.col("start") + 1).alias("bases"))
    o = g.read(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 1").join(bases, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    residues = F.when(F.col("o_orderkey") % 5 == 0, 7).otherwise(F.greatest(F.coalesce(F.expr("bases div 3 - 1"), F.lit(3)), F.lit(0))).cast("int")
    proteins = o.select(F.concat(F.lit("g"), "o_orderkey").alias("gene"), F.repeat(F.lit("M"), residues).alias("protein"))
    return census.declared_proteins(rows, proteins, F.lit(False))
