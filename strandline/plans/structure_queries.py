"""Queries for counts, segments, hierarchy rules and envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import vocabulary
from strandline.operators import envelope, hierarchy, intervals, segments
from strandline.plans import graph_view as g
from strandline.plans.registry import query

V = g.with_view
_CANON = g.canonical_sql("source_type")
_ORDER = 'ORDER BY "start", "end", row_id'


@query(V("""SELECT source_type, count(DISTINCT source_id) + count(*) FILTER (source_id IS NULL) AS features FROM feature GROUP BY source_type"""))
def feature_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.features(spark, sf_dir).groupBy("source_type").agg(segments.feature_count().alias("features"))


@query(V("""SELECT file, count(*) AS n_rows, count(DISTINCT source_id) + count(*) FILTER (source_id IS NULL) AS features FROM feature GROUP BY file"""))
def row_counts_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.features(spark, sf_dir).groupBy("file").agg(F.count("*").alias("n_rows"), segments.feature_count().alias("features"))


@query("""SELECT r_name AS organism, n_name AS assembly, count(s_suppkey) AS sequences, coalesce(sum(floor(s_acctbal)::BIGINT),0)::BIGINT AS bases
  FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL""")
def assembly_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences and bases of each assembly, also of those without sequences."""
    r, n, s = (g.read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    rows = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.col("r_name").alias("organism"), F.col("n_name").alias("assembly")).agg(F.count("s_suppkey").alias("sequences"), F.coalesce(F.sum(F.floor("s_acctbal")), F.lit(0)).alias("bases"))


@query(V(f"""SELECT row_id, CASE WHEN source_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY source_id {_ORDER}) - 1 END AS segment_index FROM feature"""))
def segment_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.with_segment_index(g.features(spark, sf_dir)).select("row_id", "segment_index")


@query(V(f"""SELECT row_id, shared, CASE WHEN phase IS DISTINCT FROM shared THEN phase END AS own FROM (
  SELECT row_id, phase, CASE WHEN source_id IS NULL THEN phase ELSE first_value(phase) OVER (PARTITION BY source_id {_ORDER}) END AS shared FROM part_rows)"""))
def first_segment_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature's value is that of its first row; other rows keep theirs only where it differs."""
    return segments.attributes_by_segment(g.features(spark, sf_dir, "part"), "phase").select("row_id", "shared", "own")


@query(V("""SELECT a.source_id, a.row_id AS row_a, b.row_id AS row_b FROM part_rows a JOIN part_rows b ON a.source_id = b.source_id
  AND (a."start" < b."start" OR a."start" = b."start" AND (a."end" < b."end" OR a."end" = b."end" AND a.row_id < b.row_id)) AND a."end" >= b."start" """))
def segment_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.overlapping_segments(g.features(spark, sf_dir, "part"))


@query(V("""SELECT a.source_id, a.row_id AS row_a, b.row_id AS row_b FROM part_rows a JOIN part_rows b ON a.source_id = b.source_id
  AND (a."start" < b."start" OR a."start" = b."start" AND (a."end" < b."end" OR a."end" = b."end" AND a.row_id < b.row_id)) AND a."end" >= b."start" AND a.strand = b.strand"""))
def segment_overlap_same_strand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlaps, but for rows on opposite strands."""
    return segments.overlapping_segments(g.features(spark, sf_dir, "part"), F.col("a.strand") != F.col("b.strand"))


@query(V("""SELECT source_id, count(*) AS n FROM part_rows WHERE source_type = 'exon' GROUP BY source_id HAVING count(*) > 1 AND NOT bool_and(strand = '+')"""))
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exon IDs that several rows share, unless all rows are marked (here: lie forward)."""
    return segments.repeated_ids(g.features(spark, sf_dir), ["exon"], F.col("strand") == "+")


@query(V("""SELECT * FROM (SELECT source_id, row_id, concat_ws(',', CASE WHEN seqid IS DISTINCT FROM s THEN 'seqid' END, CASE WHEN source_type IS DISTINCT FROM t THEN 'source_type' END,
    CASE WHEN strand IS DISTINCT FROM d THEN 'strand' END, CASE WHEN parent_id IS DISTINCT FROM p THEN 'parent_id' END) AS fields
  FROM (SELECT *, first_value(seqid) OVER w AS s, first_value(source_type) OVER w AS t, first_value(strand) OVER w AS d, first_value(parent_id) OVER w AS p
    FROM graph WINDOW w AS (PARTITION BY source_id ORDER BY row_id))) WHERE fields <> ''"""))
def same_feature_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segments.mismatched_rows(g.features(spark, sf_dir, "gene", "transcript", "part"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.features(spark, sf_dir, "gene", "transcript", "part")
    return rows.withColumn("feature_type", vocabulary.canonical(F.col("source_type")))


@query(V("""SELECT source_type, count(DISTINCT source_id) AS features, count(*) AS n_rows FROM graph c WHERE parent_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM graph p WHERE p.source_id = c.parent_id AND p.source_type <> 'repeat_region') AND (source_type <> 'repeat_region') GROUP BY source_type"""))
def dangling_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features whose parent is not in the file: here a file without repeat regions."""
    rows = hierarchy.dangling(_graph(spark, sf_dir).filter("source_type <> 'repeat_region'"))
    return rows.groupBy("source_type").agg(F.count_distinct("source_id").alias("features"), F.count("*").alias("n_rows"))


@query(V("""SELECT source_id, source_type FROM gene WHERE source_type IN ('gene','pseudogene') AND source_id NOT IN (SELECT parent_id FROM graph WHERE parent_id IS NOT NULL)"""))
def childless_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.childless(_graph(spark, sf_dir), ["gene", "pseudogene"]).select("source_id", "source_type")


@query(V("""SELECT parent_id, count(DISTINCT source_id) AS n_children, string_agg(DISTINCT source_id, ',' ORDER BY source_id) AS children FROM graph WHERE parent_id IS NOT NULL GROUP BY parent_id"""))
def children_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.children_index(_graph(spark, sf_dir))


@query(V(f"""SELECT DISTINCT c.source_id, {_CANON.replace('source_type', 'c.source_type')} AS feature_type, c.parent_id, {_CANON.replace('source_type', 'p.source_type')} AS parent_type
  FROM graph c JOIN (SELECT DISTINCT source_id, source_type FROM graph) p ON p.source_id = c.parent_id
  WHERE p.source_type NOT IN ('gene','pseudogene') AND NOT (c.source_type IN ('CDS','exon','five_prime_UTR') AND p.source_type IN ('mRNA','transcript'))"""))
def allowed_parent_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.forbidden_parents(_graph(spark, sf_dir))


@query(V("""SELECT DISTINCT source_id, source_type AS feature_type, parent_id FROM part_rows c WHERE source_type IN ('CDS','exon')
  AND parent_id IN (SELECT source_id FROM gene WHERE source_type IN ('gene','pseudogene')) AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.parent_id = c.parent_id)
  AND seqid NOT IN ('seq-3','seq-7')"""))
def transcript_bypass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CDS and exons right under genes without transcripts; two sequences are organelles."""
    n = g.read(spark, sf_dir, "nation").select(F.concat(F.lit("seq-"), "n_nationkey").alias("seqid"), F.when(F.col("n_nationkey").isin(3, 7), "Mitochondrion").otherwise("genomic").alias("genome"))
    return hierarchy.transcript_bypass(_graph(spark, sf_dir), hierarchy.organellar_sequences(n))


@query(V("""WITH m AS (SELECT row_id, source_id, parent_id, CASE WHEN source_id LIKE 't%' AND row_id//1000 % 59 = 0 THEN 'elsewhere' ELSE seqid END AS seqid FROM graph)
  SELECT c.row_id, c.source_id FROM m c JOIN (SELECT DISTINCT source_id, seqid FROM m WHERE source_id[1:1] IN ('g', 't')) p ON p.source_id = c.parent_id WHERE c.seqid <> p.seqid"""))
def off_sequence_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children on another sequence than their parent, where some transcripts are moved to one."""
    moved = F.startswith("source_id", F.lit("t")) & (F.expr("row_id div 1000") % 59 == 0)
    rows = _graph(spark, sf_dir).withColumn("seqid", F.when(moved, "elsewhere").otherwise(F.col("seqid")))
    return hierarchy.off_sequence(rows).select("row_id", "source_id")


_ENV = """env AS (SELECT source_id AS id, min(parent_id) AS parent_id, min("start") AS "start", max("end") AS "end", count(*) AS n_segments FROM graph GROUP BY source_id)"""


@query(V(f"""WITH {_ENV} SELECT c.id, c.parent_id, c."start", c."end", p."start" AS parent_start, p."end" AS parent_end FROM env c JOIN env p ON p.id = c.parent_id
  WHERE c."start" < p."start" OR c."end" > p."end" """))
def envelope_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return envelope.violations(envelope.envelopes(_graph(spark, sf_dir)))


@query(V(f"""WITH {_ENV},
  k1 AS (SELECT parent_id AS pid, min("start") AS lo, max("end") AS hi FROM env WHERE id LIKE 'c%' GROUP BY parent_id),
  t AS (SELECT id, parent_id, least("start", coalesce(lo,"start")) AS "start", greatest("end", coalesce(hi,"end")) AS "end", "start" AS old_start, "end" AS old_end FROM env LEFT JOIN k1 ON pid = id WHERE id LIKE 't%'),
  k2 AS (SELECT parent_id AS pid, min("start") AS lo, max("end") AS hi FROM (SELECT parent_id, "start", "end" FROM t UNION ALL SELECT parent_id, "start", "end" FROM env WHERE id LIKE 'c%') GROUP BY parent_id)
  SELECT id, "start", "end", old_start, old_end FROM t WHERE ("start","end") <> (old_start,old_end) UNION ALL
  SELECT id, least("start", lo), greatest("end", hi), "start", "end" FROM env JOIN k2 ON pid = id WHERE id LIKE 'g%' AND (lo < "start" OR hi > "end")"""))
def envelope_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the bottom-up repair changes."""
    fixed = envelope.repair(envelope.envelopes(_graph(spark, sf_dir)))
    return fixed.filter("start <> old_start or end <> old_end").select("id", "start", "end", "old_start", "old_end")


@query(V("""SELECT source_id, min(parent_id) AS parent_id, CASE WHEN count(DISTINCT strand) > 1 THEN '?' ELSE min(strand) END AS strand, min("start") AS "start", max("end") AS "end", count(*) AS n_segments,
   string_agg("start"||'-'||"end", ',' ORDER BY "start", "end", row_id) AS segments FROM feature WHERE source_id IS NOT NULL GROUP BY source_id
   UNION ALL SELECT source_id, parent_id, strand, "start", "end", 1, "start"||'-'||"end" FROM feature WHERE source_id IS NULL"""))
def whole_feature_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with all their rows."""
    return segments.regroup(g.features(spark, sf_dir)).select("source_id", "parent_id", "strand", "start", "end", "n_segments", "segments")


@query(V("""SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN "end" <= length THEN 'ok' WHEN circular AND "start" <= length AND "end" <= 2*length THEN 'crosses_origin'
  WHEN circular AND "start" > length AND "end" <= 2*length THEN 'wrapped' ELSE 'refused' END AS outcome FROM feature JOIN seqs USING (seqid)) GROUP BY outcome"""))
def bounds_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows within their sequence: four outcomes."""
    rows = g.features(spark, sf_dir).join(g.sequences(spark, sf_dir), "seqid")
    kind = intervals.bounds_outcome(F.col("start"), F.col("end"), F.col("length"), F.col("circular"))
    return rows.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


@query(V("""SELECT DISTINCT source_type FROM feature WHERE source_type NOT IN ('gene','mRNA','exon','CDS','tRNA','click')"""))
def unexpected_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of a file that its profile doesn't declare."""
    declared = spark.createDataFrame([(t,) for t in ("gene", "mRNA", "exon", "CDS", "tRNA", "click")], "source_type string")
    return g.features(spark, sf_dir).select("source_type").exceptAll(declared.limit(0)).distinct().join(declared, "source_type", "left_anti")


@query(V("""SELECT unnest(['gene','mRNA','exon','CDS','tRNA']) AS source_type EXCEPT SELECT source_type FROM feature"""))
def missing_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that a profile declares and the file lacks."""
    declared = spark.createDataFrame([(t,) for t in ("gene", "mRNA", "exon", "CDS", "tRNA")], "source_type string")
    return declared.subtract(g.features(spark, sf_dir).select("source_type"))


@query(V("""WITH coding AS (SELECT parent_id AS transcript, sum("end" - "start" + 1)::BIGINT AS bases FROM part_rows WHERE source_type = 'CDS' AND parent_id LIKE 't%' GROUP BY parent_id)
   SELECT transcript, bases, bases // 3 - 1 AS residues, l AS declared FROM (SELECT *, (substr(transcript,2)::BIGINT % 700) + 300 AS l FROM coding) WHERE bases // 3 - 1 <> l"""))
def coding_length_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts whose coding bases don't give the declared length of their protein."""
    from strandline.operators.census import protein_length_mismatches

    parts = g.features(spark, sf_dir, "part").filter(F.startswith("parent_id", F.lit("t")))
    declared = g.features(spark, sf_dir, "transcript").select(F.col("source_id").alias("transcript"), (F.substr("source_id", F.lit(2)).cast("long") % 700 + 300).alias("declared"))
    return protein_length_mismatches(parts, declared)
