"""A feature graph derived from the star-schema tables, and its SQL twin.

Orders are genes, pseudogenes and repeat regions; the lineitems of an order with
status O make its transcript; lineitems are the rows of CDS, exons and UTRs under
the transcript, or under the gene where their status is F; events are features without
an ID.  Positions are integers, so all results compare exactly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.sources import files

SHARE = 8 << 20  # bytes of a table's files for each task that brings its rows together
COLUMNS = ["row_id", "seqid", "source_id", "source_type", "start", "end", "strand", "phase", "parent_id", "program", "file"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table dealt by a key: a larger one to more tasks, whatever number of them a shuffle
    has, so that what one task holds doesn't grow."""
    shares, rows = files.held(spark, f"{sf_dir}/{name}.parquet") // SHARE, read(spark, sf_dir, name)
    return rows.repartition(shares, key) if shares > spark.sparkContext.defaultParallelism else rows


def _days(date) -> F.Column:
    return F.datediff(date, F.lit("1995-01-01").cast("date")).cast("long")


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    start = _days(F.col("o_orderdate")) * 100 + 1
    return rows.select(
        (F.col("o_orderkey") * 1000).alias("row_id"),
        F.concat(F.lit("seq-"), "c_nationkey").alias("seqid"),
        F.concat(F.lit("g"), "o_orderkey").alias("source_id"),
        F.when(F.col("o_orderstatus") == "F", "gene").when(F.col("o_orderstatus") == "O", "pseudogene").otherwise("repeat_region").alias("source_type"),
        start.alias("start"),
        (start + 5999).alias("end"),
        F.when(F.col("o_custkey") % 2 == 0, "+").otherwise("-").alias("strand"),
        F.lit(None).cast("long").alias("phase"),
        F.lit(None).cast("string").alias("parent_id"),
        F.col("o_orderpriority").alias("program"),
        F.lit("orders").alias("file"),
        "o_orderkey",
    )


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lineitem on their order's sequence, with the lineitem columns that queries use."""
    place = genes(spark, sf_dir).select("o_orderkey", "seqid", "strand")
    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    line = dealt(spark, sf_dir, "lineitem", "l_orderkey").withColumn("k", k)
    start = _days(F.col("l_shipdate")) * 100 + F.col("l_linenumber")
    rows = line.join(place, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        (F.col("l_orderkey") * 1000 + 200 + F.col("k")).alias("row_id"),
        "seqid",
        F.concat(F.lit("c"), "l_orderkey", "l_linestatus", "l_returnflag").alias("source_id"),
        F.when(F.col("l_returnflag") == "A", "CDS").when(F.col("l_returnflag") == "R", "exon").otherwise("five_prime_UTR").alias("source_type"),
        start.alias("start"),
        (start + F.col("l_quantity").cast("long") * 40).alias("end"),
        F.when(F.col("l_discount") >= 0.095, F.translate("strand", "+-", "-+")).otherwise(F.col("strand")).alias("strand"),
        (F.col("l_linenumber") % 3).cast("long").alias("phase"),
        F.concat(F.when(F.col("l_linestatus") == "O", "t").otherwise("g"), F.col("l_orderkey")).alias("parent_id"),
        F.lit("lineitem").alias("program"),
        F.lit("lineitem").alias("file"),
        "l_orderkey", "l_linestatus", "l_partkey", "l_suppkey", "l_linenumber", F.col("strand").alias("gene_strand"),
    )


def features(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """All rows, or those of the kinds named: gene, transcript, part, event."""
    kinds = kinds or ("gene", "transcript", "part", "event")
    out = []
    if "gene" in kinds:
        out.append(genes(spark, sf_dir).select(COLUMNS))
    if "part" in kinds or "transcript" in kinds:
        p = parts(spark, sf_dir)
        if "transcript" in kinds:
            t = p.filter(F.col("l_linestatus") == "O").groupBy("l_orderkey", "seqid", "gene_strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))
            t = t.select(
                (F.col("l_orderkey") * 1000 + 100).alias("row_id"),
                "seqid",
                F.concat(F.lit("t"), "l_orderkey").alias("source_id"),
                F.when(F.col("l_orderkey") % 3 == 0, "transcript").otherwise("mRNA").alias("source_type"),
                "start",
                "end",
                F.col("gene_strand").alias("strand"),
                F.lit(None).cast("long").alias("phase"),
                F.concat(F.lit("g"), "l_orderkey").alias("parent_id"),
                F.lit("lineitem").alias("program"),
                F.lit("lineitem").alias("file"),
            )
            out.append(t)
        if "part" in kinds:
            out.append(p.select(COLUMNS))
    if "event" in kinds:
        e, start = read(spark, sf_dir, "events"), F.col("event_id") * 7 + 1
        out.append(
            e.select(
                (-F.col("event_id") - 1).alias("row_id"), F.concat(F.lit("seq-"), F.col("user_id") % 25).alias("seqid"), F.lit(None).cast("string").alias("source_id"), F.col("event_type").alias("source_type"),
                start.alias("start"), (start + F.col("event_id") % 500).alias("end"), F.lit(".").alias("strand"), F.lit(None).cast("long").alias("phase"), F.lit(None).cast("string").alias("parent_id"),
                F.lit("events").alias("program"), F.lit("events").alias("file"),
            )
        )
    return reduce(DataFrame.unionByName, out)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence for each nation: seqid, length, circular."""
    n = read(spark, sf_dir, "nation")
    return n.select(F.concat(F.lit("seq-"), "n_nationkey").alias("seqid"), (F.lit(200000) + F.col("n_nationkey") * 1000).cast("long").alias("length"), (F.col("n_nationkey") % 2 == 0).alias("circular"))


SQL = r"""
gene AS (
  SELECT o_orderkey*1000 AS row_id, 'seq-'||c_nationkey AS seqid, 'g'||o_orderkey AS source_id,
    CASE o_orderstatus WHEN 'F' THEN 'gene' WHEN 'O' THEN 'pseudogene' ELSE 'repeat_region' END AS source_type,
    date_diff('day', DATE '1995-01-01', o_orderdate::DATE)*100+1 AS "start", date_diff('day', DATE '1995-01-01', o_orderdate::DATE)*100+6000 AS "end",
    CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END AS strand, NULL::BIGINT AS phase, NULL::VARCHAR AS parent_id, o_orderpriority AS program, 'orders' AS file
  FROM orders JOIN customer ON o_custkey = c_custkey),
part_all AS (
  SELECT l_orderkey*1000+200+row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS row_id, seqid,
    'c'||l_orderkey||l_linestatus||l_returnflag AS source_id, CASE l_returnflag WHEN 'A' THEN 'CDS' WHEN 'R' THEN 'exon' ELSE 'five_prime_UTR' END AS source_type,
    date_diff('day', DATE '1995-01-01', l_shipdate::DATE)*100+l_linenumber AS "start", date_diff('day', DATE '1995-01-01', l_shipdate::DATE)*100+l_linenumber+l_quantity::BIGINT*40 AS "end",
    CASE WHEN l_discount >= 0.095 THEN translate(gene.strand, '+-', '-+') ELSE gene.strand END AS strand, (l_linenumber % 3)::BIGINT AS phase,
    CASE l_linestatus WHEN 'O' THEN 't' ELSE 'g' END||l_orderkey AS parent_id, 'lineitem' AS program, 'lineitem' AS file,
    l_orderkey, l_linestatus, l_partkey, l_suppkey, l_linenumber, gene.strand AS gene_strand
  FROM lineitem JOIN gene ON gene.row_id = l_orderkey*1000),
tr AS (
  SELECT l_orderkey*1000+100 AS row_id, seqid, 't'||l_orderkey AS source_id, CASE WHEN l_orderkey % 3 = 0 THEN 'transcript' ELSE 'mRNA' END AS source_type,
    min("start") AS "start", max("end") AS "end", gene_strand AS strand, NULL::BIGINT AS phase, 'g'||l_orderkey AS parent_id, 'lineitem' AS program, 'lineitem' AS file
  FROM part_all WHERE l_linestatus = 'O' GROUP BY l_orderkey, seqid, gene_strand),
ev AS (
  SELECT -event_id-1 AS row_id, 'seq-'||(user_id % 25) AS seqid, NULL::VARCHAR AS source_id, event_type AS source_type, event_id*7+1 AS "start", event_id*7+1+event_id%500 AS "end",
    '.' AS strand, NULL::BIGINT AS phase, NULL::VARCHAR AS parent_id, 'events' AS program, 'events' AS file FROM events),
part_rows AS (SELECT row_id, seqid, source_id, source_type, "start", "end", strand, phase, parent_id, program, file FROM part_all),
graph AS (SELECT * FROM gene UNION ALL SELECT * FROM tr UNION ALL SELECT * FROM part_rows),
feature AS (SELECT * FROM graph UNION ALL SELECT * FROM ev),
seqs AS (SELECT 'seq-'||n_nationkey AS seqid, (200000+n_nationkey*1000)::BIGINT AS length, n_nationkey % 2 = 0 AS circular FROM nation)
"""


def canonical_sql(column: str) -> str:
    """CASE over the synonyms that the graph uses."""
    return f"CASE {column} WHEN 'transcript' THEN 'mRNA' ELSE {column} END"


def with_view(sql: str) -> str:
    """SQL with the view's tables before it."""
    head, _, rest = sql.strip().partition(" ")
    if head.upper() == "WITH":
        return f"WITH {SQL}, {rest}"
    return f"WITH {SQL} {sql.strip()}"
