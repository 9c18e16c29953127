"""Queries over parent chains: closure, roots, depth, order, whole gene models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import graph, segments
from strandline.plans import graph_view as g
from strandline.plans.registry import query

V = g.with_view
_CONV = """edges AS (SELECT conv_id*1000+turn AS id, CASE WHEN turn > 0 THEN conv_id*1000+turn-1 END AS parent_id, role FROM conversations)"""


def _conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as a chain: the deepest graph in the tables."""
    c = g.read(spark, sf_dir, "conversations")
    i = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(i.alias("id"), F.when(F.col("turn") > 0, i - 1).alias("parent_id"), "role")


@query(f"""WITH RECURSIVE {_CONV}, below AS (SELECT id AS start, id, 0::BIGINT AS depth FROM edges WHERE role <> 'assistant'
  UNION SELECT start, e.id, depth+1 FROM below b JOIN edges e ON e.parent_id = b.id) SELECT start, id, min(depth) AS depth FROM below GROUP BY ALL""")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _conv(spark, sf_dir)
    return graph.closure(e, e.filter("role <> 'assistant'").select("id"))


@query(f"""WITH RECURSIVE {_CONV}, above AS (SELECT id AS start, id, 0::BIGINT AS depth FROM edges WHERE role = 'assistant'
  UNION SELECT start, e.parent_id, depth+1 FROM above b JOIN edges e ON e.id = b.id WHERE e.parent_id IS NOT NULL) SELECT start, id, min(depth) AS depth FROM above GROUP BY ALL""")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _conv(spark, sf_dir)
    return graph.closure(e, e.filter("role = 'assistant'").select("id"), up=True)


@query(f"""WITH {_CONV} SELECT DISTINCT id, (id // 1000) * 1000 AS root FROM edges""")
def root_of_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The end of every chain, by pointer jumping."""
    return graph.roots(_conv(spark, sf_dir).select("id", "parent_id")).select("id", "root")


@query(f"""WITH {_CONV} SELECT id % 1000 AS depth, count(DISTINCT id) AS n FROM edges GROUP BY ALL""")
def depth_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.roots(_conv(spark, sf_dir).select("id", "parent_id")).groupBy("depth").agg(F.count("*").alias("n"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = g.features(spark, sf_dir, "gene", "transcript", "part")
    return rows.groupBy(F.col("source_id").alias("id")).agg(F.min("parent_id").alias("parent_id"), F.min("row_id").alias("row_id"))


@query(V("""WITH f AS (SELECT source_id AS id, min(parent_id) AS parent_id, min(row_id) AS r FROM graph GROUP BY source_id),
  p0 AS (SELECT id, r::VARCHAR AS path FROM f WHERE parent_id IS NULL), p1 AS (SELECT f.id, path||'.'||r::VARCHAR AS path FROM f JOIN p0 ON parent_id = p0.id),
  p2 AS (SELECT f.id, path||'.'||r::VARCHAR AS path FROM f JOIN p1 ON parent_id = p1.id) SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2"""))
def depth_first_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that sort features depth-first, siblings by their first row."""
    f = _features(spark, sf_dir)
    found = graph.depth_first(f.select("id", "parent_id"), f.select("id", F.col("row_id").alias("rank")))
    return found.select("id", F.array_join("path.ranks", ".").alias("path"))


@query(V("""WITH f AS (SELECT source_id AS id, min(parent_id) AS parent_id FROM graph GROUP BY source_id), a AS (SELECT id AS gene FROM f WHERE parent_id IS NULL),
  b AS (SELECT gene, gene AS id FROM a UNION SELECT gene, f.id FROM a JOIN f ON f.parent_id = gene UNION SELECT gene, h.id FROM a JOIN f ON f.parent_id = gene JOIN f h ON h.parent_id = f.id)
  SELECT gene, b.id, r.source_type, r."start", r."end", r.n_segments FROM b JOIN (SELECT source_id, min(source_type) AS source_type, min("start") AS "start", max("end") AS "end", count(*) AS n_segments FROM graph GROUP BY source_id) r ON r.source_id = b.id"""))
def gene_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gene and everything under it, as whole features."""
    f = _features(spark, sf_dir)
    found = graph.closure(f.select("id", "parent_id"), f.filter("parent_id is null").select("id")).select(F.col("start").alias("gene"), "id")
    whole = segments.regroup(g.features(spark, sf_dir, "gene", "transcript", "part")).select("source_id", "source_type", "start", "end", "n_segments")
    return found.join(whole, F.col("id") == F.col("source_id")).drop("source_id")


@query(V("""WITH f AS (SELECT source_id AS id, min(parent_id) AS parent_id FROM graph GROUP BY source_id)
  SELECT c.id, coalesce(b.parent_id, a.parent_id, c.id) AS top_level FROM f c LEFT JOIN f a ON a.id = c.id AND c.parent_id IS NOT NULL LEFT JOIN f b ON b.id = c.parent_id"""))
def top_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gene at the top of every feature's chain."""
    return graph.roots(_features(spark, sf_dir).select("id", "parent_id")).select("id", F.col("root").alias("top_level"))
