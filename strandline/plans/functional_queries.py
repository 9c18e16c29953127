"""Queries for functional annotation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import functional
from strandline.plans import graph_view as g
from strandline.plans.registry import query

V = g.with_view


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand and type of each lineitem's part as terms of its order."""
    l, p = g.read(spark, sf_dir, "lineitem"), g.read(spark, sf_dir, "part")
    rows = l.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("feature_id"), "l_linenumber", "l_suppkey", "l_partkey", F.explode(F.create_map(F.lit("Brand"), "p_brand", F.lit("Type"), "p_type")).alias("analysis", "accession"))
    return rows.withColumn("protein_start", (F.col("l_linenumber") % 3).cast("long"))


_HITS = """hits AS (SELECT l_orderkey AS feature_id, l_linenumber, l_suppkey, l_partkey, l_linenumber % 3 AS protein_start, analysis, accession FROM lineitem JOIN
  (SELECT p_partkey, unnest(['Brand','Type']) AS analysis, unnest([p_brand, p_type]) AS accession FROM part) ON l_partkey = p_partkey)"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = g.read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("feature_id"), F.explode(F.array("c_name", F.concat(F.lit("gnl|db|P"), F.col("c_custkey") % 1200), F.concat(F.lit("seg"), "c_mktsegment"))).alias("name"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = g.read(spark, sf_dir, "orders").join(g.read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey") % 5
    text = F.when(k == 0, F.col("c_name")).when(k == 1, F.concat("c_name", F.lit(" putative kinase"))).when(k == 2, F.concat(F.lit("sp|x|P"), F.col("o_custkey") % 1300)).when(k == 3, F.concat(F.lit("seg"), "c_mktsegment")).otherwise(F.concat(F.lit("none"), "o_orderkey"))
    return o.select(text.alias("query_id"))


# The first form that is known decides: whole name, first field, tail after a bar.
_MATCH = """keys AS (SELECT DISTINCT feature_id, k AS key FROM (SELECT c_custkey AS feature_id, unnest([c_name, 'gnl|db|P'||(c_custkey%1200), 'P'||(c_custkey%1200), 'seg'||c_mktsegment]) AS k FROM customer)),
  q AS (SELECT DISTINCT CASE o_orderkey%5 WHEN 0 THEN c_name WHEN 1 THEN c_name||' putative kinase' WHEN 2 THEN 'sp|x|P'||(o_custkey%1300) WHEN 3 THEN 'seg'||c_mktsegment ELSE 'none'||o_orderkey END AS query_id FROM orders JOIN customer ON o_custkey = c_custkey),
  m AS (SELECT query_id, turn, count(DISTINCT feature_id) AS n, min(feature_id) AS feature_id FROM (SELECT query_id, 0 AS turn, query_id AS k FROM q UNION ALL SELECT query_id, 1, split_part(query_id,' ',1) FROM q UNION ALL SELECT query_id, 2, regexp_extract(query_id,'([^|]*)$',1) FROM q WHERE contains(query_id,'|')) JOIN keys ON k = key GROUP BY ALL),
  best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY turn) = 1),
  resolved AS (SELECT q.query_id, CASE WHEN n = 1 THEN feature_id END AS feature_id, coalesce(n,0)::BIGINT AS n FROM q LEFT JOIN best USING (query_id))"""


@query(f"""WITH {_MATCH} SELECT * FROM resolved""")
def multi_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functional.resolve(_queries(spark, sf_dir), functional.identifier_index(_names(spark, sf_dir)))


@query(f"""WITH {_MATCH} SELECT count(*) AS queries, count(*) FILTER (n=1) AS matched, count(*) FILTER (n=0) AS unmatched, count(*) FILTER (n>1) AS ambiguous, round(count(*) FILTER (n=1)/count(*),4) AS rate FROM resolved""")
def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functional.match_rate(multi_key_match(spark, sf_dir))


@query(f"""WITH {_MATCH} SELECT query_id FROM resolved WHERE n = 0 ORDER BY query_id LIMIT 20""")
def unmatched_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty queries without a feature, as a report shows them."""
    return multi_key_match(spark, sf_dir).filter("n = 0").orderBy("query_id").limit(20).select("query_id")


@query("""SELECT p_partkey, CASE p_partkey%6 WHEN 0 THEN lpad(p_partkey::VARCHAR,7,'0')||',GO:'||lpad(p_partkey::VARCHAR,7,'0') WHEN 1 THEN 'K'||lpad(p_partkey::VARCHAR,5,'0')||',ko:K'||lpad(p_partkey::VARCHAR,5,'0')
   WHEN 2 THEN 'ko:K'||lpad(p_partkey::VARCHAR,5,'0')||',K'||lpad(p_partkey::VARCHAR,5,'0') WHEN 3 THEN 'map'||p_partkey||',ko'||p_partkey WHEN 4 THEN '1.2.3.'||p_partkey||',EC:1.2.3.'||p_partkey ELSE 'PF'||p_partkey END AS variants FROM part""")
def term_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = g.read(spark, sf_dir, "part")
    k, n = F.col("p_partkey") % 6, F.col("p_partkey").cast("string")
    term = F.when(k == 0, F.lpad(n, 7, "0")).when(k == 1, F.concat(F.lit("K"), F.lpad(n, 5, "0"))).when(k == 2, F.concat(F.lit("ko:K"), F.lpad(n, 5, "0"))).when(k == 3, F.concat(F.lit("map"), n)).when(k == 4, F.concat(F.lit("1.2.3."), n)).otherwise(F.concat(F.lit("PF"), n))
    return p.select("p_partkey", F.array_join(scalars.term_variants(term), ",").alias("variants"))


@query(f"""WITH {_HITS} SELECT feature_id, analysis, accession, protein_start, count(*) AS n FROM hits WHERE accession IN ('Brand#7','Brand#11') AND lower(analysis) = 'brand' GROUP BY ALL""")
def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with a term, in an analysis whatever its case."""
    found = functional.with_term(_hits(spark, sf_dir), ["Brand#7", "Brand#11"], "BRAND")
    return found.groupBy("feature_id", "analysis", "accession", "protein_start").agg(F.count("*").alias("n"))


@query(f"""WITH {_HITS} SELECT feature_id, analysis, accession, protein_start, l_suppkey FROM hits QUALIFY row_number() OVER (PARTITION BY feature_id, analysis, accession, protein_start ORDER BY l_linenumber, l_suppkey, l_partkey) = 1""")
def functional_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit for each feature, analysis, accession and start: the first in input order."""
    return functional.deduplicated(_hits(spark, sf_dir), [F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_partkey")]).select("feature_id", "analysis", "accession", "protein_start", "l_suppkey")


@query(f"""WITH {_HITS}, c AS (SELECT analysis, accession, count(DISTINCT feature_id) AS features FROM hits GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY analysis ORDER BY features DESC, accession) = 1""")
def top_term_per_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functional.top_accessions(_hits(spark, sf_dir))


@query(f"""WITH {_HITS} SELECT 'o'||feature_id||chr(9)||analysis||chr(9)||accession AS line, count(*) AS n FROM hits GROUP BY ALL""")
def functional_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the functional table."""
    h = _hits(spark, sf_dir)
    return h.groupBy(F.concat_ws("\t", F.concat(F.lit("o"), "feature_id"), "analysis", "accession").alias("line")).agg(F.count("*").alias("n"))


@query(f"""WITH {_HITS} SELECT analysis, count(*) AS hits, count(DISTINCT accession) AS accessions, count(DISTINCT feature_id) AS features FROM hits GROUP BY analysis""")
def hits_per_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).groupBy("analysis").agg(F.count("*").alias("hits"), F.count_distinct("accession").alias("accessions"), F.count_distinct("feature_id").alias("features"))
