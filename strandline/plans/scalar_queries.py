"""Queries for parsing, scalar functions and bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import bins, scalars, vocabulary
from strandline.operators import export_rows
from strandline.plans import graph_view as g
from strandline.plans.registry import query


def _column9() -> F.Column:
    """Attributes of a lineitem row as column-9 text, with an escape and a repeated key."""
    c = F.col
    return F.concat(
        F.lit("ID=c"), c("l_orderkey"), F.lit(";Parent=g"), c("l_orderkey"), F.lit("; tags="), c("l_shipmode_1"), F.lit(","), c("l_shipmode_2"), F.lit(";note=a%3Bb+"), c("l_returnflag"), F.lit(";;TAGS2=x=y;tags="), c("l_linestatus"), F.lit(";")
    )


def _line(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = g.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", F.col("l_partkey").cast("string").alias("l_shipmode_1"), F.col("l_suppkey").cast("string").alias("l_shipmode_2"))
    return p.withColumn("attributes", scalars.parse_attributes(_column9()))


@query(
    """SELECT key, value, ordinal, count(*) AS n FROM (
      SELECT unnest([{'key':'ID','value':'c'||l_orderkey,'ordinal':0},{'key':'Parent','value':'g'||l_orderkey,'ordinal':0},
        {'key':'tags','value':l_partkey::VARCHAR,'ordinal':0},{'key':'tags','value':l_suppkey::VARCHAR,'ordinal':1},{'key':'tags','value':l_linestatus,'ordinal':2},
        {'key':'note','value':'a;b+'||l_returnflag,'ordinal':0},{'key':'TAGS2','value':'x=y','ordinal':0}], recursive := true) FROM lineitem) GROUP BY ALL"""
)
def attr_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column 9 parsed and exploded to a row for each key and value."""
    # of an inner explode Spark infers a filter that parses every line again
    rows = _line(spark, sf_dir).select(F.explode_outer("attributes").alias("a")).filter("a is not null").select("a.key", F.posexplode("a.values").alias("ordinal", "value"))
    return rows.groupBy("key", "value", "ordinal").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_partkey::VARCHAR AS first_tag, l_partkey||','||l_suppkey||','||l_linestatus AS tags, 'x=y' AS other, 'a;b+'||l_returnflag AS note FROM lineitem""")
def attr_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive access: the first value, all values."""
    a = F.col("attributes")
    return _line(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", "l_partkey", scalars.first_value(a, "TAGS").alias("first_tag"), F.array_join(scalars.all_values(a, "Tags"), ",").alias("tags"), scalars.first_value(a, "tags2").alias("other"), scalars.first_value(a, "note").alias("note")
    )


@query("""SELECT p_partkey, '100%zz '||p_name||'+;'||p_brand AS decoded FROM part""")
def attr_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent-decoding: bad escapes and plus signs stay."""
    p = g.read(spark, sf_dir, "part")
    text = F.concat(F.lit("100%zz%20"), F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+%3b"), F.replace("p_brand", F.lit("#"), F.lit("%23")))
    return p.select("p_partkey", scalars.percent_decode(text).alias("decoded"))


@query("""SELECT p_partkey, replace(p_name,'a','%3B')||'%25%2C'||replace(p_brand,'#','%3D')||'%09%26' AS escaped FROM part""")
def attr_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percent-escaping of the characters that column 9 reserves."""
    p = g.read(spark, sf_dir, "part")
    text = F.concat(F.replace("p_name", F.lit("a"), F.lit(";")), F.lit("%,"), F.replace("p_brand", F.lit("#"), F.lit("=")), F.lit("\t&"))
    return p.select("p_partkey", scalars.percent_escape(text).alias("escaped"))


@query("""SELECT event_id, CASE WHEN value = 0 THEN '0' ELSE regexp_replace(regexp_replace(printf(CASE WHEN abs(value) >= 100000 THEN '%.0f' WHEN abs(value) >= 10000 THEN '%.1f' WHEN abs(value) >= 1000 THEN '%.2f' WHEN abs(value) >= 100 THEN '%.3f' WHEN abs(value) >= 10 THEN '%.4f' WHEN abs(value) >= 1 THEN '%.5f' WHEN abs(value) >= 0.1 THEN '%.6f' ELSE '%.7f' END, value), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END AS score FROM events""".replace("\\\\", "\\"))
def score_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with six significant digits."""
    return g.read(spark, sf_dir, "events").select("event_id", scalars.score_text(F.col("value")).alias("score"))


@query(g.with_view(f"""SELECT {g.canonical_sql('source_type')} AS feature_type, count(DISTINCT source_id) + count(*) FILTER (source_id IS NULL) AS features FROM feature GROUP BY ALL"""))
def canonical_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandline.operators.segments import feature_count

    return g.features(spark, sf_dir).groupBy(vocabulary.canonical(F.col("source_type")).alias("feature_type")).agg(feature_count().alias("features"))


_LEVELS = [(k, 14 + 3 * (8 - k), ((1 << 3 * k) - 1) // 7) for k in range(8, 0, -1)]
_BIN_SQL = "CASE " + " ".join(f"""WHEN ("start"-1)>>{s} = ("end"-1)>>{s} THEN {o}+(("start"-1)>>{s})""" for _, s, o in _LEVELS) + " ELSE 0 END"


@query(g.with_view(f"""SELECT row_id, ({_BIN_SQL})::BIGINT AS bin FROM feature"""))
def genomic_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest hierarchical bin of every row."""
    return g.features(spark, sf_dir).select("row_id", bins.bin_of(F.col("start"), F.col("end")).alias("bin"))


_OVERLAP_SQL = " UNION ALL ".join(f"""SELECT row_id, unnest(range({o}+(("start"-1)>>{s}), {o}+(("end"-1)>>{s})+1)) AS bin FROM gene""" for _, s, o in [*_LEVELS, (0, 38, 0)])


@query(g.with_view(f"""SELECT row_id, count(*) AS n, sum(bin)::BIGINT AS bins FROM ({_OVERLAP_SQL}) GROUP BY row_id"""))
def bins_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bins that can hold something overlapping a gene."""
    rows = g.genes(spark, sf_dir).select("row_id", F.explode(bins.bins_overlapping(F.col("start"), F.col("end"))).alias("bin"))
    return rows.groupBy("row_id").agg(F.count("*").alias("n"), F.sum("bin").alias("bins"))


@query("""SELECT c_custkey, CASE WHEN c_custkey%3=0 THEN 'seq:'||c_nationkey ELSE 'seq-'||c_nationkey END AS name,
  CASE WHEN c_custkey%3<>2 THEN c_custkey*1000 END AS "start", CASE WHEN c_custkey%3=0 THEN c_custkey*1000 WHEN c_custkey%3=1 THEN c_custkey*1000+500 END AS "end" FROM customer""")
def region_text_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region texts with a range, a single place, and neither; commas in numbers."""
    c = g.read(spark, sf_dir, "customer")
    number = lambda x: F.format_number(x, 0)
    s, k = F.col("c_custkey") * 1000, F.col("c_custkey") % 3
    text = F.when(k == 0, F.concat(F.lit("seq:"), "c_nationkey", F.lit(":"), number(s))).when(k == 1, F.concat(F.lit("seq-"), "c_nationkey", F.lit(":"), number(s), F.lit("-"), (s + 500).cast("string"))).otherwise(F.concat(F.lit("seq-"), "c_nationkey"))
    return c.select("c_custkey", scalars.region_parts(text).alias("r")).select("c_custkey", "r.name", "r.start", "r.end")


@query("""SELECT l_orderkey, count(*) AS n, max(spans) AS spans, max(strand) AS strand FROM (
   SELECT l_orderkey, l_orderkey||'-'||(l_orderkey+l_partkey)||','||(l_orderkey+l_partkey+10)||'-'||(l_orderkey+l_partkey+10) AS spans, CASE WHEN l_orderkey%2=0 THEN '-' ELSE '+' END AS strand FROM lineitem) GROUP BY l_orderkey""")
def genbank_location_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature-table locations: joins, complements, partial marks, single bases."""
    r = g.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    inner = F.concat(F.lit("join(<"), "l_orderkey", F.lit("..>"), F.col("l_orderkey") + F.col("l_partkey"), F.lit(","), F.col("l_orderkey") + F.col("l_partkey") + 10, F.lit(")"))
    text = F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit("complement("), inner, F.lit(")"))).otherwise(inner)
    r = r.select("l_orderkey", scalars.segments_text(scalars.location_spans(text)).alias("spans"), scalars.location_strand(text).alias("strand"))
    return r.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.max("spans").alias("spans"), F.max("strand").alias("strand"))


@query("""SELECT event_type, count(*) AS n, sum(json_extract(props,'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type""")
def json_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes that a foreign store keeps as JSON."""
    e = g.read(spark, sf_dir, "events").withColumn("k", F.from_json("props", "k long")["k"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("""SELECT p_partkey, sha1(concat_ws(chr(30), 'Name'||chr(31)||p_name, 'brand'||chr(31)||p_brand||chr(31)||p_type)) AS digest FROM part""")
def canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of attributes: keys and values sorted, ID and Parent left out, values distinct."""
    p = g.read(spark, sf_dir, "part")
    text = F.concat(F.lit("ID=p"), "p_partkey", F.lit(";brand="), "p_type", F.lit(","), "p_brand", F.lit(","), "p_type", F.lit(";Name="), "p_name", F.lit(";Parent=q"))
    return p.select("p_partkey", scalars.attribute_digest(scalars.parse_attributes(text)).alias("digest"))


@query(g.with_view("""SELECT row_id, key||CASE WHEN n > 1 THEN '#'||n ELSE '' END AS key FROM (SELECT row_id, key, row_number() OVER (PARTITION BY key ORDER BY row_id) AS n FROM (
   SELECT row_id, substr(sha1(concat_ws(chr(9), seqid, source_type, ("start"//100)::VARCHAR, ("end"//100)::VARCHAR, strand, coalesce(parent_id,''))),1,24) AS key FROM ev))"""))
def anon_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of features without ID, numbered where they repeat."""
    return export_rows.numbered_keys(
        g.features(spark, sf_dir, "event").withColumn("start", F.floor(F.col("start") / 100)).withColumn("end", F.floor(F.col("end") / 100))
    ).select("row_id", "key")


@query("""SELECT s_suppkey, CASE s_suppkey%4 WHEN 0 THEN 'pseudo' WHEN 1 THEN 'exception' END AS reason FROM supplier""")
def exemption_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first flag that excuses a feature; false values don't."""
    s = g.read(spark, sf_dir, "supplier")
    text = F.when(F.col("s_suppkey") % 4 == 0, "exception=x;Pseudo=true").when(F.col("s_suppkey") % 4 == 1, "partial=false;exception=unclassified").when(F.col("s_suppkey") % 4 == 2, "partial=no;pseudo=0").otherwise("Name=a")
    return s.select("s_suppkey", scalars.exemption(scalars.parse_attributes(text), vocabulary.EXEMPTIONS, vocabulary.FALSE_VALUES).alias("reason"))


@query("""SELECT p_partkey, lower(replace(p_name,' ','_'))||'_'||lower(replace(p_brand,'#','_')) AS slug, CASE p_partkey%4 WHEN 0 THEN 'ko'||lpad(p_partkey::VARCHAR,5,'0') WHEN 1 THEN 'ko'||lpad(p_partkey::VARCHAR,5,'0')||',x' ELSE 'M'||p_partkey END AS pathways, CASE WHEN p_partkey%2=0 THEN p_brand END AS cleaned FROM part""")
def term_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, pathway forms, placeholders."""
    p = g.read(spark, sf_dir, "part")
    n, k = F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.col("p_partkey") % 4
    terms = F.when(k == 0, F.array(F.concat(F.lit("map"), n), F.concat(F.lit("ko"), n))).when(k == 1, F.array(F.concat(F.lit("map"), n), F.lit("x"))).otherwise(F.array(F.concat(F.lit("M"), "p_partkey")))
    return p.select("p_partkey", scalars.slug(F.concat(F.lit("._"), "p_name", F.lit(" "), "p_brand", F.lit("-"))).alias("slug"), F.array_join(scalars.kegg_pathways(terms), ",").alias("pathways"), scalars.clean(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" "), "p_brand")).otherwise("-")).alias("cleaned"))


@query(g.with_view("""SELECT row_id, concat_ws(chr(9), seqid, program, source_type, "start"::VARCHAR, "end"::VARCHAR, '.', strand, coalesce(phase::VARCHAR,'.'), CASE WHEN parent_id IS NULL THEN 'ID='||source_id ELSE 'ID='||source_id||';Parent='||parent_id END) AS line FROM graph"""))
def gff3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as nine-column text."""
    rows = g.features(spark, sf_dir, "gene", "transcript", "part").withColumn("score", F.lit(None).cast("double")).withColumn("attributes", F.array().cast("array<struct<key:string,values:array<string>>>"))
    return rows.select("row_id", export_rows.gff3_line().alias("line"))
