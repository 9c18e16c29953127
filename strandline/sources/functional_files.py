"""Functional-annotation tables: hits (query_id, analysis, accession, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.sources import files

HIT = ["query_id", "analysis", "accession", "description", "protein_start", "protein_end", "score", "evalue", "line", "turn"]

# Columns of the orthology table that hold terms, and their analyses.
EGGNOG_TERMS = {
    "GOs": "GO", "EC": "EC", "KEGG_ko": "KEGG_ko", "KEGG_Pathway": "KEGG_Pathway", "KEGG_Module": "KEGG_Module", "KEGG_Reaction": "KEGG_Reaction", "BRITE": "BRITE",
    "CAZy": "CAZy", "BiGG_Reaction": "BiGG", "PFAMs": "Pfam", "eggNOG_OGs": "eggNOG_OG", "COG_category": "COG",
}


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def read_eggnog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hits, queries).  The header names the columns; a row of another width is an error."""
    text = files.lines(spark, path).filter(F.trim("value") != "")
    head = text.filter(F.startswith("value", F.lit("#query"))).select("value").first()
    if head is None:
        raise ValueError(f"{path}: no #query header")
    names = head[0].lstrip("#").split("\t")
    rows = text.filter(~F.startswith("value", F.lit("#"))).withColumn("c", F.split("value", "\t"))
    rows = rows.withColumn("c", F.when(F.size("c") == len(names), F.col("c")).otherwise(F.raise_error(F.concat(F.lit(f"{path}: a row has other than {len(names)} columns, line "), F.col("line").cast("string")))))
    col = lambda n: scalars.clean(F.get("c", F.lit(names.index(n)))) if n in names else _null("string")
    query = F.get("c", F.lit(0))
    out = []
    for turn, (name, analysis) in enumerate(EGGNOG_TERMS.items()):
        if name not in names:
            continue
        value = col(name)
        terms = F.regexp_extract_all(value, F.lit("(\\p{L})"), F.lit(1)) if analysis == "COG" else F.transform(F.split(value, ","), lambda x: F.trim(x))
        terms = F.filter(terms, lambda x: ~x.isin(scalars.EMPTY))
        if analysis == "KEGG_Pathway":
            terms = scalars.kegg_pathways(terms)
        best = analysis == "eggNOG_OG"
        found = rows.select(query.alias("query_id"), F.lit(analysis).alias("analysis"), F.posexplode(terms).alias("_i", "accession"), *[x.alias(k) for x, k in ((col("Description"), "d"), (col("score").try_cast("double"), "s"), (col("evalue").try_cast("double"), "e"))], "line")
        out.append(
            found.select(
                "query_id", "analysis", "accession", (F.col("d") if best else _null("string")).alias("description"), _null("int").alias("protein_start"), _null("int").alias("protein_end"),
                (F.col("s") if best else _null("double")).alias("score"), (F.col("e") if best else _null("double")).alias("evalue"), "line", (F.lit(turn << 32) + F.col("_i")).alias("turn"),
            )
        )
    return reduce(DataFrame.unionByName, out), rows.select(query.alias("query_id")).distinct()


def read_interproscan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(hits, queries) of a headerless table of eleven columns and more: the signature, the
    entry it belongs to, and its GO terms."""
    rows = files.lines(spark, path).filter((F.trim("value") != "") & ~F.startswith("value", F.lit("#"))).withColumn("c", F.split("value", "\t"))
    c = lambda i: F.get("c", F.lit(i))
    fail = lambda text: F.raise_error(F.concat(F.lit(f"{path}: {text}, line "), F.col("line").cast("string")))
    rows = rows.withColumn("c", F.when(F.size("c") >= 11, F.col("c")).otherwise(fail("fewer than 11 columns")))
    start, end = c(6).cast("int"), c(7).cast("int")
    rows = rows.withColumn("_s", F.when(end >= start, start).otherwise(fail("stop before start").cast("int"))).withColumn("_e", end)
    value = scalars.clean(c(8)).try_cast("double")
    small = scalars.is_evalue(value)
    hit = lambda analysis, accession, description, turn: F.struct(analysis.alias("analysis"), accession.alias("accession"), description.alias("description"), turn.alias("turn"))
    own = F.array(hit(c(3), c(4), scalars.clean(c(5)), F.lit(0).cast("long")))
    entry = F.when(F.startswith(F.coalesce(c(11), F.lit("")), F.lit("IPR")), F.array(hit(F.lit("InterPro"), c(11), scalars.clean(c(12)), F.lit(1).cast("long")))).otherwise(F.filter(own, lambda x: F.lit(False)))
    go = F.filter(F.transform(F.split(F.coalesce(scalars.clean(c(13)), F.lit("")), "\\|"), lambda x: F.trim(F.regexp_replace(x, "\\(.*\\)$", ""))), lambda x: x != "")
    terms = F.transform(go, lambda x, i: hit(F.lit("GO"), x, _null("string"), (i + 2).cast("long")))
    rows = rows.select(c(0).alias("query_id"), F.explode(F.concat(own, entry, terms)).alias("h"), "_s", "_e", F.when(~small, value).alias("score"), F.when(small, value).alias("evalue"), "line")
    hits = rows.select("query_id", "h.analysis", "h.accession", "h.description", F.col("_s").alias("protein_start"), F.col("_e").alias("protein_end"), "score", "evalue", "line", "h.turn")
    return hits, hits.select("query_id").distinct()


def read(spark: SparkSession, path: str, tool: str | None = None) -> tuple[str, DataFrame, DataFrame]:
    """(tool, hits, queries); the format is told by the content unless stated."""
    if tool is None:
        head = [r[0] for r in files.lines(spark, path).filter(F.trim("value") != "").orderBy("line").limit(50).select("value").collect()]
        if any(x.startswith("#query") or "emapper" in x for x in head if x.startswith("#")):
            tool = "eggnog"
        elif any(x.count("\t") >= 10 for x in head if not x.startswith("#")):
            tool = "interproscan"
        else:
            raise ValueError(f"{path}: neither an orthology nor a signature table")
    return (tool, *(read_eggnog if tool == "eggnog" else read_interproscan)(spark, path))
