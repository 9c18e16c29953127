"""GenBank flat files: the feature table, read line by line with carried state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import graph, intervals
from strandline.sources import files
from strandline.sources.gff3 import ATTRIBUTES, AnnotationFile

_ENDS = ("ORIGIN", "//", "CONTIG", "BASE COUNT")


def _heads() -> tuple[Column, Column]:
    """The name that a LOCUS line and a VERSION line give, else nothing."""
    return F.regexp_extract("value", "^LOCUS\\s+(\\S+)", 1), F.regexp_extract("value", "^VERSION\\s+(\\S+)", 1)


def _entries(spark: SparkSession, path: str) -> DataFrame:
    """(entry, seqid, length, circular) of the records of a file, from the lines that name them alone."""
    locus, version = _heads()
    text = files.lines(spark, path).select("line", "value", "block").filter((locus != "") | (version != ""))
    t = files.carried_sum(text, "entry", (locus != "").cast("int"))
    sized = t.filter(locus != "").select("entry", locus.alias("locus"), F.regexp_extract("value", "(\\d+)\\s+(?:bp|aa)", 1).try_cast("long").alias("length"), F.lower("value").rlike("\\scircular(\\s|$)").alias("circular"))
    named = t.filter(version != "").groupBy("entry").agg(F.max_by(version, "line").alias("version"))
    return sized.join(named, "entry", "left").select("entry", F.coalesce("version", "locus").alias("seqid"), "length", "circular")


def directives(spark: SparkSession, path: str) -> DataFrame:
    """(line, seqid, start, end) of the sequences of a file."""
    return _entries(spark, path).select(F.lit(0).cast("long").alias("line"), "seqid", F.lit(1).cast("long").alias("start"), F.col("length").alias("end"))


def records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((line, seqid, type, location, attributes), (seqid, length, circular)).

    A record's sequence is named by its VERSION, else by its LOCUS.  Wrapped values are
    joined with a space, but after a hyphen without one; a flag has the value "".
    State is carried over the lines of a file within its splits, then over the splits.
    """
    text, entries = files.lines(spark, path).select("line", "value", "block"), _entries(spark, path)
    t = files.carried_sum(text, "entry", (_heads()[0] != "").cast("int"))
    switch = F.when(F.startswith("value", F.lit("FEATURES")), True)
    for e in _ENDS:
        switch = switch.when(F.startswith("value", F.lit(e)), False)
    t = files.carried_last(t, "on", switch).filter(F.col("on") & ~F.startswith("value", F.lit("FEATURES")))
    key = F.regexp_extract("value", "^ {5}(\\S+)", 1)
    t = files.carried_sum(t, "rec", (key != "").cast("int")).filter("rec > 0").withColumn("key", key)
    body = F.trim(F.substr("value", F.lit(22)))
    qualifier = F.col("body").rlike("^/[A-Za-z0-9_'-]+(=|$)")
    t = t.withColumn("body", body).withColumn("q", F.sum(qualifier.cast("int")).over(Window.partitionBy("rec").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = t.groupBy("rec", "q").agg(F.min("line").alias("line"), F.max("entry").alias("entry"), F.max("key").alias("type"), F.array_sort(F.collect_list(F.struct("line", "body"))).alias("p"))
    joined = F.aggregate(F.transform("p", lambda x: x["body"]), F.lit(""), lambda a, b: F.when(a == "", b).when(F.endswith(a, F.lit("-")), F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b)))
    parts = parts.withColumn("text", joined)
    name = F.regexp_extract("text", "^/([^=]+)", 1)
    value = F.regexp_replace(F.when(F.contains("text", F.lit("=")), F.substr("text", F.instr("text", "=") + 1)).otherwise(""), '^"|"$', "")
    quals = parts.filter("q > 0").select("rec", "q", name.alias("name"), value.alias("value"))
    by_name = quals.groupBy("rec", "name").agg(F.min("q").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("q", "value"))), lambda x: x["value"]).alias("values"))
    attrs = by_name.groupBy("rec").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", F.col("name").alias("key"), "values"))), lambda x: F.struct(x["key"].alias("key"), x["values"].alias("values"))).alias("attributes"))
    heads = parts.filter("q = 0").select("rec", "line", "entry", "type", F.replace("text", F.lit(" "), F.lit("")).alias("location"))
    out = heads.join(attrs, "rec", "left").join(entries.select("entry", "seqid"), "entry")
    return out.select("line", "seqid", "type", "location", F.coalesce("attributes", F.array().cast(ATTRIBUTES)).alias("attributes")), entries.select("seqid", "length", "circular")


def read(spark: SparkSession, path: str, *, linkage: str = "auto") -> AnnotationFile:
    """Rows as of nine-column text; links are computed.

    Where the file has mRNA records, coding records go under the one transcript of
    their gene that contains every span of theirs, a note that names a transcript
    deciding between several; else they go under the gene of their locus tag.
    """
    recs = graph._cut(records(spark, path)[0])  # the text is put together once for all that reads its records
    a = F.col("attributes")
    one = lambda k: scalars.first_value(a, k)
    tag = F.coalesce(one("locus_tag"), one("gene"))
    recs = recs.filter("type <> 'source'").withColumn("gene", F.coalesce(one("gene"), one("locus_tag"))).withColumn("tag", tag)
    recs = recs.withColumn("spans", scalars.location_spans(F.col("location"))).withColumn("strand", scalars.location_strand(F.col("location")))
    ident = F.coalesce(one("protein_id"), one("transcript_id"), F.when(F.col("type").isin("gene", "pseudogene"), tag).otherwise(F.concat(tag, F.lit(":"), "type")))
    recs = recs.withColumn("source_id", ident)
    problems = [recs.filter("strand is null").select("line", F.lit("location").alias("rule"), F.col("location").alias("detail"))]
    genes = recs.filter(F.col("type").isin("gene", "pseudogene")).groupBy("tag").agg(F.max_by("source_id", "line").alias("gene_id"))
    with_gene = recs.join(genes.filter("tag is not null"), "tag", "left")
    by_tag = F.when(~F.col("type").isin("gene", "pseudogene"), F.col("gene_id"))
    auto = linkage == "auto" and not recs.filter("type = 'mRNA'").isEmpty()
    if auto or linkage == "containment":
        child = recs.filter("type = 'CDS'").select(F.col("line").alias("id"), "gene", "spans", F.array_join(scalars.all_values(a, "note"), " ").alias("note"))
        mrna = recs.filter("type = 'mRNA'").select(F.col("source_id").alias("id"), "gene", "spans")
        cand = child.join(mrna.select(F.col("id").alias("mrna"), F.col("gene").alias("_g"), F.col("spans").alias("_s")), F.col("gene") == F.col("_g")).filter(intervals.contains_all(F.col("spans"), F.col("_s")))
        cand = cand.withColumn("named", F.contains("note", F.col("mrna")))
        pick = cand.groupBy("id").agg(F.count("*").alias("n"), F.count_if("named").alias("m"), F.min("mrna").alias("only"), F.min(F.when(F.col("named"), F.col("mrna"))).alias("noted"))
        problems.append(pick.filter("n > 1 and m <> 1").select(F.col("id").alias("line"), F.lit("ambiguous transcript").alias("rule"), F.col("n").cast("string").alias("detail")))
        pick = pick.select(F.col("id").alias("_line"), F.when(F.col("n") == 1, F.col("only")).when(F.col("m") == 1, F.col("noted")).alias("transcript"), F.when(F.col("n") == 1, "structural").otherwise("note").alias("how"))
        linked = with_gene.join(pick, F.col("line") == F.col("_line"), "left")
        linked = linked.withColumn("parent", F.when(F.col("type") == "CDS", F.col("transcript")).otherwise(by_tag)).withColumn("how", F.when(F.col("type") == "CDS", F.col("how")).otherwise(F.lit("locus_tag")))
    else:
        linked = with_gene.withColumn("parent", by_tag).withColumn("how", F.lit("locus_tag"))
    stamp = F.when(F.col("parent").isNotNull(), F.array(F.struct(F.lit("linkage_method").alias("key"), F.array("how").alias("values")))).otherwise(F.array().cast(ATTRIBUTES))
    phase = F.when(F.col("type") == "CDS", F.coalesce(one("codon_start").try_cast("long") - 1, F.lit(0)))
    rows = linked.withColumn("s", F.explode("spans")).select(
        F.col("line").alias("row_id"), "seqid", F.lit("GenBank").alias("program"), F.col("type").alias("source_type"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.lit(None).cast("double").alias("score"),
        F.coalesce("strand", F.lit("?")).alias("strand"), phase.alias("phase"), F.lit(False).alias("inverted"), F.concat("attributes", stamp).alias("attributes"), "source_id",
        F.array_compact(F.array("parent")).alias("parents"),
    )
    rows = rows.withColumn("row_id", F.col("row_id") * 1000 + F.row_number().over(Window.partitionBy("row_id").orderBy("start")) - 1)
    comments = spark.createDataFrame([], "line long, text string, block long")
    out = problems[0]
    for p in problems[1:]:
        out = out.unionByName(p)
    return AnnotationFile(path, rows, directives(spark, path), comments, out, "genbank")
