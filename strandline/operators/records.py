"""Facts about single features: flags, names, digests, neighbourhoods, summaries and checks
of a file before it is loaded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import scalars, vocabulary

# Attributes that excuse a defect, and words of messages that announce a loss.
EXCUSES = ["exception", "part", "partial"]
ANNOUNCING = "(?i)skip|drop|ignor|reject|unknown|discard|remov|not load|could not"


def gene_keys(attributes: Column) -> Column:
    """(kind, value) of what names a gene: GeneID from cross-references, locus tag and symbol."""
    ids = F.transform(F.filter(scalars.all_values(attributes, "Dbxref"), lambda v: F.startswith(v, F.lit("GeneID:"))), lambda v: F.struct(F.lit("GeneID").alias("kind"), F.substr(v, F.lit(8)).alias("value")))

    def named(key: str) -> Column:
        return F.transform(scalars.all_values(attributes, key), lambda v: F.struct(F.lit(key).alias("kind"), v.alias("value")))

    return F.concat(ids, named("locus_tag"), named("gene"))


def excuses(attributes: Column) -> Column:
    """ "key=value" of the attributes that excuse a defect, in a fixed order."""
    one = [F.when(F.coalesce(scalars.first_value(attributes, k), F.lit("")) != "", F.concat(F.lit(f"{k}="), scalars.first_value(attributes, k))) for k in EXCUSES]
    return F.array_compact(F.array(*one))


def is_pseudo(attributes: Column) -> Column:
    """Stated as pseudo, or of the biotype."""
    return (F.lower(F.coalesce(scalars.first_value(attributes, "pseudo"), F.lit(""))) == "true") | (F.coalesce(scalars.first_value(attributes, "gene_biotype"), F.lit("")) == "pseudogene")


def partial_ends(location: Column) -> Column:
    """Whether a feature-table location says that a side of it is open."""
    return F.struct(F.contains(location, F.lit("<")).alias("low"), F.contains(location, F.lit(">")).alias("high"))


def without_trailing_space(attributes: Column) -> Column:
    """The last value of column 9 without the blanks at its end."""
    n = F.size(attributes)
    last = F.element_at(attributes, -1)
    m = F.size(last["values"])
    values = F.transform(last["values"], lambda v, i: F.when(i == m - 1, F.rtrim(v)).otherwise(v))
    return F.transform(attributes, lambda a, i: F.when(i == n - 1, F.struct(a["key"].alias("key"), values.alias("values"))).otherwise(a))


def feature_digests(rows: DataFrame) -> DataFrame:
    """source_id, digest: that of the attributes where all rows of a feature agree, else one of
    every row's place with its own attributes.  rows: source_id, start, end, attributes."""
    d = rows.withColumn("_d", scalars.attribute_digest(F.col("attributes")))
    each = F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws("\t", "start", "end", "_d"))), "\n"))
    return d.groupBy("source_id").agg(F.when(F.count_distinct("_d") == 1, F.min("_d")).otherwise(F.concat(F.lit("rows:"), each)).alias("digest"))


def drop_prefix(rows: DataFrame, name: str, level: str, by: list[str]) -> DataFrame:
    """rows with "level:" or "level-" taken off name, where every name of the group has it."""
    w = Window.partitionBy(*by)
    out = F.col(name)
    for mark in ("-", ":"):
        prefix = level + mark
        out = F.when(F.coalesce(F.bool_and(F.startswith(name, F.lit(prefix))).over(w), F.lit(False)), F.substr(F.col(name), F.lit(len(prefix) + 1))).otherwise(out)
    return rows.withColumn(name, out)


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """rows with first_seen: the least place of their value."""
    at = rows.groupBy(value).agg(F.min(order).alias("first_seen"))
    same = F.col("r." + value).eqNullSafe(F.col("f._v"))
    return rows.alias("r").join(at.select(F.col(value).alias("_v"), "first_seen").alias("f"), same).drop("_v")


def orphan_parts(features: DataFrame, genes: list[str], transcripts: list[str], parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(source_type, n) of parts under no transcript, and (source_id) of genes that are their own transcript.

    A gene with parts right under it counts as a transcript.
    """
    part = features.filter(F.col("source_type").isin(parts)).select("source_id", "source_type", "parent_id").distinct()
    held = part.select(F.col("parent_id").alias("source_id")).filter("source_id is not null").distinct()
    as_transcript = features.filter(F.col("source_type").isin(genes)).join(held, "source_id", "left_semi").select("source_id").distinct()
    known = features.filter(F.col("source_type").isin(transcripts)).select("source_id").union(as_transcript).distinct().select(F.col("source_id").alias("_t"))
    orphans = part.join(known, F.col("parent_id") == F.col("_t"), "left_anti")
    return orphans.groupBy("source_type").agg(F.count("*").alias("n")), as_transcript


def merged_sets(rows: DataFrame) -> DataFrame:
    """source_id, strands, parents: the distinct values of a feature's rows, sorted and joined."""
    return rows.filter("source_id is not null").groupBy("source_id").agg(F.array_join(F.array_sort(F.collect_set("strand")), ",").alias("strands"), F.array_join(F.array_sort(F.collect_set("parent_id")), ",").alias("parents"))


def parent_links(parents: Column) -> Column:
    """How many parents a comma-joined list names."""
    return F.when(F.coalesce(parents, F.lit("")) == "", 0).otherwise(F.size(F.split(parents, ","))).cast("long")


def truth_summary(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """(fact, n): rows, features, links to parents, sequences, circular and organellar ones.

    sequences: seqid, circular, genome.
    """
    merged = merged_sets(rows)
    anonymous = rows.filter("source_id is null")
    facts = [
        rows.agg(F.count("*").alias("n")).select(F.lit("rows").alias("fact"), "n"),
        merged.select("source_id").union(anonymous.select(F.col("row_id").cast("string"))).agg(F.count("*").alias("n")).select(F.lit("features").alias("fact"), "n"),
        merged.agg(F.coalesce(F.sum(parent_links(F.col("parents"))), F.lit(0)).alias("n")).select(F.lit("parent_links").alias("fact"), "n"),
        merged.agg(F.count_if(F.col("parents") != "").alias("n")).select(F.lit("features_with_parent").alias("fact"), "n"),
        sequences.agg(F.count("*").alias("n")).select(F.lit("sequences").alias("fact"), "n"),
        sequences.agg(F.count_if("circular").alias("n")).select(F.lit("circular_sequences").alias("fact"), "n"),
        sequences.agg(F.count_if(F.col("genome").isin(sorted(vocabulary.ORGANELLES))).alias("n")).select(F.lit("organelle_sequences").alias("fact"), "n"),
    ]
    return reduce(DataFrame.unionByName, facts)


def sequence_facts(rows: DataFrame) -> DataFrame:
    """seqid, circular, genome: from the region rows of each sequence; the last row says the molecule."""
    a = F.col("attributes")
    region = rows.filter("source_type = 'region'")
    return region.groupBy("seqid").agg(
        F.bool_or(F.lower(F.coalesce(scalars.first_value(a, "Is_circular"), F.lit(""))) == "true").alias("circular"), F.max_by(F.lower(F.coalesce(scalars.first_value(a, "genome"), F.lit("nuclear"))), "row_id").alias("genome")
    )


def announced(types: DataFrame, log: DataFrame) -> DataFrame:
    """source_type, announced: whether a line of the log that announces a loss names the type as a word.

    types and log (line) are a handful of rows each: the types of a file, a program's messages.
    """
    lines = log.filter(F.col("line").rlike(ANNOUNCING)).select(F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit("([A-Za-z0-9_]+)"), F.lit(1)))).alias("word")).distinct()
    return types.join(lines, F.col("source_type") == F.col("word"), "left").select("source_type", F.col("word").isNotNull().alias("announced"))


def under_folder(paths: DataFrame, column: str, folder: str) -> DataFrame:
    """paths that begin with a folder's name; its characters mean themselves."""
    return paths.filter(F.startswith(column, F.lit(folder.rstrip("/") + "/")))


def seeded_sample(rows: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """n rows, the same for a seed however the rows lie: the first by a hash of seed and key."""
    return rows.orderBy(F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string"))), key).limit(n)


def preflight(rows: DataFrame, sequences: DataFrame) -> DataFrame:
    """(row_id, kind, detail): coordinates that are no numbers or inverted, strands, rows past
    their sequence, children outside the union of their parent's rows.

    rows: row_id, seqid, source_type, start, end (as text), strand, source_id, parent_id;
    sequences: seqid, length.
    """
    lo, hi = F.col("start").try_cast("long"), F.col("end").try_cast("long")
    at = F.concat_ws("..", "start", "end")
    found = [rows.filter(lo.isNull() | hi.isNull()).select("row_id", F.lit("coordinate").alias("kind"), at.alias("detail"))]
    good = rows.filter(lo.isNotNull() & hi.isNotNull()).select("row_id", "seqid", "source_type", lo.alias("lo"), hi.alias("hi"), "strand", "source_id", "parent_id")
    place = F.concat_ws("..", "lo", "hi")
    found.append(good.filter("lo > hi").select("row_id", F.lit("inverted").alias("kind"), place.alias("detail")))
    found.append(good.filter(~F.col("strand").isin("+", "-", ".", "?")).select("row_id", F.lit("strand").alias("kind"), F.col("strand").alias("detail")))
    past = good.join(sequences.select("seqid", "length"), "seqid").filter("lo > length or hi > length")
    found.append(past.select("row_id", F.lit("out-of-range").alias("kind"), place.alias("detail")))
    spans = good.filter("source_id is not null").groupBy(F.col("source_id").alias("_p")).agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
    outside = good.join(spans, F.col("parent_id") == F.col("_p")).filter("lo < _lo or hi > _hi")
    found.append(outside.select("row_id", F.lit("escapes-parent").alias("kind"), F.concat(place, F.lit(" outside "), F.col("_p"), F.lit(" "), F.concat_ws("..", "_lo", "_hi")).alias("detail")))
    return reduce(DataFrame.unionByName, found)


def percent_text(part: Column, whole: Column) -> Column:
    """ "1,234 of 5,678 (21.7%)", or "none" of nothing."""
    return F.when(whole == 0, "none").otherwise(F.concat(F.format_number(part, 0), F.lit(" of "), F.format_number(whole, 0), F.lit(" ("), F.format_string("%.1f", F.floor(part * 1000 / whole + F.lit(0.5)) / 10), F.lit("%)")))
