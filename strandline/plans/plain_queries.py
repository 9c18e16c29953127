"""Queries over a text with every hard case, read by the reader that shares no code with
the scan, and comparisons of a store with what it says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import fidelity, transcripts
from strandline.plans import graph_view as g
from strandline.plans.registry import query
from strandline.sources import files, foreign, plain_reader

V = g.with_view
SHIFT = 500_000
IGNORED = ("added_by",)  # an attribute that only an export has


def _table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = files.scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view's rows with faults by row_id: k, nine columns' values and attributes apart."""
    return _faulty(g.features(spark, sf_dir)).unionByName(_region_rows(spark, sf_dir))


def _faulty(r: DataFrame, *kept: str) -> DataFrame:
    """Rows of the view with faults, and columns to keep; those of a row follow each other in the order of k."""
    m = lambda n: F.col("row_id") % n == 0
    a, b = F.col("start") + SHIFT, F.col("end") + SHIFT
    own = F.when(F.col("parent_id").isNull(), F.array().cast("array<string>")).when(m(53), F.array(F.concat(F.lit("none"), "row_id"))).when(m(47), F.array("parent_id", F.concat(F.lit("g"), F.expr("row_id div 1000")))).otherwise(F.array("parent_id"))
    rows = r.select(
        (F.col("row_id") * 2).alias("k"), "seqid", "program", F.col("source_type").alias("type"), F.when(m(43), b).otherwise(a).alias("start"), F.when(m(43), a).otherwise(b).alias("end"), F.when(m(41), "?").otherwise(F.col("strand")).alias("strand"), F.col("source_id").alias("id"), own.alias("parents"),
        F.array_compact(F.array(F.col("program"), F.when(m(29), "zz 50%"))).alias("note"), m(37).alias("spliced"), F.when(F.col("source_type") == "mRNA", F.concat(F.lit("T"), F.expr("row_id div 1000"))).alias("name"), F.lit(False).alias("circular"), F.lit(None).cast("string").alias("genome"), *kept,
    )
    twice = F.when(F.col("id").isNull() & (F.col("k") % 61 == 0), F.array(F.col("k"), F.col("k") + 1)).otherwise(F.array("k"))
    return rows.select(F.explode(twice).alias("k"), *[c for c in rows.columns if c != "k"])


def _region_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region row for each sequence."""
    n = F.regexp_extract("seqid", "[0-9]+", 0).cast("long")
    none = F.lit(None).cast("string")
    return g.sequences(spark, sf_dir).select(
        (n - (1 << 59)).alias("k"), "seqid", F.lit("made").alias("program"), F.lit("region").alias("type"), F.lit(1).cast("long").alias("start"), (F.col("length") + SHIFT).alias("end"), F.lit("+").alias("strand"), F.concat(F.lit("reg"), n).alias("id"), F.array().cast("array<string>").alias("parents"),
        F.array().cast("array<string>").alias("note"), F.lit(False).alias("spliced"), none.alias("name"), "circular", F.when(n.isin(3, 7), "mitochondrion").when(n != 5, "chromosome").alias("genome"),
    )


_NONE = "[]::VARCHAR[]"
HARD_SQL = f"""
hard_row AS (
  SELECT row_id*2 AS k, seqid, source_type AS type, CASE WHEN row_id % 43 = 0 THEN "end" ELSE "start" END + {SHIFT} AS "start", CASE WHEN row_id % 43 = 0 THEN "start" ELSE "end" END + {SHIFT} AS "end", CASE WHEN row_id % 41 = 0 THEN '?' ELSE strand END AS strand, source_id AS id,
    CASE WHEN parent_id IS NULL THEN {_NONE} WHEN row_id % 53 = 0 THEN ['none'||row_id] WHEN row_id % 47 = 0 THEN [parent_id, 'g'||(row_id//1000)] ELSE [parent_id] END AS parents,
    CASE WHEN row_id % 29 = 0 THEN [program, 'zz 50%'] ELSE [program] END AS note, row_id % 37 = 0 AS spliced, CASE WHEN source_type = 'mRNA' THEN 'T'||(row_id//1000) END AS name, false AS circular, NULL::VARCHAR AS genome FROM feature
  UNION ALL SELECT row_id*2+1, seqid, source_type, CASE WHEN row_id % 43 = 0 THEN "end" ELSE "start" END + {SHIFT}, CASE WHEN row_id % 43 = 0 THEN "start" ELSE "end" END + {SHIFT}, CASE WHEN row_id % 41 = 0 THEN '?' ELSE strand END, NULL, {_NONE},
    CASE WHEN row_id % 29 = 0 THEN [program, 'zz 50%'] ELSE [program] END, row_id % 37 = 0, NULL, false, NULL FROM feature WHERE source_id IS NULL AND row_id*2 % 61 = 0
  UNION ALL SELECT substr(seqid, 5)::BIGINT - {1 << 59}, seqid, 'region', 1, length + {SHIFT}, '+', 'reg'||substr(seqid, 5), {_NONE}, {_NONE}, false, NULL, circular, CASE WHEN seqid IN ('seq-3', 'seq-7') THEN 'mitochondrion' WHEN seqid <> 'seq-5' THEN 'chromosome' END FROM seqs),
hard_text AS (SELECT *, array_to_string(list_sort(list_distinct(parents)), ',') AS named, sha1(concat_ws(chr(30), CASE WHEN circular THEN 'Is_circular=true' END, 'Name='||name, CASE WHEN len(note) > 0 THEN 'Note='||array_to_string(list_sort(list_distinct(note)), chr(31)) END,
    CASE WHEN spliced THEN 'exception=trans-splicing' END, 'genome='||genome)) AS digest, "start"||chr(9)||"end"||chr(9) AS place FROM hard_row),
hard_key AS (SELECT *, coalesce(id, anon||CASE WHEN nth > 1 THEN '#'||nth ELSE '' END) AS key FROM (SELECT *, row_number() OVER (PARTITION BY id IS NULL, anon ORDER BY k) AS nth
  FROM (SELECT *, 'anon:'||substr(sha1(concat_ws(chr(9), seqid, type, "start", "end", strand, named)), 1, 24) AS anon FROM hard_text))),
hard_whole AS (SELECT key, first(seqid ORDER BY k) AS seqid, first(type ORDER BY k) AS type, string_agg(DISTINCT strand, ',' ORDER BY strand) AS strand, min(least("start", "end")) AS "start", max(greatest("start", "end")) AS "end", count(*) AS nseg,
    string_agg("start"||'-'||"end", ',' ORDER BY "start", "end") AS segs, first(named ORDER BY k) AS parents, CASE WHEN min(digest) <> max(digest) THEN 'rows:'||sha1(string_agg(place||digest, chr(10) ORDER BY place||digest)) ELSE min(digest) END AS attrs, 1::BIGINT AS records,
    bool_or("start" > "end") AS inverted, bool_or(strand = '?') AS unknown, bool_or(spliced) AS spliced, bool_or(len(note) > 1) AS several, min(digest) <> max(digest) AS disagree, first(id ORDER BY k) IS NULL AS no_id, list(seqid||'|'||type) AS kinds,
    list_sort(list([least("start", "end"), greatest("start", "end")])) AS spans FROM hard_key GROUP BY key),
hard_link AS (SELECT c.key, bool_or(p.key IS NULL) AS dangling, bool_or(c."start" < p."start" OR c."end" > p."end") AS escapes, bool_or(c.type = 'exon' AND p.type = 'pseudogene') AS pseudo, count(*) > 1 AS many
  FROM (SELECT *, unnest(string_split(parents, ',')) AS up FROM hard_whole WHERE parents <> '') c LEFT JOIN hard_whole p ON p.key = c.up GROUP BY c.key),
hard AS (SELECT w.key, w.seqid, type, strand, "start", "end", nseg, segs, parents, attrs, records, len(list_filter(kinds, lambda x: x <> w.seqid||'|'||type))::BIGINT AS n_conflicts,
  concat_ws(',', CASE WHEN "end" > length + {SHIFT} AND circular AND "start" <= length + {SHIFT} THEN 'crosses_origin' END, CASE WHEN dangling THEN 'dangling_parent' END, CASE WHEN escapes THEN 'escapes_parent' END, CASE WHEN pseudo THEN 'exon_under_pseudogene' END, CASE WHEN inverted THEN 'inverted' END,
    CASE WHEN many THEN 'multi_parent' END, CASE WHEN nseg > 1 THEN 'multi_row' END, CASE WHEN several THEN 'multi_valued' END, CASE WHEN no_id THEN 'no_id' END, CASE WHEN w.seqid IN ('seq-3', 'seq-7') THEN 'organelle' END,
    CASE WHEN len(list_filter(range(2, nseg + 1), lambda i: spans[i][1] <= spans[i-1][2])) > 0 THEN 'overlapping_rows' END, CASE WHEN "end" > length + {SHIFT} AND (NOT circular OR "start" > length + {SHIFT}) THEN 'past_end' END, CASE WHEN disagree THEN 'rows_disagree' END,
    CASE WHEN unknown THEN 'strand_unknown' END, CASE WHEN spliced THEN 'trans_spliced' END) AS flags
  FROM hard_whole w LEFT JOIN hard_link USING (key) LEFT JOIN seqs ON seqs.seqid = w.seqid)"""


def _with(sql: str) -> str:
    return V(f"WITH {HARD_SQL}{sql}")


def hard_text(spark: SparkSession, sf_dir: str) -> str:
    """The rows as text, with lines that are no rows: comments, eight columns, places that aren't numbers, and all after ##FASTA."""
    escape = lambda c: F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    pair = lambda k, v: F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}="), v))
    nine = F.concat_ws(
        ";", pair("ID", F.col("id")), pair("Parent", F.array_join("parents", ",")), pair("Note", F.array_join(F.transform("note", escape), ",")), F.when(F.col("spliced"), "exception=trans-splicing"), pair("Name", F.col("name")),
        F.when(F.col("circular"), "Is_circular=true"), pair("genome", F.col("genome")), F.lit("added_by=x"), F.lit("no value"), F.lit(""),
    )
    line = F.concat_ws("\t", "seqid", "program", "type", "start", "end", F.lit("."), "strand", F.lit("."), nine)
    n = F.regexp_extract("seqid", "[0-9]+", 0).cast("long")
    declared = g.sequences(spark, sf_dir).select((n - (1 << 60)).alias("k"), F.concat(F.lit("##sequence-region  "), "seqid", F.lit(" 1 "), F.col("length") + SHIFT).alias("value"))
    orders = g.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    bad = orders.filter("k % 71 = 0").select("k", F.lit("seq-1\tx\tgene\tn/a\t5\t.\t+\t.\tID=bad").alias("value")).unionByName(orders.filter("k % 73 = 0").select("k", F.lit("seq-1\tx\tgene\t1\t5\t.\t+\t.").alias("value"))).unionByName(orders.filter("k % 79 = 0").select("k", F.lit("# ID=comment").alias("value")))
    tail = spark.createDataFrame([((1 << 60) + i, v) for i, v in enumerate(["##FASTA", ">x", "seq-1\tx\tgene\t1\t5\t.\t+\t.\tID=late"])], "k long, value string")
    parts = (declared, _region_rows(spark, sf_dir).select("k", line.alias("value")), bad, tail)
    # rows of the view are put in order, and their faults and lines made after that
    told = ["row_id", "seqid", "program", "source_type", "start", "end", "strand", "source_id", "parent_id"]
    rows = g.features(spark, sf_dir).select((F.col("row_id") * 2).alias("_at"), *told)
    ordered = rows.unionByName(reduce(DataFrame.unionByName, parts).withColumnRenamed("k", "_at"), allowMissingColumns=True).repartitionByRange("_at").sortWithinPartitions("_at")
    return files.write_lines(_faulty(ordered, "value").select(F.coalesce("value", line).alias("value")), files.scratch(spark, "hard"), compression="gzip")


_READ: dict[tuple[str, str], tuple[plain_reader.Text, DataFrame]] = {}


def _read(spark: SparkSession, sf_dir: str) -> tuple[plain_reader.Text, DataFrame]:
    """The text and its features, read once for each session and set of tables."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _READ:
        text = plain_reader.read(spark, hard_text(spark, sf_dir), IGNORED)
        text = plain_reader.Text(_table(text.rows, "rows"), _table(text.declared, "declared"), _table(text.unreadable, "unreadable"))  # lines are taken apart once
        _READ[key] = text, _table(plain_reader.features(text), "plain")
    return _READ[key]


def forget() -> None:
    """The next query writes and reads the text again, as a timing wants it."""
    _READ.clear()


@query(_with(" SELECT * FROM hard"))
def plain_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature of the text: place, strands, segments, parents, digest of attributes, hard cases, conflicts."""
    return _read(spark, sf_dir)[1]


@query(_with(" SELECT key AS source_id, flags FROM hard WHERE flags <> ''"))
def hard_case_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the fifteen hard cases a feature is."""
    return _read(spark, sf_dir)[1].filter("flags <> ''").select(F.col("key").alias("source_id"), "flags")


_CASES = ", ".join(f"('{c}')" for c in plain_reader.HARD_CASES)
_BAD = "(SELECT count(*) FROM orders WHERE o_orderkey % 71 = 0)"


@query(_with(f""", total AS (SELECT count(*) AS features, (sum(nseg) + {_BAD})::BIGINT AS n_rows, coalesce(sum(len(string_split(parents, ','))) FILTER (parents <> ''), 0)::BIGINT AS links, count(*) FILTER (parents <> '') AS w, coalesce(sum(n_conflicts), 0)::BIGINT AS c FROM hard),
  cases(name) AS (VALUES {_CASES})
  SELECT 'total' AS kind, unnest(['features', 'rows', 'parent_links', 'features_with_parent', 'id_conflicts', 'non_numeric_rows']) AS name, unnest([features, n_rows, links, w, c, {_BAD}]) AS n FROM total
  UNION ALL SELECT 'total', 'sequences', count(*) FROM seqs UNION ALL SELECT 'total', 'circular_sequences', count(*) FROM seqs WHERE circular UNION ALL SELECT 'total', 'organelle_sequences', count(*) FROM seqs WHERE seqid IN ('seq-3', 'seq-7')
  UNION ALL SELECT 'hard case', name, (SELECT count(*) FROM hard WHERE list_contains(string_split(flags, ','), name)) FROM cases
  UNION ALL SELECT 'type', type, count(*) FROM hard GROUP BY type UNION ALL SELECT 'type with parent', type, count(*) FROM hard WHERE parents <> '' GROUP BY type"""))
def plain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of the text, its types, and each hard case."""
    text, found = _read(spark, sf_dir)
    return plain_reader.summary(text, found)


# -- what a store kept

_ORDER = "regexp_extract({}, '^[a-z]([0-9]+)', 1)"


def _order(column: str = "key"):
    """The order's number in an ID, null in others."""
    return F.regexp_extract(column, "^[a-z]([0-9]+)", 1).try_cast("long")


def kept(truth: DataFrame) -> DataFrame:
    """The truth after the faults of a loader, by the order's number."""
    o = F.coalesce(_order(), F.lit(1))
    t = truth.filter(~((F.col("type") == "exon") & (o % 11 == 0)) & (F.col("type") != "repeat_region") & ~((F.col("type") == "click") & F.endswith("key", F.lit("a"))))
    t = t.withColumn("key", F.when((F.col("type") == "five_prime_UTR") & (o % 13 == 0), F.concat(F.lit("x"), "key")).otherwise(F.col("key")))
    t = t.withColumn("strand", F.replace("strand", F.lit("?"), F.lit("."))).withColumn("parents", F.substring_index("parents", ",", 1))
    t = t.withColumn("segs", F.when(F.contains("flags", F.lit("inverted")), F.concat_ws("-", "start", "end")).otherwise(F.col("segs")))
    t = t.withColumn("attrs", F.when((F.col("type") == "CDS") & (o % 7 == 0), "").otherwise(F.col("attrs"))).withColumn("seqid", F.when(o % 97 == 0, "elsewhere").otherwise(F.col("seqid")))
    return t.withColumn("records", F.when((F.col("type") == "mRNA") & (o % 17 == 0), 2).otherwise(1).cast("long"))


def messages(truth: DataFrame) -> DataFrame:
    """The loader's messages: some name a feature, some a type."""
    o = _order()
    named = truth.filter((F.col("type") == "exon") & (o % 22 == 0)).select(F.concat(F.lit("could not place '"), "key", F.lit("':")).alias("line"))
    inside = truth.filter((F.col("type") == "CDS") & (o % 14 == 0)).select(F.concat(F.lit("note attributes.of/"), "key", F.lit("/were kept")).alias("line"))
    return named.unionByName(inside).unionByName(truth.sparkSession.createDataFrame([("Skipping all of type repeat_region (5)",), ("5 gene rows were read",), ("unknown: clicks, exon_part",)], "line string"))


def repaired(truth: DataFrame) -> DataFrame:
    """What the loader declares to have changed."""
    return truth.filter(F.contains("flags", F.lit("inverted"))).select("key")


_O = "coalesce(regexp_extract(key, '^[a-z]([0-9]+)', 1)::VARCHAR, '')"
_N = f"coalesce(try_cast({_O} AS BIGINT), 1)"
FIDELITY_SQL = f""", stored AS (SELECT CASE WHEN type = 'five_prime_UTR' AND {_N} % 13 = 0 THEN 'x' ELSE '' END||key AS key, CASE WHEN {_N} % 97 = 0 THEN 'elsewhere' ELSE seqid END AS seqid, type, replace(strand, '?', '.') AS strand, CASE WHEN contains(flags, 'inverted') THEN "start"||'-'||"end" ELSE segs END AS segs,
    split_part(parents, ',', 1) AS parents, CASE WHEN type = 'CDS' AND {_N} % 7 = 0 THEN '' ELSE attrs END AS attrs, CASE WHEN type = 'mRNA' AND {_N} % 17 = 0 THEN 2 ELSE 1 END AS records
    FROM hard WHERE NOT (type = 'exon' AND {_N} % 11 = 0) AND type <> 'repeat_region' AND NOT (type = 'click' AND ends_with(key, 'a'))),
  joined AS (SELECT coalesce(t.key, s.key) AS key, coalesce(t.type, s.type) AS type, coalesce(flags, '') AS flags, t.key IS NULL AS extra, s.key IS NULL AS lost, coalesce(s.parents, '') AS s_parents, coalesce(t.parents, '') AS t_parents,
    CASE WHEN t.key IS NULL OR s.key IS NULL THEN '' ELSE concat_ws(',', CASE WHEN t.seqid <> s.seqid THEN 'seqid' END, CASE WHEN t.strand <> s.strand THEN 'strand' END, CASE WHEN t.segs <> s.segs THEN 'segs' END, CASE WHEN t.parents <> s.parents THEN 'parents' END,
      CASE WHEN t.attrs <> s.attrs THEN 'attrs' END, CASE WHEN s.records > 1 THEN 'split' END) END AS fields FROM hard t FULL JOIN stored s ON t.key = s.key),
  states AS (SELECT *, CASE WHEN extra THEN 'extra' WHEN lost THEN 'lost' WHEN fields = '' THEN 'kept' WHEN contains(flags, 'inverted') THEN 'changed_declared' ELSE 'changed' END AS state FROM joined),
  told AS (SELECT *, CASE WHEN state IN ('lost', 'changed') THEN type = 'repeat_region' OR (type = 'exon' AND {_N} % 22 = 0 AND {_O} <> '') OR (type = 'CDS' AND {_N} % 14 = 0 AND {_O} <> '') END AS announced,
    CASE WHEN t_parents = '' THEN 0 ELSE len(string_split(t_parents, ',')) END::BIGINT AS links, len(list_filter(list_intersect(string_split(t_parents, ','), string_split(s_parents, ',')), lambda x: x <> ''))::BIGINT AS kept_links, CASE WHEN s_parents = '' THEN 0 ELSE 1 END AS stored_links FROM states)"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = _read(spark, sf_dir)[1]
    return fidelity.compare(truth, kept(truth), messages(truth), repaired(truth), cut=lambda df: _table(df, "compared"))


@query(_with(f"{FIDELITY_SQL} SELECT key, type, flags, state, announced, fields, links, kept_links FROM told WHERE state <> 'kept'"))
def fidelity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature that a store lost, changed or made up, and whether its messages say so."""
    return _compared(spark, sf_dir).filter("state <> 'kept'").select("key", "type", "flags", "state", "announced", "fields", "links", "kept_links")


@query(_with(f"""{FIDELITY_SQL}, c AS (SELECT *, list_filter([CASE WHEN NOT extra THEN 'truth' END, state, CASE WHEN announced IS NOT NULL THEN state||CASE WHEN announced THEN '_announced' ELSE '_silent' END END], lambda x: x IS NOT NULL) AS s,
    list_filter(string_split(flags, ','), lambda x: x <> '') AS cases, list_filter(string_split(fields, ','), lambda x: x <> '') AS f FROM told)
  SELECT 'total' AS scope, '' AS name, counter, count(*) AS n FROM (SELECT unnest(s) AS counter FROM c WHERE NOT extra) GROUP BY counter UNION ALL SELECT 'type', type, counter, count(*) FROM (SELECT type, unnest(s) AS counter FROM c WHERE NOT extra) GROUP BY ALL
  UNION ALL SELECT 'extra', type, 'n', count(*) FROM c WHERE extra GROUP BY type UNION ALL SELECT 'case', name, counter, count(*) FROM (SELECT name, unnest(s) AS counter FROM (SELECT s, unnest(cases) AS name FROM c WHERE NOT extra)) GROUP BY ALL
  UNION ALL SELECT 'field', '', counter, count(*) FROM (SELECT unnest(f) AS counter FROM c) GROUP BY ALL UNION ALL SELECT 'case field', name, counter, count(*) FROM (SELECT name, unnest(f) AS counter FROM (SELECT f, unnest(cases) AS name FROM c)) GROUP BY ALL
  UNION ALL SELECT 'total', '', unnest(['links', 'kept_links', 'stored_links', 'stored_features']), unnest([sum(links)::BIGINT, sum(kept_links)::BIGINT, sum(stored_links)::BIGINT, count(*) FILTER (NOT lost)]) FROM told"""))
def fidelity_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses and changes in total, by type, by hard case and by field, announced and silent."""
    return fidelity.counters(_compared(spark, sf_dir))


@query(_with(f"""{FIDELITY_SQL}, e AS (SELECT key, state||CASE WHEN fields = '' THEN '' ELSE ':'||replace(fields, ',', '+') END AS label FROM told WHERE state NOT IN ('kept', 'extra'))
  SELECT label, string_agg(key, ',' ORDER BY key) AS keys FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY key) AS i FROM e) WHERE i <= 5 GROUP BY label"""))
def fidelity_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five features of each way to differ."""
    return fidelity.examples(_compared(spark, sf_dir))


# -- transcripts of a store of gene models

KINDS = transcripts.Kinds(gene=["gene", "pseudogene"], transcript=["mRNA", "transcript"], exon=["exon"], cds=["CDS"])


def gene_models(want: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a store of gene models made of the transcripts: transcripts, exons and coding pieces, with faults by the order's number."""
    o = F.coalesce(_order("id"), F.lit(1))
    rows = want.filter(o % 19 != 0).withColumn("exons", F.when(o % 41 == 0, F.transform("exons", lambda x, i: F.struct((x["start"] - F.when(i == 0, 1).otherwise(0)).alias("start"), x["end"].alias("end")))).otherwise(F.col("exons")))
    rows = rows.withColumn("cds", F.when(o % 43 == 0, F.slice("cds", 2, 1000)).otherwise(F.col("cds"))).withColumn("genes", F.when(o % 47 == 0, F.array(F.lit("other"))).otherwise(F.col("genes")))
    turned = F.when(o % 37 == 0, F.translate("strand", "+-", "-+")).otherwise(F.col("strand"))
    rows = rows.select(
        F.concat(F.lit("h"), "id").alias("id"), F.when((o % 23 == 0) | (o % 31 == 0) | (o % 37 == 0), "").otherwise(F.col("name")).alias("name"), F.when(o % 31 == 0, "other").otherwise(F.col("type")).alias("type"), "seqid", F.replace(turned, F.lit("."), F.lit("*")).alias("strand"),
        (F.col("start") + F.when(o % 29 == 0, 1).otherwise(0)).alias("start"), "end", "genes", "exons", "cds", o.alias("_o"),
    )
    more = rows.filter("_o % 53 = 0").withColumn("id", F.concat(F.lit("y"), "id")).withColumn("seqid", F.lit("seq-x")).withColumn("name", F.concat(F.lit("x"), "name"))
    rows = rows.unionByName(more)
    pieces = lambda c: rows.select("id", F.inline(c))
    return rows.drop("exons", "cds", "_o"), pieces("exons"), pieces("cds")


def _transcripts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """difference, genes, parts under no transcript, transcripts expected."""
    text, found = _read(spark, sf_dir)
    want, genes, lone = transcripts.expected(found, text.rows, KINDS)
    want = _table(want, "want")
    have = _table(transcripts.held(*gene_models(want)), "have")
    o = _order("id")
    said = want.filter(o % 38 == 0).select(F.concat(F.lit("dropped: ["), "id", F.lit("]")).alias("line"))
    parts = want.filter((o % 82 == 0) & (F.size("below") > 0)).select(F.concat(F.lit("moved a base of "), F.element_at("below", -1)).alias("line"))
    log = said.unionByName(parts)
    return transcripts.difference(want, have, log, cut=lambda df: _table(df, "pairs")), genes, lone, want


_TO = "coalesce(try_cast(regexp_extract(id, '^[a-z]([0-9]+)', 1) AS BIGINT), 1)"


def _stage(i: int, name: str, columns: tuple[str, ...], unique: bool) -> str:
    """One stage of the pairing, after those before it."""
    names = [f'"{c}"' for c in columns]
    by = ", ".join(names)
    ok = " AND ".join(f"{c} IS NOT NULL" for c in names)
    left = "".join(f" AND id NOT IN (SELECT left_id FROM s{k})" for k in range(1, i))
    right = "".join(f" AND id NOT IN (SELECT right_id FROM s{k})" for k in range(1, i))
    side = lambda t, rest: f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY id) AS i, count(*) OVER (PARTITION BY {by}) AS n FROM {t} WHERE {ok}{rest})"
    one = " WHERE a.n = 1 AND b.n = 1" if unique else ""
    return f"s{i} AS MATERIALIZED (SELECT a.id AS left_id, b.id AS right_id, '{name}' AS stage FROM {side('want', left)} a JOIN {side('have', right)} b USING ({by}, i){one})"


_STAGES = ",\n  ".join(_stage(i, *s) for i, s in enumerate(transcripts.STAGES, 1))
_SPANS = "list_sort(list([split_part(x, '-', 1)::BIGINT, split_part(x, '-', 2)::BIGINT]) FILTER (type = '{}'))"

TRANSCRIPT_SQL = f""", part_of AS (SELECT key, type, segs, flags, unnest(string_split(parents, ',')) AS up FROM hard WHERE type IN ('exon', 'CDS')),
  found AS (SELECT *, false AS direct FROM hard WHERE type IN ('mRNA', 'transcript') UNION ALL SELECT *, true FROM hard WHERE type IN ('gene', 'pseudogene') AND key IN (SELECT up FROM part_of)),
  owner AS (SELECT f.key, list_sort(list(DISTINCT h.key)) AS genes FROM (SELECT key, unnest(CASE WHEN direct THEN [key] ELSE string_split(parents, ',') END) AS up FROM found) f JOIN hard h ON h.key = f.up AND h.type IN ('gene', 'pseudogene') GROUP BY f.key),
  piece AS (SELECT up, type, unnest(string_split(segs, ',')) AS x FROM part_of),
  spans AS (SELECT up, {_SPANS.format("exon")} AS exons, {_SPANS.format("CDS")} AS cds FROM piece GROUP BY up),
  under AS (SELECT up, list_sort(list(DISTINCT key)) AS below, string_agg(flags, ',') AS f FROM part_of GROUP BY up),
  want AS (SELECT f.key AS id, type, CASE WHEN type = 'mRNA' THEN 'T'||substr(f.key, 2) ELSE f.key END AS name, seqid, strand, "start", "end", coalesce(genes, []::VARCHAR[]) AS genes, coalesce(exons, []::BIGINT[][]) AS exons, coalesce(cds, []::BIGINT[][]) AS cds,
    coalesce(below, []::VARCHAR[]) AS below, array_to_string(list_sort(list_distinct(list_filter(string_split(flags||','||coalesce(f, ''), ','), lambda x: x <> ''))), ',') AS cases
    FROM found f LEFT JOIN owner USING (key) LEFT JOIN spans ON spans.up = f.key LEFT JOIN under ON under.up = f.key),
  made AS (SELECT 'h'||id AS id, {_TO} AS o, CASE WHEN {_TO} % 23 = 0 OR {_TO} % 31 = 0 OR {_TO} % 37 = 0 THEN NULL ELSE name END AS name, CASE WHEN {_TO} % 31 = 0 THEN 'other' ELSE type END AS type, seqid, CASE WHEN {_TO} % 37 = 0 THEN translate(strand, '+-', '-+') ELSE strand END AS strand,
    "start" + CASE WHEN {_TO} % 29 = 0 THEN 1 ELSE 0 END AS "start", "end", CASE WHEN {_TO} % 47 = 0 THEN ['other'] ELSE genes END AS genes, CASE WHEN {_TO} % 41 = 0 AND len(exons) > 0 THEN list_sort(list_concat([[exons[1][1] - 1, exons[1][2]]], exons[2:])) ELSE exons END AS exons, CASE WHEN {_TO} % 43 = 0 THEN cds[2:] ELSE cds END AS cds
    FROM want WHERE {_TO} % 19 <> 0),
  have AS (SELECT * FROM made UNION ALL SELECT * REPLACE ('y'||id AS id, 'seq-x' AS seqid, 'x'||coalesce(name, '') AS name) FROM made WHERE o % 53 = 0),
  {_STAGES},
  pairs AS ({" UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(1, len(transcripts.STAGES) + 1))}),
  said AS (SELECT string_agg(word, ' ') AS log FROM (SELECT id AS word FROM want WHERE {_TO} % 38 = 0 UNION SELECT below[-1] FROM want WHERE {_TO} % 82 = 0 AND len(below) > 0)),
  diff AS (SELECT w.id, h.id AS held_id, stage, CASE WHEN h.id IS NULL THEN '' ELSE concat_ws(',', CASE WHEN w.seqid <> h.seqid THEN 'seqid' END, CASE WHEN w.strand <> h.strand THEN 'strand' END, CASE WHEN w."start" <> h."start" OR w."end" <> h."end" THEN 'span' END, CASE WHEN w.genes <> h.genes THEN 'gene' END,
    CASE WHEN len(w.exons) > 0 AND w.exons <> h.exons THEN 'exons' END, CASE WHEN w.cds <> h.cds THEN 'cds' END) END AS fields, w.cases, list_concat([w.id], w.below) AS names FROM want w LEFT JOIN pairs ON left_id = w.id LEFT JOIN have h ON h.id = right_id),
  result AS (SELECT id, held_id, stage, CASE WHEN held_id IS NULL THEN 'lost' WHEN fields = '' THEN 'kept' ELSE 'changed' END AS state, CASE WHEN held_id IS NULL OR fields <> '' THEN len(list_filter(names, lambda x: contains(log, x))) > 0 END AS announced, fields, cases FROM diff, said
    UNION ALL SELECT NULL, id, NULL, 'extra', NULL, '', '' FROM have WHERE id NOT IN (SELECT right_id FROM pairs))"""


@query(_with(f"{TRANSCRIPT_SQL} SELECT * FROM result"))
def transcript_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transcript of the text, its partner in a store of gene models, the stage that found it, and what differs."""
    return _transcripts(spark, sf_dir)[0]


@query(_with(f"""{TRANSCRIPT_SQL}, c AS (SELECT *, list_filter([CASE WHEN state <> 'extra' THEN 'truth' END, state, CASE WHEN announced IS NOT NULL THEN state||CASE WHEN announced THEN '_announced' ELSE '_silent' END END], lambda x: x IS NOT NULL) AS s FROM result)
  SELECT 'total' AS scope, '' AS name, counter, count(*) AS n FROM (SELECT unnest(s) AS counter FROM c) GROUP BY counter UNION ALL SELECT 'case', name, counter, count(*) FROM (SELECT name, unnest(s) AS counter FROM (SELECT s, unnest(string_split(cases, ',')) AS name FROM c WHERE cases <> '')) GROUP BY ALL
  UNION ALL SELECT 'field', name, 'n', count(*) FROM (SELECT unnest(string_split(fields, ',')) AS name FROM c WHERE fields <> '') GROUP BY name UNION ALL SELECT 'stage', stage, 'n', count(*) FROM c WHERE stage IS NOT NULL GROUP BY stage
  UNION ALL SELECT 'gene', '', unnest(['truth', 'held', 'absent']), unnest([count(*), count(*) FILTER (key IN (SELECT unnest(genes) FROM have)), count(*) FILTER (key NOT IN (SELECT unnest(genes) FROM have))]) FROM hard WHERE type IN ('gene', 'pseudogene')
  UNION ALL SELECT 'orphan', type, 'n', count(*) FROM hard WHERE type IN ('exon', 'CDS') AND key NOT IN (SELECT key FROM part_of WHERE up IN (SELECT key FROM found)) GROUP BY type"""))
def transcript_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts kept, changed and lost in all and by hard case, the stages that paired them, genes held, and parts under no transcript."""
    found, genes, lone, want = _transcripts(spark, sf_dir)
    have = gene_models(want)[0].select(F.explode("genes").alias("id"))
    orphans = lone.select(F.lit("orphan").alias("scope"), F.col("type").alias("name"), F.lit("n").alias("counter"), "n")
    return transcripts.counters(found).unionByName(transcripts.genes_found(genes, have)).unionByName(orphans)


# -- other stores


def _identified(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The text's rows as records (id), and their links to records of the parents they name."""
    rows = _table(hard_rows(spark, sf_dir), "records").withColumn("record", F.concat(F.lit("r"), "k"))  # both ends of links and the records read them
    up = rows.filter("id is not null").groupBy(F.col("id").alias("_u")).agg(F.min("record").alias("parent"))
    links = rows.select(F.col("record").alias("child"), F.explode(F.array_distinct("parents")).alias("_p")).join(up, F.col("_p") == F.col("_u")).select("parent", "child")
    return rows, links


_KEYED = """, up AS (SELECT key, string_agg(DISTINCT p, ',' ORDER BY p) AS held FROM (SELECT key, unnest(parents) AS p FROM hard_key) WHERE p IN (SELECT id FROM hard_row WHERE id IS NOT NULL) GROUP BY key)"""


@query(_with(f"""{_KEYED} SELECT h.key, seqid, type, strand, "start", "end", nseg, segs, coalesce(held, '') AS parents, attrs, nseg AS records, '' AS flags FROM hard h LEFT JOIN up USING (key)"""))
def attribute_store_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a store of records with JSON attributes and relations by level."""
    rows, links = _identified(spark, sf_dir)
    entry = lambda k, v: F.when(F.size(v) > 0, F.struct(F.lit(k).alias("key"), v.alias("value")))
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    yes = lambda c, v: F.when(F.col(c), F.array(F.lit(v))).otherwise(F.array().cast("array<string>"))
    note = F.transform("note", lambda v, i: F.when(i == F.size("note") - 1, F.concat(v, F.lit("  "))).otherwise(v))
    pairs = F.array_compact(F.array(entry("ID", one("id")), entry("Note", note), entry("Name", one("name")), entry("exception", yes("spliced", "trans-splicing")), entry("Is_circular", yes("circular", "true")), entry("genome", one("genome"))))
    records = rows.select(F.col("record").alias("id"), "seqid", F.col("type").alias("featuretype"), "start", "end", "strand", F.to_json(F.map_from_entries(pairs)).alias("attributes"))
    far = links.select(F.col("child").alias("parent"), F.col("parent").alias("child"), F.lit(2).alias("level"))  # not stated in the text
    return foreign.from_attribute_store(records, links.withColumn("level", F.lit(1)).unionByName(far))


@query(_with(f""", up AS (SELECT key, string_agg(DISTINCT p, ',' ORDER BY p) AS held FROM (SELECT key, unnest(parents) AS p FROM hard_key) WHERE p IN (SELECT id FROM hard_row WHERE id IS NOT NULL AND type <> 'region') GROUP BY key)
  SELECT h.key, seqid, type, replace(strand, '?', '.') AS strand, "start", "end", nseg, segs, coalesce(held, '') AS parents, '' AS attrs, 1::BIGINT AS records, '' AS flags FROM hard h LEFT JOIN up USING (key) WHERE type <> 'region' AND NOT contains(strand, ',') AND NOT contains(flags, 'inverted') AND id_known"""
  .replace(" AND id_known", " AND flags NOT LIKE '%no_id%'")))
def relational_store_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named features of a store with half-open places from 0; sequences are landmarks there."""
    text, found = _read(spark, sf_dir)
    fine = found.filter("flags not like '%inverted%' and strand not like '%,%' and flags not like '%no_id%'").select("key")
    rows, links = _identified(spark, sf_dir)
    number = F.xxhash64("key")
    sides = rows.filter("id is not null").select("record", F.col("id").alias("key"), "seqid", "type", "start", "end", "strand")
    feature = sides.groupBy("key").agg(F.min("type").alias("type")).select(number.alias("feature_id"), F.col("key").alias("uniquename"), "type")
    location = sides.filter("type <> 'region'").select(number.alias("feature_id"), "seqid", (F.col("start") - 1).alias("fmin"), F.col("end").alias("fmax"), F.when(F.col("strand") == "+", 1).when(F.col("strand") == "-", -1).otherwise(0).alias("strand"))
    to = sides.select("record", number.alias("n"))
    edges = links.join(to.select(F.col("record").alias("child"), F.col("n").alias("subject_id")), "child").join(to.select(F.col("record").alias("parent"), F.col("n").alias("object_id")), "parent").select("subject_id", "object_id").distinct()
    return foreign.from_relational_store(feature, location, edges).join(fine, "key", "left_semi")


def ontology_text(spark: SparkSession, sf_dir: str) -> str:
    """A term for each part: a kind of one and in part of another part of a smaller number."""
    p = g.read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    n = lambda c: F.concat(F.lit("X:"), c)
    value = F.concat_ws(
        "\n", F.lit(""), F.when(k % 17 == 0, "[Typedef]").otherwise("[Term]"), F.concat(F.lit("id: "), n(k)), F.when(k % 19 != 0, F.concat(F.lit("name: "), "p_name")), F.concat(F.lit('synonym: "also \\\\"'), k, F.lit('\\\\"" EXACT []')), F.when(k % 2 == 0, F.concat(F.lit('synonym: "even" []'))),
        F.when(k > 1, F.concat(F.lit("is_a: "), n(F.expr("p_partkey div 2")), F.lit(" ! a comment"))), F.when((k > 2) & (k % 5 == 0), F.concat(F.lit("relationship: part_of "), n(F.expr("p_partkey div 3")), F.lit(" ! another"))), F.when(k % 7 == 0, F.concat(F.lit("relationship: has_part "), n(k + 1))),
        F.when(k % 11 == 0, "is_obsolete: true"),
    )
    head = spark.createDataFrame([(-1, "format-version: 1.2"), (0, "id: not in a stanza")], "k long, value string")
    return files.write_lines(head.unionByName(p.select(k.cast("long").alias("k"), value.alias("value"))), files.scratch(spark, "ontology"), "k")


@query("""SELECT 'X:'||p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 17 = 0 THEN 'Typedef' ELSE 'Term' END AS kind, p_partkey % 11 = 0 AS obsolete, 1 + (p_partkey % 2 = 0)::BIGINT AS synonyms FROM part WHERE p_partkey % 19 <> 0""")
def ontology_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of an ontology's text, and how many synonyms each has."""
    terms, _, synonyms = foreign.ontology(spark, ontology_text(spark, sf_dir))
    return terms.join(synonyms.groupBy("id").agg(F.count("*").alias("synonyms")), "id")


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part WHERE p_partkey > 1 AND p_partkey % 19 <> 0 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey > 2 AND p_partkey % 5 = 0 AND p_partkey % 19 <> 0),
  r AS (SELECT a, b, 1::BIGINT AS d FROM e UNION SELECT r.a, e.b, d + 1 FROM r JOIN e ON e.a = r.b) SELECT 'X:'||a AS id, 'X:'||b AS ancestor, min(d) AS depth FROM r GROUP BY a, b""")
def ontology_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each term is or is part of."""
    return foreign.ancestors(foreign.ontology(spark, ontology_text(spark, sf_dir))[1])
