"""URL filters: rules for hosts and paths, and for other pages the trust of their host.

Trust is a personalised PageRank over the links between hosts that starts from pages
that a rule allows; distrust is the same over reversed links, from pages that a rule
blocks, so it reaches those who link to blocked hosts.  Both are pushed together, round
by round: what a host received in a round goes on to its neighbours by DAMPING, in
proportion to the pages that link, until no host holds LEAST_PUSH.  Scores are whole
numbers (UNIT is the weight of a host all of whose pages are seeds), so sums don't
depend on the order of rows.

DataFrame functions alone.  Pages meet hosts once; every table of the rounds has hosts or
links between hosts, of which there are at most as many as pages and links.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import workspace

UNIT = 1_000_000_000
DAMPING = 85  # per cent
LEAST_PUSH = UNIT // 100_000
#: A host is blocked if its distrust is above its trust by more than this.
MARGIN = UNIT // 20

#: The host of a link in the attribute of an a element; relative links stay on their host.
LINK = "(?i)<a\\s[^<>]*?href\\s*=\\s*[\"']?\\s*(?:[a-z]+:)?//([^/?#\"'\\s<>]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str, str]  # host, path, "allow" or "block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first :// and the first of / ? #, in lower case, and the path after it."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_table(pages: DataFrame, rules: Iterable[Rule] | DataFrame) -> DataFrame:
    """rule, rule_host, rule_path, rule_verdict; of equal host and path the block stays."""
    if not isinstance(rules, DataFrame):
        rules = pages.sparkSession.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")
    host = F.translate("host", _UPPER, _LOWER)
    return rules.groupBy(host.alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("rule_verdict")).withColumn("rule", F.concat("rule_host", "rule_path"))


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and its rules, the longest first; of equally long ones that with the longer host."""
    labels = F.split("host", "\\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = hosts.select("host", F.explode(ends).alias("rule_host")).join(rules, "rule_host")
    order = F.struct((-F.length("rule")).alias("a"), (-F.length("rule_host")).alias("b"), "rule", "rule_path", "rule_verdict")
    return found.groupBy("host").agg(F.sort_array(F.collect_list(order)).alias("rules"))  # as many as the list has for the host


def host_links(pages: DataFrame) -> DataFrame:
    """source, target, n: the pages of source that link to target, itself left out."""
    host, _ = host_and_path(F.col("url"))
    targets = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda x: F.translate(x, _UPPER, _LOWER)))
    links = pages.select(host.alias("source"), F.explode(targets).alias("target")).filter("source <> '' and target <> '' and source <> target")
    return links.groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame) -> DataFrame:
    """host, trust, distrust; seeds has host, trust, distrust, and links what host_links gives.

    Each round is a table in the shared folder.  Mass that comes to a host without
    neighbours stays there.
    """
    spark = seeds.sparkSession
    both = links.select(F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to")), F.struct(F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to")))).alias("e"), "n").select("e.*", "n")
    out = both.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    # a host with very many neighbours is split by Spark's join of skewed partitions
    edges = workspace.Table(both.join(out, ["kind", "host"]), "edges")
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("kind"), F.col("trust").alias("v")), F.struct(F.lit("distrust").alias("kind"), F.col("distrust").alias("v")))).alias("s"))
    rounds = [workspace.Table(start.select(F.col("s.kind").alias("kind"), "host", F.expr(f"s.v * {100 - DAMPING} div 100").alias("v")).filter("v > 0"), "trust")]
    while True:
        pushed = rounds[-1].df.filter(F.col("v") >= LEAST_PUSH).join(edges.df, ["kind", "host"])
        share = F.expr(f"v div all * n div 100 * {DAMPING}")
        table = workspace.Table(pushed.select("kind", F.col("to").alias("host"), share.alias("v")).filter("v > 0").groupBy("kind", "host").agg(F.sum("v").alias("v")), "trust")
        rounds.append(table)
        if table.df.isEmpty():
            break
    scores = spark.read.schema(rounds[0].df.schema).parquet(*[t.path for t in rounds]).groupBy("host")
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("v"))), F.lit(0)).alias(kind)
    done = workspace.Table(scores.agg(of("trust"), of("distrust")), "scores")
    for t in (edges, *rounds):
        t.drop()
    return done.df


def judge_urls(pages: DataFrame, rules: Iterable[Rule] | DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust: a row for each row of pages.

    rules are tuples of host, path and verdict, or a table with these columns.  A rule
    fits its host and all hosts that end in a dot and it, if the path starts with the
    rule's; the longest decides.  Pages that no rule fits are blocked if their host's
    distrust is above its trust by more than MARGIN.  A host is a seed by the share of its
    pages that a rule allows or blocks.

    A null url or one without :// has an empty host and path, fits no rule, is no seed and
    is allowed; a null html has no links.  Repeated rows give repeated rows and count as
    pages.  Other columns are ignored.
    """
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", "url", "html")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = rows.select("host").distinct()
    known = workspace.Table(rules_of_hosts(hosts, rule_table(pages, rules)), "host_rules").df
    # a row for each host: Spark broadcasts it only below its own limit, else splits a host with very many pages
    fitting = F.get(F.filter("rules", lambda r: F.startswith("path", r["rule_path"])), F.lit(0))
    ruled = rows.join(known, "host", "left").select("page_id", "host", "path", fitting.alias("_r")).select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.col("_r.rule_verdict").alias("ruled"))
    share = lambda v: F.expr(f"count_if(ruled = '{v}') * {UNIT} div count(*)")
    seeds = ruled.filter("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    scores = propagate(seeds, host_links(pages))
    of = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    verdict = F.coalesce("ruled", F.when(F.col("distrust") - F.col("trust") > MARGIN, "block").otherwise("allow"))
    return ruled.join(scores, "host", "left").select("page_id", "host", "path", "rule", "ruled", of("trust"), of("distrust")).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")
