"""From rows of a file to a checked feature graph.

Everything that is wrong is collected: problems is a table of (stage, rule, subject,
detail); a load refuses if it has rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import scalars, vocabulary
from strandline.operators import hierarchy, segments

PROBLEM = ["stage", "rule", "subject", "detail"]


@dataclass
class Normalised:
    """rows: a row for each segment; features: one for each feature; envelopes: those of
    named features; again: rows that come twice; met: what features find that meet their
    parents; strays: features that don't fit their parent, and how (broken, outside); problems."""

    rows: DataFrame
    features: DataFrame
    envelopes: DataFrame
    again: DataFrame
    met: DataFrame
    settle: Callable[[DataFrame], DataFrame]
    find: Callable[[DataFrame], DataFrame]

    @cached_property
    def strays(self) -> DataFrame:
        return self.settle(self.met)

    @cached_property
    def problems(self) -> DataFrame:
        return self.find(self.strays)

    @property
    def outside(self) -> DataFrame:
        """id, parent_id, start, end, parent_start, parent_end of named features outside their parent."""
        return self.strays.filter("outside is not null").select("outside.*")


def _exception_has(attributes: Column, values: tuple[str, ...]) -> Column:
    text = F.transform(scalars.all_values(attributes, "exception"), lambda v: F.lower(F.replace(v, F.lit("_"), F.lit(" "))))
    hit = F.lit(False)
    for v in values:
        hit = hit | F.exists(text, lambda t: F.contains(t, F.lit(v)))
    return hit


def _has_flag(attributes: Column, names: tuple[str, ...]) -> Column:
    return F.exists(attributes, lambda a: F.lower(a["key"]).isin([n.lower() for n in names])) if names else F.lit(False)


def _problem(df: DataFrame, stage: str, rule: str, subject: str | Column, detail: Column) -> DataFrame:
    return df.select(F.lit(stage).alias("stage"), F.lit(rule).alias("rule"), (F.col(subject) if isinstance(subject, str) else subject).cast("string").alias("subject"), detail.cast("string").alias("detail"))


def normalise(rows: DataFrame, profile, *, id_prefix: str | None = None, cut: Callable[[DataFrame], DataFrame] = lambda df: df, shares: int | None = None) -> Normalised:
    """rows: those of an AnnotationFile.  The prefix goes before IDs and parents.

    Rows are brought together by ID once, as they were read, for all that needs the others of
    their feature; with ``cut``, which writes what it is given, the rules then read narrow columns
    of that table, and only features that may break a rule are brought together again.  What
    follows from other columns is neither sent nor written.  With ``shares`` they are dealt by
    ``share_of`` their ID, so that a share lies together in what is written.
    """
    rows = rows.withColumn("source_id", scalars.prefixed(id_prefix, F.col("source_id")))
    named, alone, by = rows.filter("source_id is not null"), rows.filter("source_id is null"), ["source_id"]
    if shares is not None:
        named, by = named.withColumn("_share", share_of(F.col("source_id"), shares)), ["_share", "source_id"]
    named = _opened(_packed(named).repartition(by[0]))
    named = _of_features(_told(named, profile, id_prefix), list(profile.unique_ids), by).drop("_share")
    alone = _told(alone, profile, id_prefix).withColumn("segment_index", F.lit(0).cast("long")).withColumn("_keeps", F.lit(True))
    usual = F.when(F.col("parent_id").isNull(), F.array().cast("array<string>")).otherwise(F.array("parent_id"))
    table = named.unionByName(alone, allowMissingColumns=True).drop("_own")
    table = cut(table.withColumn("parents", F.when(~F.col("parents").eqNullSafe(usual), F.col("parents"))))
    table = table.withColumn("parents", F.coalesce("parents", usual)).withColumn("stored_attributes", F.when(F.col("_keeps"), _own(F.col("attributes"))).otherwise(F.array().cast("array<struct<key:string,values:array<string>>>")))
    out = table.drop("_trans", "_overlap_ok", "_shared", "_keeps", *_FACTS)
    features = table.filter("segment_index = 0").select("row_id", "source_id", "source_type", "feature_type", "seqid", "parent_id", "linkage_method", F.col("_lo").alias("start"), F.col("_hi").alias("end"))
    envelopes = table.filter("segment_index = 0 and source_id is not null").select(F.col("source_id").alias("id"), "parent_id", F.col("_lo").alias("start"), F.col("_hi").alias("end"), F.col("_n").alias("n_segments"))
    again = table.filter("_tie").groupBy("seqid", "source_id", "start", "end").agg(F.count("*").alias("n")).filter("n > 1")
    return Normalised(out, features.drop("start", "end"), envelopes, again, _met(features), lambda met: _strays(met, features), lambda strays: _problems(table, features, strays, profile))


def share_of(name: Column, shares: int) -> Column:
    """Which of so many shares a name is in."""
    return (F.crc32(name) % shares).cast("int")


def _joined(attributes: Column) -> Column:
    """Attributes as one text: parted by 1F, a key from its values by 1E, values by 1D (hexadecimal)."""
    return F.array_join(F.transform(attributes, lambda a: F.concat_ws("\x1e", a["key"], F.array_join(a["values"], "\x1d"))), "\x1f")


def _parted(text: Column) -> Column:
    one = lambda x: F.struct(F.substring_index(x, "\x1e", 1).alias("key"), F.split(F.substring_index(x, "\x1e", -1), "\x1d").alias("values"))
    return F.when(text == "", F.array().cast("array<struct<key:string,values:array<string>>>")).otherwise(F.transform(F.split(text, "\x1f"), one))


def _packed(rows: DataFrame) -> DataFrame:
    """rows with attributes as a text, which takes less room to send, wherever just the same are made of it."""
    rows = rows.withColumn("_text", _joined(F.col("attributes")))
    same = _parted(F.col("_text")).eqNullSafe(F.col("attributes"))
    return rows.withColumns({"_text": F.when(same, F.col("_text")), "attributes": F.when(~same, F.col("attributes"))})


def _opened(rows: DataFrame) -> DataFrame:
    return rows.withColumn("attributes", F.coalesce("attributes", _parted(F.col("_text")))).drop("_text")


def _own(attributes: Column) -> Column:
    """What is stored of attributes: all but a feature's place in the graph."""
    return F.filter(attributes, lambda x: ~F.lower(x["key"]).isin("id", "parent"))


def _told(rows: DataFrame, profile, id_prefix: str | None) -> DataFrame:
    """rows with what follows from each alone."""
    a = F.col("attributes")
    rows = rows.withColumn("parents", F.transform("parents", lambda p: scalars.prefixed(id_prefix, p)))
    rows = rows.withColumn("parent_id", F.get("parents", F.lit(0))).withColumn("feature_type", vocabulary.canonical(F.col("source_type")))
    stated = scalars.first_value(a, "linkage_method")
    method = F.when(F.col("parent_id").isNotNull(), F.lit("explicit_parent") if profile.states_parents else F.coalesce(stated, F.lit("explicit_parent")))
    rows = rows.withColumn("linkage_method", method)
    trans = _exception_has(a, ("trans-splicing",)) if profile.trans_splicing else F.lit(False)
    rows = rows.withColumn("_trans", trans).withColumn("_overlap_ok", _has_flag(a, profile.overlap_flags) | _exception_has(a, profile.overlap_exceptions))
    shared = F.lit(False)
    if profile.shared_id:
        key, value = profile.shared_id
        shared = F.array_contains(scalars.all_values(a, key), value)
    return rows.withColumn("_shared", shared).withColumn("_own", _own(a))


_FACTS = ("_fields", "_hit", "_tie", "_n_unique", "_all_shared", "_lo", "_hi", "_n")


def _of_features(named: DataFrame, unique_types: list[str], by: list[str]) -> DataFrame:
    """Rows with an ID and what the others of their feature make of them: their place among
    them, whose attributes are stored, the parent of the first in the file, and _FACTS."""
    place = Window.partitionBy(*by).orderBy("start", "end", "row_id")
    w, every = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.partitionBy(*by)
    f = Window.partitionBy(*by).orderBy("row_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    differs = {c: ~F.col(c).eqNullSafe(F.first(c).over(f)) for c in ("seqid", "source_type", "strand", "parent_id")}
    differs["strand"] = differs["strand"] & ~F.col("_trans")
    unique = F.col("source_type").isin(unique_types)
    rows = named.withColumns({"_fields": F.concat_ws(",", *[F.when(d, c) for c, d in differs.items()]), "_parent": F.first("parent_id").over(f)})
    rows = rows.withColumns({
        "segment_index": (F.row_number().over(place) - 1).cast("long"), "_first": F.first("_own").over(w), "_hit": F.max("end").over(place.rowsBetween(Window.unboundedPreceding, -1)) >= F.col("start"),
        "_tie": (F.lag("start").over(place) == F.col("start")) & (F.lag("end").over(place) == F.col("end")),
    })
    rows = rows.withColumns({
        "_hit": F.max("_hit").over(every), "_tie": F.max("_tie").over(every), "_n_unique": F.count_if(unique).over(every), "_all_shared": F.min(F.when(unique, F.col("_shared"))).over(every), "_lo": F.min("start").over(every), "_hi": F.max("end").over(every),
        "_n": F.count("*").over(every),
    })
    return rows.withColumn("_keeps", (F.col("segment_index") == 0) | ~F.col("_own").eqNullSafe(F.col("_first"))).withColumn("parent_id", F.col("_parent")).drop("_first", "_parent")


_KIN = ["row_id", "source_id", "seqid", "feature_type", "parent_id", "start", "end"]


def _parents(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features as parents: those of types that may be one, and those of types that no rule has as one."""
    parents = features.filter("source_id is not null").select(F.col("source_id").alias("_pid"), F.col("seqid").alias("_p_seqid"), F.col("feature_type").alias("parent_type"), F.col("start").alias("parent_start"), F.col("end").alias("parent_end"))
    leaf = F.coalesce(F.col("parent_type").isin(vocabulary.LEAVES), F.lit(False))
    return parents.filter(~leaf), parents.filter(leaf)


def _met(features: DataFrame) -> DataFrame:
    """(broken, outside, lone) of features that don't fit their parent: the rules they break, both
    places where they lie outside it, and _KIN of those that aren't under one that may be a parent.

    A feature meets its parent once for all of this; a feature is once among features.
    """
    return _judged(features.filter("parent_id is not null").select(*_KIN).join(_parents(features)[0], F.col("parent_id") == F.col("_pid"), "left"))


def _strays(met: DataFrame, features: DataFrame) -> DataFrame:
    """(broken, outside) of features that don't fit their parent; those under none of the types that
    may be parents, few as a rule, are looked for among the others."""
    lone = met.filter("lone is not null").select("lone.*")
    asked = _parents(features)[1].join(lone.select(F.col("parent_id").alias("_asked")), F.col("_pid") == F.col("_asked"), "left_semi")
    return met.filter("lone is null").drop("lone").unionByName(_judged(lone.join(asked, F.col("parent_id") == F.col("_pid"), "left")).drop("lone"))


def _judged(kin: DataFrame) -> DataFrame:
    """(broken, outside, lone) of those that don't fit among features with their parents; without any, lone is not null."""
    one = lambda stage, rule, subject, detail: F.struct(F.lit(stage).alias("stage"), F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))
    subject, held = F.col("source_id"), F.col("_pid").isNotNull()
    broken = F.array_compact(F.array(
        F.when(~held, one("parents", "parent not in file", F.coalesce("source_id", F.col("row_id").cast("string")), F.col("parent_id"))),
        F.when(held & (F.col("seqid") != F.col("_p_seqid")), one("hierarchy", "other sequence than parent", subject, F.col("parent_id"))),
        F.when(held & ~vocabulary.may_have_parent(F.col("feature_type"), F.col("parent_type")), one("hierarchy", "parent type", subject, F.concat_ws(" under ", "feature_type", "parent_type"))),
    ))
    beyond = held & subject.isNotNull() & ((F.col("start") < F.col("parent_start")) | (F.col("end") > F.col("parent_end")))
    place = F.struct(subject.alias("id"), "parent_id", "start", "end", "parent_start", "parent_end")
    return kin.select(broken.alias("broken"), F.when(beyond, place).alias("outside"), F.when(~held, F.struct(*_KIN)).alias("lone")).filter((F.size("broken") > 0) | F.col("outside").isNotNull())


def _problems(table: DataFrame, features: DataFrame, strays: DataFrame, profile) -> DataFrame:
    found = []
    if not profile.anonymous:
        found.append(_problem(table.filter("source_id is null"), "group", "anonymous row", "row_id", F.col("source_type")))
    found.append(_problem(table.filter(F.size("parents") > 1), "group", "several parents", F.coalesce("source_id", F.col("row_id").cast("string")), F.array_join("parents", ",")))
    found.append(_problem(table.filter("_n_unique > 1 and not _all_shared and segment_index = 0"), "group", "repeated ID", "source_id", F.col("_n_unique")))
    found.append(_problem(table.filter("_fields <> ''"), "group", "rows differ", "source_id", F.concat_ws(" ", F.lit("row"), "row_id", F.col("_fields"))))
    later = F.when(F.col("a.row_id") > F.col("b.row_id"), F.col("a._overlap_ok")).otherwise(F.col("b._overlap_ok"))
    opposite = (F.col("a._trans") | F.col("b._trans")) & (F.col("a.strand") != F.col("b.strand"))
    suspects = table.filter("_hit").select("source_id", "row_id", "start", "end", "strand", "_overlap_ok", "_trans")
    found.append(_problem(segments.overlapping_segments(suspects, later | opposite), "group", "rows overlap", "source_id", F.concat_ws(" ", "row_a", "row_b")))
    unknown = F.col("linkage_method").isNotNull() & ~F.col("linkage_method").isin(vocabulary.LINKAGE)
    found.append(_problem(features.filter(unknown), "parents", "unknown linkage", "source_id", F.col("linkage_method")))
    found.append(strays.select(F.explode("broken").alias("_b")).select("_b.*"))
    regions = table.select("seqid", F.explode(scalars.all_values(F.col("attributes"), "genome")).alias("genome"))
    found.append(_problem(hierarchy.transcript_bypass(features, hierarchy.organellar_sequences(regions)), "hierarchy", "no transcript", "source_id", F.col("parent_id")))
    return reduce(DataFrame.unionByName, found)
