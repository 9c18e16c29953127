"""The store: Parquet tables of each assembly, published in one step.

root/_catalog/<revision>.json what is loaded: id, label, folder; the last revision holds
root/assemblies/<slug>-<id>/  sequence, source_file, feature, attribute, protein,
                              annotation, annotation_run (Parquet) and manifest.json;
                              by_name has the features again, by the checksum of their
                              name, and by_parent names by that of their parent
root/functional/<id>/         annotation and annotation_run of a table attached later
root/_work/<id>.json          what a writer is about, for as long as it is

A load is written under root/.staging, counted again from what was stored, renamed,
and then named in the catalog; whatever fails before that leaves the catalog as it was.
A revision is published by a rename that fails where another writer was first.  Folders
are deleted only after a revision that doesn't name them, so a writer killed at any point
leaves a catalog that names nothing that is gone; ``recover`` clears what it left.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import scalars, vocabulary
from strandline.functions.bins import bin_of, overlapping
from strandline.operators import census, envelope, export_rows, functional, graph, hierarchy, intervals, load_checks, reconcile, segments
from strandline.operators.normalise import Normalised, normalise, share_of
from strandline.sources import bgzf, cross_format, fasta, files, functional_files, genbank, gff3, profiles, recount
from strandline.sources.config import OrganismConfig
from strandline.sources.intents import Intent, Journal
from strandline.sources.published import protein_fasta

LOOKUP_MOST = 1000  # features of an answer that is found by name; a larger one is found by joins
BUCKET_ROWS = 50_000
BUCKETS_MOST = 4096
TABLES = ["sequence", "source_file", "feature", "attribute", "protein", "annotation", "annotation_run"]
ADDED = ["annotation", "annotation_run"]  # tables that attached runs add to
SCHEMAS = {
    "annotation": "feature_id long, query_id string, analysis string, accession string, description string, protein_start int, protein_end int, score double, evalue double, run string",
    "annotation_run": "run string, path string, tool string, sha256 string, queries long, matched long, unmatched long, hits long",
    "protein": "gene string, protein string",
}
# Types of two formats that name one family.
FAMILIES = [("gene", ["gene", "pseudogene"]), ("mRNA", ["mrna", "transcript"]), ("CDS", ["cds"]), ("tRNA", ["trna"]), ("rRNA", ["rrna"]), ("ncRNA", ["ncrna", "lnc_rna", "snrna", "snorna"])]
VERSION = "1"


class Refused(ValueError):
    """A load or question that the store refuses, with what was found."""


@dataclass
class LoadReport:
    assembly_id: int
    folder: str
    features: int
    rows: int
    repairs: int
    warnings: list[str] = field(default_factory=list)
    tiers: list[dict] = field(default_factory=list)


def _show(problems: DataFrame, n: int = 10) -> tuple[int, str]:
    total = problems.count()
    if not total:
        return 0, ""
    first = problems.orderBy(*problems.columns).limit(n).collect()
    text = "; ".join(" ".join(str(v) for v in r if v is not None) for r in first)
    return total, text + (f"; {total - n} more" if total > n else "")


class Warehouse:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.journal = Journal(spark, self.root)

    # -- catalog ---------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, root: str, *, force: bool = False) -> Warehouse:
        w = cls(spark, root)
        if w._revision():
            if not force:
                raise Refused(f"{root} is a store already")
            files.remove(spark, w.root)
        w._publish({"revision": 0, "vocabulary_version": vocabulary.VERSION, "vocabulary_hash": vocabulary.content_hash(), "store_id": uuid.uuid4().hex, "next_id": 1, "assemblies": []})
        return w

    def _revision(self) -> int:
        return max((int(n.split(".")[0]) for n in files.list_names(self.spark, f"{self.root}/_catalog") if n.endswith(".json")), default=0)

    def _publish(self, catalog: dict) -> None:
        """The revision after the one that this catalog was read from."""
        n = catalog["revision"] + 1
        aside = f"{self.root}/.catalog-{uuid.uuid4().hex}"
        files.write_text(self.spark, aside, json.dumps(catalog | {"revision": n}, indent=1))
        try:
            files.rename(self.spark, aside, f"{self.root}/_catalog/{n:08d}.json")
        except Exception as e:
            files.remove(self.spark, aside)
            if self._revision() >= n:
                raise Refused("another writer changed the store meanwhile") from e
            raise

    def catalog(self) -> dict:
        n = self._revision()
        if not n:
            raise Refused(f"{self.root} is no store")
        c = json.loads(files.read_bytes(self.spark, f"{self.root}/_catalog/{n:08d}.json"))
        if c["vocabulary_hash"] != vocabulary.content_hash():
            raise Refused("the store was made with another vocabulary")
        return c

    def _assembly(self, assembly_id: int) -> dict:
        for a in self.catalog()["assemblies"]:
            if a["assembly_id"] == assembly_id:
                return a
        raise Refused(f"no assembly {assembly_id}")

    def table(self, assembly_id: int, name: str) -> DataFrame:
        entry = self._assembly(assembly_id)
        folders = [entry["folder"], *(entry.get("functional", []) if name in ADDED else [])]
        return self.spark.read.parquet(*[f"{self.root}/{f}/{name}" for f in folders])

    def manifest(self, assembly_id: int) -> dict:
        return json.loads(files.read_bytes(self.spark, f"{self.root}/{self._assembly(assembly_id)['folder']}/manifest.json"))

    # -- interrupted work ----------------------------------------------------------

    def _named(self, catalog: dict) -> set[str]:
        """The folders that the catalog names."""
        return {f for a in catalog["assemblies"] for f in (a["folder"], *a.get("functional", []))}

    def recover(self, *, fence: bool = False) -> list[dict]:
        """Clears what killed writers left, and says what: kind, label, started_at, outcome.

        Work whose revision was published is finished, other work undone.  Work that
        builds on the last revision may be that of a writer that lives; with fence a
        revision of the same content is published first, after which it can't be published.
        """
        catalog = self.catalog()
        if fence and self.journal.open():
            self._publish(catalog)
            catalog = self.catalog()
        named = self._named(catalog)
        if fence:
            self.journal.clear_asides()
        stale = [i for i in self.journal.open() if i.revision < catalog["revision"]]
        return [{"kind": i.kind, "label": i.label, "started_at": i.started_at, "outcome": self.journal.clear(i, named)} for i in stale]

    def _work(self, intent: Intent, make, catalog_of) -> list[dict]:
        """Makes the intent's folder in staging by make(folder), puts it in place, publishes
        catalog_of() and deletes what the intent says; gives what recover cleared after that.

        Whatever fails before the catalog is published is taken back.
        """
        staging = f"{self.root}/{intent.staging}"
        self.journal.begin(intent)
        try:
            if intent.makes:
                make(staging)
                files.rename(self.spark, staging, f"{self.root}/{intent.makes[0]}")
            self._publish(catalog_of())
        except BaseException:
            if not set(intent.makes) & self._named(self.catalog()):  # else the revision is there, whatever was reported
                files.remove(self.spark, staging)
                for f in intent.makes:
                    files.remove(self.spark, f"{self.root}/{f}")
                self.journal.end(intent)
            raise
        for f in intent.deletes:
            files.remove(self.spark, f"{self.root}/{f}")
        self.journal.end(intent)
        return self.recover()

    # -- load --------------------------------------------------------------------

    def load(self, config: OrganismConfig, *, repair_envelopes: bool = False, strict_vocabulary: bool = False, force: bool = False) -> LoadReport:
        """Reads, checks and stores an assembly; nothing is kept of one that is refused."""
        spark, catalog = self.spark, self.catalog()
        same = [a for a in catalog["assemblies"] if a["label"] == config.label]
        if same and not force:
            raise Refused(f"{config.label} is loaded already, as assembly {same[0]['assembly_id']}")
        paths = [x.path for x in config.annotations]
        if len(set(paths)) < len(paths):
            raise Refused("a file is named twice")
        assembly_id = same[0]["assembly_id"] if same else catalog["next_id"]
        folder = f"assemblies/{scalars_slug(config.label)}-{uuid.uuid4().hex[:8]}"
        intent = Intent("load", config.label, catalog["revision"], [folder], [f for a in same for f in (a["folder"], *a.get("functional", []))])
        made: list[LoadReport] = []

        def named() -> dict:
            entry = {"assembly_id": assembly_id, "label": config.label, "folder": folder, "organism": f"{config.genus} {config.species}", "strain": config.strain, "loaded_at": datetime.now(UTC).isoformat(timespec="seconds"), "manifest_sha256": self._manifest_sha256(folder)}
            kept = [a for a in catalog["assemblies"] if a["assembly_id"] != assembly_id]
            return catalog | {"assemblies": [*kept, entry], "next_id": max(catalog["next_id"], assembly_id + 1), "organisms": _upserted(catalog.get("organisms", []), config)}

        cleared = self._work(intent, lambda staging: made.append(self._stage(config, assembly_id, staging, repair_envelopes, strict_vocabulary)), named)
        report = made[0]
        report.folder = folder
        report.warnings += [f"an interrupted {c['kind']} of {c['label']}, begun at {c['started_at']}, was {c['outcome']}" for c in cleared]
        return report

    def _manifest_sha256(self, folder: str) -> str:
        return hashlib.sha256(files.read_bytes(self.spark, f"{self.root}/{folder}/manifest.json")).hexdigest()

    def register(self, config: OrganismConfig, *, force: bool = False) -> LoadReport:
        """An assembly of sequences alone: its annotation may be loaded later, with force."""
        if not config.fasta:
            raise Refused("an assembly is registered by its sequence file")
        return self.load(replace(config, annotations=(), functional=()), force=force)

    def organisms(self) -> DataFrame:
        """genus, species, ncbi_taxon_id, common_name, strain: each once, whatever was loaded of it."""
        rows = [(o["genus"], o["species"], o["ncbi_taxon_id"], o["common_name"], s) for o in self.catalog().get("organisms", []) for s in o["strains"]]
        return self.spark.createDataFrame(rows, "genus string, species string, ncbi_taxon_id int, common_name string, strain string")

    def _read(self, path: str, linkage: str, repair: bool) -> gff3.AnnotationFile:
        if gff3.looks_like_genbank(self.spark, path):
            return genbank.read(self.spark, path, linkage=linkage)
        return gff3.read(self.spark, path, tolerate_inverted=repair)

    def _stage(self, config: OrganismConfig, assembly_id: int, staging: str, repair: bool, strict: bool) -> LoadReport:
        spark, warnings, all_rows, source_files, read, proteins_found, repairs = self.spark, [], [], [], [], [], 0
        for i, entry in enumerate(config.annotations, 1):
            f = self._read(entry.path, entry.linkage, repair)
            f.rows = graph._cut(f.rows)  # the text is parsed once for rows, once for problems
            n, text = _show(f.problems)
            if n:
                raise Refused(f"{entry.path}: {n} problems in the text: {text}")
            profile, confidence, evidence = profiles.detect(f, entry.dialect)
            shares = _buckets(f.rows.count())
            found = normalise(f.rows, profile, id_prefix=entry.id_prefix, cut=graph._cut, shares=shares)
            found.met = graph._cut(found.met)  # features meet their parents once for rules and places
            n, text = _show(found.problems)
            if n:
                raise Refused(f"{entry.path}: {n} problems: {text}")
            rows = found.rows.withColumn("file_id", F.lit(i).cast("int"))
            n, text = _show(found.again)
            if n:
                raise Refused(f"{entry.path}: {n} rows come twice: {text}")
            if profile.extract:
                said = profile.extract(f.comments).withColumn("gene", scalars.prefixed(entry.id_prefix, F.col("gene")))
                n, text = _show(census.declared_proteins(rows, said, scalars.exemption(F.col("attributes"), vocabulary.EXEMPTIONS, vocabulary.FALSE_VALUES).isNotNull()))
                if n:
                    raise Refused(f"{entry.path}: {n} declared proteins don't fit their coding rows: {text}")
                proteins_found.append(said)
            if config.ncbi_taxon_id is not None:
                taxa = rows.filter("source_type = 'region'").select(F.explode(F.filter(scalars.all_values(F.col("attributes"), "Dbxref"), lambda v: v.rlike("^taxon:[0-9]+$"))).alias("t")).distinct()
                other = sorted(r.t[6:] for r in taxa.limit(20).collect() if int(r.t[6:]) != config.ncbi_taxon_id)
                if other:
                    warnings.append(f"{entry.path}: the file declares taxon {', '.join(other)}, the configuration {config.ncbi_taxon_id}, which is used")
            if profile.expected:
                types = spark.createDataFrame([(t,) for t in profile.expected], "source_type string")
                missing = [r[0] for r in types.join(rows.select("source_type").distinct(), "source_type", "left_anti").collect()]
                if missing:
                    warnings.append(f"{entry.path}: no {', '.join(sorted(missing))}")
            known = spark.createDataFrame([(t,) for t in [*vocabulary.CANONICAL, *vocabulary.SYNONYM_OF]], "source_type string")
            unknown = rows.select("source_type").distinct().join(known, "source_type", "left_anti")
            if strict and not unknown.isEmpty():
                raise Refused(f"{entry.path}: undeclared types: {', '.join(sorted(r[0] for r in unknown.limit(20).collect()))}")
            rows, changed, explained = self._envelopes(rows, found, f.directives, entry.path, repair)
            repairs += changed
            warnings += [f"{entry.path}: {x}" for x in explained]
            all_rows.append(rows)
            read.append((i, entry, f, profile))
            source_files.append((i, entry.path, files.digest(spark, entry.path), f.format, profile.name, confidence, evidence, entry.id_prefix))
        if not all_rows and not config.fasta:
            raise Refused("no annotation file")
        rows = reduce(DataFrame.unionByName, all_rows) if all_rows else self._no_rows()
        n, text = _show(load_checks.cross_file_collisions(rows.withColumnRenamed("file_id", "file"))) if len(all_rows) > 1 else (0, "")
        if n:
            raise Refused(f"{n} IDs in more than one file: {text}")
        sequences = graph._cut(self._sequences(config, read, rows))  # of known size, so rows needn't be dealt to meet them
        bad = load_checks.unknown_sequences(rows, sequences)
        n, text = _show(bad)
        if n:
            raise Refused(f"{n} sequences are not in the assembly: {text}")
        placed = rows.join(sequences.select("seqid", "length", "circular"), "seqid").withColumn("outcome", intervals.bounds_outcome(F.col("start"), F.col("end"), F.col("length"), F.col("circular")))
        outcomes = {r.outcome: r["count"] for r in placed.groupBy("outcome").count().collect()}
        if "refused" in outcomes:
            n, text = _show(placed.filter("outcome = 'refused'").select("seqid", "start", "end"))
            raise Refused(f"{n} rows lie outside their sequence: {text}")
        if n := outcomes.get("wrapped"):
            warnings.append(f"{n} rows lie past the end of a circular sequence")
        for _, entry, f, _ in read if config.fasta else []:
            off = f.directives.join(sequences.select("seqid", "length"), "seqid").filter("end <> length").select("seqid", "end", "length")
            n, text = _show(off)
            if n:
                warnings.append(f"{entry.path}: {n} declared lengths differ from the sequences: {text}")
        dealt = len(all_rows) == 1 and not repair  # rows lie by the shares of their names, as normalise wrote them
        self._write(staging, assembly_id, rows, sequences, source_files, dealt)
        proteins = reduce(DataFrame.unionByName, proteins_found) if proteins_found else spark.createDataFrame([], SCHEMAS["protein"])
        proteins.write.parquet(f"{staging}/protein")
        for entry in config.functional:
            self._attach(staging, staging, spark.read.parquet(f"{staging}/annotation_run"), entry.path, entry.tool, entry.minimum_match_rate)
        tiers = self._check(staging, read)
        if any(t["outcome"] == "FAIL" for t in tiers):
            raise Refused(f"what was stored is not what was read: {[t for t in tiers if t['outcome'] == 'FAIL']}")
        feature = spark.read.parquet(f"{staging}/feature")
        total = feature.agg(F.count_if(F.col("segment_index") == 0).alias("f"), F.count("*").alias("n")).first()  # a feature has one first row
        manifest = {"assembly_id": assembly_id, "label": config.label, "store_version": VERSION, "vocabulary_hash": vocabulary.content_hash(), "features": total.f, "rows": total.n, "repairs": repairs, "warnings": warnings, "tiers": tiers, "files": [list(x) for x in source_files], "fasta": [config.fasta, files.digest(spark, config.fasta)] if config.fasta else None}
        files.write_text(spark, f"{staging}/manifest.json", json.dumps(manifest, indent=1))
        return LoadReport(assembly_id, "", total.f, total.n, repairs, warnings, tiers)

    def _no_rows(self) -> DataFrame:
        empty = self.spark.createDataFrame([], f"row_id long, seqid string, program string, source_type string, start long, end long, score double, strand string, phase long, inverted boolean, attributes {gff3.ATTRIBUTES}, source_id string, parents array<string>")
        return normalise(empty, profiles.PROFILES[1]).rows.withColumn("file_id", F.lit(0).cast("int"))

    def _envelopes(self, rows: DataFrame, found: Normalised, directives: DataFrame, path: str, repair: bool) -> tuple[DataFrame, int, list[str]]:
        """(rows, repairs, what is explained) after the envelope policy: a child outside its
        parent is refused, or the parent widened.

        What the origin of a circle explains is stored as written and named: one of the two
        runs past the length of a circular sequence, and one is trans-spliced.
        """
        trans = F.exists(scalars.all_values(F.col("attributes"), "exception"), lambda v: F.contains(F.replace(F.lower(v), F.lit("_"), F.lit(" ")), F.lit("trans-splicing")))
        spliced = rows.filter(trans).select(F.col("source_id").alias("_x")).distinct()
        circle = rows.filter("source_type = 'region'").filter(F.lower(scalars.first_value(F.col("attributes"), "Is_circular")) == "true").groupBy("seqid").agg(F.max("end").alias("length"))
        declared = directives.join(circle.select("seqid"), "seqid", "left_semi").groupBy("seqid").agg(F.max("end").alias("declared"))
        circle = circle.join(declared, "seqid", "left").select(F.col("seqid").alias("_seq"), F.coalesce("declared", "length").alias("length"))
        place = rows.filter("source_id is not null").groupBy(F.col("source_id").alias("_p")).agg(F.min("seqid").alias("seqid"))

        def judged(v: DataFrame) -> DataFrame:
            """Children outside their parent, and whether the origin explains it."""
            if v.isEmpty():
                return v.withColumn("explained", F.lit(False))
            v = v.join(place, F.col("parent_id") == F.col("_p")).join(circle, F.col("seqid") == F.col("_seq"), "left")
            v = v.join(spliced, (F.col("id") == F.col("_x")), "left").withColumn("_child", F.col("_x").isNotNull()).drop("_x")
            v = v.join(spliced, (F.col("parent_id") == F.col("_x")), "left").withColumn("_parent", F.col("_x").isNotNull()).drop("_x")
            past = F.coalesce(F.greatest("end", "parent_end") > F.col("length"), F.lit(False))
            return v.select("id", "parent_id", "start", "end", "parent_start", "parent_end", (past & (F.col("_child") | F.col("_parent"))).alias("explained"))

        if not repair:
            outside = graph._cut(judged(found.outside))
            n, text = _show(outside.filter("not explained").drop("explained"))
            if n:
                raise Refused(f"{path}: {n} features lie outside their parent: {text}")
            n, text = _show(outside.filter("explained").drop("explained"))
            return rows, 0, [f"{n} features cross the origin of a circular sequence: {text}"] if n else []
        fixed = graph._cut(envelope.repair(found.envelopes).filter("start <> old_start or end <> old_end").select(F.col("id").alias("_id"), F.col("start").alias("_lo"), F.col("end").alias("_hi")))
        rows = rows.join(fixed, F.col("source_id") == F.col("_id"), "left")
        rows = rows.withColumn("start", F.coalesce("_lo", "start")).withColumn("end", F.coalesce("_hi", "end")).drop("_id", "_lo", "_hi")
        n, text = _show(rows.filter("start > end").select("source_id", "row_id"))
        if n:
            raise Refused(f"{path}: {n} inverted rows that no child explains: {text}")
        return rows, fixed.count(), []

    def _sequences(self, config: OrganismConfig, read: list, rows: DataFrame) -> DataFrame:
        circular = rows.filter("source_type = 'region'").filter(F.lower(scalars.first_value(F.col("attributes"), "Is_circular")) == "true").select("seqid").distinct().withColumn("circular", F.lit(True))
        if config.fasta:
            seqs, problems = fasta.read_sequences(self.spark, config.fasta)
            n, text = _show(problems)
            if n:
                raise Refused(f"{config.fasta}: {text}")
        else:
            declared = reduce(DataFrame.unionByName, [f.directives.select("seqid", F.col("end").alias("length")) for _, _, f, _ in read])
            seen = rows.groupBy("seqid").agg(F.max("end").alias("length"))
            seqs = declared.groupBy("seqid").agg(F.max("length").alias("length"))
            seqs = seqs.unionByName(seen.join(seqs.select("seqid"), "seqid", "left_anti")).withColumn("ordinal", F.dense_rank().over(Window.orderBy("seqid")).cast("long"))  # a row for each sequence
        return seqs.join(circular, "seqid", "left").select("seqid", "length", "ordinal", F.coalesce("circular", F.lit(False)).alias("circular"))

    def _write(self, staging: str, assembly_id: int, rows: DataFrame, sequences: DataFrame, source_files: list[tuple], dealt: bool) -> None:
        spark = self.spark
        sequences.write.parquet(f"{staging}/sequence")
        spark.createDataFrame(source_files, "file_id int, path string, sha256 string, format string, dialect string, confidence string, evidence string, id_prefix string").coalesce(1).write.parquet(f"{staging}/source_file")
        key = lambda row: F.col("file_id").cast("long") * (1 << 40) + F.col(row)
        first = rows.filter("segment_index = 0 and source_id is not null")
        ruled = F.coalesce(F.col("feature_type").isin(list(vocabulary.PARENTS)), F.lit(False))
        if rows.filter(F.col("parent_id").isNotNull() & ~ruled).isEmpty():  # no problems: no parent is of another type than the rules say
            first = first.filter(~F.col("feature_type").isin(vocabulary.LEAVES))
        first = first.select(F.col("source_id").alias("_p"), F.col("row_id").alias("_parent_row"), F.col("file_id").alias("_f"))
        kept = rows.select("row_id", "file_id", "seqid", "source_id", "source_type", "start", "end", "strand", "phase", "score", "segment_index", "parent_id", "linkage_method", "program")
        under = kept.filter("parent_id is not null").join(first, (F.col("parent_id") == F.col("_p")) & (F.col("file_id") == F.col("_f")), "left").drop("_p", "_f")
        # near rows lie together, so statistics of row groups prune regions; what follows from other columns is made there
        near = under.unionByName(kept.filter("parent_id is null"), allowMissingColumns=True).repartitionByRange("seqid", "start")
        stored = near.select(
            key("row_id").alias("feature_id"), F.lit(assembly_id).cast("int").alias("assembly_id"), "seqid", "file_id", "source_id", "source_type", vocabulary.canonical(F.col("source_type")).alias("feature_type"), "start", "end", "strand",
            "phase", "score", "segment_index", "parent_id", key("_parent_row").alias("parent_feature_id"), "linkage_method", "program", F.col("row_id").alias("line"), bin_of(F.col("start"), F.col("end")).alias("bin"),
        )
        stored.sortWithinPartitions("seqid", "start").write.parquet(f"{staging}/feature", compression="zstd")
        feature = spark.read.parquet(f"{staging}/feature")
        n = _buckets(feature.count())
        shared = lambda df, c: df.withColumn("bucket", share_of(F.col(c), n))
        placed = lambda df, c: shared(df, c).repartition("bucket").sortWithinPartitions("bucket", c)
        told = lambda df: df.select(_name().alias("name"), "feature_id", "seqid", "source_type", "start", "end", "strand", "phase", "parent_id")
        if dealt:
            named = rows.withColumn("feature_id", key("row_id"))
            near = told(named.filter("source_id is not null"))
            lone = told(named.filter("source_id is null"))
            by_name = shared(near, "name").unionByName(shared(lone, "name").repartition("bucket")).sortWithinPartitions("bucket", "name")
        else:
            by_name = placed(told(feature), "name")
        by_name.write.partitionBy("bucket").parquet(f"{staging}/by_name", compression="zstd")
        kids = feature.filter("parent_id is not null and segment_index = 0").select("parent_id", _name().alias("name"))  # the rows of a feature have one parent
        placed(kids, "parent_id").write.partitionBy("bucket").parquet(f"{staging}/by_parent", compression="zstd")
        files.write_text(spark, f"{staging}/buckets.json", json.dumps(n))
        attributes = rows.select(key("row_id").alias("feature_id"), F.posexplode("stored_attributes").alias("position", "a")).filter("a.key <> 'linkage_method'").select("feature_id", "position", "a.key", F.posexplode("a.values").alias("ordinal", "value"))
        attributes.write.parquet(f"{staging}/attribute", compression="zstd")
        for t in ADDED:
            spark.createDataFrame([], SCHEMAS[t]).write.parquet(f"{staging}/{t}")

    def _attach(self, folder: str, out: str, runs: DataFrame, path: str, tool: str | None, minimum: float) -> dict:
        """Matches a functional table with the features in folder and adds it to the tables in out."""
        spark = self.spark
        if not runs.filter(F.col("path") == path).isEmpty():
            raise Refused(f"{path} is attached already")
        tool, hits, queries = functional_files.read(spark, path, tool)
        feature = spark.read.parquet(f"{folder}/feature").filter(F.col("segment_index") == 0).filter(F.col("feature_type").isin(functional.LOOKUP_TYPES))
        attribute = spark.read.parquet(f"{folder}/attribute").filter(F.col("key").isin(functional.LOOKUP_ATTRIBUTES)).select("feature_id", F.col("value").alias("name"))
        names = feature.select("feature_id", F.col("source_id").alias("name")).unionByName(attribute.join(feature.select("feature_id"), "feature_id", "left_semi"))
        resolved = graph._cut(functional.resolve(queries, functional.identifier_index(names)))
        ambiguous, text = _show(resolved.filter("n > 1").select("query_id", "n"))
        if ambiguous:
            raise Refused(f"{path}: {ambiguous} queries name more than one feature: {text}")
        rate = functional.match_rate(resolved).first()
        if rate.rate < minimum:
            _, text = _show(resolved.filter("n = 0").select("query_id"), 20)
            raise Refused(f"{path}: {rate.matched} of {rate.queries} queries match, fewer than {minimum:.0%}: {text}")
        run = uuid.uuid4().hex
        named = hits.join(resolved.filter("n = 1").select("query_id", "feature_id"), "query_id")
        kept = functional.deduplicated(named, [F.col("line"), F.col("turn")]).select("feature_id", "query_id", "analysis", "accession", "description", "protein_start", "protein_end", "score", "evalue", F.lit(run).alias("run"))
        kept.write.mode("append").parquet(f"{out}/annotation")
        n = spark.read.parquet(f"{out}/annotation").filter(F.col("run") == run).count()
        row = (run, path, tool, files.digest(spark, path), rate.queries, rate.matched, rate.unmatched, n)
        spark.createDataFrame([row], SCHEMAS["annotation_run"]).coalesce(1).write.mode("append").parquet(f"{out}/annotation_run")
        return {"queries": rate.queries, "matched": rate.matched, "unmatched": rate.unmatched, "hits": n, "rate": rate.rate}

    def attach_functional(self, assembly_id: int, path: str, *, tool: str | None = None, minimum_match_rate: float = 1.0) -> dict:
        """Adds a functional table to an assembly that is loaded: its rows lie in a folder of their
        own, which the catalog's next revision names."""
        catalog, entry = self.catalog(), self._assembly(assembly_id)
        folder, report = f"functional/{uuid.uuid4().hex}", {}

        def named() -> dict:
            return catalog | {"assemblies": [a | {"functional": [*a.get("functional", []), folder]} if a["assembly_id"] == assembly_id else a for a in catalog["assemblies"]]}

        self._work(
            Intent("attach", entry["label"], catalog["revision"], [folder]),
            lambda staging: report.update(self._attach(f"{self.root}/{entry['folder']}", staging, self.table(assembly_id, "annotation_run"), path, tool, minimum_match_rate)), named,
        )
        return report

    # -- verification --------------------------------------------------------------

    def _check(self, folder: str, read: list) -> list[dict]:
        """Tiers of a staged load, from the text and from what was stored of it."""
        out, stored = [], _by_file(self.spark.read.parquet(f"{folder}/feature"))
        for i, entry, f, _ in read:
            out += _tiers(self._naive(entry.path, f.format), stored.get(i, []), entry.path, f.format)
        return out

    def _naive(self, path: str, format: str) -> DataFrame:
        text = files.lines(self.spark, path)
        if format == "genbank":
            return recount.count_genbank(text)
        end = text.filter(F.startswith("value", F.lit("##FASTA"))).agg(F.min("line")).first()[0]
        return recount.count_lines(text if end is None else text.filter(F.col("line") < end))

    def verify(self, assembly_id: int, *, published: DataFrame | None = None, sequences_in_assembly: int | None = None, against: str | None = None, every_tier: bool = False) -> DataFrame:
        """(tier, subject, outcome, detail) of every tier; an input that has changed is SKIPPED.

        published: counts as read_published() gives them for an accession and unit; they are
        compared only where as many sequences are loaded as the assembly has, if that is said.
        against: another file of the same annotation, in either format, whose features are
        counted and compared by family.  every_tier: tiers that were not asked for are named
        as SKIPPED.
        """
        feature, out = self.table(assembly_id, "feature"), []
        stored, links = _by_file(feature), _links(feature)
        for r in self.table(assembly_id, "source_file").orderBy("file_id").collect():
            if not files.exists(self.spark, r.path):
                out.append({"tier": "source count", "subject": r.path, "outcome": "SKIPPED", "detail": "the file is gone"})
            elif files.digest(self.spark, r.path) != r.sha256:
                out.append({"tier": "source count", "subject": r.path, "outcome": "SKIPPED", "detail": "the file has changed since"})
            else:
                out += _tiers(self._naive(r.path, r.format), stored.get(r.file_id, []), r.path, r.format)
            out.append(_edges(links.get(r.file_id), r.path, r.format))
        fasta_file = self.manifest(assembly_id)["fasta"]
        if fasta_file:
            path, known = fasta_file
            same = files.exists(self.spark, path) and files.digest(self.spark, path) == known
            out.append({"tier": "assembly", "subject": path, "outcome": "PASS" if same else "FAIL", "detail": "" if same else "the sequence file is gone or has changed"})
        else:
            out.append({"tier": "assembly", "subject": "", "outcome": "SKIPPED", "detail": "no sequence file"})
        loaded = self.table(assembly_id, "sequence").count()
        if against is None and every_tier:
            out.append({"tier": "cross format", "subject": "", "outcome": "SKIPPED", "detail": "no other file"})
        elif against is not None:
            bad, aside = self._across(assembly_id, feature, against)
            n, text = _show(bad)
            out.append({"tier": "cross format", "subject": against, "outcome": "FAIL" if n else "PASS", "detail": "; ".join(x for x in (text, f"{aside} mRNAs of genes with a coding sequence and no mRNA in the flat file are not compared" if aside else "") if x)})
        if published is None and every_tier:
            out.append({"tier": "published counts", "subject": "", "outcome": "SKIPPED", "detail": "no counts"})
        elif published is not None and sequences_in_assembly not in (None, loaded):
            out.append({"tier": "published counts", "subject": "", "outcome": "SKIPPED", "detail": f"{loaded} of {sequences_in_assembly} sequences are loaded"})
        elif published is not None:
            counts = feature.groupBy("source_type").agg(segments.feature_count().alias("n"))
            folded = counts.groupBy(F.when(F.col("source_type") == "pseudogene", "gene").otherwise(F.col("source_type")).alias("source_type")).agg(F.sum("n").alias("n"))
            wanted = published.select(F.col("feature").alias("source_type"), "n")
            bad = reconcile.compare_counts(wanted, folded.join(wanted.select("source_type"), "source_type", "left_semi")).filter("delta <> 0")
            n, text = _show(bad)
            out.append({"tier": "published counts", "subject": "", "outcome": "FAIL" if n else "PASS", "detail": text})
        rows = [(t["tier"], t["subject"], t["outcome"], t["detail"]) for t in out]
        return self.spark.createDataFrame(rows, "tier string, subject string, outcome string, detail string")

    def _across(self, assembly_id: int, feature: DataFrame, against: str) -> tuple[DataFrame, int]:
        """Families that differ between what is stored and another file, and the mRNAs set aside.

        Between two files of one format nothing is set aside.
        """
        families = self.spark.createDataFrame([(t, f) for f, types in FAMILIES for t in types], "type string, family string")
        flat = gff3.looks_like_genbank(self.spark, against)
        theirs = self._naive(against, "genbank" if flat else "gff3").select("source_type", F.col("features").alias("n"))
        mine = cross_format.stored_counts(feature)
        stored = self.table(assembly_id, "source_file").select("path", "format").collect()  # a row for each file
        sources = [against] if flat else [r.path for r in stored if r.format == "genbank"]
        aside = 0
        if flat == any(r.format == "genbank" for r in stored):
            return cross_format.compared(theirs, mine, families).filter("delta <> 0"), 0
        for path in sources:
            genes = cross_format.genes_without_mrna(files.lines(self.spark, path))
            names = cross_format.stored_names(feature, self.table(assembly_id, "attribute")) if flat else cross_format.text_names(files.lines(self.spark, against))
            aside += cross_format.mrna_of(names, genes).first().n
        sides = (mine, theirs) if flat else (theirs, mine)
        return cross_format.compared(*sides, families, aside).filter("delta <> 0"), aside

    # -- questions -------------------------------------------------------------------

    def stats(self, by: str = "source_type") -> DataFrame:
        """assembly_id, the type (source_type or feature_type, or both), features."""
        by = ["source_type", "feature_type"] if by == "both" else [by]
        out = [self.table(a["assembly_id"], "feature").groupBy("assembly_id", *by).agg(segments.feature_count().alias("features")) for a in self.catalog()["assemblies"]]
        return reduce(DataFrame.unionByName, out) if out else self.spark.createDataFrame([], f"assembly_id int, {', '.join(f'{b} string' for b in by)}, features long")

    def region(self, assembly_id: int, text: str) -> tuple[str, int, int, bool, int]:
        """(seqid, start, end, circular, length): the whole text as a name first, else up to the last colon."""
        seqs = self.table(assembly_id, "sequence")
        parts = self.spark.range(1).select(F.lit(text).alias("t")).select(scalars.region_parts(F.col("t")).alias("r")).select("r.*").first()
        whole = seqs.filter(F.col("seqid") == text).first()
        if whole:
            return whole.seqid, 1, whole.length, whole.circular, whole.length
        s = seqs.filter(F.col("seqid") == parts.name).first()
        if s is None:
            names = [r.seqid for r in seqs.orderBy("ordinal").limit(10).collect()]
            raise Refused(f"no sequence {parts.name}; there are {', '.join(names)}")
        if parts.start is None or parts.start < 1 or parts.start > s.length or parts.end < parts.start:
            raise Refused(f"{text}: the sequence has {s.length} bases")
        return s.seqid, parts.start, min(parts.end, s.length), s.circular, s.length

    def by_id(self, assembly_id: int, source_id: str, **options) -> DataFrame:
        near = _Names.of(self, assembly_id)
        found = near and near.answer([source_id], **options)
        if found is not None:
            return found
        feature = self.table(assembly_id, "feature")
        return self._answer(assembly_id, feature, feature.filter(F.col("source_id") == source_id), **options)

    def in_region(self, assembly_id: int, text: str, **options) -> DataFrame:
        """Features with a row in the region; on a circular sequence also past its end."""
        seqid, lo, hi, circular, length = self.region(assembly_id, text)
        feature = self.table(assembly_id, "feature")
        where = overlapping(lo, hi) | overlapping(lo + length, hi + length) if circular else overlapping(lo, hi)
        return self._answer(assembly_id, feature, feature.filter((F.col("seqid") == seqid) & where), **options)

    def with_term(self, assembly_id: int, term: str, *, analysis: str | None = None, descendants: bool = False, ancestors: bool = False) -> DataFrame:
        """Features that carry a term in any of its forms."""
        variants = self.spark.range(1).select(F.lit(term).alias("t")).select(scalars.term_variants(F.col("t"))).first()[0]
        hits = functional.with_term(self.table(assembly_id, "annotation"), variants, analysis)
        feature = self.table(assembly_id, "feature")
        return self._answer(assembly_id, feature, feature.join(hits.select("feature_id").distinct(), "feature_id", "left_semi"), descendants=descendants, ancestors=ancestors)

    def _answer(self, assembly_id: int, feature: DataFrame, rows: DataFrame, *, descendants: bool = False, types: tuple[str, ...] = (), ancestors: bool = False) -> DataFrame:
        """Whole features of a selection of rows, in depth-first order (column place).

        Descendants hang under any row of a feature; types are filtered before ancestors
        are added.  An answer of LOOKUP_MOST features at most is found by name, a larger one
        by joins.
        """
        near = _Names.of(self, assembly_id)
        if near is not None:
            some = [r.name for r in rows.select(_name().alias("name")).distinct().limit(LOOKUP_MOST + 1).collect()]
            found = near.answer(some, descendants=descendants, types=types, ancestors=ancestors)
            if found is not None:
                return found
        edges = feature.filter("source_id is not null").select(F.col("source_id").alias("id"), "parent_id")
        if descendants:
            names = graph.closure(edges, rows.select(F.col("source_id").alias("id")).filter("id is not null").distinct()).select(F.col("id").alias("_n")).distinct()
            below = feature.join(names, F.col("source_id") == F.col("_n"), "left_semi").unionByName(feature.filter("source_id is null").join(names, F.col("parent_id") == F.col("_n"), "left_semi"))
            rows = rows.unionByName(below).distinct()
        if types:
            rows = rows.filter(F.col("feature_type").isin([vocabulary.SYNONYM_OF.get(t, t) for t in types]))
        if ancestors:
            names = graph.closure(edges, rows.select(F.coalesce("source_id", "parent_id").alias("id")).filter("id is not null").distinct(), up=True).select(F.col("id").alias("_n")).distinct()
            rows = rows.unionByName(feature.join(names, F.col("source_id") == F.col("_n"), "left_semi")).distinct()
        whole = intervals.whole_features(feature.withColumn("row_id", F.col("feature_id")), rows.select(F.col("feature_id").alias("row_id"), "source_id"))
        grouped = segments.regroup(whole)
        grouped = graph._cut(grouped)
        # upwards from the answer, whose size it follows
        above = graph.closure(edges, grouped.filter("source_id is not null").select(F.col("source_id").alias("id")), up=True)
        tops = above.groupBy(F.col("start").alias("_t")).agg(F.max_by("id", "depth").alias("top_level"))
        out = grouped.join(tops, F.col("source_id") == F.col("_t"), "left").drop("_t").withColumn("top_level", F.coalesce("top_level", "source_id"))
        key = F.coalesce("source_id", F.concat(F.lit("\x00"), F.col("first_row").cast("string")))
        out = graph._cut(out.withColumn("_key", key))
        order = out.select(F.col("_key").alias("id"), F.struct("seqid", "start", "end", "first_row").alias("rank"))
        place = graph.depth_first(out.select(F.col("_key").alias("id"), "parent_id"), order).select(F.col("id").alias("_i"), F.col("path").alias("place"))
        return out.join(place, F.col("_key") == F.col("_i")).drop("_i", "_key").orderBy("place")

    def answer_tsv(self, answer: DataFrame, *, description: str = "", assembly_id: int | None = None, term: str | None = None, analysis: str | None = None) -> DataFrame:
        """(value): the lines of a table of an answer, in its order; with a term, a line for each
        of its hits on a feature.  Write it with one partition or by parts in order."""
        names = ["source_id", "source_type", "seqid", "start", "end", "strand", "n_segments", "parent_id", "top_level"]
        more = ["analysis", "accession", "description", "protein_start", "protein_end", "evalue"] if term is not None else []
        rows = answer
        if term is not None:
            variants = self.spark.range(1).select(F.lit(term).alias("t")).select(scalars.term_variants(F.col("t"))).first()[0]
            hits = functional.with_term(self.table(assembly_id, "annotation"), variants, analysis).join(self.table(assembly_id, "feature").select("feature_id", F.col("source_id").alias("_s")), "feature_id")
            rows = rows.join(hits.select("_s", *more), F.col("source_id") == F.col("_s"), "left")
        cell = lambda c: scalars.score_text(F.col(c)) if c == "evalue" else F.col(c).cast("string")
        order = [F.col("place"), *[F.col(c) for c in more[:2]]]
        body = rows.orderBy(*order).select(F.concat_ws("\t", *[F.coalesce(F.when(F.col(c).isNotNull(), cell(c)), F.lit("")) for c in [*names, *more]]).alias("value"))
        head = self.spark.createDataFrame([(x,) for x in (f"# {description}", "\t".join([*names, *more]))], "value string")
        return head.unionByName(body)

    def answer_gff3(self, assembly_id: int, answer: DataFrame) -> DataFrame:
        """(seqid, start, end, name, line) of the rows of an answer's features and of all above them."""
        feature = self.table(assembly_id, "feature")
        edges = feature.filter("source_id is not null").select(F.col("source_id").alias("id"), "parent_id")
        named = answer.filter("source_id is not null").select(F.col("source_id").alias("id")).distinct()
        wanted = graph.closure(edges, named, up=True).select(F.col("id").alias("_w")).distinct()
        lines = self._lines(assembly_id)
        alone = answer.filter("source_id is null").select(F.col("first_row").alias("_w"))
        out = lines.join(wanted, F.col("name") == F.col("_w"), "left_semi").unionByName(lines.join(alone, F.col("feature_id") == F.col("_w"), "left_semi"))
        return out.select("seqid", "start", "end", "name", "line")

    def export_proteins(self, assembly_id: int) -> DataFrame:
        """(gene, value): records of the proteins that the producer wrote beside its genes."""
        return protein_fasta(self.table(assembly_id, "protein"))

    def explain(self, identifier: str, assembly_id: int | None = None) -> DataFrame:
        """Where an identifier is: assembly, type, place, parent, children, terms."""
        out = []
        for a in self.catalog()["assemblies"]:
            if assembly_id in (None, a["assembly_id"]):
                f = self.table(a["assembly_id"], "feature")
                kids = hierarchy.children_index(f).select(F.col("parent_id").alias("_p"), "n_children", "children")
                terms = self.table(a["assembly_id"], "annotation").join(f.select("feature_id", "source_id"), "feature_id").groupBy(F.col("source_id").alias("_s")).agg(F.count("*").alias("terms"))
                one = segments.regroup(f.filter(F.col("source_id") == identifier).withColumn("row_id", F.col("feature_id")))
                one = one.join(kids, F.col("source_id") == F.col("_p"), "left").join(terms, F.col("source_id") == F.col("_s"), "left").drop("_p", "_s")
                out.append(one.withColumn("assembly", F.lit(a["label"])))
        if not out:
            raise Refused("no assembly")
        return reduce(DataFrame.unionByName, out)

    # -- export ------------------------------------------------------------------------

    def _lines(self, assembly_id: int) -> DataFrame:
        """seqid, start, end, source_type, name, feature_id, line of every row."""
        feature, attribute = self.table(assembly_id, "feature"), self.table(assembly_id, "attribute")
        values = attribute.groupBy("feature_id", "position", "key").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "value"))), lambda x: x["value"]).alias("values"))
        per_row = values.groupBy("feature_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "key", "values"))), lambda x: F.struct(x["key"].alias("key"), x["values"].alias("values"))).alias("attributes"))
        first = feature.filter("segment_index = 0").select(F.coalesce("source_id", F.col("feature_id").cast("string")).alias("_k"), F.col("feature_id").alias("_first"))
        rows = feature.join(per_row, "feature_id", "left").withColumn("_k2", F.coalesce("source_id", F.col("feature_id").cast("string")))
        shared = per_row.select(F.col("feature_id").alias("_sf"), F.col("attributes").alias("_shared"))
        rows = rows.join(first, F.col("_k2") == F.col("_k")).join(shared, F.col("_first") == F.col("_sf"), "left")
        rows = rows.withColumn("attributes", F.coalesce("attributes", "_shared", F.array().cast(gff3.ATTRIBUTES)))
        span = Window.partitionBy("_k2")
        rows = rows.withColumn("f_start", F.min("start").over(span)).withColumn("f_end", F.max("end").over(span))
        return rows.select("seqid", "start", "end", "f_start", "f_end", "source_type", F.coalesce("source_id", F.lit("")).alias("name"), "feature_id", export_rows.gff3_line(F.col("linkage_method")).alias("line"))

    def export_gff3(self, assembly_id: int) -> DataFrame:
        """(value): the lines of the file, in order: header, sequences, features by
        (sequence, start, end, type, ID), the rows of one by start."""
        return self._sorted_lines(assembly_id).orderBy("a", "b", "c", "d", "e", "f", "value").select("value")

    def write_gff3(self, assembly_id: int, uri: str) -> str:
        """The same lines as files of a folder that follow each other by name."""
        return files.write_lines(self._sorted_lines(assembly_id), uri, "a", "b", "c", "d", "e", "f", "value")

    def _sorted_lines(self, assembly_id: int) -> DataFrame:
        seqs = self.table(assembly_id, "sequence").orderBy("seqid").collect()  # a row for each sequence
        head = ["##gff-version 3", f"{profiles.EXPORT_PRAGMA} version={VERSION} vocabulary={vocabulary.content_hash()}", *[f"##sequence-region {s.seqid} 1 {s.length}" for s in seqs]]
        rows, top = self._ordered(assembly_id), self.spark.createDataFrame([("", i, 0, "", "", 0, x) for i, x in enumerate(head)], "a string, b long, c long, d string, e string, f long, value string")
        return top.unionByName(rows)

    def _ordered(self, assembly_id: int) -> DataFrame:
        """(a to f, value): the lines of all rows and what they are sorted by."""
        return self._lines(assembly_id).select(F.concat(F.lit("\x01"), "seqid").alias("a"), F.col("f_start").alias("b"), F.col("f_end").alias("c"), F.col("source_type").alias("d"), F.col("name").alias("e"), F.col("start").alias("f"), F.col("line").alias("value"))

    def export_indexed(self, assembly_id: int) -> tuple[bytes, bytes | None]:
        """Blocked gzip text and its index as bytes, for small assemblies."""
        return bgzf.to_bytes(*self._packed(assembly_id))

    def write_indexed(self, assembly_id: int, uri: str) -> bool:
        """The same as files uri and uri.tbi; False if rows end past what an index can address.

        Executors compress and index their share of the rows; the driver copies block by
        block and moves the index entries to their place.
        """
        return bgzf.to_files(self.spark, *self._packed(assembly_id), uri)

    def write_indexed_parts(self, assembly_id: int, uri: str) -> DataFrame:
        """The same rows as files of a folder, each with its index, all written by the executors; a row for each, as ``bgzf.PARTS``."""
        return bgzf.write_parts(*self._in_order(assembly_id), uri)

    def _packed(self, assembly_id: int) -> tuple[DataFrame, list[str], list[str]]:
        rows, names, header = self._in_order(assembly_id)
        return bgzf.packed(rows), names, header

    def _in_order(self, assembly_id: int) -> tuple[DataFrame, list[str], list[str]]:
        order = self.table(assembly_id, "sequence").select("seqid", "ordinal")
        names = [r.seqid for r in order.orderBy("ordinal").collect()]  # a row for each sequence
        keys = ["ordinal", "start", "end", "name", "feature_id"]
        rows = self._lines(assembly_id).join(order, "seqid").repartitionByRange(*keys).sortWithinPartitions(*keys)
        return rows.select(F.col("ordinal").cast("int").alias("sequence"), "start", "end", "line"), names, ["##gff-version 3"]

    def export_functional(self, assembly_id: int) -> DataFrame:
        """The functional table, by ID, analysis and accession."""
        a, f, r = (self.table(assembly_id, t) for t in ("annotation", "feature", "annotation_run"))
        out = a.join(f.select("feature_id", "source_id"), "feature_id").join(r.select("run", "tool"), "run")
        return out.select("source_id", "analysis", "accession", "description", "protein_start", "protein_end", "score", "evalue", "query_id", "tool").orderBy("source_id", "analysis", "accession", "protein_start")

    # -- removal ---------------------------------------------------------------------------

    def plan_removal(self, assembly_id: int) -> dict:
        """What would go: a count for each table."""
        entry = self._assembly(assembly_id)
        return {"label": entry["label"], "folder": entry["folder"]} | {t: self.table(assembly_id, t).count() for t in TABLES}

    def remove(self, assembly_id: int, *, keep_files: bool = False, dry_run: bool = False) -> dict:
        """Takes an assembly out of the catalog, with organisms and strains that have no other,
        then deletes its folders.

        The folder must be the assembly's own by its manifest, and the manifest the one that
        the load wrote.  The catalog is published first, so it never names a folder that is
        gone.  keep_files leaves the folders; dry_run only counts.
        """
        plan, catalog, entry = self.plan_removal(assembly_id), self.catalog(), self._assembly(assembly_id)
        manifest = self.manifest(assembly_id)
        if (manifest["assembly_id"], manifest["label"]) != (assembly_id, entry["label"]):
            raise Refused(f"{plan['folder']} belongs to assembly {manifest['assembly_id']}, {manifest['label']}")
        if entry.get("manifest_sha256", self._manifest_sha256(entry["folder"])) != self._manifest_sha256(entry["folder"]):
            raise Refused(f"{plan['folder']}: the manifest is not the one that was loaded")
        if dry_run:
            return plan
        left = [a for a in catalog["assemblies"] if a["assembly_id"] != assembly_id]
        organisms = [o | {"strains": [s for s in o["strains"] if any(a["organism"] == f"{o['genus']} {o['species']}" and a["strain"] == s for a in left)]} for o in catalog.get("organisms", [])]
        folders = [entry["folder"], *entry.get("functional", [])]
        without = catalog | {"assemblies": left, "organisms": [o for o in organisms if o["strains"]]}
        self._work(Intent("remove", entry["label"], catalog["revision"], [], [] if keep_files else folders, folders if keep_files else []), None, lambda: without)
        return plan


class _Names:
    """The features of an assembly by name, read bucket by bucket: what is read follows the answer."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int):
        self.spark, self.folder, self.buckets = spark, folder, buckets
        self.schema: dict[str, object] = {}

    _OPEN: dict[tuple[str, str], _Names] = {}

    @classmethod
    def of(cls, w: Warehouse, assembly_id: int) -> _Names | None:
        """None for an assembly that was loaded without these tables."""
        folder = f"{w.root}/{w._assembly(assembly_id)['folder']}"
        key = w.spark.sparkContext.applicationId, folder
        if key not in cls._OPEN:
            if not files.exists(w.spark, f"{folder}/buckets.json"):
                return None
            cls._OPEN[key] = cls(w.spark, folder, json.loads(files.read_bytes(w.spark, f"{folder}/buckets.json")))
        return cls._OPEN[key]

    def _read(self, table: str, column: str, names: list[str]) -> DataFrame:
        """The rows of these names: only their buckets' folders are opened, and of these only row groups that may hold them."""
        buckets = sorted({zlib.crc32(n.encode()) % self.buckets for n in names})
        reader = self.spark.read.option("basePath", f"{self.folder}/{table}")
        if table in self.schema:
            reader = reader.schema(self.schema[table])
        paths = [p for p in (f"{self.folder}/{table}/bucket={b}" for b in buckets) if files.exists(self.spark, p)]
        if not paths:
            whole = self.spark.read.parquet(f"{self.folder}/{table}") if table == "by_name" else self.spark.createDataFrame([], "parent_id string, name string, bucket int")
            return whole.filter(F.lit(False))
        rows = reader.parquet(*paths)
        self.schema.setdefault(table, rows.schema)
        return rows.filter(F.col(column).isin(names))

    def _rows(self, names: list[str]) -> DataFrame:
        """The rows of features, with what follows from their names and types."""
        rows = self._read("by_name", "name", names)
        own = F.when(F.col("name") != _alone(), F.col("name"))
        return rows.withColumn("source_id", own).withColumn("feature_type", vocabulary.canonical(F.col("source_type")))

    def _below(self, names: set[str]) -> set[str] | None:
        """names and all below them; None beyond LOOKUP_MOST."""
        seen, frontier = set(names), sorted(names)
        while frontier:
            kids = [r.name for r in self._read("by_parent", "parent_id", frontier).select("name").distinct().limit(LOOKUP_MOST + 1).collect()]
            frontier = sorted(set(kids) - seen)
            seen |= set(frontier)
            if len(seen) > LOOKUP_MOST:
                return None
        return seen

    def answer(self, names: list[str], *, descendants: bool = False, types: tuple[str, ...] = (), ancestors: bool = False) -> DataFrame | None:
        """As Warehouse._answer, from names; None if it would be larger than LOOKUP_MOST."""
        chosen = set(names)
        if len(chosen) > LOOKUP_MOST:
            return None
        if descendants:
            chosen = self._below(chosen)
            if chosen is None:
                return None
        parent: dict[str, str | None] = {}
        kinds: dict[str, set[str]] = {}
        frontier = sorted(chosen)
        while frontier:  # upwards, a step for each level
            for r in self._rows(frontier).select("name", "parent_id", "feature_type").distinct().collect():
                kinds.setdefault(r.name, set()).add(r.feature_type)
                known = [x for x in (r.parent_id, parent.get(r.name)) if x is not None]
                parent[r.name] = min(known, default=None)
            frontier = sorted({p for p in parent.values() if p is not None} - set(parent) - set(frontier))  # one that is no feature is looked for once
            if len(parent) + len(frontier) > 2 * LOOKUP_MOST:
                return None
        chosen &= set(kinds)
        if types:
            wanted = {vocabulary.SYNONYM_OF.get(t, t) for t in types}
            chosen = {n for n in chosen if kinds[n] & wanted}
        chain: dict[str, list[str]] = {}
        for n in chosen:
            way, at = [n], parent[n]
            while at is not None and at not in way:
                way.append(at)
                at = parent.get(at)
            chain[n] = way
        if ancestors:
            for n in list(chosen):
                for i, a in enumerate(chain[n][1:], 1):
                    if a in kinds and a not in chosen:
                        chosen.add(a)
                        chain[a] = chain[n][i:]
        if len(chosen) > LOOKUP_MOST:
            return None
        whole = self._rows(sorted(chosen)).withColumn("row_id", F.col("feature_id")).drop("name", "bucket")
        grouped = segments.regroup(whole)
        rows = {(r.source_id if r.source_id is not None else f"\x00{r.first_row}"): r for r in grouped.collect()}
        rank = {n: (r.seqid, r.start, r.end, r.first_row) for n, r in rows.items()}
        out = []
        for n, r in rows.items():
            # ranks from the uppermost feature that the answer has without a gap down to it
            way = []
            for a in chain[n]:
                if a not in rank:
                    break
                way.insert(0, rank[a])
            top = chain[n][-1] if r.source_id is not None else None
            out.append((*r, top, (False, way)))
        more = T.StructType.fromDDL("top_level string, place struct<late: boolean, ranks: array<struct<seqid: string, start: bigint, end: bigint, first_row: bigint>>>")
        return self.spark.createDataFrame(sorted(out, key=lambda x: x[-1]), T.StructType([*grouped.schema.fields, *more.fields]))


def _upserted(organisms: list[dict], config: OrganismConfig) -> list[dict]:
    """organisms with this one and its strain, each once; what the config says of it is kept where it says nothing."""
    out, found = [], False
    for o in organisms:
        if (o["genus"], o["species"]) == (config.genus, config.species):
            found = True
            o = o | {"ncbi_taxon_id": config.ncbi_taxon_id or o["ncbi_taxon_id"], "common_name": config.common_name or o["common_name"], "strains": sorted({*o["strains"], config.strain})}
        out.append(o)
    if not found:
        out.append({"genus": config.genus, "species": config.species, "ncbi_taxon_id": config.ncbi_taxon_id, "common_name": config.common_name, "strains": [config.strain]})
    return out


def scalars_slug(text: str) -> str:
    import re

    return re.sub(r"[^A-Za-z0-9._-]+", "_", text).strip("._-").lower()


def _buckets(rows: int) -> int:
    """Into how many buckets so many rows go."""
    return max(1, min(BUCKETS_MOST, rows // BUCKET_ROWS))


def _alone() -> Column:
    """The name of a row without ID."""
    return F.concat(F.lit("\x00"), F.col("feature_id").cast("string"))


def _name() -> Column:
    return F.coalesce(F.col("source_id"), _alone())


def _stored(feature: DataFrame, *by: str) -> DataFrame:
    """The counts of each type (and file): a row for each."""
    return feature.groupBy(*by, "source_type").agg(segments.feature_count().alias("features"), F.count("*").alias("n_rows"), F.count_if(F.col("parent_id").isNotNull()).alias("with_parent"))


def _by_file(feature: DataFrame) -> dict[int, list]:
    """file_id to the counts of its types, from one scan."""
    out: dict[int, list] = {}
    for r in _stored(feature, "file_id").collect():
        out.setdefault(r.file_id, []).append(r)
    return out


def _tiers(naive: DataFrame, stored: DataFrame | list, path: str, format: str) -> list[dict]:
    """Source count, row count and stated parents: what the text holds against what is stored of it, rows or their counts."""
    text = {r.source_type: r for r in naive.collect()}  # a row for each type
    kept = {r.source_type: r for r in (_stored(stored).collect() if isinstance(stored, DataFrame) else stored)}
    out = []
    for tier, column in [("source count", "features"), *([] if format == "genbank" else [("row count", "n_rows"), ("stated parents", "with_parent")])]:
        pairs = [(t, text[t][column] if t in text else 0, kept[t][column] if t in kept else 0) for t in sorted({*text, *kept})]
        bad = [f"{t} {e} {a} {a - e}" for t, e, a in pairs if e != a]
        kind = "FAIL" if bad else "PASS" if any(e or a for _, e, a in pairs) else "SKIPPED"
        out.append({"tier": tier, "subject": path, "outcome": kind, "detail": "; ".join(bad[:10]) + (f"; {len(bad) - 10} more" if len(bad) > 10 else "")})
    return out


def _facts() -> list:
    return [F.count_if(F.col("parent_id").isNotNull() & F.col("parent_feature_id").isNull()).alias("lost"), F.count_if(F.col("source_type").isin(vocabulary.LINKED)).alias("linkable")]


def _links(feature: DataFrame) -> dict[int, dict]:
    """file_id to its features by linkage, those whose parent is lost, and those of types that must be linked."""
    first = feature.filter("segment_index = 0")
    out = {r.file_id: {"lost": r.lost, "linkable": r.linkable, "by": {}} for r in first.groupBy("file_id").agg(*_facts()).collect()}
    for r in hierarchy.linkage_counts(first, "file_id").collect():
        out[r.file_id]["by"][r.linkage] = r.n
    return out


def _edges(links: DataFrame | dict | None, path: str, format: str) -> dict:
    """Parent edges, of rows or their counts: no link without a method or the other way round; GenBank states none."""
    if isinstance(links, DataFrame):
        first = links.filter("segment_index = 0")
        links = first.agg(*_facts()).first().asDict() | {"by": {r.linkage: r.n for r in hierarchy.linkage_counts(first).collect()}}
    links = links or {"lost": 0, "linkable": 0, "by": {}}
    counts = links["by"]
    linked = sum(counts.get(m, 0) for m in vocabulary.LINKAGE)
    bad = counts.get("unlinked", 0) + counts.get("unrecorded", 0) + links["lost"] + (counts.get("explicit_parent", 0) if format == "genbank" else 0)
    kind = "SKIPPED" if not counts else "FAIL" if bad or not linked and links["linkable"] else "PASS"
    return {"tier": "parent edges", "subject": path, "outcome": kind, "detail": ", ".join(f"{k} {v}" for k, v in sorted(counts.items()))}
