"""Token counts as rollups that signed changes maintain.

A batch of changes turns into signed rows: an insert adds a document's count, a
delete takes it away, a revision takes the old one away and adds the new.  Summed by
source, language and tokenizer version they are the batch's delta, and the new totals
are the totals before plus the delta.

A commit is a version: a folder with the batch's signed rows, the totals after it and,
now and then, a snapshot of the documents that count.  Version n + 1 is written aside
and published by one rename, which fails where that version is there already; then
another writer was first, and the commit starts again from its version, so no two
commits take the same old row away.  A batch counts once however often it is run: its
name lies in its version.

A commit reads the last snapshot and the signed rows since then.  A snapshot is due
when these are as many as its own rows, or MOST_SINCE versions; so the cost of a commit
follows the documents that count and not the number of commits before it.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import token_files, workspace
from strandline.llm.textkernel import strings

KEY = ["doc_id", "tokenizer"]
GROUP = ["source", "lang", "tokenizer"]
LEDGER = "doc_id long, tokenizer string, source string, lang string, sign int, n_tokens long"
TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
MOST_SINCE = 64
ENCODE_ROWS = 256


class TokenRollup:
    """The rollup that lies in a shared folder."""

    def __init__(self, spark: SparkSession, path: str, most_since: int = MOST_SINCE):
        self.spark, self.path, self.most_since = spark, path.rstrip("/"), most_since

    def _version(self, n: int) -> str:
        return f"{self.path}/version-{n:010d}"

    def _mark(self, batch_id: str) -> str:
        return f"batch-{hashlib.sha256(str(batch_id).encode()).hexdigest()}"

    def _committed(self, batch_id: str) -> bool:
        return workspace.matches(self.spark, f"{self.path}/version-*/{self._mark(batch_id)}")

    def _last(self, inside: str = "") -> int:
        """The last version, or the last that has this in it; 0: none."""
        names = workspace.names(self.spark, f"{self.path}/version-*{inside}")
        return max((int(n.split("/version-")[-1].split("/")[0]) for n in names), default=0)

    def _ledger(self, version: int) -> tuple[DataFrame, int, int]:
        """Signed rows that make up the documents after a version: the rows of the last
        snapshot, those since, and how many they are; and how many versions are since."""
        snapshot = min(self._last("/state"), version)
        while snapshot and not workspace.exists(self.spark, f"{self._version(snapshot)}/state"):
            snapshot -= 1  # a later snapshot than this version's: another writer's
        paths = [f"{self._version(snapshot)}/state"] if snapshot else []
        paths += [f"{self._version(n)}/ledger" for n in range(snapshot + 1, version + 1)]
        rows = self.spark.read.schema(LEDGER).parquet(*paths) if paths else self.spark.createDataFrame([], LEDGER)
        return rows, snapshot, version - snapshot

    def current(self) -> DataFrame:
        """The documents that count: doc_id, tokenizer, source, lang, n_tokens."""
        return _net(self._ledger(self._last())[0])

    def _totals(self, version: int) -> DataFrame:
        return self.spark.read.schema(TOTALS).parquet(f"{self._version(version)}/totals") if version else self.spark.createDataFrame([], TOTALS)

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; groups without documents are left out."""
        return self._totals(self._last())

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch; False if it was committed before.

        changes: op ("insert", "revise" or "delete"), doc_id, source, lang, tokenizer,
        n_tokens.  An insert of a document that counts is a revision, a revision of one
        that doesn't an insert; a delete of one that doesn't changes nothing.  Of
        several changes of a document in one batch a delete wins, else the largest
        count.  A null count is 0; a null source, language or tokenizer is a group of
        its own; rows without doc_id are left out; other columns are ignored; other
        operations are an error.
        """
        if self._committed(batch_id):
            return False
        rank = F.when(F.col("op") == "delete", 2).when(F.col("op").isin("insert", "revise"), 1).otherwise(F.raise_error(F.lit("op must be insert, revise or delete")).cast("int"))
        new = changes.filter("doc_id is not null").select(
            F.col("doc_id").cast("long"), "tokenizer", rank.alias("rank"), "source", "lang", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n_tokens")
        )
        new = new.groupBy(*KEY).agg(F.max(F.struct("rank", "n_tokens", "source", "lang")).alias("c"))
        new = workspace.Table(new.select(*KEY, "c.*"), "changes")
        while not self._committed(batch_id):
            version = self._last()
            aside = f"{self.path}/_aside-{uuid.uuid4().hex}"
            self._write(aside, version, new.df)
            workspace.make(self.spark, f"{aside}/{self._mark(batch_id)}")
            if workspace.move(self.spark, aside, self._version(version + 1)):
                new.drop()
                return True
            workspace.remove(self.spark, aside)
        new.drop()
        return False

    def _write(self, aside: str, version: int, new: DataFrame) -> None:
        """The version that follows this one."""
        rows, snapshot, since = self._ledger(version)
        keys = new.select(*[F.col(k).alias(f"_{k}") for k in KEY])
        old = _net(rows.join(keys, (F.col("doc_id") == F.col("_doc_id")) & F.col("tokenizer").eqNullSafe(F.col("_tokenizer")), "left_semi"))
        signed = old.select(*KEY, "source", "lang", F.lit(-1).alias("sign"), "n_tokens").unionByName(new.filter("rank = 1").select(*KEY, "source", "lang", F.lit(1).alias("sign"), "n_tokens"))
        signed.write.parquet(f"{aside}/ledger")
        ledger = self.spark.read.schema(LEDGER).parquet(f"{aside}/ledger")
        delta = ledger.select(*GROUP, F.col("sign").cast("long").alias("n_docs"), (F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        sums = self._totals(version).union(delta).groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.filter("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{aside}/totals")
        held = self.spark.read.schema(LEDGER).parquet(f"{self._version(snapshot)}/state").count() if snapshot else 0
        fresh = rows.count() - held + ledger.count()
        if since + 1 >= self.most_since or fresh >= max(held, 1):
            _net(rows.union(ledger)).select(*KEY, "source", "lang", F.lit(1).alias("sign"), "n_tokens").write.parquet(f"{aside}/state")


def _net(rows: DataFrame) -> DataFrame:
    net = rows.groupBy("doc_id", "tokenizer", "source", "lang", "n_tokens").agg(F.sum("sign").alias("sign"))
    return net.filter("sign > 0").drop("sign")


def word_counts(docs: DataFrame, tokenizer: str = "words-1") -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens, of whole texts: runs of other than ASCII white space."""
    words = F.array_remove(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), "")
    return docs.select("doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.size(words).cast("long").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """doc_id, source, lang, tokenizer, n_tokens: ids of whole texts from a file of the
    tokenizers library, without special tokens; tokenizer names its version.  Null is empty."""
    workspace.ship(docs.sparkSession)
    special = token_files.LowerCasePieces.special_tokens(path)

    def run(batches):
        encoder = token_files.encoder(path, special)
        for batch in batches:
            texts, n = strings(batch.column(3)), []
            for first in range(0, len(texts), ENCODE_ROWS):
                n += [len(ids) for ids in encoder.encode(texts[first : first + ENCODE_ROWS])]
            yield pa.record_batch([*(batch.column(i) for i in range(3)), pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")
