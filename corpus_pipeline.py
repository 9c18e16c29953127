"""From raw documents to token files: each stage works on what the one before kept.

Stages read and return documents; the last returns what the token files hold.  The
mix lays the documents down in its order, and the token files follow that order.

In every stage a null text is an empty one: it is scored, is near no other text, leaks
nothing, has its place in the mix and becomes the end id alone.  A null doc_id is a document
of its own.  Rows that repeat a text are judged alike, but for near duplicates, of which
one document stays.  Columns beyond those of documents are kept as they are, whatever their
names, and an empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, mixing, near_dup, quality_model, token_files, workspace


NEAR_PERCENT = 80  # op10's 85 is its own


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.3 or more."""
    return quality_model.drop_poor(docs, _read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: word shingles of Jaccard 0.8 or more."""
    return near_dup.drop_near_duplicates(docs, percent=NEAR_PERCENT)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of 13 benchmark words, and of which shorter items are less than a twentieth."""
    return decontaminate.drop_leaks(docs, _read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix: part files in order, rows in order."""
    names = workspace.free(docs, *mixing.NAMES)
    mixed = mixing.mix_sources(docs, names=tuple(names))
    return mixed.repartitionByRange(names[-1]).sortWithinPartitions(names[-1]).select(*[F.col(f"`{c}`") for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order in which the documents lie; doc_id, start, n_tokens, ids_crc32 from them."""
    order = [F.col("doc_id")]
    if docs.inputFiles():
        name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
        order = [F.regexp_extract(name, "^part-([0-9]+)", 1).try_cast("long"), name, F.col("_metadata.row_index")]  # part-100000 follows part-99999
    return token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), order_by=order).documents()


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("source mix", mix),
    ("token files", tokens),
]

#: The classifier's scores, and with them all that follows, have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each result written and read again."""
    docs = _read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = workspace.Table(stage(spark, docs, sf_dir), "stage").df
    return STAGES[-1][1](spark, docs, sf_dir)
