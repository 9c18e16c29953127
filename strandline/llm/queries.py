"""The registered queries of this subpackage, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, fill_in_middle, main_text, mixing, near_dup, passages, personal_data, quality_model, quality_rules, sql_twins, token_files, token_rollup, turn_repair, url_trust, workspace
from strandline.plans import registry

TOKENIZER = "word_bpe_49k.json"
NEAR_DUP_PERCENT = 85  # of op10 alone; its SQL has the same
#: Host, path and verdict of op12's rules; its SQL has the same.
URL_RULES = sql_twins.URL_RULES

SQL = {
    "op3_decontaminate": sql_twins.DECONTAMINATE,
    "op6_quality_rules": sql_twins.QUALITY_RULES,
    "word_rollup": sql_twins.WORD_ROLLUP,
    "op10_near_dup": sql_twins.NEAR_DUP,
    "op11_fill_in_middle": sql_twins.FILL_IN_MIDDLE,
    "op12_url_trust": sql_twins.URL_TRUST,
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_token_files(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)).documents()


def op2_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find_passages(_read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find_personal_data(_read(spark, sf_dir, "documents"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(_read(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(_read(spark, sf_dir, "pages"))


def _rolled(spark: SparkSession, sf_dir: str, versions: list[DataFrame]) -> DataFrame:
    """All documents, after estimates, revisions, deletes of documents under 50 words, their return, and batches that come twice."""
    docs = _read(spark, sf_dir, "documents")
    counts = workspace.Table(reduce(DataFrame.unionByName, versions), "counts").df
    names = F.array(*[F.lit(r.tokenizer) for r in counts.select("tokenizer").distinct().orderBy("tokenizer").collect()])  # a row for each version
    rollup = token_rollup.TokenRollup(spark, workspace.new_path(spark, "rollup"))
    estimate = docs.select("doc_id", "source", "lang", F.explode(names).alias("tokenizer"), F.floor(F.col("n_chars") / 6).alias("n_tokens"))
    first = estimate.withColumn("op", F.lit("insert"))
    short = counts.filter("n_tokens < 50")
    rollup.commit("estimates", first)
    rollup.commit("counts", counts.withColumn("op", F.lit("revise")))
    rollup.commit("short", short.withColumn("op", F.lit("delete")))
    rollup.commit("estimates", first)
    rollup.commit("short again", short.withColumn("op", F.lit("insert")))
    return rollup.totals()


def op9_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all documents, in ids of op1's tokenizer and in words."""
    docs = _read(spark, sf_dir, "documents")
    return _rolled(spark, sf_dir, [token_rollup.token_counts(docs, public_tokenizers.path(TOKENIZER), TOKENIZER), token_rollup.word_counts(docs)])


def word_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op9_token_rollup that SQL can count: the version in words."""
    return _rolled(spark, sf_dir, [token_rollup.word_counts(_read(spark, sf_dir, "documents"))])


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_read(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select("doc_id", F.col("_source").alias("source"), F.col("_block").alias("block"), F.col("_slot").alias("slot"), F.col("_position").alias("position"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_read(spark, sf_dir, "documents"), percent=NEAR_DUP_PERCENT)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle.fill_in_middle(_read(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_in_middle.restored(), 256).alias("restored_sha256"),
    )


def op12_url_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_trust.judge_urls(_read(spark, sf_dir, "pages"), URL_RULES)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of damaged conversations; one that lost all its rows has zeros and the digest of nothing."""
    turns = _read(spark, sf_dir, "conversations")
    repair = turn_repair.repair_turns(turn_repair.damaged(turns))
    found = repair.report.select(F.col("conv_id").alias("_c"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    digests = turn_repair.conversation_digests(repair.turns).select(F.col("conv_id").alias("_d"), "repaired_sha256")
    rows = turns.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(digests, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_passages, op3_decontaminate, op4_personal_data, op5_quality_model, op6_quality_rules, op7_mix, op8_main_text, op9_token_rollup, word_rollup, op10_near_dup, op11_fill_in_middle, op12_url_trust, op13_turn_repair, pipeline)}


def oracle_sql() -> dict[str, str]:
    """SQL as materialised tables; ``registry.whole`` says why."""
    return {name: registry.whole(sql) for name, sql in SQL.items()}
