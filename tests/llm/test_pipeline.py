"""The pipeline and the registered queries over the smallest tables."""

import corpus_pipeline
from pyspark.sql import functions as F

from strandline.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, SF)
        assert after.columns == docs.columns, name
        path = f"{spark.conf.get('spark.checkpoint.dir')}/stage-{name.replace(' ', '-')}"
        after.write.mode("overwrite").parquet(path)
        before, kept = kept.count(), spark.read.parquet(path)
        assert 0 < kept.count() <= before
    mixed = [r.doc_id for r in stage_order(kept)]
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).orderBy("start").collect()
    assert [r.doc_id for r in last] == mixed
    assert corpus_pipeline.run(spark, SF).count() == len(mixed)


def test_near_duplicates_at_four_fifths(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join("new" if i in (40, 80, 120, 160, 200, 240) else w for i, w in enumerate(words))), (3, " ".join("new" if i % 40 == 20 else w for i, w in enumerate(words)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")  # 1 and 2: 266 / 326; 1 and 3: 256 / 336
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()) == [1, 3]


def stage_order(df):
    return sorted(df.selectExpr("doc_id", "_metadata.file_name as f", "_metadata.row_index as i").collect(), key=lambda r: (r.f, r.i))


def test_queries_run_over_whole_tables(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    for name, q in queries.queries().items():
        if name in ("op1_token_files", "op3_decontaminate", "op4_personal_data", "op5_quality_model", "op6_quality_rules", "op7_mix", "op10_near_dup"):
            assert q(spark, SF).count() == n, name


CLASHES = ["_score", "_leak", "_drop", "_position", "_o", "_w", "_q", "_r", "_b", "_rank", "_source", "_block", "_slot", "_key", "_h", "c1", "Score", "score", "rep", "_metadata_"]


def test_stages_keep_the_callers_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    more = spark.createDataFrame([(None, None, "en", None, 0), (None, "a b c", None, "x", 5), (7, "", "en", "x", 0), (3, "same text twice", "en", "x", 1), (3, "same text twice", "en", "x", 1)], docs.schema)
    docs = docs.unionByName(more)
    names = [c for c in CLASHES if c != "score"]
    wide = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in names])
    path = f"{spark.conf.get('spark.checkpoint.dir')}/wide"
    wide.write.mode("overwrite").parquet(path)
    wide = spark.read.parquet(path)
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, wide, SF)
        if name == corpus_pipeline.STAGES[-1][0]:
            assert after.count() == wide.count()
            continue
        assert after.columns == wide.columns, name
        rows = after.collect()
        assert rows and all(r[c] == f"{c} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for c in names), name
        assert stage(spark, wide.limit(0), SF).count() == 0, name
