"""Count reconciliation and the fidelity difference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_counts(expected: DataFrame, actual: DataFrame, key: str = "source_type", value: str = "n") -> DataFrame:
    """key, expected, actual, delta over the union of both key sets; an absent key counts 0."""
    e = expected.select(F.col(key).alias("_e"), F.col(value).alias("expected"))
    a = actual.select(F.col(key).alias("_a"), F.col(value).alias("actual"))
    j = e.join(a, F.col("_e").eqNullSafe(F.col("_a")), "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return j.select(F.coalesce("_e", "_a").alias(key), zero("expected").alias("expected"), zero("actual").alias("actual"), (zero("actual") - zero("expected")).alias("delta"))


def outcome(compared: DataFrame) -> DataFrame:
    """One row: outcome (PASS, FAIL, or SKIPPED where nothing is expected), mismatches, expected, actual."""
    total = compared.agg(
        F.coalesce(F.sum((F.col("delta") != 0).cast("long")), F.lit(0)).alias("mismatches"), F.coalesce(F.sum("expected"), F.lit(0)).alias("expected"), F.coalesce(F.sum("actual"), F.lit(0)).alias("actual")
    )
    kind = F.when((F.col("expected") == 0) & (F.col("actual") == 0), "SKIPPED").when(F.col("mismatches") == 0, "PASS").otherwise("FAIL")
    return total.select(kind.alias("outcome"), "mismatches", "expected", "actual")


def folded(counts: DataFrame, families: DataFrame, side: str, key: str = "source_type", value: str = "n") -> DataFrame:
    """Counts by family: families has (side, type, family), types in lower case."""
    f = families.filter(F.col("side") == side).select(F.col("type").alias("_t"), "family")
    return counts.join(f, F.lower(F.col(key)) == F.col("_t")).groupBy("family").agg(F.sum(value).cast("long").alias("n"))


def folded_all(counts: DataFrame, families: DataFrame, key: str = "source_type", value: str = "n") -> DataFrame:
    """family, n: counts by family, a type of no family by its own name; families has (type, family), types in lower case."""
    f = families.select(F.col("type").alias("_t"), F.col("family").alias("_f")).distinct()
    rows = counts.join(f, F.lower(F.col(key)) == F.col("_t"), "left")
    return rows.groupBy(F.coalesce("_f", key).alias("family")).agg(F.sum(value).cast("long").alias("n"))


def published_counts(rows: DataFrame) -> DataFrame:
    """feature, n from a published table (feature, unit, unique_ids, placements): the sum of
    the units where there are any, else the rollup 'all'; unique ids, else placements."""
    n = F.coalesce(F.col("unique_ids").try_cast("long"), F.col("placements").try_cast("long"), F.lit(0))
    unit = rows.groupBy("feature", (F.col("unit") == "all").alias("rollup")).agg(F.sum(n).alias("n"))
    return unit.groupBy("feature").agg(F.coalesce(F.sum(F.when(~F.col("rollup"), F.col("n"))), F.sum("n")).cast("long").alias("n"))


def fidelity(truth: DataFrame, stored: DataFrame, fields: list[str], declared: Column | None = None) -> DataFrame:
    """key, type, state, fields: what became of each feature of the truth, and extras.

    state: kept, changed, changed_declared, lost or extra; fields: the names of those that
    differ, in order, comma-joined.
    """
    t = truth.select(F.col("key").alias("_tk"), F.col("type").alias("_tt"), *[F.col(f).alias(f"_t_{f}") for f in fields])
    s = stored.select(F.col("key").alias("_sk"), F.col("type").alias("_st"), *[F.col(f).alias(f"_s_{f}") for f in fields])
    j = t.join(s, F.col("_tk") == F.col("_sk"), "full_outer")
    differ = F.concat_ws(",", *[F.when(~F.col(f"_t_{f}").eqNullSafe(F.col(f"_s_{f}")), f) for f in fields])
    both = F.col("_tk").isNotNull() & F.col("_sk").isNotNull()
    state = F.when(F.col("_sk").isNull(), "lost").when(F.col("_tk").isNull(), "extra").when(differ == "", "kept")
    if declared is not None:
        state = state.when(declared, "changed_declared")
    return j.select(F.coalesce("_tk", "_sk").alias("key"), F.coalesce("_tt", "_st").alias("type"), state.otherwise("changed").alias("state"), F.when(both, differ).otherwise("").alias("fields"))


def staged_pairs(left: DataFrame, right: DataFrame, stages: list[list[str]], checkpoint=None) -> DataFrame:
    """left_id, right_id, stage: pairs one to one, stage by stage.

    In each stage the rows that are left are paired that agree in its columns, the first
    with the first by id; paired rows are out.
    """
    from pyspark.sql import Window

    cut = checkpoint or (lambda df: df)
    out = None
    for i, columns in enumerate(stages, 1):
        w = Window.partitionBy(*columns).orderBy("id")
        sides = []
        for df, name in ((left, "l"), (right, "r")):
            keys = [F.col(c).alias(f"_{name}{k}") for k, c in enumerate(columns)]
            sides.append(df.dropna(subset=columns).withColumn("_n", F.row_number().over(w)).select(F.col("id").alias(f"{name}_id"), *keys, F.col("_n").alias(f"_{name}n")))
        on = F.col("_ln") == F.col("_rn")
        for k in range(len(columns)):
            on = on & (F.col(f"_l{k}") == F.col(f"_r{k}"))
        pairs = cut(sides[0].join(sides[1], on).select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), F.lit(i).cast("long").alias("stage")))
        out = pairs if out is None else out.unionByName(pairs)
        left = left.join(pairs.select(F.col("left_id").alias("id")), "id", "left_anti")
        right = right.join(pairs.select(F.col("right_id").alias("id")), "id", "left_anti")
    return out


def agreement(checker: DataFrame, engine: DataFrame) -> DataFrame:
    """checker, engine, n: verdicts on the same ids; 'absent' where a side has none."""
    c = checker.select(F.col("id").alias("_c"), F.col("verdict").alias("_cv"))
    e = engine.select(F.col("id").alias("_e"), F.col("verdict").alias("_ev"))
    j = c.join(e, F.col("_c") == F.col("_e"), "full_outer")
    return j.groupBy(F.coalesce("_cv", F.lit("absent")).alias("checker"), F.coalesce("_ev", F.lit("absent")).alias("engine")).agg(F.count("*").alias("n"))
