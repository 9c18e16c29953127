"""Quality rules with adaptive thresholds, in DataFrame functions alone.

Every document's counts are taken in its row.  For each language and source,
mergeable KLL sketches of the ratios give quartiles; the sketches of sources merge
into those of their language, and these into one for all.  A ratio is too high above
Q3 + SPREAD * max(Q3 - Q1, its least spread): the least spread keeps a group whose
ratios hardly vary from rejecting ordinary documents.  A document is held against
the narrowest group that has LEAST_ROWS rows, else against all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import workspace

LEAST_WORDS = 50
REPEATED_PERCENT = 50
SKETCH_K = 4096
LEAST_ROWS = 100
SPREAD = 3.0
#: The ratios, and the least spread of each.
RATIOS = {"symbol_ratio": 0.01, "word_length": 0.5, "dup_line_ratio": 0.02, "repeat_ratio": 0.1}

_SPACE = " \t\n\x0b\f\r"
_SYMBOLS = "#*$%&|<>"


def with_counts(docs: DataFrame) -> DataFrame:
    """docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each whole text.

    Three-word windows are compared by a 64-bit hash of their words.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keep = [F.col(f"`{c}`") for c in docs.columns]
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(_SPACE)) != "")
    rows = docs.select(
        *keep,
        F.length(F.translate(text, _SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), "").alias("_words"),
    )
    counts = [F.col("word_chars"), F.col("n_symbols")]
    windows = F.transform(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)))
    rows = rows.select(
        *keep, *counts, F.size("_words").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"), windows.alias("_w"),
    )
    counts += [F.col("n_words"), F.col("n_dup_lines")]
    # only rows with a repeated window go on to find where the windows are
    some = F.size("_w") > F.size(F.array_distinct("_w"))
    placed = F.when(some, F.array_sort(F.transform("_w", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
    rows = rows.select(*keep, *counts, placed.alias("_s"))
    same = lambda x, k: (F.get("_s", k + 1)["w"] == x["w"]) | ((k > 0) & (F.get("_s", k - 1)["w"] == x["w"]))
    starts = F.array_sort(F.transform(F.filter("_s", lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["i"]))
    rows = rows.select(*keep, *counts, starts.alias("_p"))
    covered = F.aggregate(F.transform("_p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("_p", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return rows.select(*keep, *counts, F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def _ratios() -> dict[str, Column]:
    words = F.col("n_words")
    ratio = lambda c, of: F.when(of > 0, F.col(c).cast("double") / of)
    return {
        "symbol_ratio": ratio("n_symbols", F.col("word_chars")), "word_length": ratio("word_chars", words),
        "dup_line_ratio": ratio("n_dup_lines", words), "repeat_ratio": ratio("n_repeat_words", words),
    }


def limits(counted: DataFrame) -> DataFrame:
    """lang, source, and the upper limit of each ratio.

    A null language or source is a group of its own.  Rows without words are left out
    of the sketches.
    """
    rows = counted.select("lang", "source", *[c.alias(r) for r, c in _ratios().items()]).filter("symbol_ratio is not null")
    groups = rows.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in RATIOS])
    groups = workspace.Table(groups, "sketches").df
    merge = [F.sum("n").alias("n"), *[F.kll_merge_agg_double(r, F.lit(SKETCH_K)).alias(r) for r in RATIOS]]

    def top(r: str) -> Column:
        q1, q3 = (F.kll_sketch_get_quantile_double(r, F.lit(q)) for q in (0.25, 0.75))
        return (q3 + SPREAD * F.greatest(q3 - q1, F.lit(RATIOS[r]))).alias(r)

    def tops(df: DataFrame, *keys: str) -> DataFrame:
        return df.select(*[F.col(k).alias(f"{k}_{len(keys)}") for k in keys], (F.col("n") >= LEAST_ROWS).alias(f"ok_{len(keys)}"), *[top(r).alias(f"{r}_{len(keys)}") for r in RATIOS])

    by_source = tops(groups, "lang", "source")
    by_lang = tops(groups.groupBy("lang").agg(*merge), "lang")
    total = tops(groups.agg(*merge).filter("n > 0"))
    out = by_source.join(by_lang, F.col("lang_2").eqNullSafe(F.col("lang_1"))).join(F.broadcast(total))  # one row
    pick = lambda r: F.when(F.col("ok_2"), F.col(f"{r}_2")).when(F.col("ok_1"), F.col(f"{r}_1")).otherwise(F.col(f"{r}_0"))
    return out.select(F.col("lang_2").alias("lang"), F.col("source_2").alias("source"), *[pick(r).alias(r) for r in RATIOS])


def apply_rules(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words and fails.  Other columns are ignored.  A row whose
    ratio equals its limit is kept.
    """
    counted = workspace.Table(with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text"), "counts").df
    top = workspace.Table(limits(counted), "limits").df.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), *[F.col(r).alias(f"_{r}") for r in RATIOS])
    # The limits are a row for each group; Spark broadcasts them only below its own size limit, else splits skewed groups.
    rows = counted.join(top, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")), "left")
    high = F.lit(False)
    for r, c in _ratios().items():
        high = high | F.coalesce(c > F.col(f"_{r}"), F.lit(False))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~high).alias("kept"))
