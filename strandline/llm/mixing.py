"""Mixing sources to target weights by Pfair scheduling.

A source's documents are dealt into blocks.  Block j (from 0) of a source of weight
w is released at slot floor(j / w) and due by ceil((j + 1) / w).  Each slot takes,
of the released blocks, the one that is due first; on one processor this keeps every
source within one block of its share at any time.  When a source has no blocks
left, the weights of the others are scaled up and their clocks start again, so every
document is used exactly once and the shares hold among the sources that are left.

The schedule is made on the driver over blocks, whose number is bounded by
MAX_BLOCKS whatever the input: blocks grow instead.
"""

from __future__ import annotations

import heapq
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BLOCKS = 50_000
LEAST_BLOCK = 8
BUCKET_ROWS = 4_000
NAMES = ("_source", "_block", "_slot", "_position")
ALPHA = 0.5
_PER = 1_000_000


def tempered(counts: dict[str | None, int], alpha: float = ALPHA) -> dict[str | None, Fraction]:
    """Weights in proportion to the sizes to the power alpha."""
    raw = {s: max(1, round(n**alpha * _PER)) for s, n in counts.items()}
    total = sum(raw.values())
    return {s: Fraction(v, total) for s, v in raw.items()}


def schedule(blocks: dict[str | None, int], weights: dict[str | None, Fraction]) -> list[tuple[str | None, int]]:
    """(source, block) of each slot.  Sources of weight 0 follow the others, by name."""
    name = lambda s: (s is not None, s or "")
    out: list[tuple[str | None, int]] = []
    left = {s: n for s, n in blocks.items() if n > 0}
    done = dict.fromkeys(left, 0)
    active = sorted((s for s in left if weights.get(s, 0) > 0), key=name)
    while active:
        total = sum((Fraction(weights[s]) for s in active), Fraction(0))
        share = {s: Fraction(weights[s]) / total for s in active}
        rank = {s: i for i, s in enumerate(active)}
        waiting = [(0, rank[s], s, 0) for s in active]  # by release
        ready: list[tuple[int, int, str | None, int]] = []  # by deadline
        t, ended = 0, False
        while not ended:
            while waiting and waiting[0][0] <= t:
                _, r, s, j = heapq.heappop(waiting)
                w = share[s]
                heapq.heappush(ready, (-((-(j + 1) * w.denominator) // w.numerator), r, s, j))
            _, r, s, j = heapq.heappop(ready)
            out.append((s, done[s]))
            done[s] += 1
            t += 1
            if done[s] == left[s]:
                ended = True
            else:
                w = share[s]
                heapq.heappush(waiting, ((j + 1) * w.denominator // w.numerator, r, s, j + 1))
        active = [s for s in active if done[s] < left[s]]
    for s in sorted((s for s in left if done[s] < left[s]), key=name):
        out += [(s, j) for j in range(done[s], left[s])]
    return out


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, *, alpha: float = ALPHA, max_blocks: int = MAX_BLOCKS, least_block: int = LEAST_BLOCK, names: tuple[str, ...] = NAMES) -> DataFrame:
    """docs with the columns ``names``: source, block, slot and position of each row in the mix.

    ``weights``: target of each source, null a source of its own; sources not named
    have weight 0 and follow at the end.  None: in proportion to the sizes to the
    power ``alpha``.  Within a source the order is that of a hash of doc_id and text
    (where there is one), then doc_id, then the text's own hash, so it does not depend on
    how the rows are stored; rows equal in both are interchangeable.  Rows without doc_id
    are dealt by where they lie, as all of them may have one text: docs with such rows
    has to be a stored table, so that they lie where they lay.
    Columns of these names are replaced, others stay as they are.  An empty table stays empty.

    A source's rows are numbered in buckets of a hash, so a source of any size is
    dealt over many tasks.
    """
    spark = docs.sparkSession
    docs = docs.drop(*names)
    columns = docs.columns
    docs = docs.toDF(*[c if c in ("doc_id", "source", "text") else f"c{i}" for i, c in enumerate(columns)])  # no name clashes with those below
    own = [F.col(f"`{c}`").alias(name) for c, name in zip(docs.columns, columns)]
    total = docs.count()
    buckets = max(1, -(-total // BUCKET_ROWS))
    text = F.col("text") if "text" in docs.columns else F.lit(None).cast("string")
    order = F.xxhash64(F.col("doc_id"), text.cast("string"), F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    keyed = docs.withColumn("_source", F.col("source").cast("string")).withColumn("_o", order).withColumn("_w", F.xxhash64(text.cast("string"))).withColumn("_q", F.pmod("_o", F.lit(buckets)))
    sizes = keyed.groupBy("_source", "_q").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    counts = {r["_source"]: r["n"] for r in sizes.groupBy("_source").agg(F.sum("_n").alias("n")).collect()}  # a row for each source
    if not counts:
        return docs.select(*own, *[F.lit(None).cast(k).alias(c) for c, k in zip(names, ("string", "long", "long", "long"))])
    size = max(least_block, -(-total // max(1, max_blocks - len(counts))))
    blocks = {s: -(-n // size) for s, n in counts.items()}
    shares = {s: Fraction(w).limit_denominator(_PER) for s, w in weights.items()} if weights is not None else tempered(counts, alpha)
    rows, at = [], 0
    for slot, (s, j) in enumerate(schedule(blocks, shares)):
        rows.append((s, j, slot, at))
        at += min(size, counts[s] - j * size)
    plan = spark.createDataFrame(rows, "_s string, _block long, _slot long, _first long")
    within = Window.partitionBy("_source", "_q").orderBy("_o", "doc_id", "_w")
    ranked = keyed.withColumn("_r", F.row_number().over(within) - 1)
    offsets = offsets.select(F.col("_source").alias("_os"), F.col("_q").alias("_oq"), "_before")
    ranked = ranked.join(offsets, F.col("_source").eqNullSafe(F.col("_os")) & (F.col("_q") == F.col("_oq")))
    ranked = ranked.withColumn("_rank", F.col("_r") + F.col("_before")).withColumn("_b", F.floor(F.col("_rank") / size))
    # the plan has at most max_blocks + sources rows
    placed = ranked.join(F.broadcast(plan), F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_block")))
    position = (F.col("_first") + F.col("_rank") % size).cast("long")
    return placed.select(*own, *[c.alias(n) for c, n in zip((F.col("_source"), F.col("_block"), F.col("_slot"), position), names)])
