"""Cycle-safe graph operators over (id, parent_id) edges.

Each round is a join with the frontier and an anti join with what was seen; results of
rounds are tables in the shared folder, so plans stay small, the next join knows their
size, and a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.sources import files


def _cut(df: DataFrame) -> DataFrame:
    """df without its lineage: a table in the shared folder, of known size."""
    path = files.scratch(df.sparkSession, "cut")
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, starts: DataFrame, *, up: bool = False) -> DataFrame:
    """(start, id, depth): everything below (or above) each start, itself at depth 0.

    edges: (id, parent_id).  Each pair appears once, at its least depth, so cycles end.
    """
    steps = edges.filter("parent_id is not null").select(F.col("id").alias("_c"), F.col("parent_id").alias("_p"))
    src, dst = ("_c", "_p") if up else ("_p", "_c")
    seen = _cut(starts.select(F.col("id").alias("start"), "id", F.lit(0).cast("long").alias("depth")).distinct())
    frontier, depth = seen, 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(steps, F.col("id") == F.col(src)).select("start", F.col(dst).alias("id")).distinct()
        frontier = _cut(step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        seen = seen.unionByName(frontier)
    return seen


def roots(edges: DataFrame) -> DataFrame:
    """(id, root, depth) by pointer jumping: log2(depth) rounds.

    A chain ends at a node without parent or whose parent is no node; the root is then
    that node, or null where the parent is missing.  A node on or below a cycle has a
    null root and depth -1.
    """
    nodes = edges.groupBy("id").agg(F.min("parent_id").alias("ptr"))
    state = _cut(nodes.select("id", F.col("ptr"), F.when(F.col("ptr").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("ptr").isNull().alias("done"), F.when(F.col("ptr").isNull(), F.col("id")).alias("root")))
    done, near = state.filter("done"), state.filter("not done")
    rounds = max(1, int(state.count()).bit_length() + 1)
    for _ in range(rounds):
        # finished rows are read by the next rounds and never written again
        to = done.unionByName(near).select(F.col("id").alias("_id"), F.col("ptr").alias("_ptr"), F.col("depth").alias("_depth"), F.col("done").alias("_done"), F.col("root").alias("_root"))
        rows = near.join(to, F.col("ptr") == F.col("_id"), "left")
        lost = F.col("_id").isNull()
        rows = _cut(rows.select(
            "id", F.when(lost | F.col("_done"), None).otherwise(F.col("_ptr")).alias("ptr"), F.when(lost, F.col("depth")).otherwise(F.col("depth") + F.col("_depth")).alias("depth"),
            (lost | F.col("_done")).alias("done"), F.when(F.col("_done"), F.col("_root")).cast(state.schema["root"].dataType).alias("root"),
        ))
        done, near = done.unionByName(rows.filter("done")), rows.filter("not done")
        if near.isEmpty():
            break
    state = done.unionByName(near)
    return state.select("id", F.when(F.col("done"), F.col("root")).alias("root"), F.when(F.col("done"), F.col("depth")).otherwise(-1).cast("long").alias("depth"))


def depth_first(edges: DataFrame, order: DataFrame) -> DataFrame:
    """(id, path): sorting by path lists parents before children and siblings by rank.

    order: (id, rank), ranks of any type that sorts.  path has the ranks from the top
    down; nodes on cycles are late, and follow by rank.
    """
    ranked = order.select(F.col("id").alias("_o"), F.col("rank").alias("_rank"))
    nodes = _cut(edges.select("id", "parent_id").join(ranked, F.col("id") == F.col("_o")).select("id", "parent_id", "_rank"))  # every level reads them
    known = nodes.select(F.col("id").alias("_k"))
    top = nodes.join(known, F.col("parent_id") == F.col("_k"), "left_anti")
    frontier = _cut(top.select("id", F.array("_rank").alias("ranks")))
    done = frontier
    while not frontier.isEmpty():
        below = nodes.join(frontier.select(F.col("id").alias("_p"), F.col("ranks").alias("_ranks")), F.col("parent_id") == F.col("_p"))
        frontier = _cut(below.select("id", F.concat("_ranks", F.array("_rank")).alias("ranks")))
        done = done.unionByName(frontier)
    rest = nodes.join(done.select(F.col("id").alias("_d")), F.col("id") == F.col("_d"), "left_anti").select("id", F.array("_rank").alias("ranks"))
    path = lambda rows, late: rows.select("id", F.struct(F.lit(late).alias("late"), "ranks").alias("path"))
    return path(done, False).unionByName(path(rest, True))
