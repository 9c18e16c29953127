"""Near-duplicate documents by a chosen-path set similarity join.

A document's set is its distinct 5-word shingles.  Equal sets are merged first, so
copies cost a row each and nothing more.  Over the merged sets:

1. Every set gets a signature of COORDINATES min-hashes.  The root of each of TREES
   trees branches on a coordinate of its own: sets with the same min-hash share a
   child.  Nodes of one set end there.  A node of more than NODE sets branches
   again on BRANCHES further coordinates that its path chooses, to DEPTH levels,
   unless one child would keep DENSE of its sets: such a node holds one cluster,
   and branching would only repeat it.  A pair at the threshold t shares a child of
   the root with probability t in each tree, so 9 trees lose fewer than one in a
   million of them; each further level loses at most (1 - t) ** BRANCHES.
2. Nodes are compared exhaustively on signatures, a dense or last one in tiles, so
   no task holds it whole.  Pairs whose estimate is within MARGIN standard errors of
   the threshold connect sets; a node returns a spanning forest of them, so the
   rows that leave it are fewer than those that entered.  A tile of two chunks
   returns only what joins them.
3. The components of these candidate links, dealt in tiles, are confirmed on the
   full sets: exact intersections of all pairs of a tile from a product of
   incidence matrices.  A tile returns a spanning forest of its links, which has
   the same components as the links.
4. Components: minimum labels with pointer jumping, a written table each round.

A cluster of n different near copies makes about (n / TILE) ** 2 / 2 tiles of
bounded work, dealt by a hash: no pair is left out, and the work grows with the
square of the cluster, though the rows only by n / TILE.
"""

from __future__ import annotations

import hashlib
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import workspace
from strandline.llm.textkernel import Words, grouped, mix, strings

SHINGLE = 5
THRESHOLD = 80  # per cent
COORDINATES = 64
TREES = 9
BRANCHES = 3
DEPTH = 4
NODE = 512
DENSE = 0.5
CHUNK = 1024
MARGIN = 4.5
TILE = 128

_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)
_SET = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary())])
SET_COLUMNS = "doc_id long, n_shingles long, set_key binary, signature binary"


def shingle_sets(texts: list[bytes], k: int = SHINGLE):
    """For each text its sorted distinct shingle hashes; fewer words than k are one shingle."""
    for _, group in grouped(texts):
        words = Words(group, "space")
        grams = words.grams(k)
        for d in range(len(group)):
            a, b = int(words.of[d]), int(words.of[d + 1])
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            else:
                yield np.array([words.whole(d)] if b > a else [], np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum over the shingles for each coordinate, as 32 bits."""
    low = np.empty(COORDINATES, np.uint32)
    for c in range(COORDINATES):
        low[c] = (shingles * _SEEDS[c]).min() >> np.uint64(32)
    return low


def _describe(texts: list[bytes], k: int):
    for s in shingle_sets(texts, k):
        if len(s):
            key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
            yield len(s), key, signature(s).tobytes()
        else:
            yield 0, None, None


def describe_sets(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the set) and signature of each document."""

    def run(batches):
        for batch in batches:
            n, key, sig = zip(*_describe(strings(batch.column(1)), k)) if batch.num_rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], schema=_SET)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, SET_COLUMNS)


def _child(path, coordinate, value):
    return F.xxhash64(path, coordinate, value)


def _coordinate(column, index):
    """Four bytes of the signature, as hex: the value of a coordinate."""
    return F.substring(column, index * 4 + 1, F.lit(4))


def tree_nodes(sets: DataFrame, *, node: int = NODE) -> tuple[DataFrame, list[workspace.Table]]:
    """(node, rep, large) of all nodes to compare, and the tables behind them."""
    roots = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    level = sets.select("rep", "signature", roots.alias("tree"))
    level = level.select("rep", _child(F.lit(0), F.col("tree"), _coordinate(F.col("signature"), F.col("tree"))).alias("node"))
    tables, done = [], []
    for depth in range(DEPTH):
        counts = level.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        table = workspace.Table(level.join(counts, "node").select("node", "rep", "n"), "level")
        tables.append(table)
        done.append(table.df.filter(F.col("n") <= node).select("node", "rep", F.lit(False).alias("large")))
        large = table.df.filter(F.col("n") > node)
        if large.isEmpty():
            break
        if depth == DEPTH - 1:
            done.append(large.select("node", "rep", F.lit(True).alias("large")))
            break
        turn = F.explode(F.sequence(F.lit(0), F.lit(BRANCHES - 1)))
        chosen = F.pmod(F.xxhash64("node", "turn"), F.lit(COORDINATES)).cast("int")
        branch = large.join(sets, "rep").select("rep", "node", "n", "signature", turn.alias("turn")).withColumn("c", chosen)
        branch = branch.select("rep", "node", "n", _child(F.col("node"), F.col("c"), _coordinate(F.col("signature"), F.col("c"))).alias("child"))
        branch = workspace.Table(branch.distinct(), "branch")
        tables.append(branch)
        dense = branch.df.groupBy("node", "n", "child").agg(F.count("*").alias("m")).filter(F.col("m") >= DENSE * F.col("n")).select("node").distinct()
        done.append(large.join(dense, "node", "left_semi").select("node", "rep", F.lit(True).alias("large")))
        level = branch.df.join(dense, "node", "left_anti").select("rep", F.col("child").alias("node"))
    nodes = done[0]
    for d in done[1:]:
        nodes = nodes.unionByName(d)
    return nodes, tables


def _similar(a: np.ndarray, least: int) -> np.ndarray:
    """Which signatures agree in at least that many coordinates."""
    same = np.zeros((len(a), len(a)), np.uint8)
    for c in range(COORDINATES):
        same += a[:, c, None] == a[None, :, c]
    return same >= least


def forest(near: np.ndarray, parts: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric relation; in a tile of two parts only what joins
    them, as the tile of each part has its own."""
    label, out = np.arange(len(near)), []
    for within in ([True, False] if (parts != parts[0]).any() else [False]):
        for x in range(len(near)):
            other = np.flatnonzero(near[x] & (parts == parts[x]) if within else near[x])
            other = other[label[other] != label[x]]
            while len(other):
                j = int(other[0])
                if not within:
                    out.append((x, j))
                label[label == label[j]] = label[x]
                other = other[label[other] != label[x]]
    return out


def _least(threshold: float) -> int:
    return int(COORDINATES * (threshold - MARGIN * (threshold * (1 - threshold) / COORDINATES) ** 0.5))


def node_links(rows: DataFrame, threshold: float) -> DataFrame:
    """(a, b): sets of a node that may be linked, as a spanning forest for each node,
    from rows (node, rep, part, signature) clustered by node."""
    least = _least(threshold)

    def close(reps, parts, sigs):
        n = len(reps)
        matrix = np.frombuffer(b"".join(sigs), np.uint32).reshape(n, COORDINATES)
        if n == 2:
            return [(reps[0], reps[1])] if int((matrix[0] == matrix[1]).sum()) >= least else []
        return [(reps[x], reps[y]) for x, y in forest(_similar(matrix, least), np.array(parts))]

    def run(batches):
        at, reps, parts, sigs = None, [], [], []
        for batch in batches:
            out = []
            for node, rep, part, sig in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if node != at:
                    if len(reps) > 1:
                        out += close(reps, parts, sigs)
                    at, reps, parts, sigs = node, [], [], []
                reps.append(rep)
                parts.append(part)
                sigs.append(sig)
            if out:
                yield _links(out)
        if len(reps) > 1 and (out := close(reps, parts, sigs)):
            yield _links(out)

    return rows.mapInArrow(run, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([f(p) for p in pairs], pa.int64()) for f in (min, max)], names=["a", "b"])


def in_tiles(members: DataFrame, key: str, size: int) -> DataFrame:
    """members once for each tile (a pair of chunks of its group) that it belongs to.

    A member's chunk comes from a hash of its rep; the chunks of a group follow its
    count, so tiles have about 2 * size members however large the group.
    """
    counts = members.groupBy(key).agg(F.count("*").alias("_n"))
    rows = members.join(counts, key).withColumn("_c", F.ceil(F.col("_n") / size).cast("int"))
    rows = rows.withColumn("_m", F.pmod(F.xxhash64("rep"), F.col("_c")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("_c") - 1), lambda o: F.struct(F.least("_m", o).alias("a"), F.greatest("_m", o).alias("b")))
    rows = rows.withColumn("_t", F.explode(pairs))
    return rows.withColumn("tile", F.xxhash64(key, "_t.a", "_t.b")).withColumn("part", F.col("_m")).drop("_n", "_c", "_m", "_t")


def exact_links(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The links among the sets of a tile, from exact intersections."""
    n = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, n)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1
    owner, column = owner[often], column[often]
    common = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[True], column[1:] != column[:-1]])) - 1
        width = 8192
        for lo in range(0, int(column[-1]) + 1, width):
            a, b = np.searchsorted(column, [lo, lo + width])
            m = np.zeros((n, min(width, int(column[-1]) + 1 - lo)), np.float32)
            m[owner[a:b], column[a:b] - lo] = 1
            common += m @ m.T
    both = common.astype(np.int64)
    return 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)


def confirmed(rows: DataFrame, percent: int, k: int) -> DataFrame:
    """(a, b): links between members of a tile, from rows (tile, rep, part, text) clustered by tile."""

    def tile(reps, parts, texts):
        near = exact_links(list(shingle_sets(texts, k)), percent)
        return [(reps[i], reps[j]) for i, j in forest(near, np.array(parts))]

    def run(batches):
        at, reps, parts, texts = None, [], [], []
        for batch in batches:
            out, column = [], strings(batch.column(3))
            for key, rep, part, text in zip(*(batch.column(i).to_pylist() for i in range(3)), column):
                if key != at:
                    if len(reps) > 1:
                        out += tile(reps, parts, texts)
                    at, reps, parts, texts = key, [], [], []
                if not reps or (reps[-1], texts[-1]) != (rep, text):  # a repeated row adds nothing
                    reps.append(rep)
                    parts.append(part)
                    texts.append(text)
            if out:
                yield _links(out)
        if len(reps) > 1 and (out := tile(reps, parts, texts)):
            yield _links(out)

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> tuple[DataFrame, list[workspace.Table]]:
    """(rep, component): the smallest id reachable over the links (a, b), a < b."""
    both = workspace.Table(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = workspace.Table(both.df.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "rep"), "labels")
    while True:
        near = both.df.join(labels.df, F.col("b") == F.col("rep")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.df.join(near, F.col("rep") == F.col("a")).select("rep", "label", F.least("label", "near").alias("next"))
        to = labels.df.select(F.col("rep").alias("at"), F.col("label").alias("far"))
        step = step.join(to, F.col("next") == F.col("at")).select("rep", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved"))
        table = workspace.Table(step, "labels")
        moving = not table.df.filter("moved").isEmpty()
        labels.drop()
        labels = table
        if not moving:
            return labels.df.select("rep", F.col("label").alias("component")), [both, labels]


def near_duplicates(docs: DataFrame, *, percent: int = THRESHOLD, shingle: int = SHINGLE, node: int = NODE, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of docs.

    Words are runs of other than ASCII white space, with A-Z in lower case.  Rows
    whose set is empty (null or empty text) are linked with nothing.  A row without
    doc_id is linked with nothing, has no component and is kept.  Rows that repeat a
    doc_id are one vertex; all of them are returned.  Other columns are ignored.
    """
    workspace.ship(docs.sparkSession)
    described = workspace.Table(describe_sets(docs, shingle), "sets")
    full = described.df.filter("n_shingles > 0 and doc_id is not null")
    classes = workspace.Table(full.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "classes")
    member = full.select("doc_id", "set_key").join(classes.df, "set_key").select("doc_id", "rep")
    reps = full.join(classes.df.select("rep", F.col("set_key").alias("_key")), (F.col("doc_id") == F.col("rep")) & (F.col("set_key") == F.col("_key"))).select("rep", "signature")
    sets = workspace.Table(reps.dropDuplicates(["rep", "signature"]), "signatures")

    nodes, levels = tree_nodes(sets.df, node=node)
    small = nodes.filter(~F.col("large")).select("node", "rep", F.lit(0).alias("part"))
    large = in_tiles(nodes.filter("large").select("node", "rep"), "node", CHUNK).select(F.col("tile").alias("node"), "rep", "part")
    rows = small.union(large).join(sets.df, "rep").select("node", "rep", "part", "signature")
    maybe, tables = components(node_links(rows.repartition("node").sortWithinPartitions("node", "rep"), percent / 100).filter("a < b"))
    for t in levels:
        t.drop()

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    tiles = in_tiles(maybe, "component", tile).select("tile", "rep", "part").join(texts, "rep").select("tile", "rep", "part", "text")
    links = confirmed(tiles.repartition("tile").sortWithinPartitions("tile", "rep"), percent, shingle)
    split = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b")
    split = split.join(member, "doc_id").filter("rep > a").select("a", F.col("rep").alias("b"))
    label, _ = components(links.union(split).filter("a < b"))
    for t in tables:
        t.drop()

    component = member.join(label, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("c"))
    component = component.groupBy("doc_id").agg(F.min("c").alias("component_id"))
    out = described.df.select("doc_id", "n_shingles").join(component, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that near_duplicates() does not keep.

    Of rows that repeat a doc_id of a kept document all stay if their texts are equal
    or not: they are one document.
    """
    drop = near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias("_drop")).distinct()
    return docs.join(drop, docs["doc_id"].cast("long") == drop["_drop"], "left_anti")


def brute_force(docs: list[tuple[int, str | None]], percent: int = THRESHOLD, k: int = SHINGLE) -> list[tuple]:
    """The result's rows from all pairs of word-tuple sets; for tests."""
    import re

    sets = []
    for _, text in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    up = list(range(len(docs)))

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    low: dict[int, int] = {}
    for i, (doc, _) in enumerate(docs):
        low[root(i)] = min(doc, low.get(root(i), doc))
    return [(doc, len(sets[i]), low[root(i)], doc == low[root(i)]) for i, (doc, _) in enumerate(docs)]
