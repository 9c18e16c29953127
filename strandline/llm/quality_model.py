"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics need no language resources and read the whole text.  Trees are grown
level by level on binned values with logistic loss, and flattened into arrays
(feature, threshold, left, leaf value) that numpy walks for all rows at once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import workspace
from strandline.llm.textkernel import strings

ACCEPT = 0.3
FOLDS = 5
SAMPLE_ROWS = 20_000  # labelled rows to learn from, at most
BINS = 64
TREES, DEPTH, RATE, LEAST_ROWS, RIDGE = 80, 4, 0.15, 10, 1.0

STATISTICS = [
    "log_bytes", "log_words", "word_bytes", "long_words", "short_words", "symbols", "digits", "upper", "bars", "bangs", "stops",
    "commas", "lines_per_word", "spaces", "wide", "distinct_words", "top_word", "repeated_lines", "lines_ended", "line_words",
    "upper_words", "digit_words", "symbol_words", "distinct_pairs", "entropy",
]

_CLASSES = {"symbols": b"#*$%&<>{}[]\\^~_=@", "digits": b"0123456789", "upper": bytes(range(65, 91)), "bars": b"|", "bangs": b"!?", "stops": b".", "commas": b",;:", "spaces": b" \t\r\n\v\f", "wide": bytes(range(128, 256))}
_SYMBOLS = _CLASSES["symbols"]


def statistics(text: bytes) -> list[float]:
    """The STATISTICS of a text; zeros for an empty one."""
    n = len(text)
    words = text.split()
    if not words:
        return [math.log1p(n)] + [0.0] * (len(STATISTICS) - 1)
    share = {k: (n - len(text.translate(None, c))) / n for k, c in _CLASSES.items()}
    k = len(words)
    lens = np.fromiter(map(len, words), np.int64, k)
    count: dict[bytes, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    freq = np.fromiter(count.values(), np.float64, len(count)) / k
    digit = sum(n for w, n in count.items() if any(48 <= c <= 57 for c in w))
    symbol = sum(n for w, n in count.items() if w[-1] in _SYMBOLS or w[0] in _SYMBOLS)
    upper = sum(n for w, n in count.items() if len(w) > 1 and w.isupper())
    return [
        math.log1p(n), math.log1p(k), float(lens.mean()), float((lens > 12).mean()), float((lens <= 3).mean()),
        share["symbols"], share["digits"], share["upper"], share["bars"], share["bangs"], share["stops"], share["commas"],
        len(lines) / k, share["spaces"], share["wide"], len(count) / k, float(freq.max()), 1 - len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":") for x in lines) / len(lines), k / len(lines), upper / k, digit / k, symbol / k,
        len(set(zip(words, words[1:]))) / max(1, k - 1), float(-(freq * np.log(freq)).sum() / math.log(k + 1)),
    ]


@dataclass
class Trees:
    """Flattened trees: node i of a tree has its children at left[i] and left[i] + 1;
    leaves have left 0."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(DEPTH):
                left = self.left[at]
                step = left + (x[rows, self.feature[at]] > self.threshold[at])
                at = np.where(left > 0, step, at)
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boosted trees for labels 0 and 1; without rows of both, their rate (0.5 for none)."""
    n, m = x.shape
    rate = float(y.mean()) if n else 0.5
    base = math.log(max(rate, 1e-3) / max(1 - rate, 1e-3))
    feature, threshold, left, value, roots = [], [], [], [], []
    if n and 0 < rate < 1:
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], 1)
        margin = np.full(n, base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            roots.append(len(left))
            level = [len(left)]
            feature.append(0), threshold.append(0.0), left.append(0), value.append(0.0)
            for depth in range(DEPTH + 1):
                k = len(level)
                active = node >= 0
                gs, hs = np.bincount(node[active], g[active], k), np.bincount(node[active], h[active], k)
                for i, at in enumerate(level):
                    value[at] = -RATE * gs[i] / (hs[i] + RIDGE)
                if depth == DEPTH:
                    break
                best = np.full(k, 1e-6)
                split = np.zeros((k, 2), np.int64)
                for j in range(m):
                    if not len(cuts[j]):
                        continue
                    key = node[active] * BINS + binned[active, j]
                    gl, hl, cl = (np.cumsum(np.bincount(key, w, k * BINS).reshape(k, BINS), 1) for w in (g[active], h[active], None))
                    gain = gl**2 / (hl + RIDGE) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + RIDGE) - (gs**2 / (hs + RIDGE))[:, None]
                    gain[(cl < LEAST_ROWS) | (cl[:, -1:] - cl < LEAST_ROWS)] = 0
                    gain[:, len(cuts[j]) :] = 0
                    b = gain.argmax(1)
                    better = gain[np.arange(k), b] > best
                    best[better] = gain[np.arange(k), b][better]
                    split[better] = np.stack([np.full(k, j), b], 1)[better]
                down = np.full(k, -1)
                following = []
                for i, at in enumerate(level):
                    if best[i] > 1e-6:
                        down[i] = len(following)
                        left[at], feature[at], threshold[at] = len(left), int(split[i, 0]), float(cuts[split[i, 0]][split[i, 1]])
                        for _ in range(2):
                            following.append(len(left))
                            feature.append(0), threshold.append(0.0), left.append(0), value.append(0.0)
                rows = np.flatnonzero(active)
                i = node[rows]
                right = binned[rows, split[i, 0]] > split[i, 1]
                new = np.where(down[i] >= 0, down[i] + right, -1)
                # rows whose node is a leaf keep its value
                ended = rows[new < 0]
                margin[ended] += np.array([value[a] for a in level])[node[ended]]
                node[rows] = new
                level = following
                if not level:
                    break
            live = np.flatnonzero(node >= 0)
            margin[live] += np.array([value[a] for a in level])[node[live]] if len(live) else 0
    as_int, as_float = (lambda v: np.array(v, np.int64)), (lambda v: np.array(v, np.float64))
    return Trees(base, as_int(roots), as_int(feature), as_float(threshold), as_int(left), as_float(value))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; 0 is held out.  A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0))


def learn(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from labelled documents outside fold 0.

    At most ``sample_rows`` labels are used, those first in order of a hash of their
    id.  A document with several labels takes their mean, and 1 from a half; null
    labels and labels of no document are left out.  Only the statistics and the label
    of a row reach the driver.
    """
    workspace.ship(docs.sparkSession)
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("_id"), "quality")
    known = known.filter(fold(F.col("_id")) != 0).groupBy("_id").agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(known), "_id").select("_id", "_y", "text")  # of at most sample_rows rows

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t) for t in strings(b.column(2))]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(x, pa.list_(pa.float64()))], names=["_id", "_y", "x"])

    found = sorted(map(tuple, rows.mapInArrow(measure, "_id long, _y int, x array<double>").collect()))
    if not found:
        return fit(np.empty((0, len(STATISTICS))), np.empty(0))
    return fit(np.array([r[2] for r in found]), np.array([r[1] for r in found], float))


def with_score(docs: DataFrame, model: Trees, column: str = "score") -> DataFrame:
    """docs and the score of each text; a null text is empty.  A column of that name is replaced."""
    workspace.ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(text: pa.Array) -> pa.Array:
        texts = strings(text)
        x = np.array([statistics(t) for t in texts]).reshape(len(texts), len(STATISTICS))
        return pa.array(held.value.score(x))

    return docs.withColumn(column, F.arrow_udf(score, "double").asNondeterministic()(F.col("text").cast("string")))


def quality_scores(docs: DataFrame, labels: DataFrame, *, accept: float = ACCEPT, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    scored = with_score(docs.select("doc_id", "text"), learn(docs, labels, **options))
    scored = scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def drop_poor(docs: DataFrame, labels: DataFrame, *, accept: float = ACCEPT, **options) -> DataFrame:
    """docs without the rows that score below ``accept``.

    Null and empty texts are scored like others; rows that repeat a text stay or go
    together; an empty table stays empty.  Other columns stay as they are, whatever
    their names.
    """
    (name,) = workspace.free(docs, "_score")
    scored = with_score(docs, learn(docs, labels, **options), name)
    return scored.filter(F.col(name) >= accept).select(*[F.col(f"`{c}`") for c in docs.columns])
