"""Benchmark decontamination by winnowing.

With k-grams of K words and windows of W k-grams, every span of K + W - 1 = 13
shared words has a window whose smallest k-gram hash is the same on both sides, so
joining the window minima of documents with those of the benchmark finds every
shared span.  A hit is extended to its 13 words and confirmed on the words.  Items
of fewer words are one window each and are looked up at every position.

One pass over the documents, whatever the size of the benchmark: the fingerprints
of the benchmark are a bitmap of FILTER_BITS bits, which every task holds; places
that pass it on all their hashes go into a join with the benchmark's windows, on
hash and words, which decides.  A benchmark that fills the bitmap makes the join
larger and the result no different.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import workspace
from strandline.llm.textkernel import Words, grouped, mix, sliding_min, strings

SPAN = 13
K, W = 5, 9
FILTER_BITS = 1 << 27  # 16 MB, of which only the parts in use are sent
_CHUNK = 1 << 15  # bits in a value of bitmap_construct_agg
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WINDOW = "size int, h long, words binary, mark long, item string"
_PLACE = pa.struct([("at", pa.int64()), ("size", pa.int32()), ("h", pa.int64()), ("words", pa.binary())])
_SCAN = "struct<n_words:bigint,places:array<struct<at:bigint,size:int,h:bigint,words:binary>>>"


def _slot(hashes: np.ndarray, kind: int, bits: int) -> np.ndarray:
    """Where a hash lies in the bitmap; kind 0: winnowing marks, else windows of that many words."""
    return (mix(hashes ^ np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(bits)).astype(np.int64)


def item_windows(benchmark: DataFrame, span: int, k: int) -> DataFrame:
    """(size, h, words, mark, item) of every window of every item; mark is the smallest
    k-gram hash, null in short windows."""

    def run(batches):
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), strings(batch.column(1))):
                w = Words([text], "alnum")
                size = min(span, len(w))
                if not size:
                    continue
                h = w.grams(size).view(np.int64).tolist()
                marks = sliding_min(w.grams(k), span - k + 1).view(np.int64).tolist() if size == span else [None]
                rows += [(size, x, w.joined(i, i + size), m, item) for i, (x, m) in enumerate(zip(h, marks))]
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["size", "h", "words", "mark", "item"])

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, _WINDOW)


def fingerprints(windows: DataFrame, bits: int) -> tuple[dict[int, bytes], list[int]]:
    """The bitmap of all marks and windows, as chunks that are not empty, and the window sizes."""

    def run(batches):
        for batch in batches:
            size, h, mark = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            slots = [_slot(h[size == n].view(np.uint64), int(n), bits) for n in np.unique(size)]
            marks = batch.column(3).drop_null().to_numpy().view(np.uint64)
            yield pa.record_batch([pa.array(np.unique(np.concatenate([*slots, _slot(marks, 0, bits)])), pa.int64())], names=["slot"])

    slots = windows.mapInArrow(run, "slot long").select((F.col("slot") + 1).alias("slot"))
    chunks = slots.groupBy(F.expr("bitmap_bucket_number(slot)").alias("chunk")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(slot))").alias("part"))
    held = {int(r.chunk) - 1: bytes(r.part) for r in chunks.collect()}  # FILTER_BITS / 8 bytes at most
    return held, sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most SPAN


class Filter:
    """The bitmap in a task."""

    def __init__(self, chunks: dict[int, bytes], sizes: list[int], bits: int, span: int, k: int):
        self.bits, self.sizes, self.span, self.k = bits, sizes, span, k
        self.at = np.full(-(-bits // _CHUNK), -1, np.int64)
        self.at[list(chunks)] = np.arange(len(chunks))
        self.parts = np.frombuffer(b"".join(chunks.values()), np.uint8)

    def has(self, hashes: np.ndarray, kind: int) -> np.ndarray:
        slot = _slot(hashes, kind, self.bits)
        part = self.at[slot // _CHUNK]
        out = part >= 0
        bit = slot[out] % _CHUNK
        out[out] = self.parts[part[out] * (_CHUNK // 8) + bit // 8] >> (bit % 8).astype(np.uint8) & 1 > 0
        return out


def places(words: Words, held: Filter) -> list[tuple[int, int, int]]:
    """(first word, length, hash) of the places that pass the filter."""
    out = []
    for size in held.sizes:
        if size == held.span:
            low = sliding_min(words.grams(held.k), held.span - held.k + 1)
            if not len(low):
                continue
            change = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
            at = np.flatnonzero(np.repeat(held.has(low[change], 0), np.diff(np.append(change, len(low)))))
        else:
            at = np.arange(max(0, len(words) - size + 1))
        if len(at):
            h = words.grams(size)[at]
            good = held.has(h, size)
            out += [(i, size, x) for i, x in zip(at[good].tolist(), h[good].view(np.int64).tolist())]
    return out


def scan(texts: list[bytes], held: Filter) -> list[dict]:
    """For each text: its number of words, and the places to confirm."""
    out = []
    for _, group in grouped(texts):
        words = Words(group, "alnum")
        rows = [{"n_words": int(n), "places": []} for n in np.diff(words.of)]
        for i, size, h in places(words, held):
            d = int(np.searchsorted(words.of, i, side="right")) - 1
            if i + size <= words.of[d + 1]:
                rows[d]["places"].append({"at": i - int(words.of[d]), "size": size, "h": h, "words": words.joined(i, i + size)})
        out += rows
    return out


def _key(text):
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, span: int = SPAN, k: int = K, bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """What a text has from the benchmark, and how many words each row has.

    The first table has a row for each different text that holds a window: _key (MD5 of
    the text), n_hit, n_full (windows of ``span`` words), hits (array of start and end,
    in words) and items; the second has a row for each row of docs: doc_id, _key, n_words.

    Null and empty texts have no words; a text without words is never hit.  Items
    without words match nothing.  Items that share an item_id count once; what an
    item without id matches is hit but not named.  Rows that repeat a text are looked
    up once.
    """
    spark = docs.sparkSession
    workspace.ship(spark)
    windows = workspace.Table(item_windows(benchmark, span, k), "benchmark").df
    chunks, sizes = fingerprints(windows, bits)
    sent, cache = spark.sparkContext.broadcast((chunks, sizes)), {}  # bounded by bits

    def look(text: pa.Array) -> pa.Array:
        if "filter" not in cache:
            cache["filter"] = Filter(*sent.value, bits, span, k)
        return pa.array(scan(strings(text), cache["filter"]), pa.struct([("n_words", pa.int64()), ("places", pa.list_(_PLACE))]))

    text = F.col("text").cast("string")
    look_up = F.arrow_udf(look, _SCAN).asNondeterministic()
    seen = docs.select((F.col("doc_id") if "doc_id" in docs.columns else F.lit(None).cast("long")).alias("doc_id"), _key(F.col("text")).alias("_key"), look_up(text).alias("f"))
    seen = workspace.Table(seen.select("doc_id", "_key", "f.n_words", "f.places"), "places").df
    found = seen.filter(F.size("places") > 0).select("_key", F.explode("places").alias("p")).select("_key", "p.*").dropDuplicates(["_key", "at", "size"])
    named = windows.groupBy("h", "size", "words").agg(F.collect_set("item").alias("items"))
    hits = workspace.Table(found.join(named, ["h", "size", "words"]).select("_key", "at", "size", "items"), "hits").df
    # windows that touch are one span: a span begins where no window before reaches
    by = Window.partitionBy("_key").orderBy("at", "size")
    reach = F.max(F.col("at") + F.col("size")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    begun = hits.select("_key", "at", "size", F.coalesce(F.col("at") > reach, F.lit(True)).cast("int").alias("_new"))
    begun = begun.withColumn("_span", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = begun.groupBy("_key", "_span").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("size")).alias("end"), F.count_if(F.col("size") == span).alias("n"))
    spans = spans.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("at", "end"))).alias("hits"), F.sum("n").alias("n_full"))
    items = hits.select("_key", F.explode_outer("items").alias("item")).groupBy("_key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["at"])
    return spans.join(items, "_key").select("_key", n_hit.alias("n_hit"), "n_full", "hits", "items"), seen.select("doc_id", "_key", "n_words")


def contaminated(n_words, n_hit):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the rows that leak: those that hold a window of ``span`` benchmark words
    anywhere, and those of which at least a twentieth is benchmark text (shorter items).

    No text that is left holds a window of ``span`` words of the benchmark.  Rows with
    null or empty text stay; rows that repeat a text stay or go together.  Other columns
    stay as they are, whatever their names; an empty table stays empty.
    """
    found, rows = find_leaks(docs.select("text"), benchmark, **options)
    (name,) = workspace.free(docs, "_leak")
    leaks = rows.join(found, "_key").filter((F.col("n_full") > 0) | contaminated(F.col("n_words"), F.col("n_hit"))).select(F.col("_key").alias(name)).distinct()
    return docs.join(workspace.Table(leaks, "leaks").df, _key(docs["text"]) == F.col(name), "left_anti")


def leak_report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items."""
    found, rows = find_leaks(docs.select("doc_id", "text"), benchmark, **options)
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",")
    out = rows.join(workspace.Table(found, "found").df, "_key", "left").withColumn("n_hit", n_hit)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
        items.alias("items"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]], span: int = SPAN) -> list[tuple]:
    """The report's rows, compared position by position; for tests."""

    def split(text):
        return _WORD.findall((text or "").encode().lower())

    out = []
    for doc, text in docs:
        words, hit, names = split(text), set(), set()
        for name, item in items:
            w = split(item)
            size = min(span, len(w))
            windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
            for i in range(len(words) - size + 1) if windows else ():
                if tuple(words[i : i + size]) in windows:
                    hit.update(range(i, i + size))
                    names.add(str(name))
        out.append((doc, len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    return out
