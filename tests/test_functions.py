"""Scalar functions, bins and graph operators on small inputs."""

import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from strandline.functions import bins, scalars, vocabulary
from strandline.operators import graph, intervals, reconcile


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_percent_decode_equals_unquote(spark):
    texts = ["a%3Bb", "100%", "%zz%41", "a+b", "%25", "%C3%A9x", "", "a%2"]
    assert values(spark, texts, scalars.percent_decode) == [unquote(t) for t in texts]


def test_score_text_is_percent_g(spark):
    xs = [0.41, 1.0, 0.0, 123456.0, 1234567.0, 1e-5, 0.0001, 2.5e-10, -3.25, 99.9999, 12.3456789]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)] + [(99, None)], "i int, x double")
    got = [r[0] for r in df.orderBy("i").select(scalars.score_text(F.col("x"))).collect()]
    assert got == ["%g" % x for x in xs] + ["."]


def test_attributes(spark):
    df = spark.createDataFrame([("ID=a%3D1; Parent=p ;Tags=x,y;tags=z;Tags=w;;",), (".",), ("",), (None,)], "t string").select(scalars.parse_attributes(F.col("t")).alias("a"))
    got = [[(x.key, x["values"]) for x in r.a] for r in df.collect()]
    assert got[0] == [("ID", ["a=1"]), ("Parent", ["p"]), ("Tags", ["x", "y", "w"]), ("tags", ["z"])] and got[1:] == [[], [], []]


def test_bins(spark):
    rnd = random.Random(5)
    spans = []
    for _ in range(3000):
        s, q = rnd.randint(1, 1 << rnd.randint(4, 37)), rnd.randint(1, 1 << rnd.randint(4, 37))
        spans.append((s, s + rnd.randint(0, 1 << rnd.randint(1, 30)), q, q + rnd.randint(0, 1 << rnd.randint(1, 20))))
        spans.append((s, s + 100, max(1, s - 50), s + 50))
    df = spark.createDataFrame(spans, "a long, b long, c long, d long").filter("a <= d and b >= c")
    lost = df.filter(~F.array_contains(bins.bins_overlapping(F.col("c"), F.col("d")), bins.bin_of(F.col("a"), F.col("b"))))
    assert df.count() > 2000 and lost.count() == 0
    one = spark.range(1).select(bins.bin_of(F.lit(1), F.lit(1 << 14), 5), bins.bin_of(F.lit(1), F.lit((1 << 14) + 1), 5)).first()
    assert tuple(one) == (4681, 585)


def test_cycles_end(spark):
    e = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("x", "y"), ("y", "x"), ("z", "x"), ("o", "missing")], "id string, parent_id string")
    below = {tuple(r) for r in graph.closure(e, spark.createDataFrame([("a",), ("x",)], "id string")).collect()}
    assert below == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("x", "x", 0), ("x", "y", 1), ("x", "z", 1)}
    roots = {r.id: (r.root, r.depth) for r in graph.roots(e).collect()}
    assert roots["c"] == ("a", 2) and roots["a"] == ("a", 0) and roots["o"] == (None, 1) and roots["x"][0] is None and roots["z"] == (None, -1)
    order = spark.createDataFrame([(c, i) for i, c in enumerate("abcxyzo")], "id string, rank int")
    path = {r.id: r.path for r in graph.depth_first(e, order).collect()}
    assert sorted(path, key=path.get) == ["a", "b", "c", "o", "x", "y", "z"]


@pytest.mark.parametrize("text,spans,strand", [("join(1..5,<7..>9)", [(1, 5), (7, 9)], "+"), ("complement(4)", [(4, 4)], "-"), ("complement(join(1..2,4..6))", [(1, 2), (4, 6)], "-"), ("join(complement(4..6),complement(1..2))", [(4, 6), (1, 2)], "-"), ("join(1..2,complement(4..6))", [(1, 2), (4, 6)], None), ("complement(complement(1..2))", [(1, 2)], None)])
def test_locations(spark, text, spans, strand):
    r = spark.range(1).select(scalars.location_spans(F.lit(text)).alias("s"), scalars.location_strand(F.lit(text)).alias("d")).first()
    assert [tuple(x) for x in r.s] == spans and r.d == strand


def test_vocabulary(spark):
    assert len(vocabulary.rows()) == 46 and len(vocabulary.content_hash()) == 64
    got = spark.createDataFrame([("transcript",), ("gene",), ("odd",)], "t string").select(vocabulary.canonical(F.col("t"))).collect()
    assert [r[0] for r in got] == ["mRNA", "gene", "odd"]


def test_empty_inputs(spark):
    e = spark.createDataFrame([], "id string, parent_id string")
    assert graph.closure(e, e.select("id")).count() == 0 and graph.roots(e).count() == 0
    n = spark.createDataFrame([], "source_type string, n long")
    assert reconcile.outcome(reconcile.compare_counts(n, n)).first().outcome == "SKIPPED"
    rows = spark.createDataFrame([], "row_id long, seqid string, start long, end long")
    regions = spark.createDataFrame([("r", "s", 1, 5)], "region string, seqid string, start long, end long")
    assert intervals.rows_in_regions(rows, regions).count() == 0
