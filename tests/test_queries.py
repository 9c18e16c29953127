"""Every registered query against its SQL twin, and the entry point."""

import ast
from pathlib import Path

import duckdb
import pytest

from strandline.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda v: "NULL" if v is None else repr(float(v)) if isinstance(v, float) else str(v)
    return sorted(tuple(show(v[i]) for i in order) for v in values)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, cur.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_outside_imports_the_text_subpackage_and_the_recount_imports_nothing():
    top = Path(__file__).resolve().parent.parent / "strandline"
    for p in top.rglob("*.py"):
        names = [n.module or "" if isinstance(n, ast.ImportFrom) else n.names[0].name for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, (ast.Import, ast.ImportFrom))]
        if "llm" not in p.parts:
            assert not any("llm" in n for n in names), p
        if p.name == "recount.py":
            assert not any(n.startswith("strandline") for n in names)
