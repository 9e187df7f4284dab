"""Every catalogue query against its SQL on the small tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from ohmgrid.plans import catalog

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return repr(v)
    return None if v is None else str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return c


@pytest.mark.parametrize("name", sorted(n for n in catalog.ORACLES if n not in ("fem_straight_trace", "conservation_report")))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cursor = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    order = [columns.index(c) for c in sorted(columns)]
    want = sorted((tuple(plain(r[k]) for k in order) for r in cursor.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=str)
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 7
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def smallest_reached(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


@pytest.mark.parametrize("shape", ["tables", "deep and giant"])
def test_components_of_all_lineitem(spark, tmp_path, shape):
    """Against union-find: the small tables, and a chain, a star and pairs, with rows that the thinned graph leaves out."""
    folder = SF
    if shape != "tables":
        chain = [(k + s, k) for k in range(1, 40) for s in (0, 1)]
        star = [(5000 + k, 5000) for k in range(1500)]
        rows = chain + star + [(9000 + k, 9000 + k) for k in range(50)]
        folder = str(tmp_path)
        spark.createDataFrame([(u, v, 1.0, 0.0) for u, v in rows], "l_partkey long, l_suppkey long, l_quantity double, l_discount double").write.parquet(f"{folder}/lineitem.parquet")
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_partkey", "l_suppkey").collect()
    want = smallest_reached([(r[0], r[1] + 100_000_000) for r in lines])
    queries = __spark_entry__.queries()
    assert {r["node"]: r["component"] for r in queries["components_all"](spark, folder).collect()} == want
    number = {c: k for k, c in enumerate(sorted(set(want.values())))}
    got = {r["node"]: (r["component"], r["dof"]) for r in queries["component_dense_ids_all"](spark, folder).collect()}
    assert got == {x: (c, number[c]) for x, c in want.items()}
    assert shape == "tables" or len(number) == 52
