"""Queries whose results went wrong, or whose plans grew, on tables larger than the small ones."""

from __future__ import annotations

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from ohmgrid.operators import sampling, spatial, union
from ohmgrid.plans import catalog
from ohmgrid.streaming import leases

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, name, **tables):
    """Whether the query and its SQL agree on ``tables``, given as DuckDB selects of the small ones."""
    con = duckdb.connect()
    for table, select in tables.items():
        path = f"{folder}/{table}.parquet"
        con.execute(f"COPY ({select.format(SF=SF)}) TO '{path}'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    cursor = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(repr, (tuple(r) for r in cursor.fetchall())))
    got = sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, str(folder)).select(*columns).collect())
    assert want and got == want


def test_merged_unknowns_with_keys_over_a_million(spark, tmp_path):
    part = "SELECT * REPLACE (p_partkey + 1000000 AS p_partkey) FROM '{SF}/part.parquet' UNION ALL SELECT * FROM '{SF}/part.parquet'"
    same_as_sql(spark, tmp_path, "merged_unknowns", part=part, lineitem="SELECT * FROM '{SF}/lineitem.parquet'")


FAR = "SELECT * REPLACE (c_custkey + 5000000000 AS c_custkey) FROM '{SF}/customer.parquet'"


def test_ipc_board_far_from_the_origin(spark, tmp_path):
    same_as_sql(spark, tmp_path, "ipc_board", customer=FAR, supplier="SELECT * FROM '{SF}/supplier.parquet'", nation="SELECT * FROM '{SF}/nation.parquet'")


def test_ipc_nested_primitives_far_from_the_origin(spark, tmp_path):
    same_as_sql(spark, tmp_path, "ipc_nested_primitives", customer=FAR)


def joins(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line]


def test_free_widths_exchanges_pieces(spark):
    rays = spark.createDataFrame([(1, 1, 0.5, 0.5, 1.0, 0.0)], "ray int, own int, px double, py double, dx double, dy double")
    walls = spark.createDataFrame([(1, 1.0, 0.0, 1.0, 1.0), (2, 0.6, 0.0, 0.6, 1.0)], "own int, x1 double, y1 double, x2 double, y2 double")
    found = sampling.ray_hits(rays, walls, "ray", ["own"], 2.0)
    assert [r["distance"] for r in found.collect()] == [0.5]
    assert [line for line in joins(found) if "SortMergeJoin" in line and "col" in line and "row" in line]


def test_overlap_pairs_meet_once_and_are_exchanged(spark):
    rng = random.Random(5)
    rows = [(k, rng.uniform(-30, 30), rng.uniform(-30, 30), rng.uniform(0.1, 2.0), rng.randrange(3), 2 + rng.randrange(3)) for k in range(400)]
    vias = spark.createDataFrame(rows, "k long, x double, y double, r double, lo int, hi int")
    found = spatial.overlap_pairs(vias, "k", "x", "y", "r", "lo", "hi", 2.0)
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) < a[3] + b[3] and a[4] <= b[5] and b[4] <= a[5]]
    assert want and sorted((r["a"], r["b"]) for r in found.collect()) == want
    assert {"SortMergeJoin" in line for line in joins(found)} == {True}


def crowded(spark):
    rows = [(k, f"v{k}", "N" if k % 50 else "M", "L1", "L2" if k % 70 else "L3", 1.0 + k % 3 * 4e-8, float(k % 2), 0.1, None) for k in range(1200)]
    layers = spark.createDataFrame([("L1", 0), ("L2", 1), ("L3", 2)], "layer_id string, idx int")
    return rows, spark.createDataFrame(rows, "via_no long, via_id string, net_id string, from_layer string, to_layer string, x double, y double, drill double, radius double"), layers


def test_via_conflicts_of_a_crowded_place(spark, monkeypatch):
    rows, vias, layers = crowded(spark)
    given, plain = [], spatial.near_pairs
    monkeypatch.setattr(spatial, "near_pairs", lambda points, *a, **k: given.append(points.count()) or plain(points, *a, **k))
    found = sorted((r["a"], r["b"]) for r in spatial.consolidate_vias(vias, layers)[1].collect())
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[6] == b[6] and (a[2] != b[2] or a[4] != b[4])]
    assert want and found == want
    assert max(given) <= 24


def test_via_consolidation_of_a_crowded_place(spark, monkeypatch):
    rows, vias, layers = crowded(spark)
    given, plain = [], spatial.near_pairs
    monkeypatch.setattr(spatial, "near_pairs", lambda points, *a, **k: given.append(points.count()) or plain(points, *a, **k))
    found = sorted(r["via_ids"] for r in spatial.consolidate_vias(vias, layers)[0].collect())
    kinds = {}
    for r in rows:
        kinds.setdefault((r[2], r[4], r[6]), []).append(r[1])
    assert found == sorted(kinds.values()) and max(given) <= 24


def test_overlapping_union_of_more_than_a_thousand_parts(spark, tmp_path):
    bars = "SELECT i * 40 AS c_custkey, CAST(1 AS INTEGER) AS c_nationkey FROM range(1100) r(i)"
    same_as_sql(spark, tmp_path, "overlapping_union", customer=bars)


def no_call_for_each_group(monkeypatch):
    def refuse(*_):
        raise AssertionError("a Python call for each group")

    monkeypatch.setattr(GroupedData, "applyInPandas", refuse)


def random_polygons(seed, n):
    rng = random.Random(seed)
    return [[[(rng.randrange(40) * 1e-3, rng.randrange(40) * 1e-3) for _ in range(rng.randrange(3, 6))]] for _ in range(n)]


def test_repaired_rings_in_batches(spark, tmp_path, monkeypatch):
    no_call_for_each_group(monkeypatch)
    same_as_sql(spark, tmp_path, "repaired_rings", part="SELECT * FROM '{SF}/part.parquet'")
    for seed in range(30):
        shapes = random_polygons(seed, 4)
        many = union.edges([[np.array(r) for r in rings] for rings in shapes])
        few = union.few_edges(shapes)
        assert sorted(few) == sorted(map(tuple, many.tolist()))
        # Edges that end upon others cross them or not by rounding, which cuts nothing anew.
        corners = {round(x, 9) for rings in shapes for r in rings for x, _ in r}
        assert {round(x, 9) for x in union.few_crossings(few)} - corners == {round(x, 9) for x in union.crossings(many)} - corners
        a, b = (sorted((sorted(m), area) for area, m, _ in union.connected(t)) for t in (union.few_trapezoids(few), union.trapezoids(many)))
        assert [p[0] for p in a] == [p[0] for p in b] and [p[1] for p in a] == pytest.approx([p[1] for p in b], abs=1e-9)


def test_plane_overlay_in_batches(spark, tmp_path, monkeypatch):
    no_call_for_each_group(monkeypatch)
    same_as_sql(spark, tmp_path, "plane_overlay", customer="SELECT * FROM '{SF}/customer.parquet'")


def test_streamed_leases_keep_one_timer_without_listing_them():
    class Store:
        value, timers = None, set()

        def getValueState(self, *_):
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    job, store, found = leases.Leases(1000), Store(), []
    job.init(store)
    events = [(100, 1, "CLAIMED"), (600, 2, "RUNNING"), (650, 3, "QUEUED"), (2000, 4, "CLAIMED"), (2500, 5, "RUNNING"), (2600, 6, "COMPLETED")]
    for part in (events[:1], events[1:3], events[3:5], events[5:]):
        found += [(r["ms"], r["state"], r["attempt"], r["cause"]) for r in job.handleInputRows(("j",), iter([Row(us=at * 1000 + 999, seq=seq, to=to) for at, seq, to in part]), None)]
        assert store.timers == ({store.value[2]} if store.value[0] in leases.HELD else set())
    assert found == leases.batch_leases(events, 1000, 9000)


def test_points_in_regions_are_tried_together(spark):
    rng = random.Random(3)

    def box(x, y, w):
        c = [(x, y), (x + w, y), (x + w, y + w), (x, y + w)]
        return [{"x1": p[0], "y1": p[1], "x2": q[0], "y2": q[1]} for p, q in zip(c, c[1:] + c[:1], strict=True)]

    spots = [(f"r{k}", rng.choice(["A", "B", None]), rng.uniform(-20, 20), rng.uniform(-20, 20), rng.choice([0.3, 2.0, 11.0])) for k in range(60)]
    regions = spark.createDataFrame([(r, s, box(x, y, w) + box(x + w / 4, y + w / 4, w / 4)) for r, s, x, y, w in spots], "region string, layer string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    asked = [(k, rng.choice(["A", "B", None]), rng.uniform(-25, 25), rng.uniform(-25, 25)) for k in range(500)]
    points = spark.createDataFrame(asked, "k int, layer string, px double, py double").select(F.struct("k", "layer").alias("at"), "layer", "px", "py")
    within = lambda v, a, b: a < v < b
    want = sorted(
        (k, r) for k, layer, px, py in asked for r, s, x, y, w in spots
        if layer and layer == s and within(px, x, x + w) and within(py, y, y + w) and not (within(px, x + w / 4, x + w / 2) and within(py, y + w / 4, y + w / 2))
    )
    found = spatial.points_in_regions(points, regions, "at", "region", ["layer"])
    assert want and sorted((r["at"]["k"], r["region"]) for r in found.collect()) == want
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString() and not joins(found)
