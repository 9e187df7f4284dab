"""Cell joins against all pairs, deep graphs, and imported copper."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmgrid.functions import rings as R
from ohmgrid.operators import graph, spatial
from ohmgrid.plans import imported


def test_nearest_k(spark):
    """Clusters, equal points, points far away from all nodes, and a group with fewer nodes than are asked for."""
    g = np.random.default_rng(0)
    nodes = [(k, int(k % 2), float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([g.random((150, 2)), 100 + 1e-3 * g.random((40, 2)), np.full((5, 2), 0.5)]))]
    nodes += [(900 + k, 7, float(k), 0.0) for k in range(2)]
    asked = [(k, int(k % 2), float(x), float(y)) for k, (x, y) in enumerate(np.concatenate([g.random((40, 2)), np.array([[0.5, 0.5], [-500.0, 3.0], [100.0, 100.0]])]))] + [(99, 7, 0.2, 0.0), (98, 8, 0.0, 0.0)]
    found = spatial.nearest_k(spark.createDataFrame(asked, "p long, layer int, px double, py double"), spark.createDataFrame(nodes, "node long, layer int, nx double, ny double"), "p", "node", ["layer"], 4)
    got = {}
    for r in found.collect():
        got.setdefault(r["p"], {})[r["rank"]] = r["node"]
    for p, layer, x, y in asked:
        want = [n for _, n in sorted((math.sqrt((x - a) * (x - a) + (y - b) * (y - b)), n) for n, own, a, b in nodes if own == layer)[:4]]
        assert [got.get(p, {}).get(k) for k in range(1, len(want) + 1)] == want and len(got.get(p, {})) == len(want)


def test_chains_of_equal_points(spark):
    points = [(k, float(k % 3), 0.0) for k in range(300)] + [(1000, 10.0, 0.0)]
    df = spark.createDataFrame(points, "k long, x double, y double")
    found = {r["k"]: r["cluster"] for r in spatial.clusters(df, "k", spatial.chained(df, "k", "x", "y", 1.0)).collect()}
    assert found == {**{k: 0 for k in range(300)}, 1000: 1000}
    assert spatial.chained(df, "k", "x", "y", 1.0).count() < 310


def test_long_chain(spark):
    """A path needs a number of rounds that grows with its logarithm."""
    edges = spark.range(3000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    found = graph.connected_components(edges).agg(F.count(F.lit(1)), F.max("component")).first()
    assert tuple(found) == (3001, 0)


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def board(spark, regions, pads, vias=()):
    ring = "array<array<struct<x:double,y:double>>>"
    layers = [("s", k, k * 1e-3, 35e-6, 5.8e7, None, None) for k in range(2)]
    return imported.Board(
        spark.createDataFrame(layers, "study string, layer int, z_mid double, thickness double, conductivity double, tcr double, reference_k double"),
        spark.createDataFrame([("s", f"r{k}", layer, rings, own) for k, (layer, rings, own) in enumerate(regions)], f"study string, region_id string, layer int, rings {ring}, thickness double"),
        spark.createDataFrame(list(vias), "study string, via_id string, x double, y double, low int, high int, finished double, drill double, plating double"),
        spark.createDataFrame([("s", contact, layer, rings) for contact, layer, rings in pads], f"study string, contact string, layer int, rings {ring}"),
    )


def test_imported_parallel_traces(spark):
    """Two traces between attachment groups of two pads each, one twice as thick: conductances add."""
    regions = [(0, [box(0.0, 0.0, 12e-3, 1e-3)], None), (0, [box(0.0, 5e-3, 12e-3, 6e-3)], 70e-6)]
    pads = [("a", 0, [box(0.0, y, 1e-3, y + 1e-3)]) for y in (0.0, 5e-3)] + [("b", 0, [box(11e-3, y, 12e-3, y + 1e-3)]) for y in (0.0, 5e-3)]
    problem = imported.build(board(spark, regions, pads), 1e-3)
    r = imported.resistance(problem, spark.createDataFrame([("s", "a", "b")], "study string, near string, far string")).first()["resistance_ohm"]
    assert r == pytest.approx(10e-3 / (5.8e7 * 1e-3 * (35e-6 + 70e-6)), rel=1e-9)
    # The prepared problem takes another excitation.
    roles = spark.createDataFrame([("s", "a", 1.0, None), ("s", "b", None, 2.0)], "study string, contact string, voltage double, current double")
    out = {x["contact"]: (x["voltage"], x["current"]) for x in imported.solve(problem, roles).collect()}
    assert out["b"][0] == pytest.approx(1.0 - 2 * r, rel=1e-9) and out["a"][1] == pytest.approx(2.0, rel=1e-9)


def test_imported_hole_and_slant(spark):
    """A hole raises the resistance, and slanted copper is followed."""
    pads = [("a", 0, [box(0.0, 0.0, 1e-3, 4e-3)]), ("b", 0, [box(11e-3, 0.0, 12e-3, 4e-3)])]
    probe = spark.createDataFrame([("s", "a", "b")], "study string, near string, far string")
    plain = 10e-3 / (5.8e7 * 4e-3 * 35e-6)
    holed = imported.build(board(spark, [(0, [box(0.0, 0.0, 12e-3, 4e-3), box(5e-3, 1e-3, 7e-3, 3e-3)], None)], pads), 0.5e-3)
    r = imported.resistance(holed, probe).first()["resistance_ohm"]
    assert 1.2 * plain < r < 1.8 * plain
    wedge = [(0.0, 0.0), (12e-3, 0.0), (12e-3, 4e-3), (11e-3, 4e-3), (1e-3, 2e-3), (0.0, 2e-3)]
    slanted = imported.build(board(spark, [(0, [wedge], None)], [("a", 0, [box(0.0, 0.0, 1e-3, 2e-3)]), ("b", 0, [box(11e-3, 0.0, 12e-3, 4e-3)])]), 0.1e-3)
    r = imported.resistance(slanted, probe).first()["resistance_ohm"]
    # Between parallel plates that widen from 2 to 4 mm: the logarithmic mean of the widths.
    assert r == pytest.approx(10e-3 / (5.8e7 * 35e-6 * 2e-3) * math.log(2), rel=0.03)


def test_rings_keep_their_chords(spark):
    df = spark.range(1, 60).select(F.size(R.circle(F.lit(0.0), F.lit(0.0), F.col("id") * 1e-4)).alias("n"), (F.col("id") * 5e-5).alias("r"))
    for row in df.collect():
        assert row["n"] == max(16, min(720, math.ceil(math.pi / math.acos(1 - 1e-6 / row["r"]))))
