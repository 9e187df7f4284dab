"""Tiled overlay and polygon joins against the sweep of whole groups and all pairs."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest

from ohmgrid.functions.storage import scope
from ohmgrid.operators import overlay, union

SCHEMA = "region_id string, layer_id string, net_id string, rings array<array<struct<x:double,y:double>>>"


def rect(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def blob(rng, cx, cy, r, n):
    """A ring around a centre, slanted edges, corners in any direction."""
    turn = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + r * rng.uniform(0.4, 1) * math.cos(a), cy + r * rng.uniform(0.4, 1) * math.sin(a)) for a in turn]


def united(spark, rows, per_tile):
    with scope(spark):
        parts, members, cells = overlay.tiled_union(spark.createDataFrame(rows, SCHEMA), per_tile)
        held, areas = defaultdict(set), defaultdict(float)
        for r in members.collect():
            held[r["part"]].add(r["source_id"])
        for r in cells.collect():
            a, b, la, lb, ha, hb = r["trapezoid"]
            areas[r["part"]] += (b - a) * ((ha - la) + (hb - lb)) / 2
        found = parts.collect()
    assert all(areas[r["part"]] == pytest.approx(r["area"], rel=1e-9) and len(held[r["part"]]) == r["n_sources"] for r in found)
    return found, held


def compare(spark, rows, per_tile):
    found, held = united(spark, rows, per_tile)
    groups = defaultdict(list)
    for r in rows:
        groups[r[1], r[2]].append(r)
    got = defaultdict(list)
    for r in found:
        got[r["layer_id"], r["net_id"]].append((tuple(sorted(held[r["part"]])), r["area"], (r["min_x"], r["min_y"], r["max_x"], r["max_y"]), r["region_id"]))
    for key, own in groups.items():
        own = sorted(own)
        plain = [(tuple(sorted(own[k][0] for k in members)), area, cells) for area, members, cells in union.parts([[np.array(ring) for ring in r[3] if len(ring) >= 3] for r in own]) if area >= union.SMALLEST]
        assert sorted(p[0] for p in plain) == sorted(p[0] for p in got[key])
        for (_, area, cells), (_, own_area, own_box, _) in zip(sorted(plain), sorted(got[key]), strict=True):
            c = np.array(cells)
            assert own_area == pytest.approx(area, rel=1e-6) and own_box == pytest.approx((c[:, 0].min(), c[:, 2:4].min(), c[:, 1].max(), c[:, 4:6].max()), abs=2e-9)
        names = [p[3] for p in sorted(got[key], key=lambda p: (p[2][0], p[2][1], p[1]))]
        assert names == [f"n-{key[0]}-{key[1] or 'none'}-{k:03d}" for k in range(len(names))]
    return found


def test_known_unions(spark):
    rows = [
        # Overlapping: 3, not 4; the same shapes in another net stay apart.
        ("a", "L", "N", [rect(0, 0, 2, 1)]), ("b", "L", "N", [rect(1, 0, 2, 1)]), ("c", "L", "M", [rect(1, 0, 2, 1)]), ("d", "L", None, [rect(0, 0, 1, 1)]),
        ("e", "L2", "N", [rect(0, 0, 1, 1)]), ("f", "L2", "N", [rect(5, 0, 1, 1)]), ("g", "L3", "N", [rect(0, 0, 10, 10), rect(4, 4, 2, 2)]),
        ("tie", "L4", "N", [[(0, 0), (2, 2), (2, 0), (0, 2)]]), ("copy1", "L5", None, [rect(0, 0, 1, 1)]), ("copy2", "L5", None, [rect(0, 0, 1, 1)]), ("short", "L5", None, [[(0, 0), (1, 1)]]), ("none", "L5", None, []),
    ]
    rows = [(i, la, n, [[(x * 1e-3, y * 1e-3) for x, y in r] for r in rings]) for i, la, n, rings in rows]
    for per_tile in (64, 1, 0.01):
        found, held = united(spark, rows, per_tile)
        areas = sorted((r["layer_id"], r["net_id"] or "", round(r["area"] * 1e6, 6), tuple(sorted(held[r["part"]]))) for r in found)
        assert areas == [("L", "", 1.0, ("d",)), ("L", "M", 2.0, ("c",)), ("L", "N", 3.0, ("a", "b")), ("L2", "N", 1.0, ("e",)), ("L2", "N", 1.0, ("f",)), ("L3", "N", 96.0, ("g",)), ("L4", "N", 1.0, ("tie",)), ("L4", "N", 1.0, ("tie",)), ("L5", "", 1.0, ("copy1", "copy2"))]


@pytest.mark.parametrize(("seed", "per_tile"), [(1, 64), (2, 3), (3, 0.3)])
def test_against_the_sweep(spark, seed, per_tile):
    rng = random.Random(seed)
    rows = []
    for k in range(60):
        x, y = rng.randrange(40) * 1e-3, rng.randrange(40) * 1e-3
        kind = k % 4
        ring = [rect(x, y, rng.randrange(1, 9) * 1e-3, rng.randrange(1, 9) * 1e-3)] if kind < 2 else [blob(rng, x, y, 4e-3, 9)] if kind == 2 else [rect(x - 4e-3, y - 4e-3, 8e-3, 8e-3), blob(rng, x, y, 3e-3, 7)]
        rows.append((f"r{k:03d}", f"L{k % 2}", None if k % 3 == 0 else "n", ring))
    found = compare(spark, rows, per_tile)
    assert per_tile > 1 or max(r["n_tiles"] for r in found) > 10


def test_plane_with_many_pads(spark):
    """A plane without a net under 400 pads, half of them in its holes: the plane is cut into many tiles and stays one part."""
    plane = [rect(0.0, 0.0, 0.1, 0.1)] + [rect(0.002 + 0.01 * i, 0.002 + 0.01 * j, 0.004, 0.004) for i in range(10) for j in range(10)]
    rows = [("plane", "L", None, plane)] + [(f"p{i}-{j}", "L", None, [rect(0.0035 + 0.01 * i, 0.0035 + 0.01 * j, 0.001, 0.001)]) for i in range(10) for j in range(10)]
    rows += [(f"q{i}-{j}", "L", None, [rect(0.0005 + 0.01 * i, 0.0005 + 0.01 * j, 0.001, 0.001)]) for i in range(10) for j in range(10)]
    found, held = united(spark, rows, 4)
    assert len(found) == 101
    largest = max(found, key=lambda r: r["area"])
    assert largest["area"] == pytest.approx(0.01 - 100 * 1.6e-5) and largest["n_tiles"] > 20 and largest["n_sources"] == 101
    assert all(r["n_sources"] == 1 and r["area"] == pytest.approx(1e-6) for r in found if r is not largest)
    with scope(spark):
        assert all(t.count() == 0 for t in overlay.tiled_union(spark.createDataFrame([], SCHEMA)))


def test_polygons_that_meet(spark):
    rng = random.Random(4)
    shapes = {}
    for k in range(70):
        x, y = rng.randrange(30) * 1e-3, rng.randrange(30) * 1e-3
        shapes[f"s{k}"] = ["a", "b", None][k % 3], [rect(x, y, rng.randrange(1, 7) * 1e-3, rng.randrange(1, 7) * 1e-3)] if k % 2 else [rect(x, y, 6e-3, 6e-3), rect(x + 2e-3, y + 2e-3, 2e-3, 2e-3)]
    df = spark.createDataFrame([(k, s, r) for k, (s, r) in shapes.items()], "k string, layer string, rings array<array<struct<x:double,y:double>>>")
    out = {tuple(r) for r in overlay.polygons_that_meet(df, df.withColumnRenamed("k", "o"), "k", "o", ["layer"]).collect()}

    def cells(rings):
        """Halves of millimetres that a polygon covers or touches, as all corners are whole ones."""
        box = lambda r: (round(r[0][0] * 2e3), round(r[0][1] * 2e3), round(r[2][0] * 2e3), round(r[2][1] * 2e3))
        x0, y0, x1, y1 = box(rings[0])
        hole = box(rings[1]) if len(rings) > 1 else None
        return {(x, y) for x in range(x0, x1 + 1) for y in range(y0, y1 + 1) if not (hole and hole[0] < x < hole[2] and hole[1] < y < hole[3])}

    covered = {k: cells(r) for k, (_, r) in shapes.items()}
    expected = {(a, b) for a in shapes for b in shapes if shapes[a][0] is not None and shapes[a][0] == shapes[b][0] and covered[a] & covered[b]}
    assert out == expected
