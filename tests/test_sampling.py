"""Rays and graded lattices against plain versions."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ohmgrid.operators import sampling


def plain_ray(p, d, walls, reach):
    best = reach
    for (ax, ay), (bx, by) in walls:
        wx, wy = bx - ax, by - ay
        den = d[0] * wy - d[1] * wx
        if abs(den) < 1e-15:
            continue
        t, u = ((ax - p[0]) * wy - (ay - p[1]) * wx) / den, ((ax - p[0]) * d[1] - (ay - p[1]) * d[0]) / den
        if 0 <= u <= 1 and 1e-9 < t < best:
            best = t
    return best


def test_rays(spark):
    rng = random.Random(1)
    walls = {g: [((rng.uniform(0, 0.05), rng.uniform(0, 0.05)), (rng.uniform(0, 0.05), rng.uniform(0, 0.05))) for _ in range(12)] for g in "ab"}
    walls["b"] += [((0.01, 0.0), (0.01, 0.05)), ((0.0, 0.02), (0.05, 0.02))]
    rays = [(k, "abc"[k % 3], rng.uniform(0, 0.05), rng.uniform(0, 0.05), *((math.cos(a), math.sin(a)) if (a := rng.uniform(0, 7)) > 1 else [(1.0, 0.0), (0.0, -1.0)][k % 2])) for k in range(120)]
    df = spark.createDataFrame(rays, "k long, g string, px double, py double, dx double, dy double")
    lines = spark.createDataFrame([(g, *p, *q) for g, w in walls.items() for p, q in w], "g string, x1 double, y1 double, x2 double, y2 double")
    found = {r["k"]: r["distance"] for r in sampling.ray_hits(df, lines, "k", ["g"], 0.03).collect()}
    for k, g, px, py, dx, dy in rays:
        assert found[k] == pytest.approx(plain_ray((px, py), (dx, dy), walls.get(g, []), 0.03), abs=3e-8), k
    assert set(v for k, v in found.items() if rays[k][1] == "c") == {0.03}


def test_widths_and_clearances(spark):
    """A strip 2 mm wide with a slot of 0.6 mm to its other arm."""
    arms = [(0.0, 0.0, 10.0, 2.0), (0.0, 2.6, 10.0, 3.0)]
    lines = [(1, *(1e-3 * v for v in s)) for x0, y0, x1, y1 in arms for s in ((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0))]
    points = [(1, 1, 5e-3, 2e-3, 0.0, -1.0), (2, 1, 5e-3, 0.0, 0.0, 1.0), (3, 1, 0.0, 1e-3, 1.0, 0.0), (4, 2, 5e-3, 2e-3, 0.0, -1.0)]
    df = spark.createDataFrame(points, "p long, r long, px double, py double, nx double, ny double")
    segments = spark.createDataFrame(lines, "r long, x1 double, y1 double, x2 double, y2 double")
    out = {r["p"]: [round(r[c] * 1e3, 6) for c in ("inward", "outward", "size")] for r in sampling.boundary_sizes(df, segments, "p", ["r"], 4, 0.9e-3, 1e-4, 8e-3).collect()}
    assert out == {1: [2.0, 0.6, 0.3], 2: [2.0, 8.0, 0.5], 3: [8.0, 8.0, 0.9], 4: [8.0, 8.0, 0.9]}


def plain_lattice(box, nodes, largest, smallest, growth, clearance):
    x0, y0, x1, y1 = box
    tall = math.sqrt(3) / 2
    out = set()
    b = np.array([(x, y) for _, x, y, _ in nodes])
    s = np.array([z for *_, z in nodes])
    for level in sampling.size_levels(largest, smallest, min(s)):
        for row in range(int((y1 - y0) / (level * tall)) + 2):
            for col in range(int((x1 - x0) / level) + 2):
                p = np.array((x0 + (col + 0.5 * (row % 2)) * level, y0 + row * level * tall))
                d = np.hypot(*(b - p).T)
                k = int(np.argmin(d))
                target = min(s[k] + growth * d[k], largest)
                if level <= target < 2 * level and d[k] >= clearance * level:
                    out.add((level, col, row))
    return out


def test_lattice_levels(spark):
    rng = random.Random(6)
    boxes = {0: (0.0, 0.0, 0.02, 0.015), 1: (-0.01, 0.002, 0.004, 0.01)}
    nodes = {r: [(100 * r + k, rng.uniform(b[0], b[2]), rng.uniform(b[1], b[3]), rng.choice([2e-3, 1e-3, 4e-4, 2.2e-4])) for k in range(9)] for r, b in boxes.items()}
    df = spark.createDataFrame([(r, *b) for r, b in boxes.items()], "r long, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(r, *n) for r, own in nodes.items() for n in own], "r long, node long, nx double, ny double, size double")
    out = sampling.graded_lattice(df, points, "r", "node", 2e-3, 1e-4, 0.7).collect()
    for r, box in boxes.items():
        own = [(x["level"], x["col"], x["row"]) for x in out if x["r"] == r]
        finest = min(z for n in nodes.values() for *_, z in n)
        expected = plain_lattice(box, [*nodes[r], (-1, 9.0, 9.0, finest)], 2e-3, 1e-4, 0.7, sampling.CLEARANCE)
        assert len(own) == len(set(own)) and set(own) == expected
    with pytest.raises(sampling.TooManyPoints):
        sampling.graded_lattice(df, points, "r", "node", 2e-3, 1e-4, 0.7, most=500)
    far = points.withColumn("size", F.lit(5e-3))
    assert {x["level"] for x in sampling.graded_lattice(df, far, "r", "node", 2e-3, 1e-4, 0.7).collect()} == {2e-3}


def test_walks(spark):
    """Level, rising and falling sizes in one piece and in many, against stepping along the integral in small steps."""
    spans = {"level": [(0.0, 10.0, 1.0, 1.0)], "odd": [(0.0, 10.4, 1.0, 1.0)], "short": [(2.0, 2.3, 1.0, 1.0)], "rising": [(0.0, 8.0, 0.1, 2.1)], "many": [(0.1 * k, 0.1 * (k + 1), 0.5 + 0.3 * math.sin(k), 0.5 + 0.3 * math.sin(k + 1)) for k in range(200)]}
    df = spark.createDataFrame([(n, *p) for n, ps in spans.items() for p in ps], "span string, s0 double, s1 double, z0 double, z1 double").repartition(5)
    out = {n: [] for n in spans}
    for r in sampling.walk_spans(df, ["span"], "s0", "s1", "z0", "z1").orderBy("span", "step").collect():
        out[r["span"]].append((r["step"], r["position"], r["size"]))
    assert [p for _, p, _ in out["level"]] == pytest.approx(list(range(10))) and [p for _, p, _ in out["odd"]] == pytest.approx([1.04 * k for k in range(10)]) and [p for _, p, _ in out["short"]] == [2.0]
    for name, pieces in spans.items():
        s = np.concatenate([np.linspace(a, b, 4001)[:-1] for a, b, _, _ in pieces] + [[pieces[-1][1]]])
        z = np.interp(s, [p[0] for p in pieces] + [pieces[-1][1]], [p[2] for p in pieces] + [pieces[-1][3]])
        total = np.concatenate(([0.0], np.cumsum(np.diff(s) / ((z[1:] + z[:-1]) / 2))))
        n = max(1, round(total[-1]))
        assert [k for k, _, _ in out[name]] == list(range(n))
        assert [p for _, p, _ in out[name]] == pytest.approx(np.interp(np.arange(n) * total[-1] / n, total, s), abs=1e-5)
        assert [v for _, _, v in out[name]] == pytest.approx(np.interp([p for _, p, _ in out[name]], s, z), abs=1e-5)
