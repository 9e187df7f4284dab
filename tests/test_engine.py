"""Engine operators against hand counts and closed forms."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from ohmgrid.functions import quantities as Q
from ohmgrid.functions import rings
from ohmgrid.functions import units as U
from ohmgrid.operators import fem, graph, jobs, mesh, ordered, review, spatial, union, validate, weighted
from ohmgrid.plans import boards, simulate


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_units_and_materials(spark):
    row = one(
        spark, U.to_metres(F.lit(2.0), F.lit(" inch ")).alias("a"), U.ounces(F.lit(34.8e-6)).alias("b"), U.format_resistance(F.lit(0.00985)).alias("c"),
        U.conductivity_at(F.lit(5.8001e7), F.lit(3.93e-3), F.lit(293.15), F.lit(393.15)).alias("d"), U.barrel_area(F.lit(0.3e-3), F.lit(25e-6)).alias("e"),
    )
    assert row["a"] == pytest.approx(0.0508) and row["b"] == pytest.approx(1.0) and row["c"] == "9.850 mohm"
    assert row["d"] == pytest.approx(5.8001e7 / 1.393) and row["e"] == pytest.approx(math.pi * (175e-6**2 - 150e-6**2))
    with pytest.raises(Exception, match="unknown unit"):
        one(spark, U.unit_scale(F.lit("furlong")))


def test_quantities(spark):
    q = Q.quantity(F.lit(1.0), "m", "assumed")
    row = one(spark, Q.quantity_fault(q).alias("a"), Q.slug(F.lit("  Top/Layer #1 ")).alias("b"), Q.redacted(F.create_map(F.lit("api_key"), F.lit("x"), F.lit("n"), F.lit("1"))).alias("c"))
    assert row["a"] == "assumed without a note" and row["b"] == "top-layer-1" and row["c"] == {"api_key": "***redacted***", "n": "1"}
    df = spark.createDataFrame([(1, "A b"), (2, "a-b"), (3, "c")], "k int, name string")
    assert [r["slug"] for r in Q.unique_slugs(df, "name", ["k"]).orderBy("k").collect()] == ["a-b", "a-b-2", "c"]
    names = spark.createDataFrame(list(enumerate(["A", "A", "A 2", "a", "??", "A-2", None, "a-4", "a"])), "k int, name string")
    assert [r["slug"] for r in Q.unique_slugs(names, "name", ["k"]).orderBy("k").collect()] == ["a", "a-2", "a-2-2", "a-3", "unnamed", "a-2-3", "unnamed-2", "a-4", "a-5"]
    labels = [("../etc/pass wd", "etc_pass_wd"), ("..", "unnamed"), ("a" * 60, "a" * 48), (" b.zip ", "b.zip")]
    assert [r["l"] for r in spark.createDataFrame(labels, "n string, e string").select(Q.safe_label(F.col("n")).alias("l")).collect()] == [e for _, e in labels]


def test_rings(spark):
    unit = rings.rectangle(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.0))
    full = rings.arc(F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(False))
    quarter = rings.arc(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(False))
    tidy = rings.tidy(F.array(*[rings.point(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0))]))
    row = one(
        spark, spatial.ring_area(unit).alias("a"), spatial.ring_area(rings.circle(F.lit(0.0), F.lit(0.0), F.lit(2e-3))).alias("b"), F.size(full).alias("c"), quarter.alias("d"), F.size(tidy).alias("e"),
        spatial.polygon_area(unit, F.array(rings.rectangle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.5)))).alias("f"),
        rings.arc_closure(F.lit(0.0), F.lit(0.0), F.lit(12e-9), F.lit(0.0)).alias("g"), spatial.bounding_box(unit).alias("h"),
    )
    assert row["a"] == 2.0 and row["b"] == pytest.approx(math.pi * 1e-6, rel=2e-3) and row["c"] > 100 and row["e"] == 3 and row["f"] == 1.5
    assert row["d"][-1]["x"] == 0.0 and row["d"][-1]["y"] == 1.0 and row["g"] == "degenerate" and row["h"]["max_x"] == 1.0


def test_components_and_dense_ids(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50) if k % 10 != 9] + [(100, 100)], "u long, v long")
    found = {r["node"]: r["component"] for r in graph.connected_components(edges).collect()}
    assert found == {k: k // 10 * 10 for k in range(50)}
    dense = {r["component"]: r["dof"] for r in graph.dense_ids(graph.connected_components(edges)).collect()}
    assert dense == {k * 10: k for k in range(5)}
    empty = graph.connected_components(edges.where("u < 0"))
    assert empty.count() == 0 and empty.columns == ["node", "component"]


def test_ordered(spark):
    values = [(1, k, v) for k, v in enumerate([4.0, 2.0, 1.0, 0.5])]
    series = spark.createDataFrame(values, "s int, k int, v double")
    assert ordered.monotone(series, ["s"], ["k"], "v").first()["decreasing"]
    last = ordered.last_values(series.withColumn("d", F.pow(F.lit(4.0), F.col("k"))), ["s"], ["k"], ["v", "d"])
    z = last.select(ordered.richardson(F.col("v_1"), F.col("v_2"), F.col("v_3"), F.col("d_1"), F.col("d_2")).alias("z")).first()["z"]
    assert z["limit"] == pytest.approx(0.0) and z["rate"] == pytest.approx(1.0)
    e = spark.createDataFrame([(0, k, v) for k, v in enumerate([10, 5, 5, 1, 0])], "g int, k int, e long")
    marked = ordered.mark(e, ["g"], "e", ["k"], (7, 10))
    assert {r["k"] for r in marked.collect()} == {0, 1} and ordered.doerfler(e, ["g"], "e", (7, 10)).first()["n_marked"] == 2
    ok = ordered.streaks(series, ["s"], ["k"], F.col("v") < 3).first()
    assert (ok["longest"], ok["current"]) == (3, 3)


def test_spatial(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 5.0, 5.0)], "k long, x double, y double")
    assert [(r["a"], r["b"]) for r in spatial.near_pairs(points, "k", "x", "y", 1.0).collect()] == [(1, 2)]
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    hole = [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]
    sides = [{"x1": a[0], "y1": a[1], "x2": b[0], "y2": b[1]} for r in (ring, hole) for a, b in zip(r, r[1:] + r[:1], strict=True)]
    regions = spark.createDataFrame([("r", "L", sides)], "region string, layer string, edges array<struct<x1:double,y1:double,x2:double,y2:double>>")
    asked = spark.createDataFrame([(1, "L", 0.5, 0.5), (2, "L", 1.5, 1.5), (3, "L", 5.0, 5.0), (4, "M", 0.5, 0.5)], "p int, layer string, px double, py double")
    assert [r["p"] for r in spatial.points_in_regions(asked, regions, "p", "region", ["layer"]).collect()] == [1]


def test_via_consolidation(spark):
    layers = spark.createDataFrame([("L1", 0), ("L2", 1), ("L3", 2), ("L4", 3)], "layer_id string, idx int")
    vias = spark.createDataFrame(
        [(1, "a", "N", "L1", "L4", 0.0, 0.0, None, 1e-4), (2, "b", "N", "L4", "L1", 5e-8, 0.0, 2e-4, 1e-4), (3, "c", "M", "L1", "L4", 1e-2, 0.0, 2e-4, 1e-4), (4, "d", "N", "L1", "L4", 1e-2, 0.0, 2e-4, 1e-4),
         (5, "e", "N", "L1", "L2", 2e-2, 0.0, 2e-4, 1e-4), (6, "f", "M", "L3", "L4", 2.01e-2, 0.0, 2e-4, 1e-4), (7, "g", "M", "L2", "L3", 2.01e-2, 1e-4, 2e-4, 1e-4)],
        "via_no long, via_id string, net_id string, from_layer string, to_layer string, x double, y double, drill double, radius double",
    )
    merged, conflicts, overlaps = spatial.consolidate_vias(vias, layers)
    ids = {r["via_id"]: r for r in merged.collect()}
    assert set(ids) == {"merged:a+b", "c", "d", "e", "f", "g"} and ids["merged:a+b"]["drill"] == 2e-4
    assert [(r["a"], r["b"]) for r in conflicts.collect()] == [(3, 4)]
    assert {(r["a"], r["b"]) for r in overlaps.collect()} == {(5, 7), (6, 7)}


def square(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_union_areas():
    import numpy as np

    apart = union.parts([[np.array(square(0, 0, 1, 1))], [np.array(square(0.5, 0, 1, 1))], [np.array(square(5, 0, 1, 1))]])
    assert [pytest.approx(p[0]) for p in apart] == [1.5, 1.0] and apart[0][1] == [0, 1]
    holed = union.parts([[np.array(square(0, 0, 4, 4)), np.array(square(1, 1, 1, 1))]])
    assert len(holed) == 1 and holed[0][0] == pytest.approx(15.0)
    cross = union.parts([[np.array([(0.0, 0.0), (2.0, 2.0), (0.0, 2.0)])], [np.array([(0.0, 2.0), (2.0, 0.0), (2.0, 2.0)])]])
    assert sum(p[0] for p in cross) == pytest.approx(3.0)


def test_union_regions(spark):
    rows = [("a", "L1", "N", square(0, 0, 1, 1)), ("b", "L1", "N", square(0.5, 0, 1, 1)), ("c", "L1", None, square(0, 0, 1, 1)), ("d", "L2", "N", square(0, 0, 2, 1))]
    df = spark.createDataFrame([(i, lay, n, [[{"x": float(x), "y": float(y)} for x, y in r]]) for i, lay, n, r in rows], "region_id string, layer_id string, net_id string, rings array<array<struct<x:double,y:double>>>")
    found = {r["region_id"]: (r["area"], r["source_ids"]) for r in union.union_regions(df).collect()}
    assert found["n-L1-N-000"] == (pytest.approx(1.5), ["a", "b"]) and found["n-L1-none-000"][0] == pytest.approx(1.0) and len(found) == 3


def test_jobs(spark):
    events = spark.createDataFrame([(1, 1, "CLAIMED"), (1, 2, "COMPLETED"), (1, 3, "RUNNING"), (1, 4, "COMPLETED"), (2, 1, "CANCELLED"), (2, 2, "QUEUED")], "job int, seq long, to string")
    found = {r["job"]: (r["state"], r["n_applied"], r["n_refused"]) for r in jobs.fold_states(events, "job", ["seq"], "to").collect()}
    assert found == {1: ("COMPLETED", 3, 1), 2: ("CANCELLED", 1, 1)}
    queue = spark.createDataFrame([("a", "s1", "QUEUED", 1, 5.0, 0, None, None), ("b", "s2", "QUEUED", 0, 9.0, 0, None, None), ("c", "s3", "RUNNING", 0, 1.0, 1, "w", 2.0)], "job_id string, signature string, state string, priority int, queued_at double, attempt int, claimed_by string, lease_expires_at double")
    claimed = {r["job_id"]: r for r in jobs.claim(queue, "me", 10.0, 60.0).collect()}
    assert claimed["b"]["state"] == "CLAIMED" and claimed["b"]["lease_expires_at"] == 70.0 and claimed["a"]["state"] == "QUEUED"
    new = spark.createDataFrame([("d", "s1", "QUEUED", 1, 6.0, 0, None, None), ("e", "s9", "QUEUED", 1, 6.0, 0, None, None), ("f", "s9", "QUEUED", 1, 7.0, 0, None, None)], queue.schema)
    assert {r["job_id"] for r in jobs.queue_jobs(queue, new).collect()} == {"a", "b", "c", "e"}
    states = queue.select("job_id", jobs.expire(F.col("state"), F.col("lease_expires_at"), F.col("attempt"), F.lit(5.0)).alias("s"))
    assert {r["job_id"]: r["s"] for r in states.collect()} == {"a": "QUEUED", "b": "QUEUED", "c": "QUEUED"}


def test_draft_faults(spark):
    schema = "kind string, accuracy string, source_ids array<string>, to_ids array<string>, loads array<struct<ids:array<string>,current:double>>, voltage double, policy struct<passes:int,dofs:int,target:double>"
    rows = [("ir_drop", "standard", ["s"], [], [(["l"], 1.0)], 1.0, None), ("ir_drop", "standard", ["s"], [], [(["s"], 1.0)], 1.0, None), ("resistance", "standard", ["s"], [], [], 1.0, None), ("ir_drop", "reference", ["s"], [], [(["l"], 1.0)], 1.0, (99, 1, 1e-3))]
    faults = [r["fault"] for r in validate.draft_faults(spark.createDataFrame(rows, schema), {"passes": 16, "dofs": 8_000_000}).collect()]
    assert faults == [None, "source and load overlap", "a resistance needs a far end", "too many passes"]


@pytest.mark.parametrize("order", ["p1", "p2"])
def test_straight_trace(spark, order):
    board = boards.straight_trace()
    result = simulate.solve(spark, board, 1e-3, order)
    assert result.resistance().first()["resistance_ohm"] == pytest.approx(board.expected, rel=1e-9)


def test_parallel_traces_and_conservation(spark):
    board = boards.parallel_traces()
    result = simulate.solve(spark, board, 1e-3, current=2.5)
    assert result.resistance(2.5).first()["resistance_ohm"] == pytest.approx(board.expected, rel=5e-3)
    kept = result.conservation(2.5).first()
    assert kept["severity"] == "ok" and kept["imbalance_fraction"] < 1e-9 and kept["power_mismatch_fraction"] < 1e-8


def test_via_stack_and_islands(spark):
    board = boards.via_stack(4)
    assert simulate.solve(spark, board, 2e-3).resistance().first()["resistance_ohm"] == pytest.approx(board.expected, rel=1e-9)
    with pytest.raises(Exception, match="without a path"):
        simulate.solve(spark, boards.islands(), 1e-3).resistance().collect()


def test_iterative_and_direct_agree():
    import numpy as np

    n = 30
    k = np.arange(n * n).reshape(n, n)
    pairs = np.concatenate((np.column_stack((k[:, :-1].ravel(), k[:, 1:].ravel())), np.column_stack((k[:-1].ravel(), k[1:].ravel()))))
    row = np.concatenate((pairs[:, 0], pairs[:, 1], pairs[:, 0], pairs[:, 1]))
    col = np.concatenate((pairs[:, 0], pairs[:, 1], pairs[:, 1], pairs[:, 0]))
    val = np.concatenate((np.ones(2 * len(pairs)), -np.ones(2 * len(pairs))))
    _, direct, _ = fem.solve_system(row, col, val, {0: 0.0}, {n * n - 1: -1.0})
    old, fem.DENSE = fem.DENSE, 0
    try:
        _, iterative, _ = fem.solve_system(row, col, val, {0: 0.0}, {n * n - 1: -1.0})
    finally:
        fem.DENSE = old
    assert np.abs(direct - iterative).max() < 1e-9


def test_distributed_solution(spark):
    n = 12
    rows = [(k, k, 2.0) for k in range(n)] + [(k, k + 1, -1.0) for k in range(n - 1)] + [(k + 1, k, -1.0) for k in range(n - 1)]
    found = fem.solve_distributed(spark.createDataFrame(rows, "row long, col long, val double"), spark.createDataFrame([(n - 1, 1.0)], "dof long, b double"))
    assert {r["dof"]: pytest.approx(r["x"], abs=1e-8) for r in found.collect()} == {k: (k + 1) / (n + 1) for k in range(n)}


def test_adaptive_history(spark):
    rows = simulate.adapt(spark, boards.plane_neck_plane(), 2e-3, passes=2).collect()
    assert [r["index"] for r in rows] == [0, 1] and rows[1]["dof_count"] > rows[0]["dof_count"] and rows[0]["change"] is None
    assert rows[-1]["status"] == "RESOURCE_LIMITED" and rows[1]["change"] > 0


def test_review(spark):
    layers = spark.createDataFrame([("t", "SIGNAL", 35e-6, 1.0), ("d", "DIELCORE", 1.5e-3, 2.0), ("p", "PASTEMASK", 1e-5, 3.0), ("x", "DIELPREG", 0.0, 4.0), ("b", "PLANE", None, None)], "name string, declared string, thickness double, sequence double")
    found = [(r["name"], r["function"], r["idx"]) for r in review.classify_layers(layers, "declared", "thickness", [], "sequence").orderBy("idx").collect()]
    assert found == [("t", "signal", 0), ("d", "dielectric", 1), ("b", "plane", 2)]
    tops = review.layer_tops(spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "k int, t double"), [], "k", "t")
    assert [r["z_top"] for r in tops.orderBy("k").collect()] == [0.0, 1.0, None]


def test_quality_and_estimate(spark):
    tri = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0), (1, 0.0, 0.0, 1.0, 0.0, 0.5, 0.01)], "g int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double")
    row = mesh.quality(tri, ["g"]).first()
    assert row["slivers"] == 1 and row["area"] == pytest.approx(0.505)
    assert one(spark, mesh.estimate(F.lit(100_000)).alias("e"))["e"]["compute_class"] == "standard"


def test_weighted(spark):
    df = spark.createDataFrame([(1, v, w) for v, w in ((1, 98), (2, 1), (3, 1))], "g int, v int, w int")
    row = weighted.weighted_quantiles(df, ["g"], "v", F.col("w"), {"p98": (98, 100), "p99": (99, 100), "p100": (1, 1)}).first()
    assert (row["p98"], row["p99"], row["p100"]) == (1, 2, 3)
    assert {r["bin"]: r["n"] for r in weighted.histogram(df, F.col("v"), 2).collect()} == {0: 1, 1: 2}
