"""Queries over geometry, meshes, conduction and documents, on shapes made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ohmgrid.functions import rings as R
from ohmgrid.functions.storage import durable, new_folder
from ohmgrid.operators import fem, mesh, spatial, union
from ohmgrid.plans.catalog import part_points, query, table
from ohmgrid.sources import artifacts, canonical_json, import_run, ipc2581, ipc2581_scan


# ------------------------------------------------------------------ rings
@query("ring_constructors", """
    WITH a AS (SELECT p_partkey, p_size * 1e-4 AS s, CAST(ceil(2 * pi() / (2 * acos(1 - 1e-6 / (p_size * 5e-5)))) AS INTEGER) AS raw FROM part),
    b AS (SELECT *, greatest(16, least(720, raw)) AS n FROM a)
    SELECT p_partkey, n AS chords, round(n / 2.0 * s * s / 4 * sin(2 * pi() / n) * 1e9, 4) AS circle_nm2, round(s * s * 2 * 1e9, 4) AS rectangle_nm2 FROM b""")
def ring_constructors(spark, d):
    """Areas of inscribed circles and of rectangles, by the shoelace."""
    s = F.col("p_size") * 1e-4
    at = F.lit(1e-3)
    made = table(spark, d, "part").select("p_partkey", R.circle(at, at, s).alias("c"), R.rectangle(at, at, s, 2 * s).alias("r"))
    return made.select(
        "p_partkey", F.size("c").alias("chords"), F.round(spatial.ring_area(F.col("c")) * 1e9, 4).alias("circle_nm2"), F.round(spatial.ring_area(F.col("r")) * 1e9, 4).alias("rectangle_nm2")
    )


@query("arc_tessellation", """
    WITH a AS (SELECT p_partkey, p_size * 1e-4 AS r, CASE p_partkey % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 0.75 ELSE 1.0 END AS turn FROM part),
    c AS (SELECT *, greatest(16, least(720, ceil(2 * pi() / (2 * acos(1 - 1e-6 / r))))) AS circle FROM a),
    n AS (SELECT *, greatest(1, ceil(circle * CASE WHEN turn = 1.0 THEN 1.0 ELSE turn END - 1e-9)) AS n FROM c)
    SELECT p_partkey, CASE WHEN turn = 1.0 THEN 'full_circle' ELSE 'open' END AS closure, round(n * 2 * r * sin(pi() * turn / n) * 1e3, 6) AS length_mm FROM n""")
def arc_tessellation(spark, d):
    """Arcs of a quarter, a half, three quarters and a whole circle, counter-clockwise; the length of their chords."""
    r = F.col("p_size") * 1e-4
    k = F.col("p_partkey") % 4
    x1 = F.when(k == 1, -r).when(k == 3, r).otherwise(F.lit(0.0))
    y1 = F.when(k == 0, r).when(k == 2, -r).otherwise(F.lit(0.0))
    zero = F.lit(0.0)
    made = table(spark, d, "part").select("p_partkey", R.arc_closure(r, zero, x1, y1).alias("closure"), R.arc(r, zero, x1, y1, zero, zero, F.lit(False)).alias("p"))
    steps = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: F.hypot(a["x"] - b["x"], a["y"] - b["y"]))
    return made.select("p_partkey", "closure", F.round(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v) * 1e3, 6).alias("length_mm"))


@query("tidy_rings", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN -1 WHEN p_partkey % 3 = 1 THEN 4 ELSE 3 END AS n FROM part")
def tidy_rings(spark, d):
    """Repeated and closing points go; a ring of two points is none."""
    s = F.col("p_size").cast("double")
    p = lambda x, y: R.point(x, y)
    zero = F.lit(0.0)
    line = F.array(p(zero, zero), p(s, zero), p(s, zero + 1e-10), p(zero, zero))
    square = F.array(p(zero, zero), p(zero, zero + 5e-10), p(s, zero), p(s, s), p(s, s), p(zero, s), p(zero, zero))
    corner = F.array(p(zero, zero), p(s, zero), p(s, s))
    ring = F.when(F.col("p_partkey") % 3 == 0, line).when(F.col("p_partkey") % 3 == 1, square).otherwise(corner)
    return table(spark, d, "part").select("p_partkey", F.size(R.tidy(ring)).alias("n")).withColumn("n", F.coalesce("n", F.lit(-1)))


@query("placed_rings", """
    SELECT p_partkey, CAST(CASE p_partkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 - p_size WHEN 2 THEN 3 - 2 * p_size ELSE 3 END AS DOUBLE) AS min_x,
           CAST(CASE p_partkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 7 WHEN 2 THEN 7 - p_size ELSE 7 - 2 * p_size END AS DOUBLE) AS min_y, CAST(2 * p_size * p_size AS DOUBLE) AS area, p_partkey % 8 < 4 AS counter_clockwise FROM part""")
def placed_rings(spark, d):
    """A rectangle with a corner at the origin, turned by quarters; half of them mirrored, scaled and mirrored back."""
    s = F.col("p_size").cast("double")
    zero = F.lit(0.0)
    base = F.array(R.point(zero, zero), R.point(2 * s, zero), R.point(2 * s, s), R.point(zero, s))
    turned = R.placed(base, F.lit(False), 90 * (F.col("p_partkey") % 4), F.lit(3.0), F.lit(7.0))
    # Two reflections are a rotation by half a turn and back; reversing tells the direction.
    twice = R.scaled(R.scaled(turned, F.lit(2.0)), F.lit(0.5))
    ring = F.when(F.col("p_partkey") % 8 < 4, twice).otherwise(F.reverse(twice))
    made = table(spark, d, "part").select("p_partkey", ring.alias("p")).withColumn("q", F.concat(F.slice("p", 2, 3), F.slice("p", 1, 1)))
    signed = F.aggregate(F.zip_with("p", "q", lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda t, v: t + v)
    box = spatial.bounding_box(F.col("p"))
    return made.select("p_partkey", F.round(box["min_x"], 6).alias("min_x"), F.round(box["min_y"], 6).alias("min_y"), F.round(spatial.ring_area(F.col("p")), 6).alias("area"), (signed > 0).alias("counter_clockwise"))


@query("mirrored_rings", "SELECT p_partkey, CAST(-2 * p_size + 3 AS DOUBLE) AS min_x, CAST(3 AS DOUBLE) AS max_x, true AS same_direction FROM part")
def mirrored_rings(spark, d):
    """A mirrored ring is reversed, so that it turns the same way as before."""
    s = F.col("p_size").cast("double")
    zero = F.lit(0.0)
    base = F.array(R.point(zero, zero), R.point(2 * s, zero), R.point(2 * s, s), R.point(zero, s))
    made = table(spark, d, "part").select("p_partkey", R.placed(base, F.lit(True), F.lit(0), F.lit(3.0), F.lit(0.0)).alias("p")).withColumn("q", F.concat(F.slice("p", 2, 3), F.slice("p", 1, 1)))
    signed = F.aggregate(F.zip_with("p", "q", lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda t, v: t + v)
    box = spatial.bounding_box(F.col("p"))
    return made.select("p_partkey", F.round(box["min_x"], 9).alias("min_x"), F.round(box["max_x"], 9).alias("max_x"), (signed > 0).alias("same_direction"))


@query("stroked_paths", """
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 5 ELSE 3 END AS n, round(CAST(p_size * 2 * 3 AS DOUBLE), 6) AS boxes FROM part""")
def stroked_paths(spark, d):
    """A bend of two segments: a box each, and circles at all points or at the bend alone."""
    s = F.col("p_size").cast("double")
    zero = F.lit(0.0)
    path = F.array(R.point(zero, zero), R.point(2 * s, zero), R.point(2 * s, s))
    made = table(spark, d, "part").select("p_partkey", R.stroke(path, F.lit(2.0), F.col("p_partkey") % 2 == 0).alias("rings"))
    boxes = F.aggregate(F.filter("rings", lambda r: F.size(r) == 4), F.lit(0.0), lambda t, r: t + spatial.ring_area(r))
    return made.select("p_partkey", F.size("rings").alias("n"), F.round(boxes, 6).alias("boxes"))


@query("polygon_with_holes", "SELECT p_partkey, CAST(100 * p_size * p_size - CASE WHEN p_partkey % 2 = 0 THEN 2 * p_size * p_size ELSE 0 END AS DOUBLE) AS area FROM part")
def polygon_with_holes(spark, d):
    s = F.col("p_size").cast("double")
    mid = F.lit(0.0)
    holes = F.when(F.col("p_partkey") % 2 == 0, F.array(R.rectangle(-3 * s, mid, s, s), R.rectangle(3 * s, mid, s, s)))
    area = spatial.polygon_area(R.rectangle(mid, mid, 10 * s, 10 * s), holes)
    return table(spark, d, "part").select("p_partkey", F.round(area, 6).alias("area"))


# ------------------------------------------------------------------ spatial joins
@query("points_in_regions", """
    WITH p AS (SELECT p_partkey AS k, CAST((p_partkey * 7919) % 10007 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 9973 AS DOUBLE) AS y, p_partkey % 3 AS layer FROM part),
    r AS (SELECT s_suppkey AS region, (s_suppkey * 911) % 9000 + 0.5 AS x0, (s_suppkey * 577) % 9000 + 0.5 AS y0, 20 + s_suppkey % 37 * 40 AS w, s_suppkey % 3 AS layer FROM supplier)
    SELECT k, region FROM p JOIN r USING (layer) WHERE x > x0 AND x < x0 + w AND y > y0 AND y < y0 + w AND NOT (x > x0 + w / 4.0 AND x < x0 + w / 2.0 AND y > y0 + w / 4.0 AND y < y0 + w / 2.0)""")
def points_in_regions(spark, d):
    """Squares of many sizes, each with a square hole."""
    points = part_points(spark, d).select("k", F.col("x").alias("px"), F.col("y").alias("py"), (F.col("k") % 3).alias("layer"))
    s = F.col("s_suppkey")
    x0, y0, w = (s * 911) % 9000 + F.lit(0.5), (s * 577) % 9000 + F.lit(0.5), (20 + s % 37 * 40).cast("double")

    def box(x, y, size):
        c = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
        return F.array(*[F.struct(a.alias("x1"), b.alias("y1"), e.alias("x2"), f.alias("y2")) for (a, b), (e, f) in zip(c, c[1:] + c[:1], strict=True)])

    regions = table(spark, d, "supplier").select(s.alias("region"), (s % 3).alias("layer"), F.concat(box(x0, y0, w), box(x0 + w / 4, y0 + w / 4, w / 4)).alias("edges"))
    return spatial.points_in_regions(points, regions, "k", "region", ["layer"])


@query("nodes_within_discs", """
    WITH p AS (SELECT p_partkey AS node, CAST((p_partkey * 7919) % 10007 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 9973 AS DOUBLE) AS y, p_partkey % 3 AS layer FROM part),
    r AS (SELECT s_suppkey AS via, (s_suppkey * 911) % 9000 + 0.25 AS x0, (s_suppkey * 577) % 9000 + 0.25 AS y0, 30.0 + s_suppkey % 37 * 20 AS r, s_suppkey % 3 AS layer FROM supplier)
    SELECT via, node FROM p JOIN r USING (layer) WHERE sqrt((x - x0) * (x - x0) + (y - y0) * (y - y0)) <= r""")
def nodes_within_discs(spark, d):
    nodes = part_points(spark, d).select(F.col("k").alias("node"), F.col("x").alias("nx"), F.col("y").alias("ny"), (F.col("k") % 3).alias("layer"))
    s = F.col("s_suppkey")
    discs = table(spark, d, "supplier").select(s.alias("via"), ((s * 911) % 9000 + 0.25).alias("px"), ((s * 577) % 9000 + 0.25).alias("py"), (30.0 + s % 37 * 20).alias("r"), (s % 3).alias("layer"))
    return spatial.nodes_within(discs, nodes, "via", "node", ["layer"], "r")


@query("containing_triangle", """
    WITH p AS (SELECT p_partkey AS k, (p_partkey * 7919) % 10007 + 0.25 AS x, (p_partkey * 104729) % 9973 + 0.375 AS y, p_partkey % 2 AS layer FROM part),
    t AS (SELECT s_suppkey AS tri, CAST((s_suppkey * 911) % 9000 AS DOUBLE) AS x0, CAST((s_suppkey * 577) % 9000 AS DOUBLE) AS y0, 50.0 + s_suppkey % 37 * 60 AS w, s_suppkey % 2 AS layer FROM supplier)
    SELECT k, min(tri) AS tri FROM p JOIN t USING (layer) WHERE x >= x0 AND y >= y0 AND (x - x0) + (y - y0) <= w GROUP BY 1""")
def containing_triangle(spark, d):
    points = part_points(spark, d).select("k", (F.col("x") + 0.25).alias("px"), (F.col("y") + 0.375).alias("py"), (F.col("k") % 2).alias("layer"))
    s = F.col("s_suppkey")
    x0, y0, w = ((s * 911) % 9000).cast("double"), ((s * 577) % 9000).cast("double"), 50.0 + s % 37 * 60
    triangles = table(spark, d, "supplier").select(s.alias("tri"), (s % 2).alias("layer"), x0.alias("x0"), y0.alias("y0"), (x0 + w).alias("x1"), y0.alias("y1"), x0.alias("x2"), (y0 + w).alias("y2"))
    return spatial.containing_triangle(points, triangles, "k", "tri", ["layer"])


@query("region_union", """
    SELECT 'L' || s_suppkey % 4 AS layer_id, CASE WHEN s_suppkey % 7 <> 0 THEN 'n' || s_suppkey END AS net_id, CAST(round((w * 2.0 * w * 2 - w * w) * 1e12) AS BIGINT) AS area_um2, 2 AS sources
    FROM (SELECT s_suppkey, (1 + s_suppkey % 5) * 1e-3 AS w FROM supplier) WHERE s_suppkey % 7 <> 0
    UNION ALL SELECT 'L' || s_suppkey % 4, NULL, CAST(round((w * 2.0 * w * 2 - w * w) * 1e12) AS BIGINT), 2 FROM (SELECT s_suppkey, (1 + s_suppkey % 5) * 1e-3 AS w FROM supplier) WHERE s_suppkey % 7 = 0""")
def region_union(spark, d):
    """A square with a square hole, and a smaller square inside the hole's corner that the copper touches, for each supplier; those of no net lie apart."""
    s = F.col("s_suppkey")
    w = (1 + s % 5) * 1e-3
    at = s * 2e-2
    whole = F.array(R.rectangle(at + w, w, 2 * w, 2 * w), R.rectangle(at + w, w, w * 1.5, w * 1.5))
    # The hole is filled but for a square of side w.
    half = [R.rectangle(at + w * 0.375, w, w * 0.25, w * 1.5), R.rectangle(at + w * 1.625, w, w * 0.25, w * 1.5), R.rectangle(at + w, w * 0.375, w, w * 0.25), R.rectangle(at + w, w * 1.625, w, w * 0.25)]
    base = table(spark, d, "supplier").select(s, F.concat(F.lit("L"), s % 4).alias("layer_id"), F.when(s % 7 != 0, F.concat(F.lit("n"), s)).alias("net_id"), whole.alias("w"), F.array(*half).alias("h"))
    one = base.select(F.concat(F.lit("a"), s).alias("region_id"), "layer_id", "net_id", F.col("w").alias("rings"))
    two = base.select(F.concat(F.lit("b"), s).alias("region_id"), "layer_id", "net_id", F.col("h").alias("rings"))
    merged = union.union_regions(one.unionByName(two))
    return merged.select("layer_id", "net_id", F.round(F.col("area") * 1e12).cast("long").alias("area_um2"), F.size("source_ids").alias("sources"))


# ------------------------------------------------------------------ triangles
def corners(spark, d):
    """A right triangle for each part, of its own nodes: (0, 0), (a, 0), (0, b)."""
    k = F.col("p_partkey")
    a, b = (1 + F.col("p_size") % 7).cast("double"), (1 + k % 5).cast("double")
    zero = F.lit(0.0)
    return table(spark, d, "part").select(
        (k % 3).alias("study"), F.lit(0).alias("layer"), k.alias("tri"), (3 * k).alias("n0"), (3 * k + 1).alias("n1"), (3 * k + 2).alias("n2"),
        zero.alias("x0"), zero.alias("y0"), a.alias("x1"), zero.alias("y1"), zero.alias("x2"), b.alias("y2"), F.lit(2.0).alias("gs"), F.lit(0.5).alias("thickness"),
    )


TRI = "t AS (SELECT p_partkey AS k, p_partkey % 3 AS study, CAST(1 + p_size % 7 AS DOUBLE) AS a, CAST(1 + p_partkey % 5 AS DOUBLE) AS b FROM part)"


@query("element_gradients", f"WITH {TRI} SELECT k AS tri, a * b AS area2, -1 / a AS gx0, -1 / b AS gy0, 1 / a AS gx1, CAST(0 AS DOUBLE) AS gy1, CAST(0 AS DOUBLE) AS gx2, 1 / b AS gy2 FROM t")
def element_gradients(spark, d):
    g = fem.gradients(corners(spark, d))
    return g.select("tri", "area2", *[(F.col(c) + F.lit(0.0)).alias(c) for c in ("gx0", "gy0", "gx1", "gy1", "gx2", "gy2")])


@query("linear_stiffness", f"""
    WITH {TRI}, e AS (SELECT study, 3 * k AS k, a, b, a * b AS s FROM t)
    SELECT study, k AS row, k AS col, round(s * (1 / (a * a) + 1 / (b * b)), 9) AS val FROM e UNION ALL SELECT study, k, k + 1, round(-s / (a * a), 9) FROM e UNION ALL SELECT study, k, k + 2, round(-s / (b * b), 9) FROM e
    UNION ALL SELECT study, k + 1, k, round(-s / (a * a), 9) FROM e UNION ALL SELECT study, k + 1, k + 1, round(s / (a * a), 9) FROM e UNION ALL SELECT study, k + 1, k + 2, CAST(0 AS DOUBLE) FROM e
    UNION ALL SELECT study, k + 2, k, round(-s / (b * b), 9) FROM e UNION ALL SELECT study, k + 2, k + 1, CAST(0 AS DOUBLE) FROM e UNION ALL SELECT study, k + 2, k + 2, round(s / (b * b), 9) FROM e""")
def linear_stiffness(spark, d):
    """Entries of every element: conductance 2, area ab / 2."""
    out = fem.stiffness(fem.gradients(corners(spark, d)))
    return out.select("study", "row", "col", (F.round("val", 9) + F.lit(0.0)).alias("val"))


@query("quadratic_stiffness", f"WITH {TRI} SELECT study, 36 * count(*) AS entries, CAST(0 AS DOUBLE) AS total, round(sum(10 * (1 / (a * a) + 1 / (b * b)) * a * b), 4) AS trace FROM t GROUP BY 1")
def quadratic_stiffness(spark, d):
    """Rows of a stiffness sum to zero; the trace of a right triangle's is known."""
    tri = corners(spark, d)
    nodes = tri.select("study", "layer", F.explode(F.array(*[F.struct(F.col(f"n{k}").alias("node"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(3)])).alias("p")).select("study", "layer", "p.*")
    _, wide = fem.quadratic_nodes(tri.drop("x0", "y0", "x1", "y1", "x2", "y2"), nodes)
    entries = fem.quadratic_stiffness(fem.gradients(fem.with_corners(wide, nodes)))
    own = F.sum(F.when(F.col("row") == F.col("col"), F.col("val")))
    return entries.groupBy("study").agg(F.count(F.lit(1)).alias("entries"), F.abs(F.round(F.sum("val"), 6)).alias("total"), F.round(own, 4).alias("trace"))


@query("quadratic_nodes", f"WITH {TRI} SELECT study, 6 * count(*) AS nodes, sum(a + b) * 2 AS reach FROM t GROUP BY 1")
def quadratic_nodes(spark, d):
    """Three corners and three middles each; the middles lie half way."""
    tri = corners(spark, d)
    nodes = tri.select("study", "layer", F.explode(F.array(*[F.struct(F.col(f"n{k}").alias("node"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(3)])).alias("p")).select("study", "layer", "p.*")
    more, _ = fem.quadratic_nodes(tri.drop("x0", "y0", "x1", "y1", "x2", "y2"), nodes)
    return more.groupBy("study").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("x") + F.col("y")).alias("reach"))


@query("element_fields", f"""
    WITH {TRI} SELECT k AS tri, a * b / 2 AS area, round(-1 / a, 9) AS ex, round(-2 / b, 9) AS ey, round(2 * sqrt(1 / (a * a) + 4 / (b * b)), 9) AS j_sheet, round(4 * sqrt(1 / (a * a) + 4 / (b * b)), 9) AS j_vol,
        round((1 / (a * a) + 4 / (b * b)) * a * b, 9) AS power FROM t""")
def element_fields(spark, d):
    """Potentials 0, 1 and 2 at the corners."""
    tri = fem.gradients(corners(spark, d))
    volts = tri.select("study", F.explode(F.array(*[F.struct(F.col(f"n{k}").alias("node"), F.lit(float(k)).alias("voltage")) for k in range(3)])).alias("v")).select("study", "v.*")
    out = fem.element_fields(tri, volts)
    return out.select("tri", "area", *[F.round(c, 9).alias(c) for c in ("ex", "ey", "j_sheet", "j_vol", "power")])


@query("flux_jumps", f"""
    WITH {TRI}, f AS (SELECT k, a, b, 2 / b * 2 AS f0, (1 / a * b + 2 / b * a) / sqrt(a * a + b * b) * 2 AS f1, 1 / a * 2 AS f2 FROM t)
    SELECT k AS tri, round(sqrt(0.5 * (a * a * f0 * f0 + (a * a + b * b) * f1 * f1 + b * b * f2 * f2)), 9) AS eta FROM f""")
def flux_jumps(spark, d):
    """Every edge is a boundary here: what flows out of it is the jump."""
    tri = fem.gradients(corners(spark, d))
    volts = tri.select("study", F.explode(F.array(*[F.struct(F.col(f"n{k}").alias("node"), F.lit(float(k)).alias("voltage")) for k in range(3)])).alias("v")).select("study", "v.*")
    return fem.flux_jumps(fem.element_fields(tri, volts)).select("tri", F.round("eta", 9).alias("eta"))


@query("lumped_resistors", """
    WITH s AS (SELECT l_linenumber AS study, l_partkey AS u, 1000000 + l_suppkey AS w, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS g FROM lineitem GROUP BY 1, 2, 3),
    e AS (SELECT study, u AS row, u AS col, g AS val FROM s UNION ALL SELECT study, w, w, g FROM s UNION ALL SELECT study, u, w, -g FROM s UNION ALL SELECT study, w, u, -g FROM s)
    SELECT study, row, col, sum(val) AS val FROM e GROUP BY 1, 2, 3""")
def lumped_resistors(spark, d):
    items = table(spark, d, "lineitem")
    segments = items.select(F.col("l_linenumber").alias("study"), F.col("l_partkey").alias("upper"), (F.col("l_suppkey") + 1_000_000).alias("lower"), F.col("l_quantity").cast("long").cast("double").alias("conductance"))
    return fem.assemble(fem.lumped(segments), ["study"]).select("study", "row", "col", "val")


@query("merged_unknowns", """
    WITH m AS (SELECT l_linenumber AS study, l_partkey AS row, 1000000 + l_suppkey AS col, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS val FROM lineitem GROUP BY 1, 2, 3)
    SELECT study, CASE WHEN row % 10 < 3 THEN row % 10 ELSE row END AS row, col, sum(val) AS val FROM m GROUP BY 1, 2, 3""")
def merged_unknowns(spark, d):
    """Three contacts of each study hold every node that ends in 0, 1 or 2; their smallest node is the unknown."""
    items = table(spark, d, "lineitem")
    # Suppliers are nodes below zero until they are named, as parts may have keys over a million too.
    entries = items.select(F.col("l_linenumber").alias("study"), F.col("l_partkey").alias("row"), (-1 - F.col("l_suppkey")).alias("col"), F.col("l_quantity").cast("long").cast("double").alias("val"))
    studies = items.select(F.col("l_linenumber").alias("study")).distinct()
    held = studies.crossJoin(table(spark, d, "part").where("p_partkey % 10 < 3").select(F.col("p_partkey").alias("node"))).withColumn("contact", F.concat(F.lit("c"), F.col("node") % 10))
    merged = durable(fem.equipotential(held))
    return fem.merge_unknowns(entries, merged).select("study", "row", (999_999 - F.col("col")).alias("col"), "val")


@query("via_segments_currents", """
    WITH c AS (SELECT o_orderkey % 10 AS study, o_custkey AS via, o_orderkey % 25 AS layer, o_orderkey AS node FROM orders),
    one AS (SELECT study, via, layer, min(node) AS node FROM c GROUP BY 1, 2, 3),
    p AS (SELECT study, via, node AS u, lead(node) OVER w AS l, lead(layer) OVER w - layer AS h FROM one WINDOW w AS (PARTITION BY study, via ORDER BY layer)),
    i AS (SELECT study, via, 3.0 / h AS g, (u % 13 - l % 13) AS dv FROM p WHERE l IS NOT NULL)
    SELECT study, via AS via_id, round(max(abs(g * dv)), 6) AS most, round(sum(g * dv * dv), 6) AS power FROM i GROUP BY 1, 2""")
def via_segments_currents(spark, d):
    """Barrels join neighbouring connected layers; the current is that of the segment with the most."""
    orders = table(spark, d, "orders")
    contacts = orders.groupBy((F.col("o_orderkey") % 10).alias("study"), F.col("o_custkey").alias("via_id"), (F.col("o_orderkey") % 25).cast("int").alias("layer")).agg(F.min("o_orderkey").alias("node")).withColumn("barrel_area", F.lit(1.5))
    heights = table(spark, d, "nation").select(F.col("n_nationkey").alias("layer"), F.col("n_nationkey").cast("double").alias("z_mid"))
    volts = orders.select((F.col("o_orderkey") % 10).alias("study"), F.col("o_orderkey").alias("node"), (F.col("o_orderkey") % 13).cast("double").alias("voltage"))
    found = fem.via_currents(fem.via_segments(contacts, heights, 2.0), volts)
    return found.select("study", "via_id", F.round(F.abs("current"), 6).alias("most"), F.round("power", 6).alias("power"))


@query("triangle_quality", f"""
    WITH {TRI}, m AS (SELECT study, least(degrees(atan(a / b)), degrees(atan(b / a))) AS angle, a * b / 2 AS area FROM t)
    SELECT study, round(min(angle), 6) AS min_angle, round(quantile_cont(angle, 0.05), 6) AS p05_angle, count(*) FILTER (WHERE angle < 10) AS slivers, sum(area) AS area FROM m GROUP BY 1""")
def triangle_quality(spark, d):
    found = mesh.quality(corners(spark, d), ["study"])
    return found.select("study", F.round("min_angle", 6).alias("min_angle"), F.round("p05_angle", 6).alias("p05_angle"), "slivers", "area")


# ------------------------------------------------------------------ mesh points
@query("grid_cuts", """
    WITH l AS (SELECT DISTINCT o_custkey AS board, CAST(o_orderkey % 100 AS DOUBLE) AS p FROM orders), g AS (SELECT board, p, lead(p) OVER (PARTITION BY board ORDER BY p) AS nxt FROM l)
    SELECT board, CAST(sum(CASE WHEN nxt IS NULL THEN 1 ELSE greatest(1, ceil((nxt - p) / 3 - 1e-9)) END) AS BIGINT) AS n, min(p) AS low, max(p) AS high FROM g GROUP BY 1""")
def grid_cuts(spark, d):
    lines = table(spark, d, "orders").select(F.col("o_custkey").alias("board"), (F.col("o_orderkey") % 100).cast("double").alias("at"))
    return mesh.cuts(lines, ["board"], 3.0).groupBy("board").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))


@query("hex_lattice", """
    SELECT s_suppkey, CAST(sum(CASE WHEN j % 2 = 0 THEN floor(w / 2) + 1 ELSE floor((w - 1) / 2) + 1 END) AS BIGINT) AS n
    FROM (SELECT s_suppkey, 10.25 + s_suppkey % 9 AS w, unnest(range(0, CAST(floor(20.0 / sqrt(3)) AS BIGINT) + 1)) AS j FROM supplier) GROUP BY 1""")
def hex_lattice(spark, d):
    """Rows of points two apart, every other one shifted by one."""
    boxes = table(spark, d, "supplier").select("s_suppkey", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (10.25 + F.col("s_suppkey") % 9).alias("x1"), F.lit(20.0).alias("y1"))
    return mesh.hex_lattice(boxes, ["s_suppkey"], 2.0).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query("merged_points", """
    WITH p AS (SELECT p_partkey AS k, CAST((p_partkey * 7919) % 10007 AS DOUBLE) AS x, CAST((p_partkey * 104729) % 9973 AS DOUBLE) AS y, p_partkey % 2 AS layer FROM part),
    kept AS (SELECT * FROM p WHERE k % 5 = 0), gen AS (SELECT * FROM p WHERE k % 5 <> 0)
    SELECT layer, count(*) AS n, sum(x) AS sx FROM (SELECT layer, x FROM kept UNION ALL SELECT layer, x FROM gen g WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.layer = g.layer AND sqrt((kept.x - g.x) * (kept.x - g.x) + (kept.y - g.y) * (kept.y - g.y)) < 150)) GROUP BY 1""")
def merged_points(spark, d):
    """Mandatory points suppress generated ones nearby."""
    points = part_points(spark, d).select("k", (F.col("k") % 2).alias("layer"), F.col("x").alias("px"), F.col("y").alias("py"))
    out = mesh.merge_points(points.where("k % 5 = 0"), points.where("k % 5 <> 0"), ["layer"], 150.0)
    return out.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.sum("px").alias("sx"))


@query("ring_walk", """
    SELECT p_partkey AS ring, k AS pos, CAST(CASE k WHEN 0 THEN 0 WHEN 1 THEN p_size WHEN 2 THEN 2 * p_size ELSE 3 * p_size END AS DOUBLE) AS position, k <> 1 AS corner FROM part, range(4) g(k)""")
def ring_walk(spark, d):
    """A triangle with a point in the middle of its first side, where it does not turn."""
    s = F.col("p_size").cast("double")
    zero = F.lit(0.0)
    points = F.array(*[F.struct(F.lit(k).cast("long").alias("pos"), x.alias("x"), y.alias("y")) for k, (x, y) in enumerate([(zero, zero), (s, zero), (2 * s, zero), (2 * s, s)])])
    rings = table(spark, d, "part").select(F.col("p_partkey").alias("ring"), F.explode(points).alias("p")).select("ring", "p.*")
    return mesh.ring_walk(rings, ["ring"], "pos").select("ring", "pos", "position", "corner")


# ------------------------------------------------------------------ documents
@query("canonical_round_trip", """
    SELECT n_name AS board_id, count(*) AS nets, CAST(sum(CAST(c_custkey AS BIGINT)) AS BIGINT) AS ids, 2 AS layers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def canonical_round_trip(spark, d):
    """A board a nation, its customers as nets: written as documents, read back and counted.  A nation's nets are one document, as boards are."""
    nets = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name")))).alias("nets"))
    full = table(spark, d, "nation").join(nets, "n_nationkey")
    layer = lambda k, kind: f'{{"id":"l{k}","name":"L{k}","function":"{kind}","index":{k},"thickness":{{"value":3.5e-5,"unit":"m","provenance":"imported"}}}}'
    board = F.concat(F.lit('{"id":"'), "n_name", F.lit(f'","name":"b","stackup":[{layer(0, "signal")},{layer(1, "plane")}],"nets":'), F.to_json("nets"), F.lit("}"))
    documents = full.select(F.from_json(board, canonical_json.BOARD).alias("board"))
    folder = new_folder(spark, "boards")
    # A line is one document.
    canonical_json.write(documents.repartition("board.id"), folder, "format_version")
    files = spark.read.text(f"{folder}/part-*").where("value <> ''")
    read = files.select(F.lit("f").alias("source_name"), F.sha2("value", 256).alias("source_digest"), F.from_json(F.get_json_object("value", "$.board"), canonical_json.BOARD, {"mode": "FAILFAST"}).alias("board"))
    parts = canonical_json.tables(read)
    counted = parts["nets"].groupBy("board_id").agg(F.count(F.lit(1)).alias("nets"), F.sum(F.col("id").cast("long")).alias("ids"))
    return counted.join(parts["stackup"].groupBy("board_id").agg(F.count(F.lit(1)).cast("int").alias("layers")), "board_id")


@query("canonical_diagnostics", """
    SELECT n_name AS board_id, 'layer.thickness_missing' AS code, 1 AS n, 'l1' AS first FROM nation WHERE n_nationkey % 2 = 0
    UNION ALL SELECT n_name, 'layer.thickness_assumed', 1, 'l0' FROM nation WHERE n_nationkey % 3 = 0
    UNION ALL SELECT n_name, 'via.incomplete', count(*), 'v' || min(s_suppkey) FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 1 GROUP BY 1""")
def canonical_diagnostics(spark, d):
    quantity = lambda source: F.struct(F.lit(1e-3).alias("value"), F.lit("m").alias("unit"), source.alias("provenance"), F.lit("n").alias("note"))
    n = F.col("n_nationkey")
    layer = lambda pos, function, thickness: F.struct(F.lit(pos).alias("pos"), F.lit(f"l{pos}").alias("id"), F.lit(function).alias("function"), thickness.alias("thickness"))
    layers = F.array(
        layer(0, "signal", F.when(F.lit(True), quantity(F.when(n % 3 == 0, "assumed").otherwise("imported")))), layer(1, "plane", F.when(n % 2 == 1, quantity(F.lit("imported")))),
        layer(2, "dielectric", F.when(F.lit(False), quantity(F.lit("imported")))),
    )
    stackup = table(spark, d, "nation").select(F.col("n_name").alias("board_id"), F.explode(layers).alias("l")).select("board_id", "l.*")
    s = F.col("s_suppkey")
    named = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("board_id"))
    known = quantity(F.lit("imported"))
    vias = table(spark, d, "supplier").join(named, "s_nationkey").select(
        "board_id", s.alias("pos"), F.concat(F.lit("v"), s).alias("id"), known.alias("plating_thickness"), F.when(s % 2 == 0, known).alias("finished_hole_diameter"), F.lit(None).cast("double").alias("drill_diameter")
    )
    return canonical_json.diagnostics({"stackup": stackup, "vias": vias})


def ipc_documents(spark, d, read=None):
    """An IPC-2581 document a nation, in inches for every third: four layers, a rectangle a customer, a via a supplier, a pin for both."""
    k = F.col("n_nationkey")
    net = F.when(F.col("c_custkey") % 5 == 0, "No Net").otherwise(F.concat(F.lit("N"), F.col("c_custkey")))
    feature = F.format_string(
        '<Set net="%s" polarity="%s"><Features><Location x="%d" y="0"/><RectCenter width="2" height="3"/></Features>%s</Set>', net,
        F.when(F.col("c_custkey") % 11 == 0, "NEGATIVE").otherwise("POSITIVE"), F.col("c_custkey") * 4, F.when(F.col("c_custkey") % 7 == 0, "<Features><Mystery/></Features>").otherwise("")
    )
    features = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", feature.alias("t")))), lambda x: x["t"]), "").alias("features"))
    stack = F.format_string(
        '<PadStack name="p" net="N%d"><LayerHole name="h%d" diameter="0.3" platingStatus="%s" x="%d" y="1"><Span fromLayer="Top" toLayer="Bot"/></LayerHole>'
        '<LayerPad layerRef="Top"><Location x="%d" y="20"/><StandardPrimitiveRef id="%s"/><PinRef componentRef="U%d" pin="1"/></LayerPad></PadStack><Component refDes="U%d" part="P"/>',
        F.col("s_suppkey"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 4 == 0, "NONPLATED").otherwise("VIA"), F.col("s_suppkey"), F.col("s_suppkey"), F.when(F.col("s_suppkey") % 6 == 0, "lost").otherwise("round"), F.col("s_suppkey"), F.col("s_suppkey"),
    )
    stacks = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", stack.alias("t")))), lambda x: x["t"]), "").alias("stacks"))
    units = F.when(k % 3 == 0, "INCH").otherwise("MILLIMETER")
    layers = "".join(f'<Layer name="{n}" layerFunction="{f}"/>' for n, f in (("Top", "CONDUCTOR"), ("Core", "DIELCORE"), ("Bot", "PLANE"), ("Odd", "COMPONENT")))
    heights = "".join(f'<StackupLayer layerOrGroupRef="{n}" thickness="{t}" sequence="{s}"/>' for n, t, s in (("Bot", "0.035", 3), ("Top", "0.035", 1), ("Core", "1.5", 2)))
    text = F.concat(
        F.lit('<?xml version="1.0"?><IPC-2581 revision="'), F.when(k % 2 == 0, "B").otherwise("rev-b"), F.lit('" xmlns="http://webstds.ipc.org/2581"><Content><DictionaryStandard><EntryStandard id="round"><Circle diameter="2"/></EntryStandard></DictionaryStandard></Content><Ecad><CadHeader units="'),
        units, F.lit(f'"/><CadData>{layers}<Stackup>{heights}</Stackup><Step><Profile><Polygon><PolyBegin x="0" y="0"/><PolyStepSegment x="50" y="0"/><PolyStepSegment x="50" y="50"/></Polygon></Profile>'),
        F.coalesce("stacks", F.lit("")), F.lit('<LayerFeature layerRef="Top">'), F.coalesce("features", F.lit("")), F.lit("</LayerFeature></Step></CadData></Ecad></IPC-2581>"),
    )
    full = table(spark, d, "nation").join(features, "n_nationkey", "left").join(stacks, "n_nationkey", "left")
    return stored_documents(full.select("n_nationkey", text.alias("value")), read)


def nation_of(source):
    return F.regexp_extract(source, "n_nationkey=([0-9]+)", 1).cast("int")


def stored_documents(texts, read=None):
    """The sections of documents that are stored first, one file for each: a folder for each nation; ``read`` in place of the parser."""
    folder = new_folder(texts.sparkSession, "ipc")
    texts.repartition("n_nationkey").write.partitionBy("n_nationkey").text(folder)
    if read:
        return {name: part.withColumn("n_nationkey", nation_of("source")) for name, part in read(texts.sparkSession, f"{folder}/n_nationkey=*/part-*").items()}
    rows = durable(ipc2581.read_rows(texts.sparkSession, f"{folder}/n_nationkey=*/part-*"))
    return {name: part.withColumn("n_nationkey", nation_of("source")) for name, part in ipc2581.sections_of(rows).items()}


@query("ipc_nested_primitives", """
    WITH c AS (SELECT c_nationkey AS n, c_custkey % 7 AS r, CASE WHEN c_nationkey % 3 = 0 THEN 0.0254 * 0.0254 ELSE 1e-6 END AS s, (1 + c_nationkey % 5) * 2 AS chain FROM customer),
    f AS (SELECT *, CASE r WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS rings, CASE r WHEN 0 THEN chain WHEN 1 THEN chain WHEN 2 THEN chain * 2 + 1 WHEN 5 THEN 9 WHEN 6 THEN 12 ELSE 0 END AS area FROM c)
    SELECT n AS n_nationkey, CAST(sum(rings) AS BIGINT) AS polygons, CAST(round(sum(area) * any_value(s) * 1e9) AS BIGINT) AS area_e9, count(*) FILTER (WHERE r = 3) AS cycles, count(*) FILTER (WHERE r = 4) AS missing FROM f GROUP BY 1""")
def ipc_nested_primitives(spark, d):
    """Features drawn by a chain of five references, its middle, a user group that doubles it, a cycle, an entry that is not there, two primitives in one feature, a square-cornered RectRound."""
    k, c = F.col("n_nationkey"), F.col("c_custkey")
    refs = ['<StandardPrimitiveRef id="c0"/>', '<StandardPrimitiveRef id="c3"/>', '<UserPrimitiveRef id="group"/>', '<StandardPrimitiveRef id="loop"/>', '<StandardPrimitiveRef id="half"/>',
            '<RectCenter width="2" height="4"/><UserSpecial><RectCenter width="1" height="1"/></UserSpecial>', '<RectRound width="4" height="3" radius="0"/>']
    shape = F.get(F.array(*[F.lit(r) for r in refs]), (c % 7).cast("int"))
    feature = F.format_string('<Set net="N%d"><Features><Location x="%d" y="0"/>%s</Features></Set>', c, c * 9, shape)
    drawn = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(c, feature.alias("t")))), lambda x: x["t"]), "").alias("drawn"))
    links = "".join(f'<EntryStandard id="{a}"><StandardPrimitiveRef id="{b}"/></EntryStandard>' for a, b in (("c0", "c1"), ("c1", "c2"), ("c2", "c3"), ("c3", "c4"), ("c4", "c5"), ("loop", "back"), ("back", "loop"), ("half", "gone")))
    group = '<DictionaryUser><EntryUser id="group"><UserSpecial><StandardPrimitiveRef id="c1"/><StandardPrimitiveRef id="c4"/><RectCenter width="1" height="1"/></UserSpecial></EntryUser></DictionaryUser>'
    text = F.concat(
        F.lit(f'<IPC-2581 revision="B"><Content><DictionaryStandard>{links}<EntryStandard id="c5"><RectCenter width="'), 1 + k % 5, F.lit(f'" height="2"/></EntryStandard></DictionaryStandard>{group}</Content><Ecad><CadHeader units="'),
        F.when(k % 3 == 0, "INCH").otherwise("MILLIMETER"), F.lit('"/><CadData><Layer name="Top" layerFunction="CONDUCTOR"/><Step><LayerFeature layerRef="Top">'), F.col("drawn"), F.lit("</LayerFeature></Step></CadData></Ecad></IPC-2581>"),
    )
    parts = stored_documents(drawn.select("n_nationkey", text.alias("value")))
    shapes = durable(ipc2581.resolved_shapes(parts))
    nation = nation_of("source").alias("n_nationkey")
    made = ipc2581.copper(parts, shapes).groupBy(nation).agg(F.count(F.lit(1)).alias("polygons"), spatial.exact_sum(F.get("areas", F.lit(0)), 1e-9).alias("area_e9"))
    count = lambda reason: F.coalesce(F.sum(F.when(F.col("reason") == reason, F.col("n"))), F.lit(0))
    lost = ipc2581.missing_refs(parts, shapes).groupBy(nation).agg(count("cycle").alias("cycles"), count("missing").alias("missing"))
    zero = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("polygons", "area_e9", "cycles", "missing")}
    return drawn.select("n_nationkey").join(made, "n_nationkey", "left").join(lost, "n_nationkey", "left").withColumns(zero)


@query("ipc_headers", "SELECT n_nationkey, 'supported' AS revision_state, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 0.0254 ELSE 0.001 END AS DOUBLE) AS scale FROM nation")
def ipc_headers(spark, d):
    return ipc_documents(spark, d)["header"].select("n_nationkey", "revision_state", "scale")


@query("ipc_sections", """
    SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS features, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 7 = 0) AS unknown,
           (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS holes, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey AND s_suppkey % 6 = 0) AS missing FROM nation""")
def ipc_sections(spark, d):
    """Features, unknown constructs, holes, and pads whose primitive no dictionary has."""
    parts = ipc_documents(spark, d)
    out = table(spark, d, "nation").select("n_nationkey")
    for name, section in (("features", "feature"), ("unknown", "unknown"), ("holes", "hole")):
        out = out.join(parts[section].groupBy("n_nationkey").agg(F.count(F.lit(1)).alias(name)), "n_nationkey", "left")
    lost = ipc2581.missing_refs(parts).groupBy(F.regexp_extract("source", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey")).agg(F.sum("n").alias("missing"))
    return out.join(lost, "n_nationkey", "left").select("n_nationkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("features", "unknown", "holes", "missing")])


@query("import_records", """
    SELECT 'started' AS event, CAST(NULL AS BIGINT) AS documents, CAST(NULL AS BIGINT) AS feature, CAST(NULL AS BIGINT) AS hole, CAST(NULL AS BIGINT) AS unknown
    UNION ALL SELECT 'finished', (SELECT count(*) FROM nation), (SELECT count(*) FROM customer), (SELECT count(*) FROM supplier), (SELECT count(*) FROM customer WHERE c_custkey % 7 = 0)""")
def import_records(spark, d):
    """Records of an import of all documents, counted while their sections were written."""
    root = new_folder(spark, "imports")

    def read(s, path):
        import_run.run_import(s, path, root)
        return {"records": import_run.records(s, root).withColumn("source", F.lit(None).cast("string"))}

    return ipc_documents(spark, d, read)["records"].select("event", "documents", "feature", "hole", "unknown")


@query("ipc_scan", """
    SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS feature, (SELECT CAST(coalesce(sum(c_custkey * 4), 0) AS BIGINT) FROM customer WHERE c_nationkey = n_nationkey) AS x, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 7 = 0) AS unknown,
           (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS hole, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS component, 4 AS layer, 3 AS stackup, CAST(CASE WHEN n_nationkey % 3 = 0 THEN 0.0254 ELSE 0.001 END AS DOUBLE) AS scale, true AS in_order FROM nation""")
def ipc_scan(spark, d):
    """Sections of documents that are split over tasks wherever an element ends; sets in the order in which they were drawn."""
    parts = ipc_documents(spark, d, lambda s, path: ipc2581_scan.scan(s, path)[0])
    out = parts["header"].select("n_nationkey", "scale")
    for name in ("feature", "unknown", "hole", "component", "layer", "stackup"):
        out = out.join(parts[name].groupBy("n_nationkey").agg(F.count(F.lit(1)).alias(name)), "n_nationkey", "left")
    # Sets were drawn by rising customer, so by rising x.
    along = parts["feature"].withColumn("k", F.row_number().over(W.partitionBy("n_nationkey").orderBy("x")) - 1)
    drawn = along.groupBy("n_nationkey").agg(F.sum("x").cast("long").alias("x"), F.bool_and(F.col("k") == F.col("set")).alias("in_order"))
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("feature", "unknown", "hole", "component", "layer", "stackup", "x")}
    return out.join(drawn, "n_nationkey", "left").withColumns(filled | {"in_order": F.coalesce("in_order", F.lit(True))})


@query("ipc_board", """
    WITH c AS (SELECT c_nationkey AS n, count(*) FILTER (WHERE c_custkey % 11 <> 0) AS drawn, count(*) FILTER (WHERE c_custkey % 11 = 0) AS refused, count(DISTINCT CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 11 <> 0 THEN c_custkey END) AS named FROM customer GROUP BY 1),
    s AS (SELECT s_nationkey AS n, count(*) FILTER (WHERE s_suppkey % 6 <> 0) AS pads, count(*) FILTER (WHERE s_suppkey % 4 <> 0) AS vias, count(*) AS terminals FROM supplier GROUP BY 1)
    SELECT n_nationkey, coalesce(drawn, 0) + coalesce(pads, 0) AS regions, coalesce(refused, 0) AS refused, coalesce(vias, 0) AS vias, coalesce(terminals, 0) AS terminals, 3 AS layers,
           CAST(round(coalesce(drawn, 0) * 6 * CASE WHEN n_nationkey % 3 = 0 THEN 0.0254 * 0.0254 ELSE 1e-6 END * 1e9) AS BIGINT) AS rectangles_e9
    FROM nation LEFT JOIN c ON c.n = n_nationkey LEFT JOIN s ON s.n = n_nationkey""")
def ipc_board(spark, d):
    """Layers, copper, refused negative artwork, plated holes and terminals of the boards, in metres."""
    board = ipc2581.board_tables(ipc_documents(spark, d))
    nation = F.regexp_extract("source", "n_nationkey=([0-9]+)", 1).cast("int").alias("n_nationkey")
    count = lambda name, df: df.groupBy(nation).agg(F.count(F.lit(1)).alias(name))
    boxes = board["regions"].where(F.size(F.get("rings", F.lit(0))) == 4).groupBy(nation).agg(spatial.exact_sum(F.get("areas", F.lit(0)), 1e-9).alias("rectangles_e9"))
    out = table(spark, d, "nation").select("n_nationkey")
    refused = board["refused"].groupBy(nation).agg(F.sum("n").alias("refused"))
    for part in (count("regions", board["regions"]), refused, count("vias", board["vias"]), count("terminals", board["terminals"]), boxes, board["layers"].groupBy(nation).agg(F.count(F.lit(1)).cast("int").alias("layers"))):
        out = out.join(part, "n_nationkey", "left")
    return out.select("n_nationkey", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("regions", "refused", "vias", "terminals", "layers", "rectangles_e9")])


@query("vtk_export", "SELECT 'POINTS' AS word, CAST(3 * count(*) AS BIGINT) AS n FROM part UNION ALL SELECT 'CELLS', count(*) FROM part UNION ALL SELECT 'CELL_TYPES', count(*) FROM part UNION ALL SELECT 'CELL_DATA', count(*) FROM part")
def vtk_export(spark, d):
    """Counts that the headers of the export state."""
    tri = corners(spark, d).withColumn("study", F.lit("s"))
    nodes = tri.select("study", F.explode(F.array(*[F.struct(F.col(f"n{k}").alias("node"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(3)])).alias("p")).select("study", "p.*")
    lines = artifacts.vtk_lines(nodes, tri.select("study", "tri", "n0", "n1", "n2", "gs"), ["gs"])
    heads = lines.where(F.col("value").rlike("^(POINTS|CELLS|CELL_TYPES|CELL_DATA) "))
    return heads.select(F.split("value", " ")[0].alias("word"), F.split("value", " ")[1].cast("long").alias("n"))


@query("published_results", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def published_results(spark, d):
    """A table published whole and read back from where it was renamed to."""
    counted = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    done = artifacts.publish(spark, {"t": counted}, new_folder(spark, "results"), "job-0123456789abcdef", {"quality": "CONVERGED"})
    return spark.read.parquet(f"{done}/t")


@query("resumed_generations", "SELECT event_id FROM events WHERE user_id % 4 IN (0, 1)")
def resumed_generations(spark, d):
    """Checkpoints are read up to the first that is not there; those of another signature are left out."""
    root = new_folder(spark, "generations")
    events = table(spark, d, "events").select("event_id", "user_id")
    for index, signature in ((0, "own"), (1, "own"), (2, "other"), (4, "own")):
        artifacts.save_generation(events.where(F.col("user_id") % 4 == index % 4), root, signature, index)
    return artifacts.load_generations(spark, root, "own", 9).select("event_id")


# ------------------------------------------------------------------ imported copper
@query("imported_boards_resistance", """
    SELECT 'n' || n_nationkey AS study, CAST(round(1e9 * CASE WHEN n_nationkey % 2 = 0 THEN (10 + n_nationkey) * 1e-3 / (5.8e7 / (1 + 0.0039 * 20) * (1 + n_nationkey % 3) * 1e-3 * CASE WHEN n_nationkey % 4 = 0 THEN 70e-6 ELSE 35e-6 END)
        ELSE 2 * 1e-3 / (5.8e7 / (1 + 0.0039 * 20) * pi() * (1.75e-4 * 1.75e-4 - 1.5e-4 * 1.5e-4)) END) AS BIGINT) AS nano_ohm FROM nation""")
def imported_boards_resistance(spark, d):
    """A board a nation, all solved at once: even ones are traces with a hole beside them, odd ones a barrel through three planes that their pads cover; warmer by 20 K."""
    from ohmgrid.plans import imported

    n = F.col("n_nationkey")
    trace, length, width = n % 2 == 0, (10 + n) * 1e-3, (1 + n % 3) * 1e-3
    study = F.concat(F.lit("n"), n).alias("study")
    box = lambda x0, y0, x1, y1: F.array(R.point(x0, y0), R.point(x1, y0), R.point(x1, y1), R.point(x0, y1))
    zero, side, pad = F.lit(0.0), F.lit(4e-3), F.lit(1e-3)
    nations = table(spark, d, "nation")
    layers = nations.select(study, F.explode(F.sequence(F.lit(0), F.lit(2))).alias("layer")).withColumns({
        "z_mid": F.col("layer") * 1e-3, "thickness": F.lit(35e-6), "conductivity": F.lit(5.8e7), "tcr": F.lit(0.0039), "reference_k": F.lit(293.15),
    })
    # A hole where the pad shorts the copper anyway leaves the resistance as it is.
    strip = F.array(box(-pad, zero, length + pad, width), box(-pad * 0.75, width * 0.25, -pad * 0.25, width * 0.75))
    own = F.when(n % 4 == 0, F.lit(70e-6))
    copper = F.when(trace, F.array(F.struct(F.lit(0).alias("layer"), strip.alias("rings")))).otherwise(F.array(*[F.struct(F.lit(k).alias("layer"), F.array(box(zero, zero, side, side)).alias("rings")) for k in range(3)]))
    regions = nations.select(study, own.alias("thickness"), F.posexplode(copper).alias("k", "c")).select("study", F.concat(F.lit("r"), F.col("k")).alias("region_id"), "c.layer", "c.rings", "thickness")
    vias = nations.where(~trace).select(
        study, F.lit("v").alias("via_id"), (side / 2).alias("x"), (side / 2).alias("y"), F.lit(0).alias("low"), F.lit(2).alias("high"), F.lit(3e-4).alias("finished"), F.lit(None).cast("double").alias("drill"), F.lit(None).cast("double").alias("plating")
    )
    end = lambda contact, layer, rings: F.struct(F.lit(contact).alias("contact"), F.lit(layer).alias("layer"), rings.alias("rings"))
    ends = F.when(trace, F.array(end("source", 0, F.array(box(-pad, zero, zero, width))), end("load", 0, F.array(box(length, zero, length + pad, width))))).otherwise(
        F.array(*[end(c, k, F.array(box(zero, zero, side, side))) for c, k in (("source", 0), ("load", 2))])
    )
    pads = nations.select(study, F.explode(ends).alias("p")).select("study", "p.*")
    problem = imported.build(imported.Board(layers, regions, vias, pads), 1e-3, temperature_k=313.15, plating=25e-6)
    probes = nations.select(study, F.lit("source").alias("near"), F.lit("load").alias("far"))
    return imported.resistance(problem, probes).select("study", F.round(F.col("resistance_ohm") * 1e9).cast("long").alias("nano_ohm"))


@query("lifted_fields", f"WITH {TRI} SELECT study, count(*) * 6 AS n, CAST(sum(3 * k + 3 * k + 1 + 3 * k + 2 + 3 * k + 0.5 + 3 * k + 1.5 + 3 * k + 1) AS DOUBLE) AS total FROM t GROUP BY 1")
def lifted_fields(spark, d):
    """Corners with their number as value; a middle has the mean of two."""
    tri = corners(spark, d)
    ends = F.explode(F.array(*[F.struct(F.col(f"n{k}").alias("node"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(3)])).alias("p")
    nodes = tri.select("study", "layer", ends).select("study", "layer", "p.*")
    _, wide = fem.quadratic_nodes(tri.drop("x0", "y0", "x1", "y1", "x2", "y2"), nodes)
    out = fem.lifted(wide, nodes.select("study", "node", F.col("node").cast("double").alias("value")))
    return out.groupBy("study").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("goal_weighted_indicators", "SELECT l_linenumber AS study, l_partkey AS tri, l_quantity * l_quantity AS eta FROM lineitem")
def goal_weighted_indicators(spark, d):
    return fem.goal_weighted(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("study"), F.col("l_partkey").alias("tri"), F.col("l_quantity").alias("eta")))


@query("repaired_rings", """
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 1 THEN 1 ELSE 0 END AS invalid, CASE WHEN p_partkey % 2 = 1 THEN 2 ELSE 1 END AS parts,
           CAST(CASE WHEN p_partkey % 2 = 1 THEN 2 ELSE 4 END * p_size * p_size AS BIGINT) AS area_mm2 FROM part""")
def repaired_rings(spark, d):
    """Squares, and bow ties that cross themselves in the middle: two triangles."""
    s = F.col("p_size") * 1e-3
    zero = F.lit(0.0)
    tie = F.array(R.point(zero, zero), R.point(2 * s, 2 * s), R.point(2 * s, zero), R.point(zero, 2 * s))
    square = F.array(R.point(zero, zero), R.point(2 * s, zero), R.point(2 * s, 2 * s), R.point(zero, 2 * s))
    regions = table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("region_id"), F.lit("L").alias("layer_id"), F.col("p_partkey").cast("string").alias("net_id"), F.array(F.when(F.col("p_partkey") % 2 == 1, tie).otherwise(square)).alias("rings")
    )
    merged = union.union_regions(regions).groupBy(F.col("net_id").alias("region_id")).agg(F.count(F.lit(1)).cast("int").alias("parts"), F.round(F.sum("area") * 1e6).cast("long").alias("area_mm2"))
    found = union.invalid_rings(regions).join(merged, "region_id")
    return found.select(F.col("region_id").cast("long").alias("p_partkey"), F.col("invalid").cast("int").alias("invalid"), "parts", "area_mm2")
