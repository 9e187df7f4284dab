"""Sizing, structured meshes of rectangles, mesh quality and comparison of runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ohmgrid.operators.ordered import relative_change

# Fixed values: (divisions of the board's diagonal, elements across a feature, growth, verified by a second mesh).
PROFILES = {
    "preview": (180.0, 8, 0.5, False),
    "standard": (300.0, 10, 0.5, False),
    "high": (500.0, 14, 0.45, False),
    "verification": (800.0, 18, 0.4, True),
    "reference": (180.0, 8, 0.5, False),
}
MIN_SIZE_FRACTION = 0.01
# Memory of an unknown, and unknowns up to which a run is of a class.
BYTES_PER_DOF = 5_000
COMPUTE_CLASSES = ((25_000, "interactive"), (120_000, "standard"), (300_000, "heavy"))


def profiles(spark: SparkSession, diagonal: float) -> DataFrame:
    """Absolute sizing of every accuracy profile for a board of this diagonal, in metres."""
    rows = [(name, diagonal / div, diagonal / div * MIN_SIZE_FRACTION, across, growth, verify) for name, (div, across, growth, verify) in PROFILES.items()]
    return spark.createDataFrame(rows, "profile string, max_element double, min_element double, across int, growth double, verify boolean")


def refine_sizes(sizing: DataFrame, factor: float = math.sqrt(2)) -> DataFrame:
    return sizing.withColumns({c: F.col(c) / factor for c in ("max_element", "min_element")})


def default_sizing(box: Column) -> Column:
    """struct for a study without settings: an eightieth of the diagonal, four elements across, growth 0.7."""
    diagonal = F.hypot(box["max_x"] - box["min_x"], box["max_y"] - box["min_y"])
    return F.struct((diagonal / 80).alias("max_element"), (diagonal / 80 * MIN_SIZE_FRACTION).alias("min_element"), F.lit(4).alias("across"), F.lit(0.7).alias("growth"))


def size_field(asked: DataFrame, seeds: DataFrame, key: str, seed: str, same: list[str], growth: float, largest: float, k: int = 8) -> DataFrame:
    """(key, size): the least of size + growth x distance over the k nearest seeds of the layer, at most ``largest``."""
    from ohmgrid.operators.spatial import nearest_k

    found = nearest_k(asked, seeds, key, seed, same, k).join(seeds.select(seed, "size"), seed)
    return found.groupBy(key).agg(F.min(F.least(F.col("size") + growth * F.col("distance"), F.lit(largest))).alias("size"))


def compare_runs(base: DataFrame, refined: DataFrame, target: float) -> DataFrame:
    """(quantity, base, refined, change, within) of two runs' (quantity, value)."""
    met = base.select("quantity", F.col("value").alias("base")).join(refined.select("quantity", F.col("value").alias("refined")), "quantity")
    change = relative_change(F.col("base"), F.col("refined"))
    return met.withColumn("change", change).withColumn("within", F.coalesce(F.col("change") <= target, F.lit(False)))


def estimate(points: Column) -> Column:
    """struct(dofs, memory_bytes, compute_class) from a count of mesh points."""
    out = F.lit("extreme")
    for most, name in reversed(COMPUTE_CLASSES):
        out = F.when(points <= most, name).otherwise(out)
    return F.struct(points.alias("dofs"), (points * BYTES_PER_DOF).alias("memory_bytes"), out.alias("compute_class"))


def lattice_count(area: Column, size: Column) -> Column:
    """Points of a triangular lattice of this spacing over an area."""
    return F.ceil(area / (size * size * (math.sqrt(3) / 2)))


def cuts(lines: DataFrame, group: list[str], size: float) -> DataFrame:
    """(group, k, at): grid lines through all ``lines`` (at) and evenly between them, no wider than ``size``."""
    along = W.partitionBy(*group).orderBy("at")
    gaps = lines.select(*group, "at").distinct().withColumn("next", F.lead("at").over(along))
    n = F.greatest(F.ceil((F.col("next") - F.col("at")) / size - 1e-9), F.lit(1))
    steps = gaps.select(*group, "at", "next", F.explode(F.when(F.col("next").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), n - 1))).alias("i"), n.alias("n"))
    at = F.when(F.col("next").isNull(), F.col("at")).otherwise(F.col("at") + (F.col("next") - F.col("at")) * F.col("i") / F.col("n"))
    return steps.select(*group, at.alias("at")).withColumn("k", F.row_number().over(along) - 1)


def grid_mesh(rects: DataFrame, size: float, lines: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, triangles) of unions of rectangles (study, layer, x0, y0, x1, y1), conforming across layers of a study.

    Grid lines run through every rectangle's edges, and through ``lines`` (study,
    axis, at) where given.  Cells inside any rectangle become two triangles.
    Nodes are (study, layer, node, x, y), triangles (study, layer, tri, n0, n1, n2).
    """
    edges = rects.select("study", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(c).alias("at")) for a, c in (("x", "x0"), ("x", "x1"), ("y", "y0"), ("y", "y1"))])).alias("e"))
    all_lines = edges.select("study", "e.axis", "e.at")
    if lines is not None:
        all_lines = all_lines.unionByName(lines.select("study", "axis", "at"))
    grid = cuts(all_lines, ["study", "axis"], size)

    # Each rectangle meets the grid steps it covers: an interval join inside a study.
    x, y = steps(grid, "x"), steps(grid, "y")
    wide = rects.join(x, "study").where((F.col("xa") >= F.col("x0") - 1e-12) & (F.col("xb") <= F.col("x1") + 1e-12))
    cells = wide.join(y, "study").where((F.col("ya") >= F.col("y0") - 1e-12) & (F.col("yb") <= F.col("y1") + 1e-12))
    return cell_mesh(cells.groupBy(*CELL).agg(F.count(F.lit(1)).alias("covers")))


def steps(grid: DataFrame, axis: str) -> DataFrame:
    """(study, <axis>k, <axis>a, <axis>b, n<axis>): the steps between neighbouring grid lines of an axis."""
    own = grid.where(F.col("axis") == axis)
    along = W.partitionBy("study").orderBy("k")
    named = own.select("study", F.col("k").alias(f"{axis}k"), F.col("at").alias(f"{axis}a"), F.lead("at").over(along).alias(f"{axis}b"), F.count(F.lit(1)).over(W.partitionBy("study")).alias(f"n{axis}"))
    return named.where(F.col(f"{axis}b").isNotNull())


CELL = ("study", "layer", "xk", "yk", "xa", "xb", "ya", "yb", "nx", "ny")


def ring_cells(edges: DataFrame, grid: DataFrame, bucket: float) -> DataFrame:
    """``CELL`` and region_id of the grid cells whose middle lies in a region, by the even-odd rule.

    ``edges`` has (study, layer, region_id, x1, y1, x2, y2).  Every row of cells is
    scanned once: the edges that cross its middle are sorted and pair up into
    intervals of columns.  Both joins are by buckets of this width.
    """
    bucketed = lambda v: F.floor(v / bucket).cast("long")
    y = steps(grid, "y").withColumn("yc", (F.col("ya") + F.col("yb")) / 2).withColumn("b", bucketed(F.col("yc")))
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    spread = edges.where(low < high).withColumn("b", F.explode(F.sequence(bucketed(low), bucketed(high))))
    met = spread.join(y, ["study", "b"]).where((low <= F.col("yc")) & (F.col("yc") < high))
    at = F.col("x1") + (F.col("yc") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    scans = met.groupBy("study", "layer", "region_id", "yk", "ya", "yb", "ny").agg(F.array_sort(F.collect_list(at)).alias("xs"))
    pairs = F.transform(F.sequence(F.lit(0), F.size("xs") - 2, F.lit(2)), lambda i: F.struct(F.get("xs", i).alias("lo"), F.get("xs", i + 1).alias("hi")))
    inside = scans.select("study", "layer", "region_id", "yk", "ya", "yb", "ny", F.explode(pairs).alias("p")).select("*", "p.lo", "p.hi").drop("p")
    x = steps(grid, "x").withColumn("xc", (F.col("xa") + F.col("xb")) / 2).withColumn("b", bucketed(F.col("xc")))
    opened = inside.withColumn("b", F.explode(F.sequence(bucketed(F.col("lo")), bucketed(F.col("hi")))))
    return opened.join(x, ["study", "b"]).where((F.col("lo") <= F.col("xc")) & (F.col("xc") < F.col("hi"))).select(*CELL, "region_id")


def cell_mesh(cells: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes, triangles) of grid cells (``CELL``), two triangles each, which ``keep`` columns of their cell."""
    per_layer = F.col("nx") * F.col("ny")

    def node(i, j):
        return F.col("layer") * per_layer + (F.col("yk") + j) * F.col("nx") + F.col("xk") + i

    corners = cells.select("study", "layer", *keep, "xa", "xb", "ya", "yb", node(0, 0).alias("a"), node(1, 0).alias("b"), node(1, 1).alias("c"), node(0, 1).alias("d"))
    points = F.array(*[F.struct(F.col(n).alias("node"), F.col(px).alias("x"), F.col(py).alias("y")) for n, px, py in (("a", "xa", "ya"), ("b", "xb", "ya"), ("c", "xb", "yb"), ("d", "xa", "yb"))])
    nodes = corners.select("study", "layer", F.explode(points).alias("p")).select("study", "layer", "p.*").distinct()
    # Diagonals alternate, so that the mesh has no preferred direction.
    flip = F.pmod(F.col("a"), F.lit(2)) == 0

    def half(*corner: str):
        return F.struct(*[F.col(c).alias(f"n{k}") for k, c in enumerate(corner)])

    halves = F.when(flip, F.array(half("a", "b", "c"), half("a", "c", "d"))).otherwise(F.array(half("a", "b", "d"), half("b", "c", "d")))
    triangles = corners.select("study", "layer", *keep, F.col("a"), F.posexplode(halves).alias("h", "t")).select("study", "layer", *keep, (F.col("a") * 2 + F.col("h")).alias("tri"), "t.n0", "t.n1", "t.n2")
    return nodes, triangles


def quality(triangles: DataFrame, group: list[str]) -> DataFrame:
    """Least and 5th percentile of the smallest angles in degrees, slivers below 10 degrees, and the area covered.

    ``triangles`` has (x0, y0, x1, y1, x2, y2).
    """

    def side(i, j):
        return F.hypot(F.col(f"x{i}") - F.col(f"x{j}"), F.col(f"y{i}") - F.col(f"y{j}"))

    a, b, c = side(1, 2), side(0, 2), side(0, 1)

    def angle(opposite, p, q):
        return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (p * p + q * q - opposite * opposite) / (2 * p * q)))))

    area = F.abs((F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / 2
    rated = triangles.withColumns({"__angle": F.least(angle(a, b, c), angle(b, a, c), angle(c, a, b)), "__area": area})
    return rated.groupBy(*group).agg(F.min("__angle").alias("min_angle"), F.percentile("__angle", F.lit(0.05)).alias("p05_angle"), F.count_if(F.col("__angle") < 10).alias("slivers"), F.sum("__area").alias("area"))


def hex_lattice(boxes: DataFrame, key: list[str], spacing: float) -> DataFrame:
    """(key, px, py): a triangular lattice of this spacing over each box (x0, y0, x1, y1), every other row shifted by half."""
    height = spacing * math.sqrt(3) / 2
    rows = boxes.withColumn("__j", F.explode(F.sequence(F.lit(0), F.floor((F.col("y1") - F.col("y0")) / height).cast("int"))))
    both = rows.withColumn("__i", F.explode(F.sequence(F.lit(0), F.floor((F.col("x1") - F.col("x0")) / spacing).cast("int"))))
    px = F.col("x0") + spacing * (F.col("__i") + F.when(F.col("__j") % 2 == 1, 0.5).otherwise(0.0))
    return both.select(*key, px.alias("px"), (F.col("y0") + height * F.col("__j")).alias("py"), F.col("x1").alias("__end")).where(F.col("px") <= F.col("__end")).drop("__end")


def merge_points(kept: DataFrame, generated: DataFrame, key: list[str], reach: float) -> DataFrame:
    """``kept`` (key, px, py) and those of ``generated`` that no kept point is nearer to than ``reach``: a bucketed anti-join."""
    from ohmgrid.operators.spatial import cell

    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = kept.select(*key, F.col("px").alias("kx"), F.col("py").alias("ky"), F.explode(around).alias("d"))
    near = near.select(*key, "kx", "ky", (cell(F.col("kx"), reach) + F.col("d.i")).alias("cx"), (cell(F.col("ky"), reach) + F.col("d.j")).alias("cy"))
    own = generated.withColumns({"cx": cell(F.col("px"), reach), "cy": cell(F.col("py"), reach)})
    free = own.alias("g").join(
        near.alias("n"), [F.col(f"g.{c}").eqNullSafe(F.col(f"n.{c}")) for c in [*key, "cx", "cy"]] + [F.hypot(F.col("px") - F.col("kx"), F.col("py") - F.col("ky")) < reach], "left_anti"
    )
    return kept.select(*key, "px", "py").unionByName(free.select(*[f"g.{c}" for c in key], "px", "py"))


def ring_walk(rings: DataFrame, ring: list[str], order: str, corner_deg: float = 15.0) -> DataFrame:
    """(ring, order, x, y, position, corner): arc length up to each vertex, and whether the ring turns there by the angle or more."""
    n = F.count(F.lit(1)).over(W.partitionBy(*ring))
    along = W.partitionBy(*ring).orderBy(order)
    whole = along.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first = lambda c: F.first(c).over(whole)
    last = lambda c: F.last(c).over(whole)
    ends = rings.withColumns({
        "__bx": F.coalesce(F.lag("x").over(along), last("x")), "__by": F.coalesce(F.lag("y").over(along), last("y")),
        "__ax": F.coalesce(F.lead("x").over(along), first("x")), "__ay": F.coalesce(F.lead("y").over(along), first("y")), "__first": F.row_number().over(along) == 1, "__n": n,
    })
    step = F.when(F.col("__first"), 0.0).otherwise(F.hypot(F.col("x") - F.col("__bx"), F.col("y") - F.col("__by")))
    turn = F.atan2(F.col("__ay") - F.col("y"), F.col("__ax") - F.col("x")) - F.atan2(F.col("y") - F.col("__by"), F.col("x") - F.col("__bx"))
    folded = F.abs(F.pmod(turn + math.pi, F.lit(2 * math.pi)) - math.pi)
    walked = ends.withColumns({"__step": step, "corner": folded >= math.radians(corner_deg) - 1e-12})
    return walked.select(*ring, order, "x", "y", F.sum("__step").over(along.rowsBetween(W.unboundedPreceding, 0)).alias("position"), "corner")
