"""Polygon overlay in tiles, and the join of polygons that meet.

Coordinates are whole nanometres and tile lines lie half a nanometre beside them, so
no corner is ever on a line.  Edges are cut at tile lines by column expressions.  What
a tile lacks beside its pieces is which polygons are inside on its lower and upper side:
at its left corners by the parity of the edges that cross its left line below, and
further along by the crossings of the side itself.  So a polygon as large as the
board is as many small pieces as it has tiles, a tile is united by itself, and parts are
sewn together where they share a stretch of a tile line.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmgrid.functions.storage import durable, small_side
from ohmgrid.operators import graph, grouped, ranges, spatial, union

#: Nanometres of a metre; polygons that a tile of the mean density holds.
NM, PER_TILE = 1e9, 64

TILE_PART = (
    "layer_id string, net_id string, col long, row long, area double, min_x double, min_y double, max_x double, max_y double, members array<string>, "
    "trapezoids array<array<double>>, lefts array<array<double>>, rights array<array<double>>, bottoms array<array<double>>, tops array<array<double>>"
)


def region_edges(regions: DataFrame, keys: list[str], rings: str = "rings") -> DataFrame:
    """(keys, xa, ya, xb, yb: long) of the edges of every ring, from left to right (upright ones upwards), in nanometres; edges without extent are left out."""
    ring = regions.select(*keys, F.explode(rings).alias("ring")).where(F.size("ring") >= 3)
    n = F.size("ring")
    corner = lambda p: F.struct(F.round(p["x"] * NM).cast("long").alias("x"), F.round(p["y"] * NM).cast("long").alias("y"))
    each = ring.select(*keys, "ring", F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    ends = each.select(*keys, corner(F.get("ring", F.col("i"))).alias("p"), corner(F.get("ring", (F.col("i") + 1) % n)).alias("q")).where("p != q")
    a, b = F.least("p", "q"), F.greatest("p", "q")
    return ends.select(*keys, a["x"].alias("xa"), a["y"].alias("ya"), b["x"].alias("xb"), b["y"].alias("yb"))


def tile_of(v: Column, size: Column) -> Column:
    """The tile of a coordinate; lines are at whole multiples of ``size`` and half a nanometre."""
    return F.floor((v.cast("double") - 0.5) / size).cast("long")


def cut_edges(edges: DataFrame, keys: list[str], size: Column) -> DataFrame:
    """Pieces of edges by tile: (keys, the edge, col, row, x0, y0, x1, y1, low, high, entry).

    ``low`` and ``high`` are where the piece crosses the lower and the upper side of its
    tile, or null; ``entry`` is the row at which the edge enters the column through its left line, on the piece of that row.  Neighbouring tiles get
    the same numbers for what they share.
    """
    own = [*keys, "xa", "ya", "xb", "yb", "size"]
    dx, dy = (F.col("xb") - F.col("xa")).cast("double"), (F.col("yb") - F.col("ya")).cast("double")
    first, last = tile_of(F.col("xa"), F.col("size")), tile_of(F.col("xb"), F.col("size"))
    cols = edges.withColumn("size", size.cast("double")).select(*own, first.alias("first"), last.alias("last"), F.explode(F.sequence(first, last)).alias("col"))
    line = lambda k: k * F.col("size") + 0.5
    y_at = lambda x: F.col("ya") + dy * (x - F.col("xa")) / dx
    enters, leaves = F.col("col") > F.col("first"), F.col("col") < F.col("last")
    x0, x1 = F.when(enters, line(F.col("col"))).otherwise(F.col("xa").cast("double")), F.when(leaves, line(F.col("col") + 1)).otherwise(F.col("xb").cast("double"))
    y0, y1 = F.when(enters, y_at(line(F.col("col")))).otherwise(F.col("ya").cast("double")), F.when(leaves, y_at(line(F.col("col") + 1))).otherwise(F.col("yb").cast("double"))
    strips = cols.select(*own, "col", enters.alias("enters"), x0.alias("sx"), y0.alias("sy"), x1.alias("ex"), y1.alias("ey"))
    strips = strips.withColumns({"start": tile_of(F.col("sy"), F.col("size")), "stop": tile_of(F.col("ey"), F.col("size"))})
    low_row, high_row = F.least("start", "stop"), F.greatest("start", "stop")
    rows = strips.select("*", F.explode(F.sequence(low_row, high_row)).alias("row"))
    x_at = lambda y: F.greatest(F.col("sx"), F.least(F.col("ex"), F.col("sx") + (F.col("ex") - F.col("sx")) * (y - F.col("sy")) / (F.col("ey") - F.col("sy"))))
    low = F.when(F.col("row") > F.least("start", "stop"), x_at(line(F.col("row"))))
    high = F.when(F.col("row") < F.greatest("start", "stop"), x_at(line(F.col("row") + 1)))
    cut = rows.select(*own, "col", "row", "sx", "sy", "ex", "ey", "start", "stop", low.alias("low"), high.alias("high"), F.when(F.col("enters") & (F.col("row") == F.col("start")), F.col("row")).alias("entry"))
    up = F.col("stop") >= F.col("start")
    at_start, at_end = F.col("row") == F.col("start"), F.col("row") == F.col("stop")
    below, above = line(F.col("row")), line(F.col("row") + 1)
    return cut.select(
        *own, "col", "row",
        F.when(at_start, F.col("sx")).when(up, F.col("low")).otherwise(F.col("high")).alias("x0"), F.when(at_start, F.col("sy")).when(up, below).otherwise(above).alias("y0"),
        F.when(at_end, F.col("ex")).when(up, F.col("high")).otherwise(F.col("low")).alias("x1"), F.when(at_end, F.col("ey")).when(up, above).otherwise(below).alias("y1"), "low", "high", "entry",
    )


def covered_corners(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, col, row) of the tiles whose lower left corner is inside, by the rows in which the left line is crossed an odd number of times."""
    crossed = pieces.where("entry is not null").groupBy(*keys, "col", F.col("entry").alias("row")).agg((F.count(F.lit(1)) % 2).alias("odd")).where("odd = 1")
    rows = crossed.groupBy(*keys, "col").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    pair = F.sequence(F.lit(0), F.floor(F.size("rows") / 2).cast("int") - 1)
    spans = F.flatten(F.transform(pair, lambda k: F.sequence(F.get("rows", 2 * k) + 1, F.get("rows", 2 * k + 1))))
    inside = F.get("rows", F.lit(0)) < F.get("rows", F.lit(1))
    return rows.where(inside).select(*keys, "col", F.explode(spans).alias("row"))


def _sides(state: bool, at: list[float], x0: float, x1: float) -> list[tuple[float, float]]:
    """Stretches of a side that are inside: the state at its left end changes at every crossing."""
    bounds = [x0, *sorted(at), x1]
    return [(a, b) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if (k % 2 == 1) != state and b > a]


def tile_parts(rows: list[tuple], x0: float, y0: float, size: float) -> tuple[list[str], list[tuple[float, list[int], list[list[float]]]]]:
    """The polygons of a tile's ``rows`` (polygon, x0, y0, x1, y1, low, high, lower, upper; by polygon), and (area, polygons, trapezoids) of the connected parts of their union, in metres."""
    names: list[str] = []
    edges: list[tuple[float, float, float, float, int]] = []
    for name, own in itertools.groupby(rows, key=lambda r: r[0]):
        k, own = len(names), list(own)
        names.append(name)
        for column, flag, y in ((5, 7, y0), (6, 8, y0 + size)):
            at = [r[column] for r in own if r[column] is not None]
            edges += [(a / NM, y / NM, b / NM, y / NM, k) for a, b in _sides(any(r[flag] for r in own), at, x0, x0 + size)]
        edges += [(r[1] / NM, r[2] / NM, r[3] / NM, r[4] / NM, k) for r in own if r[1] is not None and r[3] > r[1]]
    if not edges:
        return names, []
    return names, union.connected(union.few_trapezoids(edges) if len(edges) <= union.FEW else union.trapezoids(np.array(edges, float)))


def tiled_union(regions: DataFrame, per_tile: int = PER_TILE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parts, members and cells of the union of each (layer_id, net_id), a null net being a net of its own.

    ``regions`` has (region_id, layer_id, net_id, rings), the first ring being the outline, by the even-odd rule.
    Parts: (part, layer_id, net_id, region_id, area, min_x, min_y, max_x, max_y, n_sources, n_tiles), parts under
    the smallest area left out, numbered in their order from left to right.  Members: (part, source_id), every region in a part.
    Cells: (part, trapezoid).  Tiles are sized so that one holds about ``per_tile`` polygons of its group; equal outlines are united once.  Regions without
    rings or of rings of less than three corners are in no part.  An empty table gives empty tables.
    """
    group = ["layer_id", "net_id"]
    outline = F.xxhash64(F.to_json("rings"))
    named = regions.select(F.col("region_id").cast("string").alias("region_id"), F.col("layer_id").cast("string").alias("layer_id"), F.col("net_id").cast("string").alias("net_id"), "rings", outline.alias("outline"))
    named = durable(named.where(F.size("rings") > 0))
    same = [*group, "outline", "rings"]
    shapes = durable(named.groupBy(*same).agg(F.min("region_id").alias("polygon")))
    copies = named.join(shapes.select(*[F.col(c).alias(f"s_{c}") for c in same[:3]], F.col("polygon")), F.col("layer_id").eqNullSafe(F.col("s_layer_id")) & F.col("net_id").eqNullSafe(F.col("s_net_id")) & (F.col("outline") == F.col("s_outline")))
    box = shapes.select(*group, "polygon", "rings", spatial.bounding_box(F.flatten("rings")).alias("b"))
    extent = (F.col("b.max_x") - F.col("b.min_x")) * (F.col("b.max_y") - F.col("b.min_y"))
    side = F.greatest(F.lit(16.0), F.ceil(F.sqrt(F.sum(extent) / F.count(F.lit(1)) * per_tile) * NM).cast("double"))
    sizes = small_side(durable(box.groupBy(*group).agg(side.alias("side")).select(F.col("layer_id").alias("g_layer"), F.col("net_id").alias("g_net"), "side")))
    edges = region_edges(shapes, [*group, "polygon"]).join(sizes, F.col("layer_id").eqNullSafe(F.col("g_layer")) & F.col("net_id").eqNullSafe(F.col("g_net")))
    pieces = durable(cut_edges(edges, [*group, "polygon"], F.col("side")))
    corners = covered_corners(pieces, [*group, "polygon", "size"])
    none = {c: F.lit(None).cast("double") for c in ("x0", "y0", "x1", "y1", "low", "high")}
    flags = corners.withColumns({**none, "lower": F.lit(True), "upper": F.lit(False)}).unionByName(corners.withColumns({**none, "row": F.col("row") - 1, "lower": F.lit(False), "upper": F.lit(True)}))
    columns = [*group, "col", "row", "size", "polygon", *none, "lower", "upper"]
    content = pieces.withColumns({"lower": F.lit(False), "upper": F.lit(False)}).select(*columns).unionByName(flags.select(*columns))

    def run(key: tuple, rows: list[tuple]) -> list[tuple]:
        layer, net, col, row, size = key
        x0, y0 = col * size + 0.5, row * size + 0.5
        left, right, low, high = x0 / NM, (x0 + size) / NM, y0 / NM, (y0 + size) / NM
        near = lambda v, at: abs(v - at) < union.SNAP / 8
        names, parts = tile_parts(rows, x0, y0, size)
        out = []
        for area, members, cells in parts:
            box = (min(c[0] for c in cells), min(min(c[2:4]) for c in cells), max(c[1] for c in cells), max(max(c[4:6]) for c in cells))
            lefts, rights = [[c[2], c[4]] for c in cells if near(c[0], left)], [[c[3], c[5]] for c in cells if near(c[1], right)]
            bottoms, tops = [[c[0], c[1]] for c in cells if near(c[2], low) and near(c[3], low)], [[c[0], c[1]] for c in cells if near(c[4], high) and near(c[5], high)]
            out.append((layer, net, col, row, area, *box, [names[k] for k in members], cells, lefts, rights, bottoms, tops))
        return out

    local = grouped.map_groups(content, [*group, "col", "row", "size"], ["polygon"], run, TILE_PART)
    local = durable(local.withColumn("node", F.monotonically_increasing_id()))
    seams = durable(_seams(local, "rights", "lefts", 1, 0).unionAll(_seams(local, "tops", "bottoms", 0, 1)))
    home = local.join(graph.connected_components(seams), "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    home = durable(home)
    # Copies belong to the parts of the outline that was united for them.
    members = home.select("part", F.explode("members").alias("polygon"), *[F.col(g).alias(f"m_{g}") for g in group]).distinct()
    met = (F.col("m_layer_id").eqNullSafe(F.col("layer_id"))) & (F.col("m_net_id").eqNullSafe(F.col("net_id"))) & (members["polygon"] == copies["polygon"])
    members = members.join(copies.select(*group, "polygon", "region_id"), met).select("part", F.col("region_id").alias("source_id"))
    wide = home.groupBy("part").agg(F.first("layer_id").alias("layer_id"), F.first("net_id").alias("net_id"), F.sum("area").alias("area"), *[f(c).alias(c) for f, c in ((F.min, "min_x"), (F.min, "min_y"), (F.max, "max_x"), (F.max, "max_y"))], F.count(F.lit(1)).alias("n_tiles"))
    kept = wide.where(F.col("area") >= union.SMALLEST).join(members.groupBy("part").agg(F.count(F.lit(1)).alias("n_sources")), "part")
    numbered = ranges.numbered(kept, group, [F.col(c).asc() for c in ("min_x", "min_y", "area", "part")], "number")
    parts = numbered.select("part", *group, F.format_string("n-%s-%s-%03d", "layer_id", F.coalesce("net_id", F.lit("none")), "number").alias("region_id"), "area", "min_x", "min_y", "max_x", "max_y", "n_sources", "n_tiles")
    ids = parts.select("part")
    return parts, members.join(ids, "part", "left_semi"), home.select("part", F.explode("trapezoids").alias("trapezoid")).join(ids, "part", "left_semi")


def _seams(local: DataFrame, near: str, far: str, d_col: int, d_row: int) -> DataFrame:
    """(u, v) of parts in neighbouring tiles that share a stretch of the line between them."""
    keys = ["layer_id", "net_id", "col", "row"]
    a = local.select(*keys, F.col("node").alias("u"), F.explode(near).alias("a")).withColumns({"col": F.col("col") + d_col, "row": F.col("row") + d_row})
    b = local.select(*[F.col(k).alias(f"o_{k}") for k in keys], F.col("node").alias("v"), F.explode(far).alias("b"))
    met = (F.col("col") == F.col("o_col")) & (F.col("row") == F.col("o_row"))
    for k in ("layer_id", "net_id"):
        met &= F.col(k).eqNullSafe(F.col(f"o_{k}"))
    shared = F.least(F.col("a")[1], F.col("b")[1]) - F.greatest(F.col("a")[0], F.col("b")[0])
    return a.join(b, met & (shared > union.SNAP / 4)).select("u", "v")


def _turn(px: str, py: str, qx: str, qy: str, rx: str, ry: str) -> Column:
    """Sign of the turn p, q, r; exact for coordinates up to a metre from the origin."""
    c = F.col
    return F.signum(((c(qx) - c(px)) * (c(ry) - c(py)) - (c(qy) - c(py)) * (c(rx) - c(px))).cast("double"))


def _segments_meet() -> Column:
    """Whether the segments a and b have a point in common, ends included."""
    a1, a2 = _turn("a_xa", "a_ya", "a_xb", "a_yb", "b_xa", "b_ya"), _turn("a_xa", "a_ya", "a_xb", "a_yb", "b_xb", "b_yb")
    b1, b2 = _turn("b_xa", "b_ya", "b_xb", "b_yb", "a_xa", "a_ya"), _turn("b_xa", "b_ya", "b_xb", "b_yb", "a_xb", "a_yb")
    c = F.col
    boxes = (c("a_xa") <= c("b_xb")) & (c("b_xa") <= c("a_xb")) & (F.least("a_ya", "a_yb") <= F.greatest("b_ya", "b_yb")) & (F.least("b_ya", "b_yb") <= F.greatest("a_ya", "a_yb"))
    return boxes & (a1 * a2 <= 0) & (b1 * b2 <= 0)


def polygons_that_meet(left: DataFrame, right: DataFrame, left_key: str, right_key: str, same: list[str]) -> DataFrame:
    """(left_key, right_key), each pair once: polygons of equal ``same`` that share a point, touching included.

    Both sides have their key (string), ``same`` and rings.  Edges are cut at the lines of a grid as wide as
    the mean edge is long and meet in its cells; what meets no edge of the other is tried for containment by one
    corner.  A null in ``same`` meets nothing.
    """
    e = region_edges(left, [*same, left_key]), region_edges(right, [*same, right_key])
    long = F.avg(F.greatest(F.col("xb") - F.col("xa"), F.abs(F.col("yb") - F.col("ya"))))
    size = max([1.0, *(r["s"] for df in e if (r := df.agg(long.alias("s")).first())["s"] is not None)])
    cells = []
    for df, key, side in ((e[0], left_key, "a"), (e[1], right_key, "b")):
        cut = cut_edges(df, [*same, key], F.lit(float(round(size) + 1)))
        cells.append(cut.select(*same, "col", "row", F.col(key).alias(f"{side}_key"), *[F.col(c).alias(f"{side}_{c}") for c in ("xa", "ya", "xb", "yb")]))
    crossing = cells[0].join(cells[1], [*same, "col", "row"]).where(_segments_meet()).select(F.col("a_key").alias(left_key), F.col("b_key").alias(right_key)).distinct()

    def corner(df: DataFrame, key: str) -> DataFrame:
        p = F.get(F.get("rings", F.lit(0)), F.lit(0))
        return df.where(F.size(F.get("rings", F.lit(0))) >= 3).select(key, *same, p["x"].alias("px"), p["y"].alias("py"))

    def edged(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, *same, spatial.ring_edges(F.filter("rings", lambda r: F.size(r) >= 3)).alias("edges"))

    inside = spatial.points_in_regions(corner(left, left_key), edged(right, right_key), left_key, right_key, same).select(left_key, right_key)
    around = spatial.points_in_regions(corner(right, right_key), edged(left, left_key), right_key, left_key, same).select(left_key, right_key)
    return crossing.unionByName(inside).unionByName(around).distinct()
