"""Spatial joins by grid cells; never a product of two large tables.

Boxes of every size are met by levels: a box lies on the level whose cells are as
wide as it is, so that it covers four of them at most, and a point looks into one
cell of each level in use.  Nearest neighbours are searched in cells that double
until the search is certain to be complete.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window as W

from ohmgrid.functions.storage import durable
from ohmgrid.operators.graph import connected_components


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def levels_of(boxes: DataFrame) -> list[int]:
    """The levels in use; widths are doubles, so there are few."""
    return sorted(r[0] for r in boxes.select("level").distinct().collect())


def with_cells(boxes: DataFrame, finer: int = 0) -> DataFrame:
    """``boxes`` (bx0, bx1, by0, by1) once for each cell of their level that they touch: level, cx, cy; cells may be some levels ``finer``."""
    width = F.greatest(F.col("bx1") - F.col("bx0"), F.col("by1") - F.col("by0"), F.lit(1e-12))
    levelled = boxes.withColumn("level", (F.ceil(F.log2(width)) - finer).cast("int"))
    size = F.pow(F.lit(2.0), F.col("level"))

    def span(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / size).cast("long"), F.floor(F.col(high) / size).cast("long")))

    return levelled.withColumn("cx", span("bx0", "bx1")).withColumn("cy", span("by0", "by1"))


def in_cells(points: DataFrame, levels: list[int], x: str, y: str) -> DataFrame:
    """``points`` once for each level: level, cx, cy of the cell that the point is in."""
    each = points.withColumn("level", F.explode(F.array(*[F.lit(k) for k in levels]) if levels else F.array().cast("array<int>")))
    size = F.pow(F.lit(2.0), F.col("level"))
    return each.withColumns({"cx": F.floor(F.col(x) / size).cast("long"), "cy": F.floor(F.col(y) / size).cast("long")})


def near_pairs(points: DataFrame, key: str, x: str, y: str, radius: float, group: list[str] | None = None, held: list[str] | None = None, keep: Column | None = None) -> DataFrame:
    """(a, b, distance), a < b, of points of a group within ``radius``: a bucket join on cells of that size.

    Each point is put into its own cell and looks for partners there and in four of the eight around, as the others look for it.
    Columns that are ``held`` come with both ends as name_1 and name_2, in either order, and ``keep``, a condition on
    them and on ``distance``, is tried where points meet, so that no pair is moved for it.  Both
    sides are exchanged, however small the table of the points is thought to be.
    """
    group, held = group or [], held or []
    own = points.select(*group, F.col(key).alias("v"), F.col(x).alias("vx"), F.col(y).alias("vy"), *[F.col(c).alias(f"{c}_2") for c in held], cell(F.col(x), radius).alias("cx"), cell(F.col(y), radius).alias("cy"))
    ahead = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    looks = points.select(*group, F.col(key).alias("u"), F.col(x).alias("ux"), F.col(y).alias("uy"), *[F.col(c).alias(f"{c}_1") for c in held], F.explode(ahead).alias("d"))
    looks = looks.withColumns({"cx": cell(F.col("ux"), radius) + F.col("d.i"), "cy": cell(F.col("uy"), radius) + F.col("d.j"), "here": (F.col("d.i") == 0) & (F.col("d.j") == 0)}).drop("d")
    once = F.when(F.col("here"), F.col("u") < F.col("v")).otherwise(F.col("u") != F.col("v"))
    met = looks.join(own.hint("merge"), [*group, "cx", "cy"]).where(once)
    near = met.withColumn("distance", F.hypot(F.col("ux") - F.col("vx"), F.col("uy") - F.col("vy"))).where(F.col("distance") <= radius)
    if keep is not None:
        near = near.where(keep)
    return near.select(*group, F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "distance", *[f"{c}_{k}" for c in held for k in (1, 2)])


def clusters(points: DataFrame, key: str, pairs: DataFrame) -> DataFrame:
    """(key, cluster): the smallest key of those that ``pairs`` (a, b) chain together; lone points are their own."""
    parts = connected_components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return points.select(key).join(parts.select(F.col("node").alias(key), "component"), key, "left").select(key, F.coalesce("component", key).alias("cluster"))


def chained(points: DataFrame, key: str, x: str, y: str, radius: float, group: list[str] | None = None) -> DataFrame:
    """(a, b) that chain exactly the points of a group within ``radius`` of each other, a point for many in one place."""
    place = [*(group or []), x, y]
    first = durable(points.groupBy(*place).agg(F.min(key).alias("a")))
    stars = points.join(first, [*place]).where(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"))
    return near_pairs(first.withColumnRenamed("a", key), key, x, y, radius, group).select("a", "b").unionAll(stars)


def overlap_pairs(vias: DataFrame, key: str, x: str, y: str, radius: str, low: str, high: str, most_radius: float, apart: float | None = None) -> DataFrame:
    """(a, b) of barrels that touch (distance below the sum of radii) and share a layer; cells are twice the largest radius.

    Those no more than ``apart`` from each other, where it is given, are left out.
    """
    size = 2 * most_radius
    wide = vias.select(F.col(key).alias("key"), F.col(x).alias("x"), F.col(y).alias("y"), F.col(radius).alias("r"), F.col(low).alias("lo"), F.col(high).alias("hi"))
    touch = (F.col("distance") < F.col("r_1") + F.col("r_2")) & (F.col("lo_1") <= F.col("hi_2")) & (F.col("lo_2") <= F.col("hi_1"))
    if apart is not None:
        touch &= F.col("distance") > apart
    return near_pairs(wide, "key", "x", "y", size, held=["r", "lo", "hi"], keep=touch).select("a", "b")


def consolidate_vias(vias: DataFrame, layers: DataFrame, tolerance: float = 1e-7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(consolidated, conflicts, overlaps) of ``vias`` (via_no: long, via_id, net_id, from_layer, to_layer, x, y, drill, radius).

    Vias at one place with the same net and the same span are one: ``merged:a+b``,
    mean position, first known drill.  Vias at one place that disagree are
    conflicts, and barrels that touch and share a layer are overlaps; neither is
    merged.  ``layers`` has (layer_id, idx).
    """
    # A board has tens of layers.
    at = layers.select("layer_id", "idx")
    spanned = vias.join(at.toDF("from_layer", "i"), "from_layer").join(at.toDF("to_layer", "j"), "to_layer")
    spanned = spanned.withColumns({"lo": F.least("i", "j"), "hi": F.greatest("i", "j")})
    # Vias that agree in one place stand behind the first of them, so that a place of many is not opened into pairs.
    place = ["x", "y", "net_id", "lo", "hi"]
    firsts = durable(spanned.groupBy(*place).agg(F.min("via_no").alias("first")))
    at_first = F.lit(True)
    for c in place:
        at_first &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    spanned = spanned.join(firsts.select("first", *[F.col(c).alias(f"of_{c}") for c in place]).hint("merge"), at_first).drop(*[f"of_{c}" for c in place])
    same = F.col("net_id_1").eqNullSafe(F.col("net_id_2")) & (F.col("lo_1") == F.col("lo_2")) & (F.col("hi_1") == F.col("hi_2"))
    close = lambda keep: near_pairs(firsts, "first", "x", "y", tolerance, held=["net_id", "lo", "hi"], keep=keep).select("a", "b")
    behind = lambda end, via: spanned.select(F.col("first").alias(end), F.col("via_no").alias(via)).hint("merge")
    opened = close(~same).join(behind("a", "u"), "a").join(behind("b", "v"), "b")
    conflicts = opened.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    roots = clusters(firsts.select("first"), "first", close(same))
    grouped = spanned.join(roots, "first").groupBy("cluster").agg(
        F.array_sort(F.collect_list(F.struct("via_no", "via_id"))).alias("members"),
        F.first("net_id").alias("net_id"), F.min_by("from_layer", "via_no").alias("from_layer"), F.min_by("to_layer", "via_no").alias("to_layer"),
        F.avg("x").alias("x"), F.avg("y").alias("y"),
        F.min(F.when(F.col("drill").isNotNull(), F.struct("via_no", "drill")))["drill"].alias("drill"),
    )
    ids = F.transform("members", lambda m: m["via_id"])
    consolidated = grouped.select(
        F.when(F.size(ids) == 1, ids[0]).otherwise(F.concat(F.lit("merged:"), F.array_join(ids, "+"))).alias("via_id"),
        ids.alias("via_ids"), "net_id", "from_layer", "to_layer", "x", "y", "drill",
    )
    sized = spanned.where(F.col("radius").isNotNull())
    most = sized.agg(F.max("radius")).first()[0]
    if not most:
        return consolidated, conflicts, conflicts.limit(0)
    return consolidated, conflicts, overlap_pairs(sized, "via_no", "x", "y", "radius", "lo", "hi", float(most), apart=tolerance)


def edges_of(rings: DataFrame, ring: list[str], order: str, x: str, y: str) -> DataFrame:
    """(ring, x1, y1, x2, y2) of closed rings given by ordered points; the last point joins the first."""
    points = rings.groupBy(*ring).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(x).alias("x"), F.col(y).alias("y")))).alias("p"))
    n = F.size("p")
    each = points.where(n >= 3).select(*ring, "p", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    after = F.pmod(F.col("k") + 1, F.size("p"))
    this, that = F.get(F.col("p"), F.col("k")), F.get(F.col("p"), after)
    return each.select(*ring, this["x"].alias("x1"), this["y"].alias("y1"), that["x"].alias("x2"), that["y"].alias("y2"))


def crosses(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray to the right of (px, py) crosses the edge; even-odd rule, edges hold their lower end."""
    spans = (y1 > py) != (y2 > py)
    at = x1 + (py - y1) * (x2 - x1) / F.when(y2 != y1, y2 - y1).otherwise(1.0)
    return spans & (px < at)


def to_edge(px: Column, py: Column, e: Column) -> Column:
    """Distance of a point from an edge struct(x1, y1, x2, y2)."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    along = ((px - e["x1"]) * dx + (py - e["y1"]) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-300))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.hypot(px - e["x1"] - t * dx, py - e["y1"] - t * dy)


def ring_edges(rings: Column) -> Column:
    """array of struct(x1, y1, x2, y2): the edges of an array of closed rings."""

    def one(ring):
        turned = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, F.lit(1), F.lit(1)))
        return F.zip_with(ring, turned, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))

    return F.flatten(F.transform(rings, one))


def points_in_regions(points: DataFrame, regions: DataFrame, key: str, region: str, same: list[str], pad: float = 0.0) -> DataFrame:
    """(key, region) of points inside; even-odd over all rings, so holes count themselves out.

    ``points`` has (key, px, py, ...same), ``regions`` (region, edges: array of
    struct x1, y1, x2, y2, ...same).  Points meet the boxes whose cells they are in;
    a cell's points are tried against a region's edges at once.  Points within ``pad`` of an edge,
    where it is given, are inside too.
    """
    boxed = regions.select(
        region, *same, "edges",
        (F.array_min(F.transform("edges", lambda e: e["x1"])) - pad).alias("bx0"), (F.array_max(F.transform("edges", lambda e: e["x1"])) + pad).alias("bx1"),
        (F.array_min(F.transform("edges", lambda e: e["y1"])) - pad).alias("by0"), (F.array_max(F.transform("edges", lambda e: e["y1"])) + pad).alias("by1"),
    ).where(F.col("bx0").isNotNull())
    boxes = with_cells(boxed, finer=1)
    looks = in_cells(points, levels_of(boxes), "px", "py")
    cells = [*same, "level", "cx", "cy"]
    # Keys and regions keep their names apart from each other and from what the cells are known by.
    own = {"__key": F.col(key), "__x": F.col("px").cast("double"), "__y": F.col("py").cast("double")}
    its = {"__region": F.col(region), "__edges": F.transform("edges", lambda e: F.array(*[e[c].cast("double") for c in ("x1", "y1", "x2", "y2")])), **{f"__{c}": F.col(c).cast("double") for c in ("bx0", "bx1", "by0", "by1")}}
    first = boxes.select(*cells, F.lit(0).alias("__kind"), *[v.alias(c) for c, v in its.items()])
    then = looks.select(*cells, F.lit(1).alias("__kind"), *[v.alias(c) for c, v in own.items()])
    both = first.unionByName(then, allowMissingColumns=True).dropna(subset=same) if same else first.unionByName(then, allowMissingColumns=True)
    schema = StructType([StructField(key, then.schema["__key"].dataType), StructField(region, first.schema["__region"].dataType)])
    dealt = both.repartition(*cells).sortWithinPartitions(*cells, "__kind")
    return dealt.mapInArrow(_inside(len(cells), key, region, pad), schema)


#: Pairs that a batch of results holds at least, and points times edges that are tried at once.
PAIRS, TRIED = 200_000, 1_000_000


def _holds(e: np.ndarray, x: np.ndarray, y: np.ndarray, pad: float) -> np.ndarray:
    """Which points are inside the edges (x1, y1, x2, y2 by row), by the rules of ``crosses`` and ``to_edge``."""
    odd, close = np.zeros(len(x), bool), np.zeros(len(x), bool)
    step = max(1, TRIED // max(len(x), 1))
    for k in range(0, len(e), step):
        x1, y1, x2, y2 = (c[:, None] for c in e[k : k + step].T)
        spans = (y1 > y) != (y2 > y)
        odd ^= (spans & (x < x1 + (y - y1) * (x2 - x1) / np.where(y2 != y1, y2 - y1, 1.0))).sum(axis=0) % 2 == 1
        if pad:
            dx, dy = x2 - x1, y2 - y1
            t = np.clip(((x - x1) * dx + (y - y1) * dy) / np.maximum(dx * dx + dy * dy, 1e-300), 0.0, 1.0)
            close |= (np.hypot(x - x1 - t * dx, y - y1 - t * dy) <= pad).any(axis=0)
    return odd | close


def _inside(n: int, key: str, region: str, pad: float):
    """Pairs of the points and regions of each cell, whose regions come first; a cell's regions are held, its points are not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = list(zip(*(c.to_pylist() for c in batch.columns[:n]), strict=True))
            starts = [i for i in range(len(cells)) if i == 0 or cells[i] != cells[i - 1]]
            at = {c: batch.column(c) for c in ("__kind", "__key", "__x", "__y", "__region", "__edges", "__bx0", "__bx1", "__by0", "__by1")}
            kind = at["__kind"].to_numpy()
            x, y = (at[c].to_numpy(zero_copy_only=False) for c in ("__x", "__y"))
            box = np.column_stack([at[c].to_numpy(zero_copy_only=False) for c in ("__bx0", "__bx1", "__by0", "__by1")])
            bounds = at["__edges"].offsets.to_numpy() - at["__edges"].offsets[0].as_py()
            flat = at["__edges"].flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            found: list[tuple[np.ndarray, pa.Array]] = []
            count = 0

            def made(found: list, keys: pa.Array = at["__key"]) -> pa.RecordBatch:
                hits = np.concatenate([f[0] for f in found])
                which = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                return pa.RecordBatch.from_arrays([keys.take(pa.array(hits)), pa.concat_arrays([f[1] for f in found]).take(pa.array(which))], names=[key, region])

            for start, stop in zip(starts, [*starts[1:], len(cells)], strict=True):
                if cells[start] != cell:
                    cell, held = cells[start], []
                middle = start + int(np.searchsorted(kind[start:stop], 1))
                held += [(box[i], flat[bounds[i] : bounds[i + 1]], at["__region"].slice(i, 1)) for i in range(start, middle)]
                if middle == stop:
                    continue
                px, py = x[middle:stop], y[middle:stop]
                for (x0, x1, y0, y1), edges, name in held:
                    near = np.flatnonzero((px >= x0) & (px <= x1) & (py >= y0) & (py <= y1))
                    if len(near):
                        near = near[_holds(edges, px[near], py[near], pad)]
                        if len(near):
                            found.append((near + middle, name))
                            count += len(near)
                            if count >= PAIRS:
                                yield made(found)
                                found, count = [], 0
            if found:
                yield made(found)

    return run


def nearest_k(points: DataFrame, nodes: DataFrame, key: str, node: str, same: list[str], k: int) -> DataFrame:
    """(key, node, distance, rank) of the ``k`` nearest nodes of the same net and layer; equal distances by the smaller node.

    ``points`` has (key, px, py, ...same), ``nodes`` (node, nx, ny, ...same); groups
    of fewer nodes give them all.  Points look into the nine cells around them; those
    whose k-th node is within a cell's width are done, as nothing nearer lies outside,
    and the others go on with cells twice as wide.
    """
    own = durable(nodes.select(*same, node, "nx", "ny"))
    extent = own.agg(F.min("nx"), F.max("nx"), F.min("ny"), F.max("ny"), F.count(F.lit(1))).first()
    result = "__d"
    open_points = durable(points.select(key, *same, "px", "py"))
    reach = open_points.agg(F.min("px"), F.max("px"), F.min("py"), F.max("py")).first()
    if not extent[4] or reach[0] is None:
        empty = open_points.join(own, same).select(key, node, F.lit(0.0).alias("distance"), F.lit(0).alias("rank"))
        return empty.limit(0)
    width = max(extent[1], reach[1]) - min(extent[0], reach[0])
    height = max(extent[3], reach[3]) - min(extent[2], reach[2])
    whole = max(math.hypot(width, height), 1e-12) * (1 + 1e-9)
    size = min(whole, max(whole * math.sqrt(k / extent[4]), whole * 2.0**-40))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    done: list[DataFrame] = []
    while True:
        looks = open_points.withColumn("d", F.explode(around)).withColumns({"cx": cell(F.col("px"), size) + F.col("d.i"), "cy": cell(F.col("py"), size) + F.col("d.j")}).drop("d")
        met = looks.join(own.withColumns({"cx": cell(F.col("nx"), size), "cy": cell(F.col("ny"), size)}), [*same, "cx", "cy"])
        dx, dy = F.col("px") - F.col("nx"), F.col("py") - F.col("ny")
        by_distance = W.partitionBy(key).orderBy(result, node)
        ranked = met.select(key, node, F.sqrt(dx * dx + dy * dy).alias(result)).withColumn("rank", F.row_number().over(by_distance)).where(F.col("rank") <= k)
        last = size >= whole
        if not last:
            complete = ranked.where((F.col("rank") == k) & (F.col(result) <= size)).select(key)
            ranked = ranked.join(complete, key, "left_semi")
        ranked = durable(ranked)
        done.append(ranked)
        if last:
            break
        open_points = durable(open_points.join(ranked.select(key).distinct(), key, "left_anti"))
        if open_points.isEmpty():
            break
        size = min(2 * size, whole)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumnRenamed(result, "distance").select(key, node, "distance", "rank")


def nearest(points: DataFrame, nodes: DataFrame, key: str, node: str, same: list[str]) -> DataFrame:
    """(key, node, distance): the nearest node of the same net and layer; equal distances by the smaller node."""
    return nearest_k(points, nodes, key, node, same, 1).select(key, node, "distance")


def nodes_within(discs: DataFrame, nodes: DataFrame, key: str, node: str, same: list[str], radius: str) -> DataFrame:
    """(key, node) of nodes inside each disc, with the tolerance of one part in 10^9."""
    reach = F.col(radius) * (1 + 1e-9) + 1e-12
    boxes = with_cells(discs.select(key, *same, "px", "py", reach.alias("reach")).withColumns({
        "bx0": F.col("px") - F.col("reach"), "bx1": F.col("px") + F.col("reach"), "by0": F.col("py") - F.col("reach"), "by1": F.col("py") + F.col("reach"),
    }))
    met = in_cells(nodes, levels_of(boxes), "nx", "ny").join(boxes, [*same, "level", "cx", "cy"])
    return met.where(F.hypot(F.col("px") - F.col("nx"), F.col("py") - F.col("ny")) <= F.col("reach")).select(key, node)


def containing_triangle(points: DataFrame, triangles: DataFrame, key: str, tri: str, same: list[str], tolerance: float = 1e-9) -> DataFrame:
    """(key, tri): the first triangle (x0, y0, x1, y1, x2, y2) that holds each point, by barycentric coordinates."""
    boxes = with_cells(triangles.withColumns({
        "bx0": F.least("x0", "x1", "x2"), "bx1": F.greatest("x0", "x1", "x2"), "by0": F.least("y0", "y1", "y2"), "by1": F.greatest("y0", "y1", "y2"),
    }))
    px, py = F.col("px"), F.col("py")
    met = in_cells(points, levels_of(boxes), "px", "py").join(boxes, [*same, "level", "cx", "cy"])
    met = met.where(px.between(F.col("bx0"), F.col("bx1")) & py.between(F.col("by0"), F.col("by1")))
    area = (F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    l1 = ((px - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (py - F.col("y0"))) / area
    l2 = ((F.col("x1") - F.col("x0")) * (py - F.col("y0")) - (px - F.col("x0")) * (F.col("y1") - F.col("y0"))) / area
    inside = (area != 0) & (l1 >= -tolerance) & (l2 >= -tolerance) & (l1 + l2 <= 1 + tolerance)
    return met.where(inside).groupBy(key).agg(F.min(tri).alias(tri))


def interval_join(spans: DataFrame, layers: DataFrame, low: str, high: str, index: str) -> DataFrame:
    """Each span with every layer it covers, ends in either order: spans are opened into indices, then an equi-join."""
    opened = spans.withColumn(index, F.explode(F.sequence(F.least(low, high), F.greatest(low, high))))
    return opened.join(layers, index)


def covering_counts(spans: DataFrame, low: Column, high: Column) -> DataFrame:
    """(idx, n): how many spans cover each index, from equal spans counted first; ends in either order."""
    counted = spans.groupBy(F.least(low, high).alias("lo"), F.greatest(low, high).alias("hi")).agg(F.count(F.lit(1)).alias("k"))
    opened = counted.select("k", F.explode(F.sequence("lo", "hi")).alias("idx"))
    return opened.groupBy("idx").agg(F.sum("k").alias("n"))


def ring_area(points: Column) -> Column:
    """Absolute shoelace area of an array of struct(x, y), taken about the first point, so that a ring far from the origin keeps its digits."""
    n, first = F.size(points), F.get(points, F.lit(0))
    turned = F.concat(F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(1), F.lit(1)))
    terms = F.zip_with(points, turned, lambda p, q: (p["x"] - first["x"]) * (q["y"] - first["y"]) - (q["x"] - first["x"]) * (p["y"] - first["y"]))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def exact_sum(areas: Column, unit: float) -> Column:
    """Sum of ``areas`` in whole ``unit``, rounded once: decimals carry no error from row to row, in whatever order they are added."""
    return F.round(F.sum((areas / unit).cast("decimal(38,9)"))).cast("long")


def polygon_area(exterior: Column, holes: Column) -> Column:
    """Area of the exterior without the holes."""
    return ring_area(exterior) - F.aggregate(F.coalesce(holes, F.array()), F.lit(0.0), lambda s, h: s + ring_area(h))


def bounding_box(points: Column) -> Column:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))
