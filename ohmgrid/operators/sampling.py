"""Sizes along boundaries by rays, and interior lattices at power-of-two levels of the size field."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmgrid.functions.storage import durable
from ohmgrid.operators import overlay, ranges, spatial

# Hits nearer than this, in metres, are the boundary that a ray starts on; spacings that interior points keep off
# the boundary; candidates of a region's lattices at most.
NEAREST_HIT, CLEARANCE, MOST_CANDIDATES = 1e-9, 0.55, 16_000_000


class TooManyPoints(ValueError):
    """A lattice would have more points than the budget."""


def ray_hits(rays: DataFrame, segments: DataFrame, key: str, same: list[str], reach: float) -> DataFrame:
    """(key, distance): from each ray's start to the first segment of equal ``same`` that it meets, ``reach`` if it meets none.

    Rays have (key, px, py, dx, dy: unit direction), segments (x1, y1, x2, y2).  Both are cut at the lines of a grid, so that a
    ray meets only the segments of the cells that it crosses, and the nearest hit is a partial
    aggregate.  Ends are whole nanometres; segments along a ray do not stop it, their neighbours do.
    """
    nm = lambda c: F.round(c * overlay.NM).cast("long")
    start = rays.select(key, *same, nm(F.col("px")).alias("from_x"), nm(F.col("py")).alias("from_y"), nm(F.col("px") + F.col("dx") * reach).alias("to_x"), nm(F.col("py") + F.col("dy") * reach).alias("to_y"))
    start = durable(start)
    a, b = F.struct(F.col("from_x").alias("x"), F.col("from_y").alias("y")), F.struct(F.col("to_x").alias("x"), F.col("to_y").alias("y"))
    lines = start.select(key, *same, "from_x", "from_y", "to_x", "to_y", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    lines = lines.select(key, *same, "from_x", "from_y", "to_x", "to_y", F.col("a.x").alias("xa"), F.col("a.y").alias("ya"), F.col("b.x").alias("xb"), F.col("b.y").alias("yb"))
    c, d = F.struct(nm(F.col("x1")).alias("x"), nm(F.col("y1")).alias("y")), F.struct(nm(F.col("x2")).alias("x"), nm(F.col("y2")).alias("y"))
    walls = segments.select(*same, F.least(c, d).alias("a"), F.greatest(c, d).alias("b")).where("a != b")
    walls = walls.select(*same, F.col("a.x").alias("xa"), F.col("a.y").alias("ya"), F.col("b.x").alias("xb"), F.col("b.y").alias("yb"))
    long = walls.agg(F.avg(F.greatest(F.col("xb") - F.col("xa"), F.abs(F.col("yb") - F.col("ya"))))).first()[0] or 1.0
    size = F.lit(float(round(max(long, reach * overlay.NM / 64)) + 1))
    cut = overlay.cut_edges(lines, [key, *same, "from_x", "from_y", "to_x", "to_y"], size).select(key, *same, "col", "row", "from_x", "from_y", "to_x", "to_y")
    wall = overlay.cut_edges(walls, same, size).select(*same, "col", "row", "xa", "ya", "xb", "yb")
    x = lambda n: F.col(n).cast("double")
    rx, ry, wx, wy = x("to_x") - x("from_x"), x("to_y") - x("from_y"), x("xb") - x("xa"), x("yb") - x("ya")
    den = rx * wy - ry * wx
    t = ((x("xa") - x("from_x")) * wy - (x("ya") - x("from_y")) * wx) / F.when(den != 0, den)
    u = ((x("xa") - x("from_x")) * ry - (x("ya") - x("from_y")) * rx) / F.when(den != 0, den)
    distance = t * F.hypot(rx, ry) / overlay.NM
    hit = F.when(u.between(0.0, 1.0) & (distance > NEAREST_HIT) & (distance < reach), distance)
    # Pieces are many for a row of the tables they come from, so their size is not guessed from it: both sides are exchanged.
    nearest = cut.join(wall.hint("merge"), [*same, "col", "row"]).groupBy(key).agg(F.min(hit).alias("distance"))
    return start.select(key).join(nearest, key, "left").select(key, F.coalesce("distance", F.lit(reach)).alias("distance"))


def graded_size(inward: Column, outward: Column, across: int, largest: float, smallest: float) -> Column:
    """``across`` elements over the width, points denser than half the clearance, within the bounds."""
    return F.greatest(F.least(inward / across, outward / 2, F.lit(largest)), F.lit(smallest))


def boundary_sizes(points: DataFrame, segments: DataFrame, key: str, same: list[str], across: int, largest: float, smallest: float, reach: float) -> DataFrame:
    """(key, inward, outward, size) of boundary points (key, px, py, nx, ny: inward normal) by one ray each way."""
    both = points.select(key, *same, "px", "py", F.explode(F.array(F.lit(1.0), F.lit(-1.0))).alias("way"), "nx", "ny")
    rays = both.select(F.struct(key, "way").alias("ray"), *same, "px", "py", (F.col("nx") * F.col("way")).alias("dx"), (F.col("ny") * F.col("way")).alias("dy"))
    found = ray_hits(rays, segments, "ray", same, reach)
    way = lambda w: F.max(F.when(F.col("ray.way") == w, F.col("distance")))
    sides = found.groupBy(F.col(f"ray.{key}").alias(key)).agg(way(1.0).alias("inward"), way(-1.0).alias("outward"))
    return sides.withColumn("size", graded_size(F.col("inward"), F.col("outward"), across, largest, smallest))


def size_levels(largest: float, smallest: float, finest: float) -> list[float]:
    """Halves of the largest size, none under the smallest or half of the finest that is asked for."""
    floor, out = max(smallest, finest / 2), [largest]
    while out[-1] / 2 >= floor:
        out.append(out[-1] / 2)
    return out


def graded_lattice(
    boxes: DataFrame, boundary: DataFrame, region: str, node: str, largest: float, smallest: float, growth: float, clearance: float = CLEARANCE, most: int = MOST_CANDIDATES
) -> DataFrame:
    """(region, level, col, row, px, py): triangular lattices of each box, each level where the size field asks for it.

    Boxes have (region, x0, y0, x1, y1), boundary points (region, node, nx, ny, size).  The size
    asked for at a point is that of the nearest boundary point and ``growth`` times its distance, at most ``largest``; a
    level's points are those that ask for its spacing up to twice of it and lie ``clearance`` spacings off the boundary.  The
    largest level covers the box; finer ones are laid only around boundary points that can ask for
    them, a point that several ask for once.  What the levels may have to try is summed up first, and
    more than ``most`` in a region is refused before any is laid.
    """
    held = durable(boundary.select(region, node, "nx", "ny", "size"))
    finest = held.agg(F.min("size")).first()[0]
    levels = size_levels(largest, smallest, finest if finest is not None else largest)
    tall = math.sqrt(3) / 2
    near = held.join(boxes, region)
    tried: Column = F.lit(0.0)
    windows = []
    for k, level in enumerate(levels[1:], 1):
        reach = 2 * level / growth
        rows, cols = int(reach / (level * tall)) + 1, int(reach / level) + 1
        asks = F.col("size") < 2 * level
        tried = tried + F.when(asks, float((2 * rows + 1) * (2 * cols + 1))).otherwise(0.0)
        row, col = F.floor((F.col("ny") - F.col("y0")) / (level * tall)), F.floor((F.col("nx") - F.col("x0")) / level)
        last_row, last_col = F.floor((F.col("y1") - F.col("y0")) / (level * tall)) + 1, F.floor((F.col("x1") - F.col("x0")) / level) + 1
        span = lambda at, far, end: F.sequence(F.greatest(F.lit(0).cast("long"), at - far), F.greatest(F.greatest(F.lit(0).cast("long"), at - far), F.least(end, at + far)))
        window = near.where(asks).select(region, "x0", "y0", F.explode(span(row, rows, last_row)).alias("row"), span(col, cols, last_col).alias("cols"))
        windows.append(window.select(region, "x0", "y0", F.lit(k).alias("k"), "row", F.explode("cols").alias("col")).distinct())
    whole = (F.floor((F.col("y1") - F.col("y0")) / (largest * tall)) + 2) * (F.floor((F.col("x1") - F.col("x0")) / largest) + 2)
    needed = boxes.select(region, whole.cast("double").alias("n")).unionAll(near.select(region, tried.alias("n")))
    if needed.groupBy(region).agg(F.sum("n").alias("n")).where(F.col("n") > most).limit(1).count():
        raise TooManyPoints(f"a region's lattices have more than {most} candidates; take larger sizes")
    full = boxes.select(region, "x0", "y0", F.lit(0).alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("y1") - F.col("y0")) / (largest * tall)) + 1)).alias("row"), F.sequence(F.lit(0).cast("long"), F.floor((F.col("x1") - F.col("x0")) / largest) + 1).alias("cols"))
    laid = full.select(region, "x0", "y0", "k", "row", F.explode("cols").alias("col"))
    for window in windows:
        laid = laid.unionByName(window)
    spacing = F.element_at(F.array(*[F.lit(v) for v in levels]), F.col("k") + 1)
    points = laid.withColumn("level", spacing).select(region, "level", "col", "row", (F.col("x0") + (F.col("col") + 0.5 * (F.col("row") % 2)) * F.col("level")).alias("px"), (F.col("y0") + F.col("row") * F.col("level") * tall).alias("py"))
    ident, = ranges.free_names(points, "ident")
    points = durable(points.withColumn(ident, F.monotonically_increasing_id()))
    met = points.join(spatial.nearest(points, held, ident, node, [region]), ident).join(held.select(region, node, "size"), [region, node])
    target = F.least(F.col("size") + growth * F.col("distance"), F.lit(largest))
    wanted = (target >= F.col("level")) & (target < 2 * F.col("level")) & (F.col("distance") >= clearance * F.col("level"))
    return met.where(wanted).select(region, "level", "col", "row", "px", "py")


def walk_spans(pieces: DataFrame, span: list[str], start: str, stop: str, first_size: str, last_size: str) -> DataFrame:
    """(span, step, position, size): points along spans whose distances follow the size there, the first at the span's start, none at its end.

    Pieces have where they start and stop along the span and the sizes at both ends, between which the size is linear; those of
    a span follow each other.  A span of n sizes in all, the integral of one over the size, takes round(n) steps, one at least,
    which are stretched alike so that the last ends where the span does.  The integral is
    carried over sorted ranges of pieces, so a span may be any number of them, and each piece gives the points that lie on it.
    """
    a, b = F.col(first_size), F.col(last_size)
    long = F.col(stop) - F.col(start)
    slope = (b - a) / long
    level = F.abs(b - a) <= 1e-12 * a
    own = F.when(level, long / a).otherwise(F.ln(b / a) / F.when(~level, slope))
    sound = pieces.select(*span, start, stop, first_size, last_size).where((F.col(stop) > F.col(start)) & (a > 0) & (b > 0))
    number, reached, whole = ranges.free_names(sound, "number", "reached", "whole")
    laid = ranges.numbered(sound, span, [F.col(start).asc()], number, sums={reached: own}, totals={reached: whole})
    steps = F.greatest(F.lit(1.0), F.round(F.col(whole)))
    before = F.greatest(F.col(reached) - own, F.lit(0.0))
    # Sums of the same numbers in another order may differ in the last digits; a point between two pieces is on the later one.
    place = lambda v: F.ceil(v * steps / F.col(whole) - 1e-9).cast("long")
    low, high = F.when(F.col(number) == 0, F.lit(0).cast("long")).otherwise(place(before)), F.least(place(F.col(reached)), steps.cast("long"))
    points = laid.select("*", before.alias("from_"), steps.alias("steps_"), F.explode(F.when(high > low, F.sequence(low, high - 1))).alias("step"))
    into = F.greatest(F.col("step") * F.col(whole) / F.col("steps_") - F.col("from_"), F.lit(0.0))
    moved = F.when(level, into * a).otherwise(a * F.expm1(into * slope) / F.when(~level, slope))
    return points.select(*span, "step", (F.col(start) + moved).alias("position"), (a + slope * moved).alias("size"))
