"""Rings, arcs and strokes as expressions over arrays of struct(x, y)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerances in metres, and chords of a circle.
FULL_CIRCLE, DEGENERATE, SAGITTA, COINCIDENT = 1e-12, 1e-6, 1e-6, 1e-9
LEAST_CHORDS, MOST_CHORDS = 16, 720
TURN = 2 * math.pi


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def arc_closure(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """``full_circle`` for coincident ends, ``degenerate`` for ends a rounding apart, else ``open``."""
    chord = F.hypot(x0 - x1, y0 - y1)
    return F.when(chord <= FULL_CIRCLE, "full_circle").when(chord <= DEGENERATE, "degenerate").otherwise("open")


def chords(radius: Column, sweep: Column, sagitta: float = SAGITTA) -> Column:
    """Chords of a sweep that stay within the sagitta, between 16 and 720 a circle."""
    step = F.when(radius > sagitta, 2 * F.acos(1 - F.lit(sagitta) / radius))
    circle = F.coalesce(F.greatest(F.lit(LEAST_CHORDS), F.least(F.lit(MOST_CHORDS), F.ceil(F.lit(TURN) / step))), F.lit(LEAST_CHORDS))
    # Rounding does not add a chord to a whole number of them.
    return F.greatest(F.lit(1), F.ceil(circle * sweep / TURN - 1e-9)).cast("int")


def arc(x0: Column, y0: Column, x1: Column, y1: Column, cx: Column, cy: Column, clockwise: Column) -> Column:
    """Points of an arc with both ends; it lands on the stated end whatever the radius there. A zero radius is an error."""
    radius = F.hypot(x0 - cx, y0 - cy)
    start, end = F.atan2(y0 - cy, x0 - cx), F.atan2(y1 - cy, x1 - cx)
    closure = arc_closure(x0, y0, x1, y1)
    sweep = F.when(closure == "full_circle", F.lit(TURN)).otherwise(F.pmod(F.when(clockwise, start - end).otherwise(end - start), F.lit(TURN)))
    n = chords(radius, sweep)
    way = F.when(clockwise, -1.0).otherwise(1.0)
    inner = F.transform(
        F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: point(cx + radius * F.cos(start + way * sweep * i / n), cy + radius * F.sin(start + way * sweep * i / n)),
    )
    last = F.when(closure == "full_circle", point(x0, y0)).otherwise(point(x1, y1))
    points = F.concat(F.array(point(x0, y0)), F.when(closure == "degenerate", F.array().cast("array<struct<x:double,y:double>>")).otherwise(inner), F.array(last))
    return F.when(radius > COINCIDENT, points).otherwise(F.raise_error(F.lit("an arc has no radius")).cast("array<struct<x:double,y:double>>"))


def circle(cx: Column, cy: Column, diameter: Column) -> Column:
    """Ring of a circle, without a repeated last point; a diameter that is not positive is an error."""
    n = chords(diameter / 2, F.lit(TURN))
    ring = F.transform(F.sequence(F.lit(0), n - 1), lambda i: point(cx + diameter / 2 * F.cos(i * TURN / n), cy + diameter / 2 * F.sin(i * TURN / n)))
    return F.when(diameter > 0, ring).otherwise(F.raise_error(F.lit("a circle has no diameter")).cast("array<struct<x:double,y:double>>"))


def rectangle(cx: Column, cy: Column, width: Column, height: Column) -> Column:
    return F.array(*[point(cx + i * width / 2, cy + j * height / 2) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))])


def round_rectangle(width: Column, height: Column, radius: Column, rounded: Column) -> Column:
    """Ring about the origin with corners of ``radius``, half of the shorter side at most.

    ``rounded`` says which of lower left, lower right, upper right and upper left are; an oval has the largest radius.
    """
    ways = F.array(*[F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j"), F.get(rounded, F.lit(k)).alias("on")) for k, (i, j) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))])
    r = F.least(radius, width / 2, height / 2)
    spots = F.transform(ways, lambda w: F.struct((w["i"] * width / 2).alias("x"), (w["j"] * height / 2).alias("y"), w["i"].alias("i"), w["j"].alias("j"), F.when(w["on"], r).otherwise(F.lit(0.0)).alias("r")))

    def corner(c: Column) -> Column:
        cx, cy = c["x"] - c["i"] * c["r"], c["y"] - c["j"] * c["r"]
        # Counter-clockwise: two corners are entered along their upright side, two along the level one.
        upright = c["i"] * c["j"] > 0
        x0, y0, x1, y1 = F.when(upright, c["x"]).otherwise(cx), F.when(upright, cy).otherwise(c["y"]), F.when(upright, cx).otherwise(c["x"]), F.when(upright, c["y"]).otherwise(cy)
        return F.when(c["r"] > COINCIDENT, arc(x0, y0, x1, y1, cx, cy, F.lit(False))).otherwise(F.array(point(c["x"], c["y"])))

    return F.when((width > 0) & (height > 0), F.flatten(F.transform(spots, corner))).otherwise(F.raise_error(F.lit("a rectangle has no extent")).cast("array<struct<x:double,y:double>>"))


def tidy(ring: Column) -> Column:
    """The ring without points that repeat the one before and without the closing point; null if fewer than three are left."""

    def near(p, q):
        return F.hypot(p["x"] - q["x"], p["y"] - q["y"]) <= COINCIDENT

    empty = F.array().cast("array<struct<x:double,y:double>>")
    kept = F.aggregate(ring, empty, lambda out, p: F.when((F.size(out) > 0) & near(F.element_at(out, -1), p), out).otherwise(F.concat(out, F.array(p))))
    opened = F.transform(F.array(kept), lambda k: F.when((F.size(k) > 1) & near(F.get(k, F.lit(0)), F.element_at(k, -1)), F.slice(k, F.lit(1), F.size(k) - 1)).otherwise(k))[0]
    return F.transform(F.array(opened), lambda k: F.when(F.size(k) >= 3, k))[0]


def placed(ring: Column, mirror: Column, rotation_deg: Column, dx: Column, dy: Column) -> Column:
    """A ring mirrored in x, rotated and moved; a mirrored ring is reversed, so that its direction stays."""
    a = F.radians(rotation_deg)
    sign = F.when(mirror, -1.0).otherwise(1.0)
    moved = F.transform(ring, lambda p: point(p["x"] * sign * F.cos(a) - p["y"] * F.sin(a) + dx, p["x"] * sign * F.sin(a) + p["y"] * F.cos(a) + dy))
    return F.when(mirror, F.reverse(moved)).otherwise(moved)


def scaled(ring: Column, scale: Column) -> Column:
    return F.transform(ring, lambda p: point(p["x"] * scale, p["y"] * scale))


def stroke(path: Column, width: Column, round_ends: Column) -> Column:
    """Rings whose union is the stroked path: a rectangle a segment and, with round ends, a circle a point.

    Joints of flat-ended paths are round as well, so that bends have no notch.
    """
    n = F.size(path)
    segments = F.transform(F.when(n > 1, F.sequence(F.lit(0), n - 2)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(F.get(path, i).alias("p"), F.get(path, i + 1).alias("q")))

    def box(s):
        dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
        length = F.hypot(dx, dy)
        ox, oy = -dy / length * width / 2, dx / length * width / 2
        return F.array(*[point(s[e]["x"] + k * ox, s[e]["y"] + k * oy) for e, k in (("p", -1), ("q", -1), ("q", 1), ("p", 1))])

    boxes = F.transform(F.filter(segments, lambda s: F.hypot(s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]) > COINCIDENT), box)
    inner = F.when(n > 2, F.slice(path, F.lit(2), n - 2)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    caps = F.transform(F.when(round_ends, path).otherwise(inner), lambda p: circle(p["x"], p["y"], width))
    return F.concat(boxes, caps)
