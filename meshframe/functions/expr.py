"""Scalar expressions over colours, points and polygons. Vertices are ARRAY<STRUCT<x, y, ...>> of BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b, 8)


def clamp(v: Column, lo: Column, hi: Column) -> Column:
    return F.least(F.greatest(v, lo), hi)


def dist2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return (ax - bx) * (ax - bx) + (ay - by) * (ay - by)


def cross(o: Column, a: Column, b: Column) -> Column:
    """Twice the signed area of the triangle o, a, b."""
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def rotate(v: Column, by: int = 1) -> Column:
    return F.concat(F.slice(v, by + 1, F.size(v) - by), F.slice(v, 1, by))


def signed_area2(v: Column) -> Column:
    parts = F.zip_with(v, rotate(v), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(parts, F.lit(0).cast("bigint"), lambda s, p: s + p)


def incircle(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Above 0 when d is inside the circle through the counter-clockwise a, b, c."""
    rel = lambda p: (p["x"] - d["x"], p["y"] - d["y"])
    (ax, ay), (bx, by), (cx, cy) = rel(a), rel(b), rel(c)
    return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay)


def edges(v: Column) -> Column:
    """ARRAY<STRUCT<u, v>> of a closed ring."""
    return F.zip_with(v, rotate(v), lambda a, b: F.struct(a.alias("u"), b.alias("v")))


def inside(v: Column, x: Column, y: Column) -> Column:
    """Closed test against a counter-clockwise convex polygon."""
    p = F.struct(x.alias("x"), y.alias("y"))
    return F.forall(edges(v), lambda e: cross(e["u"], e["v"], p) >= 0)


def interiors_meet(p: Column, q: Column) -> Column:
    """Whether no edge of either convex polygon separates them."""
    parted = lambda a, b: F.exists(edges(a), lambda e: F.forall(b, lambda v: cross(e["u"], e["v"], v) <= 0))
    return ~(parted(p, q) | parted(q, p))


def strictly_convex(v: Column) -> Column:
    return F.forall(F.zip_with(edges(v), rotate(v, 2), lambda e, c: cross(e["u"], e["v"], c)), lambda s: s > 0)


def floor_div(a: Column, b: Column) -> Column:
    """Quotient rounded down, for b above 0."""
    return F.call_function("div", a - F.pmod(a, b), b)


def int_div(a: Column, b: Column) -> Column:
    """Quotient of whole numbers cut towards zero."""
    return F.call_function("div", a, b)


def map_px(x: Column, n: Column, to: Column) -> Column:
    """Pixel centre of a side of n pixels on a side of `to` pixels; the ends stay ends."""
    inner = F.round((x + 0.5) * to / n - 0.5).cast("bigint")
    return F.when(x <= 0, F.lit(0).cast("bigint")).when(x >= n - 1, to - 1).otherwise(clamp(inner, F.lit(0).cast("bigint"), to - 1))


def half_px(x: Column, n: Column) -> Column:
    """Half-pixel coordinate of vector output; the ends snap to the frame."""
    return F.when(x <= 0, F.lit(0).cast("bigint")).when(x >= n - 1, 2 * n).otherwise(2 * x + 1)


def sse(s2: Column, sr: Column, sg: Column, sb: Column, n: Column) -> Column:
    d = lambda c: c.cast("double")
    return F.when(n == 0, F.lit(0.0)).otherwise(d(s2) - (d(sr) * d(sr) + d(sg) * d(sg) + d(sb) * d(sb)) / d(n))


def let(value: Column, body) -> Column:
    """body(value), the value computed once: the optimiser writes a column out wherever it is used, but not a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hull(v: Column) -> Column:
    """Strict convex hull of at most four distinct points, counter-clockwise from the smallest (x, y).

    A point is no corner when it lies on a segment of two others or in a triangle of three others; the corners behind
    the smallest are ordered by how many of them come before.
    """
    between = lambda p, a, b: (cross(a, b, p) == 0) & ((a["x"] - p["x"]) * (b["x"] - p["x"]) + (a["y"] - p["y"]) * (b["y"] - p["y"]) < 0)

    def corner(p: Column, o: Column) -> Column:
        on = F.exists(o, lambda a: F.exists(o, lambda b: between(p, a, b)))
        a, b, c = F.get(o, F.lit(0)), F.get(o, F.lit(1)), F.get(o, F.lit(2))
        turn = F.array(*(F.signum(s.cast("double")) for s in (cross(a, b, p), cross(b, c, p), cross(c, a, p))))
        within = (F.size(o) == 3) & F.coalesce(F.abs(F.aggregate(turn, F.lit(0.0), lambda s, t: s + t)) == 3, F.lit(False))
        return ~(on | within)

    def corners(v: Column) -> Column:
        others = lambda p: F.filter(v, lambda q: (q["x"] != p["x"]) | (q["y"] != p["y"]))
        return F.array_sort(F.filter(v, lambda p: let(others(p), lambda o: corner(p, o))))

    def ordered(kept: Column, first: Column, rest: Column) -> Column:
        ranked = F.transform(rest, lambda p: F.struct(F.size(F.filter(rest, lambda q: cross(first, q, p) > 0)).alias("rank"), p.alias("p")))
        return F.concat(F.slice(kept, 1, 1), F.transform(F.array_sort(ranked), lambda r: r["p"]))

    return let(v, lambda v: let(corners(v), lambda kept: let(F.get(kept, F.lit(0)), lambda first: let(F.slice(kept, 2, 3), lambda rest: ordered(kept, first, rest)))))
