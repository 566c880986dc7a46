"""Polygons against pixels: edge functions, exact scanline spans, sums and colours.

A span row is (polygon, row, first and last pixel). Sums come from row prefix sums at both ends of a span, so no
polygon is ever expanded to its pixels for an aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.functions import expr


def edge_functions(polys: DataFrame) -> DataFrame:
    """a, b, c of each edge: a x + b y + c is above 0 inside."""
    e = polys.select("image_id", "poly_id", F.posexplode(expr.edges(F.col("verts"))).alias("pos", "e"))
    a, b = F.col("e.u.y") - F.col("e.v.y"), F.col("e.v.x") - F.col("e.u.x")
    return e.select("image_id", "poly_id", F.col("pos").cast("bigint").alias("pos"), a.alias("a"), b.alias("b"), (-(a * F.col("e.u.x") + b * F.col("e.u.y"))).alias("c"))


def polygon_spans(polys: DataFrame, sizes: DataFrame) -> DataFrame:
    """image_id, poly_id, y, xl, xr: in a tiling, each pixel belongs to one polygon.

    Grouping the edges by polygon and row is sound because the left end only grows and the right end only shrinks.
    """
    zero = F.lit(0).cast("bigint")
    xs, ys = F.transform("verts", lambda v: v["x"]), F.transform("verts", lambda v: v["y"])
    box = polys.join(sizes, "image_id").select(
        "image_id", "poly_id", "verts", "w", "h", F.greatest(F.array_min(xs), zero).alias("x0"), F.least(F.array_max(xs) + 1, F.col("w")).alias("x1"),
        F.greatest(F.array_min(ys), zero).alias("y0"), F.least(F.array_max(ys) + 1, F.col("h")).alias("y1"),
    ).where("y0 < y1")
    rows = box.withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    e = rows.select("image_id", "poly_id", "y", "w", "h", "x0", "x1", F.explode(expr.edges(F.col("verts"))).alias("e"))
    e = e.select("*", (F.col("e.u.y") - F.col("e.v.y")).alias("a"), (F.col("e.v.x") - F.col("e.u.x")).alias("b"))
    e = e.select("*", (F.col("b") * (F.col("y") - F.col("e.u.y")) - F.col("a") * F.col("e.u.x")).alias("k"), F.when(F.col("y") == F.col("h") - 1, -1).otherwise(1).alias("down"))
    a, b, k, down = (F.col(c) for c in ("a", "b", "k", "down"))
    steep = F.nullif(F.abs(a), F.lit(0).cast("bigint"))
    end = a * (F.col("w") - 1) + k
    grouped = e.groupBy("image_id", "poly_id", "y", "w", "x0", "x1").agg(
        F.max(F.when(a > 0, -expr.floor_div(k, steep))).alias("lo"),
        F.min(F.when(a < 0, -expr.floor_div(-k, steep) - 1)).alias("hi"),
        F.bool_or((a == 0) & ((k < 0) | ((k == 0) & (b * down <= 0)))).alias("never"),
        F.bool_and((end > 0) | ((end == 0) & ((a < 0) | ((a == 0) & (b * down > 0))))).alias("last"),
    )
    lo = F.greatest("x0", F.coalesce("lo", "x0"))
    hi = F.when(F.col("never"), F.lit(-1).cast("bigint")).otherwise(F.least(F.least("x1", F.col("w") - 1) - 1, F.coalesce("hi", F.col("w"))))
    ends = grouped.select("image_id", "poly_id", "y", "w", lo.alias("lo"), hi.alias("hi"), (F.col("last") & (F.col("x1") == F.col("w"))).alias("last"))
    some = ends.where("lo <= hi OR last")
    return some.select("image_id", "poly_id", "y", F.when(F.col("lo") > F.col("hi"), F.col("w") - 1).otherwise(F.col("lo")).alias("xl"), F.when(F.col("last"), F.col("w") - 1).otherwise(F.col("hi")).alias("xr"))


def polygon_pixels(spans: DataFrame) -> DataFrame:
    return spans.select("image_id", "poly_id", "y", F.explode(F.sequence("xl", "xr")).alias("x"))


def row_sums(pixels: DataFrame) -> DataFrame:
    """Running sums of r, g, b and their squares along each row."""
    w = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    r, g, b = F.col("r"), F.col("g"), F.col("b")
    return pixels.select("image_id", "y", "x", F.sum(r).over(w).alias("pr"), F.sum(g).over(w).alias("pg"), F.sum(b).over(w).alias("pb"), F.sum(r * r + g * g + b * b).over(w).alias("p2"))


def polygon_sums(polys: DataFrame, spans: DataFrame, rows: DataFrame) -> DataFrame:
    """n, sr, sg, sb, s2 of every polygon; zeros for one that holds no pixel."""
    at = lambda end, tag: rows.select("image_id", "y", F.col("x").alias(end), *(F.col(c).alias(c + tag) for c in ("pr", "pg", "pb", "p2")))
    both = spans.withColumn("xb", F.col("xl") - 1).join(at("xr", "1"), ["image_id", "y", "xr"]).join(at("xb", "0"), ["image_id", "y", "xb"], "left")
    part = lambda c: F.sum(F.col(c + "1") - F.coalesce(c + "0", F.lit(0).cast("bigint")))
    sums = both.groupBy("image_id", "poly_id").agg(F.sum(F.col("xr") - F.col("xl") + 1).alias("n"), part("pr").alias("sr"), part("pg").alias("sg"), part("pb").alias("sb"), part("p2").alias("s2"))
    out = polys.select("image_id", "poly_id").join(sums, ["image_id", "poly_id"], "left")
    return out.select("image_id", "poly_id", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n", "sr", "sg", "sb", "s2")))


def with_sse(sums: DataFrame) -> DataFrame:
    return sums.withColumn("sse", expr.sse(*(F.col(c) for c in ("s2", "sr", "sg", "sb", "n"))))


def corner_colours(polys: DataFrame, pixels: DataFrame) -> DataFrame:
    first = polys.select("image_id", "poly_id", F.get("verts", F.lit(0)).alias("v")).select("image_id", "poly_id", F.col("v.x").alias("x"), F.col("v.y").alias("y"))
    return first.join(pixels, ["image_id", "y", "x"]).select("image_id", "poly_id", "r", "g", "b")


def mean_colours(polys: DataFrame, sums: DataFrame, pixels: DataFrame) -> DataFrame:
    """Mean colour of each polygon, cut to whole numbers; that of its first corner where it holds no pixel."""
    corner = corner_colours(polys, pixels)
    mean = lambda s, c: F.when(F.col("n") > 0, expr.int_div(F.col(s), F.nullif("n", F.lit(0).cast("bigint")))).otherwise(F.col(c)).alias(c)
    return sums.join(corner, ["image_id", "poly_id"]).select("image_id", "poly_id", mean("sr", "r"), mean("sg", "g"), mean("sb", "b"))


def image_mean(pixels: DataFrame) -> DataFrame:
    n = F.greatest(F.count("*"), F.lit(1))
    return pixels.groupBy("image_id").agg(*(expr.int_div(F.sum(c), n).alias(c) for c in "rgb"))


def image_sse(a: DataFrame, b: DataFrame) -> DataFrame:
    """Total squared difference of two images, and its peak signal-to-noise ratio in decibels."""
    both = a.join(b.select("image_id", "y", "x", *(F.col(c).alias(c + "2") for c in "rgb")), ["image_id", "y", "x"])
    diff = sum((F.col(c) - F.col(c + "2")) * (F.col(c) - F.col(c + "2")) for c in "rgb")
    out = both.groupBy("image_id").agg(F.sum(diff).alias("sse"), F.count("*").alias("n"))
    return out.select("image_id", "sse", F.when(F.col("sse") > 0, F.round(10 * F.log10(F.lit(3.0 * 255 * 255) * F.col("n") / F.col("sse")), 6)).alias("psnr"))


def cell_mean(owner: DataFrame, pixels: DataFrame) -> DataFrame:
    """Mean colour of each Voronoi cell."""
    both = owner.join(pixels, ["image_id", "y", "x"])
    return both.groupBy("image_id", "seed_id").agg(F.count("*").alias("n"), *(expr.int_div(F.sum(c), F.count("*")).alias(c) for c in "rgb"))
