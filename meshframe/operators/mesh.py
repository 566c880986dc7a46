"""From owners to polygons: junctions, distinct keys, hulls, adjacency, overlaps and exact Delaunay tests."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.functions import expr, kernels


def junctions(owner: DataFrame) -> DataFrame:
    """Every 2 x 2 window where three or four owners meet: its corner and the sorted owners k0..k3 (null for none)."""
    right = F.lead("seed_id").over(Window.partitionBy("image_id", "y").orderBy("x"))
    rows = owner.select("image_id", "y", "x", F.col("seed_id").alias("a"), right.alias("b")).where("b IS NOT NULL")
    down = Window.partitionBy("image_id", "x").orderBy("y")
    four = rows.withColumns({"c": F.lead("a").over(down), "d": F.lead("b").over(down)}).where("c IS NOT NULL")
    key = four.where("NOT (a = b AND a = c AND a = d)").select("image_id", "y", "x", F.array_sort(F.array_distinct(F.array("a", "b", "c", "d"))).alias("k")).where(F.size("k") >= 3)
    return key.select("image_id", "y", "x", *(F.get("k", F.lit(i)).alias(f"k{i}") for i in range(4)))


def distinct_keys(found: DataFrame) -> DataFrame:
    """Keys once, with their first window (y, x)."""
    first = F.min(F.struct("y", "x"))
    return found.groupBy("image_id", "k0", "k1", "k2", "k3").agg(first.alias("f")).select("image_id", "k0", "k1", "k2", "k3", F.col("f.y").alias("y"), F.col("f.x").alias("x"))


def key_polygons(keys: DataFrame, seeds: DataFrame) -> DataFrame:
    """image_id, poly_id (by first window), n, verts (x, y, s), counter-clockwise; flat keys are left out."""
    ids = keys.select("image_id", "y", "x", F.posexplode(F.array("k0", "k1", "k2", "k3")).alias("pos", "seed_id")).where("seed_id IS NOT NULL")
    at = ids.join(seeds.select("image_id", "seed_id", F.col("x").alias("sx"), F.col("y").alias("sy")), ["image_id", "seed_id"])
    # two keys may share their first window's place only if they are one key: a window has one key
    whole = at.groupBy("image_id", "y", "x").agg(F.collect_list(F.struct(F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("seed_id").alias("s"))).alias("v"))
    ring = whole.withColumn("verts", expr.hull(F.col("v"))).where(F.size("verts") >= 3)
    w = Window.partitionBy("image_id").orderBy("y", "x")
    return ring.select("image_id", (F.row_number().over(w) - 1).cast("bigint").alias("poly_id"), F.size("verts").cast("bigint").alias("n"), "verts")


def poly_vertices(polys: DataFrame) -> DataFrame:
    return polys.select("image_id", "poly_id", "n", F.posexplode("verts").alias("pos", "v")).select("image_id", "poly_id", "n", F.col("pos").cast("bigint").alias("pos"), F.col("v.s").alias("seed_id"), F.col("v.x").alias("x"), F.col("v.y").alias("y"))


def vertex_degree(polys: DataFrame) -> DataFrame:
    return poly_vertices(polys).groupBy("image_id", "seed_id").agg(F.count("*").alias("degree"))


def overlap_pairs(polys: DataFrame) -> DataFrame:
    """Pairs of polygons that share a seed and whose interiors meet."""
    pv = poly_vertices(polys).select("image_id", "seed_id", "poly_id")
    a, b = pv.withColumnRenamed("poly_id", "poly_a"), pv.withColumnRenamed("poly_id", "poly_b")
    pairs = a.join(b, ["image_id", "seed_id"]).where("poly_a < poly_b").select("image_id", "poly_a", "poly_b").distinct()
    ring = polys.select("image_id", "poly_id", "verts")
    both = pairs.join(ring.select("image_id", F.col("poly_id").alias("poly_a"), F.col("verts").alias("p")), ["image_id", "poly_a"]).join(ring.select("image_id", F.col("poly_id").alias("poly_b"), F.col("verts").alias("q")), ["image_id", "poly_b"])
    return both.where(expr.interiors_meet(F.col("p"), F.col("q"))).select("image_id", "poly_a", "poly_b")


def overlap_groups(pairs: DataFrame) -> DataFrame:
    """poly_id and the smallest poly_id of its group of overlapping polygons, by labels that spread until none changes."""
    from meshframe.plans.loops import cut

    both = pairs.select("image_id", F.col("poly_a").alias("poly_id"), F.col("poly_b").alias("near")).unionByName(pairs.select("image_id", F.col("poly_b").alias("poly_id"), F.col("poly_a").alias("near")))
    both = cut(both.distinct())
    label = cut(both.groupBy("image_id", "poly_id").agg(F.least(F.min("near"), F.col("poly_id")).alias("group_id")))
    while True:
        spread = both.join(label.select("image_id", F.col("poly_id").alias("near"), F.col("group_id").alias("g")), ["image_id", "near"]).groupBy("image_id", "poly_id").agg(F.min("g").alias("g"))
        step = cut(label.join(spread, ["image_id", "poly_id"]).select("image_id", "poly_id", F.least("group_id", "g").alias("group_id"), (F.col("g") < F.col("group_id")).alias("moved")))
        label = step.drop("moved")
        if step.where("moved").isEmpty():
            return label


def empty_circles(points: DataFrame) -> DataFrame:
    """Triples a < b < c of a group's points that turn and hold no other point of the group in their circle.

    points: image_id, group_id, seed_id, x, y, a few for each group (groups for exact repair have twelve at most).
    """
    p = points.groupBy("image_id", "group_id").agg(F.array_sort(F.collect_list(F.struct("seed_id", "x", "y"))).alias("p")).where(F.size("p") >= 3)
    i = p.select("image_id", "group_id", "p", F.explode(F.sequence(F.lit(0), F.size("p") - 3)).alias("i"))
    j = i.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.size("p") - 2)))
    k = j.withColumn("k", F.explode(F.sequence(F.col("j") + 1, F.size("p") - 1)))
    t = k.select("image_id", "group_id", "p", F.get("p", F.col("i")).alias("a"), F.get("p", F.col("j")).alias("b"), F.get("p", F.col("k")).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    side = expr.cross(a, b, c)
    clear = F.forall("p", lambda d: (F.signum(side.cast("double")) * expr.incircle(a, b, c, d).cast("double") <= 0))
    return t.where((side != 0) & clear).select("image_id", "group_id", F.col("a.seed_id").alias("a"), F.col("b.seed_id").alias("b"), F.col("c.seed_id").alias("c"))


def seed_hull(seeds: DataFrame) -> DataFrame:
    """Corners of each image's hull, numbered counter-clockwise.

    Only the lowest and highest point of a column can be a corner, which leaves two rows for each x before the chain.
    """
    ends = seeds.groupBy("image_id", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    pts = ends.select("image_id", "x", F.explode(F.array("lo", "hi")).alias("y"))
    return _hulls(pts, "image_id long, pos long, x long, y long", ["image_id"])


def hull_two_phase(seeds: DataFrame, parts: int = 8) -> DataFrame:
    """The same corners as a hull of partial hulls, for points too many for one task."""
    part = seeds.select("image_id", F.pmod(F.xxhash64("x", "y"), F.lit(parts)).alias("part"), "x", "y")
    return _hulls(_hulls(part, "image_id long, part long, pos long, x long, y long", ["image_id", "part"]).select("image_id", "x", "y"), "image_id long, pos long, x long, y long", ["image_id"])


def _hulls(points: DataFrame, schema: str, keys: list[str]) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ring = np.array(kernels.hull(pdf[["x", "y"]].to_numpy()), np.int64).reshape(-1, 2)
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "pos": np.arange(len(ring)), "x": ring[:, 0], "y": ring[:, 1]})

    return points.groupBy(*keys).applyInPandas(run, schema)


def border_keys(owner: DataFrame, seeds: DataFrame) -> DataFrame:
    """Triangles of seeds whose circle's centre lies outside the image; only border rows and columns travel."""
    ends = owner.groupBy("image_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    edge = owner.join(ends, "image_id").where("x = 0 OR y = 0 OR x = mx OR y = my").select("image_id", "y", "x", "seed_id")

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in ("image_id", "k0", "k1", "k2")}).astype("int64")
        b = b.sort_values("seed_id")
        grid = kernels.plane(a.y, a.x, np.searchsorted(b.seed_id.to_numpy(), a.seed_id.to_numpy()), int(a.y.max()) + 1, int(a.x.max()) + 1)
        keys = np.array(sorted(set(kernels.border_triangles(grid, b[["x", "y"]].to_numpy()))), np.int64).reshape(-1, 3)
        ids = b.seed_id.to_numpy()[keys]
        return pd.DataFrame({"image_id": key[0], "k0": ids[:, 0], "k1": ids[:, 1], "k2": ids[:, 2]})

    return edge.groupBy("image_id").cogroup(seeds.groupBy("image_id")).applyInPandas(run, "image_id long, k0 long, k1 long, k2 long")


def polygons_of_owner(owner: DataFrame, seeds: DataFrame, exact: bool = True) -> DataFrame:
    """The whole extraction by image: image_id, poly_id, n, verts; with overlaps repaired if exact."""

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"image_id": [], "poly_id": [], "n": [], "verts": []})
        b = b.sort_values("seed_id")
        xy, ids = b[["x", "y"]].to_numpy(), b.seed_id.to_numpy()
        grid = kernels.plane(a.y, a.x, np.searchsorted(ids, a.seed_id.to_numpy()), int(a.y.max()) + 1, int(a.x.max()) + 1)
        polys = kernels.mesh(grid, xy, exact)
        rows = [[{"x": int(xy[s, 0]), "y": int(xy[s, 1]), "s": int(ids[s])} for s in p] for p in polys]
        return pd.DataFrame({"image_id": key[0], "poly_id": np.arange(len(polys)), "n": [len(p) for p in polys], "verts": rows})

    schema = "image_id long, poly_id long, n long, verts array<struct<x:long,y:long,s:long>>"
    return owner.groupBy("image_id").cogroup(seeds.groupBy("image_id")).applyInPandas(run, schema)


