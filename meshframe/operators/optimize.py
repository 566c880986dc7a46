"""Error-driven changes of a mesh: what to split, flip, move or merge, as relations; the loops as kernels by image."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshframe.functions import expr, kernels
from meshframe.operators import mesh, spans


def worst_polygons(errors: DataFrame, k: int) -> DataFrame:
    """The k polygons of greatest error of each image, ties by number: each task keeps k of an image before the exchange."""
    rank = F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("sse"), "poly_id"))
    return errors.select("image_id", "poly_id", "sse").withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def split_points(polys: DataFrame, sums: DataFrame, pixels_of: DataFrame, pixels: DataFrame) -> DataFrame:
    """Where a polygon would be split: its pixels' centroid weighted by squared deviation from the mean colour.

    Kept in whole numbers (n times the deviation), so the order of summing cannot change a place.
    """
    s = sums.where("n > 0").select("image_id", "poly_id", "n", "sr", "sg", "sb")
    p = pixels_of.join(pixels, ["image_id", "y", "x"]).join(s, ["image_id", "poly_id"])
    off = [F.col("n") * F.col(c) - F.col("s" + c) for c in "rgb"]
    w = (off[0] * off[0] + off[1] * off[1] + off[2] * off[2]).cast("decimal(38,0)")
    out = p.groupBy("image_id", "poly_id").agg(F.sum(w).alias("w"), F.sum(w * F.col("x")).alias("wx"), F.sum(w * F.col("y")).alias("wy")).where("w > 0")
    at = lambda c: F.round(F.col(c).cast("double") / F.col("w").cast("double")).cast("bigint")
    return out.select("image_id", "poly_id", at("wx").alias("x"), at("wy").alias("y"))


def _corners(polys: DataFrame) -> DataFrame:
    e = polys.where("n = 3").select("image_id", "poly_id", F.posexplode(expr.edges(F.col("verts"))).alias("pos", "e"), "verts")
    third = F.get("verts", (F.col("pos") + 2) % 3)
    return e.select("image_id", "poly_id", F.least("e.u.s", "e.v.s").alias("u"), F.greatest("e.u.s", "e.v.s").alias("v"), third.alias("third"), F.when(F.col("e.u.s") < F.col("e.v.s"), F.col("e.u")).otherwise(F.col("e.v")).alias("pu"), F.when(F.col("e.u.s") < F.col("e.v.s"), F.col("e.v")).otherwise(F.col("e.u")).alias("pv"))


def shared_edges(polys: DataFrame) -> DataFrame:
    """Edges (u < v) of two triangles: the first two that hold it."""
    held = _corners(polys).groupBy("image_id", "u", "v").agg(F.array_sort(F.collect_list("poly_id")).alias("p")).where(F.size("p") >= 2)
    return held.select("image_id", "u", "v", F.get("p", F.lit(0)).alias("poly_a"), F.get("p", F.lit(1)).alias("poly_b"))


def _strict(a: Column, b: Column) -> Column:
    return ((a > 0) & (b < 0)) | ((a < 0) & (b > 0))


def flip_candidates(polys: DataFrame, sizes: DataFrame, rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Edges whose other diagonal lies inside the quad, with the error it would save."""
    side = _corners(polys)
    a = side.select("image_id", "u", "v", F.col("poly_id").alias("poly_a"), "pu", "pv", F.col("third").alias("c"))
    b = side.select("image_id", "u", "v", F.col("poly_id").alias("poly_b"), F.col("third").alias("d"))
    pair = shared_edges(polys).join(a, ["image_id", "u", "v", "poly_a"]).join(b, ["image_id", "u", "v", "poly_b"])
    A, B, C, D = (F.col(c) for c in ("pu", "pv", "c", "d"))
    quad = pair.where(_strict(expr.cross(C, D, A), expr.cross(C, D, B)) & _strict(expr.cross(A, B, C), expr.cross(A, B, D)))
    ring = lambda p, q, r: F.when(expr.cross(p, q, r) < 0, F.array(p, r, q)).otherwise(F.array(p, q, r))
    alt = quad.select("image_id", "u", "v", F.posexplode(F.array(ring(C, D, A), ring(D, C, B))).alias("half", "verts"))
    # each alternative is a polygon of its own, so the sums of polygons score it
    numbered = alt.withColumn("poly_id", F.xxhash64("u", "v", "half"))
    scored = spans.with_sse(spans.polygon_sums(numbered, spans.polygon_spans(numbered, sizes), rows)).select("image_id", "poly_id", "sse")
    after = numbered.join(scored, ["image_id", "poly_id"]).groupBy("image_id", "u", "v").agg(F.sum("sse").alias("after"))
    err = errors.select("image_id", "poly_id", "sse")
    before = quad.select("image_id", "u", "v", "poly_a", "poly_b").join(err.withColumnsRenamed({"poly_id": "poly_a", "sse": "ea"}), ["image_id", "poly_a"]).join(err.withColumnsRenamed({"poly_id": "poly_b", "sse": "eb"}), ["image_id", "poly_b"])
    return before.join(after, ["image_id", "u", "v"]).select("image_id", "u", "v", "poly_a", "poly_b", F.round(F.col("ea") + F.col("eb") - F.col("after"), 3).alias("gain"))


def merge_candidates(polys: DataFrame, sums: DataFrame, rel: float) -> DataFrame:
    """Pairs of triangles on an edge whose merging costs at most rel times the mean error (Ward's cost)."""
    s = spans.with_sse(sums)
    limit = s.groupBy("image_id").agg((rel * F.sum("sse") / F.count("*")).alias("most"))
    side = lambda t: s.where("n > 0").select("image_id", F.col("poly_id").alias(f"poly_{t}"), *(F.col(c).cast("double").alias(c + t) for c in ("n", "sr", "sg", "sb")))
    p = shared_edges(polys).join(side("a"), ["image_id", "poly_a"]).join(side("b"), ["image_id", "poly_b"]).join(limit, "image_id")
    gap = lambda c: F.col(c + "a") / F.col("na") - F.col(c + "b") / F.col("nb")
    cost = F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * (gap("sr") * gap("sr") + gap("sg") * gap("sg") + gap("sb") * gap("sb"))
    return p.withColumn("cost", cost).where("cost <= most").select("image_id", "poly_a", "poly_b", F.round("cost", 6).alias("cost"))


def move_candidates(polys: DataFrame, sizes: DataFrame, rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Single steps of a vertex that lower the error of its polygons while they stay convex over the same ground.

    A task holds the polygons and row sums of an image; a step is scored from the sums there, without a row for each of
    its polygons.
    """
    long = lambda df, *names: df.select("image_id", *(F.col(c).cast("bigint").alias(c) for c in names))
    mine = polys.select("image_id", "poly_id", "verts").join(errors.select("image_id", "poly_id", "sse"), ["image_id", "poly_id"]).join(long(sizes, "w", "h"), "image_id")

    def run(keys: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        seed, to, won = np.zeros(0, np.int64), np.zeros((0, 2), np.int64), np.zeros(0)
        if a.num_rows and b.num_rows:
            a = a.sort_by("poly_id")
            rings = a.column("verts").combine_chunks()
            n = pc.list_value_length(rings).to_numpy().astype(np.int64)
            corner = rings.flatten()
            x, y, s = (corner.field(c).to_numpy() for c in ("x", "y", "s"))
            names, first, at = np.unique(s, return_index=True, return_inverse=True)
            ids = np.full((len(n), int(n.max())), -1, np.int64)
            ids[np.arange(ids.shape[1]) < n[:, None]] = at
            sums = kernels.Sums.of_rows(a.column("w")[0].as_py(), a.column("h")[0].as_py(), *(b.column(c).to_numpy() for c in ("y", "x", "pr", "pg", "pb", "p2")))
            at, to, won = kernels.moves(sums, np.stack((x, y), 1)[first], ids, n, a.column("sse").to_numpy())
            seed = names[at]
        some = won > 1e-3
        image = np.full(int(some.sum()), keys[0].as_py(), np.int64)
        return pa.Table.from_arrays([pa.array(image), *(pa.array(c[some]) for c in (seed, to[:, 0], to[:, 1], won))], names=["image_id", "seed_id", "tx", "ty", "gain"])

    found = mine.groupBy("image_id").cogroup(long(rows, "y", "x", "pr", "pg", "pb", "p2").groupBy("image_id")).applyInArrow(run, "image_id long, seed_id long, tx long, ty long, gain double")
    return found.withColumn("gain", F.round("gain", 3))


# Loops, by image ------------------------------------------------------------------------------------------------------

VERTS = "array<struct<x:long,y:long,s:long>>"
POLYS = f"image_id long, poly_id long, n long, verts {VERTS}"


def _by_image(pixels: DataFrame, other: DataFrame, run, schema: str) -> DataFrame:
    def call(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = [x.split()[0] for x in schema.replace(VERTS, "v").split(", ")]
        if a.empty or b.empty:
            return pd.DataFrame({c: [] for c in names})
        return pd.DataFrame({"image_id": key[0], **run(kernels.image(a), b)})[names]

    return pixels.groupBy("image_id").cogroup(other.groupBy("image_id")).applyInPandas(call, schema)


def _mesh_of(b: pd.DataFrame) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """Seeds and polygons of poly rows; seed ids are dense in a mesh made here."""
    b = b.sort_values("poly_id")
    n = 1 + max(int(v["s"]) for ring in b.verts for v in ring)
    seeds = np.full((n, 2), -1, np.int64)
    for ring in b.verts:
        for v in ring:
            seeds[int(v["s"])] = v["x"], v["y"]
    return seeds, [tuple(int(v["s"]) for v in ring) for ring in b.verts]


def poly_rows(seeds: np.ndarray, polys: list[tuple[int, ...]]) -> dict:
    return {"poly_id": np.arange(len(polys)), "n": [len(p) for p in polys], "verts": [[{"x": int(seeds[s, 0]), "y": int(seeds[s, 1]), "s": s} for s in p] for p in polys]}


def refine(pixels: DataFrame, seeds: DataFrame, target: int, once: bool = False) -> DataFrame:
    """Seeds followed by new ones in the worst polygons, until `target` or for one round."""

    def run(rgb, b):
        start = b.sort_values("seed_id")[["x", "y"]].to_numpy()
        out = kernels.refine_round(rgb, kernels.Sums(rgb), start, target) if once else kernels.refine(rgb, start, target)
        return {"seed_id": np.arange(len(out)), "x": out[:, 0], "y": out[:, 1]}

    return _by_image(pixels, seeds, run, "image_id long, seed_id long, x long, y long")


def flip(pixels: DataFrame, polys: DataFrame) -> DataFrame:
    def run(rgb, b):
        seeds, p = _mesh_of(b)
        return poly_rows(seeds, kernels.flip(kernels.Sums(rgb), seeds, p)[0])

    return _by_image(pixels, polys, run, POLYS)


def relax(pixels: DataFrame, polys: DataFrame, rounds: int) -> DataFrame:
    def run(rgb, b):
        seeds, p = _mesh_of(b)
        return poly_rows(kernels.relax(kernels.Sums(rgb), seeds, p, rounds)[0], p)

    return _by_image(pixels, polys, run, POLYS)


def merge(pixels: DataFrame, polys: DataFrame, rel: float) -> DataFrame:
    def run(rgb, b):
        seeds, p = _mesh_of(b)
        return poly_rows(seeds, kernels.merge(kernels.Sums(rgb), seeds, p, rel))

    return _by_image(pixels, polys, run, POLYS)


def vertex_coloring(polys: DataFrame) -> DataFrame:
    """A class for each seed so that no two of a class share a polygon."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        seeds, p = _mesh_of(pdf)
        used = np.array(sorted({s for q in p for s in q}))
        return pd.DataFrame({"image_id": pdf.image_id.iloc[0], "seed_id": used, "color": kernels.vertex_classes(p, len(seeds))[used]})

    return polys.groupBy("image_id").applyInPandas(run, "image_id long, seed_id long, color long")
