"""Nearest-seed joins: who owns each pixel. The smallest (squared distance, seed_id) wins, as one number."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshframe.functions import expr, kernels

_SHIFT = 1 << 32
#: Rows of pixels that a task of the row pass works on at once.
BAND = 32
#: Tasks that share an image when its pixels are compared with all seeds.
PARTS = 8
#: No seed yet: greater than any key, with room to add to it.
_NONE = 1 << 62


def _key(px: Column, py: Column, sx: Column, sy: Column, sid: Column) -> Column:
    return expr.dist2(px, py, sx, sy) * _SHIFT + sid


def _owned(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, (F.col("k") % _SHIFT).alias("seed_id"), F.shiftright("k", 32).alias("d2"))


def voronoi_brute(pixels: DataFrame, seeds: DataFrame) -> DataFrame:
    """image_id, y, x, seed_id, d2 by comparing pixels with the seeds of their image one by one: for comparison.

    A task holds a part of an image's pixels, bands of BAND rows dealt to PARTS, and all its seeds as three columns. A
    block of pixels meets the seeds in blocks, the nearest rows first; blocks in rows so far away that none of their seeds
    could win are passed over.
    """
    part = F.pmod(expr.floor_div(F.col("y"), F.lit(BAND)), F.lit(PARTS)).cast("bigint").alias("part")
    p = pixels.select("image_id", part, F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"))
    s = seeds.select("image_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))).alias("part"), F.col("y").cast("bigint").alias("y"), F.col("x").cast("bigint").alias("x"), F.col("seed_id").cast("bigint").alias("s"))

    def run(keys: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        k = np.zeros(0, np.int64)
        y, x = a.column("y").to_numpy(), a.column("x").to_numpy()
        if not b.num_rows:
            y, x = y[:0], x[:0]
        elif len(y):
            order = np.lexsort((x, y))
            y, x = y[order], x[order]
            k = kernels.least_keys(y, x, b.column("y").to_numpy(), b.column("x").to_numpy(), b.column("s").to_numpy())
        image = np.full(len(y), keys[0].as_py(), np.int64)
        return pa.Table.from_arrays([pa.array(image), pa.array(y), pa.array(x), pa.array(k & (_SHIFT - 1)), pa.array(k >> 32)], names=["image_id", "y", "x", "seed_id", "d2"])

    return p.groupBy("image_id", "part").cogroup(s.groupBy("image_id", "part")).applyInArrow(run, "image_id long, y long, x long, seed_id long, d2 long")


def seed_bins(seeds: DataFrame, sizes: DataFrame) -> DataFrame:
    """Seeds with the side g of a bin and their bin."""
    n = seeds.groupBy("image_id").agg(F.count("*").alias("n"))
    side = F.least(F.greatest(F.round(F.sqrt(2.0 * F.col("w") * F.col("h") / F.col("n"))), F.lit(4)), F.lit(64)).cast("bigint")
    g = sizes.join(n, "image_id").select("image_id", side.alias("g"))
    return seeds.join(g, "image_id").withColumns({"bx": expr.int_div(F.col("x"), F.col("g")), "by": expr.int_div(F.col("y"), F.col("g"))})


def nearest_ring(pixels: DataFrame, seeds: DataFrame, sizes: DataFrame) -> DataFrame:
    """The same rows by bins in growing rings: a pixel is settled once no farther ring can hold a nearer seed.

    Each round equi-joins the open pixels with the bins up to RINGS around theirs; then bins double their side, so a round
    costs the same number of bins for each open pixel and rounds grow with the logarithm of the largest empty distance.
    What is open and what is settled is cut, so no round repeats another. For whole images voronoi_grid is the way.
    """
    from meshframe.plans.loops import cut

    binned = seed_bins(seeds, sizes).select("image_id", "g", "seed_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    g = sizes.join(binned.select("image_id", "g").distinct(), "image_id").select("image_id", "g", F.greatest("w", "h").alias("span"))
    open_ = cut(pixels.select("image_id", "y", "x").distinct().join(g, "image_id"))
    done, times = None, 1
    around = F.explode(F.sequence(F.lit(-RINGS), F.lit(RINGS)))
    while True:
        side = F.col("g") * times
        bins = binned.select("image_id", expr.int_div(F.col("sx"), side).alias("bx"), expr.int_div(F.col("sy"), side).alias("by"), "sx", "sy", "seed_id")
        probe = open_.withColumn("ox", around).withColumn("oy", around).withColumns({"bx": expr.int_div(F.col("x"), side) + F.col("ox"), "by": expr.int_div(F.col("y"), side) + F.col("oy")})
        met = probe.join(bins, ["image_id", "bx", "by"])
        best = met.groupBy("image_id", "y", "x", "g", "span").agg(F.min(_key(F.col("x"), F.col("y"), F.col("sx"), F.col("sy"), F.col("seed_id"))).alias("k"))
        # seeds outside these rings are farther than so many bins less the place in the own bin
        reach = F.col("g") * (times * RINGS) + 1
        sure = cut(best.where((F.shiftright("k", 32) < reach * reach) | (reach > F.col("span"))))
        now = _owned(sure, "image_id", "y", "x")
        done = now if done is None else done.unionByName(now)
        # where the rings have covered the image, pixels without a seed have none
        open_ = cut(open_.where(reach <= F.col("span")).join(sure.select("image_id", "y", "x"), ["image_id", "y", "x"], "left_anti"))
        if open_.isEmpty():
            return done
        times *= 2


RINGS = 2


def voronoi_grid(pixels: DataFrame, seeds: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The same rows for whole images, by columns and then by rows: a distance transform in two exchanges.

    Down each column a window finds the nearest seed of that column; along each row the owner of a pixel is among the
    columns' nearest ones, as the least of (dx^2 + dy^2, seed_id). pixels: all pixels of each image; sizes, as
    nearest_ring takes them, are not needed.
    """
    places = seeds.groupBy("image_id", "x", "y").agg(F.min("seed_id").alias("seed_id"))
    both = pixels.select("image_id", "x", "y", F.lit(None).cast("struct<y:bigint,s:bigint>").alias("at")).unionByName(
        places.select("image_id", "x", "y", F.struct(F.col("y").cast("bigint").alias("y"), F.col("seed_id").cast("bigint").alias("s")).alias("at"))
    )
    column = Window.partitionBy("image_id", "x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumns({"up": F.last("at", ignorenulls=True).over(column.orderBy("y")), "down": F.last("at", ignorenulls=True).over(column.orderBy(F.desc("y")))}).where("at IS NULL")
    key = lambda c: (F.col(c)["y"] - F.col("y")) * (F.col(c)["y"] - F.col("y")) * _SHIFT + F.col(c)["s"]
    keyed = seen.select("image_id", "y", "x", F.least(key("up"), key("down")).alias("k"), expr.int_div(F.col("y"), F.lit(BAND)).alias("band"))

    def run(keys: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        y, x = got.column("y").to_numpy(), got.column("x").to_numpy()
        own = np.full((BAND, int(x.max()) + 1), _NONE, np.int64)
        own[y % BAND, x] = got.column("k").fill_null(_NONE).to_numpy()
        best = own.copy()
        for dx in range(1, own.shape[1]):
            # no column so far away holds a nearer seed, nor one as near
            if dx * dx > best.max() >> 32:
                break
            more = dx * dx << 32
            np.minimum(best[:, dx:], own[:, :-dx] + more, out=best[:, dx:])
            np.minimum(best[:, :-dx], own[:, dx:] + more, out=best[:, :-dx])
        k = best[y % BAND, x]
        some = k < _NONE
        image = np.full(int(some.sum()), keys[0].as_py(), np.int64)
        return pa.Table.from_arrays([pa.array(image), pa.array(y[some]), pa.array(x[some]), pa.array(k[some] & (_SHIFT - 1)), pa.array(k[some] >> 32)], names=["image_id", "y", "x", "seed_id", "d2"])

    return keyed.groupBy("image_id", "band").applyInArrow(run, "image_id long, y long, x long, seed_id long, d2 long")


def voronoi_jfa(sizes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Jump flooding by image; approximate."""

    def run(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"image_id": [], "y": [], "x": [], "seed_id": []}).astype("int64")
        b = b.sort_values("seed_id")
        h, w = int(a.h.iloc[0]), int(a.w.iloc[0])
        owner = kernels.jump_flood(w, h, b[["x", "y"]].to_numpy())
        y, x = np.indices((h, w))
        return pd.DataFrame({"image_id": key[0], "y": y.ravel(), "x": x.ravel(), "seed_id": b.seed_id.to_numpy()[owner.ravel()]})

    return sizes.groupBy("image_id").cogroup(seeds.groupBy("image_id")).applyInPandas(run, "image_id long, y long, x long, seed_id long")


def side_seeds(seeds: DataFrame, sizes: DataFrame) -> DataFrame:
    """Seeds followed by the projections of border pixels' owners to their side, each place once, in border order."""
    x = sizes.select("image_id", "w", "h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("w") - 1)).alias("i"))
    y = sizes.select("image_id", "w", "h", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("h") - 1)).alias("i"))
    zero = F.lit(0).cast("bigint")
    flat = lambda df, px, py, turn, across: df.select("image_id", px.alias("x"), py.alias("y"), F.lit(across).alias("across"), turn.alias("turn"))
    i = F.col("i")
    border = flat(x, i, zero, 2 * i, True).unionByName(flat(x, i, F.col("h") - 1, 2 * i + 1, True))
    border = border.unionByName(flat(y, zero, i, 2 * F.col("w") + 2 * i, False)).unionByName(flat(y, F.col("w") - 1, i, 2 * F.col("w") + 2 * i + 1, False))
    every = y.select("image_id", "w", F.col("i").alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("w") - 1)).alias("x"))
    owners = voronoi_grid(every, seeds).join(seeds.select("image_id", "seed_id", F.col("x").alias("sx"), F.col("y").alias("sy")), ["image_id", "seed_id"])
    put = border.join(owners.select("image_id", "y", "x", "sx", "sy"), ["image_id", "y", "x"]).select(
        "image_id", F.when(F.col("across"), F.col("sx")).otherwise(F.col("x")).alias("x"), F.when(F.col("across"), F.col("y")).otherwise(F.col("sy")).alias("y"), "turn"
    )
    fresh = put.groupBy("image_id", "x", "y").agg(F.min("turn").alias("turn")).join(seeds, ["image_id", "x", "y"], "left_anti")
    n = seeds.groupBy("image_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("image_id").orderBy("turn")
    return seeds.select("image_id", "seed_id", "x", "y").unionByName(fresh.join(n, "image_id").select("image_id", (F.col("n") + F.row_number().over(w) - 1).alias("seed_id"), "x", "y"))
