"""Edge detection: separable window stencils, classification and reachability.

Every stencil is two window passes, one along rows and one along columns, so an image of any size is worked on row by
row and column by column; window partitions are single rows or columns, never whole images.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshframe.functions import expr, kernels



def row():
    return Window.partitionBy("image_id", "y").orderBy("x")


def col():
    return Window.partitionBy("image_id", "x").orderBy("y")


def _tap5(v: str, w) -> Column:
    """Weights 1 4 6 4 1, the ends repeated."""
    back, ahead = F.lag(v, 1).over(w), F.lead(v, 1).over(w)
    return F.coalesce(F.lag(v, 2).over(w), back, F.col(v)) + 4 * F.coalesce(back, F.col(v)) + 6 * F.col(v) + 4 * F.coalesce(ahead, F.col(v)) + F.coalesce(F.lead(v, 2).over(w), ahead, F.col(v))


def luma(pixels: DataFrame) -> DataFrame:
    return pixels.select("image_id", "y", "x", expr.luma(F.col("r"), F.col("g"), F.col("b")).alias("luma"))


def blur_h(lumas: DataFrame) -> DataFrame:
    return lumas.select("image_id", "y", "x", _tap5("luma", row()).alias("bh"))


def blur(lumas: DataFrame) -> DataFrame:
    return blur_h(lumas).select("image_id", "y", "x", F.shiftright(_tap5("bh", col()), 8).alias("blur"))


def sobel(blurred: DataFrame) -> DataFrame:
    """mag2 and the sector of the gradient: 0 along x, 2 along y, 1 and 3 the diagonals."""
    near = lambda v, k, w: F.coalesce((F.lag if k < 0 else F.lead)(v, 1).over(w), F.col(v))
    cols = blurred.select("image_id", "y", "x", (near("blur", -1, col()) + 2 * F.col("blur") + near("blur", 1, col())).alias("s"), (near("blur", 1, col()) - near("blur", -1, col())).alias("d"))
    grad = cols.select("image_id", "y", "x", (near("s", 1, row()) - near("s", -1, row())).alias("dx"), (near("d", -1, row()) + 2 * F.col("d") + near("d", 1, row())).alias("dy"))
    ax, ay = F.abs("dx"), F.abs("dy")
    sector = F.when(1000 * ay <= 414 * ax, 0).when(1000 * ay >= 2414 * ax, 2).when((F.col("dx") >= 0) == (F.col("dy") >= 0), 1).otherwise(3)
    return grad.select("image_id", "y", "x", (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("mag2"), sector.cast("bigint").alias("dir"))


def nms(gradient: DataFrame) -> DataFrame:
    """v: mag2 where no neighbour along the gradient exceeds it, else 0; 0 on the border."""
    up = gradient.withColumns({"u": F.lag("mag2").over(col()), "d": F.lead("mag2").over(col())})
    at = lambda v, k: (F.lag if k < 0 else F.lead)(v, 1).over(row())
    near = up.withColumns({"l": at("mag2", -1), "rr": at("mag2", 1), "ul": at("u", -1), "ur": at("u", 1), "dl": at("d", -1), "dr": at("d", 1)})
    a = F.when(F.col("dir") == 0, F.col("l")).when(F.col("dir") == 1, F.col("ul")).when(F.col("dir") == 2, F.col("u")).otherwise(F.col("ur"))
    b = F.when(F.col("dir") == 0, F.col("rr")).when(F.col("dir") == 1, F.col("dr")).when(F.col("dir") == 2, F.col("d")).otherwise(F.col("dl"))
    inner = F.col("u").isNotNull() & F.col("d").isNotNull() & F.col("l").isNotNull() & F.col("rr").isNotNull()
    return near.select("image_id", "y", "x", F.when(inner & (F.col("mag2") >= a) & (F.col("mag2") >= b), F.col("mag2")).otherwise(F.lit(0)).cast("bigint").alias("v"))


def classify(ridges: DataFrame, low: float, high: float) -> DataFrame:
    """cls: 2 strong, 1 weak, 0 none."""
    cls = F.when(F.col("v") >= int(high * high), 2).when(F.col("v") >= int(low * low), 1).otherwise(0)
    return ridges.select("image_id", "y", "x", cls.cast("bigint").alias("cls"))


def auto_thresholds(ridges: DataFrame) -> DataFrame:
    """image_id, high2, low2: the order statistic at 85 % of an image's positive ridges.

    The rank is looked up in a histogram of the values (partial counts, then a running sum over distinct values), so no
    task sorts all pixels of an image.
    """
    counts = ridges.where("v > 0").groupBy("image_id", "v").count()
    w = Window.partitionBy("image_id")
    ranked = counts.withColumns({"n": F.sum("count").over(w), "upto": F.sum("count").over(w.orderBy("v"))})
    picked = ranked.where(F.col("upto") > F.floor((F.col("n") - 1) * 0.85)).groupBy("image_id").agg(F.min("v").alias("v"))
    high = F.greatest(F.lit(1).cast("bigint"), F.coalesce("v", F.lit(1).cast("bigint")))
    every = ridges.select("image_id").distinct().join(picked, "image_id", "left")
    return every.select("image_id", high.alias("high2"), F.floor(high * 0.16).cast("bigint").alias("low2"))


def classify_auto(ridges: DataFrame) -> DataFrame:
    t = ridges.join(auto_thresholds(ridges), "image_id")
    return t.select("image_id", "y", "x", F.when(F.col("v") >= F.col("high2"), 2).when(F.col("v") >= F.col("low2"), 1).otherwise(0).cast("bigint").alias("cls"))


def hysteresis(classes: DataFrame) -> DataFrame:
    """mask: 255 for strong pixels and weak ones that reach a strong one through weak ones, by image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, w = int(pdf.y.max()) + 1, int(pdf.x.max()) + 1
        grid = kernels.plane(pdf.y, pdf.x, pdf.cls, h, w)
        return pd.DataFrame({"image_id": pdf.image_id, "y": pdf.y, "x": pdf.x, "mask": kernels.hysteresis(grid)[pdf.y, pdf.x].astype("int64")})

    return classes.groupBy("image_id").applyInPandas(run, "image_id long, y long, x long, mask long")


def canny(pixels: DataFrame, low: float = 20, high: float = 60, auto: bool = False) -> DataFrame:
    ridges = nms(sobel(blur(luma(pixels))))
    return hysteresis(classify_auto(ridges) if auto else classify(ridges, low, high))


def canny_float(pixels: DataFrame, low: float, high: float) -> DataFrame:
    """The 32-bit floating variant, by image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rgb = kernels.image(pdf)
        mask = kernels.hysteresis(kernels.float_classes(rgb, low, high))
        return pd.DataFrame({"image_id": pdf.image_id, "y": pdf.y, "x": pdf.x, "mask": mask[pdf.y, pdf.x].astype("int64")})

    return pixels.groupBy("image_id").applyInPandas(run, "image_id long, y long, x long, mask long")


def orient(pixels: DataFrame, exif: Column, w: Column, h: Column) -> DataFrame:
    """Pixels where an orientation tag wants them; tags out of 1..8 change nothing."""
    x, y = F.col("x"), F.col("y")
    nx = F.when(exif.isin(2, 3), w - 1 - x).when(exif.isin(5, 8), y).when(exif.isin(6, 7), h - 1 - y).otherwise(x)
    ny = F.when(exif.isin(3, 4), h - 1 - y).when(exif.isin(5, 6), x).when(exif.isin(7, 8), w - 1 - x).otherwise(y)
    return pixels.select("image_id", ny.alias("y"), nx.alias("x"), "r", "g", "b")
