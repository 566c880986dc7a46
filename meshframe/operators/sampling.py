"""Point sampling: summed areas, grids of cells, proportional quotas, seeded draws."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshframe.functions import expr, kernels


def zero() -> Column:
    return F.lit(0).cast("bigint")


def summed_area(mask: DataFrame) -> DataFrame:
    """s: edge pixels up to and with (y, x), by a running sum along rows and one along columns."""
    on = F.when(F.col("mask") != 0, 1).otherwise(0).cast("bigint")
    row = Window.partitionBy("image_id", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    col = Window.partitionBy("image_id", "x").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    return mask.select("image_id", "y", "x", F.sum(on).over(row).alias("a")).select("image_id", "y", "x", F.sum("a").over(col).alias("s"))


def level_cells(sizes: DataFrame, levels: int) -> DataFrame:
    """Cells of the grids of 1..levels; the last column and row take the rest."""
    at = lambda: F.explode(F.sequence(zero(), F.col("level") - 1))
    d = expr.int_div
    grid = sizes.withColumn("level", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(levels).cast("bigint"))))
    grid = grid.withColumns({"sw": F.greatest(d(F.col("w"), F.col("level")), F.lit(1).cast("bigint")), "sh": F.greatest(d(F.col("h"), F.col("level")), F.lit(1).cast("bigint"))})
    grid = grid.withColumn("gy", at()).withColumn("gx", at()).withColumns({"x0": F.col("gx") * F.col("sw"), "y0": F.col("gy") * F.col("sh")}).where("x0 < w AND y0 < h")
    last = lambda g, side, start, step: F.when(F.col(g) == F.col("level") - 1, F.col(side) - F.col(start)).otherwise(F.col(step))
    return grid.select("image_id", "level", "gy", "gx", "x0", "y0", last("gx", "w", "x0", "sw").alias("cw"), last("gy", "h", "y0", "sh").alias("ch"))


def cell_counts(cells: DataFrame, sat: DataFrame) -> DataFrame:
    """cnt: edge pixels of each cell from four corners of the summed areas."""
    out = cells.withColumns({"x1": F.col("x0") + F.col("cw") - 1, "y1": F.col("y0") + F.col("ch") - 1, "xb": F.col("x0") - 1, "yb": F.col("y0") - 1})
    for name, x, y in (("s11", "x1", "y1"), ("s01", "xb", "y1"), ("s10", "x1", "yb"), ("s00", "xb", "yb")):
        corner = sat.select("image_id", F.col("x").alias(x), F.col("y").alias(y), F.col("s").alias(name))
        out = out.join(corner, ["image_id", x, y], "left")
    n = F.col("s11") - F.coalesce("s01", zero()) - F.coalesce("s10", zero()) + F.coalesce("s00", zero())
    return out.select("image_id", "level", "gy", "gx", "x0", "y0", "cw", "ch", n.alias("cnt"))


def cell_quota(counts: DataFrame, points: int, levels: int, uniform: float) -> DataFrame:
    """quota: the level's share of points in proportion to edge pixels, the remainder carried in row-major order; at most 1024."""
    budget = int(points * (1 - uniform))
    w = Window.partitionBy("image_id", "level")
    upto = counts.withColumns({"c": F.sum("cnt").over(w.orderBy("gy", "gx")), "t": F.sum("cnt").over(w)}).where("t > 0")
    share = lambda c: expr.int_div(F.lit(budget).cast("bigint") * c, levels * F.col("t"))
    q = F.least(share(F.col("c")) - share(F.col("c") - F.col("cnt")), F.lit(1024).cast("bigint"))
    return upto.select("image_id", "level", "gy", "gx", "x0", "y0", "cw", "ch", "cnt", q.alias("quota")).where("quota > 0")


def cell_samples(quotas: DataFrame, seed: int) -> DataFrame:
    """k-th point of each cell, from the cell's own stream: order and partitions do not matter."""

    def run(batches):
        for pdf in batches:
            cells = pdf[["level", "gy", "gx", "x0", "y0", "cw", "ch", "quota"]].to_numpy(np.int64)
            at = np.repeat(np.arange(len(pdf)), cells[:, 7])
            xy = kernels.cell_samples(cells, seed)
            k = np.concatenate([np.arange(q) for q in cells[:, 7]]) if len(pdf) else at
            yield pd.DataFrame({"image_id": pdf.image_id.to_numpy()[at], "level": cells[at, 0], "gy": cells[at, 1], "gx": cells[at, 2], "k": k, "x": xy[:, 0], "y": xy[:, 1]})

    return quotas.mapInPandas(run, "image_id long, level long, gy long, gx long, k long, x long, y long")


def mix64(df: DataFrame, column: str) -> DataFrame:
    """The mixer over a BIGINT column, as BIGINT of the same bits."""

    @F.pandas_udf("bigint")
    def mixed(v: pd.Series) -> pd.Series:
        return pd.Series(kernels.mix64(v.to_numpy(np.int64).view(np.uint64)).view(np.int64))

    return df.withColumn("mixed", mixed(column))


def sample_points(mask: DataFrame, points: int, levels: int = 3, uniform: float = 0.1, seed: int = 1) -> DataFrame:
    """image_id, seed_id, x, y of all sampled points with the corners, by image."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m = kernels.plane(pdf.y, pdf.x, pdf["mask"], int(pdf.y.max()) + 1, int(pdf.x.max()) + 1)
        p = kernels.sample_points(m, points, levels, uniform, seed)
        return pd.DataFrame({"image_id": pdf.image_id.iloc[0], "seed_id": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1]})

    return mask.groupBy("image_id").applyInPandas(run, "image_id long, seed_id long, x long, y long")
