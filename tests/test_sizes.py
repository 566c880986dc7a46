"""Queries over pictures of different heights, many seeds and few of them."""

import os

import numpy as np
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from meshframe import queries as q
from meshframe.functions import kernels
from meshframe.operators import nearest, raster
from tests.parity import compare
from tests.test_parity import FOLDER


@pytest.fixture(scope="module")
def uneven(tmp_path_factory):
    """Pictures of 13 and of 12 rows."""
    folder = str(tmp_path_factory.mktemp("uneven"))
    e = pq.read_table(f"{FOLDER}/embeddings.parquet")
    pq.write_table(e.filter(pc.less(e["vec_id"], 125)), f"{folder}/embeddings.parquet")
    os.symlink(f"{FOLDER}/orders.parquet", f"{folder}/orders.parquet")
    return folder


def test_pictures_of_different_heights_are_scaled_by_their_own(spark, uneven):
    compare(spark, q.QUERIES["render_scaled"], q.ORACLES["render_scaled"], uneven)


def ranged_joins(df):
    """Joins of the plan whose condition is more than equalities: they compare all pairs of a key. Extents (gx0) are a row an image."""
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in line and "gx0" not in line and (">=" in line or "<=" in line)]


def test_a_mesh_is_filled_without_pairs_of_all_polygons_and_pixels(spark, uneven):
    compare(spark, q.QUERIES["raster_naive"], q.ORACLES["raster_naive"], uneven)
    polys, colours, grid = (spark.range(3000).selectExpr("id div 1500 AS image_id", "id % 1500 AS poly_id", *more) for more in (
        ["array(named_struct('x', id % 1500, 'y', 0L, 's', 0L), named_struct('x', id % 1500 + 1, 'y', 0L, 's', 1L), named_struct('x', id % 1500 + 1, 'y', 1L, 's', 2L)) AS verts"],
        ["id % 1500 % 200 AS r", "0L AS g", "0L AS b"], ["id % 1500 AS x", "0L AS y"],
    ))
    out = raster.raster_naive(polys, colours, grid.drop("poly_id"))
    assert sorted(out.select("image_id", "x", "r").collect()) == [(k, x, x % 200) for k in (0, 1) for x in range(1500)]
    assert not ranged_joins(out)


def test_brute_owners_of_many_seeds(spark):
    """3000 places of 64 x 300 and a few ids twice at a place; the array of all seeds is never in a row of pixels."""
    pixels = spark.range(64 * 300).selectExpr("0L AS image_id", "id div 64 AS y", "id % 64 AS x")
    seeds = spark.range(3000).selectExpr("0L AS image_id", "2999 - id AS seed_id", "id * 37 % 64 AS x", "id * id * 31 % 300 AS y")
    brute = nearest.voronoi_brute(pixels, seeds)
    assert brute.columns == ["image_id", "y", "x", "seed_id", "d2"]
    grid = nearest.voronoi_grid(pixels, seeds)
    assert sorted(brute.collect()) == sorted(grid.collect()) and brute.count() == 64 * 300
    assert "array<struct<" not in brute._jdf.queryExecution().analyzed().treeString() and "collect_list" not in brute._jdf.queryExecution().analyzed().treeString()
    assert nearest.voronoi_brute(pixels, seeds.where("seed_id < 0")).count() == 0


def test_least_keys_equal_all_pairs():
    r = np.random.default_rng(3)
    for n, far in ((1, 10), (40, 10), (3000, 200), (3000, 40_000)):
        y, x = np.sort(r.integers(-5, 900, 1300)), r.integers(0, 70, 1300)
        sy, sx, ids = r.integers(0, far, n), r.integers(0, 70, n), r.permutation(n) * 7
        want = (((y[:, None] - sy) ** 2 + (x[:, None] - sx) ** 2 << 32) + ids).min(1)
        assert (kernels.least_keys(y, x, sy, sx, ids) == want).all()


def test_moves_are_found_without_a_row_for_each_try(spark, uneven):
    compare(spark, q.QUERIES["move_candidates"], q.ORACLES["move_candidates"], uneven)
    moves = q.QUERIES["move_candidates"](spark, uneven)
    plan = moves._jdf.queryExecution().analyzed().treeString()
    assert "collect_list" not in plan and "rings" not in plan
