import pytest

from meshframe import queries as q
from tests.parity import compare

FOLDER = "/root/testdata/sf0.001"
#: The rest is checked by the driver; these stand for each group of operators.
SOME = ["luma", "blur", "nms", "canny_auto", "canny_mask", "orient_remap", "interiors_meet", "map_px", "scan_png", "cell_quota", "voronoi_grid", "nearest_ring", "side_seeds", "key_polygon", "overlap_groups", "empty_circle",
    "polygon_spans", "polygon_sse", "color_mean", "split_points", "merge_candidates", "raster_owner", "box_down", "svg_paths", "shape_text"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    compare(spark, q.QUERIES[name], q.ORACLES[name], FOLDER)


def test_registry():
    assert len(q.QUERIES) >= 70 and set(q.ORACLES) <= set(q.QUERIES) and set(SOME) <= set(q.ORACLES)


def test_tiling_and_coverage_of_the_repaired_mesh(spark):
    from meshframe.functions import expr
    from meshframe.functions.fixtures import size
    from meshframe.operators import spans
    from pyspark.sql import functions as F

    polys = q._whole(spark, FOLDER).cache()
    sizes = {r["image_id"]: (r["w"], r["h"]) for r in size(spark, FOLDER).collect()}
    area = {r["image_id"]: r["a"] for r in polys.groupBy("image_id").agg(F.sum(expr.signed_area2(F.col("verts"))).alias("a")).collect()}
    assert len(sizes) == 10 and area == {k: 2 * (w - 1) * (h - 1) for k, (w, h) in sizes.items()}
    pixels = spans.polygon_pixels(spans.polygon_spans(polys, size(spark, FOLDER)))
    got = {r["image_id"]: (r["n"], r["places"]) for r in pixels.groupBy("image_id").agg(F.count("*").alias("n"), F.countDistinct("y", "x").alias("places")).collect()}
    assert got == {k: (w * h, w * h) for k, (w, h) in sizes.items()}


def test_flip_gain_of_the_relation_equals_the_kernel(spark):
    import numpy as np

    from meshframe.functions import kernels
    from meshframe.functions.fixtures import pixels
    from meshframe.operators.optimize import _mesh_of

    polys = q.key_polygons_of(spark, FOLDER).where("image_id = 3").toPandas()
    rgb = kernels.image(pixels(spark, FOLDER).where("image_id = 3").toPandas())
    seeds, rings = _mesh_of(polys)
    sums = kernels.Sums(rgb)
    for r in q.flip_candidates(spark, FOLDER).where("image_id = 3").limit(60).collect():
        one, two = rings[r["poly_a"]], rings[r["poly_b"]]
        c, d = (next(s for s in p if s not in (r["u"], r["v"])) for p in (one, two))
        after = sum(sums.error(seeds[list(kernels.triangle(seeds, *t))]) for t in ((c, d, r["u"]), (d, c, r["v"])))
        before = sums.error(seeds[list(one)]) + sums.error(seeds[list(two)])
        assert np.isclose(before - after, r["gain"], atol=2e-3)
