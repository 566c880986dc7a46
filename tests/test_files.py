import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshframe.operators import nearest, stencil
from meshframe.plans.pipeline import Params
from meshframe.sources import files
from meshframe.streaming.images import reduce_stream


def tiny():
    i = np.arange(35)
    return np.stack([i % 256, 3 * i % 256, 7 * i % 256], 1).reshape(5, 7, 3).astype(np.uint8)


def test_round_trips():
    r = np.random.default_rng(1)
    for h, w in ((5, 7), (1, 1), (33, 64), (97, 101)):
        a = r.integers(0, 256, (h, w, 3)).astype(np.uint8)
        assert (files.decode_ppm(files.encode_ppm(a)) == a).all() and (files.decode_png(files.encode_png(a)) == a).all()
    with pytest.raises(ValueError):
        files.encode_png(np.zeros((0, 0, 3), np.uint8))


def test_bitmaps_and_targas():
    r = np.random.default_rng(2)
    for h, w in ((1, 1), (5, 7), (4, 6), (33, 64)):
        a = r.integers(0, 256, (h, w, 3)).astype(np.uint8)
        for encode in (files.encode_bmp, files.encode_tga):
            raw = encode(a)
            assert (files.decode(raw) == a).all()
            with pytest.raises(ValueError):
                files.decode(raw[:-1])
    a = r.integers(0, 256, (2, 3, 4)).astype(np.uint8)
    turned = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 3, -2, 1, 32, 0, 0, 0, 0, 0, 0) + a.tobytes()
    assert (files.decode(turned) == a[:, :, 2::-1]).all()
    low = struct.pack("<BBB5xHHHHBB", 2, 0, 2, 0, 0, 3, 2, 32, 8) + b"id" + a.tobytes()
    assert (files.decode(low) == a[::-1, :, 2::-1]).all()
    grey = struct.pack("<BBB5xHHHHBB", 0, 0, 3, 0, 0, 3, 2, 8, 0x30) + bytes(range(6))
    assert files.decode(grey)[:, :, 0].tolist() == [[2, 1, 0], [5, 4, 3]]
    for encode in (files.encode_bmp, files.encode_tga):
        with pytest.raises(ValueError):
            encode(np.zeros((0, 0, 3), np.uint8))
    with pytest.raises(ValueError):
        files.decode(b"BM" + b"\0" * 60)


def test_pixmap_headers():
    assert (files.decode_ppm(b"P5\n# note\n2 1\n255\n\x07\x09") == [[[7] * 3, [9] * 3]]).all()
    assert files.decode_ppm(b"GIF89a") is None
    for bad in (b"P6\n2 2\n255\nxx", b"P6\n2 2\n65535\n" + b"x" * 99, b"P6\n0 2\n255\n"):
        with pytest.raises(ValueError):
            files.decode_ppm(bad)
    with pytest.raises(ValueError):
        files.decode(b"no image")


def jpeg(tag, order):
    e = {"II": "<", "MM": ">"}[order]
    tiff = order.encode() + struct.pack(e + "HI", 42, 8) + struct.pack(e + "H", 2) + struct.pack(e + "HHIHH", 0x0100, 3, 1, 9, 0) + struct.pack(e + "HHIHH", 0x0112, 3, 1, tag, 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xd9"


def test_orientation_tags():
    for tag in (1, 6, 8):
        for order in ("II", "MM"):
            assert files.jpeg_orientation(jpeg(tag, order)) == tag
    assert files.jpeg_orientation(jpeg(9, "II")) == 1
    for n in range(len(jpeg(6, "MM")) - 2):
        assert files.jpeg_orientation(jpeg(6, "MM")[:n]) in (1, 6)
    assert files.jpeg_orientation(b"\xff\xd8\xff") == 1


def frame(spark, rgb, image_id=0):
    h, w = rgb.shape[:2]
    rows = [(image_id, y, x, *(int(c) for c in rgb[y, x])) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "image_id long, y long, x long, r long, g long, b long")


def test_orientations_of_a_small_image(spark):
    rgb = np.stack([40 * np.arange(6) + 10, np.arange(6), np.zeros(6)], 1).reshape(2, 3, 3).astype(np.uint8)
    flips = {1: rgb, 2: rgb[:, ::-1], 3: rgb[::-1, ::-1], 4: rgb[::-1], 5: rgb.transpose(1, 0, 2), 6: np.rot90(rgb, -1), 7: np.rot90(rgb, 2).transpose(1, 0, 2), 8: np.rot90(rgb), 0: rgb, 9: rgb}
    for tag, want in flips.items():
        got = {(r["y"], r["x"]): r["r"] for r in stencil.orient(frame(spark, rgb), F.lit(tag), F.lit(3), F.lit(2)).collect()}
        assert got == {(y, x): int(want[y, x, 0]) for y in range(want.shape[0]) for x in range(want.shape[1])}, tag


def test_folder_of_images_and_stream(spark, tmp_path):
    folder = tmp_path / "ünï"
    folder.mkdir()
    y, x = np.indices((24, 30))
    big = np.stack([x * 8, y * 9, (x + y) * 4], 2).astype(np.uint8)
    (folder / "a.ppm").write_bytes(files.encode_ppm(big))
    (folder / "b.png").write_bytes(files.encode_png(tiny()))
    got = {r["path"][-5:]: r for r in files.read_images(spark, str(folder)).collect()}
    assert bytes(got["a.ppm"]["data"]) == big.tobytes() and (got["b.png"]["w"], got["b.png"]["h"]) == (7, 5)
    (folder / "b.png").unlink()
    reduce_stream(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "check"), Params(points=40)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() > 10


def test_photos_through_the_image_source(spark, tmp_path):
    (tmp_path / "b.png").write_bytes(files.encode_png(tiny()))
    got = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in files.read_photos(spark, str(tmp_path)).collect()}
    assert got == {(y, x): tuple(int(c) for c in tiny()[y, x]) for y in range(5) for x in range(7)}


def test_sinks(spark, tmp_path):
    names = files.save_images(frame(spark, tiny(), 3), f"{tmp_path}/ö-{{}}.png")
    assert names == [f"{tmp_path}/ö-3.png"] and (files.decode_png(open(names[0], "rb").read()) == tiny()).all()
    for kind in ("bmp", "tga"):
        assert (files.decode(open(files.save_images(frame(spark, tiny(), 3), f"{tmp_path}/{{}}.{kind}")[0], "rb").read()) == tiny()).all()
    sizes = spark.createDataFrame([(3, 7, 5)], "image_id long, w long, h long")
    shapes = spark.createDataFrame([(3, 1, "<path b/>", "Qua\n"), (3, 0, "<path a/>", "Tri\n")], "image_id long, poly_id long, path string, shape string")
    assert open(files.save_shapes(shapes, sizes, f"{tmp_path}/{{}}.svg", 2.0)[0]).read().splitlines()[2:4] == ["<path a/>", "<path b/>"]
    assert open(files.save_shapes(shapes, sizes, f"{tmp_path}/{{}}.txt")[0]).read() == "P6\n7 5\n255\n2\nTri\nQua\n"
    for bad in ("x", "x.heic"):
        with pytest.raises(ValueError):
            files.kind_of(bad)


def test_closed_line_of_a_ring(spark):
    from meshframe.operators import raster

    ring = spark.createDataFrame([(0, 0, 0, 0), (0, 1, 4, 0), (0, 2, 4, 3), (0, 3, 0, 3)], "image_id long, pos long, x long, y long")
    got = {(r["x"], r["y"]) for r in raster.closed_lines(ring).collect()}
    assert got == {(x, y) for x in range(5) for y in range(4) if x in (0, 4) or y in (0, 3)}


def test_documents():
    svg = files.svg_document(['<path d="M0 0l2 0 0 2z" color="#fff"/>'], 10, 8, 20, 16)
    assert 'viewBox="0 0 20 16"' in svg and 'stroke-width="1"' in svg and svg.count("<path") == 1
    assert files.text_document(["Tri\n"], 3, 2) == "P6\n3 2\n255\n1\nTri\n"


def test_images_do_not_leak_into_each_other(spark):
    r = np.random.default_rng(2)
    images = [r.integers(0, 256, (14, 18, 3)).astype(np.uint8) for _ in range(2)]
    both = frame(spark, images[0], 0).unionByName(frame(spark, images[1], 1))
    masks = {i: sorted((r["y"], r["x"], r["mask"]) for r in stencil.canny(both, 20, 60, auto=True).where(f"image_id = {i}").collect()) for i in (0, 1)}
    for i in (0, 1):
        alone = stencil.canny(frame(spark, images[i], i), 20, 60, auto=True).collect()
        assert sorted((r["y"], r["x"], r["mask"]) for r in alone) == masks[i]
    seeds = spark.createDataFrame([(0, 0, 3, 3), (0, 1, 9, 9), (1, 0, 16, 2)], "image_id long, seed_id long, x long, y long")
    sizes = spark.createDataFrame([(0, 18, 14), (1, 18, 14)], "image_id long, w long, h long")
    a = sorted(map(tuple, nearest.voronoi_brute(both, seeds).collect()))
    assert a == sorted(map(tuple, nearest.voronoi_grid(both, seeds, sizes).collect())) == sorted(map(tuple, nearest.nearest_ring(both, seeds, sizes).collect()))


def test_relational_hull_equals_the_kernel(spark):
    from meshframe.functions import expr, kernels

    r = np.random.default_rng(7)
    rows = []
    for i in range(300):
        pts = {tuple(p) for p in r.integers(0, 5, (4, 2)).tolist()}
        rows.append((i, [(int(x), int(y), k) for k, (x, y) in enumerate(sorted(pts))]))
    df = spark.createDataFrame(rows, "id long, v array<struct<x:long,y:long,s:long>>")
    for row in df.select("id", expr.hull(F.col("v")).alias("h")).collect():
        want = kernels.hull([(x, y) for x, y, _ in rows[row["id"]][1]])
        if len(want) >= 3:
            assert [(p["x"], p["y"]) for p in row["h"]] == want
        else:
            assert len(row["h"]) < 3
