"""Registered queries of the raster, point and mesh operators over the fixtures, and their SQL.

Meshes are made of the owners of scattered seeds and corners: junction keys, their hulls, and all that follows. Every
query is defined once as a DataFrame and, where SQL can say it, once as SQL for another engine.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshframe.functions import expr
from meshframe.functions.fixtures import CORNER_SQL, IMAGES, PIX_SQL, SEED_SQL, SIZE_SQL, corner_seeds, pixels, seeds, size
from meshframe.functions.kernels import STEPS
from meshframe.operators import mesh, nearest, optimize, raster, sampling, spans, stencil
from meshframe.plans.loops import cut, ship
from meshframe.plans.pipeline import PLAIN, Params, reduce_images
from meshframe.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOW, HIGH = 20, 60
LEVELS, POINTS, UNIFORM, SEED = 4, 800, 0.1, 7


def query(sql: str | None = None):
    """Registers a query under the function's name; sql: its oracle."""

    def put(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def with_(ctes: str, select: str) -> str:
    """The query for each picture, one after another."""
    one = f"WITH {ctes}\n{select}"
    return "\nUNION ALL\n".join(f"SELECT * FROM ({one.replace('@IMG@', str(k))}) AS t{k}" for k in range(IMAGES)) if "@IMG@" in one else one


# Expressions and stencils ---------------------------------------------------------------------------------------------

LUMA_SQL = PIX_SQL + ", l AS (SELECT y, x, (77 * r + 150 * g + 29 * b) >> 8 AS luma FROM pix)"
BLUR_H_SQL = LUMA_SQL + """, bh AS (SELECT y, x, coalesce(lag(luma, 2) OVER w, lag(luma) OVER w, luma) + 4 * coalesce(lag(luma) OVER w, luma) + 6 * luma
  + 4 * coalesce(lead(luma) OVER w, luma) + coalesce(lead(luma, 2) OVER w, lead(luma) OVER w, luma) AS bh FROM l WINDOW w AS (PARTITION BY y ORDER BY x))"""
BLUR_SQL = BLUR_H_SQL + """, bl AS (SELECT y, x, (coalesce(lag(bh, 2) OVER w, lag(bh) OVER w, bh) + 4 * coalesce(lag(bh) OVER w, bh) + 6 * bh
  + 4 * coalesce(lead(bh) OVER w, bh) + coalesce(lead(bh, 2) OVER w, lead(bh) OVER w, bh)) >> 8 AS blur FROM bh WINDOW w AS (PARTITION BY x ORDER BY y))"""
SOBEL_SQL = BLUR_SQL + """, lim AS (SELECT max(x) AS mx, max(y) AS my FROM bl),
nb AS (SELECT c.y, c.x, dx, dy, n.blur AS v FROM bl AS c, lim, (VALUES (-1), (0), (1)) AS a(dx), (VALUES (-1), (0), (1)) AS b(dy), bl AS n
  WHERE n.x = least(greatest(c.x + dx, 0), mx) AND n.y = least(greatest(c.y + dy, 0), my)),
gr AS (SELECT y, x, cast(sum(dx * (CASE WHEN dy = 0 THEN 2 ELSE 1 END) * v) AS bigint) AS gx, cast(sum(dy * (CASE WHEN dx = 0 THEN 2 ELSE 1 END) * v) AS bigint) AS gy FROM nb GROUP BY y, x),
sob AS (SELECT y, x, gx * gx + gy * gy AS mag2, cast(CASE WHEN 1000 * abs(gy) <= 414 * abs(gx) THEN 0 WHEN 1000 * abs(gy) >= 2414 * abs(gx) THEN 2 WHEN (gx < 0) = (gy < 0) THEN 1 ELSE 3 END AS bigint) AS dir FROM gr)"""
NMS_SQL = SOBEL_SQL + """, way AS (SELECT * FROM (VALUES (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1)) AS t(dir, dx, dy)),
nms AS (SELECT s.y, s.x, cast(CASE WHEN s.x > 0 AND s.y > 0 AND s.x < mx AND s.y < my AND s.mag2 >= coalesce(p.mag2, 0) AND s.mag2 >= coalesce(q.mag2, 0) THEN s.mag2 ELSE 0 END AS bigint) AS v
  FROM sob AS s JOIN way ON s.dir = way.dir CROSS JOIN lim LEFT JOIN sob AS p ON p.x = s.x + dx AND p.y = s.y + dy LEFT JOIN sob AS q ON q.x = s.x - dx AND q.y = s.y - dy)"""
CLS_SQL = NMS_SQL + f", cls AS (SELECT y, x, cast(CASE WHEN v >= {HIGH * HIGH} THEN 2 WHEN v >= {LOW * LOW} THEN 1 ELSE 0 END AS bigint) AS cls FROM nms)"
MASK_SQL = CLS_SQL + """, reach AS (SELECT y, x FROM cls WHERE cls = 2 UNION SELECT c.y, c.x FROM reach AS r, cls AS c WHERE c.cls = 1 AND c.y BETWEEN r.y - 1 AND r.y + 1 AND c.x BETWEEN r.x - 1 AND r.x + 1),
mask AS (SELECT c.y, c.x, cast(CASE WHEN r.x IS NULL THEN 0 ELSE 255 END AS bigint) AS mask FROM cls AS c LEFT JOIN reach AS r ON c.y = r.y AND c.x = r.x)"""
I0 = "cast(@IMG@ AS bigint) AS image_id"


@query(with_(LUMA_SQL, f"SELECT {I0}, y, x, luma FROM l"))
def luma(spark, d):
    return stencil.luma(pixels(spark, d))


@query(with_(BLUR_H_SQL, f"SELECT {I0}, y, x, bh FROM bh"))
def blur_h(spark, d):
    return stencil.blur_h(luma(spark, d))


@query(with_(BLUR_SQL, f"SELECT {I0}, y, x, blur FROM bl"))
def blur(spark, d):
    return stencil.blur(luma(spark, d))


@query(with_(SOBEL_SQL, f"SELECT {I0}, y, x, mag2, dir FROM sob"))
def sobel(spark, d):
    return stencil.sobel(blur(spark, d))


@query(with_(NMS_SQL, f"SELECT {I0}, y, x, v FROM nms"))
def nms(spark, d):
    return stencil.nms(sobel(spark, d))


@query(with_(CLS_SQL, f"SELECT {I0}, y, x, cls FROM cls"))
def canny_classify(spark, d):
    return stencil.classify(nms(spark, d), LOW, HIGH)


@query(with_(NMS_SQL, f"""SELECT {I0}, y, x, cast(CASE WHEN v >= high2 THEN 2 WHEN v >= floor(high2 * 0.16) THEN 1 ELSE 0 END AS bigint) AS cls FROM nms,
  (SELECT greatest(1, v) AS high2 FROM (SELECT v, row_number() OVER (ORDER BY v) AS k, count(*) OVER () AS n FROM nms WHERE v > 0) AS s WHERE k = floor((n - 1) * 0.85) + 1) AS t"""))
def canny_auto(spark, d):
    return stencil.classify_auto(nms(spark, d))


@query(with_("RECURSIVE " + MASK_SQL, f"SELECT {I0}, y, x, mask FROM mask"))
def canny_mask(spark, d):
    return stencil.canny(pixels(spark, d), LOW, HIGH)


@query()
def canny_float(spark, d):
    return stencil.canny_float(pixels(spark, d), LOW, HIGH)


@query(with_(PIX_SQL + ", " + SIZE_SQL, """SELECT cast(e AS bigint) AS exif, y2 AS y, x2 AS x, r, g, b FROM (SELECT e, r, g, b,
  CASE WHEN e IN (2, 3) THEN w - 1 - x WHEN e IN (5, 8) THEN y WHEN e IN (6, 7) THEN h - 1 - y ELSE x END AS x2,
  CASE WHEN e IN (3, 4) THEN h - 1 - y WHEN e IN (5, 6) THEN x WHEN e IN (7, 8) THEN w - 1 - x ELSE y END AS y2 FROM pix, size, unnest(range(0, 10)) AS t(e)) AS o"""))
def orient_remap(spark, d):
    """All tags at once: the image id is the tag."""
    p = pixels(spark, d).join(size(spark, d), "image_id").withColumn("image_id", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("image_id", F.col("image_id").cast("bigint"))
    return stencil.orient(p, F.col("image_id"), F.col("w"), F.col("h")).withColumnRenamed("image_id", "exif")


# Four seeds in a row of numbers are the points of the geometric predicates
QUADS_SQL = SEED_SQL + """, q AS (SELECT a.seed_id AS id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, e.x AS dx, e.y AS dy FROM seed AS a JOIN seed AS b ON b.seed_id = a.seed_id + 1
  JOIN seed AS c ON c.seed_id = a.seed_id + 7 JOIN seed AS e ON e.seed_id = a.seed_id + 11)"""


def _quads(spark, d) -> DataFrame:
    s = seeds(spark, d)
    at = lambda k, n: s.select("image_id", (F.col("seed_id") - k).alias("id"), F.struct("x", "y").alias(n))
    return at(0, "a").join(at(1, "b"), ["image_id", "id"]).join(at(7, "c"), ["image_id", "id"]).join(at(11, "d"), ["image_id", "id"])


CROSS_ABC = "((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax))"


@query(with_(QUADS_SQL, f"SELECT id, {CROSS_ABC} AS turn FROM q"))
def cross_sign(spark, d):
    return _quads(spark, d).select("id", expr.cross(F.col("a"), F.col("b"), F.col("c")).alias("turn"))


@query(with_(QUADS_SQL, "SELECT id, (ax * by_ - bx * ay) + (bx * cy - cx * by_) + (cx * dy - dx * cy) + (dx * ay - ax * dy) AS area2 FROM q"))
def signed_area(spark, d):
    return _quads(spark, d).select("id", expr.signed_area2(F.array("a", "b", "c", "d")).alias("area2"))


@query(with_(QUADS_SQL, """SELECT id, ((ax - dx) * (ax - dx) + (ay - dy) * (ay - dy)) * ((bx - dx) * (cy - dy) - (cx - dx) * (by_ - dy))
  - ((bx - dx) * (bx - dx) + (by_ - dy) * (by_ - dy)) * ((ax - dx) * (cy - dy) - (cx - dx) * (ay - dy))
  + ((cx - dx) * (cx - dx) + (cy - dy) * (cy - dy)) * ((ax - dx) * (by_ - dy) - (bx - dx) * (ay - dy)) AS det FROM q"""))
def incircle(spark, d):
    return _quads(spark, d).select("id", expr.incircle(*(F.col(c) for c in "abcd")).alias("det"))


@query(with_(QUADS_SQL, f"""SELECT id, CASE WHEN {CROSS_ABC} >= 0 THEN s1 >= 0 AND s2 >= 0 AND s3 >= 0 ELSE s1 <= 0 AND s2 <= 0 AND s3 <= 0 END AS inside FROM (SELECT *,
  (bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax) AS s1, (cx - bx) * (dy - by_) - (cy - by_) * (dx - bx) AS s2, (ax - cx) * (dy - cy) - (ay - cy) * (dx - cx) AS s3 FROM q) AS t"""))
def point_in_polygon(spark, d):
    a, b, c = (F.col(k) for k in "abc")
    ring = F.when(expr.cross(a, b, c) >= 0, F.array(a, b, c)).otherwise(F.array(a, c, b))
    return _quads(spark, d).select("id", expr.inside(ring, F.col("d.x"), F.col("d.y")).alias("inside"))


TRI_SQL = QUADS_SQL + f""", tri AS (SELECT id, unnest([0, 1, 2]) AS k, unnest(CASE WHEN {CROSS_ABC} > 0 THEN [ax, bx, cx] ELSE [ax, cx, bx] END) AS x, unnest(CASE WHEN {CROSS_ABC} > 0 THEN [ay, by_, cy] ELSE [ay, cy, by_] END) AS y FROM q WHERE {CROSS_ABC} <> 0),
side AS (SELECT u.id, u.k, u.x AS ux, u.y AS uy, v.x AS vx, v.y AS vy FROM tri AS u JOIN tri AS v ON u.id = v.id AND v.k = (u.k + 1) % 3),
pr AS (SELECT a.id AS p, b.id AS q FROM (SELECT DISTINCT id FROM tri) AS a JOIN (SELECT DISTINCT id FROM tri) AS b ON b.id > a.id AND b.id <= a.id + 20),
parted AS (SELECT p, q FROM (SELECT p, q, s.k, max((vx - ux) * (t.y - uy) - (vy - uy) * (t.x - ux)) AS m FROM pr JOIN side AS s ON s.id = p JOIN tri AS t ON t.id = q GROUP BY p, q, s.k
  UNION ALL SELECT p, q, s.k, max((vx - ux) * (t.y - uy) - (vy - uy) * (t.x - ux)) AS m FROM pr JOIN side AS s ON s.id = q JOIN tri AS t ON t.id = p GROUP BY p, q, s.k) AS a WHERE m <= 0)"""


@query(with_(TRI_SQL, "SELECT p, q, NOT EXISTS (SELECT 1 FROM parted WHERE parted.p = pr.p AND parted.q = pr.q) AS meet FROM pr"))
def interiors_meet(spark, d):
    a, b, c = (F.col(k) for k in "abc")
    t = _quads(spark, d).where(expr.cross(a, b, c) != 0).select("image_id", "id", F.when(expr.cross(a, b, c) > 0, F.array(a, b, c)).otherwise(F.array(a, c, b)).alias("v"))
    left = t.select("image_id", F.col("id").alias("p"), F.col("v").alias("pv"), F.explode(F.sequence(F.col("id") + 1, F.col("id") + 20)).alias("q"))
    return left.join(t.select("image_id", F.col("id").alias("q"), F.col("v").alias("qv")), ["image_id", "q"]).select("p", "q", expr.interiors_meet(F.col("pv"), F.col("qv")).alias("meet"))


@query(with_(SEED_SQL, """SELECT seed_id, cast(CASE WHEN x <= 0 THEN 0 WHEN x >= 63 THEN 199 ELSE least(greatest(round((x + 0.5) * 200 / 64 - 0.5), 0), 199) END AS bigint) AS big,
  cast(CASE WHEN x <= 0 THEN 0 WHEN x >= 63 THEN 30 ELSE least(greatest(round((x + 0.5) * 31 / 64 - 0.5), 0), 30) END AS bigint) AS small FROM seed"""))
def map_px(spark, d):
    to = lambda n: expr.map_px(F.col("x"), F.lit(64), F.lit(n).cast("bigint"))
    return seeds(spark, d).select("seed_id", to(200).alias("big"), to(31).alias("small"))


# Files ----------------------------------------------------------------------------------------------------------------


def _files(spark, d, kind):
    return files.to_pixels(files.decode_images(files.encode_images(pixels(spark, d), kind)))


@query(with_(PIX_SQL, f"SELECT {I0}, y, x, r, g, b FROM pix"))
def scan_ppm(spark, d):
    """Pixels written as a pixmap and read back."""
    return _files(spark, d, "ppm")


@query(with_(PIX_SQL, f"SELECT {I0}, y, x, r, g, b FROM pix"))
def scan_png(spark, d):
    """Pixels written as PNG and read back."""
    return _files(spark, d, "png")


LABEL_SQL = PIX_SQL.replace("vec_id // 10 AS", "rank - 1 AS").replace("FROM embeddings,", "FROM (SELECT *, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings) AS e,").replace("WHERE vec_id % 10 =", "WHERE label =")


@query(with_(LABEL_SQL, f"SELECT {I0}, y, x, r, g, b FROM pix"))
def encode_png(spark, d):
    """A picture for each label, encoded and decoded again."""
    p = pixels(spark, d).withColumns({"line": F.col("y") * IMAGES + F.col("image_id"), "image_id": expr.int_div(F.col("b"), F.lit(25))})
    rank = F.dense_rank().over(Window.partitionBy("image_id").orderBy("line")) - 1
    return files.to_pixels(files.decode_images(files.encode_images(p.withColumn("y", rank.cast("bigint")).drop("line"))))


# Sampling -------------------------------------------------------------------------------------------------------------

WEAK_SQL = CLS_SQL + ", " + SIZE_SQL + ", m AS (SELECT y, x, CASE WHEN cls <> 0 THEN 1 ELSE 0 END AS o FROM cls)"
SAT_SQL = WEAK_SQL + ", sat AS (SELECT y, x, cast(sum(a) OVER (PARTITION BY x ORDER BY y) AS bigint) AS s FROM (SELECT y, x, sum(o) OVER (PARTITION BY y ORDER BY x) AS a FROM m) AS t)"
CELL = f"""cell AS (SELECT level, gy, gx, x0, y0, CASE WHEN gx = level - 1 THEN w - x0 ELSE sw END AS cw, CASE WHEN gy = level - 1 THEN h - y0 ELSE sh END AS ch FROM
  (SELECT cast(level AS bigint) AS level, cast(gy AS bigint) AS gy, cast(gx AS bigint) AS gx, w, h, greatest(w // level, 1) AS sw, greatest(h // level, 1) AS sh, gx * greatest(w // level, 1) AS x0, gy * greatest(h // level, 1) AS y0
   FROM size, unnest(range(1, {LEVELS + 1})) AS a(level), unnest(range(0, {LEVELS})) AS b(gy), unnest(range(0, {LEVELS})) AS c(gx) WHERE gy < level AND gx < level) AS t WHERE x0 < w AND y0 < h)"""
COUNT_SQL = WEAK_SQL + ", " + CELL + ", cnt AS (SELECT level, gy, gx, x0, y0, cw, ch, cast(sum(o) AS bigint) AS cnt FROM cell JOIN m ON x >= x0 AND x < x0 + cw AND y >= y0 AND y < y0 + ch GROUP BY ALL)"
QUOTA_SQL = COUNT_SQL + f""", quota AS (SELECT * FROM (SELECT level, gy, gx, x0, y0, cw, ch, cnt, cast(least(1024, {int(POINTS * (1 - UNIFORM))} * c // ({LEVELS} * t) - {int(POINTS * (1 - UNIFORM))} * (c - cnt) // ({LEVELS} * t)) AS bigint) AS quota
  FROM (SELECT *, sum(cnt) OVER (PARTITION BY level ORDER BY gy, gx) AS c, sum(cnt) OVER (PARTITION BY level) AS t FROM cnt) AS r) AS q WHERE quota > 0)"""


def _weak(spark, d):
    return canny_classify(spark, d).withColumnRenamed("cls", "mask")


@query(with_(SAT_SQL, f"SELECT {I0}, y, x, s FROM sat"))
def sat(spark, d):
    return sampling.summed_area(_weak(spark, d))


@query(with_(SIZE_SQL + ", " + CELL, f"SELECT {I0}, level, gy, gx, x0, y0, cw, ch FROM cell"))
def level_cells(spark, d):
    return sampling.level_cells(size(spark, d), LEVELS)


@query(with_(COUNT_SQL, f"SELECT {I0}, level, gy, gx, x0, y0, cw, ch, cnt FROM cnt"))
def cell_counts(spark, d):
    return sampling.cell_counts(level_cells(spark, d), sat(spark, d))


@query(with_(QUOTA_SQL, f"SELECT {I0}, level, gy, gx, x0, y0, cw, ch, cnt, quota FROM quota"))
def cell_quota(spark, d):
    return sampling.cell_quota(cell_counts(spark, d), POINTS, LEVELS, UNIFORM)


MIX_SQL = SEED_SQL + """, m0 AS (SELECT seed_id, cast(seed_id AS ubigint) AS x FROM seed),
m1 AS (SELECT seed_id, cast(cast(xor(x, x >> 33) AS uhugeint) * 18397679294719823053 % 18446744073709551616 AS ubigint) AS x FROM m0),
m2 AS (SELECT seed_id, cast(cast(xor(x, x >> 33) AS uhugeint) * 14181476777654086739 % 18446744073709551616 AS ubigint) AS x FROM m1),
m3 AS (SELECT seed_id, xor(x, x >> 33) AS x FROM m2)"""


@query(with_(MIX_SQL, "SELECT seed_id, cast(CASE WHEN x >= 9223372036854775808 THEN cast(x AS hugeint) - 18446744073709551616 ELSE x END AS bigint) AS mixed FROM m3"))
def mix64(spark, d):
    return sampling.mix64(seeds(spark, d).select("seed_id"), "seed_id")


@query()
def cell_samples(spark, d):
    return sampling.cell_samples(cell_quota(spark, d), SEED)


@query()
def seed_points(spark, d):
    return sampling.sample_points(canny_mask(spark, d), POINTS, LEVELS, UNIFORM, SEED)


# Nearest seeds --------------------------------------------------------------------------------------------------------

OWN = ", own AS (SELECT y, x, k % 4294967296 AS seed_id, k // 4294967296 AS d2 FROM (SELECT p.y, p.x, min(((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y)) * 4294967296 + s.seed_id) AS k FROM pix AS p, seed AS s GROUP BY p.y, p.x) AS t)"
OWN_SQL = PIX_SQL + ", " + SEED_SQL + OWN
OWN_OUT = with_(OWN_SQL, f"SELECT {I0}, y, x, cast(seed_id AS bigint) AS seed_id, cast(d2 AS bigint) AS d2 FROM own")


@query(OWN_OUT)
def voronoi_brute(spark, d):
    return nearest.voronoi_brute(pixels(spark, d), seeds(spark, d))


@query(OWN_OUT)
def nearest_ring(spark, d):
    return nearest.nearest_ring(pixels(spark, d), seeds(spark, d), size(spark, d))


@query(OWN_OUT)
def voronoi_grid(spark, d):
    return nearest.voronoi_grid(pixels(spark, d), seeds(spark, d))


@query()
def voronoi_jfa(spark, d):
    return nearest.voronoi_jfa(size(spark, d), seeds(spark, d))


@query(with_(SEED_SQL, f"""SELECT {I0}, seed_id, x, y, g, x // g AS bx, y // g AS by FROM seed, (SELECT cast(least(greatest(round(sqrt(2.0 * w * h / (SELECT count(*) FROM seed))), 4), 64) AS bigint) AS g FROM size) AS t"""))
def seed_bins(spark, d):
    return nearest.seed_bins(seeds(spark, d), size(spark, d)).select("image_id", "seed_id", "x", "y", "g", "bx", "by")


@query(with_(OWN_SQL, f"SELECT {I0}, cast(o.seed_id AS bigint) AS seed_id, count(*) AS n, cast(sum(r) // count(*) AS bigint) AS r, cast(sum(g) // count(*) AS bigint) AS g, cast(sum(b) // count(*) AS bigint) AS b FROM own AS o JOIN pix AS p ON o.y = p.y AND o.x = p.x GROUP BY o.seed_id"))
def cell_mean(spark, d):
    return spans.cell_mean(voronoi_grid(spark, d), pixels(spark, d))


@query(with_(SEED_SQL + """, border AS (SELECT i AS x, cast(0 AS bigint) AS y, true AS across, 2 * i AS turn FROM size, unnest(range(0, 64)) AS u(i) UNION ALL SELECT i, h - 1, true, 2 * i + 1 FROM size, unnest(range(0, 64)) AS u(i)
  UNION ALL SELECT 0, i, false, 128 + 2 * i FROM size, unnest(range(0, h)) AS u(i) UNION ALL SELECT 63, i, false, 128 + 2 * i + 1 FROM size, unnest(range(0, h)) AS u(i)),
near AS (SELECT b.x, b.y, b.across, b.turn, min(((b.x - s.x) * (b.x - s.x) + (b.y - s.y) * (b.y - s.y)) * 4294967296 + s.seed_id) % 4294967296 AS sid FROM border AS b, seed AS s GROUP BY ALL),
put AS (SELECT CASE WHEN across THEN s.x ELSE n.x END AS x, CASE WHEN across THEN n.y ELSE s.y END AS y, min(turn) AS turn FROM near AS n JOIN seed AS s ON s.seed_id = n.sid GROUP BY 1, 2),
fresh AS (SELECT p.* FROM put AS p LEFT JOIN seed AS s ON s.x = p.x AND s.y = p.y WHERE s.x IS NULL)""",
    f"SELECT {I0}, cast(seed_id AS bigint) AS seed_id, x, y FROM seed UNION ALL SELECT {I0}, (SELECT count(*) FROM seed) + row_number() OVER (ORDER BY turn) - 1, x, y FROM fresh"))
def side_seeds(spark, d):
    return nearest.side_seeds(seeds(spark, d), size(spark, d))


# Meshes ---------------------------------------------------------------------------------------------------------------

KEY_SQL = PIX_SQL + ", " + CORNER_SQL + OWN + """, win AS (SELECT a.y, a.x, list_sort(list_distinct([a.seed_id, b.seed_id, c.seed_id, e.seed_id])) AS k FROM own AS a JOIN own AS b ON b.y = a.y AND b.x = a.x + 1 JOIN own AS c ON c.y = a.y + 1 AND c.x = a.x JOIN own AS e ON e.y = a.y + 1 AND e.x = a.x + 1),
jun AS (SELECT y, x, cast(k[1] AS bigint) AS k0, cast(k[2] AS bigint) AS k1, cast(k[3] AS bigint) AS k2, cast(k[4] AS bigint) AS k3 FROM win WHERE len(k) >= 3)"""
DIST_SQL = KEY_SQL + ", key AS (SELECT k0, k1, k2, k3, cast(f // 1000000 AS bigint) AS y, cast(f % 1000000 AS bigint) AS x FROM (SELECT k0, k1, k2, k3, min(y * 1000000 + x) AS f FROM jun GROUP BY k0, k1, k2, k3) AS t)"
POLY_SQL = DIST_SQL + """, kv AS (SELECT key.y AS ky, key.x AS kx, s.seed_id AS s, s.x, s.y FROM key, unnest([k0, k1, k2, k3]) AS u(id) JOIN seed AS s ON s.seed_id = u.id),
flat AS (SELECT DISTINCT p.ky, p.kx, p.s FROM kv AS p JOIN kv AS a ON a.ky = p.ky AND a.kx = p.kx AND a.s <> p.s JOIN kv AS b ON b.ky = p.ky AND b.kx = p.kx AND b.s <> p.s AND b.s > a.s
  WHERE (b.x - a.x) * (p.y - a.y) = (b.y - a.y) * (p.x - a.x) AND (a.x - p.x) * (b.x - p.x) + (a.y - p.y) * (b.y - p.y) < 0),
within AS (SELECT DISTINCT p.ky, p.kx, p.s FROM kv AS p JOIN kv AS a ON a.ky = p.ky AND a.kx = p.kx AND a.s <> p.s JOIN kv AS b ON b.ky = p.ky AND b.kx = p.kx AND b.s <> p.s AND b.s <> a.s JOIN kv AS c ON c.ky = p.ky AND c.kx = p.kx AND c.s <> p.s AND c.s <> a.s AND c.s <> b.s
  WHERE (b.x - a.x) * (p.y - a.y) - (b.y - a.y) * (p.x - a.x) > 0 AND (c.x - b.x) * (p.y - b.y) - (c.y - b.y) * (p.x - b.x) > 0 AND (a.x - c.x) * (p.y - c.y) - (a.y - c.y) * (p.x - c.x) > 0),
cor AS (SELECT kv.* FROM kv WHERE (ky, kx, s) NOT IN (SELECT (ky, kx, s) FROM flat) AND (ky, kx, s) NOT IN (SELECT (ky, kx, s) FROM within)),
st AS (SELECT ky, kx, min(x * 1000000 + y) AS f, count(*) AS n FROM cor GROUP BY ky, kx),
ord AS (SELECT p.ky, p.kx, n, p.s, p.x, p.y, CASE WHEN p.x * 1000000 + p.y = f THEN 0 ELSE 1 + (SELECT count(*) FROM cor AS q WHERE q.ky = p.ky AND q.kx = p.kx AND q.x * 1000000 + q.y <> f AND (q.x - f // 1000000) * (p.y - f % 1000000) - (q.y - f % 1000000) * (p.x - f // 1000000) > 0) END AS pos
  FROM cor AS p JOIN st ON st.ky = p.ky AND st.kx = p.kx WHERE n >= 3),
poly AS (SELECT ky, kx, n, row_number() OVER (ORDER BY ky, kx) - 1 AS poly_id FROM (SELECT DISTINCT ky, kx, n FROM ord) AS t),
pv AS (SELECT poly_id, poly.n, cast(pos AS bigint) AS pos, cast(s AS bigint) AS seed_id, x, y FROM ord JOIN poly ON poly.ky = ord.ky AND poly.kx = ord.kx)"""
SIDE_SQL = POLY_SQL + ", side AS (SELECT u.poly_id, u.pos, u.n, u.x AS ux, u.y AS uy, v.x AS vx, v.y AS vy, u.seed_id AS us, v.seed_id AS vs, u.y - v.y AS a, v.x - u.x AS b, -((u.y - v.y) * u.x + (v.x - u.x) * u.y) AS c FROM pv AS u JOIN pv AS v ON v.poly_id = u.poly_id AND v.pos = (u.pos + 1) % u.n)"


def _owner(spark, d):
    return nearest.voronoi_grid(pixels(spark, d), corner_seeds(spark, d))


def _polys(spark, d):
    """The polygons of the fixture, cut so that what follows does not repeat the joins."""
    return cut(key_polygons_of(spark, d))


def key_polygons_of(spark, d):
    return mesh.key_polygons(distinct_keys(spark, d), corner_seeds(spark, d))


@query(with_(KEY_SQL, f"SELECT {I0}, y, x, k0, k1, k2, k3 FROM jun"))
def junction_keys(spark, d):
    return mesh.junctions(_owner(spark, d))


@query(with_(DIST_SQL, f"SELECT {I0}, k0, k1, k2, k3, y, x FROM key"))
def distinct_keys(spark, d):
    return mesh.distinct_keys(junction_keys(spark, d))


@query(with_(POLY_SQL, f"SELECT {I0}, poly_id, n, pos, seed_id, x, y FROM pv"))
def key_polygon(spark, d):
    return mesh.poly_vertices(key_polygons_of(spark, d))


@query(with_(POLY_SQL, f"SELECT {I0}, seed_id, count(*) AS degree FROM pv GROUP BY seed_id"))
def vertex_degree(spark, d):
    return mesh.vertex_degree(key_polygons_of(spark, d))


OVER_SQL = SIDE_SQL + """, shared AS (SELECT DISTINCT p.poly_id AS pa, q.poly_id AS pb FROM pv AS p JOIN pv AS q ON p.seed_id = q.seed_id AND p.poly_id < q.poly_id),
apart AS (SELECT pa, pb FROM (SELECT pa, pb, s.pos, max((vx - ux) * (t.y - uy) - (vy - uy) * (t.x - ux)) AS m, 0 AS w FROM shared JOIN side AS s ON s.poly_id = pa JOIN pv AS t ON t.poly_id = pb GROUP BY pa, pb, s.pos
  UNION ALL SELECT pa, pb, s.pos, max((vx - ux) * (t.y - uy) - (vy - uy) * (t.x - ux)), 1 FROM shared JOIN side AS s ON s.poly_id = pb JOIN pv AS t ON t.poly_id = pa GROUP BY pa, pb, s.pos) AS a WHERE m <= 0),
over AS (SELECT pa AS poly_a, pb AS poly_b FROM shared WHERE (pa, pb) NOT IN (SELECT (pa, pb) FROM apart))"""


@query(with_(OVER_SQL, f"SELECT {I0}, poly_a, poly_b FROM over"))
def overlap_pairs(spark, d):
    return mesh.overlap_pairs(_polys(spark, d))


@query(with_("RECURSIVE " + OVER_SQL + ", two AS (SELECT poly_a AS u, poly_b AS v FROM over UNION SELECT poly_b, poly_a FROM over), rch AS (SELECT u AS p, u AS q FROM two UNION SELECT r.p, b.v FROM rch AS r JOIN two AS b ON b.u = r.q)",
    f"SELECT {I0}, p AS poly_id, min(q) AS group_id FROM rch GROUP BY p"))
def overlap_groups(spark, d):
    return mesh.overlap_groups(overlap_pairs(spark, d))


GROUP_SQL = SEED_SQL + ", few AS (SELECT x // 3 * 100000 + y // 3 AS group_id, seed_id, x, y FROM seed)"


@query(with_(GROUP_SQL + """, tri AS (SELECT a.group_id, a.seed_id AS a, b.seed_id AS b, c.seed_id AS c, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) AS o
  FROM few AS a JOIN few AS b ON b.group_id = a.group_id AND b.seed_id > a.seed_id JOIN few AS c ON c.group_id = a.group_id AND c.seed_id > b.seed_id)""",
    f"""SELECT {I0}, group_id, a, b, c FROM tri WHERE o <> 0 AND NOT EXISTS (SELECT 1 FROM few AS d WHERE d.group_id = tri.group_id AND sign(o) * (((ax - d.x) * (ax - d.x) + (ay - d.y) * (ay - d.y)) * ((bx - d.x) * (cy - d.y) - (cx - d.x) * (by_ - d.y))
  - ((bx - d.x) * (bx - d.x) + (by_ - d.y) * (by_ - d.y)) * ((ax - d.x) * (cy - d.y) - (cx - d.x) * (ay - d.y)) + ((cx - d.x) * (cx - d.x) + (cy - d.y) * (cy - d.y)) * ((ax - d.x) * (by_ - d.y) - (bx - d.x) * (ay - d.y))) > 0)"""))
def empty_circle(spark, d):
    s = seeds(spark, d).withColumn("group_id", expr.int_div(F.col("x"), F.lit(3)) * 100000 + expr.int_div(F.col("y"), F.lit(3)))
    return mesh.empty_circles(s)


HULL_SQL = SEED_SQL + """, tip AS (SELECT x, min(y) AS y FROM seed GROUP BY x UNION SELECT x, max(y) FROM seed GROUP BY x),
ext AS (SELECT DISTINCT p.x, p.y FROM tip AS p JOIN tip AS q ON p.x <> q.x OR p.y <> q.y WHERE NOT EXISTS (SELECT 1 FROM tip AS r WHERE
  (q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x) < 0 OR ((q.x - p.x) * (r.y - p.y) = (q.y - p.y) * (r.x - p.x) AND (r.x - p.x) * (r.x - q.x) + (r.y - p.y) * (r.y - q.y) > 0))),
low AS (SELECT x AS fx, y AS fy FROM ext ORDER BY x, y LIMIT 1)"""
HULL_OUT = with_(HULL_SQL, f"SELECT {I0}, CASE WHEN p.x = fx AND p.y = fy THEN 0 ELSE 1 + (SELECT count(*) FROM ext AS r WHERE (r.x - fx) * (p.y - fy) - (r.y - fy) * (p.x - fx) > 0) END AS pos, p.x, p.y FROM ext AS p, low")


@query(HULL_OUT)
def seed_hull(spark, d):
    return mesh.seed_hull(seeds(spark, d))


@query(HULL_OUT)
def hull_two_phase(spark, d):
    return mesh.hull_two_phase(seeds(spark, d))


@query()
def border_keys(spark, d):
    return mesh.border_keys(_owner(spark, d), corner_seeds(spark, d))


def _whole(spark, d, exact=True):
    s = cut(nearest.side_seeds(corner_seeds(spark, d), size(spark, d)))
    return mesh.polygons_of_owner(nearest.voronoi_grid(pixels(spark, d), s), s, exact)


@query()
def mesh_exact(spark, d):
    """Corners of the whole mesh of seeds and side seeds, overlaps repaired."""
    return mesh.poly_vertices(_whole(spark, d))


# Spans, sums, colours -------------------------------------------------------------------------------------------------

FDIV = "(({k} - (({k} % {a}) + {a}) % {a}) // {a})"
SPAN_SQL = SIDE_SQL + """, box AS (SELECT poly_id, greatest(min(x), 0) AS x0, least(max(x) + 1, w) AS x1, greatest(min(y), 0) AS y0, least(max(y) + 1, h) AS y1, w, h FROM pv, size GROUP BY poly_id, w, h),
rw AS (SELECT *, unnest(range(y0, y1)) AS y FROM box),
ek AS (SELECT rw.poly_id, rw.y, w, x0, x1, a, b, b * rw.y + c AS k, CASE WHEN rw.y = h - 1 THEN -1 ELSE 1 END AS dn, nullif(abs(a), 0) AS aa FROM rw JOIN side ON side.poly_id = rw.poly_id),
ends AS (SELECT poly_id, y, w, x0, x1, max(CASE WHEN a > 0 THEN -""" + FDIV.format(k="k", a="aa") + """ END) AS lo, min(CASE WHEN a < 0 THEN -""" + FDIV.format(k="(-k)", a="aa") + """ - 1 END) AS hi,
  bool_or(a = 0 AND (k < 0 OR (k = 0 AND b * dn <= 0))) AS never, bool_and(a * (w - 1) + k > 0 OR (a * (w - 1) + k = 0 AND (a < 0 OR (a = 0 AND b * dn > 0)))) AND x1 = w AS last FROM ek GROUP BY poly_id, y, w, x0, x1),
cl AS (SELECT poly_id, y, w, last, greatest(x0, coalesce(lo, x0)) AS lo, CASE WHEN never THEN -1 ELSE least(least(x1, w - 1) - 1, coalesce(hi, w)) END AS hi FROM ends),
span AS (SELECT poly_id, cast(y AS bigint) AS y, cast(CASE WHEN lo > hi THEN w - 1 ELSE lo END AS bigint) AS xl, cast(CASE WHEN last THEN w - 1 ELSE hi END AS bigint) AS xr FROM cl WHERE lo <= hi OR last)"""
PP_SQL = SPAN_SQL + ", pp AS (SELECT poly_id, y, cast(unnest(range(xl, xr + 1)) AS bigint) AS x FROM span)"
SUM_SQL = PP_SQL + """, sums AS (SELECT poly.poly_id, count(p.r) AS n, cast(coalesce(sum(r), 0) AS bigint) AS sr, cast(coalesce(sum(g), 0) AS bigint) AS sg, cast(coalesce(sum(b), 0) AS bigint) AS sb, cast(coalesce(sum(r * r + g * g + b * b), 0) AS bigint) AS s2
  FROM poly LEFT JOIN pp ON pp.poly_id = poly.poly_id LEFT JOIN pix AS p ON p.y = pp.y AND p.x = pp.x GROUP BY poly.poly_id),
err AS (SELECT *, CASE WHEN n = 0 THEN 0.0 ELSE cast(s2 AS double) - (cast(sr AS double) * cast(sr AS double) + cast(sg AS double) * cast(sg AS double) + cast(sb AS double) * cast(sb AS double)) / cast(n AS double) END AS sse FROM sums)"""
COL_SQL = SUM_SQL + ", fst AS (SELECT poly_id, p.r, p.g, p.b FROM pv JOIN pix AS p ON p.y = pv.y AND p.x = pv.x WHERE pos = 0), col AS (SELECT s.poly_id, cast(CASE WHEN n > 0 THEN sr // nullif(n, 0) ELSE r END AS bigint) AS r, cast(CASE WHEN n > 0 THEN sg // nullif(n, 0) ELSE g END AS bigint) AS g, cast(CASE WHEN n > 0 THEN sb // nullif(n, 0) ELSE b END AS bigint) AS b FROM sums AS s JOIN fst ON fst.poly_id = s.poly_id)"


def _again(tag: str, sizes: str = "size") -> str:
    """The edges, spans and pixels of other polygons: pv becomes pv with a tag, and so on."""
    text = PP_SQL.removeprefix(POLY_SQL)
    text = re.sub(r"\b(pv|side|box|rw|ek|ends|cl|span|pp)\b", lambda m: m[0] + tag, text)
    return re.sub(r"\bsize\b", sizes, text)


def _again_sse(tag: str) -> str:
    one = lambda c: f"cast(coalesce(sum({c}), 0) AS double)"
    return _again(tag) + f""", err{tag} AS (SELECT o.poly_id, CASE WHEN count(p.r) = 0 THEN 0.0 ELSE {one("r * r + g * g + b * b")} - ({one("r")} * {one("r")} + {one("g")} * {one("g")} + {one("b")} * {one("b")}) / count(p.r) END AS sse
  FROM (SELECT DISTINCT poly_id FROM pv{tag}) AS o LEFT JOIN pp{tag} AS t ON t.poly_id = o.poly_id LEFT JOIN pix AS p ON p.y = t.y AND p.x = t.x GROUP BY o.poly_id)"""


def _spans(spark, d, polys=None):
    return spans.polygon_spans(polys if polys is not None else _polys(spark, d), size(spark, d))


def _sums(spark, d, polys):
    return spans.polygon_sums(polys, _spans(spark, d, polys), spans.row_sums(pixels(spark, d)))


def _colours(spark, d, polys):
    return spans.mean_colours(polys, _sums(spark, d, polys), pixels(spark, d))


@query(with_(SIDE_SQL, f"SELECT {I0}, poly_id, pos, a, b, c FROM side"))
def edge_functions(spark, d):
    return spans.edge_functions(key_polygons_of(spark, d))


@query(with_(SPAN_SQL, f"SELECT {I0}, poly_id, y, xl, xr FROM span"))
def polygon_spans(spark, d):
    return _spans(spark, d)


@query(with_(PP_SQL, f"SELECT {I0}, poly_id, y, x FROM pp"))
def polygon_pixels(spark, d):
    return spans.polygon_pixels(_spans(spark, d))


@query(with_(PIX_SQL, f"""SELECT {I0}, y, x, cast(sum(r) OVER w AS bigint) AS pr, cast(sum(g) OVER w AS bigint) AS pg, cast(sum(b) OVER w AS bigint) AS pb, cast(sum(r * r + g * g + b * b) OVER w AS bigint) AS p2 FROM pix WINDOW w AS (PARTITION BY y ORDER BY x)"""))
def row_sums(spark, d):
    return spans.row_sums(pixels(spark, d))


@query(with_(SUM_SQL, f"SELECT {I0}, poly_id, n, sr, sg, sb, s2 FROM sums"))
def polygon_sums(spark, d):
    return _sums(spark, d, _polys(spark, d))


@query(with_(SUM_SQL, f"SELECT {I0}, poly_id, round(sse, 3) AS sse FROM err"))
def polygon_sse(spark, d):
    return spans.with_sse(_sums(spark, d, _polys(spark, d))).select("image_id", "poly_id", F.round("sse", 3).alias("sse"))


@query(with_(COL_SQL, f"SELECT {I0}, poly_id, r, g, b FROM col"))
def color_mean(spark, d):
    return _colours(spark, d, _polys(spark, d))


@query(with_(COL_SQL, f"SELECT {I0}, poly_id, r, g, b FROM fst"))
def color_corner(spark, d):
    return spans.corner_colours(_polys(spark, d), pixels(spark, d))


@query(with_(PIX_SQL, f"SELECT {I0}, cast(sum(r) // count(*) AS bigint) AS r, cast(sum(g) // count(*) AS bigint) AS g, cast(sum(b) // count(*) AS bigint) AS b FROM pix"))
def image_mean(spark, d):
    return spans.image_mean(pixels(spark, d))


@query(with_(POLY_SQL, f"SELECT {I0}, (SELECT count(*) FROM seed) AS seeds, count(*) AS polygons, count(*) FILTER (n = 3) AS triangles, count(*) FILTER (n = 4) AS quads FROM poly"))
def pipeline_stats(spark, d):
    n = corner_seeds(spark, d).groupBy("image_id").agg(F.count("*").alias("seeds"))
    p = key_polygons_of(spark, d).groupBy("image_id").agg(F.count("*").alias("polygons"), F.count_if(F.col("n") == 3).alias("triangles"), F.count_if(F.col("n") == 4).alias("quads"))
    return n.join(p, "image_id")


RAS_SQL = COL_SQL + ", ras AS (SELECT p.y, p.x, coalesce(c.r, 0) AS r, coalesce(c.g, 0) AS g, coalesce(c.b, 0) AS b FROM pix AS p LEFT JOIN (SELECT y, x, max(poly_id) AS poly_id FROM pp GROUP BY y, x) AS t ON t.y = p.y AND t.x = p.x LEFT JOIN col AS c ON c.poly_id = t.poly_id)"


def _raster(spark, d):
    p = _polys(spark, d)
    return raster.raster(spans.polygon_pixels(_spans(spark, d, p)), _colours(spark, d, p), pixels(spark, d))


@query(with_(RAS_SQL, f"SELECT {I0}, y, x, r, g, b FROM ras"))
def raster_fill(spark, d):
    return _raster(spark, d)


@query(with_(RAS_SQL, f"SELECT {I0}, sse, round(10 * log10(3.0 * 255 * 255 * n / sse), 6) AS psnr FROM (SELECT cast(sum((a.r - b.r) * (a.r - b.r) + (a.g - b.g) * (a.g - b.g) + (a.b - b.b) * (a.b - b.b)) AS bigint) AS sse, count(*) AS n FROM ras AS a JOIN pix AS b ON a.y = b.y AND a.x = b.x) AS t"))
def image_sse(spark, d):
    return spans.image_sse(_raster(spark, d), pixels(spark, d))


# Refinement, flips, moves, merges -------------------------------------------------------------------------------------


@query(with_(SUM_SQL, f"SELECT {I0}, poly_id, round(sse, 3) AS sse FROM err ORDER BY err.sse DESC, poly_id LIMIT 50"))
def worst_polygons(spark, d):
    top = optimize.worst_polygons(spans.with_sse(_sums(spark, d, _polys(spark, d))), 50)
    return top.withColumn("sse", F.round("sse", 3))


@query(with_(SUM_SQL + """, dev AS (SELECT s.poly_id, p.x, p.y, cast((n * r - sr) * (n * r - sr) + (n * g - sg) * (n * g - sg) + (n * b - sb) * (n * b - sb) AS hugeint) AS w FROM pp JOIN pix AS p ON p.y = pp.y AND p.x = pp.x JOIN sums AS s ON s.poly_id = pp.poly_id)""",
    f"SELECT {I0}, poly_id, cast(round(cast(sum(w * x) AS double) / cast(sum(w) AS double)) AS bigint) AS x, cast(round(cast(sum(w * y) AS double) / cast(sum(w) AS double)) AS bigint) AS y FROM dev GROUP BY poly_id HAVING sum(w) > 0"))
def split_points(spark, d):
    p = _polys(spark, d)
    return optimize.split_points(p, _sums(spark, d, p), spans.polygon_pixels(_spans(spark, d, p)), pixels(spark, d))


SHARE = """, tri AS (SELECT poly_id, least(us, vs) AS u, greatest(us, vs) AS v FROM side WHERE n = 3),
sh AS (SELECT u, v, p[1] AS poly_a, p[2] AS poly_b FROM (SELECT u, v, list_sort(list(poly_id)) AS p FROM tri GROUP BY u, v) AS t WHERE len(p) >= 2)"""


@query(with_(SIDE_SQL + SHARE, f"SELECT {I0}, u, v, poly_a, poly_b FROM sh"))
def shared_edges(spark, d):
    return optimize.shared_edges(_polys(spark, d))


@query(with_(SUM_SQL + SHARE + """, lim AS (SELECT 2.0 * sum(sse) / count(*) AS most FROM err),
mc AS (SELECT poly_a, poly_b, a.n * 1.0 * b.n / (a.n + b.n) * (power(cast(a.sr AS double) / a.n - cast(b.sr AS double) / b.n, 2) + power(cast(a.sg AS double) / a.n - cast(b.sg AS double) / b.n, 2) + power(cast(a.sb AS double) / a.n - cast(b.sb AS double) / b.n, 2)) AS cost
  FROM sh JOIN sums AS a ON a.poly_id = poly_a AND a.n > 0 JOIN sums AS b ON b.poly_id = poly_b AND b.n > 0)""", f"SELECT {I0}, poly_a, poly_b, round(cast(cost AS double), 6) AS cost FROM mc, lim WHERE cost <= most"))
def merge_candidates(spark, d):
    p = _polys(spark, d)
    return optimize.merge_candidates(p, _sums(spark, d, p), 2.0)


FLIP_SQL = SUM_SQL + SHARE + """, pair AS (SELECT u, v, poly_a, poly_b, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, c.x AS cx, c.y AS cy, c.seed_id AS cs, d.x AS dx, d.y AS dy, d.seed_id AS ds FROM sh JOIN pv AS a ON a.poly_id = poly_a AND a.seed_id = u JOIN pv AS b ON b.poly_id = poly_a AND b.seed_id = v
  JOIN pv AS c ON c.poly_id = poly_a AND c.seed_id NOT IN (u, v) JOIN pv AS d ON d.poly_id = poly_b AND d.seed_id NOT IN (u, v)),
quad AS (SELECT * FROM pair WHERE sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * sign((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) < 0 AND sign((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * sign((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) < 0),
half AS (SELECT u, v, 0 AS half, cx AS px, cy AS py, dx AS qx, dy AS qy, ax AS rx, ay AS ry FROM quad UNION ALL SELECT u, v, 1, dx, dy, cx, cy, bx, by_ FROM quad),
turned AS (SELECT *, (qx - px) * (ry - py) - (qy - py) * (rx - px) < 0 AS back FROM half),
pvf AS (SELECT (u * 1000000 + v) * 2 + half AS poly_id, 3 AS n, cast(pos AS bigint) AS pos, cast(0 AS bigint) AS seed_id, CASE WHEN pos = 0 THEN px WHEN (pos = 1) <> back THEN qx ELSE rx END AS x, CASE WHEN pos = 0 THEN py WHEN (pos = 1) <> back THEN qy ELSE ry END AS y FROM turned, (VALUES (0), (1), (2)) AS t(pos))""" + _again_sse("f")


@query(with_(FLIP_SQL, f"SELECT {I0}, u, v, poly_a, poly_b, round(ea.sse + eb.sse - f0.sse - f1.sse, 3) AS gain FROM quad JOIN err AS ea ON ea.poly_id = poly_a JOIN err AS eb ON eb.poly_id = poly_b JOIN errf AS f0 ON f0.poly_id = (u * 1000000 + v) * 2 JOIN errf AS f1 ON f1.poly_id = (u * 1000000 + v) * 2 + 1"))
def flip_candidates(spark, d):
    p = _polys(spark, d)
    rows = spans.row_sums(pixels(spark, d))
    return optimize.flip_candidates(p, size(spark, d), rows, spans.with_sse(_sums(spark, d, p)))


MOVE_SQL = SUM_SQL + f""", steps AS (SELECT * FROM (VALUES {", ".join(str(s) for s in STEPS)}) AS t(dx, dy)),
tries AS (SELECT pv.seed_id, pv.poly_id, pv.n, pv.pos, pv.x + dx AS tx, pv.y + dy AS ty FROM pv, steps, size WHERE NOT ((pv.x IN (0, w - 1)) AND (pv.y IN (0, h - 1))) AND NOT (pv.x IN (0, w - 1) AND dx <> 0) AND NOT (pv.y IN (0, h - 1) AND dy <> 0) AND pv.x + dx BETWEEN 0 AND w - 1 AND pv.y + dy BETWEEN 0 AND h - 1),
ring AS (SELECT t.seed_id AS sid, t.tx, t.ty, t.poly_id, q.n, q.pos, q.x AS ox, q.y AS oy, CASE WHEN q.pos = t.pos THEN t.tx ELSE q.x END AS x, CASE WHEN q.pos = t.pos THEN t.ty ELSE q.y END AS y FROM tries AS t JOIN pv AS q ON q.poly_id = t.poly_id),
bend AS (SELECT a.sid, a.tx, a.ty, a.poly_id, min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS least, sum(a.x * b.y - b.x * a.y) - sum(a.ox * b.oy - b.ox * a.oy) AS grown FROM ring AS a JOIN ring AS b ON b.sid = a.sid AND b.tx = a.tx AND b.ty = a.ty AND b.poly_id = a.poly_id AND b.pos = (a.pos + 1) % a.n
  JOIN ring AS c ON c.sid = a.sid AND c.tx = a.tx AND c.ty = a.ty AND c.poly_id = a.poly_id AND c.pos = (a.pos + 2) % a.n GROUP BY a.sid, a.tx, a.ty, a.poly_id),
fit AS (SELECT sid, tx, ty FROM bend GROUP BY sid, tx, ty HAVING min(least) > 0 AND sum(grown) = 0 AND count(*) <= 16),
alt AS (SELECT *, row_number() OVER (ORDER BY sid, tx, ty, poly_id) AS alt_id FROM (SELECT DISTINCT r.sid, r.tx, r.ty, r.poly_id FROM ring AS r JOIN fit ON fit.sid = r.sid AND fit.tx = r.tx AND fit.ty = r.ty) AS z),
pvm AS (SELECT alt_id AS poly_id, n, pos, cast(0 AS bigint) AS seed_id, x, y FROM ring JOIN alt ON alt.sid = ring.sid AND alt.tx = ring.tx AND alt.ty = ring.ty AND alt.poly_id = ring.poly_id)""" + _again_sse("m")


@query(with_(MOVE_SQL, f"SELECT {I0}, sid AS seed_id, tx, ty, round(sum(e.sse) - sum(m.sse), 3) AS gain FROM alt JOIN err AS e ON e.poly_id = alt.poly_id JOIN errm AS m ON m.poly_id = alt_id GROUP BY sid, tx, ty HAVING sum(e.sse) - sum(m.sse) > 1e-3"))
def move_candidates(spark, d):
    p = _polys(spark, d)
    rows = cut(spans.row_sums(pixels(spark, d)))
    return optimize.move_candidates(p, size(spark, d), rows, spans.with_sse(_sums(spark, d, p)))


@query()
def refine_round(spark, d):
    return optimize.refine(pixels(spark, d), corner_seeds(spark, d), 1000, once=True)


@query()
def refine(spark, d):
    return optimize.refine(pixels(spark, d), corner_seeds(spark, d), 600)


@query()
def flip(spark, d):
    return mesh.poly_vertices(optimize.flip(pixels(spark, d), _whole(spark, d)))


@query()
def vertex_coloring(spark, d):
    return optimize.vertex_coloring(_whole(spark, d))


@query()
def relax(spark, d):
    return mesh.poly_vertices(optimize.relax(pixels(spark, d), _whole(spark, d), 2))


@query()
def merge(spark, d):
    return mesh.poly_vertices(optimize.merge(pixels(spark, d), _whole(spark, d), 1.0))


# Rendering and sinks --------------------------------------------------------------------------------------------------

INSIDE_SQL = SIDE_SQL + ", hit AS (SELECT p.y, p.x, s.poly_id FROM own AS p JOIN (SELECT DISTINCT poly_id, seed_id FROM pv) AS s ON s.seed_id = p.seed_id WHERE NOT EXISTS (SELECT 1 FROM side AS e WHERE e.poly_id = s.poly_id AND e.a * p.x + e.b * p.y + e.c < 0))"
OWNP_SQL = INSIDE_SQL + """, fst1 AS (SELECT y, x, min(poly_id) AS poly_id FROM hit GROUP BY y, x), every AS (SELECT p.y, p.x, min(s.poly_id) AS any_id FROM own AS p JOIN pv AS s ON s.seed_id = p.seed_id GROUP BY p.y, p.x),
miss AS (SELECT e.y, e.x, any_id, o.seed_id FROM every AS e JOIN own AS o ON o.y = e.y AND o.x = e.x LEFT JOIN fst1 AS f ON f.y = e.y AND f.x = e.x WHERE f.poly_id IS NULL),
hop AS (SELECT m.y, m.x, min(a.poly_id * 10000000000 + c.pos * 1000000000 + z.poly_id) AS k FROM miss AS m JOIN pv AS a ON a.seed_id = m.seed_id JOIN pv AS c ON c.poly_id = a.poly_id JOIN pv AS z ON z.seed_id = c.seed_id
  WHERE NOT EXISTS (SELECT 1 FROM side AS e WHERE e.poly_id = z.poly_id AND e.a * m.x + e.b * m.y + e.c < 0) GROUP BY m.y, m.x),
fnd AS (SELECT e.y, e.x, coalesce(f.poly_id, hop.k % 1000000000, e.any_id) AS poly_id FROM every AS e LEFT JOIN fst1 AS f ON f.y = e.y AND f.x = e.x LEFT JOIN hop ON hop.y = e.y AND hop.x = e.x),
mn AS (SELECT poly_id, sum(r) // count(*) AS r, sum(g) // count(*) AS g, sum(b) // count(*) AS b FROM fnd JOIN pix AS p ON p.y = fnd.y AND p.x = fnd.x GROUP BY poly_id)"""


@query(with_(OWNP_SQL, f"SELECT {I0}, p.y, p.x, cast(coalesce(mn.r, 0) AS bigint) AS r, cast(coalesce(mn.g, 0) AS bigint) AS g, cast(coalesce(mn.b, 0) AS bigint) AS b FROM pix AS p LEFT JOIN fnd ON fnd.y = p.y AND fnd.x = p.x LEFT JOIN mn ON mn.poly_id = fnd.poly_id"))
def raster_owner(spark, d):
    return raster.raster_by_owner(_owner(spark, d), _polys(spark, d), pixels(spark, d))


@query(with_(COL_SQL + ", nv AS (SELECT p.y, p.x, max(s.poly_id) AS poly_id FROM pix AS p JOIN box AS s ON p.x BETWEEN s.x0 AND s.x1 AND p.y BETWEEN s.y0 AND s.y1 WHERE NOT EXISTS (SELECT 1 FROM side AS e WHERE e.poly_id = s.poly_id AND e.a * p.x + e.b * p.y + e.c < 0) GROUP BY p.y, p.x)",
    f"SELECT {I0}, p.y, p.x, coalesce(c.r, 0) AS r, coalesce(c.g, 0) AS g, coalesce(c.b, 0) AS b FROM pix AS p LEFT JOIN nv ON nv.y = p.y AND nv.x = p.x LEFT JOIN col AS c ON c.poly_id = nv.poly_id"))
def raster_naive(spark, d):
    p = _polys(spark, d)
    return raster.raster_naive(p, _colours(spark, d, p), pixels(spark, d))


@query(with_(PIX_SQL + ", " + SIZE_SQL + """, oy AS (SELECT i AS ny, unnest(range(i * h // 40, greatest(i * h // 40 + 1, (i + 1) * h // 40))) AS y FROM size, unnest(range(0, 40)) AS u(i)), ox AS (SELECT i AS nx, unnest(range(i * w // 20, greatest(i * w // 20 + 1, (i + 1) * w // 20))) AS x FROM size, unnest(range(0, 20)) AS u(i))""",
    f"SELECT {I0}, cast(ny AS bigint) AS y, cast(nx AS bigint) AS x, cast((sum(r) + count(*) // 2) // count(*) AS bigint) AS r, cast((sum(g) + count(*) // 2) // count(*) AS bigint) AS g, cast((sum(b) + count(*) // 2) // count(*) AS bigint) AS b FROM pix AS p JOIN oy ON oy.y = p.y JOIN ox ON ox.x = p.x GROUP BY ny, nx"))
def box_down(spark, d):
    return raster.box_down(pixels(spark, d), size(spark, d), 20, 40)


MAP = "cast(CASE WHEN {v} <= 0 THEN 0 WHEN {v} >= {n} - 1 THEN {to} - 1 ELSE least(greatest(round(({v} + 0.5) * {to} / {n} - 0.5), 0), {to} - 1) END AS bigint)"
REN_SQL = COL_SQL + f""", frame AS (SELECT cast(192 AS bigint) AS w, h * 3 // 2 * 2 AS h FROM size), pvs AS (SELECT poly_id, n, pos, seed_id, {MAP.format(v="x", n="w", to="192")} AS x, {MAP.format(v="y", n="h", to="(h * 3 // 2 * 2)")} AS y FROM pv, size)""" + _again("s", "frame") + """,
big AS (SELECT i AS y, k AS x FROM frame, unnest(range(0, h)) AS u(i), unnest(range(0, 192)) AS t(k)), tops AS (SELECT y, x, max(poly_id) AS poly_id FROM pps GROUP BY y, x)"""


@query(with_(REN_SQL, f"SELECT {I0}, cast(b.y // 2 AS bigint) AS y, cast(b.x // 2 AS bigint) AS x, cast((sum(coalesce(c.r, 0)) + 2) // 4 AS bigint) AS r, cast((sum(coalesce(c.g, 0)) + 2) // 4 AS bigint) AS g, cast((sum(coalesce(c.b, 0)) + 2) // 4 AS bigint) AS b FROM big AS b LEFT JOIN tops AS t ON t.y = b.y AND t.x = b.x LEFT JOIN col AS c ON c.poly_id = t.poly_id GROUP BY b.y // 2, b.x // 2"))
def render_scaled(spark, d):
    p = _polys(spark, d)
    return raster.render_scaled(p, cut(_colours(spark, d, p)), size(spark, d), 96, expr.int_div(F.col("h") * 3, F.lit(2)), 2)


HV = "CASE WHEN {v} <= 0 THEN 0 WHEN {v} >= {n} - 1 THEN 2 * {n} ELSE 2 * {v} + 1 END"
PATH_SQL = COL_SQL + f""", hp AS (SELECT poly_id, pos, {HV.format(v='x', n='w')} AS hx, {HV.format(v='y', n='h')} AS hy FROM pv, size),
st2 AS (SELECT a.poly_id, a.pos, a.hx - b.hx AS mx, a.hy - b.hy AS my FROM hp AS a JOIN hp AS b ON b.poly_id = a.poly_id AND b.pos = a.pos - 1),
mv AS (SELECT poly_id, string_agg(CASE WHEN pos = 1 OR mx < 0 THEN '' ELSE ' ' END || cast(mx AS varchar) || CASE WHEN my < 0 THEN '' ELSE ' ' END || cast(my AS varchar), '' ORDER BY pos) AS m FROM st2 GROUP BY poly_id),
hx AS (SELECT poly_id, printf('%02x', r) AS hr, printf('%02x', g) AS hg, printf('%02x', b) AS hb, r % 17 = 0 AND g % 17 = 0 AND b % 17 = 0 AS short FROM col)"""


@query(with_(PATH_SQL, f"""SELECT {I0}, hp.poly_id, '<path d="M' || cast(hp.hx AS varchar) || ' ' || cast(hp.hy AS varchar) || 'l' || m || 'z" color="#' || CASE WHEN short THEN hr[1] || hg[1] || hb[1] ELSE hr || hg || hb END || '"/>' AS path FROM hp JOIN mv ON mv.poly_id = hp.poly_id JOIN hx ON hx.poly_id = hp.poly_id WHERE hp.pos = 0"""))
def svg_paths(spark, d):
    p = _polys(spark, d)
    return raster.svg_paths(p, _colours(spark, d, p), size(spark, d))


@query(with_(COL_SQL, f"""SELECT {I0}, pv.poly_id, CASE WHEN any_value(n) = 3 THEN 'Tri' ELSE 'Qua' END || chr(10) || string_agg(cast(x AS varchar) || ' ' || cast(y AS varchar) || chr(10), '' ORDER BY pos) || any_value(cast(r AS varchar) || ' ' || cast(g AS varchar) || ' ' || cast(b AS varchar)) || chr(10) AS shape FROM pv JOIN col ON col.poly_id = pv.poly_id GROUP BY pv.poly_id"""))
def shape_text(spark, d):
    p = _polys(spark, d)
    return raster.shape_text(p, _colours(spark, d, p))


@query()
def wireframe(spark, d):
    return raster.wireframe(_polys(spark, d), size(spark, d))


@query(with_("RECURSIVE " + MASK_SQL, f"SELECT {I0}, y, x, mask AS r, mask AS g, mask AS b FROM mask"))
def stage_edges(spark, d):
    return canny_mask(spark, d).select("image_id", "y", "x", *(F.col("mask").alias(c) for c in "rgb"))


@query(with_(PIX_SQL + ", " + SEED_SQL, f"SELECT {I0}, p.y, p.x, cast(CASE WHEN s.x IS NULL THEN 0 ELSE 255 END AS bigint) AS v FROM pix AS p LEFT JOIN seed AS s ON s.x = p.x AND s.y = p.y"))
def stage_points(spark, d):
    s = seeds(spark, d).select("image_id", "y", "x", F.lit(255).cast("bigint").alias("v"))
    return pixels(spark, d).select("image_id", "y", "x").join(s, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.coalesce("v", F.lit(0).cast("bigint")).alias("v"))


@query()
def stage_voronoi(spark, d):
    return voronoi_grid(spark, d).select("image_id", "y", "x", raster.id_colour(F.col("seed_id")).alias("c")).select("image_id", "y", "x", "c.r", "c.g", "c.b")


@query()
def stage_polygons(spark, d):
    """The wireframe over black: triangles and quads in colours of their own."""
    w = raster.wireframe(_polys(spark, d), size(spark, d))
    p = pixels(spark, d).select("image_id", "y", "x", *(F.lit(0).cast("bigint").alias(c) for c in "rgb"))
    return raster.overlay(raster.overlay(p, w.where("n = 3"), (0, 229, 255)), w.where("n = 4"), (255, 138, 0))


@query()
def hull_overlay(spark, d):
    return raster.overlay(pixels(spark, d), raster.closed_lines(seed_hull(spark, d)), (255, 0, 0))


@query()
def pipeline_plain(spark, d):
    return mesh.poly_vertices(reduce_images(pixels(spark, d), Params(points=600, **PLAIN)))


@query()
def pipeline_default(spark, d):
    return mesh.poly_vertices(reduce_images(pixels(spark, d), Params(points=600)))
