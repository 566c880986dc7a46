"""Images and seeds read out of the supplied tables, in both dialects.

There are IMAGES pictures. Embeddings are dealt to them in turn, a row of pixels each; all orders scatter seeds, each over
the picture of its customer. In SQL every query is written for one picture, @IMG@, and put together for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WIDTH, IMAGES = 64, 10


def _channel(e):
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor((e.cast("double") + 0.6) * 212.5))).cast("bigint")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, y, x, r, g, b: a row of the picture for each embedding, a column for each of its numbers."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    p = e.select((F.col("vec_id") % IMAGES).cast("bigint").alias("image_id"), F.expr(f"vec_id div {IMAGES}").alias("y"), F.posexplode("embedding").alias("x", "e"), "embedding", "label")
    return p.select("image_id", "y", F.col("x").cast("bigint").alias("x"), _channel(F.col("e")).alias("r"), _channel(F.get("embedding", (F.col("x") + 21) % WIDTH)).alias("g"), (F.col("label") * 25).cast("bigint").alias("b"))


def size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, w, h."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.groupBy((F.col("vec_id") % IMAGES).cast("bigint").alias("image_id")).agg(F.lit(WIDTH).cast("bigint").alias("w"), F.count("*").alias("h"))


def _scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").withColumn("image_id", (F.col("o_custkey") % IMAGES).cast("bigint"))
    at = o.join(size(spark, sf_dir), "image_id")
    return at.select("image_id", (F.col("o_orderkey") * 7919 % WIDTH).alias("x"), ((F.col("o_custkey") * 104729 + F.col("o_orderkey") * 31) % F.col("h")).alias("y")).distinct()


def _numbered(points: DataFrame) -> DataFrame:
    w = Window.partitionBy("image_id").orderBy("x", "y")
    return points.select("image_id", (F.row_number().over(w) - 1).cast("bigint").alias("seed_id"), "x", "y")


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, seed_id, x, y: points scattered by orders."""
    return _numbered(_scatter(spark, sf_dir))


def corner_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the corners of the image."""
    s = size(spark, sf_dir)
    corners = s.select("image_id", F.explode(F.array(*(F.struct((F.col("w") - 1).alias("x") if a else F.lit(0).cast("bigint").alias("x"), (F.col("h") - 1).alias("y") if b else F.lit(0).cast("bigint").alias("y")) for a in (0, 1) for b in (0, 1)))).alias("c")).select("image_id", "c.x", "c.y")
    return _numbered(_scatter(spark, sf_dir).unionByName(corners).distinct())


SIZE_SQL = "size AS (SELECT cast(64 AS bigint) AS w, count(*) AS h FROM embeddings WHERE vec_id % 10 = @IMG@)"
PIX_SQL = """pix AS (SELECT cast(vec_id // 10 AS bigint) AS y, cast(i - 1 AS bigint) AS x,
  cast(least(255, greatest(0, floor((cast(embedding[i] AS double) + 0.6) * 212.5))) AS bigint) AS r,
  cast(least(255, greatest(0, floor((cast(embedding[(i + 20) % 64 + 1] AS double) + 0.6) * 212.5))) AS bigint) AS g,
  cast(label * 25 AS bigint) AS b FROM embeddings, unnest(range(1, 65)) AS u(i) WHERE vec_id % 10 = @IMG@)"""
SCATTER_SQL = """scatter AS (SELECT DISTINCT (o_orderkey * 7919) % 64 AS x, (o_custkey * 104729 + o_orderkey * 31) % (SELECT h FROM size) AS y FROM orders WHERE o_custkey % 10 = @IMG@)"""
SEED_SQL = SIZE_SQL + ", " + SCATTER_SQL + ", seed AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS seed_id, x, y FROM scatter)"
CORNER_SQL = SIZE_SQL + ", " + SCATTER_SQL + """, corner AS (SELECT * FROM scatter UNION SELECT 0, 0 UNION SELECT 63, 0 UNION SELECT 0, h - 1 FROM size UNION SELECT 63, h - 1 FROM size),
seed AS (SELECT row_number() OVER (ORDER BY x, y) - 1 AS seed_id, x, y FROM corner)"""
