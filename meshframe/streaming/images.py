"""A folder of pictures as a stream: each micro-batch of new files is reduced and appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshframe.plans.pipeline import Params, reduce_images
from meshframe.sources.files import decode_images, to_pixels

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def reduce_stream(spark: SparkSession, folder: str, table: str, checkpoint: str, params: Params, files_per_batch: int = 64) -> StreamingQuery:
    """Polygons of the pictures that arrive in `folder`, as Parquet under `table`; what is there now, then stop."""

    def batch(files: DataFrame, number: int) -> None:
        polys = reduce_images(to_pixels(decode_images(files)), params)
        polys.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{table}/batch={number}")

    source = spark.readStream.format("binaryFile").schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).load(folder)
    named = source.select(F.xxhash64("path").alias("image_id"), "content")
    return named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
