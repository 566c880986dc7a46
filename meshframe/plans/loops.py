"""What sessions need: lineage cut in driver loops, and Python workers that find this package."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package from where it lies (on a cluster: from a place that all nodes have)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def cut(df: DataFrame) -> DataFrame:
    """The same rows by checkpoint() into the folder of spark.checkpoint.dir; one of this machine only where Spark runs on it alone."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="meshframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
