"""Shared pieces of the training-data operators: table reading, bucket counts, packed arrays."""

from __future__ import annotations

import ctypes
import os
import struct
import tempfile
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one bucket of a bucketed exchange should hold.
BUCKET_BYTES = 64 << 20
#: Stands for a null doc_id where documents are ordered: null sorts last.
NULL_ID = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package and keeps Arrow batches small enough for very long texts."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder from spark.checkpoint.dir; a folder of this machine only where Spark runs on it alone."""
    shared = spark.conf.get("spark.checkpoint.dir", "")
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not hasattr(checkpoint_dir, "own"):
            checkpoint_dir.own = tempfile.mkdtemp(prefix="meshframe-checkpoints-")
        shared = checkpoint_dir.own
    return shared


#: Whether Spark deletes a query's shuffle files when it ends, not when the driver happens to collect garbage.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, tidy: bool = False) -> DataFrame:
    """The same rows with their lineage cut by checkpoint() into the shared folder; if tidy, shuffle files go at once."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    if not tidy:
        return df.checkpoint()
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        return df.select("*").checkpoint()  # the setting holds for frames made under it
    finally:
        spark.conf.set(TIDY, before) if before is not None else spark.conf.unset(TIDY)


def prime_at_least(n: int) -> int:
    n = max(2, n)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def bucket_count(docs: DataFrame, text: str = "text") -> int:
    """A prime number of buckets, in proportion to the text bytes: doc_id modulo a prime deals any stride evenly."""
    total = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return prime_at_least(max(parts, -(-total // BUCKET_BYTES)))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed blob."""
    head = b"".join(struct.pack("<2sI", a.dtype.str[1:].encode(), len(a)) for a in arrays)
    raw = struct.pack("<I", len(arrays)) + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    return struct.pack("<Q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    size = struct.unpack_from("<Q", blob)[0]
    raw = pa.decompress(blob[8:], decompressed_size=size, codec="zstd", asbytes=True)
    n, at = struct.unpack_from("<I", raw)[0], 4
    kinds = []
    for _ in range(n):
        kinds.append(struct.unpack_from("<2sI", raw, at))
        at += 6
    out = []
    for kind, count in kinds:
        dtype = np.dtype("<" + kind.decode())
        out.append(np.frombuffer(raw, dtype, count, at))
        at += count * dtype.itemsize
    return out


@lru_cache(maxsize=1)
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory of finished work back to the system, so that a Python worker holds what one task needs."""
    pa.default_memory_pool().release_unused()
    if _trim():
        _trim()(0)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
