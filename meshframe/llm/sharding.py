"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id), so equal texts stand together. Candidate boundaries between keys are
refined in rounds: each round counts the exact rows and bytes below all probes in one pass over narrow keys (partial
histograms per partition, summed by probe), until every boundary is within the tolerance or no key is left between its
bounds. Then every row goes once to its range, is sorted there and numbered. Law `bytes`: shards have nearly equal sizes.

Where a boundary falls among rows equal in text and doc_id (too many repeated rows for one shard), rows get a third key,
a hash of their number, which is written down (checkpoint) so that all passes see the same; then such rows split too.

Ranges are finer than shards (`ranges` of them for each), so the last exchange is as wide as the data needs. What the
driver holds are probes and their counts: shards x ranges x probes numbers.

Defined cases: a null text has size 1 and crc 0; a null doc_id sorts first; equal texts and repeated rows of any number
may be split between shards; empty tables give no rows; an input column named like a result column is replaced.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshframe.llm.common import cut

SHARDS = 16
#: A shard boundary may be off by this part of a shard's mean size.
TOLERANCE = 0.001
#: A range boundary inside a shard may be off by this part of a range's mean size.
LOOSE = 0.05
PROBES = 32
_SIGN = 1 << 63


def _wide(*parts: np.ndarray) -> np.ndarray:
    """Triples of signed 64-bit keys as 24 bytes that sort alike."""
    out = np.empty((len(parts[0]), 3), ">u8")
    for k, x in enumerate(parts):
        out[:, k] = x.view(np.uint64) ^ np.uint64(_SIGN)
    return np.frombuffer(out.tobytes(), "S24") if len(out) else np.zeros(0, "S24")


def _key(n: int) -> bytes:
    return n.to_bytes(24, "big")


KEYS = ("__mf_hi", "__mf_lo", "__mf_tie")


def below(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact (rows, bytes) with a key below each probe; probes ascend."""
    # numpy drops trailing zero bytes on both sides alike, so the order holds
    bounds = np.array([_key(p) for p in probes], "S24")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(bounds, _wide(*(b.column(k).to_numpy() for k in range(3))), "right")
            rows += np.bincount(at, minlength=len(rows))
            size += np.bincount(at, b.column(3).to_numpy(), len(size)).astype(np.int64)
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(rows[some]), pa.array(size[some])], names=["at", "n", "s"])

    got = keys.select(*KEYS, "__mf_size").mapInArrow(count, "at long, n long, s long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    rows, size = [0] * (len(probes) + 1), [0] * (len(probes) + 1)
    for r in got:  # one row for each probe at most
        rows[r["at"]], size[r["at"]] = r["n"], r["s"]
    return list(zip(np.cumsum(rows)[:-1].tolist(), np.cumsum(size)[:-1].tolist(), strict=True))


def splitters(keys: DataFrame, total: int, shards: int, ranges: int) -> tuple[list[int], list[int], list[int]]:
    """Boundaries between ranges (keys below go left), the rows below each, and keys (without tie) that hide a boundary."""
    n = shards * ranges
    goals = [total * i / n for i in range(1, n)]
    slack = [(TOLERANCE * total / shards) if (i + 1) % ranges == 0 else LOOSE * total / n for i in range(n - 1)]
    ends = keys.agg(*(f(c) for c in KEYS[1:] for f in (F.min, F.max))).first()
    exist = {64: (ends[0] + _SIGN, ends[1] + _SIGN), 0: (ends[2] + _SIGN, ends[3] + _SIGN)}
    # low: bytes below are less than the goal; high: not less
    low = [(0, 0, 0)] * (n - 1)
    high = [((1 << 192) - 1, total, None)] * (n - 1)
    best: list[tuple[int, int, int] | None] = [None] * (n - 1)
    hidden: set[int] = set()

    def probe(a: int, b: int) -> list[int]:
        """Keys inside (a, b): first between hashes, then inside one hash between its ids, then between their ties."""
        for shift in (128, 64, 0):
            first, last = (a >> shift) + 1, b - 1 >> shift
            if shift != 128:
                base = a >> shift + 64 << 64
                first, last = max(first, base + exist[shift][0]), min(last, base + exist[shift][1] + 1)
            if first <= last:
                step = max(1, last - first)
                return sorted({first + step * k // PROBES << shift for k in range(PROBES + 1) if first + step * k // PROBES <= last})
        return []

    while True:
        ask = sorted({x for i in range(n - 1) if best[i] is None for x in probe(low[i][0], high[i][0])})
        found = dict(zip(ask, below(keys, ask), strict=True)) if ask else {}
        known = [(k, found[k][1], found[k][0]) for k in ask]
        for i in range(n - 1):
            if best[i] is not None:
                continue
            inside = known[bisect.bisect_right(ask, low[i][0]) : bisect.bisect_left(ask, high[i][0])]
            for x in inside:
                if x[1] < goals[i]:
                    low[i] = max(low[i], x)
                else:
                    high[i] = min(high[i], x, key=lambda y: y[0])
            near = min((low[i], high[i]), key=lambda x: abs(x[1] - goals[i]))
            if near[2] is not None and abs(near[1] - goals[i]) <= slack[i]:
                best[i] = near
            elif not inside:
                best[i] = near if near[2] is not None else low[i]
                if high[i][2] is None or high[i][2] - low[i][2] > 1:
                    hidden.add(low[i][0] >> 64)
        if all(b is not None for b in best):
            ends = sorted(best)
            return [b[0] for b in ends], [b[2] for b in ends], sorted(hidden)


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, ranges: int | None = None) -> DataFrame:
    """Rows with size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    t = F.col(text)
    base = docs.withColumns({
        "size": (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("bigint"),
        "text_crc32": F.crc32(F.coalesce(t, F.lit("")).cast("binary")),
        "__mf_hi": F.xxhash64(F.coalesce(t, F.lit(""))),
        "__mf_lo": F.coalesce(F.col(doc_id).cast("bigint"), F.lit(-(1 << 63))),
    })
    base = base.withColumn("__mf_tie", F.lit(0).cast("bigint"))
    keys = cut(base.select(*KEYS, F.col("size").alias("__mf_size")))
    count, total = keys.agg(F.count("*"), F.coalesce(F.sum("__mf_size"), F.lit(0))).first()
    if ranges is None:
        parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
        ranges = max(1, -(-max(parts, total >> 27) // shards))
    cuts, rows, hidden = splitters(keys, total, shards, ranges) if count else ([], [], [])
    if hidden:
        # as many keys as there are boundaries at most
        signed = lambda x: x - _SIGN
        many = F.concat_ws(",", "__mf_hi", "__mf_lo").isin([f"{signed(k >> 64)},{signed(k & (1 << 64) - 1)}" for k in hidden])
        base = cut(base.withColumn("__mf_tie", F.when(many, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.lit(0).cast("bigint"))))
        cuts, rows, _ = splitters(base.select(*KEYS, F.col("size").alias("__mf_size")), total, shards, ranges)
    bounds = np.array([_key(c) for c in cuts], "S24")
    starts = [0, *rows]

    @F.pandas_udf("int")
    def range_of(hi, lo, tie):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, _wide(*(x.to_numpy(np.int64) for x in (hi, lo, tie))), "right").astype(np.int32))

    ahead = np.array(starts, np.int64) - np.array(starts, np.int64)[np.arange(len(starts)) // ranges * ranges]

    @F.pandas_udf("bigint")
    def ahead_of(part):
        import pandas as pd

        return pd.Series(ahead[part.to_numpy()])

    w = Window.partitionBy("__mf_range").orderBy(*KEYS)
    out = base.withColumn("__mf_range", range_of(*KEYS)).withColumns({
        "law": F.lit("bytes"), "shard": (F.col("__mf_range") / ranges).cast("int"),
        "slot": (F.row_number().over(w) - 1 + ahead_of("__mf_range")).cast("bigint"), "grown_shard": F.lit(None).cast("int"),
    })
    return out.drop(*KEYS, "__mf_range")
