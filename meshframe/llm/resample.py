"""Importance resampling of raw text towards target text.

Both texts are bags of hashed n-grams (words and word pairs, words being runs of word characters or of other marks,
lower-cased over A-Z). With smoothed bucket shares p of the target and q of all raw text, a document's weight is the
sum of log p - log q over its n-grams; Gumbel noise drawn from its doc_id makes top-k of weight + noise a sample without
replacement in proportion to the weights. Counts are summed over all rows; the driver gets one row for each bucket.
The k-th key is found by counting (radix selection over the keys' bits), so nothing is sorted in one place.

Defined cases: null and empty texts have no n-grams and weight 0; ties of the key go to the smaller doc_id, and rows
equal in both are taken together; without target text all weights are 0; empty tables give no rows; an input column
named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshframe.llm import textops as T
from meshframe.llm.common import NULL_ID, cut
from meshframe.llm.repeats import doc_ids

BUCKETS = 1 << 14
SMOOTHING = 1.0
SEED = 20240607
#: Bytes of marks that stand alone as words: printable and neither white space, digit, letter nor underscore.
MARKS = np.zeros(256, bool)
MARKS[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x5F), 0x60, *range(0x7B, 0x7F)]] = True
SPACE = ~T.SPACED
SPACE[[*range(0x00, 0x20), 0x7F]] = True


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each n-gram."""
    kind = np.where(SPACE[buf], 0, np.where(MARKS[buf], 1, 2)).astype(np.int8)
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.ones(len(buf), bool)
    change[1:] = kind[1:] != kind[:-1]
    cuts = off[1:-1]
    change[cuts[cuts < len(buf)]] = True
    edge = np.flatnonzero(change)
    end = np.concatenate((edge[1:], [len(buf)]))
    real = kind[edge] > 0
    start, end = edge[real], end[real]
    row = np.searchsorted(off, start, "right") - 1
    h = T.word_hashes(T.LOWER[buf], start, end)
    if len(h) < 2:
        return (h % np.uint64(BUCKETS)).astype(np.int64), row
    pair = T.mix(h[:-1] * np.uint64(3) + h[1:])[row[1:] == row[:-1]]
    rows = np.concatenate((row, row[1:][row[1:] == row[:-1]]))
    return (np.concatenate((h, pair)) % np.uint64(BUCKETS)).astype(np.int64), rows


def gram_counts(docs: DataFrame, text: str, flag: str) -> np.ndarray:
    """Counts by bucket: row 0 of all rows, row 1 of rows with the flag."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            buf, off = T.buffer(b.column(0))
            picked = b.column(1).fill_null(False).to_numpy(zero_copy_only=False)
            for i, j in T.slices(off):
                f, r = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                total[0] += np.bincount(f, minlength=BUCKETS)
                total[1] += np.bincount(f[picked[i:j][r]], minlength=BUCKETS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[0][some]), pa.array(total[1][some])], names=["f", "n", "t"])

    got = docs.select(text, flag).mapInArrow(count, "f long, n long, t long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).collect()
    out = np.zeros((2, BUCKETS), np.int64)
    for r in got:  # BUCKETS rows at most
        out[:, r["f"]] = r["n"], r["t"]
    return out


def log_ratio(counts: np.ndarray) -> np.ndarray:
    if not counts[1].sum():
        return np.zeros(BUCKETS)
    share = (counts + SMOOTHING) / (counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    return np.log(share[1]) - np.log(share[0])


def gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Noise that depends on the id and the seed only."""
    u = (T.mix(T.mix(ids.astype(np.uint64) + np.uint64(seed)) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(11)).astype(np.float64)
    return -np.log(-np.log((u + 0.5) / 2.0**53))


def select_top(scored: DataFrame, k: int, key: str, tie: str) -> tuple[int, int]:
    """(bits, id): rows with greater bits, or these bits and at most this id, are the top k; bits: sortable key bits."""

    def walk(df: DataFrame, column: str, need: int) -> tuple[int, int]:
        """The value of `column` (descending) at rank `need` and how many of its rows are needed, 16 bits a round."""
        value = 0
        for shift in (48, 32, 16, 0):
            digit = F.shiftrightunsigned(F.col(column), shift).bitwiseAND(F.lit(0xFFFF))
            if shift == 48:
                digit = digit.bitwiseXOR(F.lit(0x8000))  # signed order
            got = df.groupBy(digit.alias("d")).count().collect()  # 65,536 rows at most
            for d, n in sorted(((r["d"], r["count"]) for r in got), reverse=True):
                if n >= need:
                    break
                need -= n
            value = value << 16 | d
            df = df.where(digit == d)
        value ^= 1 << 63
        return value - (1 << 64) if value >> 63 else value, need

    bits, need = walk(scored, key, k)
    last, _ = walk(scored.where(F.col(key) == bits).withColumn("__mf_neg", F.bitwise_not(F.col(tie))), "__mf_neg", need)
    return bits, ~last


def resample(docs: DataFrame, targets: DataFrame, keep: float, doc_id: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, sample_key and selected; `targets` has the ids of target text, `keep` is the part to take."""
    ids = targets.select(F.col(doc_id).alias("__mf_target")).distinct().withColumn("__mf_is", F.lit(True))
    # only counting needs the targets beside the texts; scoring reads the texts where they are. Labels grow with the
    # documents, so the join is a merge at every size, not a broadcast below some size
    marked = docs.select(F.col(doc_id).alias("__mf_id"), F.col(text).alias("__mf_text")).join(ids.hint("merge"), F.col("__mf_id") == F.col("__mf_target"), "left")
    ratio = log_ratio(gram_counts(marked, "__mf_text", "__mf_is"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = doc_ids(b.column(0))
            buf, off = T.buffer(b.column(1))
            weight = np.zeros(len(ids))
            grams = np.zeros(len(ids), np.int64)
            for i, j in T.slices(off):
                f, r = features(buf[off[i] : off[j]], off[i : j + 1] - off[i])
                weight[i:j] = np.bincount(r, ratio[f], j - i)
                grams[i:j] = np.bincount(r, minlength=j - i)
            key = weight + gumbel(ids, seed)
            bits = key.view(np.int64)
            bits = np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(ids), pa.array(grams), pa.array(weight), pa.array(key), pa.array(bits)], names=["doc_id", "__mf_id", "n_grams", "log_weight", "sample_key", "__mf_bits"])

    scored = cut(docs.select(F.col(doc_id), F.col(text)).mapInArrow(score, "doc_id long, __mf_id long, n_grams long, log_weight double, sample_key double, __mf_bits long"))
    n = scored.count()
    k = round(keep * n)
    if not k:
        chosen = F.lit(False)
    else:
        bits, last = select_top(scored, k, "__mf_bits", "__mf_id")
        chosen = (F.col("__mf_bits") > bits) | ((F.col("__mf_bits") == bits) & (F.col("__mf_id") <= last))
    return scored.withColumn("selected", chosen).drop("__mf_id", "__mf_bits")


def keep_share(labels: DataFrame, quality: str = "quality") -> float:
    """The part of labelled rows that are good."""
    return float(labels.agg(F.coalesce(F.avg((F.col(quality) == 1).cast("double")), F.lit(1.0))).first()[0])
