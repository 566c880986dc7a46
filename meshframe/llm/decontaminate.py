"""Benchmark decontamination by winnowing, with DataFrame functions only.

Every text becomes lower-case words; of each run of `window` words the k-gram of least hash is its fingerprint, so a
shared run always shares a fingerprint. An item is reduced to the segments of its words that hold each of its windows
once, so what repeats within it is looked for once. Fingerprints of documents and segments meet in one equi-join of narrow
rows; every hit names a diagonal (document position minus segment position). A document then meets each segment once, with
all its diagonals, and they are compared word by word.

Defined cases: a null or empty text has no words and no hit; an item without words never occurs; an item shorter than
the window is one window of all its words; repeated rows are judged row by row, also when they share an id or have none;
an item id that repeats counts once; a null item id is left out of the digest; empty tables give no hits.
Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
GRAM = 5
#: What stands between words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Low bits of a fingerprint hold its position: a row of Spark cannot hold 2^28 words.
_POS_BITS = 28
_HIGH = -(1 << _POS_BITS)


def words(text: Column) -> Column:
    """Words of a text, A-Z lowered and no other letter."""
    t = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(t) == F.char_length(t)
    lowered = F.when(ascii_only, F.lower(t)).otherwise(F.translate(t, string.ascii_uppercase, string.ascii_lowercase))
    # splitting takes a fifth of the time of extracting the matches; empty strings stand only at the ends
    return F.array_remove(F.split(lowered, BETWEEN), "")


def _grams(w: Column, k: int) -> Column:
    """High bits: hash of the k words from a place on; low bits: the place, from 0."""
    none = F.array().cast("array<bigint>")
    return F.when(
        F.size(w) >= k,
        F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(F.slice(w, i + 1, k)).bitwiseAND(F.lit(_HIGH)).bitwiseOR(i.cast("bigint"))),
    ).otherwise(none)


def _winnow(grams: Column, n: Column, window: int, k: int) -> Column:
    """Distinct minima of all runs of window - k + 1 grams; on equal hashes the leftmost."""
    none = F.array().cast("array<bigint>")
    span = window - k + 1
    return F.when(n >= window, F.array_distinct(F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.array_min(F.slice(grams, i, span))))).otherwise(none)


def _exploded(df: DataFrame, keys: list[str], marks: Column, pos: str) -> DataFrame:
    out = df.select(*keys, F.explode(marks).alias("__mf_v"))
    return out.select(*keys, F.shiftright("__mf_v", _POS_BITS).alias("__mf_fp"), F.col("__mf_v").bitwiseAND(F.lit(~_HIGH)).cast("int").alias(pos))


def _fingerprints(df: DataFrame, keys: list[str], pos: str, window: int, k: int) -> DataFrame:
    hashed = df.select(*keys, F.size("__mf_w").alias("__mf_n"), _grams(F.col("__mf_w"), k).alias("__mf_g"))
    return _exploded(hashed, keys, _winnow(F.col("__mf_g"), F.col("__mf_n"), window, k), pos)


def segments(items: DataFrame, window: int) -> DataFrame:
    """__mf_seg (a number), __mf_item and __mf_w: stretches of items (__mf_item, __mf_w) that hold each of an item's windows once."""
    numbered = items.withColumn("__mf_no", F.xxhash64("__mf_item", "__mf_w"))
    n = F.size("__mf_w")
    grams = F.transform(F.sequence(F.lit(1), n - (window - 1)), lambda i: F.array_join(F.slice("__mf_w", i, window), " "))
    first = numbered.where(n >= window).select("__mf_no", F.posexplode(grams).alias("__mf_p", "__mf_g")).groupBy("__mf_no", "__mf_g").agg(F.min("__mf_p").alias("__mf_p"))
    kept = first.groupBy("__mf_no").agg(F.array_sort(F.collect_list("__mf_p")).alias("__mf_k")).withColumnRenamed("__mf_no", "__mf_of")
    k = F.col("__mf_k")
    starts = F.filter(k, lambda p, i: (i == 0) | (F.get(k, F.greatest(i - 1, F.lit(0))) < p - 1))
    ends = F.filter(k, lambda p, i: (i == F.size(k) - 1) | (F.get(k, F.least(i + 1, F.size(k) - 1)) > p + 1))
    cuts = F.when(k.isNull(), F.array(F.col("__mf_w"))).otherwise(F.zip_with(starts, ends, lambda a, z: F.slice("__mf_w", a + 1, z - a + window)))
    out = numbered.join(kept, F.col("__mf_no") == F.col("__mf_of"), "left").select("__mf_item", F.explode(cuts).alias("__mf_w"))
    return out.select(F.xxhash64("__mf_item", "__mf_w").alias("__mf_seg"), "__mf_item", "__mf_w").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = GRAM) -> DataFrame:
    """Documents with n_words, n_hit, n_items, items (sorted strings), hit_spans (word ranges) and contaminated."""
    items = benchmark.select(F.col(item_id).alias("__mf_item"), words(F.col(item_text)).alias("__mf_w")).where(F.size("__mf_w") > 0).distinct()
    parts = segments(items, window)
    # rows are told apart by their text too, so rows without id or of one id don't meet each other's hits
    doc_keys = ["__mf_doc", "__mf_sub"]
    slim = docs.select(F.col(doc_id).alias("__mf_doc"), F.xxhash64(text).alias("__mf_sub"), words(F.col(text)).alias("__mf_w"))
    left = _fingerprints(slim, doc_keys, "__mf_p", window, k)
    right = _fingerprints(parts, ["__mf_seg"], "__mf_q", window, k)
    found = left.join(right, "__mf_fp").select(*doc_keys, "__mf_seg", (F.col("__mf_p") - F.col("__mf_q")).alias("__mf_d"))
    short = parts.where(F.size("__mf_w") < window)
    lengths = [r[0] for r in short.select(F.size("__mf_w")).distinct().collect()]  # at most window - 1 numbers
    for n in sorted(lengths):
        a = _exploded(slim, doc_keys, _grams(F.col("__mf_w"), n), "__mf_p")
        b = _exploded(short.where(F.size("__mf_w") == n), ["__mf_seg"], _grams(F.col("__mf_w"), n), "__mf_q")
        found = found.unionByName(a.join(b, "__mf_fp").select(*doc_keys, "__mf_seg", F.col("__mf_p").alias("__mf_d")))
    # one row for each document and segment with its diagonals, then the few of a document together
    met = found.groupBy(*doc_keys, "__mf_seg").agg(F.collect_set("__mf_d").alias("__mf_ds")).join(parts.withColumnRenamed("__mf_w", "__mf_iw"), "__mf_seg")
    pairs = met.groupBy(*doc_keys).agg(F.collect_list(F.struct("__mf_item", "__mf_iw", "__mf_ds")).alias("__mf_c"))
    base = docs.withColumns({"__mf_key": F.col(doc_id), "__mf_text": F.xxhash64(text)})
    joined = base.join(pairs, F.col("__mf_key").eqNullSafe(F.col("__mf_doc")) & (F.col("__mf_text") == F.col("__mf_sub")), "left").withColumn("__mf_w", words(F.col(text)))

    def spans(iw: Column, d: Column) -> Column:
        """Runs of equal words along a diagonal that are long enough, as ranges of document words."""
        dw = F.col("__mf_w")
        lo = F.greatest(F.lit(0), -d)
        n = F.least(F.size(iw), F.size(dw) - d) - lo
        need = F.least(F.lit(window), F.size(iw))
        differ = F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.element_at(iw, lo + j + 1) != F.element_at(dw, d + lo + j + 1))
        before, after = F.concat(F.array(F.lit(-1)), differ), F.concat(differ, F.array(n))
        gaps = F.zip_with(before, after, lambda x, y: F.struct((d + lo + x + 1).alias("s"), (d + lo + y).alias("e")))
        return F.when(n >= need, F.filter(gaps, lambda g: g["e"] - g["s"] >= need)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))

    hits = F.filter(F.transform("__mf_c", lambda c: F.struct(c["__mf_item"].alias("item"), F.flatten(F.transform(c["__mf_ds"], lambda d: spans(c["__mf_iw"], d))).alias("spans"))), lambda x: F.size(x["spans"]) > 0)
    marked = joined.withColumn("__mf_h", hits)
    ranges = F.array_sort(F.flatten(F.transform("__mf_h", lambda x: x["spans"])))
    covered = F.aggregate(
        ranges, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end")),
        lambda a, r: F.struct((a["n"] + F.greatest(F.lit(0), r["e"] - F.greatest(r["s"], a["end"]))).cast("bigint").alias("n"), F.greatest(a["end"], r["e"]).alias("end")),
        lambda a: a["n"],
    )
    names = F.array_sort(F.array_distinct(F.transform("__mf_h", lambda x: x["item"].cast("string"))))
    out = marked.withColumns({
        "n_words": F.size("__mf_w").cast("bigint"),
        "n_hit": F.coalesce(covered, F.lit(0).cast("bigint")),
        "items": F.coalesce(names, F.array().cast("array<string>")),
        "hit_spans": F.coalesce(ranges, F.array().cast("array<struct<s:int,e:int>>")),
    })
    out = out.withColumn("n_items", F.size("items").cast("bigint")).withColumn("contaminated", F.col("n_hit") > 0)
    return out.drop("__mf_key", "__mf_text", "__mf_doc", "__mf_sub", "__mf_c", "__mf_w", "__mf_h")


OP2_SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM iw WHERE len(w) > 0) AS x),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n) AS x),
hits AS (SELECT grams.doc_id, grams.i, grams.n, win.item_id FROM grams JOIN win ON grams.n = win.n AND grams.g = win.g),
cov AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) AS x GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS s FROM hits) AS x GROUP BY doc_id)
SELECT dw.doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov ON dw.doc_id = cov.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
