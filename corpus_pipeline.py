"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents:
1. toxicity: documents that the classifier predicts to be toxic go;
2. n-gram Jaccard join (five words, similarity 0.8): of each group of near copies the smallest doc_id stays;
3. suffix-array dedup: bytes of passages of 100 bytes that start earlier go from the texts; a character cut in two goes;
4. benchmark decontamination: documents with a benchmark passage go;
5. packing: pieces of documents in sequences of 2048 tokens, with their ids.

Rows without doc_id or text pass all stages as their operators define it: a null text counts as empty, and rows without
doc_id are told apart by their texts. Further columns pass all stages, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.llm import decontaminate, jaccard_join, packing, suffix_dedup, toxicity
from meshframe.llm.common import checkpoint_dir, prepare, table
from meshframe.llm.queries import tokenizer_path


def _apart(docs: DataFrame) -> DataFrame:
    """documents with names for the further columns that no operator gives to a result."""
    return docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"__mf_{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")))


def _back(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs again."""
    return out.select(*(F.col(c if c in ("doc_id", "text") else f"__mf_{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return _back(toxicity.score(_apart(docs), labels).where("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    # rows without doc_id are documents by their text, so a copy among them takes no other of them along
    named = _apart(docs).withColumn("node", jaccard_join.node_of("doc_id", "text"))
    gone = jaccard_join.node_components(named.select("node", "text"), n=5, num=4, den=5).where("root <> node").select("node").distinct()
    return _back(named.join(gone, "node", "left_anti"), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    # decoded where the texts are cut: a second Python step in a task would be two workers more that stay in an executor
    out = _back(suffix_dedup.suffix_dedup(_apart(docs), as_text=True).withColumn("text", F.col("kept")), docs)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return _back(decontaminate.decontaminate(_apart(docs), table(spark, sf_dir, "benchmark")).where("NOT contaminated"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_sequences(docs.select("doc_id", "text"), tokenizer_path(), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained classifier and packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again, and goes once the next stage is written."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
