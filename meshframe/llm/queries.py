"""Queries of the training-data operators over the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshframe.llm import chat, decontaminate, jaccard_join, media, packing, resample, sharding, substring_dedup, suffix_dedup, toxicity
from meshframe.llm.common import prepare, table


def op1_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target text: documents labelled as good; the part of them among labelled rows is the part to keep."""
    prepare(spark)
    labels = table(spark, sf_dir, "labels")
    return resample.resample(table(spark, sf_dir, "documents"), labels.where("quality = 1"), resample.keep_share(labels))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = toxicity.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return out.select("doc_id", "held_out", "score", "predicted")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = substring_dedup.substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents").select("doc_id", "text"), n=3, num=90, den=100)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack_sequences(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    out = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_image_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplied tables hold no pictures: the media column is a picture of each row of embeddings."""
    prepare(spark)
    return media.image_copies(media.pictures(table(spark, sf_dir, "embeddings")))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = [(-1, 0, "user", chat.CONTROL_TEXT), (-1, 1, "assistant", chat.CONTROL_TEXT)]
    extra = spark.sql("SELECT " + " UNION ALL SELECT ".join(f"{c}L AS conv_id, {t}L AS turn, '{r}' AS role, '{x}' AS text" for c, t, r, x in rows))
    out = chat.format_chats(chats.unionByName(extra)).withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.loss_text(F.col("formatted"), F.col("loss_spans"))})
    whole = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_importance_resampling": op1_importance_resampling,
    "op2_decontamination": op2_decontamination,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_retrieval_packing": op5_retrieval_packing,
    "op6_histogram_sort": op6_histogram_sort,
    "op7_image_descriptors": op7_image_descriptors,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
}
ORACLES: dict[str, str] = {
    "op2_decontamination": decontaminate.OP2_SQL, "op3_suffix_dedup": suffix_dedup.OP3_SQL, "op4_jaccard_join": jaccard_join.OP4_SQL,
    "op8_chat_formatting": chat.OP8_SQL, "op10_substring_dedup": substring_dedup.OP10_SQL,
}
