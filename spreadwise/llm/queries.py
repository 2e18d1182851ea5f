"""Registered queries of the operators: thin, each over its whole table, digest columns only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_lm import score_texts
from .conversation_repair import damage_conversations, repair_conversations, repaired_digests
from .decontaminate import find_benchmark_spans
from .frames import crc_mod, read_table
from .language_id import identify_language
from .minhash_dedup import near_duplicate_classes
from .oracle import SQL
from .personal_data import KINDS, find_personal_data
from .quality import judge_quality
from .ranked_search import search_ranked
from .sentencepiece_codec import sentencepiece_round_trip
from .substring_dedup import remove_repeated_passages
from .suffix_dedup import remove_repeated_bytes
from .token_file import token_file_round_trip
from .toxicity import score_toxicity


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_passages(read_table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeated_bytes(read_table(spark, sf_dir, "documents"), window=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_benchmark_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, installed alike on every machine."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_round_trip(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"), digests=True)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(read_table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 0)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(read_table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


def op8_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_round_trip(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2, digests=True)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = judge_quality(read_table(spark, sf_dir, "documents")).withColumn("base_failed", failed)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~failed & F.col("kept")).alias("kept"), "p_good")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read_table(spark, sf_dir, "conversations")
    summary, edits = repair_conversations(damage_conversations(conversations), "conv")
    every = conversations.select("conv_id").distinct()
    of = lambda df, name: df.withColumnRenamed("conv", name)
    out = (every.join(of(summary, "of"), F.col("conv_id").eqNullSafe(F.col("of")), "left")
           .join(of(repaired_digests(edits, "conv"), "left_of"), F.col("conv_id").eqNullSafe(F.col("left_of")), "left"))
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(read_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter(F.transform(base, lambda s: s["kind"]), F.lit(kind).eqNullSafe)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return out.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=50)


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of operator 9 that SQL can state."""
    return op9_quality(spark, sf_dir).drop("kept", "p_good")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of operator 6 that SQL can state; the score to four decimals."""
    out = op6_lm_scoring(spark, sf_dir)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def personal_data_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of operator 12 that SQL can state."""
    return op12_personal_data(spark, sf_dir).drop("base_sha256", "spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_substring_dedup, op2_minhash_dedup, op3_suffix_dedup, op4_sentencepiece, op5_language_id, op6_lm_scoring,
        op7_toxicity, op8_token_file, op9_quality, op10_decontaminate, op11_conversation_repair,
        op12_personal_data, op13_ranked_search, quality_base_counts, lm_base_scores, personal_data_base_counts,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
