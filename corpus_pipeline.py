"""Clean a training corpus in five stages, each a Spark job over all that the one before it kept.

``run(spark, sf_dir)`` reads ``documents`` and writes the result of every stage as Parquet into the
shared folder, from which the next stage reads it; a lost executor re-reads a stage's input instead
of running the stages before it again.

Every stage takes an empty table, repeated rows, null ids and texts, very long texts and columns of any
name beside those of ``documents``, which pass through all but the last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spreadwise.llm.decontaminate import drop_contaminated
from spreadwise.llm.frames import crc_mod, read_table, staged
from spreadwise.llm.minhash_dedup import drop_near_duplicates
from spreadwise.llm.queries import vocabulary
from spreadwise.llm.sentencepiece_codec import sentencepiece_round_trip
from spreadwise.llm.substring_dedup import cut_repeated_passages
from spreadwise.llm.toxicity import reject_toxic

#: SQL expresses neither the fitted classifier, the sketches nor the tokenizer; every stage is
#: tested against a brute-force version instead.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents scored 0.5 or more go. Null and empty texts are scored as texts without words;
    without a label to learn from every row stays."""
    return reject_toxic(docs, read_table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) == 0)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each class of near duplicates the document with the least id stays, and every row without words."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: words in 35-word passages that occur elsewhere are cut; n_chars is kept true. Every row stays, with
    empty text if nothing is left; null text stays null."""
    cut = cut_repeated_passages(docs, window=35)
    if "n_chars" not in docs.columns:
        return cut
    return cut.selectExpr(*[f"cast(char_length(text) as {docs.schema['n_chars'].dataType.simpleString()}) as n_chars"
                            if c == "n_chars" else f"`{c}`" for c in cut.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that hold a 10-word window of a benchmark item go; null and empty texts stay, and without
    items all do."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"), window=10)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids of every document, with the text decoded from them; a null text is empty."""
    return sentencepiece_round_trip(docs, vocabulary("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
    ("decontamination", decontamination), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
