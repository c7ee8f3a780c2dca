"""Queries of the corpus operators with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import automata, bpe, fingerprint, gif, jaccard, lines, mixing, private, suffix_array, toxicity
from quarry.llm.common import table


def rank_file() -> tuple[str, str]:
    """Path of the vocabulary and the split pattern that op3 and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go, and the SHA-256 of what stays."""
    kept = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.digest(table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), *rank_file())


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "worst_start",
        "worst_end",
        "worst_score",
    )


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.dedup(table(spark, sf_dir, "documents"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "copies", "taken")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [f"n_{k}" for k in private.KINDS]
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_discovered", "secrets", "n_found")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_gif_media, op3_byte_bpe, op4_toxicity, op5_suffix_array, op6_substring_dedup, op7_mix_sources, op8_personal_data, op9_ngram_jaccard, op10_fingerprint)
}

ORACLE: dict[str, str] = {"op7_mix_sources": mixing.ORACLE}
