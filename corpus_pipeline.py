"""A corpus from raw documents: toxic ones go, repeated lines go, near copies go, sources are mixed, texts become ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame with the columns of documents (the last: what it made);
`run` writes each stage's rows as Parquet in the shared folder and reads them again as the next one's docs.

Null and empty texts are never toxic, have no lines, are linked with nothing, have size 0 (so the mix may take them at no cost
of words) and give no ids. Rows that share a doc_id, or lack one, are told apart wherever a row is kept or dropped; rows that
repeat both id and text are one document to the line dedup, and one of their near copies to the join, which keeps one row of
each component. Very long texts go whole through every stage. Further columns pass through all stages but the last,
whatever their names. Empty tables give empty tables; without labels no document is toxic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, jaccard, lines, mixing, toxicity
from quarry.llm.common import discard, release, store, table
from quarry.llm.queries import rank_file, toxicity_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model learns from the labels of the documents it is given."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).filter("score < 0.5").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without its repeated lines."""
    kept = lines.dedup(docs)
    counted = F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", counted).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones."""
    return jaccard.keep_one(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(mixing.mix(docs, keep_text=True)).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, as counts and hashes, and the hash of what they decode to."""
    return bpe.digest(docs, *rank_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix),
    ("byte-level BPE", tokenize),
]

#: A trained score and MinHash aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = store(docs, name.replace(" ", "-"))
            release(spark)
            if i:
                discard(before)
    return docs
