"""The training-data operators in a row: each stage takes documents and gives documents, the last one token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palletwatch.llm import decontaminate, sentencepiece_ids, simhash, substring_dedup, toxicity
from palletwatch.session import fresh_dir

PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_text(docs: DataFrame, text) -> DataFrame:
    return docs.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("bigint"))


def _set_aside(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` with its own columns of these names, which an operator would replace, under others."""
    return docs.withColumnsRenamed({name: f"own {name}" for name in names if name in docs.columns})


def _restored(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, those set aside under their own names again."""
    return result.select(*(F.col(f"own {c}").alias(c) if f"own {c}" in result.columns else F.col(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not taken for toxic. The classifier learns from labelled documents of the input, none held out."""
    labels = _table(spark, sf_dir, "labels").filter("toxic is not null").select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.scored(_set_aside(docs, "score", "predicted"), toxicity.fitted(docs, labels))
    return _restored(scored.filter("predicted = 0"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    return simhash.representatives(docs)


def drop_repeated_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without word windows that came earlier; one with nothing removed keeps its text as it is.

    Documents of which no word is left go; those that had none stay.
    """
    found = substring_dedup.removed_words(_set_aside(docs, "n_words", "n_removed", "kept", "_chunk"))
    found = found.filter("n_removed = 0 or n_removed < n_words")
    return _restored(_with_text(found, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))), docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the spans they share with test items; documents made of such spans only go."""
    plain = _set_aside(docs, "n_words", "hits", "items", "cleaned")
    found = decontaminate.decontaminated(plain, _table(spark, sf_dir, "benchmark"), clean=True)
    found = found.filter((F.size("hits") == 0) | (F.size("hits") < F.col("n_words")))
    return _restored(_with_text(found, F.col("cleaned")), docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text they decode to."""
    coded = sentencepiece_ids.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(PIECES), drop=("text",))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_windows),
    ("benchmark_decontamination", drop_test_items),
    ("sentencepiece", to_pieces),
]

# Scores, fingerprints and token ids are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. What each stage keeps is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    folder = fresh_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
