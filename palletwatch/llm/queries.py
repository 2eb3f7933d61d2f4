"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palletwatch.llm import (
    decontaminate,
    html_extract,
    lm_scoring,
    minhash_tables,
    quality,
    ranked_search,
    sentencepiece_ids,
    sharding,
    simhash,
    substring_dedup,
    tokenizer_alignment,
    toxicity,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]

SHARDS = [f"shard-{i:02d}" for i in range(32)]
PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_50k.json"
CRAWL_DATE = "2024-01-01T00:00:00Z"


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def texts(spark: SparkSession, path: str) -> DataFrame:
    return table(spark, path, "documents").select("doc_id", "text")


def op1_lookup_sharding(spark: SparkSession, path: str) -> DataFrame:
    """The shard of every document, by its id."""
    return sharding.sharded(table(spark, path, "documents").select("doc_id"), F.col("doc_id"), SHARDS)


def op2_fixed_divergence(spark: SparkSession, path: str) -> DataFrame:
    """Counts, limits and the verdict of the distances to fixed references for every document."""
    judged = quality.judged(table(spark, path, "documents").select("doc_id", "lang", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op3_subword_toxicity(spark: SparkSession, path: str) -> DataFrame:
    """A score for every document, learnt from labelled rows that are not held out."""
    docs, labels = texts(spark, path), table(spark, path, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    known = labels.filter(~held_out & F.col("toxic").isNotNull()).select("doc_id", F.col("toxic").alias("label"))
    scored = toxicity.scored(docs, toxicity.fitted(docs, known), drop=("text",))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op4_block_tree_extraction(spark: SparkSession, path: str) -> DataFrame:
    """The main text of every page."""
    pages = html_extract.extracted(table(spark, path, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_super_kmer_dedup(spark: SparkSession, path: str) -> DataFrame:
    """What is left of every document without windows seen before."""
    return substring_dedup.removed_words(texts(spark, path)).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )


def op6_pigeonring_simhash(spark: SparkSession, path: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(texts(spark, path))


def op7_warc_derivatives(spark: SparkSession, path: str) -> DataFrame:
    """Metadata and conversion records of every page's response."""
    responses = warc.page_responses(table(spark, path, "pages"), CRAWL_DATE)
    return warc.derived_records(responses, keep=("page_id",))


def op8_trigram_backoff(spark: SparkSession, path: str) -> DataFrame:
    """The score of every document, from every count of n-grams up to three words in all other documents."""
    return lm_scoring.scores(texts(spark, path)).select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"))


def op9_suffix_automaton(spark: SparkSession, path: str) -> DataFrame:
    """Words of every document inside test items, and which items these are."""
    found = decontaminate.decontaminated(texts(spark, path), table(spark, path, "benchmark"))
    items = F.concat_ws(",", F.array_sort(F.transform("items", lambda i: i.cast("string"))))
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op10_chunk_table_pieces(spark: SparkSession, path: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    coded = sentencepiece_ids.encode(texts(spark, path), public_tokenizers.path(PIECES), drop=("text",))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_pointer_jumping(spark: SparkSession, path: str) -> DataFrame:
    """How the tokens of two tokenizers line up in every document."""
    found = tokenizer_alignment.aligned(
        texts(spark, path), public_tokenizers.path(BYTES), public_tokenizers.path(PIECES), drop=("text",)
    )
    return found.select("doc_id", *tokenizer_alignment.FIGURES, "groups_sha256")


def op12_tensored_minhash(spark: SparkSession, path: str) -> DataFrame:
    """Set size and component of every document."""
    return minhash_tables.near_duplicates(texts(spark, path))


def op13_block_max_maxscore(spark: SparkSession, path: str) -> DataFrame:
    """The twenty best documents for every test item."""
    return ranked_search.ranked(texts(spark, path), table(spark, path, "benchmark"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_lookup_sharding, op2_fixed_divergence, op3_subword_toxicity, op4_block_tree_extraction,
        op5_super_kmer_dedup, op6_pigeonring_simhash, op7_warc_derivatives, op8_trigram_backoff, op9_suffix_automaton, op10_chunk_table_pieces,
        op11_pointer_jumping, op12_tensored_minhash, op13_block_max_maxscore,
    )
}
