from __future__ import annotations

import random

import numpy as np
import pytest

from palletwatch.llm import substring_dedup
from palletwatch.llm.blocks import Words
from palletwatch.llm.substring_dedup import removed_words, super_kmers
from tests.llm import brute, odd


def check(df, size=20, inner=5):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    want = sorted(
        (repr(row), len(w), len(w) - sum(stay), b" ".join(x for x, s in zip(w, stay, strict=True) if s).decode())
        for row, (w, stay) in zip(rows, brute.kept_words(rows, size), strict=True)
    )
    got = removed_words(df, size, inner)
    assert sorted((repr((r["doc_id"], r["text"])), r["n_words"], r["n_removed"], r["kept"]) for r in got.collect()) == want
    return sum(w[2] for w in want)


def test_odd_documents(spark):
    assert check(odd.documents(spark)) > 100


def test_chunks_and_buckets_do_not_matter(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK_BYTES", 300)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 200)
    monkeypatch.setattr(substring_dedup, "LONGEST", 3)
    rng = random.Random(3)
    rows = [(rng.randrange(40), " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))) for _ in range(60)]
    assert check(spark.createDataFrame(rows, "doc_id long, text string"), 6, 3) > 100


@pytest.mark.parametrize("sf", ["0.001"])
def test_given_documents(spark, sf):
    assert check(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").select("doc_id", "text")) > 0


def test_other_columns_stay_and_clashing_ones_give_way(spark):
    got = removed_words(odd.documents(spark, "lang string, n_words string, _chunk string, bucket string"))
    assert got.columns == ["doc_id", "text", "lang", "bucket", "n_words", "n_removed", "kept"]
    assert got.filter("lang = '7' and bucket = '7'").count() == got.count() == len(odd.TEXTS) + 3


def test_empty_table(spark):
    assert removed_words(odd.empty(spark)).count() == 0


def test_frequent_inner_runs_are_avoided():
    common = "x y z"
    rng = random.Random(1)
    texts = [(" ".join(f"{rng.random()}" for _ in range(12)) + f" {common} " + " ".join(f"{rng.random()}" for _ in range(12))).encode() for _ in range(50)]
    words = Words.of(texts)
    none = np.empty(0, np.uint64)
    keys, counts = np.unique(super_kmers(words, 10, 3, none).key, return_counts=True)
    hot = words.window_hashes(3, np.array([12])) >> np.uint64(1)
    runs = super_kmers(words, 10, 3, hot)
    assert hot[0] not in runs.key and counts.max() >= 1
    at = words.windows(10)
    assert runs.windows.sum() == len(at)  # each window travels, once


def test_inner_runs_must_fit(spark):
    with pytest.raises(ValueError):
        removed_words(odd.empty(spark), 5, 6)
