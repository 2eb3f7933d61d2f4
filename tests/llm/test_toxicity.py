from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest

from palletwatch.llm import toxicity
from palletwatch.llm.queries import op3_subword_toxicity
from palletwatch.llm.toxicity import fitted, ngrams, scored, train
from tests.llm import odd


def test_ngrams_of_a_text_do_not_depend_on_its_neighbours():
    alone = ngrams(["Ab, cdé"])
    among = ngrams(["xyz", "Ab, cdé", ""])
    lo, hi = among[1][1], among[1][2]
    for (rows, valid), (all_rows, all_valid) in zip(alone[0], among[0], strict=True):
        assert (rows[valid] == all_rows[lo:hi][all_valid[lo:hi]]).all()
    # 3-grams with a word's end on either side: " ab", "ab ", " cd", "cdé", "dé "
    assert sum(int(valid.sum()) for _, valid in alone[0][:1]) >= 5


def made_up(n, seed):
    rng = random.Random(seed)
    plain = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 120))]
        if i % 3 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = "zwkvq" + rng.choice(plain)
        texts.append(" ".join(words))
        labels.append(int(i % 3 == 0))
    return texts, labels


def test_unseen_endings_are_found():
    model = train(*made_up(300, 1))
    texts, labels = made_up(150, 2)
    predicted = model.score([t.encode() for t in texts]) >= toxicity.THRESHOLD
    assert (predicted == np.array(labels, bool)).mean() > 0.95


def test_training_without_both_labels():
    assert train([], []).score([b"x"])[0] == 0.5
    assert train(["a b c"], [1]).score([b"a b c"])[0] > 0.9
    assert train(["a b c"], [0]).score([b"a b c"])[0] < 0.1


def test_odd_documents(spark):
    docs = odd.documents(spark, "score string, label string")
    known = spark.createDataFrame([(0, 1), (0, 0), (4, 0), (8, 1), (8, None), (77, 1), (5, 3), (None, 1)], "doc_id long, label int")
    got = scored(docs, fitted(docs, known))
    assert got.columns == ["doc_id", "text", "label", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(odd.TEXTS) + 3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    model = fitted(docs, known)
    none = model.score([b""])[0]
    assert all(abs(r["score"] - none) < 1e-12 for r in rows if not (r["text"] or "").strip())
    assert scored(odd.empty(spark), model).count() == 0


def test_sample_bounds(spark):
    docs = odd.documents(spark)
    known = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, label int")
    assert np.isfinite(fitted(docs, known, sample=1, clean=1).rows).all()


@pytest.mark.parametrize("sf", ["0.1"])
def test_held_out_accuracy(spark, sf):
    path = f"/root/testdata/sf{sf}"
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic")
    rows = op3_subword_toxicity(spark, path).filter("held_out").join(labels, "doc_id").collect()
    hit = [r for r in rows if r["toxic"] == 1]
    assert sum(r["predicted"] for r in hit) > 0.92 * len(hit)
    clean = [r for r in rows if r["toxic"] == 0]
    assert sum(r["predicted"] for r in clean) < 0.02 * len(clean)
    words = {r["doc_id"]: len(r["text"].split()) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    short = [r for r in clean if words[r["doc_id"]] < 20]
    assert len(short) > 20 and sum(r["predicted"] for r in short) < 0.05 * len(short)


def test_the_curve_asks_more_of_short_texts():
    texts, labels = made_up(400, 1)
    model = toxicity.train_with_curve(texts, labels)
    plain, none = "aeio lnrs tute", model.score([b""])[0]
    assert none < 0.3 and model.score([plain.encode()])[0] < 0.3
    assert model.score([b"zwkvqaei " + plain.encode() * 3])[0] < model.score([b"zwkvqaei zwkvqlon zwkvqtes " + b" aei lon" * 10])[0]
    odd_ones = [b"", b" \n", "é\u4e2d".encode(), b"x" * 5000, b"." * 50]
    together = model.score(odd_ones)
    assert together == pytest.approx([model.score([t])[0] for t in odd_ones])


def test_counting_holds_little_more_than_what_stays():
    texts, _ = made_up(600, 3)
    toxicity.Counts.of(texts[:10])
    tracemalloc.start()
    try:
        counts = toxicity.Counts.of(texts)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert counts.counts.itemsize == 1 and len(counts.rows) > 300_000
    fixed = 4 * toxicity.ROWS * 8  # some numbers for each row, however many texts there are
    assert most < counts.rows.nbytes + counts.counts.nbytes + fixed


def test_counts_of_texts_one_after_the_other():
    texts = ["abab cd", "", "abab", *["abab cd ef"] * 3, "xyzxyz", *["é" * 70_000] * 5, "..."]
    counts, each = toxicity.Counts.of(texts), [toxicity._counted(text) for text in texts]
    often = np.bincount(np.concatenate([rows for rows, _ in each]), minlength=toxicity.ROWS) >= toxicity.MIN_TEXTS
    assert counts.total.tolist() == [found.sum() for _, found in each]
    for i, (rows, found) in enumerate(each):
        span = slice(counts.begin[i], counts.begin[i + 1])
        assert (counts.rows[span] == rows[often[rows]]).all() and (counts.counts[span] == found[often[rows]]).all()
    assert counts.begin[-1] == len(counts.rows) == len(counts.counts) and counts.counts.max() > 65_535
