from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from palletwatch.llm.ranked_search import Heap, Postings, impacts, pack, ranked, search, unpack
from tests.llm import brute, odd

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def slow(rows, items, most=20):
    """(item id, rank, doc id, score) from the definition."""
    terms = [TERM.findall(brute.lower(t)) for _, t in rows]
    n_docs, total = sum(1 for t in terms if t), sum(map(len, terms))
    counts = [Counter(t) for t in terms]
    df = Counter(term for c in counts for term in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for (doc, _), c, t in zip(rows, counts, terms, strict=True):
            score = 0
            for term in TERM.findall(brute.lower(text)):
                if c[term]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    m = 100 - 25 + 25 * len(t) * n_docs // total
                    score += w * (1000000000 * c[term] // (1000 * c[term] + 12 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, i, doc, -s) for i, (s, _, doc) in enumerate(found[:most], 1)]
    return out


def check(spark, docs, items, **settings):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = ranked(docs, spark.createDataFrame(items, "item_id long, text string"), **settings)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, slow(rows, items, settings.get("most", 20))))


def made_up(n, seed):
    """Documents over words of very different frequency, many of them alike."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [" ".join(rng.choices(words, weights, k=rng.randrange(1, 60))) for _ in range(n)]
    return texts + texts[: n // 4], words


def test_blocks_are_packed_and_unpacked():
    for most in (3, 255, 256, 70_000):
        a, b = np.array([1, most, 2]), np.array([1, 1, most])
        assert [x.tolist() for x in unpack(pack(a, b))] == [a.tolist(), b.tolist()]
    assert len(pack(np.ones(128, np.int64), np.ones(128, np.int64))) == 257


def lists_of(n, seed, block=8):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(75, 400, n)
    out, plain = [], []
    for share in (0.9, 0.5, 0.2, 0.02):
        documents = np.flatnonzero(rng.random(n) < share)
        times = rng.integers(1, 9, len(documents))
        impact = impacts(times, lengths[documents])
        at = np.arange(0, len(documents), block)
        gaps = np.diff(documents, prepend=-1)
        last = [int(documents[min(a + block, len(documents)) - 1]) for a in at]
        high = np.maximum.reduceat(impact, at).tolist()
        out.append(Postings(max(high), last, high, [pack(gaps[a : a + block], times[a : a + block]) for a in at], lengths))
        whole = np.zeros(n, np.int64)
        whole[documents] = impact
        plain.append(whole)
    return out, plain


@pytest.mark.parametrize("seed", range(5))
def test_search_finds_the_best_and_leaves_blocks_packed(seed):
    n, weights = 4000, [20, 700, 1600, 3900]
    lists, plain = lists_of(n, seed)
    heap = Heap(10)
    ids = np.arange(n) * 3
    search(lists, weights, ids, np.ones(n, bool), heap, step=256)
    score = sum(w * p for w, p in zip(weights, plain, strict=True))
    want = sorted(((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if s))[:10]
    assert [(-s, i) for s, i in zip(heap.scores.tolist(), heap.ids.tolist(), strict=True)] == want
    assert len(lists[0].open) < len(lists[0].blocks) / 2  # the list of the least weight is hardly ever unpacked


SETTINGS = [{}, {"shard_bytes": 400, "group_bytes": 2000, "query_bytes": 40, "step": 3}, {"vocabulary": 0, "shard_bytes": 900, "most": 3}]


@pytest.mark.parametrize("settings", SETTINGS)
def test_made_up_documents(spark, settings):
    texts, words = made_up(160, 4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rng = random.Random(9)
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for i in range(12)] + [(50, "W1 w1 w1, w250"), (51, "nowhere")]
    check(spark, docs, items, **settings)


def test_odd_documents_and_items(spark):
    items = [(1, odd.TEXTS[0]), (1, odd.TEXTS[0]), (1, odd.PASSAGE), (2, None), (3, ""), (None, "NAÏVE naïve café w1x1"), (5, "日本語 🙂"), (6, odd.LONG), (7, "tie Tie")]
    check(spark, odd.documents(spark, "term string, item string, score string"), items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ranked(odd.empty(spark), spark.createDataFrame([(1, "a")], none.schema)).count() == 0
    assert ranked(odd.documents(spark), none).count() == 0
