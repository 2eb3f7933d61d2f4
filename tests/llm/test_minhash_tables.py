from __future__ import annotations

import random

import numpy as np
import pytest

from palletwatch.llm import minhash_tables
from palletwatch.llm.minhash_tables import DEPTH, SIDE, entries, near_duplicates, shingle_sets, spanning_links
from tests.llm import brute, odd


def shingles(text):
    w = brute.words(brute.lower(text))
    return {tuple(w[i : i + 2]) for i in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()


def linked(a, b, percent=80):
    return bool(a) and bool(b) and 100 * len(a & b) >= percent * len(a | b)


def roots(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if linked(a, sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def check(df, **settings):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    sets = [shingles(t) for _, t in rows]
    label, ids = roots(sets), {}
    for (doc, _), n in zip(rows, label, strict=True):
        if doc is not None:
            ids[n] = min(doc, ids.get(n, doc))
    want = []
    for (doc, _), s, n in zip(rows, sets, label, strict=True):
        component = ids.get(n) if s else doc
        want.append((doc, len(s), component, doc is not None and doc == component))
    assert sorted(map(repr, map(tuple, near_duplicates(df, **settings).collect()))) == sorted(map(repr, want))


def near_copies(n, seed, words=60):
    """Texts in families whose members differ from one another by a few words, around the limit of similarity."""
    rng = random.Random(seed)
    texts = []
    while len(texts) < n:
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(rng.choice([1, 2, 3, 40])):
            copy = list(base)
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts[:n]


def test_sets_of_odd_texts():
    found = shingle_sets([t.encode() if t is not None else None for t in odd.TEXTS])
    assert [len(s) for s in found] == [len(shingles(t)) for t in odd.TEXTS]
    assert all((np.diff(s) > 0).all() for s in found if len(s) > 1)
    assert shingle_sets([]) == []


def test_entries_are_shared_as_often_as_they_should():
    rng = np.random.default_rng(3)
    hits = 0
    for _ in range(200):
        base = rng.integers(0, 2**63, 90, dtype=np.int64).astype(np.uint64)
        a, b = entries([np.unique(base[:85]), np.unique(np.concatenate([base[:80], base[85:]]))])  # 80 of 90 in common
        hits += (a == b).mean()
    assert abs(hits / 200 - (80 / 90) ** DEPTH) < 0.03
    assert entries([]).shape == (0, 2 * SIDE)


@pytest.mark.parametrize("seed", [1, 2])
def test_links_span_the_components(seed):
    texts = near_copies(90, seed)
    sets = shingle_sets([t.encode() for t in texts])
    root = list(range(len(texts)))

    def find(i):
        return i if root[i] == i else find(root[i])

    found = list(spanning_links(sets))
    for i, j in found:
        x, y = find(i), find(j)
        root[max(x, y)] = min(x, y)
    want = roots([shingles(t) for t in texts])
    assert [find(i) for i in range(len(texts))] == want
    assert len(found) == len(texts) - len(set(want))
    assert list(spanning_links([sets[0], sets[0]])) == [(0, 1)]


@pytest.mark.parametrize("group_bytes", [minhash_tables.GROUP_BYTES, 4000])
def test_near_copies(spark, group_bytes):
    docs = spark.createDataFrame([(3 * i % 400, t) for i, t in enumerate(near_copies(300, 5))], "doc_id long, text string")
    check(docs.repartition(4), group_bytes=group_bytes)


def test_odd_documents(spark):
    check(odd.documents(spark, "node string, entries string, component_id string"))


def test_repeated_ids_and_no_ids(spark):
    rows = [(5, "a b c d e f"), (5, "q r s t u v"), (2, "q r s t u v"), (None, "A b c D e f"), (None, "only here without id"), (None, "only here without id"), (7, "")]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_empty_table(spark):
    assert near_duplicates(odd.empty(spark)).count() == 0
