from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palletwatch.llm import simhash
from palletwatch.llm.simhash import components, fingerprints, links, near_duplicates, representatives
from tests.llm import brute, odd


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprints_of_odd_texts():
    data = [t.encode() if t is not None else None for t in odd.TEXTS]
    assert fingerprints(data).tolist() == [signed(brute.fingerprint(t)) for t in odd.TEXTS]
    assert fingerprints([None, b"", b" \n"]).tolist() == [0, 0, 0]
    assert fingerprints([]).tolist() == []


def near(rng, n, centres=3, flips=6):
    base = [rng.getrandbits(64) for _ in range(centres)]
    found = {0}
    while len(found) < n:
        x = rng.choice(base)
        for _ in range(rng.randrange(flips)):
            x ^= 1 << rng.randrange(64)
        found.add(x)
    return sorted(found)


@pytest.mark.parametrize("small, split", [(64, 4096), (2, 4096), (2, 8)])
@pytest.mark.parametrize("most", [0, 1, 2, 3])
def test_links_join_exactly_the_components(spark, monkeypatch, small, split, most):
    monkeypatch.setattr(simhash, "SMALL", small)
    monkeypatch.setattr(simhash, "SPLIT", split)
    points = near(random.Random(small + split + most), 400)
    df = spark.createDataFrame([(signed(p),) for p in points], "fingerprint long")
    found = components(links(df, most)).collect()
    root = {r["node"]: r["root"] for r in found}
    label = [root.get(signed(p), signed(p)) for p in points]
    want = brute.components(points, most)
    assert len(set(label)) == len(set(want))
    assert len(set(zip(label, want, strict=True))) == len(set(want))


def test_every_pair_within_three_bits_shares_a_key(spark):
    rng = random.Random(5)
    a = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for bit in rng.sample(range(64), rng.randrange(4)):
            b[i] ^= np.uint64(1 << bit)
    met = np.zeros(len(a), bool)
    for start in range(8):
        for pair in ((2, 3), (2, 4), (3, 4)):
            same = simhash._linked(a, b, np.full(len(a), start), 3)
            for s in (0, 1, *pair):
                turn = np.uint64(8 * ((start + s) % 8))
                same &= (a >> turn) & np.uint64(255) == (b >> turn) & np.uint64(255)
            met |= same
    assert met.all()


def test_components_of_long_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(0, 200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    got = components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    prints = [brute.fingerprint(t) for _, t in rows]
    label = brute.components(prints)
    ids = {}
    for (doc, _), n in zip(rows, label, strict=True):
        if doc is not None:
            ids[n] = min(doc, ids.get(n, doc))
    want = [(doc, f"{p:016x}", ids.get(n)) for (doc, _), p, n in zip(rows, prints, label, strict=True)]
    got = near_duplicates(df)
    assert sorted(map(repr, map(tuple, got.select("doc_id", "fingerprint", "component_id").collect()))) == sorted(map(repr, want))


def test_odd_documents(spark):
    check(odd.documents(spark, "fingerprint string, root string"))


def test_given_documents(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_empty_table(spark):
    assert near_duplicates(odd.empty(spark)).count() == 0
    assert representatives(odd.empty(spark)).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = spark.createDataFrame(
        [(3, "one two three four"), (2, "one two three four"), (2, "one two three four"), (None, "one two three four"),
         (None, "quite another text here"), (None, "quite another text here"), (9, None), (8, "")],
        "doc_id long, text string",
    ).withColumn("fingerprint", F.lit("mine"))
    got = representatives(docs)
    assert got.columns == docs.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [
        (2, "one two three four", "mine"), (None, "quite another text here", "mine"), (8, "", "mine")]))


def test_no_group_is_lost_where_one_id_is_in_two(spark):
    a, b = "zeta alpha beta gamma delta", "one two three four five six"
    docs = spark.createDataFrame([(5, a), (7, a), (5, b), (6, b), (2, b)], "doc_id long, text string")
    docs = docs.withColumns({"_own": F.lit("x"), "hash": F.lit("y"), "place": F.lit("z"), "fingerprint": F.lit("w")})
    got = representatives(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect())) == [(2, b, "x", "y", "z", "w"), (5, a, "x", "y", "z", "w")]


def test_distances_beyond_the_keys_are_refused(spark):
    with pytest.raises(ValueError):
        links(spark.createDataFrame([(1,)], "fingerprint long"), 4)
