from __future__ import annotations

import random

from palletwatch.llm.decontaminate import NORMAL, Automaton, decontaminated
from palletwatch.llm.blocks import Words
from tests.llm import brute, odd

ITEMS = [(1, "What is the capital of the old kingdom, and why did it move so far?"), (2, "Short ITEM here"), (3, None), (4, "..."), (5, "Short item here"), (None, "Nobody's item")]


def test_random_items_and_texts():
    rng = random.Random(1)
    for _ in range(300):
        def text(n):
            return " ".join(rng.choice(["a", "b", "C", "d"]) for _ in range(rng.randrange(n)))

        items = [(rng.randrange(5), text(9)) for _ in range(rng.randrange(5))]
        docs = [text(30) for _ in range(4)]
        span, coverage = rng.choice([1, 2, 3, 5, 10]), rng.choice([0.3, 0.5, 1.0])
        words = Words.of([d.encode() for d in docs], lower=NORMAL)
        starts, sizes, found = Automaton([(i, t.encode()) for i, t in items], span, coverage).search(words)
        places = [set() for _ in docs]
        for start, size in zip(starts.tolist(), sizes.tolist(), strict=True):
            doc = int(words.text[start])
            places[doc] |= {p - int(words.first[doc]) for p in range(start, start + size)}
        got = [(int(n), places[i], found.get(i, set())) for i, n in enumerate(words.counts)]
        assert got == [brute.hits(d, items, span, coverage) for d in docs]


def test_odd_documents_in_one_and_in_many_blocks(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = odd.documents(spark, "items string, lang string").unionByName(spark.createDataFrame(
        [(100, f"See: {ITEMS[0][1].upper()} Yes.", "x", "en"), (101, "short, item\nHERE and Nobody s item", "x", "en"), (102, "short item", "x", "en")],
        "doc_id long, text string, items string, lang string",
    ))
    for block in (1 << 20, 10):
        got = decontaminated(docs, items, block_bytes=block).collect()
        assert len(got) == len(odd.TEXTS) + 6
        for r in got:
            n, places, found = brute.hits(r["text"], ITEMS)
            assert (r["n_words"], set(r["hits"]), r["items"]) == (n, places, sorted(i for i in found if i is not None)), r["doc_id"]
        assert {r["doc_id"] for r in got if r["hits"]} == {100, 101}


def test_plan_and_columns_do_not_depend_on_the_number_of_blocks(spark):
    items = spark.createDataFrame(ITEMS + ITEMS, "item_id long, text string")
    docs = odd.documents(spark, "_hits string, hash string, block string, text_hash string")
    plans = []
    for block in (60, 1):
        got = decontaminated(docs, items, block_bytes=block)
        assert got.columns == [*docs.columns, "n_words", "hits", "items"] and got.count() == len(odd.TEXTS) + 3
        plans.append(got._jdf.queryExecution().analyzed().toString().count("\n"))
    assert plans[0] == plans[1]


def test_cleaned_text_keeps_what_stands_around(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(1, "Héllo, (Short item  HERE)! Rest."), (2, "none"), (3, None), (4, "short item here")], "doc_id long, text string")
    for block in (1 << 20, 10):
        got = {r["doc_id"]: r["cleaned"] for r in decontaminated(docs, items, block_bytes=block, clean=True).collect()}
        assert got == {1: "Héllo, ()! Rest.", 2: "none", 3: None, 4: ""}


def test_empty_tables(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminated(odd.empty(spark), items).count() == 0
    assert decontaminated(odd.documents(spark), items).filter("size(hits) > 0").count() == 0
