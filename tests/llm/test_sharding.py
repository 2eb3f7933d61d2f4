from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from palletwatch.llm.sharding import _hash, fill, lookup_table, sharded
from tests.llm import odd

NAMES = [f"s{i}" for i in range(7)]


def slow_fill(shards, size):
    """Whole orders of preference, and turns one by one."""
    orders = [[(_hash(s, "offset:") + j * (_hash(s, "skip:") % (size - 1) + 1)) % size for j in range(size)] for s in shards]
    owner = [-1] * size
    for turn in range(size):
        mine = orders[turn % len(shards)]
        owner[next(slot for slot in mine if owner[slot] < 0)] = turn % len(shards)
    return owner


@pytest.mark.parametrize("size", [7, 101, 1009])
def test_turns(size):
    assert fill(NAMES, size) == slow_fill(NAMES, size)


def test_shares_are_even_and_few_keys_move():
    before, after = fill(NAMES, 4099), fill(NAMES[:-1], 4099)
    counts = Counter(before)
    assert max(counts.values()) - min(counts.values()) <= 1
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 6)
    assert moved < 0.1 * 4099


@pytest.mark.parametrize("shards, size", [([], 7), (["a", "a"], 7), (["a"], 8), (NAMES, 5), (["a"], 1)])
def test_bad_tables_are_refused(shards, size):
    with pytest.raises(ValueError):
        fill(shards, size)


def test_odd_documents(spark):
    docs = odd.documents(spark, "slot string, shard string, lang string")
    got = sharded(docs, F.col("doc_id"), NAMES, 101)
    assert got.columns == ["doc_id", "text", "lang", "slot", "shard"]
    rows = got.collect()
    table = fill(NAMES, 101)
    assert len(rows) == len(odd.TEXTS) + 3
    for r in rows:
        assert r["slot"] == _hash("" if r["doc_id"] is None else str(r["doc_id"]), "") % 101
        assert r["shard"] == NAMES[table[r["slot"]]]
    assert sharded(odd.empty(spark), F.col("doc_id"), NAMES, 101).count() == 0


def test_only_dataframe_operations_and_no_shuffle(spark):
    plan = sharded(odd.documents(spark).select("doc_id"), F.col("doc_id"), NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "Arrow" not in plan
    assert lookup_table(spark, NAMES, 101).count() == 101
