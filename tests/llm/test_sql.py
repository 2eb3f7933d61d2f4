"""Registered queries against their SQL, and the registry itself."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
import corpus_pipeline
from palletwatch.llm.oracle import ORACLE
from palletwatch.llm.queries import QUERIES
from tests.compare import assert_same, database
from tests.conftest import TESTDATA


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, name, sf):
    path = f"{TESTDATA}/sf{sf}"
    assert assert_same(QUERIES[name](spark, path), name, database(path))


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.partition("_")[0] for name in QUERIES}
    assert {*QUERIES, "pipeline"} <= set(entry_point.queries())
    assert set(ORACLE) <= set(entry_point.oracle_sql())
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "sentencepiece"
    ]
