"""Registered queries against their SQL, and the shape of all others."""

import pytest

import corpus_pipeline
from compare import connect, spark_rows, sql_rows
from reachline import llm

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.ORACLES))
def test_query_matches_its_sql(spark, name):
    found = spark_rows(llm.QUERIES[name](spark, FOLDER))
    wanted = sql_rows(connect(FOLDER), llm.ORACLES[name])
    assert found[0] == wanted[0]
    assert found[1] == wanted[1]


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.QUERIES) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "near_duplicates", "repeats", "mix", "pack"]
