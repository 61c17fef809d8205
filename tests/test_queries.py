import pytest

import __spark_entry__ as entry
from compare import connect, spark_rows, sql_rows
from reachline import plans

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    return connect(FOLDER)


def test_every_query_has_a_check():
    assert set(plans.queries()) == set(plans.oracle_sql())
    assert set(plans.queries()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 35


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_matches_its_check(spark, sql, name):
    found = spark_rows(entry.queries()[name](spark, FOLDER))
    wanted = sql_rows(sql, entry.oracle_sql()[name])
    assert found[0] == wanted[0]
    assert len(found[1]) == len(wanted[1])
    assert found[1] == wanted[1]
