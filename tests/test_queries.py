"""Every registered query against its comparison SQL at the smallest scale."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from compare import connect, differences  # noqa: E402

OPTIONAL = set(entry.llm.QUERIES) if entry.llm else set()
QUERIES = {name: query for name, query in entry.queries().items() if name not in OPTIONAL}
ORACLE = {name: sql for name, sql in entry.oracle_sql().items() if name not in OPTIONAL}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_comparison_sql():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, con, sf_dir):
    assert differences(spark, con, QUERIES[name], ORACLE[name], sf_dir) is None


def test_entry_is_the_flagship_report(spark):
    assert set(entry.entry(spark).columns) == {"host", "grade", "pages", "avg_score", "critical"}
