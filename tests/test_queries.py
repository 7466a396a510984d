"""Every core query against its DuckDB statement, and those without one for running at all."""

import pytest

from murmur.plans import registry
from tests.oracle import DATA, same

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    same(spark, QUERIES[name], SQL[name])


#: Queries that SQL cannot express, with their columns; their operators are tested against plain versions.
OTHERS = {
    "Q27_manifest": ["query", "operators"],
    "T1_stemmed_vocabulary": ["token", "posts"],
    "T6_stemmed_search": ["id", "bm25", "phrases"],
    "V10_Q4_content_clusters": ["group_no", "size", "ids", "similarity", "total_likes", "total_shares", "label"],
}


def test_all_others_are_known():
    assert set(QUERIES) - set(SQL) == set(OTHERS)


@pytest.mark.parametrize("name", sorted(OTHERS))
def test_has_rows(spark, name):
    rows = QUERIES[name](spark, DATA)
    assert rows.columns == OTHERS[name] and (rows.count() > 0 or name == "T6_stemmed_search")


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "x_score", "tone"]
    assert set(e.oracle_sql()) <= set(e.queries())
