"""Every registered query outside the training-data part against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from duck import DATA, same

QUERIES = {name: f for part in entry.PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: s for part in entry.PARTS for name, s in part.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    same(spark, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["qid", "doc_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
