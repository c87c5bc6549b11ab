"""The registered queries of this folder on the smallest tables."""

from pathlib import Path

import pytest

from helpers import differences
from vislake import llm

FOLDER = "/root/testdata/sf0.001"
MODULES = [__import__(f"vislake.llm.{m}", fromlist=["QUERIES"]) for m in llm.QUERY_MODULES]
QUERIES = {n: f for m in MODULES for n, f in m.QUERIES.items()}
SQL = {n: s for m in MODULES for n, s in m.ORACLE.items()}

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, name):
    ours, theirs, more, less = differences(spark, name, QUERIES[name], SQL[name], FOLDER)
    assert (ours, more, less) == (theirs, [], [])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
