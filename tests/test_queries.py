"""Every registered query of the core against its SQL, on the smallest tables."""

import pytest

from tests import oracle
from tessera.operators import content, index
from tessera.plans.query import compile_query
from tessera.queries import general, search

CORE = {**general.QUERIES, **search.QUERIES}
SQL = {**general.SQL, **search.SQL}


@pytest.mark.skipif(not oracle.DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, name):
    oracle.same(spark, CORE[name], SQL[name])


@pytest.mark.skipif(not oracle.DATA.exists(), reason="needs the test tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "rel_path", "line_number", "content", "start", "end"]
    assert set(e.oracle_sql()) <= set(e.queries()) and set(CORE) <= set(e.queries())


@pytest.mark.skipif(not oracle.DATA.exists(), reason="needs the test tables")
def test_search_without_index_does_not_shuffle(spark):
    docs = index.with_words(search.docs(spark, str(oracle.DATA)))
    plan = content.matches(docs, compile_query("return error"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    scan = CORE["key_prefix_scan"](spark, str(oracle.DATA))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(row_key,kw:7|s)" in scan and "docids" not in scan
