"""The driver contract: entry smoke, every registered query against its DuckDB twin at sf0.001."""

import pytest

import __spark_entry__ as E
from quarry.plans import catalog
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck

NAMES = sorted(n for n in E.queries() if n in catalog.QUERIES)  # the training-data queries have tests of their own


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(df.columns) >= {"source", "docs", "tokens", "share"}


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    info = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF_SMALL)
    assert info["ok"] in (True, None), info
    assert info["rows"] >= 0
