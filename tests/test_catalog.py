"""Every query of the engine beside its SQL."""

import os

import pytest

from helixframe.plans import catalog
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="without test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(spark, con, catalog.queries()[name], catalog.oracle_sql()[name], SF_DIR) == ""


def test_entry_returns_rows(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["kmer", "dist", "neigh_cnt", "positions"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
