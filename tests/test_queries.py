"""Every registered query against its SQL twin on whole tables."""

import pytest

from gaugeworks import catalog
from tests.oracle import assert_equal, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_matches_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    text = catalog.oracle_sql().get(name)
    if text is None:
        assert df.collect() is not None
    else:
        assert_equal(df, con, text)
