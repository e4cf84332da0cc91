"""Every registered query of the vector engine against its SQL, on sf0.001."""

import pytest

from stratavec.plans import catalog
from tests.compare import connect, differences

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(D)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    assert not differences(spark, con, D, name, catalog.QUERIES[name], catalog.SQL[name])
