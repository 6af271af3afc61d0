"""Each query that goes through a store against its SQL."""

import os

import pytest

from stratalog.plans import stored

from .oracle import DATA, agree

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(stored.QUERIES))
def test_query(spark, name):
    assert agree(spark, stored.QUERIES[name], stored.SQL[name])
