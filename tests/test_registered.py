"""Every registered query against its checking SQL on the smallest data."""

import pytest
from compare import ROOT, compare, connect

from lettertrail.plans import registry

registry.load_all()
SF_DIR = f"{ROOT}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF_DIR, name) is None
