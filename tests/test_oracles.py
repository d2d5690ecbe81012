"""Every query against its SQL on the smallest tables."""

import pytest

import oracle
from watchfold.plans.catalogue import QUERIES
from watchfold.plans.oracles import ORACLES


@pytest.fixture(scope="module")
def con(testdata):
    return oracle.connect(testdata)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, con, testdata):
    assert oracle.compare(spark, con, testdata, QUERIES[name], ORACLES[name]) is None
