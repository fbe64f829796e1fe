"""Every query that SQL can express gives the rows of its SQL; the others run and give rows."""

import pytest

from reelframe import catalogue
from tests.support import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(spark, sf, name):
    assert_same(catalogue.QUERIES[name](spark, sf), catalogue.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
