"""Every registered query against its SQL twin; those without one must give rows of a stable schema."""

import pytest

from sentimill import plans
from tests.duck import SF_DIR, connect, duck_rows, spark_rows


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_matches_sql(spark, duck, name):
    assert spark_rows(plans.QUERIES[name](spark, SF_DIR)) == duck_rows(duck, plans.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_gives_rows(spark, name):
    df = plans.QUERIES[name](spark, SF_DIR)
    assert df.columns and df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
