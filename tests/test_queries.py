"""Every query against its SQL; those without SQL give rows of a stable schema."""

import pytest
from helpers import SF, same_as_sql

from lodestar.plans import oracle
from lodestar.plans.queries import QUERIES

SQL = oracle.build()


def test_names():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    same_as_sql(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and len(df.columns) == len(set(df.columns))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
