"""Every query of the conflict engine beside its SQL twin."""

import pytest
from compare import same

from mergelake import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    same(catalogue.QUERIES[name](spark, sf_dir), duck.sql(catalogue.ORACLES[name]))


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_rows_only(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
