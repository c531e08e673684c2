"""Every query with an SQL twin gives the twin's rows; the others run and give rows."""

import pytest

import sylva.queries  # noqa: F401
from sylva.catalog import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(name, spark, duck, sf_dir, same_rows):
    same_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
