"""Every registered query with SQL, against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from macrospark.plans.registry import CATALOGUE
from tests.compare import compare, connect
from tests.conftest import SF

CHECKED = [n for n, q in CATALOGUE.items() if q.sql is not None]
UNCHECKED = [n for n, q in CATALOGUE.items() if q.sql is None and not n.startswith("mlo")]


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_sql(spark, duck, name):
    query = CATALOGUE[name]
    assert compare(query.run(spark, SF), duck, query.sql) == "ok"


@pytest.mark.parametrize("name", UNCHECKED)
def test_gives_rows(spark, name):
    assert CATALOGUE[name].run(spark, SF).count() > 0


def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "value_rollmean3" in df.columns


def test_contract():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
