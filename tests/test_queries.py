import importlib

import pytest
from compare import SF, connection, same

import __spark_entry__ as entry

MODULES = [importlib.import_module(f"siltworks.queries.{m}") for m in entry._CORE]
QUERIES = {k: q for m in MODULES for k, q in m.queries().items()}
SQL = {k: q for m in MODULES for k, q in m.oracle_sql().items()}


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    same(spark, con, QUERIES[name], SQL[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_name_is_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert SF.endswith("0.001")
