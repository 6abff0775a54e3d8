"""Every core query that has SQL gives the rows that DuckDB gives."""

import importlib

import pytest
from comparing import SF, connect, difference

import __spark_entry__ as entry

MODULES = [importlib.import_module(m) for m in entry._MODULES]
NAMES = [(m, name) for m in MODULES for name in m.SQL]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("module,name", NAMES, ids=[n for _, n in NAMES])
def test_query(spark, con, module, name):
    assert difference(module.QUERIES[name](spark, SF), con, module.SQL[name]) == ""
