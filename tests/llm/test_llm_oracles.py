"""Every query of the subpackage that has SQL gives the rows that DuckDB gives."""

import pytest
from comparing import SF, connect, difference

from suitelens.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), SQL[name]) == ""
