"""The operators that SQL can express, against their SQL at the smallest scale."""

import pytest

from edgeloom.llm.workload import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(SQL))
def test_same_rows(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]) == ""
