"""Every registered query against its SQL at the smallest scale."""

import pytest

from __spark_entry__ import entry
from edgeloom.workload import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, SQL[name]) == ""


def test_entry(spark):
    assert entry(spark).columns == ["direction", "entity_id", "entity_name", "neighbor", "neighbor_full", "n_edges"]
