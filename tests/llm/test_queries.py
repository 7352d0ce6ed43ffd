"""The queries over the operators for training data on the smallest tables, against their SQL where there is some."""

import os

import pytest

from spanloom.llm.queries import QUERIES, SQL
from tests.oracle import differences

SMALLEST = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    if name in SQL:
        assert differences(spark, SMALLEST, name, QUERIES[name], SQL[name]) == ""
    else:
        assert QUERIES[name](spark, SMALLEST).count() > 0
