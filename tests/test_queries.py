"""Every query of the library outside ``llm`` against its SQL on the smallest tables."""

import importlib
import os

import pytest

import __spark_entry__ as entry
from tests.oracle import differences

SMALLEST = "/root/testdata/sf0.001"
FOUND = [(name, module) for module in map(importlib.import_module, entry.MODULES) for name in module.QUERIES]


@pytest.mark.skipif(not os.path.isdir(SMALLEST), reason="no test tables")
@pytest.mark.parametrize("name, module", FOUND, ids=[name for name, _ in FOUND])
def test_query(spark, name, module):
    query = module.QUERIES[name]
    if name in module.SQL:
        assert differences(spark, SMALLEST, name, query, module.SQL[name]) == ""
    else:
        assert query(spark, SMALLEST).count() > 0


def test_entry_lists_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p4_found", "p5_found"} <= set(entry.queries())
