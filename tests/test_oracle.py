"""Every core query with SQL against it, on the smallest tables."""

import importlib

import pytest
from oracle import check, rows

MODULES = ("data_problems", "text", "clock", "aggregates", "relational", "graphs", "numeric", "storage", "planning", "roundtrips", "questions")
CASES = [(m, name) for m in MODULES for name in importlib.import_module(f"loomspan.plans.{m}").QUERIES]


@pytest.mark.parametrize(("module", "name"), CASES)
def test_query(spark, data, module, name):
    plans = importlib.import_module(f"loomspan.plans.{module}")
    if name in plans.ORACLE:
        check(spark, data, plans.QUERIES[name], plans.ORACLE[name])
    else:
        assert rows(plans.QUERIES[name](spark, data))[0]
