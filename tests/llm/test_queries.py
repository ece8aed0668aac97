"""What the registered queries have in common."""

import pytest
from check_oracle import compare, connect
from conftest import SMALL

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from salesengine.llm import queries as own


def test_registered():
    names = set(own.QUERIES) | {"pipeline"}
    assert names <= set(queries())
    assert {int(n[2:].split("_")[0]) for n in own.QUERIES} == set(range(1, 14))
    assert set(own.ORACLES) <= set(oracle_sql()) and corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(own.ORACLES))
def test_same_rows_as_sql(spark, name):
    _, problems = compare(spark, connect(SMALL), SMALL, own.QUERIES[name], own.ORACLES[name])
    assert problems == []


@pytest.mark.parametrize("name", ["op1_url_filter", "op6_tool_calls", "op9_mixing"])
def test_native_plans(spark, name):
    plan = own.QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))
