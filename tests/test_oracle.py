"""Every registered query with SQL, run beside DuckDB on the smallest folder."""

import re

import pytest
from check_oracle import compare, connect
from conftest import SMALL

from __spark_entry__ import entry, oracle_sql, queries

TEXTS = oracle_sql()
# Operations on texts and vectors have tests of their own.
OF_TEXTS = re.compile(r"op\d+_|pipeline")


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(TEXTS))
def test_same_rows(spark, duck, name):
    _, problems = compare(spark, duck, SMALL, queries()[name], TEXTS[name])
    assert problems == []


def test_every_query_has_sql():
    assert all(OF_TEXTS.match(name) for name in set(queries()) - set(TEXTS))


def test_entry(spark):
    assert entry(spark).count() == 80
