"""Queries whose rows SQL can express, over the smallest tables, awkward tables and empty ones."""

import pytest
from brute import SF, awkward_dir, duck_rows, spark_rows

from sparkarray.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", SQL)
def test_small(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == duck_rows(SF, SQL[name])


@pytest.mark.parametrize("name", SQL)
def test_awkward(spark, name, tmp_path):
    d = awkward_dir(tmp_path)
    assert spark_rows(queries.queries()[name](spark, d)) == duck_rows(d, SQL[name])


@pytest.mark.parametrize("name", queries.queries())
def test_empty(spark, name, tmp_path):
    d = awkward_dir(tmp_path, empty=True)
    got = queries.queries()[name](spark, d).collect()
    assert len(got) == (name == "op6_chat")  # the conversation that the contract adds
