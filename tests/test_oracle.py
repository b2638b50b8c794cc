"""Every registered query against its SQL check."""

import os

import pytest

import __spark_entry__ as entry_module
import oracle

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, CHECKS = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", list(CHECKS))
def test_query_agrees_with_sql(spark, connection, name):
    rows, problems = oracle.compare(spark, connection, FOLDER, QUERIES[name], CHECKS[name])
    assert problems == []
    assert rows > 0


def test_entry_gives_rows(spark):
    assert entry_module.entry(spark).columns == ["user_id", "job_id", "score"]


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)
