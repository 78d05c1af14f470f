"""Every registered query against its SQL, on whole tables."""

import re

import pytest

import __spark_entry__ as entry
from check import compare, connect

# The numbered operators and the pipeline have tests of their own.
NAMES = [n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)]


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry.oracle_sql()])
def test_matches_sql(spark, con, sf, name):
    ok, note = compare(spark, con, sf, name)
    assert ok, note


@pytest.mark.parametrize("name", [n for n in NAMES if n not in entry.oracle_sql()])
def test_runs(spark, sf, name):
    df = entry.queries()[name](spark, sf)
    assert df.count() > 0


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["query_id", "doc_id", "source", "chunk_no", "rank", "score"]
    assert df.count() > 0
