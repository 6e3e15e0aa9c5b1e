"""Every registered query against its SQL."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from checking import compare, connect  # noqa: E402

from linewarden.plans.catalog import CHECKS, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql():
    assert set(CHECKS) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, QUERIES[name], CHECKS[name], sf_dir) is None


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "oee" in df.columns
