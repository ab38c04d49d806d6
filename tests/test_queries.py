"""Every query of the core against its SQL, or at least run, on the smallest tables."""

import importlib
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import __spark_entry__ as entry
from oracle import DATA, connection, differs

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
MODULES = [importlib.import_module(f"sievelight.plans.{n}") for n in entry.PLANS]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}


@pytest.fixture(scope="module")
def db():
    return connection()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, db, name):
    assert differs(spark, db, QUERIES[name], ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
