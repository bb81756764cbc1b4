"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as entry
import bindings
from tests import harness

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = bindings.QUERIES, bindings.ORACLES


@pytest.fixture(scope="module")
def con():
    return harness.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert harness.difference(QUERIES[name](spark, FOLDER), con, ORACLES[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_them_all():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_replay_and_families_read_all(spark, con):
    days = con.sql("SELECT count(DISTINCT (user_id, ts::DATE)) FROM events").fetchall()[0][0]
    replay = QUERIES["entity_replay"](spark, FOLDER)
    assert replay.filter("action IN ('created', 'carried', 'returned')").count() == days
    assert any("|" in r.families for r in QUERIES["display_families"](spark, FOLDER).collect() if r.families)
