"""The registered queries against their SQL, on the smallest tables."""

import pytest

import check_oracles
from conftest import SMALL
from __spark_entry__ import entry
from oracle_queries import ORACLES
from textgrove.queries import QUERIES

# Runs of many rounds are covered by the numpy restatement; check_oracles.py runs them as well.
SLOW = ("tree_", "bisect_", "word_clusters", "kmeans_kway", "split_")
NAMES = [name for name in QUERIES if not name.startswith(SLOW)]


@pytest.fixture(scope="module")
def con():
    return check_oracles.connect(SMALL)


@pytest.mark.parametrize("name", [*NAMES, "bisect_i1", "bisect_exhausted", "split_h2"])
def test_matches_sql(spark, con, name):
    outcome = check_oracles.compare(spark, con, SMALL, name, ORACLES[name])
    assert outcome.startswith("ok"), outcome


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).count() == 400
