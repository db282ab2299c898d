"""Each query of the order engine against its SQL; of those that classify all dirty orders, a few stand for all."""

import pytest

import oracle
from ledgerloom.plans import registry

SF = "/root/testdata/sf0.001"
SLOW = {"quality_error_counts", "quality_status_counts", "run_metrics", "run_summary", "split_by_status", "rule_totals"}
NAMES = [n for n in registry.oracle_sql() if n not in SLOW]


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    oracle.compare(spark, con, registry.queries()[name], registry.oracle_sql()[name], SF)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
