"""Every registered query of the engine against DuckDB."""

import pytest
from tests.conftest import SMALL
from tests.oracle import differences

from lodestone.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    assert differences(QUERIES[name](spark, SMALL), ORACLES[name], SMALL) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize(
    ("name", "key", "whole"),
    [
        ("arith_ops", "l_orderkey", "SELECT max(l_orderkey) AS last FROM lineitem"),
        ("cast_types", "l_orderkey", "SELECT max(l_orderkey) AS last FROM lineitem"),
        ("scalar_correlated", "l_orderkey", "SELECT max(l_orderkey) AS last FROM lineitem"),
        ("join_filter_after_outer", "c_custkey", "SELECT max(c_custkey) AS last FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 480000)"),
    ],
)
def test_reaches_the_last_key(spark, name, key, whole):
    assert differences(QUERIES[name](spark, SMALL).selectExpr(f"max({key}) AS last"), whole, SMALL) == []
