"""Queries of this subpackage against DuckDB, where SQL can express them."""

import pytest

from lodestone.llm.queries import ORACLES, QUERIES
from tests.conftest import SMALL
from tests.oracle import differences


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, name):
    assert differences(QUERIES[name](spark, SMALL), ORACLES[name], SMALL) == []


def test_one_query_for_each_operator():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(ORACLES) <= set(QUERIES)
