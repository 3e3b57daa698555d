"""Plans are the ones to be wanted: pruned scans, equi-joins, semi joins, top-n."""

import pytest
from tests.conftest import TINY

from lodestone.queries import QUERIES


def plan(spark, name):
    return QUERIES[name](spark, TINY)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "filter_cmp")
    assert "PushedFilters: [IsNotNull(c_acctbal), IsNotNull(c_nationkey), GreaterThanOrEqual(c_acctbal" in text
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_acctbal:double>" in text


def test_two_columns_of_a_wide_table(spark):
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double>" in plan(spark, "scan_parquet")


@pytest.mark.parametrize("name", ["join_comma_where", "join_or_common_key", "join_inner", "join_equi_theta", "tpch_q5", "tpch_q9"])
def test_equality_joins(spark, name):
    text = plan(spark, name)
    assert "HashJoin" in text or "SortMergeJoin" in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


@pytest.mark.parametrize(("name", "kind"), [("exists_corr", "LeftSemi"), ("not_exists_corr", "LeftAnti"), ("in_subquery", "LeftSemi"), ("not_in_subquery", "LeftAnti"), ("join_semi", "LeftSemi"), ("join_anti", "LeftAnti"), ("exists_under_or", "ExistenceJoin")])
def test_subqueries_are_joins(spark, name, kind):
    assert kind in plan(spark, name)


@pytest.mark.parametrize("name", ["top_n", "sort_desc_nulls_first", "limit_offset", "tpch_q3", "tpch_q10"])
def test_top_n(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


def test_theta_join_needs_no_product(spark):
    assert "BroadcastNestedLoopJoin" in plan(spark, "join_theta")


def test_partial_aggregation(spark):
    text = plan(spark, "group_multi")
    assert text.count("HashAggregate") == 2 and "partial_count" in text


def test_transitive_filter(spark):
    left, right = (spark.read.parquet(f"{TINY}/{t}.parquet") for t in ("orders", "customer"))
    text = left.join(right, left.o_custkey == right.c_custkey).where("c_custkey > 10")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_custkey,10)" in text and "GreaterThan(c_custkey,10)" in text
