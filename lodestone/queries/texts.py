"""Queries by their SQL text."""

from __future__ import annotations

from .base import over

#: Text that the session and DuckDB both run.
SHARED = {
    "scan_parquet": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem",
    "project_expr": "SELECT o_orderkey, o_totalprice * 2 AS twice, o_custkey + 1 AS next_key FROM orders",
    "filter_cmp": "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal >= 5000 AND c_nationkey != 3",
    "filter_and_or": "SELECT p_partkey FROM part WHERE (p_size > 40 AND p_type = 'PROMO') OR (p_size < 5 AND p_brand = 'Brand#3')",
    "filter_is_null": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NULLIF(l_discount, 0) IS NULL AND l_quantity > 40",
    "filter_is_not_null": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NULLIF(l_discount, 0) IS NOT NULL AND l_quantity > 49",
    "filter_not": "SELECT s_suppkey FROM supplier WHERE NOT (s_acctbal > 0 AND s_nationkey < 10)",
    "filter_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring' AND p_type LIKE 'S_A%'",
    "filter_not_like": "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%o%'",
    "filter_between": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000",
    "filter_not_between": "SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 10000 AND 480000",
    "filter_in_list": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "filter_not_in_list": "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3, 5, 8, 13)",
    "select_star": "SELECT * FROM nation",
    "qualified_star": "SELECT n.* FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA'",
    "select_no_from": "SELECT 1 AS one, 'text' AS word, 2 > 1 AS truth",
    "values_rel": "SELECT a, b FROM (SELECT 1 AS a, 'x' AS b UNION ALL SELECT 2, 'y' UNION ALL SELECT NULL, 'z') v",
    "empty_rel": "SELECT r_regionkey, r_name FROM region WHERE 1 = 0",
    "arith_ops": "SELECT l_orderkey, l_linenumber, l_linenumber + 2 * 3 - 1 AS a, -l_linenumber AS b, +l_linenumber AS c, l_quantity * 4 AS d FROM lineitem",
    "mod_op": "SELECT o_orderkey, o_orderkey % 7 AS m FROM orders",
    "neg_op": "SELECT c_custkey, -c_acctbal AS debt, -(-c_custkey) AS same FROM customer",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders",
    "case_searched": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 END AS class FROM part",
    "cast_types": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, l_linenumber::DOUBLE AS d, CAST(l_orderkey AS VARCHAR) AS s, CAST('7' AS INT) AS seven FROM lineitem",
    "date_literal": "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-03-01' AND o_orderdate < DATE '1997-06-01'",
    "date_interval": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL '3' MONTH AS DATE) = DATE '1997-06-01' AS hit FROM orders WHERE o_orderdate < DATE '1997-03-02' AND o_orderdate > DATE '1997-02-01' - INTERVAL 1 YEAR",
    "date_vs_string": "SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) > '2001-06-30'",
    "extract_parts": "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS BIGINT) AS d FROM orders",
    "extract_time": "SELECT event_id, CAST(EXTRACT(HOUR FROM ts) AS BIGINT) AS h, CAST(EXTRACT(MINUTE FROM ts) AS BIGINT) AS mi, CAST(FLOOR(EXTRACT(SECOND FROM ts)) AS BIGINT) AS s FROM events",
    "decimal_arith": "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) AS DOUBLE) AS net FROM lineitem",
    "agg_global": "SELECT COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s, MIN(l_orderkey) AS lo, MAX(l_orderkey) AS hi, ROUND(AVG(l_linenumber), 6) AS av FROM lineitem",
    "agg_global_empty": "SELECT COUNT(*) AS n, COUNT(l_orderkey) AS c, CAST(SUM(l_linenumber) AS BIGINT) AS s, MIN(l_orderkey) AS lo FROM lineitem WHERE l_quantity < 0",
    "group_empty": "SELECT l_returnflag, COUNT(*) AS n FROM lineitem WHERE l_quantity < 0 GROUP BY l_returnflag",
    "group_single": "SELECT c_mktsegment, COUNT(*) AS n, CAST(SUM(CAST(c_acctbal AS DECIMAL(15,2))) AS DOUBLE) AS total FROM customer GROUP BY c_mktsegment",
    "group_multi": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, MAX(l_shipdate) AS latest FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_expr": "SELECT o_custkey % 10 AS bucket, COUNT(*) AS n FROM orders GROUP BY o_custkey % 10",
    "group_alias": "SELECT p_size + 1 AS bigger, COUNT(*) AS n FROM part GROUP BY bigger",
    "group_duplicate_keys": "SELECT COUNT(*) AS n, MIN(s_acctbal) AS lo FROM supplier GROUP BY s_nationkey, s_nationkey",
    "group_no_agg": "SELECT p_brand, p_type FROM part GROUP BY p_brand, p_type",
    "group_null_keys": "SELECT NULLIF(n_regionkey, 2) AS r, NULLIF(n_nationkey % 3, 1) AS m, COUNT(*) AS n FROM nation GROUP BY NULLIF(n_regionkey, 2), NULLIF(n_nationkey % 3, 1)",
    "agg_all_null": "SELECT MIN(NULLIF(n_regionkey, n_regionkey)) AS lo, MAX(NULLIF(n_regionkey, n_regionkey)) AS hi, COUNT(NULLIF(n_regionkey, n_regionkey)) AS n FROM nation",
    "agg_expr_over_agg": "SELECT o_orderstatus, 2 * COUNT(*) AS twice, -COUNT(*) AS minus, MAX(o_custkey) + MIN(o_custkey) + 1 AS ends FROM orders GROUP BY o_orderstatus",
    "agg_min_max_text": "SELECT MIN(p_name) AS first_name, MAX(p_brand) AS last_brand FROM part",
    "count_star": "SELECT COUNT(*) AS n FROM orders",
    "count_column": "SELECT COUNT(NULLIF(l_discount, 0)) AS n FROM lineitem",
    "avg_decimal": "SELECT l_returnflag, CAST(ROUND(AVG(CAST(l_quantity AS DECIMAL(15,2))), 3) AS DOUBLE) AS a FROM lineitem GROUP BY l_returnflag",
    "having_agg": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 400000",
    "having_unselected": "SELECT l_suppkey FROM lineitem GROUP BY l_suppkey HAVING MIN(l_quantity) = 1 AND SUM(l_linenumber) > 100",
    "having_alias": "SELECT c_nationkey AS nation, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING n > 55",
    "having_scalar_subquery": "SELECT c_nationkey, COUNT(*) AS n FROM customer GROUP BY c_nationkey HAVING COUNT(*) > (SELECT COUNT(*) * 0.04 FROM customer)",
    "select_distinct": "SELECT DISTINCT p_type, p_size FROM part",
    "join_comma_where": "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey",
    "join_or_common_key": "SELECT COUNT(*) AS n FROM lineitem, part WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity < 11) OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity > 40)",
    "join_on_one_side": "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey AND n_nationkey = n_regionkey",
    "join_filter_after_outer": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 480000 WHERE o_orderkey IS NULL",
    "sort_multi": "SELECT s_nationkey, s_acctbal, s_suppkey FROM supplier ORDER BY s_nationkey ASC, s_acctbal DESC, s_suppkey",
    "sort_alias": "SELECT o_orderkey AS k, o_totalprice AS price FROM orders ORDER BY price DESC, k",
    "limit_zero": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0",
    "offset_beyond": "SELECT r_regionkey FROM region ORDER BY r_regionkey OFFSET 10",
    "derived_table": "SELECT big.k, big.n FROM (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey) big WHERE big.n > 15",
    "cte_single": "WITH rich AS (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 9000) SELECT c_nationkey, COUNT(*) AS n FROM rich GROUP BY c_nationkey",
    "cte_chain": "WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, COUNT(*) AS customers FROM a GROUP BY n) SELECT n, customers FROM b WHERE n > 3",
    "cte_self_join": "WITH t AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation) SELECT x.k AS k1, y.k AS k2 FROM t AS x, t AS y WHERE x.r = y.r AND x.k < y.k",
    "scalar_uncorrelated": "SELECT s_suppkey FROM supplier WHERE s_acctbal > (SELECT AVG(s_acctbal) FROM supplier)",
    "scalar_correlated": "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity = (SELECT MAX(m.l_quantity) FROM lineitem m WHERE m.l_orderkey = l.l_orderkey)",
    "scalar_correlated_count": "SELECT c_custkey FROM customer WHERE 0 = (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey)",
    "scalar_nested": "SELECT p_partkey FROM part WHERE p_retailprice > (SELECT AVG(p_retailprice) FROM part WHERE p_size > (SELECT AVG(p_size) FROM part))",
    "scalar_in_select": "SELECT r_name, (SELECT COUNT(*) FROM nation WHERE n_regionkey = r_regionkey) AS nations FROM region",
    "exists_corr": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)",
    "exists_under_or": "SELECT c_custkey FROM customer WHERE c_nationkey = 3 OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 490000)",
    "not_exists_corr": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "not_in_subquery": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)",
    "in_binds_below_plus": "SELECT n_nationkey FROM nation WHERE n_nationkey + n_regionkey IN (4, 8, 15)",
}
#: (the session's text, DuckDB's text) where the dialects differ.
OWN = {
    "int_div": (
        "SELECT l_orderkey, l_linenumber, l_orderkey / (l_linenumber + 1) AS q, -l_orderkey / 7 / 2 AS r FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_orderkey // (l_linenumber + 1) AS q, (-l_orderkey // 7) // 2 AS r FROM lineitem",
    ),
    "decimal_div": (
        "SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(15,2)) / CAST(l_quantity AS DECIMAL(15,2)) AS unit FROM lineitem",
        "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS DOUBLE) / CAST(CAST(l_quantity AS DECIMAL(15,2)) AS DOUBLE) AS unit FROM lineitem",
    ),
    "interval_fold": (
        "SELECT CAST(DATE '1993-07-01' + INTERVAL '1' + '2' DAY AS STRING) AS d, CAST(DATE '1993-01-31' + INTERVAL 3 - 2 MONTH AS STRING) AS m",
        "SELECT '1993-07-04' AS d, '1993-02-28' AS m",
    ),
    "timestamp_offset": (
        "SELECT CAST(TIMESTAMP '1991-01-08 04:05:06 +09:00' AS STRING) AS t",
        "SELECT '1991-01-07 19:05:06' AS t",
    ),
    "bare_decimal": ("SELECT CAST(CAST('1.23456789012' AS DECIMAL) AS STRING) AS d", "SELECT '1.2345678901' AS d"),
    "sort_desc_nulls_first": (
        "SELECT NULLIF(n_regionkey, 4) AS r, n_nationkey FROM nation ORDER BY r DESC, n_nationkey LIMIT 8",
        "SELECT NULLIF(n_regionkey, 4) AS r, n_nationkey FROM nation ORDER BY r DESC NULLS FIRST, n_nationkey LIMIT 8",
    ),
    "limit_offset": (
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 7 LIMIT 12",
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 12 OFFSET 7",
    ),
    "distinct_on_text": (
        "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey",
        "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1",
    ),
    "distinct_on_limit": (
        "SELECT DISTINCT ON (o_custkey) o_custkey AS c, o_orderkey FROM orders ORDER BY c DESC, o_totalprice DESC, o_orderkey LIMIT 9",
        "SELECT c, o_orderkey FROM (SELECT o_custkey AS c, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1 ORDER BY c DESC LIMIT 9",
    ),
    "distinct_on_nested": (
        "SELECT d.s, COUNT(*) AS n FROM (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderstatus AS s FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey) d GROUP BY d.s",
        "SELECT s, COUNT(*) AS n FROM (SELECT o_orderstatus AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1 GROUP BY s",
    ),
    "recursive": (
        "WITH RECURSIVE steps(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM steps WHERE n < 12) SELECT CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM steps",
        "WITH RECURSIVE steps(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM steps WHERE n < 12) SELECT CAST(n AS BIGINT) AS n, CAST(total AS BIGINT) AS total FROM steps",
    ),
    "array_struct_literals": (
        "SELECT array(1, 2, 3)[1] AS second, named_struct('a', 1, 'b', 'x').b AS b",
        "SELECT 2 AS second, 'x' AS b",
    ),
}
QUERIES = {k: over(v) for k, v in SHARED.items()} | {k: over(own) for k, (own, _) in OWN.items()}
ORACLES = SHARED | {k: other for k, (_, other) in OWN.items()}
