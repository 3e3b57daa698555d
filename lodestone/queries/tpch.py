"""The twelve decision-support queries, adapted to the tables at hand."""

from __future__ import annotations

from .base import over

NET = "CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2)))"
COST = "SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, MIN(l_extendedprice / l_quantity) AS ps_supplycost, CAST(SUM(l_quantity) AS BIGINT) AS ps_availqty FROM lineitem GROUP BY l_partkey, l_suppkey"


def total(x: str, name: str) -> str:
    """An exact decimal sum, shown as a double."""
    return f"CAST(SUM({x}) AS DOUBLE) AS {name}"


ORACLES = {
    "tpch_q1": f"""
SELECT l_returnflag, l_linestatus, {total('CAST(l_quantity AS DECIMAL(15,2))', 'sum_qty')},
  {total('CAST(l_extendedprice AS DECIMAL(15,2))', 'sum_base_price')}, {total(NET, 'sum_disc_price')},
  {total(f'{NET} * (1 + CAST(l_tax AS DECIMAL(15,2)))', 'sum_charge')}, ROUND(AVG(l_quantity), 4) AS avg_qty,
  ROUND(AVG(l_extendedprice), 4) AS avg_price, ROUND(AVG(l_discount), 4) AS avg_disc, COUNT(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tpch_q2": f"""
WITH ps AS ({COST})
SELECT s_acctbal, s_name, n_name, p_partkey, p_brand
FROM part, supplier, ps, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size = 15 AND p_type LIKE '%PROMO'
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  AND ps_supplycost = (SELECT MIN(p2.ps_supplycost) FROM ps p2, supplier s2, nation n2, region r2
    WHERE p_partkey = p2.ps_partkey AND s2.s_suppkey = p2.ps_suppkey AND s2.s_nationkey = n2.n_nationkey
      AND n2.n_regionkey = r2.r_regionkey AND r2.r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""",
    "tpch_q3": f"""
SELECT l_orderkey, {total(NET, 'revenue')}, CAST(o_orderdate AS DATE) AS o_orderdate
FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
  AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "tpch_q4": """
SELECT o_orderpriority, COUNT(*) AS order_count FROM orders
WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-07-01' + INTERVAL '3' MONTH
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY)
GROUP BY o_orderpriority ORDER BY o_orderpriority""",
    "tpch_q5": f"""
SELECT n_name, {total(NET, 'revenue')}
FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
  AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA'
  AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-01-01' + INTERVAL '1' YEAR
GROUP BY n_name ORDER BY revenue DESC""",
    "tpch_q6": f"""
SELECT {total('CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(15,2))', 'revenue')} FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '1' YEAR
  AND CAST(l_discount AS DECIMAL(15,2)) BETWEEN 0.06 - 0.01 AND 0.06 + 0.01 AND l_quantity < 24""",
    "tpch_q7": f"""
SELECT supp_nation, cust_nation, l_year, {total('volume', 'revenue')} FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(EXTRACT(YEAR FROM l_shipdate) AS BIGINT) AS l_year, {NET} AS volume
  FROM supplier, lineitem, orders, customer, nation n1, nation n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey
    AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
    AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') AS shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""",
    "tpch_q8": f"""
SELECT o_year, ROUND(CAST(SUM(CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END) AS DOUBLE) / CAST(SUM(volume) AS DOUBLE), 8) AS mkt_share FROM (
  SELECT CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {NET} AS volume, n2.n_name AS nation
  FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey
    AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA'
    AND s_nationkey = n2.n_nationkey AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'
    AND p_type = 'ECONOMY') AS all_nations
GROUP BY o_year ORDER BY o_year""",
    "tpch_q9": f"""
SELECT nation, o_year, {total('amount', 'sum_profit')} FROM (
  SELECT n_name AS nation, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS o_year,
    {NET} - CAST(p_retailprice AS DECIMAL(15,2)) * CAST(l_quantity AS DECIMAL(15,2)) AS amount
  FROM part, supplier, lineitem, orders, nation
  WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey
    AND s_nationkey = n_nationkey AND p_name LIKE '%bolt%') AS profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""",
    "tpch_q10": f"""
SELECT c_custkey, c_name, {total(NET, 'revenue')}, c_acctbal, n_name
FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01'
  AND o_orderdate < DATE '1996-10-01' + INTERVAL '3' MONTH AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    "tpch_q11": f"""
WITH ps AS ({COST})
SELECT ps_partkey, ROUND(SUM(ps_supplycost * ps_availqty), 2) AS value FROM ps, supplier, nation
WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7'
GROUP BY ps_partkey HAVING SUM(ps_supplycost * ps_availqty) > (
  SELECT SUM(ps_supplycost * ps_availqty) * 0.001 FROM ps, supplier, nation
  WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7')
ORDER BY value DESC""",
    "tpch_q12": """
SELECT l_returnflag, CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
  CAST(SUM(CASE WHEN o_orderpriority != '1-URGENT' AND o_orderpriority != '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '1' YEAR
GROUP BY l_returnflag ORDER BY l_returnflag""",
}
QUERIES = {k: over(v) for k, v in ORACLES.items()}
