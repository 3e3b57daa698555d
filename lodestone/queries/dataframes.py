"""Queries by DataFrame operators."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import relational as rel
from ..session import Session
from .base import load

QUERIES, ORACLES = {}, {}


def query(oracle: str):
    """Register a function of loaded tables under its name, with DuckDB's SQL for its rows."""

    def add(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*(spark if n == "spark" else load(spark, sf_dir, n) for n in names))
        ORACLES[f.__name__] = oracle
        return f

    return add


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def join_inner(nation: DataFrame, region: DataFrame) -> DataFrame:
    return rel.join(nation, region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def join_left(customer: DataFrame, orders: DataFrame) -> DataFrame:
    on = (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_totalprice") > 300000)
    return rel.join(customer, orders, on, "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) s RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    rich = rel.keep(supplier, F.col("s_acctbal") > 5000)
    return rel.join(rich, nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT a.n_nationkey AS l, b.r_regionkey AS r FROM nation a FULL JOIN region b ON a.n_nationkey = b.r_regionkey + 22")
def join_full(nation: DataFrame, region: DataFrame) -> DataFrame:
    on = F.col("n_nationkey") == F.col("r_regionkey") + 22
    return rel.join(nation, region, on, "full").select(F.col("n_nationkey").alias("l"), F.col("r_regionkey").alias("r"))


@query("SELECT a.r_name AS x, n_name AS y FROM region a CROSS JOIN nation")
def join_cross(region: DataFrame, nation: DataFrame) -> DataFrame:
    return rel.join(region, nation, None).select(F.col("r_name").alias("x"), F.col("n_name").alias("y"))


@query("SELECT a.s_suppkey AS x, b.n_nationkey AS y FROM supplier a JOIN nation b ON a.s_nationkey < b.n_nationkey AND a.s_acctbal > 8000")
def join_theta(supplier: DataFrame, nation: DataFrame) -> DataFrame:
    on = (F.col("s_nationkey") < F.col("n_nationkey")) & (F.col("s_acctbal") > 8000)
    return rel.join(supplier, nation, on).select(F.col("s_suppkey").alias("x"), F.col("n_nationkey").alias("y"))


@query("SELECT o_orderkey, l_linenumber FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate < o_orderdate")
def join_equi_theta(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    on = (F.col("o_orderkey") == F.col("l_orderkey")) & (F.col("l_shipdate") < F.col("o_orderdate"))
    return rel.join(orders, lineitem, on).select("o_orderkey", "l_linenumber")


@query("SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self_alias(nation: DataFrame) -> DataFrame:
    on = (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))
    return rel.join(nation.alias("a"), nation.alias("b"), on).select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y"))


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE b.l_quantity > 45")
def join_multi_key(lineitem: DataFrame) -> DataFrame:
    right = rel.keep(lineitem, F.col("l_quantity") > 45).select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"))
    return rel.join(lineitem.select("l_orderkey", "l_linenumber"), right, ["l_orderkey", "l_linenumber"])


@query("SELECT x.k, y.v FROM (SELECT n_nationkey AS n, NULLIF(n_regionkey, 1) AS k FROM nation) x LEFT JOIN (SELECT NULLIF(r_regionkey, 1) AS k, r_name AS v FROM region) y ON x.k = y.k")
def join_null_keys(nation: DataFrame, region: DataFrame) -> DataFrame:
    x = nation.select(F.nullif(F.col("n_regionkey"), F.lit(1)).alias("k"))
    return rel.join(x, region.select(F.nullif(F.col("r_regionkey"), F.lit(1)).alias("k"), F.col("r_name").alias("v")), ["k"], "left")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def join_semi(customer: DataFrame, orders: DataFrame) -> DataFrame:
    on = (F.col("o_custkey") == F.col("c_custkey")) & (F.col("o_orderstatus") == "P")
    return rel.semi(customer, orders, on).select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 30)")
def join_anti(part: DataFrame, lineitem: DataFrame) -> DataFrame:
    on = (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_quantity") > 30)
    return rel.anti(part, lineitem, on).select("p_partkey")


@query("SELECT l_suppkey, COUNT(*) AS n, MAX(l_quantity) AS most FROM lineitem GROUP BY l_suppkey HAVING COUNT(*) > 600")
def group_having(lineitem: DataFrame) -> DataFrame:
    return rel.aggregate(lineitem, ["l_suppkey"], F.count("*").alias("n"), F.max("l_quantity").alias("most"), having=F.col("n") > 600)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n(orders: DataFrame) -> DataFrame:
    return rel.top_n(orders.select("o_orderkey", "o_totalprice"), 10, ("o_totalprice", "desc"), "o_orderkey")


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5 OFFSET 20")
def top_n_offset(customer: DataFrame) -> DataFrame:
    return rel.limit(rel.sort(customer.select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey"), 5, 20).select("c_custkey")


@query("SELECT s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS n FROM supplier) WHERE n = 1")
def distinct_on(supplier: DataFrame) -> DataFrame:
    return rel.distinct_on(supplier, ["s_nationkey"], ("s_acctbal", "desc"), "s_suppkey").select("s_nationkey", "s_suppkey")


@query("SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS BIGINT) AS y, o_orderkey // 3 AS third, CAST(CAST(o_orderdate + INTERVAL 40 DAY AS DATE) AS VARCHAR) AS later FROM orders")
def scalar_functions(orders: DataFrame) -> DataFrame:
    later = scalars.plus_interval(F.col("o_orderdate"), 40, "days").cast("date").cast("string")
    third = scalars.int_div(F.col("o_orderkey"), F.lit(3))
    return rel.project(orders, "o_orderkey", scalars.extract("year", F.col("o_orderdate")).alias("y"), third.alias("third"), later.alias("later"))


@query("SELECT c_custkey, upper(c_mktsegment) || '!' AS loud FROM customer")
def udf_scalar(spark: SparkSession, customer: DataFrame) -> DataFrame:
    session = Session(spark)
    session.register_table("customer", customer)
    session.register_udf("Louder", lambda x: pc.binary_join_element_wise(pc.utf8_upper(x), "!", ""), "string")
    return session.sql("SELECT c_custkey, LOUDER(c_mktsegment) AS loud FROM customer")
