"""Queries over tables that statements define and change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .base import load
from .files import session_with


def script(tables: tuple[str, ...], *statements: str):
    """Run statements in a new session; the last one's rows are the result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = session_with(spark, sf_dir, *tables)
        for s in statements[:-1]:
            session.sql(s)
        return session.sql(statements[-1])

    return run


def insert_columns_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session_with(spark, sf_dir)
    s.register_table("people", spark.createDataFrame([], "id long, name string, age long"), defaults={"name": "nobody"})
    s.sql("INSERT INTO people (age, id) VALUES (30, 1), (40, 2)")
    s.sql("INSERT INTO people VALUES (3, 'somebody', NULL)")
    return s.sql("SELECT * FROM people")


def catalog_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = session_with(spark, sf_dir, "region")
    s.register_catalog("lake", "raw", "clean")
    for name, table in (("lake.raw.place", "nation"), ("lake.clean.place", "nation"), ("lake.raw.seller", "supplier")):
        s.register_table(name, load(spark, sf_dir, table))
    return s.sql(
        "SELECT place.n_name AS name, lake.raw.seller.s_suppkey AS k, (SELECT COUNT(*) FROM lake.clean.place WHERE place.n_regionkey = r.r_regionkey) AS n"
        " FROM lake.raw.place JOIN lake.raw.seller ON place.n_nationkey = seller.s_nationkey, region r"
        " WHERE lake.raw.place.n_regionkey = r.r_regionkey AND EXISTS (SELECT 1 FROM lake.clean.place p WHERE p.n_nationkey = seller.s_nationkey)"
    )


QUERIES = {
    "catalog_names": catalog_names,
    "insert_conflict": script(
        ("nation",), "CREATE TABLE t (k INT PRIMARY KEY, name VARCHAR, seen INT)", "INSERT INTO t SELECT n_nationkey, n_name, 1 FROM nation WHERE n_regionkey < 3",
        "INSERT INTO t AS x (k, name, seen) SELECT n_nationkey, 'again', 2 FROM nation WHERE n_regionkey > 1 ON CONFLICT (k) DO UPDATE SET name = excluded.name, seen = t.seen + excluded.seen",
        "INSERT INTO t SELECT n_nationkey, 'never', 9 FROM nation ON CONFLICT DO NOTHING", "SELECT * FROM t",
    ),
    "insert_returning": script(("region",), "CREATE TABLE t (k INT, name VARCHAR)", "INSERT INTO t SELECT r_regionkey, r_name FROM region RETURNING k * 10 AS tens, t.name"),
    "create_table": script((), "CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR, c DECIMAL(10,2) NULL)", "SELECT * FROM t"),
    "ctas": script(("orders",), "CREATE TABLE big AS SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000", "SELECT * FROM big"),
    "ctas_from": script(("region",), "CREATE TABLE copy_of AS FROM region", "SELECT * FROM copy_of"),
    "insert_values": script(
        (), "CREATE TABLE t (a INT, b FLOAT, c BOOLEAN)", "INSERT INTO t VALUES (1, 2.5, TRUE), (2, NULL, false)", "INSERT INTO t VALUES (1 + 2, 4, 2 > 1)", "SELECT * FROM t"
    ),
    "insert_columns_default": insert_columns_default,
    "insert_select": script(
        ("nation",), "CREATE TABLE t (k INT, half DOUBLE, name VARCHAR)", "INSERT INTO t (name, k) SELECT n_name, n_nationkey FROM nation WHERE n_regionkey = 1", "INSERT INTO t (half) SELECT 1", "SELECT * FROM t"
    ),
    "insert_from": script(("region",), "CREATE TABLE t (k BIGINT, name VARCHAR)", "INSERT INTO t FROM region", "SELECT * FROM t"),
    "delete_where": script(("customer",), "CREATE TABLE t AS SELECT c_custkey, NULLIF(c_nationkey, 4) AS n FROM customer", "DELETE FROM t WHERE n > 6", "SELECT * FROM t"),
    "delete_all": script(("region",), "CREATE TABLE t AS FROM region", "DELETE FROM t", "SELECT COUNT(*) AS n FROM t"),
    "delete_count": script(("nation",), "CREATE TABLE t AS FROM nation", "DELETE FROM t WHERE n_regionkey = 2"),
    "update_where": script(("supplier",), "CREATE TABLE t AS SELECT s_suppkey, s_nationkey AS n FROM supplier", "UPDATE t SET n = n + 100 WHERE s_suppkey > 50", "SELECT * FROM t"),
    "drop_recreate": script((), "CREATE TABLE t (a INT)", "DROP TABLE t", "DROP TABLE IF EXISTS t", "CREATE TABLE t (b VARCHAR)", "INSERT INTO t VALUES ('x')", "SELECT * FROM t"),
    "schema_names": script((), "CREATE SCHEMA lake", "CREATE TABLE lake.t (a INT)", "INSERT INTO lodestone.lake.t VALUES (5)", "SELECT lake.t.a FROM lake.t"),
    "show_tables": script(("region", "nation"), "SHOW TABLES"),
    "information_schema": script(("region",), "CREATE TABLE t (a INT)", "SELECT table_name, table_type FROM information_schema.tables"),
}
ORACLES = {
    "catalog_names": "SELECT n_name AS name, s_suppkey AS k, (SELECT COUNT(*) FROM nation x WHERE x.n_regionkey = n.n_regionkey) AS n FROM nation n JOIN supplier ON n_nationkey = s_nationkey",
    "insert_conflict": "SELECT CAST(n_nationkey AS BIGINT) AS k, CASE WHEN n_regionkey > 1 THEN 'again' ELSE n_name END AS name, CAST(CASE WHEN n_regionkey = 2 THEN 3 WHEN n_regionkey > 1 THEN 2 ELSE 1 END AS BIGINT) AS seen FROM nation",
    "insert_returning": "SELECT CAST(r_regionkey * 10 AS BIGINT) AS tens, r_name AS name FROM region",
    "show_tables": "SELECT 'lodestone' AS catalog_name, 'public' AS schema_name, t AS table_name, 'LOCAL TEMPORARY' AS table_type FROM (VALUES ('region'), ('nation')) v(t)",
    "create_table": "SELECT CAST(1 AS BIGINT) AS a, 'x' AS b, CAST(1 AS DECIMAL(10,2)) AS c WHERE 1 = 0",
    "ctas": "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000",
    "ctas_from": "SELECT * FROM region",
    "insert_values": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), CAST(2.5 AS DOUBLE), true), (2, NULL, false), (3, 4, true)) v(a, b, c)",
    "insert_columns_default": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'nobody', CAST(30 AS BIGINT)), (2, 'nobody', 40), (3, 'somebody', NULL)) v(id, name, age)",
    "insert_select": "SELECT CAST(n_nationkey AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS half, n_name AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT NULL, 1, NULL",
    "insert_from": "SELECT CAST(r_regionkey AS BIGINT) AS k, r_name AS name FROM region",
    "delete_where": "SELECT c_custkey, NULLIF(c_nationkey, 4) AS n FROM customer WHERE coalesce(NULLIF(c_nationkey, 4) <= 6, true)",
    "delete_all": "SELECT CAST(0 AS BIGINT) AS n",
    "delete_count": "SELECT CAST(COUNT(*) AS BIGINT) AS row FROM nation WHERE n_regionkey = 2",
    "update_where": "SELECT s_suppkey, CASE WHEN s_suppkey > 50 THEN s_nationkey + 100 ELSE s_nationkey END AS n FROM supplier",
    "drop_recreate": "SELECT 'x' AS b",
    "schema_names": "SELECT CAST(5 AS BIGINT) AS a",
    "information_schema": "SELECT * FROM (VALUES ('region', 'LOCAL TEMPORARY'), ('t', 'BASE TABLE')) v(table_name, table_type)",
}
