"""Queries over files that the session itself writes and reads."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import shared_root
from ..session import Session
from .base import load


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    return f"{shared_root(spark)}/files-{uuid.uuid4().hex}"


def session_with(spark: SparkSession, sf_dir: str, *names: str) -> Session:
    session = Session(spark)
    for n in names:
        session.register_table(n, load(spark, sf_dir, n))
    return session


def read_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, path = session_with(spark, sf_dir, "customer"), f"{shared_folder(spark)}/customer"
    s.sql(f"COPY customer TO '{path}' (FORMAT csv, HEADER, DELIMITER ';')")
    return s.sql(f"SELECT c_custkey, c_name, c_acctbal FROM read_csv('{path}', delim = ';') WHERE c_nationkey < 5")


def read_csv_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, path = session_with(spark, sf_dir, "supplier"), f"{shared_folder(spark)}/supplier"
    s.sql(f"COPY (SELECT s_suppkey, s_name, s_acctbal FROM supplier) TO '{path}' (FORMAT csv)")
    return s.sql(f"SELECT k, name, balance FROM read_csv('{path}', header = false, columns = {{'k': 'INT', 'name': 'VARCHAR', 'balance': 'DOUBLE'}})")


def read_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, path = session_with(spark, sf_dir, "nation"), f"{shared_folder(spark)}/nation"
    s.sql(f"COPY (SELECT n_nationkey, n_name FROM nation) TO '{path}' (FORMAT json)")
    return s.sql(f"SELECT n_nationkey, n_name FROM read_json('{path}')")


def read_parquet_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Session(spark).sql(f"SELECT r_regionkey, r_name FROM read_parquet('{sf_dir}/region.parquet') r WHERE r_regionkey > 0")


def copy_from_tbl(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, path = session_with(spark, sf_dir, "supplier"), f"{shared_folder(spark)}/supplier"
    s.sql(f"COPY (SELECT s_suppkey, s_name, s_acctbal FROM supplier) TO '{path}' (DELIMITER '|')")
    s.sql("CREATE TABLE loaded (k BIGINT NOT NULL, name VARCHAR, balance DECIMAL(15,2),)")
    s.sql(f"COPY loaded FROM '{path}' (DELIMITER '|')")
    return s.sql("SELECT k, name, CAST(balance AS DOUBLE) AS balance FROM loaded")


QUERIES = {f.__name__: f for f in (read_csv_roundtrip, read_csv_columns, read_json_roundtrip, read_parquet_function, copy_from_tbl)}
ORACLES = {
    "read_csv_roundtrip": "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey < 5",
    "read_csv_columns": "SELECT CAST(s_suppkey AS BIGINT) AS k, s_name AS name, s_acctbal AS balance FROM supplier",
    "read_json_roundtrip": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation",
    "read_parquet_function": "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 0",
    "copy_from_tbl": "SELECT s_suppkey AS k, s_name AS name, s_acctbal AS balance FROM supplier",
}
