"""How queries get their tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import Session

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
Query = Callable[[SparkSession, str], DataFrame]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(sql: str) -> Query:
    """A query by its text, run by a session in which the tables it names are registered."""
    named = [t for t in TABLES if re.search(rf"\b{t}\b", sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = Session(spark)
        for t in named:
            session.register_table(t, load(spark, sf_dir, t))
        return session.sql(sql)

    return run
