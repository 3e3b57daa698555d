"""User-defined functions: scalars and aggregates over Arrow arrays, and table functions."""

from __future__ import annotations

import inspect
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_scalar(spark: SparkSession, name: str, function: Callable, returns: str) -> Callable:
    """Register a vectorized function (Arrow arrays in, one out) for SQL and DataFrames.

    Names resolve whatever their case. Batches travel as Arrow, never row by row.
    """
    vectorized = F.arrow_udf(function, returns)
    spark.udf.register(name, vectorized)
    return vectorized


def register_aggregate(spark: SparkSession, name: str, function: Callable, returns: str) -> Callable:
    """Register an aggregate: the Arrow arrays of one group in, one value out.

    A group's rows meet in one task; use built-in aggregates for groups without bound.
    """

    def aggregate(*columns: pa.Array):
        return function(*columns)

    # The arguments' number is the function's own, and the hints say that a group gives one value.
    aggregate.__signature__ = inspect.Signature([p.replace(annotation=pa.Array) for p in inspect.signature(function).parameters.values()], return_annotation=float)
    aggregate.__annotations__ = {p: pa.Array for p in inspect.signature(function).parameters} | {"return": float}
    vectorized = F.arrow_udf(aggregate, returns)
    spark.udf.register(name, vectorized)
    return vectorized


def register_table_function(spark: SparkSession, name: str, handler: type, returns: str) -> None:
    """Register a class whose ``eval`` yields rows as a function that stands in FROM."""
    spark.udtf.register(name, F.udtf(handler, returnType=returns))
