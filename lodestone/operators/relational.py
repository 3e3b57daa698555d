"""Operators as functions of DataFrames.

Each builds a declarative plan and leaves the physical choice to Catalyst: joins are
equi-joins wherever the condition has an equality, nothing is hinted, and no operator
looks at rows on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Name = str | Column


def column(x: Name) -> Column:
    return F.col(x) if isinstance(x, str) else x


def project(df: DataFrame, *columns: Name) -> DataFrame:
    return df.select(*columns)


def keep(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is true; false and null rows go."""
    return df.where(condition)


def join(left: DataFrame, right: DataFrame, on: Column | Sequence[str] | None, how: str = "inner") -> DataFrame:
    """Inner, left, right, full, semi, anti and cross joins; null keys never match."""
    kinds = {"semi": "left_semi", "anti": "left_anti"}
    return left.crossJoin(right) if on is None else left.join(right, on, kinds.get(how, how))


def semi(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """Rows of ``left`` with a match, once each (EXISTS)."""
    return join(left, right, on, "semi")


def anti(left: DataFrame, right: DataFrame, on: Column | Sequence[str]) -> DataFrame:
    """Rows of ``left`` without a match (NOT EXISTS)."""
    return join(left, right, on, "anti")


def aggregate(df: DataFrame, by: Sequence[Name], *aggregates: Column, having: Column | None = None) -> DataFrame:
    """Grouped (or, without keys, global) aggregation, filtered after it."""
    out = df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)
    return out if having is None else out.where(having)


def sort(df: DataFrame, *keys: tuple[Name, str] | Name) -> DataFrame:
    """Sort by keys or ``(key, "desc")``; nulls come first either way."""
    order = []
    for key in keys:
        name, way = key if isinstance(key, tuple) else (key, "asc")
        order.append(column(name).desc_nulls_first() if way == "desc" else column(name).asc_nulls_first())
    return df.orderBy(*order)


def limit(df: DataFrame, count: int | None = None, offset: int = 0) -> DataFrame:
    df = df.offset(offset) if offset else df
    return df if count is None else df.limit(count)


def top_n(df: DataFrame, count: int, *keys: tuple[Name, str] | Name) -> DataFrame:
    """The first rows of a sort; each task keeps no more than ``count``."""
    return sort(df, *keys).limit(count)


def distinct_on(df: DataFrame, keys: Sequence[Name], *order: tuple[Name, str] | Name) -> DataFrame:
    """For each combination of keys, the row that comes first in ``order``."""
    first = [column(k[0]).desc_nulls_first() if isinstance(k, tuple) and k[1] == "desc" else column(k[0] if isinstance(k, tuple) else k).asc_nulls_first() for k in order]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*(first or [F.lit(1)])))
    name = next(f"__place{n}" for n in range(len(df.columns) + 1) if f"__place{n}" not in {c.lower() for c in df.columns})
    return df.withColumn(name, place).where(F.col(name) == 1).drop(name)
