"""CSV, JSON and Parquet files in and out, through Spark's readers and writers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

READERS = ("read_csv", "read_json", "read_parquet")


def location(path: str) -> str:
    """A path as it is if it names a file system, else absolute."""
    return path if "://" in path or path.startswith("file:") else os.path.abspath(path)


def widened(df: DataFrame) -> DataFrame:
    """Inferred 32-bit integers as 64-bit ones."""
    return df.select(*(F.col(f"`{c}`").cast("long").alias(c) if t == "int" else F.col(f"`{c}`") for c, t in df.dtypes))


def read_csv(
    spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", quote: str = '"', escape: str = "\\", schema: str | None = None
) -> DataFrame:
    """A CSV file; without a schema it is inferred from the whole file."""
    reader = spark.read.option("header", header).option("sep", delimiter).option("quote", quote).option("escape", escape)
    if schema is not None:
        return reader.schema(schema).csv(location(path))
    return widened(reader.option("inferSchema", True).csv(location(path)))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited JSON with an inferred schema."""
    return spark.read.json(location(path))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(location(path))


def write(df: DataFrame, path: str, form: str = "parquet", header: bool = True, delimiter: str = ",") -> None:
    """Write a folder of files in the named format."""
    if form in ("csv", "tbl"):
        df.write.option("header", header).option("sep", delimiter).csv(location(path))
    elif form in ("json", "parquet", "orc"):
        df.write.format(form).save(location(path))
    else:
        raise ValueError(f"unknown format {form!r}")
