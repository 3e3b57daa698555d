"""The queries of this subpackage, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from . import decontaminate, line_dedup, near_dedup, neighbours, oracles, pieces, quality, secrets, sharding, token_counts, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_documents(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"))


def on_two(f: Callable[[DataFrame, DataFrame], DataFrame], other: str) -> Query:
    return lambda spark, sf_dir: f(table(spark, sf_dir, "documents"), table(spark, sf_dir, other))


ORACLES: dict[str, str] = oracles.ORACLES
QUERIES: dict[str, Query] = {
    "op1_secrets": on_documents(secrets.op1_secrets),
    "op2_quality": on_two(quality.op2_quality, "labels"),
    "op3_sharding": on_documents(sharding.op3_sharding),
    "op4_toxicity": on_two(toxicity.op4_toxicity, "labels"),
    "op5_decontaminate": on_two(decontaminate.op5_decontaminate, "benchmark"),
    "op6_token_counts": on_documents(token_counts.op6_token_counts),
    "op7_pieces": on_documents(pieces.op7_pieces),
    "op8_line_dedup": on_documents(line_dedup.op8_line_dedup),
    "op9_near_dedup": on_documents(near_dedup.op9_near_dedup),
    "op10_neighbours": lambda spark, sf_dir: neighbours.op10_neighbours(table(spark, sf_dir, "embeddings")),
}
