"""Proportional stratified interleaving into shards (DataFrame operations only).

Every source is shuffled by a seeded hash. A row's place in its source, from 0 to 1, is
the share of the source that lies before it, moved by a seeded offset of the source
(less than one row's share), so that sources of few rows spread like those of many. All
rows are sorted by that fraction and the order is cut into equal runs. Every run then
holds each source in the corpus' proportion.

Ranks are exact and no window holds a whole source: the hash space of a source
and the fractions are divided into as many ranges as a range has rows (the root of
all rows), a row is ranked within its range, and the sizes of the ranges before it are
added. Both the ranges' rows and their number grow with the root only. Equal rows are
ranked as one with a weight and dealt out again in runs of the same size, so that they
are no large window either.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, parts_for

#: Rows that one ranking window holds at least, on average.
RANGE_ROWS = 400
#: Hexadecimal digits of MD5 that make the shuffle key.
KEY_DIGITS = 15
SPAN = float(16**KEY_DIGITS)


def shard_rows(
    docs: DataFrame,
    shards: int = 8,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Shard and slot of every row; shard sizes differ by one row at most.

    Returns ``doc_id, size, text_crc32, source, shard, slot``. A null text has
    size 1 and the checksum of no bytes; null sources form one source; a null id
    is an id like others; equal rows are ranked side by side, and which of them
    takes which place can't be told; an empty table gives no rows. Other columns
    are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    crc = F.crc32(text.cast("binary"))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    tie = ["key", "doc_id", "text_crc32", "size"]
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        crc.alias("text_crc32"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("stratum"),
        seeded(seed, name, crc).alias("key"),
    )
    # Equal rows meet where they are, then as one row.
    rows = cut(rows.groupBy("stratum", "source", *tie).agg(F.count(F.lit(1)).alias("copies")))
    total = rows.agg(F.sum("copies")).first()[0] or 0
    ranges = parts_for(total, max(range_rows, math.isqrt(total)))

    # Rank of a row in its source: rows in the ranges before, then within its own.
    ranged = rows.withColumn("range", F.least(F.floor(F.col("key") / SPAN * ranges), F.lit(ranges - 1)).cast("long"))
    counts = ranged.groupBy("stratum", "range").agg(F.sum("copies").alias("n"))
    whole = Window.partitionBy("stratum")
    before = counts.select(
        "stratum",
        "range",
        (F.sum("n").over(whole.orderBy("range")) - F.col("n")).alias("before"),
        F.sum("n").over(whole).alias("of"),
        (seeded(seed, F.lit("source"), F.col("stratum")) / SPAN).alias("offset"),
    )
    in_range = Window.partitionBy("stratum", "range").orderBy(*tie)
    ranked = ranged.withColumn("nth", F.sum("copies").over(in_range) - F.col("copies")).join(before, ["stratum", "range"])
    ranked = ranked.select("doc_id", "size", "text_crc32", "source", "key", "copies", "of", "offset", (F.col("before") + F.col("nth")).alias("first"))
    ranked = dealt(ranked, max(range_rows, math.isqrt(total)))
    fraction = (F.col("place").cast("double") + F.col("offset")) / F.col("of").cast("double")
    ranked = cut(
        ranked.select("doc_id", "size", "text_crc32", "source", "key", fraction.alias("fraction")).withColumn(
            "range", F.least(F.floor(F.col("fraction") * ranges), F.lit(ranges - 1)).cast("long")
        )
    )

    # Rank of a row among all, the same way; the list of ranges is short.
    sizes = ranked.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    in_range = Window.partitionBy("range").orderBy("fraction", *tie)
    placed = ranked.withColumn("nth", F.row_number().over(in_range)).join(before, "range")
    rank = F.col("before") + F.col("nth") - 1
    shard = F.expr(f"cast((before + nth - 1) * {shards} div {max(1, total)} as int)")
    first = F.expr(f"(cast(shard as bigint) * {total} + {shards - 1}) div {shards}")
    return placed.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", "source", "shard", (rank - first).cast("long").alias("slot")
    )


def seeded(seed: int, *columns: Column) -> Column:
    """A whole number below ``SPAN`` that a seed and values decide."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *columns)), 1, KEY_DIGITS), 16, 10).cast("long")


def dealt(rows: DataFrame, most: int) -> DataFrame:
    """A row for each of its ``copies``, with its ``place`` from ``first`` on; one task makes no more than ``most`` of a row."""
    many = rows.where(F.col("copies") > most)
    runs = many.withColumn("at", F.explode(F.expr(f"sequence(0L, copies - 1, {most}L)")))
    runs = runs.select(*[c for c in rows.columns if c not in ("first", "copies")], (F.col("first") + F.col("at")).alias("first"), F.expr(f"least({most}L, copies - at)").alias("copies"))
    each = rows.where(F.col("copies") <= most).unionByName(runs.repartition("key", "first"))
    return each.withColumn("place", F.explode(F.expr("sequence(first, first + copies - 1)")))


def op3_sharding(docs: DataFrame) -> DataFrame:
    """The contract's digest of :func:`shard_rows` with eight shards."""
    return shard_rows(docs).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
    )
