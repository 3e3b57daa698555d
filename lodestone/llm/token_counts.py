"""Exact length histogram: documents by encoded length, and what follows from it.

Every whole text is encoded; documents are counted by length. Suffix sums over the
histogram then give, for any context limit, how many documents are longer, the tokens
that stay after truncation and the quantiles, without another look at the texts.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, segments

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that parts a text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths that one summing window holds.
LENGTH_RANGE = 128


def encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def encoded_lengths(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens`` of every row; a null text has none.

    The vocabulary file is read by the driver and sent along, so executors need no copy.
    """
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks.value).encode_ordinary
        for batch in segments(batches):
            counts = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, n_docs``: documents of each encoded length; pre-aggregated before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_table(histogram: DataFrame, length_range: int = LENGTH_RANGE) -> DataFrame:
    """What every context limit that is some document's length keeps.

    ``limit_tokens, n_docs`` (of that very length), ``docs_within`` and
    ``docs_longer``, ``tokens_within`` (of documents no longer than the limit),
    ``tokens_truncated`` (all documents cut at the limit), ``total_tokens`` and
    ``quantile`` (share of documents no longer). Between two rows
    ``tokens_truncated`` grows by ``docs_longer`` a token, so every limit is answered
    (:func:`truncated_total`). An empty histogram gives no rows.
    """
    rows = cut(histogram.withColumn("range", F.floor(F.col("n_tokens") / length_range)))
    rows = rows.withColumn("tokens", (F.col("n_tokens") * F.col("n_docs")).cast("decimal(38,0)"))
    ranges = rows.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # One row for each few thousand lengths, so this window is short at any corpus size.
    after = Window.orderBy(F.desc("range"))
    everything = Window.partitionBy()
    ranges = ranges.select(
        "range",
        (F.sum("d").over(after) - F.col("d")).alias("d_after"),
        (F.sum("t").over(after) - F.col("t")).alias("t_after"),
        F.sum("d").over(everything).alias("d_all"),
        F.sum("t").over(everything).alias("t_all"),
    )
    suffix = Window.partitionBy("range").orderBy(F.desc("n_tokens"))
    longer = F.sum("n_docs").over(suffix) - F.col("n_docs") + F.col("d_after")
    beyond = F.sum("tokens").over(suffix) - F.col("tokens") + F.col("t_after")
    summed = rows.join(ranges, "range").select(
        F.col("n_tokens").alias("limit_tokens"), "n_docs", longer.alias("docs_longer"), beyond.alias("beyond"), "d_all", "t_all"
    )
    within = F.col("t_all") - F.col("beyond")
    return summed.select(
        "limit_tokens",
        "n_docs",
        (F.col("d_all") - F.col("docs_longer")).alias("docs_within"),
        "docs_longer",
        within.cast("long").alias("tokens_within"),
        (within + F.col("limit_tokens") * F.col("docs_longer")).cast("long").alias("tokens_truncated"),
        F.col("t_all").cast("long").alias("total_tokens"),
        ((F.col("d_all") - F.col("docs_longer")) / F.col("d_all")).alias("quantile"),
    )


def truncated_total(table: DataFrame, limit: int) -> int:
    """Tokens that stay if every document is cut at ``limit``; any limit of 0 or more."""
    below = table.where(F.col("limit_tokens") <= limit).orderBy(F.desc("limit_tokens")).first()
    if below is not None:
        return below.tokens_truncated + (limit - below.limit_tokens) * below.docs_longer
    least = table.orderBy("limit_tokens").first()
    return 0 if least is None else limit * (least.docs_longer + least.n_docs)


def length_at_quantile(table: DataFrame, q: float) -> int | None:
    """The least length that a share ``q`` of the documents doesn't exceed."""
    found = table.where(F.col("quantile") >= q).orderBy("limit_tokens").first()
    return None if found is None else found.limit_tokens


def op6_token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """The context table of all documents."""
    return context_table(length_histogram(encoded_lengths(docs, tokenizer)))
