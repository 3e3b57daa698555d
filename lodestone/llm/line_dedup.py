"""Removal of lines that spread over many sites (DataFrame operations only).

A line's spread is the number of distinct sites (sources) it occurs on, and no more than
the number of distinct texts: the lines of a text that was copied to many sites are that
text's, which near-duplicate removal keeps once. HyperLogLog sketches of sites and of
texts, a pair for each line hash, are built straight from the lines where they are and
merged by the aggregation. Lines whose estimate is near the threshold get exact distinct
counts; lines far above it are boilerplate at once, lines far below are not.

Boilerplate goes from every document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, row_key, spread_join, text_hashes

#: Sites (and texts) from which on a line is boilerplate, and characters that a line needs to be looked at.
LEAST_SITES, LEAST_CHARS = 6, 10
#: Estimates from 1/BAND to BAND times the threshold are counted exactly.
BAND = 2.0
SKETCH_BITS = 10
#: Bytes of row keys and positions that are broadcast at most.
MOST_BYTES = 32 << 20

#: Identifies a row; equal rows have equal results.
ROW = row_key("cast(doc_id as long)", "cast(text as string)", "cast(source as string)")
#: Two hashes with different seeds identify a line.
LINE = ["h1", "h2"]


def lines_of(rows: DataFrame, *kept: str) -> DataFrame:
    """``kept, pos, h1, h2`` of the trimmed lines that are long enough; no text travels further."""
    each = rows.select(*kept, F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    each = each.select(*kept, "pos", F.trim("raw").alias("line")).where(F.length("line") >= LEAST_CHARS)
    return each.select(*kept, "pos", *text_hashes("line"))


def spread_lines(rows: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """``h1, h2`` of the lines on ``least_sites`` sites and in as many texts or more; a null source is no site."""
    low, high = least_sites / BAND, least_sites * BAND
    lines = lines_of(rows.withColumn("of", F.xxhash64("text")), "source", "of")
    sketch = lambda c: F.hll_sketch_estimate(F.hll_sketch_agg(c, F.lit(SKETCH_BITS)))
    estimates = lines.groupBy(*LINE).agg(sketch("source").alias("sites"), sketch("of").alias("texts"))
    spread = F.least("sites", "texts")
    wide = cut(estimates.select(*LINE, spread.alias("spread")).where(spread >= low))
    near = bounded(wide.where(F.col("spread") <= high).select(*LINE))
    # Only the lines in the band are looked up again; equal ones of a site, and of a text, meet where they are.
    seen = cut(lines.join(near, LINE, "left_semi").groupBy(*LINE, "source", "of").agg(F.count(F.lit(1)).alias("n")))
    enough = lambda c: seen.where(F.col(c).isNotNull()).groupBy(*LINE, c).agg(F.lit(1)).groupBy(*LINE).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_sites).select(*LINE)
    return wide.where(F.col("spread") > high).select(*LINE).union(enough("source").join(enough("of"), LINE, "left_semi"))


def find_boilerplate(docs: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """``row, drop``: for each document with such lines, their sorted positions."""
    rows = docs.selectExpr(f"{ROW} as row", "cast(text as string) as text", "cast(source as string) as source")
    spread = bounded(cut(spread_lines(rows, least_sites)))
    # Equal rows have equal lines.
    hits = lines_of(rows, "row").join(spread, LINE, "left_semi")
    return hits.groupBy("row").agg(F.array_sort(F.collect_set("pos")).alias("drop"))


def remove_boilerplate(docs: DataFrame, least_sites: int = LEAST_SITES) -> DataFrame:
    """All rows and columns; ``text`` without boilerplate lines, and ``n_chars`` (if there) its length.

    Needs ``doc_id, text, source``. A null text stays null and an empty one empty; a
    null source counts as no site, but its lines go like others; lines of fewer than
    ten characters after trimming always stay; repeated rows repeat their lines'
    occurrences, not their sites or texts; an empty table gives no rows. ``n_dropped``
    counts removed lines. A document of boilerplate alone becomes empty.
    """
    found = cut(find_boilerplate(docs, least_sites).toDF("__row", "__drop"))
    size = found.agg(F.sum(F.size("__drop") * 4 + 48)).first()[0] or 0
    named = docs.withColumn("__row", F.expr(ROW))
    # A large table is joined by a shuffle; copies of one row are dealt to many tasks.
    kept = named.join(F.broadcast(found), "__row", "left") if size <= MOST_BYTES else spread_join(named, found, "__row", "left")
    drop = F.coalesce("__drop", F.array().cast("array<int>"))
    rest = "array_join(filter(split(text, '\\n'), (x, i) -> not array_contains(__keep, i)), '\\n')"
    out = kept.withColumn("__keep", drop).withColumn("n_dropped", F.size("__keep").cast("long"))
    out = out.withColumn("text", F.when(F.size("__keep") > 0, F.expr(rest)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__keep") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[c for c in docs.columns if c != "n_dropped"], "n_dropped")


def op8_line_dedup(docs: DataFrame) -> DataFrame:
    """Every document with its text after removal, by its checksum."""
    return remove_boilerplate(docs.select("doc_id", "text", "source")).selectExpr(
        "doc_id", "n_dropped", "cast(length(text) as long) as n_chars_left", "md5(text) as text_md5"
    )


#: The same rows in DuckDB's SQL: exact distinct counts for every line.
OP8_SQL = f"""
WITH rows_ AS (SELECT doc_id, text, source, row_number() OVER () AS r FROM documents),
lines AS (
  SELECT r, source, text, u.pos, trim(u.raw, ' ') AS line FROM (
    SELECT r, source, text, unnest(list_zip(range(len(string_split(text, chr(10)))), string_split(text, chr(10)))) AS z FROM rows_
  ) s, LATERAL (SELECT s.z[1] AS pos, s.z[2] AS raw) u
  WHERE length(trim(u.raw, ' ')) >= {LEAST_CHARS}
),
spread AS (SELECT line FROM lines GROUP BY line HAVING count(DISTINCT source) >= {LEAST_SITES} AND count(DISTINCT md5(text)) >= {LEAST_SITES}),
hits AS (SELECT r, list(pos) AS drops FROM lines JOIN spread USING (line) GROUP BY r),
kept AS (SELECT doc_id, text, coalesce(drops, []) AS drops FROM rows_ LEFT JOIN hits USING (r)),
cut_ AS (
  SELECT doc_id, drops, CASE WHEN len(drops) = 0 THEN text ELSE array_to_string(
    list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(drops, i - 1)), chr(10)) END AS text FROM kept
)
SELECT doc_id, CAST(len(drops) AS BIGINT) AS n_dropped, CAST(length(text) AS BIGINT) AS n_chars_left, md5(text) AS text_md5 FROM cut_
"""
