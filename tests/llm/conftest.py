"""Small tables that hold what every operator must stand."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A function from (id, text[, source[, lang]]) rows to a documents table with a clashing extra column."""

    def make(*rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s0", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, SCHEMA).selectExpr("*", "'x' as score", "'y' as row", "1.5D as shard", "'z' as keep", "'w' as ids")

    return make


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in every column, empty and blank texts, repeated rows, ties, and a long text."""
    long = " ".join(f"word{i % 977}" for i in range(30_000))
    return documents(
        (1, "the quick brown fox jumps over the lazy dog again and again", "s0"),
        (1, "the quick brown fox jumps over the lazy dog again and again", "s0"),
        (2, "the quick brown fox jumps over the lazy dog again and again", "s1"),
        (3, None, "s1"),
        (4, "", "s1"),
        (5, " \n\t ", None),
        (None, "a text without an id, which is long enough to be a line", None, None),
        (None, None, None, None),
        (6, long, "s2"),
        (7, "Größe ß 𝔘nicode space ﷐ \x00 end", "s2"),
        (8, "x" * 5000, "s2"),
    )
