import re

from tests.conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import secrets
from lodestone.llm.queries import QUERIES, table


def test_whole_table_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    rows = QUERIES["op1_secrets"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.base_sha256, r.spans) == secrets.spans_by_scan(texts[r.doc_id])


def test_each_kind_is_found(documents):
    text = "\n".join(
        ["API_KEY = 'abcdef123'", "pass password:short", "AKIA" + "B" * 16, "0123456789abcdef" * 2, "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "Zq" * 18, "xoxb-" + "1" * 12, "eyJ" + "a" * 9 + ".eyJ" + "b" * 9 + ".c"]
    )
    row = secrets.op1_secrets(documents((1, text))).first()
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 1, 1)
    assert [s.split(":")[0] for s in row.spans.split(",")] == ["assign", "access", "hex", "private_key", "forge_token", "chat_token", "web_token"]


def test_odd_rows(odd, spark):
    rows = secrets.op1_secrets(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.spans == "" and r.n_hex == 0 for r in rows)
    assert secrets.op1_secrets(odd.limit(0)).count() == 0


def test_expressions_are_read():
    """The parser of expressions is Python's own and not part of its public library; this fails if it changes."""
    for pattern, kind in (("abcd", "and"), ("abcd|wxyz", "or"), ("[0-9a-f]+", "all")):
        assert secrets.trigram_query(pattern)[0] == kind


def test_case_and_code_points(documents):
    row = secrets.op1_secrets(documents((1, "𝔘ß SeCrEt\x20=\x20'abcdef' paſſword=abcdefgh"))).first()
    assert row.spans == "assign:3:19"


PIECES = ["token", "TOKEN", "=", ":", " ", '"', "abcdef", "12", "AKIA", "ABCDEFGHIJKLMNOPQ", "deadbeef" * 3, "ß", "\n", "api", "_key", "pass", "word", "ghp_", "z" * 36]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_queries_never_miss(text):
    index = secrets.SegmentIndex(sorted(set().union(*(secrets.grams_in(secrets.trigram_query(r.pattern)) for r in secrets.RULES))))
    index.build(["", text, "other"])
    for r in secrets.RULES:
        if re.search(r.pattern, text):
            assert 1 in index.candidates(secrets.trigram_query(r.pattern)).tolist()
        assert secrets.spans_of(r, re.compile(secrets.search_pattern(r)), text) == secrets.spans_of(r, re.compile(r.pattern), text)


def test_postings_narrow():
    query = secrets.trigram_query(r"(foo|bar)baz[0-9]+quux")
    index = secrets.SegmentIndex(sorted(secrets.grams_in(query)))
    index.build(["foobaz1quux", "barbaz", "foo baz quux", "BARBAZ7QUUX"])
    assert index.candidates(query).tolist() == [0, 3]
    assert secrets.trigram_query("[0-9a-f]+") == secrets.ALL
