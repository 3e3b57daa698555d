from collections import Counter

import pytest
from tests.conftest import TINY

from lodestone.llm import token_counts
from lodestone.llm.queries import QUERIES, table


def lengths(texts):
    with open(token_counts.TOKENIZER, "rb") as f:
        encode = token_counts.encoder(f.read()).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def by_hand(sizes):
    out = []
    for limit, n in sorted(Counter(sizes).items()):
        within = [s for s in sizes if s <= limit]
        out.append((limit, n, len(within), len(sizes) - len(within), sum(within), sum(min(s, limit) for s in sizes), sum(sizes), len(within) / len(sizes)))
    return out


def test_whole_table_by_brute_force(spark):
    sizes = lengths(r.text for r in table(spark, TINY, "documents").collect())
    assert sorted(map(tuple, QUERIES["op6_token_counts"](spark, TINY).collect())) == by_hand(sizes)


def test_odd_rows_and_any_limit(odd):
    sizes = lengths(r.text for r in odd.collect())
    context = token_counts.op6_token_counts(odd)
    assert sorted(map(tuple, context.collect())) == by_hand(sizes)
    for limit in (0, 1, 5, 13, 1000, 10**6):
        assert token_counts.truncated_total(context, limit) == sum(min(s, limit) for s in sizes)
    assert token_counts.length_at_quantile(context, 0.5) == sorted(sizes)[(len(sizes) - 1) // 2]
    assert token_counts.op6_token_counts(odd.limit(0)).count() == 0


def test_special_strings_are_text(documents):
    rows = token_counts.encoded_lengths(documents((1, "<|endoftext|>"))).collect()
    assert rows[0].n_tokens > 1


def test_missing_vocabulary(documents):
    with pytest.raises(FileNotFoundError):
        token_counts.encoded_lengths(documents((1, "x")), "/nowhere.tiktoken")
