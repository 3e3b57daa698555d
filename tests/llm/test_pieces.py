import random

import pytest
import sentencepiece
from tests.conftest import TINY

from lodestone.llm import pieces
from lodestone.llm.queries import QUERIES, table


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_whole_table_matches_the_library(spark, model):
    texts = {r.doc_id: r.text for r in table(spark, TINY, "documents").collect()}
    rows = QUERIES["op7_pieces"](spark, TINY).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == model.encode(texts[r.doc_id]) and r.round_trip and r.n_tokens == len(r.ids)


def test_odd_rows(odd, model):
    rows = pieces.encode_documents(odd).collect()
    texts = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=repr)
    assert sorted(((r.doc_id, r.ids) for r in rows), key=repr) == sorted(((i, model.encode(t)) for i, t in texts), key=repr)
    assert all(r.round_trip for r in rows)
    assert pieces.encode_documents(odd.limit(0)).count() == 0


def test_random_strings(documents, model):
    rng = random.Random(8)
    alphabet = ["a", "b", "e", "th", "ing", " ", "  ", "\n", "ß", "é", "𝔘", "12", ".", "\t", "\x01", "﷐", "nation", "ab" * 45]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 30))) for _ in range(150)]
    rows = pieces.encode_documents(documents(*enumerate(texts))).collect()
    for r in rows:
        assert r.ids == model.encode(texts[r.doc_id]), texts[r.doc_id]
        assert r.round_trip


def viterbi(word, vocabulary):
    """Best path of a unigram model by hand; an uncovered character costs ten more than the worst piece."""
    scores = {p: (s, i) for p, i, s in vocabulary.pieces}
    unknown = min(s for _, _, s in vocabulary.pieces) - 10
    best = [(0.0, [])]
    for end in range(1, len(word) + 1):
        ways = []
        for start in range(max(0, end - vocabulary.longest), end):
            piece = word[start:end]
            if piece in scores:
                ways.append((best[start][0] + scores[piece][0], best[start][1] + [scores[piece][1]]))
            elif end - start == 1:
                ways.append((best[start][0] + unknown, best[start][1] + [-1]))
        best.append(max(ways, key=lambda x: x[0]))
    return best[-1][1]


def test_viterbi_of_a_unigram_model(spark, documents):
    table_ = [("▁", -3.1), ("a", -4.3), ("b", -4.7), ("ab", -5.2), ("▁ab", -6.05), ("ba", -5.9), ("aba", -9.01), ("bb", -9.7), ("▁a", -5.13)]
    vocabulary = pieces.Vocabulary(tuple((p, i + 3, s) for i, (p, s) in enumerate(table_)), (-1,) * 256, "unigram", 0)
    words = ["▁abab", "▁", "▁babab", "aabbx", "▁xab", "b" * 9, "▁abbaab"]
    frame = spark.createDataFrame([(0, w) for w in words], "bucket int, word string")
    assert {r.word: r.ids for r in pieces.viterbi(frame, vocabulary).collect()} == {w: viterbi(w, vocabulary) for w in words}
    row = pieces.encode(documents((1, "abab xab  b")), vocabulary).first()
    want = [i if i >= 0 else 0 for w in ("▁abab", "▁xab", "▁▁b") for i in viterbi(w, vocabulary)]
    assert row.ids == want


def test_both_folds_of_merges_agree(spark):
    vocabulary = pieces.load()
    rng = random.Random(1)
    words = sorted({"▁" + "".join(rng.choice("aeinorst") for _ in range(rng.randrange(2, 50))) for _ in range(200)})
    lattice = pieces.merge_lattices(spark.createDataFrame([(0, w) for w in words], "bucket int, word string"), vocabulary).cache()
    short = {r.word: pieces.parted(r.word, r.borders) for r in pieces.merge_folds(lattice).collect()}
    assert {r.word: pieces.merged(r.word, r.edges) for r in lattice.collect()} == short


def test_long_words(documents, model):
    """Words without a space: one letter or few, no script that pieces cover, encoded bytes; all linear."""
    rng = random.Random(4)
    texts = [
        "x" * 200_000,
        "".join(rng.choice("ACGT") for _ in range(50_000)),
        "".join(rng.choice("的一是不了人我在有他这中大来上国𝔘") for _ in range(50_000)),
        "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000)),
        "=-" * 20_000 + "internationalization" * 3_000 + " end",
        "y" * pieces.MOST_BITS + " " + "y" * (pieces.MOST_BITS + 1),
    ]
    rows = {r.doc_id: r for r in pieces.encode_documents(documents(*enumerate(texts))).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == model.encode(t) and rows[i].round_trip, i


def test_substrings_of_chunks(spark):
    """Chunks have the substrings of the whole word, each once."""
    word = "".join(random.Random(2).choice("abc") for _ in range(150))
    entries = pieces.Parting("", frozenset(), 7).entries(word)
    assert len(entries) == 3
    got = []
    for k, e in enumerate(entries):
        found = pieces.spans(spark.createDataFrame([(0, e)], "bucket int, word string"), 7, 2).collect()
        got += [(k * pieces.CHUNK + r.s, r.l, r.piece) for r in found]
    assert sorted(got) == sorted((s, n, word[s : s + n]) for s in range(150) for n in range(2, 8) if s + n <= 150)


def test_round_trip_tells(documents, model):
    """A text with the mark itself doesn't decode to itself; ids that were put together wrong wouldn't either."""
    rows = {r.doc_id: r for r in pieces.encode_documents(documents((1, "a▁b"), (2, "a b"))).collect()}
    assert not rows[1].round_trip and rows[2].round_trip
    coder = pieces.Coder(pieces.load())
    ids = model.encode("one two three")
    assert coder.text(ids) == "one two three" != coder.text(ids[::-1])


def test_order_of_merges_must_be_steady():
    fine = [("ab", -1.0), ("bc", -2.0), ("abc", -3.0)]
    late = [("abc", -1.0), ("bc", -2.0)]
    of = lambda rows: pieces.Vocabulary(tuple((p, i, s) for i, (p, s) in enumerate(rows)), (-1,) * 256, "bpe", 0)
    assert pieces.steady(of(fine)) and not pieces.steady(of(late))


def test_decode(spark, documents, model):
    vocabulary = pieces.load()
    texts = ["plain words", "  two  spaces ", "lines\n\nand ß 𝔘", ""]
    coded = pieces.encode(documents(*enumerate(texts)), vocabulary)
    got = {r.doc_id: r.decoded for r in pieces.decode(coded, vocabulary).collect()}
    assert got == dict(enumerate(texts))


def test_words_part_where_no_piece_reaches():
    assert pieces.words_of("a  b\n\nc ") == ["▁a", "▁▁b", "\n", "\n", "c", "▁"]
    assert pieces.words_of("") == []
    for text in ("a b\nc", "x \ny", "a ", "\n\na", "one", "\n", "a\n", "a\tb c"):
        assert [w for w in pieces.words_of(text) if w] == pieces.PART.findall(pieces.MARK + text.replace(" ", pieces.MARK))
