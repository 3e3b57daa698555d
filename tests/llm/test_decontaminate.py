import hashlib
import re

from tests.conftest import SMALL

from lodestone.llm import decontaminate
from lodestone.llm.queries import QUERIES, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, window=8):
    wanted = {}
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wanted.setdefault(tuple(w[k : k + window]), set()).add(i)
    sizes = {len(x) for x in wanted}
    out = []
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in wanted:
                    hit.update(range(k, k + size))
                    found |= wanted[tuple(w[k : k + size])]
        found.discard(None)
        listed = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=repr)


def test_whole_table_by_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    assert sorted(map(tuple, QUERIES["op5_decontaminate"](spark, SMALL).collect()), key=repr) == by_hand(docs, items)


def items_of(spark, *rows):
    return spark.createDataFrame(list(rows), "item_id long, text string")


def test_short_items_ties_and_blocks(spark, documents, odd):
    rows = [
        (1, "one two three FOUR five six seven eight nine ten"),
        (2, "a b a b a b a b a b a b"),
        (3, "short"),
        (4, "three four five six seven eight nine ten eleven and a b a b"),
        (None, "one two three four five six seven eight"),
        (5, "nothing here at all"),
    ]
    items = [(10, "one two three four five six seven eight nine"), (11, "Short!"), (12, "a b a b a b a b"), (13, "a b"), (14, ""), (15, None), (None, "nothing here"), (2, "here at all"), (2, "here at all")]
    docs = documents(*rows).unionByName(odd)
    want = by_hand([(r.doc_id, r.text) for r in docs.collect()], items)
    table_ = items_of(spark, *items)
    assert sorted(map(tuple, decontaminate.op5_decontaminate(docs, table_).collect()), key=repr) == want
    found = decontaminate.find_contamination(docs, table_, block_bytes=150)
    again = sorted(((r.doc_id, r.n_words, sum(b - a for a, b in r.runs), len(r["items"])) for r in found.collect()), key=repr)
    assert again == sorted((w[:4] for w in want), key=repr)


def test_empty_tables(spark, odd):
    none = items_of(spark, (1, "x")).limit(0)
    assert all(r.n_hit == 0 and not r.contaminated for r in decontaminate.op5_decontaminate(odd, none).collect())
    assert decontaminate.op5_decontaminate(odd.limit(0), none).count() == 0


def test_drop(spark, documents):
    docs = documents((1, "x " * 5 + "a passage of the benchmark that is eight words"), (2, "clean text"), (None, "also clean"))
    kept = decontaminate.drop_contaminated(docs, items_of(spark, (1, "a passage of the benchmark that is eight words long")))
    assert kept.columns == docs.columns and sorted(r.text for r in kept.collect()) == ["also clean", "clean text"]
