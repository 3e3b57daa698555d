import zlib
from collections import Counter

from tests.conftest import SMALL

from lodestone.llm import sharding
from lodestone.llm.queries import QUERIES, table


def test_law_and_mixture(spark):
    docs = {r.doc_id: r for r in table(spark, SMALL, "documents").collect()}
    rows = QUERIES["op3_sharding"](spark, SMALL).collect()
    counts = Counter(r.shard for r in rows)
    assert sorted(counts) == list(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    for r in rows:
        raw = docs[r.doc_id].text.encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    # Each source's share of a shard is its share of the corpus, but for rounding.
    sources = Counter(d.source for d in docs.values())
    for (shard, source), n in Counter((r.shard, docs[r.doc_id].source) for r in rows).items():
        assert abs(n - sources[source] / 8) <= 2, (shard, source)


def test_sources_of_one_row(spark):
    """20,000 rows of one source and 20,000 sources of one row: every shard has both alike."""
    docs = spark.range(40_000).selectExpr("id as doc_id", "'x' as text", "if(id < 20000, 'big', concat('site', id)) as source")
    counts = Counter((r.shard, r.source == "big") for r in sharding.shard_rows(docs).select("shard", "source").collect())
    for shard in range(8):
        assert counts[shard, True] + counts[shard, False] == 5000
        assert abs(counts[shard, True] - 2500) <= 50  # within 1 %


def test_equal_rows_in_number(spark):
    """100,000 equal rows without an id are no large window, and are spread like others."""
    docs = spark.range(120_000).selectExpr("if(id < 100000, null, id) as doc_id", "if(id < 100000, 'same', 'other') as text", "'s' as source")
    placed = sharding.shard_rows(docs)
    counts = Counter((r.shard, r.doc_id is None) for r in placed.select("shard", "doc_id").collect())
    assert sum(counts.values()) == 120_000 and all(counts[s, True] + counts[s, False] == 15_000 for s in range(8))
    slots = {(r.shard, r.slot) for r in placed.select("shard", "slot").collect()}
    assert slots == {(s, n) for s in range(8) for n in range(15_000)}


def test_equal_rows_are_dealt_in_runs(spark):
    rows = spark.createDataFrame([(1, 3, 25), (2, 40, 1), (3, 50, 10)], "key long, first long, copies long")
    got = sorted((r.key, r.place) for r in sharding.dealt(rows, 10).collect())
    assert got == [(1, 3 + i) for i in range(25)] + [(2, 40)] + [(3, 50 + i) for i in range(10)]


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op3_sharding"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def by_hand(rows, shards, seed=7):
    import hashlib

    keyed = []
    for i, text, source in rows:
        raw = (text or "").encode()
        key = hashlib.md5(f"{seed}:{'null' if i is None else i}:{zlib.crc32(raw)}".encode()).hexdigest()[: sharding.KEY_DIGITS]
        keyed.append((source, int(key, 16), i, zlib.crc32(raw), len(raw) + 1))
    out = []
    for s in {k[0] for k in keyed}:
        own = sorted((k for k in keyed if k[0] == s), key=lambda k: (k[1], k[2] is not None, k[2] or 0, k[3], k[4]))
        offset = int(hashlib.md5(f"{seed}:source:{'n' if s is None else f's{s}'}".encode()).hexdigest()[: sharding.KEY_DIGITS], 16) / sharding.SPAN
        out += [((n + offset) / len(own), *k[1:]) for n, k in enumerate(own)]
    out.sort(key=lambda k: (k[0], k[1], k[2] is not None, k[2] or 0, k[3], k[4]))
    placed = Counter()
    rows = []
    for n, k in enumerate(out):
        shard = n * shards // len(out)
        rows.append((k[2], k[4], k[3], shard, placed[shard]))
        placed[shard] += 1
    return sorted(rows, key=repr)


def test_odd_rows_by_hand(odd):
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    got = sharding.shard_rows(odd, 3, range_rows=2).collect()
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got), key=repr) == by_hand(rows, 3)
    assert sharding.op3_sharding(odd.limit(0)).count() == 0
