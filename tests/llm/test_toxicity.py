import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import toxicity
from lodestone.llm.queries import QUERIES, table
from tests.conftest import SMALL

MIDDLE = "/root/testdata/sf0.1"


def test_held_out(spark):
    rows = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, MIDDLE).collect()}
    assert len(rows) == table(spark, MIDDLE, "documents").count()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.3)
    held = [(r.toxic, rows[r.doc_id].score) for r in table(spark, MIDDLE, "labels").collect() if rows[r.doc_id].held_out]
    toxic, clean = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([a > b for a in toxic for b in clean]) + np.mean([a == b for a in toxic for b in clean]) / 2 > 0.93
    assert np.mean([s >= 0.3 for s in toxic]) > 0.85
    assert np.mean([s >= 0.3 for s in clean]) < 0.05


def scores_by_hand(docs, labels):
    """Every document's score, by loops over all rows on one machine."""
    split = {i: re.findall("[0-9a-z\\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in docs}
    first = {}  # of equal texts the least id
    for i, t in sorted(docs):
        if i in labels and zlib.crc32(str(i).encode()) % 4 != 2:
            first.setdefault(t, i)
    train = {i: labels[i] for i in first.values()}
    held, counts = ({y: Counter() for y in (0, 1)} for _ in range(2))
    for i, y in train.items():
        held[y].update(set(split[i]))
        counts[y].update(split[i])
    n = Counter(train.values())
    words = [w for w in held[1] if held[1][w] >= 3]
    every = Counter(w for ws in split.values() for w in ws)
    total = {y: sum(counts[y].values()) for y in (0, 1)}
    scores = {}
    for w in words:
        a, b = held[1][w], held[0][w]
        share = (a + b) / (n[0] + n[1])
        ratio = 0.0
        for k, of in ((a, n[1]), (b, n[0])):
            for x, p in ((k, k / of), (of - k, 1 - k / of)):
                ratio += 2 * x * math.log(p / (share if p == k / of and x == k else 1 - share)) if x else 0
        weight = 0.1 * total[1]
        prior = weight * (every[w] + 0.5) / (sum(every.values()) + 1)
        odds = [math.log((counts[y][w] + prior) / (total[y] + weight - counts[y][w] - prior)) for y in (0, 1)]
        if a / n[1] > share and ratio >= 2 * math.log(len(words)) and odds[1] - odds[0] > 1:
            scores[w] = min(odds[1] - odds[0], 10) - 1
    chance = Counter({round(s * 4) / 4: 0 for s in scores.values()})
    for w, s in scores.items():
        chance[round(s * 4) / 4] += counts[0][w]
    chance[-1.0] = total[0] - sum(chance.values())
    rate = toxicity.extreme_rate({s: c for s, c in chance.items() if c})
    found = {i: [x[2] for x in toxicity.maximal_segments(np.array([scores.get(w, -1.0) for w in ws]))] for i, ws in split.items()}
    gaps = [rate * max(found[i]) - math.log(len(split[i])) - 0.5772156649 for i, y in train.items() if not y and found[i]]
    model = toxicity.Model({}, rate, sum(gaps) / (len(gaps) + 1), np.zeros(4))
    x = {i: np.array(toxicity.row_features(len(split[i]), found[i], model)) for i in split}
    w = np.array([-4.0, 0, 0, 0])
    for _ in range(400):  # Newton steps on the penalised likelihood, one row at a time
        slope, bend = -np.array([1e-3, 1, 1, 1]) * (w - [-4, 0, 0, 0]), np.diag([1e-3, 1.0, 1, 1])
        for i, y in train.items():
            p = 1 / (1 + math.exp(-x[i] @ w))
            slope, bend = slope + (y - p) * x[i], bend + p * (1 - p) * np.outer(x[i], x[i])
        w = w + 0.2 * np.linalg.solve(bend, slope)
    return {i: 1 / (1 + math.exp(-x[i] @ w)) for i in split}, scores


def test_whole_query_by_hand(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    labels = {r.doc_id: r.toxic for r in table(spark, SMALL, "labels").collect()}
    want, scores = scores_by_hand(docs, labels)
    assert len(scores) > 3
    got = {r.doc_id: r.score for r in QUERIES["op4_toxicity"](spark, SMALL).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[i] - want[i]) for i in want) < 1e-5


def test_all_segments_count():
    many = np.full(300, 0.5)
    assert toxicity.joint_surprise(many) > toxicity.joint_surprise(many[:64]) > 0


def segments_by_hand(scores):
    """Maximal segments by definition: the best segment, then the best of what is left of and right of it."""
    def best(a, b):
        found = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (found is None or total > found[0] + 1e-12):
                    found = (total, i, j + 1)
        if found is None:
            return []
        s, i, j = found
        return [*best(a, i), (i, j, s), *best(j, b)]

    return best(0, len(scores))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([-1.03, -2.11, 0.57, 1.31, 3.77, -0.29]), max_size=14))
def test_segments_are_maximal(scores):
    got = toxicity.maximal_segments(np.array(scores, float))
    want = segments_by_hand(scores)
    assert np.isclose(sum(s for _, _, s in got), sum(s for _, _, s in want))
    assert len(got) == len(want)
    for a, b, s in got:
        assert np.isclose(s, sum(scores[a:b])) and s > 0


def test_rate_solves_its_equation():
    rate = toxicity.extreme_rate({-1.0: 900, 2.0: 50, 5.0: 1})
    assert np.isclose((900 * np.exp(-rate) + 50 * np.exp(2 * rate) + np.exp(5 * rate)) / 951, 1, atol=1e-6)


def test_any_surprise_has_a_logarithm():
    for scores in ([], [0.1], [50.0], [5000.0], [800.0] * 100, [-3.0], [1e-9, 1e-9]):
        assert 0 <= toxicity.joint_surprise(np.array(scores)) < float("inf")
    assert toxicity.joint_surprise(np.array([40.0, 30.0])) > toxicity.joint_surprise(np.array([40.0])) > 39


def test_passages_are_the_toxic_words(documents, spark):
    clean = [(i, f"plain words number {i} and other plain words follow here", "s") for i in range(0, 400)]
    toxic = [(i, f"plain words number {i} you vile rotten creature and words", "s") for i in range(400, 460)]
    docs = documents(*clean, *toxic)
    labels = spark.createDataFrame([(r[0], 1, int(r[0] >= 400)) for r in clean + toxic], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in toxicity.op4_toxicity(docs, labels).collect()}
    assert all(rows[i].predicted == (i >= 400) for i in rows)
    words = toxicity.words_of(toxic[0][1])
    assert all(b"vile" in words[p.start : p.end] for p in rows[400].passages)


def test_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        rows = toxicity.op4_toxicity(odd, some).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    assert toxicity.op4_toxicity(odd.limit(0), labels).count() == 0
