import numpy as np
from tests.conftest import SMALL

from lodestone.llm import quality
from lodestone.llm.queries import QUERIES, table


def test_whole_table(spark):
    rows = {r.doc_id: r for r in QUERIES["op2_quality"](spark, SMALL).collect()}
    assert len(rows) == table(spark, SMALL, "documents").count()
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    good = [rows[i].keep for i, q in labels.items() if q == 1]
    bad = [rows[i].keep for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_unseen_documents(spark):
    """Fitted on half of the labels, judged on the other."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.score_documents(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    right = np.mean([r.keep == (r.quality == 1) for r in rows])
    assert right > 0.93


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.7).astype(float)
    one = quality.with_one(np.column_stack([y * 3 + rng.normal(size=4000), rng.normal(size=4000)]))
    two = quality.with_one(np.column_stack([y * 2 + rng.normal(size=4000)]))
    few, pool = slice(0, 60), slice(60, 3000)
    known = quality.Known((one[few], two[few]), y[few], np.arange(60) % 5 == 0)
    model = quality.co_train(known, lambda f: f((one[pool], two[pool])))
    right = ((model.score(one[3000:], two[3000:]) > 0.5) == (y[3000:] > 0.5)).mean()
    assert right > 0.9


def fitted_by_hand(docs, labels, held):
    """The model, by loops over all rows on one machine: features in two matrices, Newton steps on sums over rows."""
    rows = [tuple(np.append(1, x.astype(np.float32)).astype(float) for x in (quality.text_view(d.text), quality.page_view(d.text, d.lang, d.source, d.n_chars))) for d in docs]
    y = {i: labels[d.doc_id] for i, d in enumerate(docs) if d.doc_id in labels}
    learned = [i for i in y if not held[docs[i].doc_id]]
    pool = [i for i in range(len(docs)) if i not in y]
    logit = lambda k, i, w: min(12.0, max(-12.0, float(rows[i][k] @ w)))

    def fit(k, w, steps, teacher=None):
        for _ in range(steps):
            m = len(w)
            damp = np.array([1e-3] + [1.0] * (m - 1))
            slope, bend = -damp * w, np.diag(damp)
            extra = [] if teacher is None else [(i, float(c > 0), 0.3 * min(1, len(learned) / len(teacher))) for i, c in teacher.items()]
            for i, label, weight in [(i, y[i], 1.0) for i in learned] + extra:
                p = 1 / (1 + np.exp(-min(30.0, max(-30.0, float(rows[i][k] @ w)))))
                slope = slope + weight * (label - p) * rows[i][k]
                bend = bend + weight * (p * (1 - p) if teacher is None else 0.25) * np.outer(rows[i][k], rows[i][k])
            step = np.linalg.solve(bend, slope)
            w = w + (np.clip(step, -4, 4) if teacher is None else step)
        return w

    weights = [fit(k, np.zeros(quality.WIDTHS[k]), 25) for k in (0, 1)]
    good = (sum(y[i] for i in learned) + 1) / (len(learned) + 2)
    for _ in range(3):
        sure = []
        for k in (0, 1):
            found = {i: logit(k, i, weights[k]) for i in pool}
            bins = np.linspace(-12, 12, 481)
            high = max(np.log(0.97 / 0.03), min(e for e in bins if sum(c >= e for c in found.values()) <= 0.1 * len(pool) * good or e == 12))
            low = min(-np.log(0.97 / 0.03), max(e for e in bins if sum(c < e for c in found.values()) <= 0.1 * len(pool) * (1 - good) or e == -12))
            sure.append({i: c for i, c in found.items() if c >= high or c <= low})
        weights = [fit(k, weights[k], 3, sure[1 - k]) for k in (0, 1)]
    return weights


def test_fit_by_hand(spark):
    docs = table(spark, SMALL, "documents").where("doc_id < 250")
    labels = table(spark, SMALL, "labels")
    model = quality.fit(docs, labels)
    held = {r.doc_id: r.held for r in docs.selectExpr("doc_id", "pmod(xxhash64(doc_id, 'held'), 5) = 0 as held").collect()}
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    text, page = fitted_by_hand(rows, {r.doc_id: r.quality for r in labels.collect()}, held)
    assert np.abs(model.text - text).max() < 1e-3 and np.abs(model.page - page).max() < 1e-3


def test_a_view_that_is_surely_wrong():
    """One view is certain of what the other calls impossible, of many more rows than have labels: neither runs away."""
    rng = np.random.default_rng(3)
    y = (rng.random(30_000) < 0.85).astype(float)
    one = quality.with_one(np.column_stack([y * 40 + rng.normal(size=30_000), rng.normal(size=30_000)]))
    two = quality.with_one(np.column_stack([y * 40 + rng.normal(size=30_000), rng.normal(size=30_000)]))
    two[600:8000, 1] = 40 - two[600:8000, 1]
    few, pool = slice(0, 600), slice(600, 29_000)
    known = quality.Known((one[few], two[few]), y[few], np.arange(600) % 5 == 0)
    model = quality.co_train(known, lambda f: f((one[pool], two[pool])))
    right = ((model.score(one[29_000:], two[29_000:]) > 0.2) == (y[29_000:] > 0.5)).mean()
    assert right > 0.98 and max(np.abs(model.text).max(), np.abs(model.page).max()) < 30


def test_whole_pool_is_read(spark, monkeypatch):
    """Every unlabelled row adds to every sum."""
    seen = []
    total = quality.pool_total
    monkeypatch.setattr(quality, "pool_total", lambda pool: lambda f: seen.append(total(pool)(f)) or seen[-1])
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    quality.fit(docs, labels)
    unlabelled = docs.join(labels, "doc_id", "left_anti").count()
    assert len(seen) == quality.ROUNDS * (1 + quality.STEPS)
    assert seen[0].sum() == 2 * unlabelled


def test_odd_rows(odd, spark):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.op2_quality(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    assert quality.op2_quality(odd, labels.limit(0)).count() == odd.count()
    assert quality.op2_quality(odd.limit(0), labels).count() == 0
