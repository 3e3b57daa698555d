"""Toxicity by maximum-scoring segments.

Words get log-odds between toxic and other labelled documents, smoothed by a Dirichlet
prior whose shape is the corpus' own word distribution. A word scores its log-odds less
a drift if the difference is significant, and minus the drift otherwise. A linear scan
over a document's scores finds all maximal-scoring segments. How surprising they are
follows from extreme-value statistics of such scores in documents that aren't toxic;
the segments' joint surprise is calibrated to a probability on the labelled documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, segments, text_hashes
from .decontaminate import words_of

#: Labelled rows that the model is fitted on at most (by hash, so any are as likely); all are used if fewer.
MAX_LABELLED = 200_000
#: Toxic documents that must hold a word before it can score.
LEAST_DOCUMENTS = 3
#: Weight of the prior against the toxic documents' words, what each word costs, and the steps in which scores are counted.
PRIOR_SHARE, DRIFT, STEP = 0.1, 1.0, 0.25
HIGHEST = 10.0
THRESHOLD = 0.3
#: Bytes of text whose words are counted together; documents without evidence that count for the level of chance scores.
WORDS_BYTES, PRIOR_GAPS = 1 << 20, 1
#: Weights of the calibration before any labelled row is seen.
PRIOR_WEIGHTS = np.array([-4.0, 0.0, 0.0, 0.0])
EULER = 0.5772156649


@dataclass
class Model:
    """What scoring needs: word scores, the extreme-value parameters and the calibration."""

    scores: dict[bytes, float]
    rate: float
    log_k: float
    weights: np.ndarray


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments ``(from, to, score)`` in order, in linear time.

    Sums of positive runs are put on a list with, for each, the nearest entry before
    whose left sum is smaller; a run that overtakes that entry's right sum is joined
    with it and all between.
    """
    sums = np.concatenate(([0.0], np.cumsum(scores)))
    rises = np.flatnonzero(np.diff(np.concatenate(([0], (scores > 0).astype(np.int8), [0]))))
    found: list[tuple[int, int, float, float]] = []
    before: list[int] = []
    for a, b in rises.reshape(-1, 2).tolist():
        left, right = sums[a], sums[b]
        at = len(found) - 1
        while True:
            while at >= 0 and found[at][2] >= left:
                at = before[at]
            if at < 0 or found[at][3] >= right:
                break
            a, left = found[at][0], found[at][2]
            at, keep = before[at], at
            del found[keep:], before[keep:]
        found.append((a, b, left, right))
        before.append(at)
    return [(a, b, float(r - s)) for a, b, s, r in found]


def word_scores(words: list[bytes], scores: dict[bytes, float]) -> np.ndarray:
    get = scores.get
    return np.fromiter((get(w, -DRIFT) for w in words), np.float64, len(words))


def surprises(found: list[tuple[int, int, float]], n: int, model: Model) -> np.ndarray:
    """Normalised scores, highest first: minus the log of the segments expected by chance that score so."""
    s = np.sort([x[2] for x in found])[::-1] if found else np.empty(0)
    return model.rate * s - model.log_k - math.log(max(n, 1))


def joint_surprise(norm: np.ndarray) -> float:
    """Minus the log of the least chance of the best r segments' sum, over r (1 at no segment)."""
    best, total = 0.0, 0.0
    for r, x in enumerate(norm.tolist(), 1):
        if x <= 0 and r > 1:
            break
        total += x
        if total > 0:
            if r > 1:
                log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
            else:  # the chance of one such segment or more; minus the total where that is the same
                log_p = -total if total > 30 else math.log(-math.expm1(-math.exp(-total)))
            best = max(best, -log_p - r * math.log(2) + math.log(2))
    return best


def probability(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, sample: np.ndarray | None = None, prior: np.ndarray | None = None) -> np.ndarray:
    """Penalised logistic regression by Newton steps; the first column is the intercept.

    Weights are drawn towards ``prior`` (zeros if none), which is what no rows give.
    """
    prior = np.zeros(x.shape[1]) if prior is None else prior
    w = prior.copy()
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    weight = np.ones(len(y)) if sample is None else sample
    for _ in range(25):
        p = probability(x, w)
        hessian = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - penalty * (w - prior))
        w = w + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def log_odds(n: np.ndarray, background: np.ndarray, totals: tuple[float, float, float]) -> np.ndarray:
    """Log-odds of words (rows of toxic and other counts) under a Dirichlet prior shaped by the corpus."""
    all_toxic, all_other, all_words = totals
    weight = max(1.0, PRIOR_SHARE * all_toxic)
    prior = weight * (background + 0.5) / (all_words + 1)
    rate = lambda c, of: np.log((c + prior) / (of + weight - c - prior))
    return rate(n[:, 0], all_toxic) - rate(n[:, 1], all_other)


def signed_root(toxic: int, other: int) -> Column:
    """Signed root of the likelihood ratio of the columns ``d1`` and ``d0``, document counts among ``toxic`` and ``other``."""
    both = max(1, toxic + other)

    def clipped(x: Column) -> Column:
        return F.least(F.greatest(x, F.lit(1e-12)), F.lit(1 - 1e-12))

    share = clipped((F.col("d1") + F.col("d0")) / both)

    def part(k: Column, n: int) -> Column:
        p = clipped(k / max(1, n))
        return k * F.log(p / share) + (n - k) * F.log((1 - p) / (1 - share))

    ratio = 2 * (part(F.col("d1"), toxic) + part(F.col("d0"), other))
    return F.signum(F.col("d1") / max(1, toxic) - share) * F.sqrt(F.greatest(F.lit(0.0), ratio))


def extreme_rate(counts: dict[float, int]) -> float:
    """The positive root of E[exp(rate * score)] = 1 over scores of documents that aren't toxic."""
    s = np.array(sorted(counts))
    p = np.array([counts[x] for x in s.tolist()], float)
    if not len(s) or s.max() <= 0 or (s * p).sum() >= 0:
        return 1.0
    p /= p.sum()
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (low, mid)
    return low


def labelled(labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """``id, toxic`` of the rows that labels are learned from: one for each id, no null."""
    known = labels.selectExpr("cast(doc_id as long) as id", "cast(toxic as int) as toxic").where("id is not null and toxic in (0, 1)")
    known = known.where("pmod(crc32(cast(cast(id as string) as binary)), 4) != 2").groupBy("id").agg(F.max("toxic").alias("toxic"))
    return known.orderBy(F.xxhash64("id"), "id").limit(most) if known.count() > most else known


def document_words(texts: DataFrame) -> DataFrame:
    """``word, toxic, n``: a row for each word of each document, and one of no word for all its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches, limit=WORDS_BYTES):
            words: list[bytes | None] = []
            counts: list[int] = []
            rows = []
            for text in batch.column("text").to_pylist():
                found = words_of(text)
                seen = Counter(found)
                words += [None, *seen]
                counts += [len(found), *seen.values()]
                rows.append(len(seen) + 1)
            toxic = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False), rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(toxic), pa.array(counts, pa.int64())], ["word", "toxic", "n"])

    return texts.mapInArrow(run, "word binary, toxic int, n long")


def telling_words(texts: DataFrame) -> tuple[dict[bytes, tuple[int, int]], tuple[int, int]]:
    """Words that toxic documents hold more often than chance gives, with their (other, toxic) counts; and all words' counts.

    Words are counted and judged where they are; only those that pass come to the driver.
    """
    by = {name: F.sum(F.when(F.col("toxic") == k, x)) for k in (0, 1) for name, x in ((f"c{k}", F.col("n")), (f"d{k}", F.lit(1)))}
    counts = document_words(texts).groupBy("word").agg(*(F.coalesce(x, F.lit(0)).alias(name) for name, x in by.items()))
    counts = cut(counts.where(F.col("word").isNull() | (F.col("d1") >= LEAST_DOCUMENTS)))
    whole = counts.where("word is null").first()
    if whole is None:
        return {}, (0, 0)
    # The largest root that so many words reach by chance alone.
    least_root = math.sqrt(2 * math.log(max(2, counts.count() - 1)))
    found = counts.where("word is not null").where(signed_root(whole.d1, whole.d0) >= least_root).select("word", "c0", "c1")
    return {bytes(r.word): (r.c0, r.c1) for r in found.collect()}, (whole.c0, whole.c1)


def background(rows: DataFrame, words: list[bytes]) -> tuple[np.ndarray, int]:
    """How often the whole corpus has each word, and how many words it has; a row for each word of a segment travels."""
    number = rows.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = number.value
        for batch in segments(batches):
            count = np.zeros(len(known) + 1, np.int64)
            for text in batch.column("text").to_pylist():
                found = words_of(text)
                count[-1] += len(found)
                for w in found:
                    if w in known:
                        count[known[w]] += 1
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["word", "n"])

    count = np.zeros(len(words) + 1)
    for r in rows.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        count[r.word] = r.n
    return count[:-1], int(count[-1])


def segment_scores(texts: DataFrame, scores: dict[bytes, float]) -> DataFrame:
    """``n, s, toxic``: words of each document, and the scores of its maximal segments."""
    sent = texts.sparkSession.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches):
            out = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                out.append((len(words), [x[2] for x in maximal_segments(word_scores(words, sent.value))] if words else []))
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.float64())), batch.column("toxic")], ["n", "s", "toxic"]
            )

    return texts.mapInArrow(run, "n long, s array<double>, toxic int")


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn a model; what comes to the driver is its words and five numbers for each of ``most`` labelled rows at most."""
    spark = docs.sparkSession
    rows = docs.selectExpr(f"cast(`{id_col}` as long) as id", f"cast(`{text_col}` as string) as text")
    # Of equal texts one is learned from, else a copied document's own words would look toxic.
    copies = rows.select("id", *text_hashes("text")).join(F.broadcast(labelled(labels, most)), "id")
    train = copies.groupBy("h1", "h2").agg(F.min(F.struct("id", "toxic")).alias("x")).select("x.id", "x.toxic").distinct()
    train = F.broadcast(cut(train))  # 16 bytes for each of ``most`` rows at most, as is the broadcast before
    texts = rows.join(train, "id").select("text", "toxic")

    found, (all_other, all_toxic) = telling_words(texts)
    words = sorted(found)
    counts = np.array([found[w] for w in words], float).reshape(-1, 2)[:, ::-1]
    everywhere, all_words = background(rows, words)
    odds = log_odds(counts, everywhere, (all_toxic, all_other, all_words))
    scores = {w: float(min(odds[i], HIGHEST) - DRIFT) for i, w in enumerate(words) if odds[i] > DRIFT}

    # Scores of words in documents that aren't toxic; the same counts give them.
    null: Counter = Counter()
    for w, s in scores.items():
        if found[w][0]:
            null[round(s / STEP) * STEP] += found[w][0]
    null[-DRIFT] = all_other - sum(null.values())
    model = Model(scores, extreme_rate(null), 0.0, PRIOR_WEIGHTS)

    measured = cut(segment_scores(texts, scores))
    gap = F.lit(model.rate) * F.array_max("s") - F.log(F.greatest(F.col("n"), F.lit(1))) - EULER
    clean = measured.where((F.col("toxic") == 0) & (F.size("s") > 0)).agg(F.sum(gap).alias("gaps"), F.count(F.lit(1)).alias("n")).first()
    model.log_k = (clean.gaps or 0.0) / (clean.n + PRIOR_GAPS)
    sent = spark.sparkContext.broadcast(model)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [row_features(n, s, sent.value) for n, s in zip(batch.column("n").to_pylist(), batch.column("s").to_pylist(), strict=True)]
            columns = np.array(x).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in columns), batch.column("toxic")], ["x0", "x1", "x2", "x3", "toxic"])

    table = measured.mapInArrow(featured, "x0 double, x1 double, x2 double, x3 double, toxic int").toArrow()
    x = np.column_stack([table.column(f"x{i}").to_numpy() for i in range(4)])
    order = np.lexsort(x.T)  # sums don't depend on which task was first
    y = table.column("toxic").to_numpy().astype(float)
    model.weights = fit_logistic(x[order], y[order], prior=PRIOR_WEIGHTS)
    return model


def row_features(n: int, scores: list[float], model: Model) -> list[float]:
    """The features of a document of ``n`` words whose segments score so."""
    total = sum(scores)
    norm = surprises([(0, 0, s) for s in scores], n, model)
    return [1.0, math.log1p(joint_surprise(norm)), math.log1p(total), math.log1p(100 * total / (n + 20))]


SCORED = "doc_id long, score double, passages array<struct<start:long,end:long,score:double>>"


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score, passages`` of every row; passages are word ranges, in order.

    The score needs the text alone. A null, empty or wordless text has the score of
    no evidence; repeated rows repeat; null ids stay null; an empty table gives no
    rows. Other columns aren't read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in segments(batches):
            rows, passages = [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                found = maximal_segments(word_scores(words, m.scores)) if words else []
                rows.append(row_features(len(words), [x[2] for x in found], m))
                level = (m.log_k + math.log(max(len(words), 1))) / m.rate
                passages.append([{"start": a, "end": b, "score": s} for a, b, s in found if s > level])
            scores = probability(np.array(rows).reshape(-1, 4), m.weights)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array(passages, kind)], ["doc_id", "score", "passages"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    return rows.mapInArrow(run, SCORED)


def op4_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's digest of :func:`score_documents`."""
    return score_documents(docs, fit(docs, labels)).selectExpr(
        "doc_id",
        "coalesce(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2, false) as held_out",
        "score",
        f"if(score >= {THRESHOLD}, 1, 0) as predicted",
        "passages",
    )
