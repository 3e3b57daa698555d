"""Quality by co-training of two views.

One logistic classifier sees only what a document's text consists of, the other only
what is known about the page: its source, language, length and line layout. In every
round each names the unlabelled documents it is surest of, and the other learns from
them. The calibrated views are then combined by a small logistic model fitted on
labelled documents that neither has seen, and every document is scored.

All unlabelled documents take part in every round. Their views are written once; what a
round needs of them are sums (a histogram of certainty, then the slope and bend of the
likelihood for each step), which the executors add up before the driver gets them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, segments
from .toxicity import fit_logistic, probability

#: Labelled rows that are fitted on at most (by hash, so any are as likely).
MAX_LABELLED = 20_000
#: Rounds and the steps of one, the certainty that a pseudo-label needs, and the share of the pool a view may name.
ROUNDS, STEPS, CERTAIN, SHARE = 3, 3, 0.97, 0.1
#: Weight of all pseudo-labels together against the labels, and of one at most.
TRUST = 0.3
#: Log-odds are counted in so many bins up to this bound on either side; tasks that add sums up.
BOUND, BINS, ADDERS = 12.0, 480, 32
#: What the combination is without labels: a good document, by both views alike.
PRIOR = np.array([2.0, 0.5, 0.5])
#: A document is rejected if it is less likely than this to be good.
THRESHOLD = 0.2

LOWER, UPPER, DIGIT, SPACE, BREAK, MARK, OTHER = range(7)
#: Class of each byte; bytes of characters beyond ASCII count as lower-case letters.
BYTE_CLASS = np.full(256, OTHER, np.int64)
BYTE_CLASS[[*range(97, 123), *range(128, 256)]] = LOWER
BYTE_CLASS[range(65, 91)] = UPPER
BYTE_CLASS[range(48, 58)] = DIGIT
BYTE_CLASS[[32, 9]] = SPACE
BYTE_CLASS[[10, 13]] = BREAK
BYTE_CLASS[[33, 39, 44, 45, 46, 58, 59, 63]] = MARK
SYMBOLS = [b for b in range(33, 127) if not chr(b).isalnum()]
HASHED = 32


def text_view(text: str | None) -> np.ndarray:
    """What a text consists of: its symbols, how kinds of characters follow each other, and repetition."""
    raw = (text or "").encode()
    n = max(1, len(raw))
    data = np.frombuffer(raw, np.uint8)
    kinds = BYTE_CLASS[data]
    symbols = np.bincount(data, minlength=256)[SYMBOLS] / n
    pairs = np.bincount(kinds[:-1] * 7 + kinds[1:], minlength=49) / n if len(raw) > 1 else np.zeros(49)
    words = raw.split()
    m = max(1, len(words))
    distinct = len(set(words)) / m
    triples = len(set(zip(words, words[1:], words[2:], strict=False))) / max(1, len(words) - 2)
    mean = sum(map(len, words)) / m / 10
    return np.concatenate((np.sqrt(symbols), np.sqrt(pairs), [distinct, triples, mean, np.log1p(len(words)) / 10]))


def page_view(text: str | None, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """What is known of a page but its words: where it is from, its language, length and line layout."""
    hashed = np.zeros(HASHED)
    for name in (f"s{source}", f"l{lang}", f"{source}/{lang}"):
        hashed[zlib.crc32(name.encode()) % HASHED] += 1
    lines = (text or "").split("\n")
    lengths = np.array([len(x) for x in lines], float)
    long = np.log1p(max(0, n_chars if n_chars is not None else len(text or "")))
    ended = sum(x.rstrip().endswith((".", "!", "?")) for x in lines) / len(lines)
    repeated = 1 - len(set(lines)) / len(lines)
    layout = [long / 10, (long / 10) ** 2, np.log1p(len(lines)) / 5, np.log1p(lengths.mean()) / 7, np.log1p(lengths.max()) / 10, lengths.std() / (1 + lengths.mean()) / 3, ended, repeated]
    return np.concatenate((hashed, layout))


@dataclass
class Model:
    """Weights of each view (intercept first) and of their combination."""

    text: np.ndarray
    page: np.ndarray
    both: np.ndarray

    def views(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(text)), np.clip(text @ self.text, -12, 12), np.clip(page @ self.page, -12, 12)])

    def score(self, text: np.ndarray, page: np.ndarray) -> np.ndarray:
        return probability(self.views(text, page), self.both)


def with_one(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), x])


@dataclass
class Known:
    """Labelled rows: both views, the labels, and which are held for the combination."""

    views: tuple[np.ndarray, np.ndarray]
    y: np.ndarray
    held: np.ndarray

    def learned(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.views[k][~self.held], self.y[~self.held]


def cutoffs(histogram: np.ndarray, good: float) -> tuple[float, float]:
    """Log-odds from which on a view's good labels, and down to which its bad ones, count: certain, and the surest share only."""
    edges = np.linspace(-BOUND, BOUND, BINS + 1)
    certain, most = np.log(CERTAIN / (1 - CERTAIN)), SHARE * histogram.sum()
    above = np.append(np.cumsum(histogram[::-1])[::-1], 0)
    below = np.append(0, np.cumsum(histogram))
    return max(certain, edges[np.argmax(above <= most * good)]), min(-certain, edges[BINS - np.argmax(below[::-1] <= most * (1 - good))])


def pseudo(logits: np.ndarray, cut_: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows a view is sure of, and their labels."""
    sure = np.flatnonzero((logits >= cut_[0]) | (logits <= cut_[1]))
    return sure, (logits[sure] > 0).astype(float)


def logits_of(view: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(view @ weights, -BOUND, BOUND)


def histograms(views: tuple[np.ndarray, np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.histogram(logits_of(v, w), BINS, (-BOUND, BOUND))[0] for v, w in zip(views, weights, strict=True)]).astype(float)


def slopes(views: tuple[np.ndarray, np.ndarray], teachers: list[np.ndarray], cuts: list[tuple[float, float]], weights: list[np.ndarray]) -> np.ndarray:
    """For each view, of the rows that the other is sure of: their number, the slope and the most it can bend, in a row."""
    out = []
    for k in (0, 1):
        sure, y = pseudo(logits_of(views[1 - k], teachers[1 - k]), cuts[1 - k])
        x = views[k][sure]
        p = probability(x, weights[k])
        out += [[float(len(sure))], x.T @ (y - p), (x.T @ x / 4).ravel()]
    return np.concatenate(out)


def stepped(known: Known, k: int, w: np.ndarray, n: float, slope: np.ndarray, bend: np.ndarray) -> np.ndarray:
    """A step of one view on its labels and the other's pseudo-labels.

    The bend is the most it can be, as if all chances were even. Such a step never
    overshoots, however sure the other view is of what this one calls impossible.
    """
    x, y = known.learned(k)
    penalty = np.ones(len(w))
    penalty[0] = 1e-3
    weight = TRUST * min(1.0, len(y) / n) if n else 0.0
    slope = x.T @ (y - probability(x, w)) + weight * slope - penalty * w
    return w + np.linalg.solve(x.T @ x / 4 + weight * bend + np.diag(penalty), slope)


def co_train(known: Known, total: Callable[[Callable], np.ndarray]) -> Model:
    """Fit both views on labelled rows, let them teach each other, and combine them.

    ``total`` adds up a function of both views over the whole pool. Pseudo-labels keep
    the classes' shares, so that the surer class doesn't crowd out the other. Without
    labels nothing is certain, and the model is its prior.
    """
    weights = [fit_logistic(*known.learned(k)) for k in (0, 1)]
    y = known.learned(0)[1]
    good = (y.sum() + 1) / (len(y) + 2)
    widths_ = [len(w) for w in weights]
    for _ in range(ROUNDS if len(y) else 0):
        teachers = list(weights)
        cuts = [cutoffs(h, good) for h in total(lambda v, w=teachers: histograms(v, w).ravel()).reshape(2, BINS)]
        for _ in range(STEPS):
            sums = total(lambda v, t=teachers, c=cuts, w=weights: slopes(v, t, c, w))
            new, at = [], 0
            for k, m in enumerate(widths_):
                n, slope, bend = sums[at], sums[at + 1 : at + 1 + m], sums[at + 1 + m : at + 1 + m + m * m].reshape(m, m)
                new.append(stepped(known, k, weights[k], n, slope, bend))
                at += 1 + m + m * m
            weights = new
    model = Model(weights[0], weights[1], PRIOR)
    held = known.held
    model.both = fit_logistic(model.views(known.views[0][held], known.views[1][held]), known.y[held], 0.1, prior=PRIOR)
    return model


def labelled_rows(docs: DataFrame, labels: DataFrame, most_labelled: int) -> DataFrame:
    """``text, lang, source, n_chars`` of all rows, with their ``quality`` (null in the pool) and whether they are ``held``."""
    known = labels.selectExpr("cast(doc_id as long) as id", "cast(quality as int) as quality").where("id is not null and quality in (0, 1)")
    known = known.groupBy("id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(most_labelled) if known.count() > most_labelled else known
    rows = docs.selectExpr("cast(doc_id as long) as id", "cast(text as string) as text", "cast(lang as string) as lang", "cast(source as string) as source", "cast(n_chars as long) as n_chars")
    # 16 bytes for each of ``most_labelled`` rows at most.
    return rows.join(F.broadcast(known), "id", "left").selectExpr("text", "lang", "source", "n_chars", "quality", "coalesce(pmod(xxhash64(id, 'held'), 5) = 0, false) as held")


def both_views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    texts = batch.column("text").to_pylist()
    rest = (batch.column(c).to_pylist() for c in ("lang", "source", "n_chars"))
    text = np.array([text_view(t) for t in texts])
    page = np.array([page_view(*r) for r in zip(texts, *rest, strict=True)])
    return with_one(text), with_one(page)


WIDTHS = len(text_view("")) + 1, len(page_view("", None, None, None)) + 1


def unpacked(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).reshape(-1, w).astype(np.float64) for c, w in zip(("text", "page"), WIDTHS, strict=True))


def pool_total(pool: DataFrame) -> Callable[[Callable], np.ndarray]:
    """Adds up a function of both views over a pool: in each task, then in a few, then on the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.frombuffer(raw) for batch in batches for raw in batch.column("sum").to_pylist()]
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([np.sum(sums, axis=0).tobytes()], pa.binary())], ["sum"])

    def total(f: Callable) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = f(tuple(np.empty((0, w)) for w in WIDTHS))
            for batch in batches:
                sums = sums + f(unpacked(batch))
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], ["sum"])

        few = pool.mapInArrow(run, "sum binary").repartition(ADDERS).mapInArrow(added, "sum binary")
        found = [np.frombuffer(bytes(r["sum"])) for r in few.collect()]
        return np.sum(found, axis=0) if found else f(tuple(np.empty((0, w)) for w in WIDTHS))

    return total


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = MAX_LABELLED) -> Model:
    """Learn a model from a bounded sample of labelled rows and from all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in segments(batches):
            packed = [[x.astype(np.float32).tobytes() for x in v] for v in both_views(batch)]
            yield pa.RecordBatch.from_arrays([*(pa.array(p, pa.binary()) for p in packed), batch.column("quality"), batch.column("held")], ["text", "page", "quality", "held"])

    views = cut(labelled_rows(docs, labels, most_labelled).mapInArrow(run, "text binary, page binary, quality int, held boolean"))
    rows = views.where("quality is not null").toArrow()
    known = Known(unpacked(rows), rows.column("quality").to_numpy().astype(float), rows.column("held").to_numpy().astype(bool))
    return co_train(known, pool_total(views.where("quality is null").select("text", "page")))


SCORED = "double"


def score_column(model: Model, spark: SparkSession) -> Callable:
    """A column function of ``text, lang, source, n_chars`` that gives the combined score."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf(SCORED)
    def score(text: pa.Array, lang: pa.Array, source: pa.Array, n_chars: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([text, lang, source, n_chars], ["text", "lang", "source", "n_chars"])
        parts = [sent.value.score(*both_views(x)) for x in segments(iter([batch]))]
        return pa.array(np.concatenate(parts) if parts else np.empty(0))

    return score


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns, with ``quality_score`` and ``keep``.

    Nulls are values like others: a null text is an empty one, a null source or
    language a source of its own, a null length that of the text. Repeated rows have
    equal scores; an empty table gives no rows; a column of the result's names is
    replaced.
    """
    score = score_column(model, docs.sparkSession)
    arguments = [F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string"), F.col("n_chars").cast("long")]
    scored = docs.withColumn("quality_score", score(*arguments))
    return scored.withColumn("keep", F.col("quality_score") >= THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with their columns, of the documents that aren't rejected."""
    return score_documents(docs, fit(docs, labels)).where("keep").select(*docs.columns)


def op2_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's score and whether it is kept."""
    return score_documents(docs, fit(docs, labels)).select("doc_id", F.col("quality_score").alias("score"), "keep")
