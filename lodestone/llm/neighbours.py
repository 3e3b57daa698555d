"""Approximate nearest neighbours through learned partitions.

A graph of nearest neighbours over a bounded sample of the vectors is cut into balanced
partitions with few cut edges. A small classifier learns the partition from the vector.
Every partition is cut into leaves the same way, from a sample of its own, with a
classifier of its own; the executors do that. So the number of leaves follows the number
of vectors, and a leaf's size doesn't grow until both levels are as wide as allowed. The
two classifiers place every vector in the index and route a query to its most probable
leaves, where inner products rank the vectors exactly. How many leaves a query visits is
set on held-out queries, so that they find ``RECALL`` of their true neighbours among all
vectors; one pass over the vectors finds those.

Equal vectors are indexed once, with no more ids than a result can hold. Leaves are
packed into blocks of bounded size, and a crowded leaf is parted into several, so a block
is searched by one task and a query travels once to each block that it visits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, cut, row_key

#: Vectors that the partitions are learned from at most, those that a partition's leaves are learned from about, and
#: held-out queries (the least by hash each); vectors in a leaf about, and partitions (leaves of one) at most.
SAMPLE, LEAF_SAMPLE, HELD = 8_000, 3_000, 300
LEAF_ROWS, WIDEST = 250, 256
NEIGHBOURS = 12
#: Share of their true neighbours that held-out queries must find.
RECALL = 0.95
#: Vectors of one block, and queries that meet it in one task.
BLOCK_ROWS, ASKED_ROWS = 4_000, 20_000
#: Scores that are held at a time.
CELLS = 4_000_000
SEED = 11


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


@dataclass
class Router:
    """A softmax layer from vectors to partitions."""

    weights: np.ndarray
    bias: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.bias


@dataclass
class Tree:
    """A router to partitions, one for each to its leaves, and how many leaves a query visits."""

    top: Router
    below: list[Router]
    probes: int = 1

    @property
    def first(self) -> np.ndarray:
        """The number of each partition's first leaf, and of all leaves."""
        return np.cumsum([0, *(len(r.bias) for r in self.below)])

    def parts(self, x: np.ndarray) -> np.ndarray:
        return self.top.logits(x).argmax(axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf that holds each vector."""
        part, out, first = self.parts(x), np.zeros(len(x), np.int64), self.first
        for p in np.unique(part).tolist():
            own = np.flatnonzero(part == p)
            out[own] = first[p] + self.below[p].logits(x[own]).argmax(axis=1)
        return out

    def routes(self, x: np.ndarray, most: int) -> np.ndarray:
        """Each vector's most probable leaves, in order."""
        first, out = self.first, []
        most = min(most, int(first[-1]))
        for at in range(0, len(x), max(1, CELLS // int(first[-1]))):
            some = x[at : at + max(1, CELLS // int(first[-1]))]
            above = log_softmax(self.top.logits(some))
            chance = np.concatenate([above[:, [p]] + log_softmax(r.logits(some)) for p, r in enumerate(self.below)], axis=1)
            best = np.argpartition(-chance, most - 1, axis=1)[:, :most] if most < chance.shape[1] else np.tile(np.arange(most), (len(some), 1))
            out.append(np.take_along_axis(best, np.argsort(-np.take_along_axis(chance, best, axis=1), axis=1, kind="stable"), axis=1))
        return np.concatenate(out) if out else np.empty((0, most), np.int64)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of each row's ``k`` largest inner products with others, in blocks."""
    n = len(x)
    k = min(k, n - 1)
    out = np.empty((n, k), np.int32)
    for a in range(0, n, 512):
        dots = x[a : a + 512] @ x.T
        dots[np.arange(len(dots)), np.arange(a, a + len(dots))] = -np.inf
        out[a : a + 512] = np.argpartition(-dots, k - 1, axis=1)[:, :k] if k else out[a : a + 512]
    return out


def balanced_partitions(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A partition for each row: balanced starts by repeated parting, then moves along the graph.

    In every round rows move to the partition that most of their neighbours are in, the
    most eager first, as long as it has room (a twentieth above the mean).
    """
    n = len(x)
    rng = np.random.default_rng(SEED)
    label = np.zeros(n, np.int64)
    todo, made = [(np.arange(n), parts)], 0
    while todo:
        g, share = todo.pop()
        if share == 1:
            label[g] = made
            made += 1
            continue
        axis = x[g].mean(axis=0) + rng.normal(size=x.shape[1]) * 0.01
        centred = x[g] - x[g].mean(axis=0)
        for _ in range(8):  # the main direction, by power iteration
            axis = centred.T @ (centred @ axis)
            axis /= np.linalg.norm(axis) + 1e-12
        order = g[np.argsort(centred @ axis, kind="stable")]
        at = len(g) * (share // 2) // share
        todo += [(order[:at], share // 2), (order[at:], share - share // 2)]
    room = math.ceil(1.05 * n / parts)
    source = np.repeat(np.arange(n), graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((n, parts), np.float32)
        np.add.at(votes, (source, label[graph.ravel()]), 1)
        np.add.at(votes, (graph.ravel(), label[source]), 1)
        gain = votes - votes[np.arange(n), label][:, None]
        want = gain.argmax(axis=1)
        sizes = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain[np.arange(n), want], kind="stable").tolist():
            if gain[i, want[i]] <= 0:
                break
            if sizes[want[i]] < room:
                sizes[label[i]] -= 1
                sizes[want[i]] += 1
                label[i] = want[i]
                moved += 1
        if not moved:
            break
    return label


def train_router(x: np.ndarray, label: np.ndarray, epochs: int = 30) -> Router:
    """Softmax regression by mini-batches with momentum."""
    rng = np.random.default_rng(SEED)
    parts = int(label.max()) + 1 if len(label) else 1
    scale = 1 / max(1e-12, float(np.sqrt((x**2).sum(axis=1).mean()))) if len(x) else 1.0
    w, b = np.zeros((x.shape[1], parts)), np.zeros(parts)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    z = x * scale
    for epoch in range(epochs):
        rate = 2.0 * 0.9**epoch
        for i in np.array_split(rng.permutation(len(z)), max(1, len(z) // 256)):
            s = z[i] @ w + b
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(i)), label[i]] -= 1
            vw = 0.9 * vw - rate * (z[i].T @ p / len(i) + 1e-5 * w)
            vb = 0.9 * vb - rate * p.mean(axis=0)
            w, b = w + vw, b + vb
    return Router(w * scale, b)


def learned(x: np.ndarray, parts: int) -> Router:
    """A router to balanced partitions of a sample's neighbour graph."""
    parts = min(parts, len(x) // 2)
    if parts < 2:
        return Router(np.zeros((x.shape[1] if x.ndim == 2 else 0, 1)), np.zeros(1))
    return train_router(x, balanced_partitions(x, neighbour_graph(x, NEIGHBOURS), parts))


def widths(rows: int) -> tuple[int, int]:
    """Partitions, and leaves in all, for so many vectors."""
    leaves = max(1, rows // LEAF_ROWS)
    return min(WIDEST, leaves if leaves <= 32 else math.isqrt(leaves)), leaves


def exact_scores(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products in double precision, each summed in the same order, so that equal vectors tie."""
    return (vectors.astype(np.float64) * query.astype(np.float64)).sum(axis=1)


def top_of(asked: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries and rows, and scores: each query's nearest ``k`` and all that tie with the last."""
    out = []
    for at in range(0, len(asked), max(1, CELLS // max(1, len(x)))):
        some = asked[at : at + max(1, CELLS // max(1, len(x)))]
        rough = some @ x.T
        if len(x) > k:
            bound = np.partition(rough, len(x) - k, axis=1)[:, [len(x) - k]]
            q, r = np.nonzero(rough >= bound - 1e-9 * np.maximum(1.0, np.abs(bound)))
        else:
            q, r = (i.ravel() for i in np.indices(rough.shape))
        out.append((q + at, r, (x[r] * some[q]).sum(axis=1)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2 + (np.empty(0),)


def best_of(q: np.ndarray, r: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of several such results the nearest ``k`` of each query and all that tie with the last."""
    order = np.lexsort((-score, q))
    q, r, score = q[order], r[order], score[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(q)))
    last = np.repeat(score[start + np.minimum(size, k) - 1], size)
    keep = score >= last
    return q[keep], r[keep], score[keep]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` of the vectors that take part: no null, zero or non-finite ones."""
    rows = vectors.selectExpr(f"cast(`{id_col}` as long) as vec_id", f"cast(`{vector_col}` as array<double>) as v")
    fine = "v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x != 0)"
    return rows.where(f"vec_id is not null and coalesce({fine}, false)")


def as_matrix(column: pa.Array) -> np.ndarray:
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.array(lists.flatten().to_numpy(zero_copy_only=False), np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def tree_of(points: DataFrame, rows: int, sample: int, k: int, recall: float) -> Tree:
    """Partitions from a sample of all vectors, leaves from samples of the partitions; ``probes`` from true neighbours."""
    spark = points.sparkSession
    share = lambda seed, part: F.pmod(F.xxhash64("same", F.lit(seed)), F.lit(1 << 30)) < F.lit(int(min(1.0, part) * (1 << 30)))
    parts, leaves = widths(rows)
    taken = as_matrix(points.orderBy(F.xxhash64("same", F.lit(SEED))).limit(sample).toArrow().column("v"))
    tree = Tree(learned(taken, parts), [])
    parts = len(tree.top.bias)
    dim = tree.top.weights.shape[0]
    tree.below = [Router(np.zeros((dim, 1)), np.zeros(1)) for _ in range(parts)]
    sent = spark.sparkContext.broadcast(tree)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(sent.value.parts(as_matrix(batch.column("v"))).astype(np.int32)), batch.column("v")], ["part", "v"])

    if leaves > parts > 1:
        sizes = {r.part: r.n for r in points.mapInArrow(placed, "part int, v array<double>").groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}

        def leafed(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py()
            router = learned(as_matrix(table.column("v"))[: 2 * LEAF_SAMPLE], max(1, min(WIDEST, round(sizes[part] / LEAF_ROWS))))
            return pa.table({"part": pa.array([part], pa.int32()), "weights": pa.array([router.weights.tobytes()], pa.binary()), "bias": pa.array([router.bias.tobytes()], pa.binary())})

        some = points.where(share(SEED + 1, LEAF_SAMPLE * parts / max(1, rows))).mapInArrow(placed, "part int, v array<double>")
        for r in some.groupBy("part").applyInArrow(leafed, "part int, weights binary, bias binary").collect():
            bias = np.frombuffer(bytes(r.bias))
            tree.below[r.part] = Router(np.frombuffer(bytes(r.weights)).reshape(dim, len(bias)), bias)

    if int(tree.first[-1]) == 1:
        return tree
    held = points.orderBy(F.xxhash64("same", F.lit(SEED + 2))).limit(HELD).toArrow()
    asked, names = as_matrix(held.column("v")), held.column("same").to_pylist()
    sent = spark.sparkContext.broadcast((tree, asked, names))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, queries, own = sent.value
        q, leaf, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for batch in batches:
            x = as_matrix(batch.column("v"))
            if not len(x):
                continue
            i, r, near = top_of(queries, x, k + 1)
            same = batch.column("same").to_pylist()
            other = np.array([own[a] != same[b] for a, b in zip(i.tolist(), r.tolist(), strict=True)], bool)
            i, r, near = i[other], r[other], near[other]
            where = np.zeros(len(x), np.int64)
            where[np.unique(r)] = t.leaves(x[np.unique(r)])
            q, leaf, score = best_of(np.append(q, i), np.append(leaf, where[r]), np.append(score, near), k)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(leaf), pa.array(score)], ["q", "leaf", "score"])

    best = Window.partitionBy("q").orderBy(F.desc("score"))
    true = points.mapInArrow(nearest, "q long, leaf long, score double").withColumn("place", F.rank().over(best)).where(F.col("place") <= k).select("q", "leaf").toArrow()
    place = np.argsort(tree.routes(asked, int(tree.first[-1])), axis=1)
    need = np.sort(place[true.column("q").to_numpy(), true.column("leaf").to_numpy()])
    tree.probes = int(need[min(len(need) - 1, math.ceil(recall * len(need)) - 1)]) + 1 if len(need) else 1
    return tree


@dataclass
class Blocks:
    """Where leaves are searched: their first block, and in how many blocks they lie."""

    first: np.ndarray
    parts: np.ndarray

    @classmethod
    def of(cls, sizes: np.ndarray) -> Blocks:
        parts = np.maximum(1, -(-sizes // BLOCK_ROWS))
        first, block, held = np.zeros(len(sizes), np.int64), 0, 0
        for i, n in enumerate(sizes.tolist()):
            if held and (held + n > BLOCK_ROWS):
                block, held = block + 1, 0
            first[i] = block
            held += n
            if parts[i] > 1:
                block, held = block + int(parts[i]), 0
        return cls(first, parts)


def search(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, recall: float = RECALL
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest rows found for each id divisible by ``every``.

    Nearness is the largest inner product, ties go to the smaller id, a row isn't its
    own neighbour. Null, zero and non-finite vectors and null ids take no part;
    vectors of a length that isn't the commonest take none either; of rows with equal
    ids and vectors one takes part; fewer candidates give fewer rows; an empty table
    gives none. Other columns aren't read.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    width = rows.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").first()
    rows = rows.where(F.size("v") == (width.w if width else 0)).withColumn("same", F.expr(row_key("v")))
    # A result holds k ids, and the query's own may be among a vector's: k + 1 ids of each vector are enough.
    first = Window.partitionBy("same").orderBy("vec_id")
    distinct = cut(rows.dropDuplicates(["vec_id", "same"]).withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1))
    points = distinct.where("nth = 1").select("same", "v")
    tree = tree_of(points, points.count(), sample, k, recall)
    sent = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("same"), batch.column("v"), pa.array(sent.value.leaves(as_matrix(batch.column("v"))))], ["same", "v", "leaf"])

    placed = cut(points.mapInArrow(place, "same binary, v array<double>, leaf long"))
    sizes = np.zeros(int(tree.first[-1]), np.int64)
    for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect():  # a row for each leaf
        sizes[r.leaf] = r.n
    blocks = spark.sparkContext.broadcast(Blocks.of(sizes))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and block, with the leaves that it visits there."""
        b = blocks.value
        for batch in batches:
            if not batch.num_rows:
                continue
            leaves = sent.value.routes(as_matrix(batch.column("v")), sent.value.probes)
            q, leaf = np.repeat(np.arange(len(leaves)), leaves.shape[1]), leaves.ravel()
            many = b.parts[leaf]
            q, leaf = np.repeat(q, many), np.repeat(leaf, many)
            block = b.first[leaf] + np.arange(len(leaf)) - np.repeat(np.cumsum(many) - many, many)
            order = np.lexsort((leaf, block, q))
            q, leaf, block = q[order], leaf[order], block[order]
            start = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (block[1:] != block[:-1])))
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(q)).astype(np.int32)), pa.array(leaf))
            at = pa.array(q[start])
            yield pa.RecordBatch.from_arrays([batch.column("same").take(at), batch.column("v").take(at), pa.array(block[start]), lists], ["same", "v", "block", "leaves"])

    queries = cut(rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("same").alias("own")).distinct())
    # Queries of equal vectors are asked once.
    asked = points.join(queries.select(F.col("own").alias("same")).distinct(), "same", "left_semi").mapInArrow(route, "same binary, v array<double>, block long, leaves array<long>")
    asked = cut(asked)
    chunks = bounded(cut(asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / ASKED_ROWS).cast("int").alias("chunks"))))
    own_of = lambda n: F.pmod(F.xxhash64("same"), F.col(n)).cast("long")
    where = spark.createDataFrame([(i, int(f), int(p)) for i, (f, p) in enumerate(zip(blocks.value.first, blocks.value.parts, strict=True))], "leaf long, first long, parts long")
    index = placed.join(F.broadcast(where), "leaf").withColumn("block", F.col("first") + own_of("parts")).join(chunks, "block")
    index = index.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("block", "chunk", "leaf", "same", "v")
    asked = asked.join(chunks, "block").withColumn("chunk", own_of("chunks").cast("int"))
    asked = asked.select(F.col("block").alias("b"), F.col("chunk").alias("c"), F.col("same").alias("own"), "v", "leaves")

    def ranked(some: pa.Table, indexed: pa.Table) -> pa.Table:
        out = []
        if indexed.num_rows and some.num_rows:
            queries, x, leaf_of = as_matrix(some.column("v")), as_matrix(indexed.column("v")), indexed.column("leaf").to_numpy()
            lists = some.column("leaves").combine_chunks()
            visits = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
            for leaf in np.unique(leaf_of).tolist():
                here, q = np.flatnonzero(leaf_of == leaf), visits[0][visits[1] == leaf]
                if len(q):
                    i, r, score = top_of(queries[q], x[here], k + 1)
                    out.append((q[i], here[r], score))
        q, r, score = best_of(*(np.concatenate(c) for c in zip(*out, strict=True)), k + 1) if out else (np.empty(0, np.int64),) * 2 + (np.empty(0),)
        return pa.table([some.column("own").take(pa.array(q)), indexed.column("same").take(pa.array(r)), pa.array(score)], names=["own", "same", "score"])

    near = asked.groupBy("b", "c").cogroup(index.groupBy("block", "chunk")).applyInArrow(ranked, "own binary, same binary, score double")
    # The nearest k + 1 vectors have the nearest k + 1 rows among their ids, and those have the nearest k that aren't the query.
    best = Window.partitionBy("own").orderBy(F.desc("score"))
    near = near.withColumn("place", F.rank().over(best)).where(F.col("place") <= k + 1)
    answers = near.join(distinct.select("same", "vec_id"), "same")
    answers = answers.withColumn("place", F.row_number().over(best.orderBy(F.desc("score"), "vec_id"))).where(F.col("place") <= k + 1)
    answers = queries.join(answers.select("own", "vec_id", "score"), "own").where("vec_id != query_id")
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    answers = answers.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    return answers.select("query_id", "rank", "vec_id", "score")


def op10_neighbours(vectors: DataFrame) -> DataFrame:
    """The contract's search: 20 nearest for every twentieth id."""
    return search(vectors, 20, 20)


def brute_force(vectors: dict[int, np.ndarray], k: int, every: int) -> list[tuple[int, int, int, float]]:
    """For tests: every query against every row."""
    out = []
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids.tolist()], np.float64).reshape(len(ids), -1)
    for q in ids[ids % every == 0].tolist():
        score = exact_scores(np.asarray(vectors[q], np.float64), x)
        order = [i for i in np.lexsort((ids, -score)).tolist() if ids[i] != q][:k]
        out += [(q, r + 1, int(ids[i]), float(score[i])) for r, i in enumerate(order)]
    return out
