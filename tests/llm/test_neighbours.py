import numpy as np
from tests.conftest import SMALL

from lodestone.llm import neighbours
from lodestone.llm.queries import QUERIES, table


def found(df, **more):
    return sorted(map(tuple, neighbours.search(df, **more).collect()))


def test_recall_and_exact_scores(spark):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table(spark, SMALL, "embeddings").collect()}
    want = neighbours.brute_force(vectors, 20, 20)
    got = QUERIES["op10_neighbours"](spark, SMALL).collect()
    assert len({(q, v) for q, _, v, _ in want} & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)
    for r in got:
        assert r.score == neighbours.exact_scores(vectors[r.query_id], vectors[r.vec_id][None])[0]
    for q in {r.query_id for r in got}:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21))
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)


def test_clustered_recall(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + 0.3 * rng.normal(size=(6000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = {(q, v) for q, _, v, _ in neighbours.brute_force(dict(enumerate(x.astype(float))), 10, 50)}
    got = {(q, v) for q, _, v, _ in found(df, k=10, every=50)}
    assert len(want & got) >= 0.9 * len(want)


def test_small_blocks_and_few_queries_a_task(spark, monkeypatch):
    """Two levels, leaves parted into several blocks, and queries dealt to several tasks find the same."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(5000, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    want = {(q, v) for q, _, v, _ in neighbours.brute_force(dict(enumerate(x.astype(float))), 10, 25)}
    for name, value in (("LEAF_ROWS", 100), ("WIDEST", 6), ("BLOCK_ROWS", 60), ("ASKED_ROWS", 7), ("CELLS", 5000)):
        monkeypatch.setattr(neighbours, name, value)
    got = found(df, k=10, every=25)
    assert len(want & {(q, v) for q, _, v, _ in got}) >= 0.9 * len(want)
    assert len(got) == 200 * 10


def test_blocks():
    monkey = np.array([10, 3990, 5, 9000, 1, 0, 4000, 4000])
    blocks = neighbours.Blocks.of(monkey)
    assert blocks.first.tolist() == [0, 0, 1, 2, 5, 5, 6, 7] and blocks.parts.tolist() == [1, 1, 1, 3, 1, 1, 1, 1]


def test_leaves_visited_fall_as_vectors_grow(spark):
    rng = np.random.default_rng(6)
    shares = []
    for n in (4_000, 32_000):
        x = rng.normal(size=(n, 16))
        points = neighbours.cut(spark.createDataFrame([(str(i).encode(), v.tolist()) for i, v in enumerate(x)], "same binary, v array<double>"))
        tree = neighbours.tree_of(points, n, 2000, 20, 0.95)
        shares.append(tree.probes / int(tree.first[-1]))
    assert shares[1] < 0.7 * shares[0]


def test_odd_vectors_ties_and_copies(spark):
    rows = [(i, [1.0, 0.5, float(i % 3)]) for i in range(60)]
    rows += [(100 + i, [2.0, 2.0, 2.0]) for i in range(50)]
    rows += [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 2.0]), (260, [float("nan"), 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (300, [1.0, 2.0]), (40, [1.0, 0.5, 1.0]), (400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "'x' as part", "0 as same")
    fine = {i: np.array(v) for i, v in rows[:110]}
    assert found(df, k=7, every=20) == sorted(neighbours.brute_force(fine, 7, 20))
    assert found(df.limit(0), k=7) == []
    assert found(df.where("vec_id in (0, 1, 2)"), k=7) == sorted(neighbours.brute_force({i: fine[i] for i in (0, 1, 2)}, 7, 20))


def test_partitions_are_balanced():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 8))
    label = neighbours.balanced_partitions(x, neighbours.neighbour_graph(x, 8), 6)
    sizes = np.bincount(label, minlength=6)
    assert sizes.max() <= 1.3 * sizes.mean() and sizes.min() > 0
