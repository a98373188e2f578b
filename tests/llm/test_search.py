import math

import numpy as np
import pytest

from lumenframe.llm import neighbours, topk
from lumenframe.llm.common import Workspace

EMB = "vec_id long, embedding array<float>, label int, v string, id int"


def write(spark, path, rows):
    spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], EMB).repartition(3).write.parquet(f"{path}/embeddings.parquet")


def vectors(n, dims=8, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype("float32")
    x[n // 2 : n // 2 + n // 4] = x[0]  # a vector that a quarter of the rows hold
    return [(i, x[i].tolist()) for i in range(n)]


ODD = [(None, [1.0] * 8), (5000, None), (5020, [float("nan")] + [0.0] * 7), (5040, [float("inf")] + [0.0] * 7), (5060, [None] + [1.0] * 7), (5100, []), (5120, [1.0] * 3)]


def test_top_k_is_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "LEAF", 8)
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    rows = vectors(500)
    write(spark, tmp_path, rows + ODD + [rows[40]])
    got = {}
    for r in topk.op3(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = np.floor(64 * np.array([v for _, v in rows], float)).astype(int)
    assert set(got) == {i for i, _ in rows if i % 20 == 0}
    for q, found in got.items():
        s = x @ x[q]
        want = sorted((int(-s[i]), i) for i in range(len(rows)) if i != q)[:20]
        assert sorted(found) == [(n + 1, i, -v) for n, (v, i) in enumerate(want)]


def test_clustered_vectors_are_pruned(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 256)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(24, 12)) * 40
    x = np.floor(centres[rng.integers(0, 24, 4000)] + rng.normal(size=(4000, 12)) * 4)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    tally = []
    got = {}
    for r in topk.top_k(rows, rows.where("id % 40 = 0"), Workspace(spark, "t"), 5, tally).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 4000, 40):
        s = x @ x[q]
        want = sorted((-int(s[i]), i) for i in range(4000) if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -v) for n, (v, i) in enumerate(want)]
    assert sum(tally) < 0.5 * 100 * 4000


class Counted(np.ndarray):
    """Rows of a tree that count the products they take part in."""

    products = 0

    def __rmatmul__(self, other):
        Counted.products += 1
        return other @ self.view(np.ndarray)


@pytest.mark.parametrize(("most", "kind"), [(60, np.float32), (1 << 20, np.float64)])
def test_queries_at_a_leaf_share_a_product(monkeypatch, most, kind):
    monkeypatch.setattr(topk, "LEAF", 16)
    monkeypatch.setattr(topk, "HELD", 500)
    rng = np.random.default_rng(17)
    x = rng.integers(-most, most, (512, 6)).astype(float)
    ends = np.concatenate([[0], np.cumsum(rng.integers(1, 5, 512))])
    ids = rng.permutation(ends[-1])
    q = np.concatenate([x[:200], x[:200] // 3, np.zeros((1, 6))])
    own, floor = np.append(ids[ends[:200]], [-1] * 201), np.where(np.arange(401) % 7, -np.inf, 0.0)
    tree, used = topk.BallTree(x), []
    monkeypatch.setattr(tree, "rows", lambda k, rows=tree.rows: used.append(k) or rows(k).view(Counted))
    Counted.products = 0
    (row, v, score), scored = tree.search(q, 9, ids, ends, own, floor)
    assert used == [kind]
    assert 0 < Counted.products <= 32 * 6  # leaves and rounds, however many queries
    assert scored <= 401 * 512
    for i in range(401):
        s = np.repeat(x @ q[i], np.diff(ends))
        want = sorted((-int(a), int(b)) for a, b in zip(s, ids, strict=True) if b != own[i] and a >= floor[i])[:9]
        assert sorted((-int(a), int(b)) for a, b in zip(score[row == i], v[row == i], strict=True)) == want


def test_top_k_of_few_and_none(spark, tmp_path):
    write(spark, tmp_path / "a", vectors(3))
    assert sorted((r.query_id, r.rank) for r in topk.op3(spark, str(tmp_path / "a")).collect()) == [(0, 1), (0, 2)]
    write(spark, tmp_path / "b", [])
    assert topk.op3(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("n", [5, 40, 900])
def test_neighbours_recall(spark, tmp_path, n):
    rows = vectors(n)
    write(spark, tmp_path, rows + ODD + [(6000, [0.0] * 8), rows[0]])
    got = {}
    for r in neighbours.op9(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    x = np.array([v for _, v in rows], float)
    recall = []
    assert set(got) == {i for i, _ in rows if i % 100 == 0}
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(n) if i != q)[:10]
        assert [f[0] for f in sorted(found)] == list(range(1, len(want) + 1))
        assert all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in found)
        recall.append(len({i for _, i, _ in found} & {i for _, i in want}) / len(want))
    assert np.mean(recall) >= 0.9


@pytest.mark.parametrize(("dims", "pool"), [(8, 60), (24, 20)])
def test_recall_of_the_graph_search_beyond_its_pool(spark, dims, pool):
    x = np.random.default_rng(11).normal(size=(3000, dims)).astype("float32").astype(float)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    got = {}
    for r in neighbours.nearest(rows, rows.where("id % 60 = 0"), Workspace(spark, "t"), 10, pool=pool).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = [len(got[q] & {i for _, i in sorted((((x[i] - x[q]) ** 2).sum(), i) for i in range(3000) if i != q)[:10]}) for q in range(0, 3000, 60)]
    assert np.mean(hits) >= 9


def shuffled(spark):
    """Bytes that this session's shuffles have written so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    return sum(e.totalShuffleWrite() for e in [sc.statusStore().executorList(False).apply(0)])


@pytest.mark.parametrize("clustered", [False, True])
def test_neighbours_search_moves_bounded_bytes(spark, monkeypatch, clustered):
    monkeypatch.setattr(neighbours, "SHARD_ROWS", 512, raising=False)
    n, dims = 6000, 24
    rng = np.random.default_rng(23)
    x = rng.normal(size=(n, dims))
    if clustered:
        x = rng.normal(size=(30, dims))[rng.integers(0, 30, n)] * 40 + x
    x[n // 2 : n // 2 + 40] = x[100]  # copies, more than are listed
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    before, got = shuffled(spark), {}
    for r in neighbours.nearest(rows, rows.where("id % 100 = 0"), Workspace(spark, "t"), 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert shuffled(spark) - before < 12 * n * dims * 8  # NN-descent over the whole table sent every vector to every neighbourhood, round by round
    assert set(got) == set(range(0, n, 100))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(n) if i != q)[:10]
        found = sorted(found)
        assert [r for r, _, _ in found] == list(range(1, 11))
        assert all(s == pytest.approx(d[i], abs=1e-9) for _, i, s in found)
        assert [(s, i) for _, i, s in found] == sorted((s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want})
    assert hits >= 0.9 * 10 * len(got)
    assert [i for _, i, _ in sorted(got[100])] == list(range(n // 2, n // 2 + 10))


def test_neighbours_of_nothing(spark, tmp_path):
    write(spark, tmp_path, ODD)
    assert neighbours.op9(spark, str(tmp_path)).count() == 0


def mixed():
    """Vectors of 8, and among them longer and shorter ones, second vectors of an id, and huge ones."""
    rows = vectors(500)
    rows += [(6000, [1.0] * 9), (6001, [2.0] * 9), (7000, [0.5, 1.0]), (7001, [1.0, 1.0])]
    rows += [(100, [3.0, -2.0] * 4), (301, [1.5] * 8), (8000, [1e9] + [1.0] * 7), (8001, [-1e9] + [2.0] * 7), (8100, [1e25] * 8), (8101, [9e24] * 8)]
    return [(i, np.array(v, "float32").tolist()) for i, v in rows]


def test_top_k_of_every_size_and_magnitude(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 100)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 7)
    rows = mixed()
    write(spark, tmp_path, rows)
    got = {}
    for r in topk.op3(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    asked = {i for i, _ in rows if i % 20 == 0}
    assert set(got) == asked
    top = 2**63 - 1
    for q in asked:
        found = [(-sum(a * b for a, b in zip(v, w, strict=True)), j) for i, v in whole if i == q for j, w in whole if j != q and len(v) == len(w)]
        assert sorted(got[q]) == [(n + 1, j, max(-top, min(top, -s))) for n, (s, j) in enumerate(sorted(found)[:20])]


def test_neighbours_of_every_size(spark, tmp_path):
    rows = [(i, v) for i, v in mixed() if i < 8000]
    write(spark, tmp_path, rows)
    got = {}
    for r in neighbours.op9(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in {i for i, _ in rows if i % 100 == 0}:
        want = sorted((math.dist(v, w), j) for i, v in rows if i == q for j, w in rows if j != q and len(v) == len(w))[:10]
        assert [n for n, _, _ in sorted(got[q])] == list(range(1, len(want) + 1))
        hits, total = hits + len({j for _, j in want} & {j for _, j, _ in got[q]}), total + len({j for _, j in want})
    assert hits / total >= 0.9


def test_neighbours_beside_huge_vectors(spark, tmp_path):
    rows = vectors(900) + [(9000, [1e9] * 8), (9001, [-2e9] * 8)]
    write(spark, tmp_path, rows)
    got = {}
    for r in neighbours.op9(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for q in range(100, 900, 100):
        want = sorted((math.dist(rows[q][1], w), j) for j, w in rows if j != q)[:10]
        recall.append(len({j for _, j in want} & got[q]) / 10)
    assert np.mean(recall) >= 0.9
