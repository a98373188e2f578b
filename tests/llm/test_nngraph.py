import numpy as np
import pytest

from lumenframe.llm import nngraph


def made(n, dims, seed=7):
    return np.random.default_rng(seed).normal(size=(n, dims)).astype(np.float32)


def listed(x, k):
    d = ((x[:, None].astype(float) - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("n", [1, 2, 15, 100])
def test_graph_of_few_rows_is_complete(n):
    x = made(n, 5)
    near = nngraph.graph(x)
    assert near.shape == (n, 36)
    k = min(20, n - 1)
    want = listed(x, k)
    assert all(set(near[i, :k]) == set(want[i]) and set(near[i, k:20]) <= {n} for i in range(n))
    assert not (near == np.arange(n)[:, None]).any()


def test_rounds_of_descent_learn(monkeypatch):
    monkeypatch.setattr(nngraph, "LEAF", 64)
    x = made(3000, 16)
    want = listed(x, 20)
    share = [np.mean([len(set(a[:20]) & set(b)) / 20 for a, b in zip(nngraph.graph(x, trees=2, rounds=r), want, strict=True)]) for r in (0, 1, 3)]
    assert share[0] < share[1] < share[2] and share[2] > 0.8


def test_lists_keep_the_nearest_once():
    lists = nngraph.Lists(3, 2)
    u, v, d = (np.array(c) for c in ([0, 0, 0, 0, 2], [1, 2, 1, 0, 1], [4.0, 3.0, 4.0, 9.0, 1.0]))
    lists.take(u, v.astype(np.int32), d.astype(np.float32))
    lists.take(np.array([0]), np.array([2], np.int32), np.array([3.0], np.float32))
    assert lists.near.tolist() == [[2, 1], [-1, -1], [1, -1]]
    assert lists.back(2).tolist() == [[-1, -1], [2, 0], [0, -1]]


@pytest.mark.parametrize("step", [1, 32])
def test_a_pool_as_large_as_the_shard_finds_all(monkeypatch, step):
    monkeypatch.setattr(nngraph, "STEP", step)
    x, q = made(600, 12), made(70, 12, 8)
    q[:30] = x[:30]
    own = np.where(np.arange(70) < 30, np.arange(70), 600)
    near = nngraph.graph(x)
    ids, d = nngraph.search(x, near, q, own, 600)
    want = ((q[:, None].astype(float) - x) ** 2).sum(2)
    assert (ids[:, :10] == np.argsort(want, axis=1)[:, :10]).mean() > 0.98
    assert np.allclose(np.take_along_axis(want, ids, 1), d, rtol=1e-4)
    assert all(len(set(i)) == 600 for i in ids.tolist())
    ids, d = nngraph.search(x, near, q, own, 40)
    assert all(len(set(i)) == 40 for i in ids.tolist()) and (np.diff(d, axis=1) >= 0).all()
    assert nngraph.search(x, near, q[:0], own[:0], 40)[0].shape == (0, 40)


def test_a_frame_keeps_most_rows_apart_beside_huge_ones():
    x = np.concatenate([made(500, 8).astype(float), [[1e300] * 8, [-1e300] * 8]]) + 1e6
    y = nngraph.single(x, *nngraph.framed(x))
    assert np.isfinite(y).all() and np.isfinite(nngraph._squares(y)).all()
    assert (listed(y[:500], 5) == listed(made(500, 8), 5)).mean() > 0.98
    same = np.full((5, 3), 2.0)
    assert (nngraph.single(same, *nngraph.framed(same)) == 0).all()


def test_a_frame_keeps_small_rows_apart_among_others():
    x = np.concatenate([made(400, 8), made(400, 8, 8) * 1e-9]).astype(float)
    y = nngraph.single(x, *nngraph.framed(x))
    assert (listed(y[400:] * 1e9, 5) == listed(x[400:] * 1e9, 5)).mean() > 0.98


def test_pools_are_measured_in_double_precision():
    x = 1 + 1e-9 * made(50, 6).astype(float)
    ids = np.array([[3, 50, 7], [49, 0, 50]])
    got = nngraph.measured(x, x[:2], ids)
    assert np.isinf(got[0, 1]) and np.isinf(got[1, 2])
    assert np.allclose([got[0, 0], got[1, 1]], [((x[3] - x[0]) ** 2).sum(), ((x[0] - x[1]) ** 2).sum()], rtol=1e-12, atol=0)
