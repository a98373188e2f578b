"""A graph of near neighbours over the rows of one matrix, and greedy search in it, for the vectors of a shard."""

from __future__ import annotations

import numpy as np

#: Rows of a random-projection leaf, all of which meet; nodes whose neighbourhoods, and queries that, are worked on together.
LEAF, NODES, QUERIES = 2048, 256, 64
#: Entry points that every query of a shard is measured against, and the nodes of its pool that it expands at a time.
ENTRIES, STEP = 4096, 32
MOST = np.float32(1e15)  # its square, summed over a vector, stays finite in single precision


def framed(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Centre and scale that bring most rows near 1, whatever a few rows hold. Rows that lie about the origin stay about it, so small ones keep their digits."""

    def norms(d):
        size = np.abs(d).max(1)
        d = d / np.maximum(size, np.finfo(float).tiny)[:, None]  # no square overflows
        return size * np.sqrt(np.einsum("ij,ij->i", d, d))

    centre = np.median(x, axis=0)
    norm = norms(x - centre)
    if norms(centre[None])[0] < 16 * np.median(norm):
        centre = np.zeros_like(centre)
        norm = norms(x)
    return centre, float(np.median(norm)) or float(norm.max()) or 1.0


def single(x: np.ndarray, centre: np.ndarray, scale: float) -> np.ndarray:
    return np.clip((x - centre) / scale, -MOST, MOST).astype(np.float32)


def _squares(y: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of each matrix in a stack."""
    n = np.einsum("...ij,...ij->...i", y, y)
    return np.maximum(n[..., :, None] + n[..., None, :] - 2 * np.matmul(y, np.swapaxes(y, -1, -2)), 0)


def _places(group: np.ndarray) -> np.ndarray:
    """Each entry's place among the equal ones of a sorted array."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))


def _leaves(x: np.ndarray, size: int, rng: np.random.Generator):
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            yield rows
            continue
        half = len(rows) // 2
        by = np.argpartition(x[rows] @ rng.normal(size=x.shape[1]).astype(np.float32), half)
        todo += [rows[by[:half]], rows[by[half:]]]


class Lists:
    """The ``k`` nearest rows known of each row (``near``, -1 where there are fewer) and their squared distances (``far``), nearest first."""

    def __init__(self, n: int, k: int):
        self.near, self.far = np.full((n, k), -1, np.int32), np.full((n, k), np.inf, np.float32)

    def take(self, u: np.ndarray, v: np.ndarray, d: np.ndarray) -> None:
        """Let rows ``u`` know ``v`` at distances ``d``."""
        k = self.near.shape[1]
        new = ~(self.near[u] == v[:, None]).any(1) & (d < self.far[u, -1])
        _, at = np.unique(u[new].astype(np.int64) * len(self.near) + v[new], return_index=True)
        u, v, d = (a[new][at] for a in (u, v, d))
        if not len(u):
            return
        by = np.lexsort((d, u))
        u, v, d = u[by], v[by], d[by]
        place = _places(u)
        who, row = np.unique(u, return_inverse=True)
        some = place < k
        shape = len(who), int(place[some].max()) + 1
        ids, far = np.full(shape, -1, np.int32), np.full(shape, np.inf, np.float32)
        ids[row[some], place[some]], far[row[some], place[some]] = v[some], d[some]
        ids, far = np.concatenate([self.near[who], ids], 1), np.concatenate([self.far[who], far], 1)
        by = np.argsort(far, axis=1, kind="stable")[:, :k]
        self.near[who], self.far[who] = np.take_along_axis(ids, by, 1), np.take_along_axis(far, by, 1)

    def back(self, most: int, fresh: np.ndarray | None = None) -> np.ndarray:
        """Up to ``most`` rows that have a row in their list, the nearest first, before them those that have got it in the last round."""
        n, k = self.near.shape
        u, v, d = np.repeat(np.arange(n, dtype=np.int32), k), self.near.ravel(), self.far.ravel()
        by = np.lexsort((d, v) if fresh is None else (d, ~fresh.ravel(), v))
        by = by[v[by] >= 0]
        u, v = u[by], v[by]
        place = _places(v)
        some = place < most
        out = np.full((n, most), -1, np.int32)
        out[v[some], place[some]] = u[some]
        return out


def descend(x: np.ndarray, lists: Lists, old: np.ndarray, most: int) -> None:
    """One round of NN-descent: what a row's neighbours, and the rows whose neighbour it is, can learn of each other. Pairs that also met in the last round (whose lists were ``old``) are left out."""
    every = np.arange(len(x), dtype=np.int32)[:, None, None]
    fresh = ~(lists.near[:, :, None] == old[:, None]).any(2)
    back = lists.back(most, fresh)
    members = np.concatenate([lists.near, back], 1)
    fresh = np.concatenate([fresh, ~(old[back] == every).any(2)], 1)
    for lo in range(0, len(x), NODES):
        m, f = members[lo : lo + NODES], fresh[lo : lo + NODES]
        d = _squares(np.take(x, m, axis=0, mode="clip") - x[lo : lo + NODES, None])  # around the row itself, so that close rows keep their digits
        known = np.where(m < 0, np.float32(-1), lists.far[:, -1][m])
        meet = (d < known[:, :, None]) & (m[:, :, None] != m[:, None]) & (m >= 0)[:, None] & (f[:, :, None] | f[:, None])
        b, i, j = np.nonzero(meet)
        lists.take(m[b, i], m[b, j], d[b, i, j])


def graph(x: np.ndarray, k: int = 20, trees: int = 4, rounds: int = 2) -> np.ndarray:
    """For each row the ``k`` nearest rows found and up to ``k - 4`` rows that have it among theirs; the number of rows where there are fewer."""
    n, rng = len(x), np.random.default_rng(17)
    lists, size = Lists(n, k), max(4 * k, min(LEAF, n // 8))
    for _ in range(trees):
        for rows in _leaves(x, size, rng):
            d = _squares(x[rows] - x[rows].mean(0))
            np.fill_diagonal(d, np.inf)
            m = min(k, len(rows) - 1)
            if m < 1:
                continue
            at = np.argpartition(d, m - 1, axis=1)[:, :m]
            d = np.take_along_axis(d, at, 1)
            i, j = np.nonzero(d < lists.far[rows, -1][:, None])
            lists.take(rows[i].astype(np.int32), rows[at[i, j]].astype(np.int32), d[i, j])
    old = np.full_like(lists.near, -2)
    for _ in range(rounds):
        before = lists.near.copy()
        descend(x, lists, old, k - 4)
        old = before
    out = np.concatenate([lists.near, lists.back(k - 4)], 1)
    return np.where(out < 0, n, out).astype(np.int32)


def search(x: np.ndarray, near: np.ndarray, q: np.ndarray, own: np.ndarray, pool: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and squared distances of the pool of each query, nearest first; the number of rows where a pool is not full.

    A query starts from its own row (``own``; the number of rows if it has none) and the nearest of some entry points. It expands its
    nearest nodes until all of its pool are expanded; a pool only gets nearer, so every query ends.
    """
    n = len(x)
    entry = np.sort(np.random.default_rng(18).choice(n, min(n, ENTRIES, max(256, n // 8)), replace=False))
    own = np.where(np.isin(own, entry), n, own)
    out = [(np.zeros((0, pool), np.int64), np.zeros((0, pool), np.float32))]
    for lo in range(0, len(q), QUERIES):
        p = q[lo : lo + QUERIES]
        every = np.arange(len(p))
        seen, mark = np.zeros((len(p), n + 1), bool), np.zeros(len(p) * (n + 1), np.int32)
        seen[:, entry] = seen[:, n] = seen[every, own[lo : lo + QUERIES]] = True
        flat = seen.reshape(-1)

        def best(ids, dist, some):
            by = np.argsort(dist, axis=1, kind="stable")[:, :pool]
            return [np.take_along_axis(a, by, 1) for a in (ids, dist, some)]

        def gap(row, v, p=p):
            y = np.take(x, v, axis=0)
            y -= np.take(p, row, axis=0)
            return np.einsum("ij,ij->i", y, y)

        c = x[entry].mean(0)
        y, z = x[entry] - c, p - c
        d = np.einsum("ij,ij->i", y, y) - 2 * (z @ y.T)
        w = min(pool, len(entry))
        ids = entry[np.argpartition(d, w - 1, axis=1)[:, :w]]
        ids = np.concatenate([ids, own[lo : lo + QUERIES, None], np.full((len(p), max(0, pool - w)), n)], 1)
        dist = np.full(ids.shape, np.inf, np.float32)
        row, col = np.nonzero(ids < n)
        dist[row, col] = gap(row, ids[row, col])
        ids, dist, ahead = best(ids, dist, ids < n)
        while ahead.any():
            row, col = np.nonzero(ahead & (np.cumsum(ahead, axis=1) <= STEP))
            ahead[row, col] = False
            key = (row[:, None] * (n + 1) + near[ids[row, col]]).ravel()
            key = key[~flat[key]]
            mark[key] = np.arange(len(key))
            key = key[mark[key] == np.arange(len(key))]  # one of those that name the same node
            flat[key] = True
            row, v = np.divmod(key, n + 1)
            d = gap(row, v)
            some = d < dist[row, -1]
            row, v, d = row[some], v[some], d[some]
            if not len(row):
                continue
            by = np.argsort(row, kind="stable")
            row, v, d = row[by], v[by], d[by]
            place = _places(row)
            more, gaps = np.full((len(p), place.max() + 1), n), np.full((len(p), place.max() + 1), np.inf, np.float32)
            more[row, place], gaps[row, place] = v, d
            ids, dist, ahead = best(*(np.concatenate(c, 1) for c in ((ids, more), (dist, gaps), (ahead, more < n))))
        out.append((ids, dist))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def measured(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances from each query to the rows ``ids`` of its pool, in the precision of ``x``; infinite for the number of rows."""
    out = np.full(ids.shape, np.inf)
    step = max(1, (1 << 21) // max(1, ids.shape[1] * x.shape[1]))
    for lo in range(0, len(q), step):
        y = np.take(x, ids[lo : lo + step], axis=0, mode="clip")
        y -= q[lo : lo + step, None]
        out[lo : lo + step] = np.einsum("ijk,ijk->ij", y, y)
    return np.where(ids < len(x), out, np.inf)
