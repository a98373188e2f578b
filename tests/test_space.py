import random

import pytest

from lumenframe.operators import space

POINT = "tag long, x long, y long"


def tree(points, levels, cap):
    """Leaves by adding points one at a time, a full leaf handing its points to its quarters."""
    out = {}

    def put(level, x0, y0, pts):
        if not pts:
            return
        side = 1 << (levels - level)
        if len(pts) <= cap or level == levels:
            out[level, x0, y0, x0 + side, y0 + side] = len(pts)
            return
        h = side // 2
        for dx in (0, h):
            for dy in (0, h):
                put(level + 1, x0 + dx, y0 + dy, [p for p in pts if x0 + dx <= p[1] < x0 + dx + h and y0 + dy <= p[2] < y0 + dy + h])

    put(0, 0, 0, points)
    return out


def some(seed, n, w, h):
    rng = random.Random(seed)
    even = [(i, rng.randrange(w), rng.randrange(h)) for i in range(n)]
    crowd = [(n + i, rng.choice([3, 3, 4, w - 1]), rng.choice([5, h - 1])) for i in range(n // 2)]
    return even + crowd


@pytest.mark.parametrize(("w", "h", "cap"), [(100, 120, 20), (64, 64, 3), (1, 1, 20), (1000, 7, 1)])
def test_leaves(spark, w, h, cap):
    rows = some(4, 150, w, h)
    odd = [(9001, w, 0), (9002, -1, 0), (9003, 0, h), (9004, None, 1)]
    got = space.leaves(spark.createDataFrame(rows + odd, POINT), w, h, cap).collect()
    assert {(r.level, r.x0, r.y0, r.x1, r.y1): r.n for r in got} == tree([p for p in rows if p[1] < w and p[2] < h], space.levels_of(w, h), cap)


def test_nearest_over_a_grid(spark):
    """Every fourth place holds a point; from between them the nearest is at one of four corners."""
    pts = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in range(0, 100, 4) for y in range(0, 120, 4))]
    asked = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in range(0, 100, 3) for y in range(0, 120, 5))]
    got = {r.tag: (r.dist, r.target) for r in space.nearest(spark.createDataFrame(asked, POINT), spark.createDataFrame(pts, POINT), 100, 120).collect()}
    for i, x, y in asked:
        assert got[i] == min(((x - a) ** 2 + (y - b) ** 2, t) for t, a, b in pts)


def test_nearest_visits_few(spark):
    pts, asked = some(1, 900, 500, 400), some(2, 300, 500, 400) + [(7001, -50, 900), (7002, 10**6, 3), (7003, None, 1)]
    got = space.nearest(spark.createDataFrame(asked, POINT), spark.createDataFrame(pts, POINT), 500, 400).collect()
    assert len(got) == len(asked) - 1
    want = {i: min(((x - a) ** 2 + (y - b) ** 2, t) for t, a, b in pts) for i, x, y in asked if x is not None}
    assert {r.tag: (r.dist, r.target) for r in got} == want
    assert sum(r.visited for r in got) < 0.06 * len(pts) * len(got)


def test_nearest_of_none(spark):
    none = spark.createDataFrame([], POINT)
    one = spark.createDataFrame([(1, 2, 3)], POINT)
    assert space.nearest(one, none, 10, 10).count() == 0
    assert space.nearest(none, one, 10, 10).count() == 0
    assert [tuple(r)[:3] for r in space.nearest(one, one, 10, 10).collect()] == [(1, 0, 1)]
