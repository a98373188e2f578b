"""Maps that balance histograms, against plain Python."""

import random

import pytest

from lumenframe.operators.series import balanced


def plain(counts):
    upto = [sum(counts[:i]) for i in range(257)]
    found, todo = {}, [(0, 256, 0, 256)]
    for lo, hi, a, b in todo:
        if lo < hi and a < b:
            left, right, half = a, b, (upto[a] + upto[b - 1]) / 2
            while left < right:
                m = (left + right) // 2
                left, right = (m + 1, right) if upto[m] < half else (left, m - 1)
            mid = (lo + hi) // 2
            found[mid] = left
            todo += [(lo, mid - 1, a, left - 1), (mid + 1, hi, left + 1, b)]
    return found


def lines(known):
    known = {0: 0, 255: 255} | known
    at = sorted(known)
    out = [known[i] + (known[j] - known[i]) * (k - i) / (j - i) for i, j in zip(at, at[1:]) for k in range(i, j)]
    return [*out, known[255]]


def rows_of(spark, cases):
    rows = [(k, i, n) for k, counts in cases.items() for i, n in enumerate(counts) if n]
    df = spark.createDataFrame(rows, "k string, level int, n long")
    got = {}
    for r in balanced(df, "k").collect():
        got.setdefault(r.k, {})[r.level] = (r.mapped, r.inverse)
    return got


def test_maps_equal_plain_splits(spark):
    rng = random.Random(5)
    one = [0] * 256
    one[200] = 1_000_000
    cases = {
        "even": [7] * 256,
        "rising": [i * i + 1 for i in range(256)],
        "noise": [rng.randrange(1000) for _ in range(256)],
        "sparse": [rng.randrange(1, 9) if rng.random() < 0.05 else 0 for _ in range(256)],
        "one": one,
        "hot": [10**12 if i == 3 else 1 for i in range(256)],
    }
    got = rows_of(spark, cases)
    assert set(got) == set(cases)
    for k, counts in cases.items():
        mapped = lines(plain(counts))
        back = lines({int(v): i for i, v in enumerate(mapped)})
        assert [got[k][i][0] for i in range(256)] == pytest.approx(mapped)
        assert [got[k][i][1] for i in range(256)] == pytest.approx(back)


def test_nulls_repeats_and_empty_tables(spark):
    schema = "k string, level int, n long, extra int"
    rows = [(None, 5, 2, 1), (None, 5, 3, 1), (None, None, 9, 1), (None, 9, None, 1), ("a", None, None, 1)]
    got = balanced(spark.createDataFrame(rows, schema), "k")
    assert got.columns == ["k", "level", "mapped", "inverse"]
    by = {}
    for r in got.collect():
        by.setdefault(r.k, {})[r.level] = r.mapped
    five = [0] * 256
    five[5] = 5
    assert [by[None][i] for i in range(256)] == pytest.approx(lines(plain(five)))
    assert [by["a"][i] for i in range(256)] == pytest.approx(lines(plain([0] * 256)))
    assert balanced(spark.createDataFrame([], schema), "k").count() == 0
    with pytest.raises(Exception, match="out of range"):
        balanced(spark.createDataFrame([("a", 256, 1, 1)], schema), "k").collect()
