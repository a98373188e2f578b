import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest

from lumenframe.llm import codes
from lumenframe.llm.common import Workspace

EMB = "vec_id long, embedding array<double>, label int, code string, error long"


def brute(rows):
    """vec_id -> (code, error, label_error), and the codebooks' digest, in Python's integers."""
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = -(-max((len(v) for _, v, _ in kept), default=0) // 8)
    ints = [[math.floor(Fraction(x) * 4096) for x in v] + [0] * (8 * d - len(v)) for _, v, _ in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0))[:16]
    near = lambda p, book: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(p, book[e], strict=True)), e))
    code, error, books = [[] for _ in kept], [0] * len(kept), []
    for q in range(8):
        part = [x[q * d : q * d + d] for x in ints]
        book = [part[i] for i in order]
        for _ in range(6):
            own = [near(p, book) for p in part]
            for e in range(len(book)):
                got = [p for p, o in zip(part, own, strict=True) if o == e]
                if got:
                    book[e] = [sum(c) // len(got) for c in zip(*got, strict=True)]
        for n, p in enumerate(part):
            e = near(p, book)
            code[n].append(f"{e:02x}")
            error[n] += sum((a - b) ** 2 for a, b in zip(p, book[e], strict=True))
        books.append(book)
    by = {}
    for (_, _, y), e in zip(kept, error, strict=True):
        by[y] = by.get(y, 0) + e
    held = lambda v: v if v < 1 << 63 else None
    sha = hashlib.sha256(",".join(str(v) for b in books for row in b for v in row).encode()).hexdigest()
    return sorted(((i, "".join(c), held(e), held(by[y]), sha) for (i, _, y), c, e in zip(kept, code, error, strict=True)), key=str)


def result(spark, path, rows):
    spark.createDataFrame([(i, v, y, "x", 1) for i, v, y in rows], EMB).repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return sorted((tuple(r) for r in codes.op11(spark, str(path)).collect()), key=str)


def some(n, dims=16, seed=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, dims)), 3)
    x[n // 2 : n // 2 + n // 3] = x[1]  # a third of the rows are one vector
    return [(int(i), x[i].tolist(), int(i % 3) if i % 7 else None) for i in rng.permutation(n)]


ODD = [(900, None, 1), (901, [], 1), (902, [math.nan] + [0.0] * 15, 2), (903, [math.inf] + [0.0] * 15, 2), (904, [None] + [1.0] * 15, 0), (905, [0.5] * 3, 0), (None, [0.25] * 16, None)]


def test_codes_equal_brute_force(spark, tmp_path):
    rows = some(300) + ODD
    assert result(spark, tmp_path, rows) == brute(rows)


def test_ties_and_repeated_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.integers(-2, 3, 8) / 4096).tolist(), 0) for i in range(120)]  # one component a part: entries tie all the time
    rows += [rows[40], rows[40]]
    assert result(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("size", [1e6, 1e13, 1e300, 1.7e308])
def test_numbers_of_any_size(spark, tmp_path, size):
    rows = [(i, [x * size if i % 5 == 0 else x for x in np.clip(v, -1, 1).tolist()], y) for i, v, y in some(60)]
    assert result(spark, tmp_path, rows) == brute(rows)


def test_few_and_no_rows(spark, tmp_path):
    rows = some(5)
    assert result(spark, tmp_path / "few", rows) == brute(rows)
    assert result(spark, tmp_path / "none", []) == []
    assert result(spark, tmp_path / "null", [(1, None, 0)]) == []
    assert result(spark, tmp_path / "empty", [(1, [], 0), (2, [], None)]) == brute([(1, [], 0), (2, [], None)])


def test_annulus_leaves_entries_out():
    rng = np.random.default_rng(9)
    book = (np.arange(1, 17)[:, None] * rng.normal(size=(16, 8)) * 900).astype(np.int64)
    x = (rng.integers(1, 17, 2000)[:, None] * rng.normal(size=(2000, 8)) * 900).astype(np.int64)
    code, best, seen = codes.nearest(x, book)
    d = ((x[:, None] - book[None]) ** 2).sum(2)
    assert (code == d.argmin(1)).all() and (best == d.min(1)).all()
    assert seen.min() >= 1 and seen.sum() < 0.7 * 16 * 2000


def test_operator_takes_other_shapes(spark):
    rows = spark.createDataFrame([(str(i), [float(i % 7)] * 6, i) for i in range(50)], "name string, v array<float>, packed_in int")
    out, books = codes.compress(rows, Workspace(spark, "t"), key="name", vector="v", parts=2, entries=4, rounds=2)
    assert out.columns == ["name", "packed_in", "code", "error", "evaluated"] and out.count() == 50
    assert len(books) == 2 and books[0].shape == (4, 3)
