import random

import numpy as np
import pytest
import xxhash

from lumenframe.llm import simhash
from lumenframe.llm.common import Workspace


def brute(ids, fps):
    root = {i: i for i in range(len(ids))}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        low[r] = min([x for x in (low.get(r), d) if x is not None], default=None)
    return [low[find(i)] for i in range(len(ids))]


def plain_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in lower).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprint_matches_plain():
    for t in (None, "", "  \n", "One", "A b\tc", "Ä b Ç d e f g", "x y z " * 50):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_allocate_spends_the_whole_budget_and_is_optimal():
    rng = np.random.default_rng(1)
    costs = rng.random((50, 4, 3))
    t = simhash.allocate(costs, 2)
    assert (np.sum(t + 1, axis=1) == 3).all()
    import itertools

    for n in range(50):
        best = min(sum(costs[n, p, s] for p, s in enumerate(c)) for c in itertools.product(range(3), repeat=4) if sum(c) == 3)
        assert sum(costs[n, p, t[n, p] + 1] for p in range(4)) == pytest.approx(best)


@pytest.mark.parametrize("bucket", [2048, 4])
def test_components_match_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng = random.Random(5)
    fps = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(15):
            base ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                base ^= 1 << rng.randrange(64)
            fps.append(base)
    fps += [0, 3, 7, 2**64 - 1]
    signed = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {r.fp: r.root for r in simhash.groups(df, Workspace(spark, "t")).collect()}
    want = brute(signed, [x & (2**64 - 1) for x in signed])
    assert {x: got.get(x, x) for x in signed} == dict(zip(signed, want, strict=True))


def test_query_shapes(spark, tmp_path):
    text = "one two three four five six"
    rows = [(5, text), (3, text), (3, text), (None, text), (None, None), (9, ""), (8, None), (7, "lone words here that differ")]
    df = spark.createDataFrame([(i, t, "en", "s", 1, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, fp int")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.op6(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (None, 8), (9, 8), (8, 8), (7, 7)], key=str)
    kept = simhash.keep_representatives(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]


def similarity(a, b):
    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


def test_verified_groups_match_brute_force(spark):
    """A large group whose copies are near the original but not all near each other, reordered word sets, pairs and strangers."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=5))
    base = [word() for _ in range(120)]
    texts = [" ".join(base)]
    for _ in range(70):
        w = list(base)
        for _ in range(2):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    mixed = [word() for _ in range(40)]
    for _ in range(30):
        rng.shuffle(mixed)
        texts.append(" ".join(mixed))
    for _ in range(20):
        w = [word() for _ in range(rng.randint(3, 90))]
        texts += [" ".join(w), " ".join([*w, word()]), " ".join(w)]
    rng.shuffle(texts)
    want = brute_groups(texts)
    df = spark.createDataFrame([(i, t, i, "x", 0) for i, t in enumerate(texts)], "id long, text string, doc_id long, fp string, node int")
    got = {r.id: r.root for r in simhash.same_texts(df.select("id", "text"), Workspace(spark, "t")).collect()}
    firsts = {}
    for i in range(len(texts)):
        firsts.setdefault(got[i], i)
    missed = [i for i in range(len(texts)) if firsts[got[i]] != want[i]]
    assert not [i for i in missed if want[i] == i]  # nothing is joined that should not be
    assert len(missed) <= 0.1 * sum(want[i] != i for i in range(len(texts)))
    kept = simhash.keep_representatives(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(firsts.values())


def brute_groups(texts):
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if similarity(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert simhash.op6(spark, str(tmp_path)).count() == 0
