import random
import re

import numpy as np
import pytest

from lumenframe.llm import ngrams, sketch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n int, node string"


def plain_set(t):
    w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))
    return ({tuple(w)} if len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if w else set()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 90 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def result(spark, path, rows):
    spark.createDataFrame([(i, t, "aa", "p", 0, 1, "x") for i, t in rows], DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return sorted((tuple(r) for r in ngrams.op12(spark, str(path)).collect()), key=str)


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return " ".join(out)


def corpus(seed=6):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n: rng.choices(vocab, k=n)
    rows, passage = [], text(60)
    for group in range(4):  # chains and stars of near copies, most of them under the bound with each other
        base = text(rng.choice([80, 150, 150, 260]))
        rows += [edited(rng, base, rng.randrange(6)) for _ in range(40)]
    rows += [" ".join(text(30) + passage + text(rng.randrange(5))) for _ in range(40)]  # a passage that many share
    rows += [" ".join(text(rng.randrange(12))) for _ in range(40)]
    rows += [rows[3].upper(), rows[3].replace(" ", "\n\t"), rows[50], rows[50]]
    rows += ["", None, " \n", "one", "ONE", "one two", "One\x0bTwo", "É x y", "é x y", " ".join(text(4000))]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows, strict=True)) + [(None, rows[7]), (None, "alone null"), (ids[9], rows[9]), (ids[9], "another text of the id")]


@pytest.mark.parametrize("list_rows", [2048, 16])  # with 16 rows lists are compared as pairs of blocks
def test_components_equal_brute_force(spark, tmp_path, monkeypatch, list_rows):
    monkeypatch.setattr(ngrams, "LIST_ROWS", list_rows)
    rows = corpus()
    assert result(spark, tmp_path, rows) == brute(rows)


def test_held_pairs_come_in_later_rounds(spark, tmp_path):
    rng = random.Random(1)
    base = [rng.choices([f"w{i}" for i in range(500)], k=150) for _ in range(2)]
    rows = [(i, edited(rng, base[i % 2], rng.randrange(4))) for i in range(260)]
    got = result(spark, tmp_path, rows)
    assert got == brute(rows) and 2 < len({c for _, _, c in got}) < 200


def test_filters_keep_every_link():
    rng = np.random.default_rng(3)
    for n, m in [(1, 1), (9, 10), (19, 20), (50, 45), (148, 148), (300, 290)]:
        limit = int(sketch.may_differ(np.array(n), np.array(m), 90, 100))
        for both in range(min(n, m) + 1):
            assert (n + m - 2 * both <= limit) == (100 * both >= 90 * (n + m - both))
        h = rng.integers(0, 1 << 63, 2 * (n + m), dtype=np.uint64) * np.uint64(2)
        a, b = h[:n], np.concatenate([h[: n // 2], h[n : n + m - n // 2]])
        d = sketch.apart(sketch.matrix([sketch.parity(a)]), sketch.matrix([sketch.parity(b)]))[0]
        assert d <= len(np.setxor1d(a, b))


def test_no_rows(spark, tmp_path):
    assert result(spark, tmp_path / "none", []) == []
    assert result(spark, tmp_path / "null", [(1, None), (2, " ")]) == [(1, 0, 1), (2, 0, 2)]
