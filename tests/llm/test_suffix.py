import hashlib
import random

import numpy as np
import pytest

from lumenframe.llm import suffix
from lumenframe.llm.common import Workspace


def brute(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = {}
    for i, b in enumerate(raw):
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], []).append((i, s))
    gone = [np.zeros(len(b), bool) for b in raw]
    for at in seen.values():
        if len(at) > 1:
            for i, s in at:
                gone[i][s : s + length] = True
    out = []
    for b, g in zip(raw, gone, strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~g])
        spans = int(g[:1].sum() + np.count_nonzero(g[1:] & ~g[:-1]))
        out.append((len(b), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    a, b, c = text(150), text(90), text(300)
    out = [text(60) + a + text(60), text(10) + a + text(30) + b, b + " " + text(80), c, c, c[:700], c[3:900] + "x" + c[900:], text(40)]
    out += [a[:399] + text(50), text(9) + a[:400] + text(9), a[1:401] + text(9), "z" * 1500, "ab" * 700, None, "", "z" * 450, text(2000)]
    out += [text(5) + a[20:419] + text(20), text(5) + a[20:420] + text(20), c + c]
    return out


def test_loser_tree_merges_with_exact_prefixes():
    rng = random.Random(3)
    runs = []
    for _ in range(9):
        keys = sorted(bytes(rng.choices(b"ab", k=rng.randint(0, 12))) for _ in range(rng.randint(0, 40)))
        runs.append([(k, b"l" * 3, i, False) for i, k in enumerate(keys)])
    got = list(suffix.merge([list(suffix.decode(suffix.encode(r))) for r in runs]))
    keys = [item[0] for _, _, item in got]
    assert keys == sorted(k for r in runs for k, *_ in r)
    assert [h for h, _, _ in got] == [suffix.common(a, b) for a, b in zip([b"", *keys], keys, strict=False)]
    assert {(r, item[3]) for _, r, item in got} == {(i, j) for i, r in enumerate(runs) for j in range(len(r))}


@pytest.mark.parametrize(("seed", "chunk", "hot"), [(1, 1 << 20, 20_000), (2, 1500, 3), (3, 400, 20_000)])
def test_matches_brute_force(spark, tmp_path, monkeypatch, seed, chunk, hot):
    monkeypatch.setattr(suffix, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(suffix, "HOT", hot)
    texts = corpus(seed)
    rows = [(i if i != 3 else None, t, 7) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, n_bytes int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.op2(spark, str(tmp_path)).collect()}
    want = brute(texts)
    assert got == {r[0]: want[i] for i, r in enumerate(rows)}


@pytest.mark.parametrize("length", [100, 300])
def test_other_lengths_match_brute_force(spark, length):
    texts = corpus(5)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    chunks, marks = suffix.repeated(docs, Workspace(spark, "t"), length)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.cut(chunks, marks, ["doc_id"], False, length).collect()}
    assert got == dict(enumerate(brute(texts, length)))


def test_empty_and_stage(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert suffix.op2(spark, str(tmp_path)).count() == 0
    passage, other = " ".join(f"p{i}" for i in range(51)), " ".join(f"r{i}" for i in range(50))
    rows = [(1, f"head {passage} tail", "en", "s", 1), (2, passage, "en", "s", 2), (3, "short", "en", None, 5), (4, f"{other} x", "en", "s", 0), (5, f"y {other}", "en", "s", 0), (6, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, row string, n_chars long")
    out = suffix.cut_repeats(spark, docs, "")
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "head  tail"[: len(got[1])], 2: "", 3: "short", 4: f"{other} x", 5: f"y {other}", 6: ""}
    assert all(r.n_chars == len(r.text) for r in out.collect())


def test_segments_hold_the_same_starts(monkeypatch):
    rng = random.Random(2)
    data = np.frombuffer(bytes(rng.choices(b"abc ", k=5000)), np.uint8)
    ends = np.array([1200, 1210, 4000, 5000])
    whole = suffix.Units(data, ends, 120)
    monkeypatch.setattr(suffix, "SEGMENT", 333)
    parts = suffix.Units(data, ends, 120)

    def starts(u):
        return {s: (x, h) for x, lo, hi, h in zip(u.x.tolist(), u.lo.tolist(), u.hi.tolist(), u.hash.tolist(), strict=True) for s in range(x - hi, x - lo + 1)}

    assert starts(whole) == starts(parts) and len(starts(parts)) == sum(max(0, n - 119) for n in (1200, 10, 2790, 1000))


def test_long_run_of_one_byte(spark, tmp_path):
    """Every start of such a run is a unit; their contexts are never held at once."""
    rows = [(1, "z" * 1_500_000), (2, "z" * 399), (3, "y " + "z" * 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffix.op2(spark, str(tmp_path)).collect()}
    assert got == {1: (1_500_000, 1_500_000, 1), 2: (399, 0, 0), 3: (402, 400, 1)}
