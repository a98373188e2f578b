import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import scans, trie
from lumenframe.llm.common import Workspace

CONV = "conv_id long, turn long, role string, text string, depth int, part string"


def brute(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    out = []
    for v, m in members.items():
        below = [u for u in members if u[: len(v)] == v]
        kids = lambda u: [w for w in members if len(w) == len(u) + 1 and w[: len(u)] == u]
        saved = sum((len(members[u]) - 1) * len(re.findall("[^\\x20\\x09-\\x0D]+", u[-1][1])) for u in below if u)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(v, [])))).encode()).hexdigest()
        out.append((min(m), len(v), min(members[v[:-1]]) if v else None, len(m), len(kids(v)), sum(not kids(u) for u in below), saved, sha))
    return sorted(out, key=str)


def some(n, seed=5, long=6):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        like = rng.choice([c, 3, 3, 7])  # many conversations begin, or are, alike
        turns = random.Random(like)
        for t in range(turns.randint(0, long) if c % 9 else 1):
            text = " ".join(turns.choices("ab cd ef\tgh".split(" "), k=turns.randint(0, 4)))
            rows.append((c, t, turns.choice(["user", "assistant"]), text if rng.random() < 0.9 else text + " !"))
    rng.shuffle(rows)
    return rows


ODD = [(None, 0, "user", "a"), (45, None, "user", "b"), (45, 0, None, None), (45, 0, "user", "c"), (45, 0, "user", "c"), (61, 1, "user", "x" * 100_000), (62, 1, "user", "x" * 100_000 + "y"), (-7, 0, "user", "q"), (2**40, 0, "user", "b")]


def build(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], CONV).repartition(parts)


@pytest.mark.parametrize("bits", [64, 6])  # with six bits most nodes collide and are split by their texts
def test_trie_equals_brute_force(spark, bits):
    rows = [r for r in some(60) + ODD if r[0] != -7]
    df = build(spark, rows).select("conv_id", "turn", "role", "text")
    assert sorted((tuple(r) for r in trie.trie(df, Workspace(spark, "t"), bits).collect()), key=str) == brute(rows)


def test_query_over_a_table(spark, tmp_path):
    rows = [r for r in some(90, seed=8) + ODD if r[0] != -7]
    build(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted((tuple(r) for r in trie.op13(spark, str(tmp_path)).collect()), key=str) == brute(rows)


def test_one_conversation_with_most_turns_and_one_node_with_most_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 64)
    rows = [(20, t, "user", f"t{t % 5} w") for t in range(700)] + [(c, t, "user", "same") for c in range(100, 400) for t in range(3)]
    rows += [(c, 0, "user", "same") for c in (3, 5, 2000)]
    df = build(spark, rows).select("conv_id", "turn", "role", "text")
    got = {(r.conv_id, r.depth): r for r in trie.trie(df, Workspace(spark, "t")).collect()}
    want = [r for r in brute([r for r in rows if r[0] != 20] + [r for r in rows if r[0] == 20 and r[1] < 40])]
    deep = [r for r in got.values() if r.conv_id != 20 and r.depth > 0]
    assert sorted((tuple(r) for r in deep), key=str) == [r for r in want if r[0] != 20 and r[1] > 0]
    assert max(d for _, d in got) == 700 and got[20, 700].n_children == 0


def test_negative_ids_and_no_rows(spark):
    df = build(spark, [(-7, 0, "user", "q"), (0, 0, "user", "z")]).select("conv_id", "turn", "role", "text")
    h = zlib.crc32(b"-7") % 4
    got = {(r.conv_id, r.depth) for r in trie.trie(df, Workspace(spark, "t")).collect()}
    assert got == ({(-7, 0), (-7, 1), (0, 1)} if h == 0 else {(-7, 0), (-7, 1)})
    assert trie.trie(df.limit(0), Workspace(spark, "t")).count() == 0


def test_running_over_partitions(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), i, int(v)) for i, (k, v) in enumerate(zip(rng.choice([1, 2, 2, 2, 2, 9], 3000), rng.integers(-(2**62), 2**62, 3000), strict=True))]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    small = df.withColumn("v", F.col("v") % 1000)
    got = scans.running(small.withColumn("w", F.col("v")), Workspace(spark, "t"), "k", [F.col("i").desc()], sums=("v",), poly="w").collect()
    want = {}
    for k in {r[0] for r in rows}:
        total = upto = 0
        for n, (_, i, v) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: -r[1])):
            v = int(np.fmod(v, 1000))
            total, before = total + v, upto
            upto = (upto + v * pow(scans.BASE, n, 1 << 64)) % (1 << 64)
            want[i] = n, total, before, upto
    assert {r.i: (r.pos, r.v_sum, r.before % (1 << 64), r.upto % (1 << 64)) for r in got} == want
