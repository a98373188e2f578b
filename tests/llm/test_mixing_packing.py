import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumenframe.llm import mixing, packing
from lumenframe.llm.common import Workspace, spread

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, taken string"


def write(spark, path, rows, parts=3):
    spark.createDataFrame([(i, t, "en", s, 0, 1, "x") for i, t, s in rows], DOCS).repartition(parts).write.parquet(f"{path}/documents.parquet")


def corpus():
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["a", "b", "b", "b", "b", "tiny", None])) for i in range(200)]
    rows += [(300, None, "a"), (301, "", "b"), (None, "one two", "c"), (302, "x\ty z\n", "c"), (302, "x\ty z\n", "c"), (303, "long " * 20000, "b")]
    return rows


def test_mixing_meets_the_targets(spark, tmp_path):
    rows = corpus()
    write(spark, tmp_path, rows)
    got = mixing.op4(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or -1, r.size) for r in got) == sorted((i or -1, size(t)) for i, t, _ in rows)
    own = defaultdict(int)
    for _, t, s in rows:
        own[s] += size(t)
    order = sorted((s for s in own if s is not None)) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    goal, open_, left = {}, set(own), float(sum(own.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * own[s]}
        if not full:
            goal |= share
            break
        for s in full:
            goal[s] = 3.0 * own[s]
            left -= goal[s]
        open_ -= full
    by_size = {own[s]: goal[s] for s in own}
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(by_size[r.source_size]) and 0 <= r.taken <= 3 * r.size
        taken[r.source_size] += r.taken
    for s in own:
        assert abs(taken[own[s]] - goal[s]) <= 1
    again = mixing.op4(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_op4_deals_the_schedule(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)), rng.choice(["a", "b", "b", "b", "c", "c"])) for i in range(300)]
    write(spark, tmp_path, rows)
    got = mixing.op4(spark, str(tmp_path)).collect()
    own, goal = defaultdict(list), {r.source_size: r.target for r in got}
    for i, t, s in rows:
        own[s].append((hashlib.md5(f"{i}/{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest(), i, len(t.split())))
    first = {}
    for s, (d0, d1) in zip("abc", mixing.SCHEDULES, strict=True):
        total = sum(n for _, _, n in own[s])
        whole, before = round(goal[total]), 0
        for _, i, n in sorted(own[s]):
            if n and before < whole:
                demand = before / whole * (d0 + d1) / 2
                lo, hi = 0.0, 1.0
                for _ in range(60):  # the time at which the integral of the schedule reaches the demand
                    t = (lo + hi) / 2
                    lo, hi = (t, hi) if d0 * t + (d1 - d0) * t * t / 2 < demand else (lo, t)
                first[i] = lo
            before += n
    assert {r.doc_id for r in got if r.taken} == set(first)
    assert all(r.position == pytest.approx(first[r.doc_id], abs=1e-8) for r in got if r.taken) and all(r.position is None for r in got if not r.taken)
    at = [first[r.doc_id] for r in got[: len(first)]]
    assert all(x <= y + 1e-9 for x, y in zip(at[:-1], at[1:], strict=True))
    assert sorted(r.doc_id for r in got) == list(range(300))


def test_other_schedules_give_another_order_of_the_same_words(spark, tmp_path, monkeypatch):
    write(spark, tmp_path, [(i, "w " * (5 + i % 7), "abc"[i % 3]) for i in range(60)])
    before = mixing.op4(spark, str(tmp_path)).collect()
    monkeypatch.setattr(mixing, "SCHEDULES", ((0.2, 1.8), (1.0, 1.0), (1.9, 0.1)))
    after = mixing.op4(spark, str(tmp_path)).collect()
    assert [r.doc_id for r in before] != [r.doc_id for r in after]
    assert {r.doc_id: r.taken for r in before} == {r.doc_id: r.taken for r in after}


def test_stage_takes_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 1, 2, 3, "p", "k", 9)], "doc_id long, text string, source string, size int, epoch int, words int, position string, _key string, _row int")
    out = mixing.mix_sources(spark, docs, "").collect()
    assert [tuple(r) for r in out] == [(1, "a b", "s", 1, 2, 3, "p", "k", 9)] and out[0].asDict().keys() == set(docs.columns)


def test_position_inverts_the_integral():
    for d0, d1 in mixing.SCHEDULES:
        for t in (0.0, 0.2, 0.7, 1.0):
            done = (d0 * t + (d1 - d0) * t * t / 2) / ((d0 + d1) / 2) * 50
            share = done / 50 * (d0 + d1) / 2
            assert 2 * share / (d0 + (d0 * d0 + 2 * (d1 - d0) * share) ** 0.5) == pytest.approx(t)


def test_stage_repeats_and_cuts_documents(spark):
    docs = spark.createDataFrame([(1, "a b c d", "en", "small", 7), (2, " ".join(["q"] * 400), "en", "big", 799)], "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix_sources(spark, docs, "").collect()
    words = defaultdict(int)
    for r in out:
        words[r.source] += len(r.text.split())
    assert words == {"small": 12, "big": 392}


def tokens(t):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*tok.encode(t or "", add_special_tokens=False).ids, 1]


def test_fast_ids_equal_the_tokenizer(spark):
    bpe = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    assert bpe.fast is not None
    rng = random.Random(1)
    texts = ["", " ", "Hello  world\n\n x", "é漢字🙂 don't", "a<|endoftext|>b", "  tab\t", "x" * 3000] + ["".join(chr(rng.choice([32, 10, 97, 233, 0x4E00, 0x1F600, 39, 49])) for _ in range(200)) for _ in range(30)]
    assert [[*bpe.encode(t), 1] for t in texts] == [tokens(t) for t in texts]


def test_long_runs_of_spaces():
    bpe = packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ("a" + " " * 1_000_000 + "b", "\n" * 2_000_000):
        assert [*bpe.encode(t), 1] == tokens(t)


def test_pieces_rebuild_every_document(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "été"], k=rng.randint(0, 900))), "s") for i in range(40)] + [(50, None, "s"), (51, "", "s"), (None, "no id", None), (52, "again", "s"), (52, "again", "s")]
    write(spark, tmp_path, rows)
    pieces = packing.pack(spread(spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text")), Workspace(spark, "t")).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    for i, t, _ in rows[:42]:
        own = sorted(by_doc[i], key=lambda p: p.start)
        ids = [x for p in own for x in np.frombuffer(p.ids, "<u4").tolist()]
        assert ids == tokens(t) and all(p.doc_tokens == len(ids) and p.length == len(p.ids) // 4 for p in own)
    assert sum(p.length for p in by_doc[52]) == 2 * len(tokens("again"))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, own in by_seq.items():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at == 2048 or s == len(by_seq) - 1
    got = packing.op8(spark, str(tmp_path)).collect()
    assert sorted((r.sequence_id, r.offset, r.ids_crc32) for r in got) == sorted((p.sequence_id, p.offset, zlib.crc32(p.ids)) for p in pieces)


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], 1)
    assert mixing.op4(spark, str(tmp_path)).count() == 0
    assert packing.op8(spark, str(tmp_path)).count() == 0
