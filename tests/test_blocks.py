"""Windows in blocks against plain loops: a key with nine tenths of the rows, null keys, gaps, borders everywhere."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import signature as sig
from lumenframe.operators import blocks, planes, series

SCHEMA = "user_id long, i long, v double"


def hot(n: int = 900) -> list[tuple]:
    rng = random.Random(5)
    sizes = {1: n, 2: n // 20, None: n // 20, 3: 1}
    return [(k, i, rng.random() + 0.25) for k, size in sizes.items() for i in range(size)]


def by_key(rows) -> dict:
    out = {}
    for k, i, v in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])):
        out.setdefault(k, []).append(v)
    return out


def collected(df, *cols) -> dict:
    return {(r["user_id"], r["i"]): tuple(r[c] for c in cols) for r in df.collect()}


@pytest.fixture
def short(monkeypatch):
    monkeypatch.setattr(blocks, "LENGTH", 16)
    monkeypatch.setattr(series, "BLOCK", 16)


@pytest.mark.parametrize(("before", "after"), [(4, 0), (0, 7), (3, 3), (40, 0), (0, 0)])
def test_sliding_sees_over_borders(spark, before, after):
    rows = hot()
    df = spark.createDataFrame(rows, SCHEMA)
    sums = lambda t, k: t.withColumn("s", F.sum("v").over(series.rows(k, "i", before, after)))
    got = collected(blocks.sliding(df, before, after, sums, length=16), "s")
    assert len(got) == len(rows)
    for k, vs in by_key(rows).items():
        for i in range(len(vs)):
            assert got[k, i][0] == pytest.approx(sum(vs[max(0, i - before) : i + after + 1]))


def test_running_sums_and_maxima(spark):
    rows = hot()
    df = spark.createDataFrame(rows, SCHEMA)
    some = F.when(F.col("i") % 5 == 3, F.col("v"))
    sums = collected(blocks.running(df, {"s": some}, length=16), "s_before", "s")
    tops = collected(blocks.running(df, {"m": some}, "max", length=16), "m_before", "m")
    for k, vs in by_key(rows).items():
        total, top = 0.0, None
        for i, v in enumerate(vs):
            before, held = total, top
            if i % 5 == 3:
                total, top = total + v, v if top is None else max(top, v)
            assert sums[k, i] == pytest.approx((before, total))
            assert tops[k, i] == (held, top)


def test_one_key_is_many_tasks(spark):
    """Nine tenths of the rows have one key, and more than one task has them."""
    df = spark.createDataFrame(hot(4000), SCHEMA)
    task = lambda t, k: t.withColumn("x", F.lag("v").over(Window.partitionBy(k).orderBy("i"))).withColumn("task", F.spark_partition_id())
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per = [r["count"] for r in blocks.sliding(df, 1, 0, task, length=64).where("user_id = 1").groupBy("task").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(per) > 1
    assert max(per) < 4000 * 0.6


@pytest.mark.parametrize("ahead", [False, True])
def test_beside_skips_gaps(spark, ahead):
    rng = random.Random(9)
    seqs = {k: sorted(rng.sample(range(400), 60)) for k in (1, 2, None)}
    df = spark.createDataFrame([(k, i, float(i)) for k, s in seqs.items() for i in s], SCHEMA)
    got = collected(blocks.beside(df, ["i", "v"], ahead, "user_id", "i", length=8), "_n")
    assert len(got) == 180
    for k, s in seqs.items():
        for n, i in enumerate(s):
            want = (s[n + 1] if n + 1 < len(s) else None) if ahead else (s[n - 1] if n else None)
            assert (got[k, i][0] and got[k, i][0]["i"]) == want


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert blocks.sliding(none, 1, 1, lambda t, k: t).collect() == []
    assert blocks.running(none, {"s": F.col("v")}).collect() == []
    assert blocks.beside(none, ["v"], True, "user_id", "i").collect() == []
    assert series.decayed(none, 0.5).collect() == []


@pytest.mark.parametrize("rate", [0.0, 0.5, 0.9, 0.9999, 0.99999999])
def test_decay_over_blocks_at_any_rate(spark, short, rate):
    rows = hot(300)
    got = collected(series.decayed(spark.createDataFrame(rows, SCHEMA), rate, value=3.0, scale=2.0), "out")
    for k, vs in by_key(rows).items():
        a, s = 3.0, 2.0
        for i, v in enumerate(vs):
            a, s = a * rate + v, s * rate + 1
            assert got[k, i][0] == pytest.approx(a / s)


def test_bent_and_translated_do_not_depend_on_blocks(spark, monkeypatch):
    rows = [r for r in hot(300) if r[0] is not None]
    df = spark.createDataFrame(rows, SCHEMA)
    kernel = ([0.0, 0.25, 0.5, 0.25, 0.0],)

    def every():
        bent = collected(series.bent(df.withColumn("rate", F.col("v") + 0.5)), "v")
        played = {(r.user_id, r.tick): (r.value, r.stop) for r in series.translated(df, 12).collect()}
        folded = collected(series.pitch_convolve(df, kernel), "out")
        return bent, played, folded

    whole = every()
    monkeypatch.setattr(blocks, "LENGTH", 16)
    for a, b in zip(whole, every(), strict=True):
        assert a.keys() == b.keys()
        assert all(a[k] == pytest.approx(b[k]) for k in a)


def test_latest_holds_over_blocks(spark, short):
    rows = [(1, i, float(i)) for i in range(0, 400, 37)]
    got = {r.epoch: r.value for r in series.latest(spark.createDataFrame(rows, SCHEMA), "last", F.col("i"), -1.0).collect()}
    assert got == {e: float(e - e % 37) for e in range(max(r[1] for r in rows) + 1)}


def test_frames_pair_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(planes, "PAIRED", 4)
    rng = np.random.default_rng(3)
    parms = {"W": "4", "H": "4", "C": "444"}
    cards = {(s, i): rng.integers(0, 256, (3, 16), np.uint8) for s, n in (("a", 45), ("b", 3)) for i in range(0, n, 1 if s == "b" else 2)}
    rows = [(s, i, parms, *(bytearray(p.tobytes()) for p in c)) for (s, i), c in cards.items()]
    f = spark.createDataFrame(rows, "stream_id string, seq long, parms map<string,string>, y binary, cb binary, cr binary")
    got = {(r.stream_id, r.seq): np.frombuffer(bytes(r.y), np.uint8) for r in planes.delta(f).collect()}
    assert got.keys() == cards.keys()
    for (s, i), y in got.items():
        last = cards.get((s, i - (2 if s == "a" else 1)), cards[s, i])
        assert (y == np.clip(cards[s, i][0].astype(int) - last[0] + 128, 0, 255)).all()


def test_signatures_meet_in_groups_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(sig, "BLOCK", 4)
    rng = random.Random(2)
    words = [rng.getrandbits(256) for _ in range(70)]
    df = spark.createDataFrame([("s", i, f"{w:0256b}") for i, w in enumerate(words)], "stream_id string, seq long, signature string")
    got = {r.seq: (r.bits, r.nearest) for r in sig.nearest_before(df, "stream_id", "seq").collect()}
    assert got == {i: min(((words[i] ^ words[j]).bit_count(), j) for j in range(i)) for i in range(1, 70)}
    pairs = {(r.first, r.second): r.bits for r in sig.pairs_within(df, "stream_id", "seq", 115).collect()}
    assert pairs == {(j, i): (words[i] ^ words[j]).bit_count() for i in range(70) for j in range(i) if (words[i] ^ words[j]).bit_count() <= 115}


@pytest.mark.parametrize("slow", [0.01, 0.4, 3.0])
def test_bent_adds_up_before_it_spreads(spark, short, slow):
    """A way of a hundred ticks goes through the sums as its two ends and one row between, and rows are dealt once for windows and carry."""
    rows = hot(90)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rate", F.col("v") * slow)
    bent = series.bent(df)
    got = collected(bent, "v")
    want = {}
    for k, vs in by_key(rows).items():
        t, ticks = 0.0, {}
        for i, v in enumerate(vs):
            nx = vs[min(i + 1, len(vs) - 1)]
            r = nx * slow
            for o in range(math.floor(t), max(math.floor(t), math.ceil(t + 1 / r) - 1) + 1):
                a, b = max(t, o), min(t + 1 / r, o + 1)
                left = 1 - (a - t) * r
                ticks[o] = ticks.get(o, 0.0) + (b - a) * (v * left + nx * (1 - left))
            t += 1 / r
        want |= {(k, o): x for o, x in ticks.items() if o < math.floor(t + 1e-9)}
    assert set(got) == set(want)
    assert all(got[at][0] == pytest.approx(x, abs=1e-6) for at, x in want.items())
    plan = bent._jdf.queryExecution().optimizedPlan().toString()
    sums = [line for line in plan.splitlines() if "Aggregate" in line or "Generate" in line]
    assert "Generate" in sums[0] and "Aggregate" in sums[1]  # the ticks between are spread over what was added up
    assert plan.count("Join ") == 1
