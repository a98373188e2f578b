"""Golden values and brute-force loops for the operators."""

import io
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import colour, parse
from lumenframe.functions import signature as sig
from lumenframe.operators import planes, samplers, series, spectral
from lumenframe.sources import y4m


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(("src", "want"), [([1, 2], [1, 1.5, 2]), ([1, 2, 3, 4], [1.5, 3.5]), ([5.0], [5, 5, 5]), ([1, 2, 3], [1, 2, 3])])
def test_resample_goldens(spark, src, want):
    got = one(spark, series.resampled(F.array(*[F.lit(float(x)) for x in src]), len(want)))
    assert got == pytest.approx(want)


def test_resample_of_nothing_is_zeros(spark):
    assert one(spark, series.resampled(F.array().cast("array<double>"), 3)) == [0, 0, 0]


def test_decay_is_a_fold_whatever_the_block(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK", 100)
    rng = random.Random(1)
    xs = [rng.random() for _ in range(9000)]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(xs)], "user_id long, i long, v double")
    got = [r.out for r in series.decayed(df, 0.99).orderBy("i").collect()]
    value, scale = 0.0, 1.0
    for x, y in zip(xs, got, strict=True):
        value, scale = value * 0.99 + x, scale * 0.99 + 1
        assert y == pytest.approx(value / scale)


def test_zigzag_walks_the_diagonals():
    assert samplers.zigzag(3, 3) == [0, 1, 3, 6, 4, 2, 5, 7, 8]
    assert samplers.weave(3, 2) == [0, 1, 2, 5, 4, 3]
    for w, h in ((1, 1), (4, 7), (8, 8)):
        assert sorted(samplers.zigzag(w, h)) == list(range(w * h))


def test_spiral_cells_are_nearest_pixels():
    pts = samplers.spiral_points(20, 16, 2.0, 0.7)
    tag = samplers.nearest_tags(pts, 20, 16)
    for p in range(320):
        d = [(p % 20 - x) ** 2 + (p // 20 - y) ** 2 for x, y in pts.tolist()]
        assert tag[p] == d.index(min(d))
    cells = samplers.spiral(20, 16, 2.0, 0.7, area_limit=1.5, edge_trim=True)
    most = 320 // len(pts) * 1.5
    assert all(len(c) <= most and not any(p % 20 in (0, 19) or p // 20 in (0, 15) for p in c) for c in cells) and cells[-1]


def test_unknown_sampler_is_an_error():
    with pytest.raises(ValueError, match="no sampler"):
        samplers.named("nope")


def walked(x0, y0, x1, y1):
    """The line by its accumulator, a step at a time."""
    dx, dy = x1 - x0, y1 - y0
    steep = abs(dx) <= abs(dy)
    a, b, n, m = (y0, x0, dy, dx) if steep else (x0, y0, dx, dy)
    if n < 0:
        a, b, n, m = (y1, x1, -dy, -dx) if steep else (x1, y1, -dx, -dy)
    way, m = (-1, -m) if m < 0 else (1, m)
    acc, out = (n + m) >> 1, []
    for _ in range(n + 1):
        out.append((b, a) if steep else (a, b))
        a, acc = a + 1, acc - m
        if acc <= 0:
            acc, b = acc + n, b + way
    return out


def test_lines_follow_the_accumulator():
    for x in range(-7, 8):
        for y in range(-7, 8):
            assert planes.line(2, 3, x, y) == walked(2, 3, x, y)
    assert planes.line(1, 1, 6, 7) == [(1, 1), (2, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7)]


PARMS = {"420": {"W": "512", "H": "512", "C": "420"}, "422": {"W": "128", "H": "96", "C": "422"}, "444": {"W": "5", "H": "3", "C": "444"}}


def stream(spark, cs, n=4, seed=1):
    rng = np.random.default_rng(seed)
    raw = [[rng.integers(0, 256, s, dtype=np.uint8) for s in planes.shapes(PARMS[cs])] for _ in range(n)]
    df = spark.createDataFrame([("s", i, PARMS[cs], *(p.tobytes() for p in f)) for i, f in enumerate(raw)], "stream_id string, seq long, parms map<string,string>, y binary, cb binary, cr binary")
    return raw, df


def read(df):
    return {r.seq: [np.frombuffer(x, np.uint8).reshape(s) for x, s in zip((r.y, r.cb, r.cr), planes.shapes(r.parms), strict=True)] for r in df.collect()}


@pytest.mark.parametrize("cs", ["420", "422", "444"])
def test_frame_operators_on_whole_frames(spark, cs):
    raw, df = stream(spark, cs)
    d = read(planes.delta(df))
    m = read(planes.merge(df, 3))
    for k in range(3):
        assert (d[0][k] == 128).all() and all((d[i][k] == np.clip(raw[i][k].astype(int) - raw[i - 1][k] + 128, 0, 255)).all() for i in (1, 2, 3))
        assert (m[0][k] == sum(f[k].astype(int) for f in raw[:3]) // 3).all() and (m[1][k] == raw[3][k] // 3).all()
    info = planes.info(df).where("seq = 2").first()
    for name, p in zip(("Y", "Cb", "Cr"), raw[2], strict=True):
        x = p.astype(float)
        want = (x.mean() / 255, x.min() / 255, x.max() / 255, x.std() / 255, math.sqrt(x.var() + (x.mean() - x.min()) ** 2) / 255)
        assert [info[f"raw_{name}_{f}"] for f in planes.INFO] == pytest.approx(list(want))
    assert all((a == b).all() for i, f in read(planes.from_float(planes.to_float(df))).items() for a, b in zip(f, raw[i], strict=True))
    same = read(planes.scale(df, int(PARMS[cs]["W"]), int(PARMS[cs]["H"])))
    assert all((a == b).all() for i, f in same.items() for a, b in zip(f, raw[i], strict=True))
    bent = read(planes.bent(df, planes.fixed_spans(df, 1.0)))
    assert all((a == np.clip(b, 16, 240)).all() for i, f in bent.items() for a, b in zip(f, raw[i], strict=True))


def test_centre_and_equalise_on_whole_frames(spark):
    raw, df = stream(spark, "420", 1)
    r = planes.centre(df).first()
    half, x = int(raw[0][0].sum(dtype=np.int64)) // 2, raw[0][0].astype(np.int64)
    assert x[:, : r.cx + 1].sum() >= half > x[:, : r.cx].sum() and x[: r.cy + 1].sum() >= half > x[: r.cy].sum()
    big = read(planes.centred(df))[0]
    assert [p.shape for p in big] == [(1024, 1024), (512, 512), (512, 512)]
    assert (big[0][512 - r.cy :, 512 - r.cx :][:512, :512] == raw[0][0]).all() and big[0][0, 0] == 16 and big[1][0, 0] == 128
    black = df.withColumn("y", F.unhex(F.repeat(F.lit("00"), 512 * 512)))
    assert (read(planes.equalise(black))[0][0] == 16).all()
    assert (read(planes.equalise(df))[0][0].min(), read(planes.equalise(df))[0][0].max()) == (16, 235)


def test_samplers_on_whole_frames(spark):
    raw, df = stream(spark, "422", 1)
    got = planes.sampled(df, samplers.zigzag).first()["signals"]
    for p, signal in zip(raw[0], got, strict=True):
        h, w = p.shape
        assert signal == pytest.approx(((p.ravel()[samplers.zigzag(w, h)] - 128.0) / 128).tolist())
    cells = lambda w, h: [[0, w], [], [w * h - 1]]
    got = planes.sampled(df, cells, True).first()["signals"]
    assert got[0] == pytest.approx([((raw[0][0][0, 0] / 2 + raw[0][0][1, 0] / 2) - 128) / 128, 0, (raw[0][0][-1, -1] - 128.0) / 128])


def test_nearest_signature_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(sig, "BLOCK", 7)
    rng = random.Random(4)
    rows = [(s, i, "".join(rng.choice("01") for _ in range(256))) for s in ("a", "b") for i in range(40)]
    df = spark.createDataFrame(rows, "stream_id string, seq long, signature string").repartition(3)
    gap = lambda x, y: sum(p != q for p, q in zip(x, y, strict=True))
    of = {(s, i): t for s, i, t in rows}
    got = {(r.stream_id, r.seq): (r.bits, r.nearest) for r in sig.nearest_before(df, "stream_id", "seq").collect()}
    assert got == {(s, i): min((gap(t, of[s, j]), j) for j in range(i)) for s, i, t in rows if i}
    pairs = {(r.stream_id, r.first, r.second): r.bits for r in sig.pairs_within(df, "stream_id", "seq", 115).collect()}
    assert pairs == {(s, j, i): g for s, i, t in rows for j in range(i) if (g := gap(t, of[s, j])) <= 115}


def test_zeros_and_slow_samples_convolve(spark):
    rng = random.Random(6)
    v = [rng.choice([0.0, 1e-4, 0.3, 1.0, 2.5]) for _ in range(50)]
    kernel, width = [0.0, 0.25, 0.5, 0.25, 0.0], 4
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "user_id long, i long, v double")
    got = [r.out for r in series.pitch_convolve(df, (kernel,), 1.0, True).orderBy("i").collect()]
    area = lambda x: np.trapezoid(np.interp(t := np.linspace(0, x, 4001), range(5), kernel), t)
    length = [width / 2 if x < 1e-5 else 1 / x for x in v]
    starts = np.concatenate([[0], np.cumsum(length)])
    for h in range(50):
        low = starts[h] - width / 2 + length[h] / 2
        cut = [(max(0, starts[p] - low), min(width, starts[p + 1] - low), v[p]) for p in range(50)]
        cut = [c for c in cut if c[1] > c[0]]
        want = width / sum(b - a for a, b, _ in cut) * sum(x * (area(b) - area(a)) for a, b, x in cut)
        assert got[h] == pytest.approx(want, abs=1e-4)


def test_colour_round_trip_and_specs(spark):
    rgb = tuple(F.lit(float(x)) for x in (200, 30, 90))
    back = one(spark, F.struct(*[x.alias(k) for x, k in zip(colour.f_yuv2rgb(colour.f_rgb2yuv(rgb)), "rgb", strict=True)]))
    assert tuple(back) == pytest.approx((200, 30, 90), abs=0.1)
    read = lambda s: one(spark, colour.parse_rgb(F.lit(s)))
    assert tuple(read("#f0e1d2")) == (240, 225, 210) and tuple(read("#fff")) == (255, 255, 255) and tuple(read("1,2,3")) == (1, 2, 3)
    assert read("1,2") is None and read("#12") is None and read("1,2,300") is None


def test_small_parsers(spark):
    assert one(spark, parse.gcd(F.lit(1920), F.lit(1080))) == 120
    assert one(spark, parse.timecode(F.lit(3723.0045))) == "01:02:03.004"
    assert one(spark, parse.strict_double(F.lit("1.5x"))) is None and one(spark, parse.strict_double(F.lit("-1e3"))) == -1000
    name, m = parse.sampler_spec(F.lit("""spiral:a=1,b='x y',c="z",d=q"""))
    assert one(spark, name) == "spiral" and one(spark, m) == {"a": "1", "b": "x y", "c": "z", "d": "q"}
    assert one(spark, parse.params(F.lit("W10 H5 W12"))) == {"W": "12", "H": "5"}


def test_signature_forms(spark):
    for i in range(0, 256, 37):
        text = "".join("1" if j == i else "0" for j in range(256))
        w = sig.parse(F.lit(text))
        assert one(spark, sig.bits_set(w)) == 1 and one(spark, sig.to_binary(w)) == text
        assert int(one(spark, sig.to_hex(w)), 16) == int(text, 2)
    assert one(spark, sig.parse(F.lit("12"))) is None


def test_profile_of_another_size_is_an_error(spark):
    with pytest.raises(Exception, match="number of bins"):
        one(spark, spectral.normalised(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))))


def test_smooth_of_short_arrays(spark):
    got = one(spark, spectral.smoothed(F.array(F.lit(1.0), F.lit(4.0), F.lit(16.0)), 30))
    assert got == pytest.approx([4.0] * 3)
    assert one(spark, spectral.smoothed(F.array(F.lit(3.0)), 1)) == [1.0]


def test_numpipe_repeats_what_it_last_gave(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, 7.0), (1, 2, 9.0)], "user_id long, i long, v double")
    epoch = F.when(F.col("i") < 2, 1).otherwise(4).cast("long")
    got = {how: [r.value for r in series.latest(df, how, epoch, -1.0).orderBy("epoch").collect()] for how in ("first", "average", "last")}
    assert got == {"first": [-1, 5, 5, 5, 9], "average": [-1, 6, 6, 6, 9], "last": [-1, 7, 7, 7, 9]}


def translate(rates, ticks):
    """The output clock cuts the input at whole input and output positions, a step at a time."""
    out, last, i, o = [0.0] * ticks, len(rates) - 1, 0.0, 0.0
    height = lambda x: np.interp(x, range(len(rates) + 1), [*rates, 0.0])
    while i < last and o < ticks:
        cell, tick = int(i + 1e-9), int(o + 1e-9)
        if cell >= last or tick >= ticks:
            break
        step = min((cell + 1 - i) / rates[cell], tick + 1 - o)
        at = sorted({i, min(i + step, len(rates)), *(k for k in range(len(rates) + 1) if i < k < i + step)})
        area = sum((b - a) * (height(a) + height(b)) / 2 for a, b in zip(at[:-1], at[1:], strict=True))
        out[tick] += step / area
        i, o = i + step * rates[cell], o + step
    return out, o


def test_translate_equals_the_stepped_clock(spark):
    rng = random.Random(12)
    rates = {1: [2.0] * 9, 2: [rng.uniform(0.5, 5) for _ in range(60)], 3: [0.7] * 40, 4: [1.5]}
    df = spark.createDataFrame([(u, i, x) for u, r in rates.items() for i, x in enumerate(r)], "user_id long, i long, v double")
    got = {(r.user_id, r.tick): (r.value, r.stop) for r in series.translated(df, 16).collect()}
    for u, r in rates.items():
        out, stop = translate(r, 16)
        assert [got[u, t][0] for t in range(16)] == pytest.approx(out, abs=1e-6) and got[u, 0][1] == pytest.approx(stop)


def test_constant_series_convolve_to_themselves(spark):
    df = spark.createDataFrame([(1, i, 2.0) for i in range(60)], "user_id long, i long, v double")
    kernel = [0.0, 0.25, 0.5, 0.25, 0.0]
    mid = [r.out for r in series.pitch_convolve(df, (kernel,), 1.0, True).orderBy("i").collect()][20:40]
    assert mid == pytest.approx([2.0] * 20)


def test_y4m_round_trip_and_errors():
    rng = random.Random(2)
    parms = {"W": "6", "H": "4", "F": "25:1", "C": "422"}
    planes = [tuple(rng.randbytes(n) for n in y4m.plane_sizes(parms)) for _ in range(5)]
    raw = y4m.encode(parms, planes)
    got = list(y4m.decode(io.BytesIO(raw)))
    assert [tuple(r[3:]) for r in got] == planes and [r[0] for r in got] == list(range(5)) and got[4][1] == pytest.approx(0.16)
    for bad in (b"x" + raw, raw[:-1], raw.replace(b"FRAME", b"FRAMS", 1), raw.replace(b"C422", b"C999")):
        with pytest.raises(ValueError):
            list(y4m.decode(io.BytesIO(bad)))
    assert list(y4m.decode(io.BytesIO(b""))) == []


def test_y4m_source_splits_files(spark, tmp_path):
    parms = {"W": "2", "H": "2", "C": "444"}
    (tmp_path / "a.y4m").write_bytes(y4m.encode(parms, [(bytes([i] * 4),) * 3 for i in range(10)]))
    (tmp_path / "b.y4m").write_bytes(y4m.encode(parms, [(bytes([9] * 4),) * 3]).replace(b"FRAME\n", b"FRAME Xnote\n"))
    spark.dataSource.register(y4m.Y4mSource)
    df = spark.read.format("y4m").option("framesPerPartition", 3).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 5
    rows = sorted((r.stream_id, r.seq, r.y[0], r.parms.get("X")) for r in df.collect())
    assert rows == [("a", i, i, None) for i in range(10)] + [("b", 0, 9, "note")]


def test_png_holds_its_pixels():
    rgb = bytes(range(18))
    out = y4m.png(3, 2, rgb)
    at = out.index(b"IDAT")
    body = zlib.decompress(out[at + 4 : at + 4 + int.from_bytes(out[at - 4 : at])])
    assert body == b"\0" + rgb[:9] + b"\0" + rgb[9:]


def test_spectrum_of_a_sine(spark):
    n = 64
    x = [math.sin(2 * math.pi * 5 * i / n) for i in range(n)]
    m = spark.createDataFrame([(x,)], "s array<double>").select(spectral.magnitudes()("s").alias("m")).first()["m"]
    assert len(m) == 31 and int(np.argmax(m)) == 4 and m[4] == pytest.approx(32)
