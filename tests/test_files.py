import io
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import colour
from lumenframe.operators import spectral
from lumenframe.sources import audio, files, y4m

FRAME = "stream_id string, seq long, parms map<string,string>, y binary, cb binary, cr binary"


def frame(rng, parms, i, stream="a", **own):
    sizes = y4m.plane_sizes(parms)
    return (stream, i, parms | own, *(rng.randbytes(n) for n in sizes))


@pytest.mark.parametrize("differ", [False, True])
def test_stream_round_trip_in_many_tasks(spark, tmp_path, differ):
    rng, parms = random.Random(2), {"W": "4", "H": "2", "C": "420", "F": "25:1"}
    rows = [frame(rng, parms, i, **({"X": f"n{i}", "F": "50:1"} if differ and i % 3 == 1 else {})) for i in range(1000)]
    y4m.write(spark.createDataFrame(rows[::-1], FRAME).repartition(4), str(tmp_path / "out"))
    assert (tmp_path / "out/a.y4m.idx").exists() == differ and not (tmp_path / "out/_temporary").exists()
    back = spark.read.format("y4m").option("framesperpartition", 128).load(str(tmp_path / "out"))
    assert back.rdd.getNumPartitions() == 8
    got = back.orderBy("seq").collect()
    assert [(r.stream_id, r.seq, dict(r.parms), bytes(r.y), bytes(r.cb), bytes(r.cr)) for r in got] == rows
    time = 0.0
    for r, row in zip(got, rows, strict=True):
        assert r.elapsed == pytest.approx(time)
        time += y4m.seconds(row[2])


def test_headers_that_add_up_to_a_frame(spark, tmp_path):
    """Parameters as long as a frame: the size divides, but no range may trust it."""
    parms = {"W": "2", "H": "2", "C": "444"}
    raw = y4m.encode(parms, [(bytes([i] * 4),) * 3 for i in range(18)])
    raw = raw.replace(b"FRAME\n" + bytes([5] * 4), b"FRAME Xaaaaaaaaaaaaaaaa\n" + bytes([5] * 4))
    (tmp_path / "s.y4m").write_bytes(raw)
    spark.dataSource.register(y4m.Y4mSource)
    got = spark.read.format("y4m").option("framesperpartition", 3).load(str(tmp_path)).orderBy("seq").collect()
    assert [bytes(r.y)[0] for r in got] == list(range(18))


class Failing(files.FileWriter):
    def store(self, batches, create):
        create("one").write(b"x")
        raise RuntimeError("lost")


def test_a_failed_attempt_leaves_nothing(tmp_path):
    w = Failing({"path": str(tmp_path)})
    with pytest.raises(RuntimeError):
        w.write(iter(()))
    good = type("Good", (files.FileWriter,), {"store": lambda self, batches, create: create("one").write(b"good")})({"path": str(tmp_path)})
    good.job = w.job
    done = good.write(iter(()))
    again = good.write(iter(()))  # the task ran twice; only one attempt is committed
    good.commit([done, None])
    assert [p.name for p in tmp_path.iterdir()] == ["one"] and (tmp_path / "one").read_bytes() == b"good"
    assert again.files[0][0] != done.files[0][0]
    with pytest.raises(ValueError, match="same name"):
        good.commit([good.write(iter(())), good.write(iter(()))])


def read_png(raw):
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    w, h = struct.unpack(">II", raw[16:24])
    at, body = 8, b""
    while at < len(raw):
        n, kind = struct.unpack(">I4s", raw[at : at + 8])
        body += raw[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
        assert zlib.crc32(raw[at + 4 : at + 8 + n]) == struct.unpack(">I", raw[at + 8 + n : at + 12 + n])[0]
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + 3 * w)
    assert not rows[:, 0].any()
    return rows[:, 1:].reshape(h, w, 3)


@pytest.mark.parametrize("space", ["420", "422", "444"])
def test_dumped_frames_are_their_planes_colours(spark, tmp_path, space):
    rng, parms = random.Random(7), {"W": "6", "H": "4", "C": space}
    rows = [frame(rng, parms, i) for i in range(7)]
    df = spark.createDataFrame(rows, FRAME).repartition(3)
    y4m.dump(df, str(tmp_path / "png"), 3)
    assert sorted(p.name for p in (tmp_path / "png").iterdir()) == [f"a-0000{i}.png" for i in range(3)]
    xs, ys = y4m.SUBSAMPLING[space]
    pixel = [(x, y, rows[3][3][y * 6 + x], *(rows[3][p][(y // ys) * (6 // xs) + x // xs] for p in (4, 5))) for y in range(4) for x in range(6)]
    t = spark.createDataFrame(pixel, "x int, yy int, y int, u int, v int")
    want = t.select("x", "yy", *[c.alias(k) for c, k in zip(colour.b_yuv2rgb((F.col("y"), F.col("u"), F.col("v"))), "rgb", strict=True)]).collect()
    got = read_png((tmp_path / "png/a-00001.png").read_bytes())
    for r in want:
        assert tuple(got[r.yy, r.x]) == (r.r, r.g, r.b)


def wav(kind, bits, channels, raw, data_length=None):
    fmt = struct.pack("<HHIIHH", kind, channels, 8000, 0, channels * bits // 8, bits)
    return b"RIFF\0\0\0\0WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(raw) if data_length is None else data_length) + raw


@pytest.mark.parametrize(("kind", "bits"), [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32), (3, 64)])
def test_audio_blocks_of_every_kind_of_sample(spark, tmp_path, kind, bits):
    rng = np.random.default_rng(3)
    n, channels, stride = 1003, 2, 10
    if kind == 3:
        x = rng.normal(size=(n, channels)).astype(f"f{bits // 8}")
        raw, x = x.tobytes(), x.astype(float)
    else:
        v = rng.integers(-(1 << (bits - 1)), 1 << (bits - 1), (n, channels))
        x = v / float(1 << (bits - 1))
        raw = (v + 128).astype(np.uint8).tobytes() if bits == 8 else b"".join(int(i).to_bytes(bits // 8, "little", signed=True) for i in v.ravel())
    (tmp_path / "s.wav").write_bytes(wav(kind, bits, channels, raw, 0 if bits == 16 else None))
    df = audio.load(spark, str(tmp_path), stride, framesperpartition=7)
    assert df.rdd.getNumPartitions() == 15
    padded = np.concatenate([x, np.zeros((7, channels))])
    got = {(r.frame, r.channel): r.samples for r in df.collect()}
    assert set(got) == {(f, c) for f in range(100) for c in range(2)}
    for (f, c), s in got.items():
        assert s == padded[f * 10 : f * 10 + 20, c].tolist()


def test_audio_written_and_read_back(spark, tmp_path):
    rows = [("u", i, [i / 7, -i / 3]) for i in range(75)] + [("v", i, [float(i)]) for i in range(5)] + [("w", 0, [1.0])]
    audio.write(spark.createDataFrame(rows, "stream_id string, i long, samples array<double>").repartition(3), str(tmp_path / "wav"))
    got = {(r.stream_id, r.channel, r.frame): r.samples for r in audio.load(spark, str(tmp_path / "wav"), 32).collect()}
    assert set(got) == {("u", c, f) for c in (0, 1) for f in (0, 1)}
    assert got["u", 1, 1] == [-i / 3 for i in range(32, 75)] + [0.0] * 21
    series = spark.createDataFrame([("u", i, i / 7) for i in range(75)], "k string, i long, v double")
    assert {r.frame: r.signal for r in spectral.overlapping(series, "k", 32).collect()} == {f: got["u", 0, f] for f in (0, 1)}
    for bad in (b"RIFX", b"RIFF\0\0\0\0WAVEdata\0\0\0\0", wav(1, 12, 1, b"")):
        with pytest.raises(ValueError):
            audio.Layout(io.BytesIO(bad), len(bad))
