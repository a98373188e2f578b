"""Operators on whole frames: binary Y, Cb and Cr planes of any size, numpy inside Arrow batches.

A frame is a row (stream_id, seq, parms, y, cb, cr, ...), as the ``y4m`` source reads it; parms has W, H and C. Stateless
operators are one pass without a shuffle. Operators with memory pair a frame with the one before or after it in a window, or
group the pieces of an output frame; a plane is one value throughout, so neither plan nor rows grow with the pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType, _parse_datatype_string

from lumenframe.operators import blocks
from lumenframe.operators.frames import FILL_C, FILL_Y, HIGH_C, LOW, SUBSAMPLING

PLANES = ("y", "cb", "cr")
FILL = (FILL_Y, FILL_C, FILL_C)
INFO = ("average", "min", "max", "rms", "energy")


def shapes(parms: dict[str, str]) -> list[tuple[int, int]]:
    """(height, width) of the three planes."""
    w, h = int(parms["W"]), int(parms["H"])
    xs, ys = SUBSAMPLING[parms.get("C", "420")]
    return [(h, w), (h // ys, w // xs), (h // ys, w // xs)]


def factors(parms: dict[str, str]) -> list[tuple[int, int]]:
    """(x, y) subsampling of the three planes."""
    return [(1, 1)] + [SUBSAMPLING[parms.get("C", "420")]] * 2


def unpack(parms: dict[str, str], raw) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint8).reshape(s) for b, s in zip(raw, shapes(parms), strict=True)]


#: Bytes of planes that are unpacked at once.
UNPACKED = 1 << 20


def pieces(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``UNPACKED`` bytes, at least a row each, so that Python objects of few frames are held at a time."""
    step = max(1, UNPACKED * b.num_rows // max(1, b.nbytes))
    return (b.slice(lo, step) for lo in range(0, b.num_rows, step))


def mapped(frames: DataFrame, fn: Callable, add: str = "", planes: bool = True, sides: tuple[str, ...] = PLANES) -> DataFrame:
    """Apply ``fn(parms, planes)`` to every frame.

    It returns (parms, planes, values): the new planes where ``planes`` is true, and the values of the columns ``add`` (DDL).
    ``sides`` names the binary columns that it gets; those beyond the three planes may be null and go afterwards.
    """
    extra = _parse_datatype_string(add) if add else StructType([])
    gone = {"parms", *sides} if planes else set(sides) - set(PLANES)
    keep = [f for f in frames.schema.fields if f.name not in gone]
    made = "parms map<string,string>, y binary, cb binary, cr binary" if planes else ""
    out = StructType([*keep, *(_parse_datatype_string(made).fields if planes else []), *extra.fields])
    kinds = [to_arrow_type(f.dataType) for f in extra.fields]
    text = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in pieces(whole)):
            got = []
            for row in zip(b.column("parms").to_pylist(), *(b.column(s).to_pylist() for s in sides), strict=True):
                parms = dict(row[0])
                every = [x for i in range(1, len(row), 3) for x in (unpack(parms, row[i : i + 3]) if row[i] is not None else [None] * 3)]
                got.append(fn(parms, every))
            cols = [b.column(f.name) for f in keep]
            if planes:
                cols.append(pa.array([list(g[0].items()) for g in got], text))
                cols += [pa.array([np.ascontiguousarray(g[1][i], np.uint8).tobytes() for g in got], pa.binary()) for i in range(3)]
            cols += [pa.array([g[2][i] for g in got], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=out.names)

    return frames.mapInArrow(run, out)


def each(frames: DataFrame, fn: Callable) -> DataFrame:
    """Apply ``fn(plane, number, parms)`` to every plane; sizes stay."""
    return mapped(frames, lambda parms, ps: (parms, [fn(p, i, parms) for i, p in enumerate(ps)], ()))


def testcard(numbers: DataFrame, width: int, height: int, steps: int = 256) -> DataFrame:
    """Frames (stream_id, seq, parms, y, cb, cr) in 4:4:4 for (stream_id, seq), seq from 0 to 6 x steps - 1: ramps from 0 to 255 along
    x, along y and over ``steps`` frames, dealt to the planes in all six orders."""
    parms = {"A": "1:1", "C": "444", "F": "25:1", "H": str(height), "I": "t", "W": str(width)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.broadcast_to(np.arange(width) * 255 // max(1, width - 1), (height, width)).astype(np.uint8).tobytes()
        y = np.broadcast_to((np.arange(height) * 255 // max(1, height - 1))[:, None], (height, width)).astype(np.uint8).tobytes()
        orders = list(permutations(range(3)))
        for b in batches:
            for lo in range(0, b.num_rows, 16):
                some = b.slice(lo, 16)
                seq = some.column("seq").to_pylist()
                ramps = [(x, y, bytes([n % steps * 255 // max(1, steps - 1)]) * (width * height)) for n in seq]
                cols = [some.column("stream_id"), some.column("seq"), pa.array([list(parms.items())] * len(seq), pa.map_(pa.string(), pa.string()))]
                cols += [pa.array([r[orders[n // steps][k]] for r, n in zip(ramps, seq, strict=True)], pa.binary()) for k in range(3)]
                yield pa.RecordBatch.from_arrays(cols, names=["stream_id", "seq", "parms", *PLANES])

    kind = numbers.schema["stream_id"].dataType.simpleString()
    return numbers.select("stream_id", F.col("seq").cast("long")).mapInArrow(run, f"stream_id {kind}, seq long, parms map<string,string>, y binary, cb binary, cr binary")


def info_of(p: np.ndarray) -> tuple[float, ...]:
    """average, min, max, rms, energy over 255; rms is the population deviation, energy that around the minimum."""
    x = p.astype(float)
    mean, low = x.mean(), x.min()
    var = ((x - mean) ** 2).mean()
    return mean / 255, low / 255, x.max() / 255, float(np.sqrt(var)) / 255, float(np.sqrt(var + (mean - low) ** 2)) / 255


def info(frames: DataFrame, kind: str = "raw") -> DataFrame:
    """Add ``<kind>_<plane>_<field>`` for the fields of all three planes."""
    names = [f"{kind}_{p}_{f}" for p in ("Y", "Cb", "Cr") for f in INFO]
    return mapped(frames, lambda parms, ps: (parms, ps, tuple(float(v) for p in ps for v in info_of(p))), ", ".join(f"{n} double" for n in names), planes=False)


#: Frames of a stream that are paired in one task.
PAIRED = 256


def with_neighbour(frames: DataFrame, ahead: bool) -> DataFrame:
    """Add y0, cb0, cr0: the planes of the next frame of the stream, or of the one before; null at its end.

    A stream is as many tasks as it has blocks of ``PAIRED`` frames; a block lends one frame to the next.
    """
    both = blocks.beside(frames, PLANES, ahead, "stream_id", "seq", PAIRED)
    return both.select("*", *[F.col(f"_n.{p}").alias(f"{p}0") for p in PLANES]).drop("_n")


NEIGHBOURS = (*PLANES, *(f"{p}0" for p in PLANES))


def delta(frames: DataFrame) -> DataFrame:
    """Difference to the frame before, around 128 and clamped to a byte; a stream's first frame gives 128 throughout."""

    def run(parms, ps):
        return parms, [np.clip(a.astype(int) - (a if b is None else b) + 128, 0, 255) for a, b in zip(ps[:3], ps[3:], strict=True)], ()

    return mapped(with_neighbour(frames, False), run, sides=NEIGHBOURS)


def summed(pieces: DataFrame, weights: tuple[str, ...], clamp: tuple[int, int], digits: int | None, divide: int = 1, whole: float | None = None, lost: str | None = None) -> DataFrame:
    """One frame for each (stream_id, seq) of ``pieces``: the sum of their planes by ``weights``, a column for the frame and perhaps one for its neighbour.

    The rest of the weights up to ``whole`` is filled with black, where weights in the column ``lost`` count as given. Pieces
    stream through a task, one frame of sums is held.
    """
    sides = PLANES if len(weights) == 1 else NEIGHBOURS

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parms, total, sums = None, 0.0, None
        for b in batches:
            total += sum(b.column(lost).to_pylist()) if lost else 0.0
            rows = zip(b.column("parms").to_pylist(), *(b.column(w).to_pylist() for w in weights), *(b.column(s).to_pylist() for s in sides), strict=True)
            for row in rows:
                parms = dict(row[0])
                if sums is None:
                    sums = [np.zeros(s) for s in shapes(parms)]
                for j, w in enumerate(row[1 : 1 + len(weights)]):
                    total += w
                    raw = row[1 + len(weights) + 3 * j :][:3]
                    for i, x in enumerate(unpack(parms, raw) if raw[0] is not None else FILL):
                        if w:
                            sums[i] += np.asarray(x, float) * w
        rest = 0.0 if whole is None else max(0.0, whole - total)
        made = [s / divide + rest * f for s, f in zip(sums, FILL, strict=True)]
        made = [np.clip(m if digits is None else m.round(digits), *clamp).astype(np.uint8) for m in made]
        cols = [pa.array([key[0].as_py()], b.schema.field("stream_id").type), pa.array([key[1].as_py()], pa.int64()), pa.array([list(parms.items())], pa.map_(pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*cols, *(pa.array([m.tobytes()], pa.binary()) for m in made)], names=["stream_id", "seq", "parms", *PLANES])

    kind = pieces.schema["stream_id"].dataType.simpleString()
    return pieces.groupBy("stream_id", "seq").applyInArrow(run, f"stream_id {kind}, seq long, parms map<string,string>, y binary, cb binary, cr binary")


def merge(frames: DataFrame, n: int) -> DataFrame:
    """Mean of every n frames, truncated. A stream's last, shorter group is still divided by n."""
    pieces = frames.withColumns({"seq": F.floor(F.col("seq") / n).cast("long"), "_w": F.lit(1.0)})
    return summed(pieces, ("_w",), (0, 255), None, divide=n)


def equalise(frames: DataFrame) -> DataFrame:
    """Luma through its cumulative histogram as a lookup, value 0 to 16 and value 255 to 235; a plane of one value, where that is 0 / 0, gives 16. Chroma stays."""

    def table(p: np.ndarray) -> np.ndarray:
        upto = np.cumsum(np.bincount(p.ravel(), minlength=256)) * 255.0 / p.size
        if upto[0] >= 255:
            return np.full(256, LOW, np.uint8)
        return np.clip((upto - upto[0]) / (255 - upto[0]) * 219 + 16, 16, 235).astype(np.uint8)

    return each(frames, lambda p, i, _: table(p)[p] if i == 0 else p)


def centre_of(p: np.ndarray) -> tuple[int, int]:
    """First column and row at which the running total reaches half of the plane's, halves rounded down."""
    x = p.astype(np.int64)
    half = int(x.sum()) // 2
    return int(np.argmax(np.cumsum(x.sum(0)) >= half)), int(np.argmax(np.cumsum(x.sum(1)) >= half))


def centre(frames: DataFrame) -> DataFrame:
    """Add cx and cy, the centre of the luma plane."""
    return mapped(frames, lambda parms, ps: (parms, ps, centre_of(ps[0])), "cx int, cy int", planes=False)


def centred(frames: DataFrame) -> DataFrame:
    """The frame on a black canvas of twice its sides, its luma centre in the middle; chroma moves by the same shift over its subsampling."""

    def run(parms, ps):
        cx, cy = centre_of(ps[0])
        px, py = int(parms["W"]) - cx, int(parms["H"]) - cy
        big = parms | {"W": str(2 * int(parms["W"])), "H": str(2 * int(parms["H"]))}
        out = [np.full(s, f, np.uint8) for s, f in zip(shapes(big), FILL, strict=True)]
        for canvas, p, (xs, ys) in zip(out, ps, factors(parms), strict=True):
            part = canvas[py // ys :, px // xs :][: p.shape[0], : p.shape[1]]
            part[:] = p[: part.shape[0], : part.shape[1]]
        return big, out, ()

    return mapped(frames, run)


def window(frames: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """The rectangle at (x0, y0) as a frame of its own; its edges should lie on whole chroma pixels."""

    def run(parms, ps):
        cut = [p[y0 // ys :, x0 // xs :][: h // ys, : w // xs] for p, (xs, ys) in zip(ps, factors(parms), strict=True)]
        return parms | {"W": str(w), "H": str(h)}, cut, ()

    return mapped(frames, run)


def overlaps(n: int, m: int) -> np.ndarray:
    """m x n shares of the input cells in the output cells of box scaling; a row sums to 1."""
    s, i, o = n / m, np.arange(n)[None, :], np.arange(m)[:, None]
    return np.maximum(0.0, np.minimum(i + 1, (o + 1) * s) - np.maximum(i, o * s)) / s


def scale(frames: DataFrame, w: int, h: int) -> DataFrame:
    """Box scaling: every output pixel is the overlap-weighted mean of the input, truncated."""

    def run(parms, ps):
        to = parms | {"W": str(w), "H": str(h)}
        return to, [np.floor((overlaps(p.shape[0], s[0]) @ p @ overlaps(p.shape[1], s[1]).T).round(9)) for p, s in zip(ps, shapes(to), strict=True)], ()

    return mapped(frames, run)


def to_float(frames: DataFrame) -> DataFrame:
    """Add ``floats``: three values for each luma pixel in raster order, chroma repeated over its subsampling, as packed doubles."""

    def run(parms, ps):
        h, w = ps[0].shape
        full = [p.repeat(ys, 0).repeat(xs, 1)[:h, :w] for p, (xs, ys) in zip(ps, factors(parms), strict=True)]
        return parms, ps, (np.stack(full, -1).astype("<f8").tobytes(),)

    return mapped(frames, run, "floats binary", planes=False)


def from_float(frames: DataFrame) -> DataFrame:
    """The frame from ``floats``: means over the subsampling, clamped to a byte and truncated."""

    def run(parms, raw):
        x = np.frombuffer(raw, "<f8").reshape(int(parms["H"]), int(parms["W"]), 3)
        out = []
        for i, ((h, w), (xs, ys)) in enumerate(zip(shapes(parms), factors(parms), strict=True)):
            boxes = x[: h * ys, : w * xs, i].reshape(h, ys, w, xs)
            out.append(np.clip(boxes.sum((1, 3)) / (xs * ys), 0, 255).astype(np.uint8))
        return out

    def batches_of(batches):
        for b in (x for whole in batches for x in pieces(whole)):
            got = [run(dict(p), f) for p, f in zip(b.column("parms").to_pylist(), b.column("floats").to_pylist(), strict=True)]
            cols = [pa.array([g[i].tobytes() for g in got], pa.binary()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("stream_id"), b.column("seq"), b.column("parms"), *cols], names=["stream_id", "seq", "parms", *PLANES])

    kind = frames.schema["stream_id"].dataType.simpleString()
    return frames.select("stream_id", "seq", "parms", "floats").mapInArrow(batches_of, f"stream_id {kind}, seq long, parms map<string,string>, y binary, cb binary, cr binary")


def line(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Pixels of the line between two points, both included.

    One step along the longer axis each, from its low end (vertical at a tie). With n steps there and m across, the other
    axis has moved (m i - (n + m) div 2) div n + 1 pixels after step i > 0.
    """
    across = abs(x1 - x0) > abs(y1 - y0)
    (a0, b0), (a1, b1) = ((x0, y0), (x1, y1)) if across else ((y0, x0), (y1, x1))
    if a1 < a0:
        a0, b0, a1, b1 = a1, b1, a0, b0
    n, m, way = a1 - a0, abs(b1 - b0), 1 if b1 >= b0 else -1
    moved = [(m * i - (n + m) // 2) // n + 1 if i else 0 for i in range(n + 1)]
    return [(a0 + i, b0 + way * k) if across else (b0 + way * k, a0 + i) for i, k in enumerate(moved)]


def draw(frames: DataFrame, points: list[tuple[int, int]], colour: tuple[int, int, int]) -> DataFrame:
    """Set single luma positions (x, y), and the chroma pixels over them, to a colour; those outside are left out."""

    def run(parms, ps):
        out = [p.copy() for p in ps]
        for p, (xs, ys), v in zip(out, factors(parms), colour, strict=True):
            for x, y in points:
                if 0 <= int(x / xs) < p.shape[1] and 0 <= int(y / ys) < p.shape[0]:
                    p[int(y / ys), int(x / xs)] = v
        return parms, out, ()

    return mapped(frames, run)


def draw_line(frames: DataFrame, x0: int, y0: int, x1: int, y1: int, colour: tuple[int, int, int]) -> DataFrame:
    """A line on every plane, on chroma between the ends over its subsampling. One with both ends past the same edge is not drawn."""

    def run(parms, ps):
        (h, w), out = ps[0].shape, [p.copy() for p in ps]
        if (x0 < 0 and x1 < 0) or (y0 < 0 and y1 < 0) or (x0 >= w and x1 >= w) or (y0 >= h and y1 >= h):
            return parms, out, ()
        for p, (xs, ys), v in zip(out, factors(parms), colour, strict=True):
            for x, y in line(int(x0 / xs), int(y0 / ys), int(x1 / xs), int(y1 / ys)):
                if 0 <= x < p.shape[1] and 0 <= y < p.shape[0]:
                    p[y, x] = v
        return parms, out, ()

    return mapped(frames, run)


def sampled(frames: DataFrame, order, cells: bool = False) -> DataFrame:
    """Add ``signals``: for each plane its values, a byte as -1 .. 1, by ``order(width, height)``: positions, or with ``cells`` lists of positions to average, an empty one as 0."""
    known: dict = {}

    def signal(p: np.ndarray) -> list[float]:
        h, w = p.shape
        if (w, h) not in known:
            made = order(w, h)
            if cells:
                known[w, h] = np.array([t for t, c in enumerate(made) for _ in c], np.int64), np.array([x for c in made for x in c], np.int64), np.array([len(c) for c in made])
            else:
                known[w, h] = np.array(made)
        flat = (p.ravel() - 128.0) / 128.0
        if not cells:
            return flat[known[w, h]].tolist()
        tag, at, n = known[w, h]
        return (np.bincount(tag, flat[at], len(n)) / np.maximum(n, 1)).tolist()

    return mapped(frames, lambda parms, ps: (parms, ps, ([signal(p) for p in ps],)), "signals array<array<double>>", planes=False)


def bent(frames: DataFrame, spans: DataFrame) -> DataFrame:
    """Time-bend: ``spans`` (stream_id, o, t0, t1, rate) say which stretch of the input each output frame takes in.

    A frame fades into the next over a unit of input time. An output boundary cuts the unit; every piece weighs the fade
    where it begins. The frame after a stream's last is black, as is what an output lacks of its unit of time.
    """
    s = spans.withColumn("at", F.explode(F.sequence(F.floor("t0"), F.greatest(F.floor("t0"), F.ceil("t1") - 1))))
    p = with_neighbour(frames, True).join(s.withColumnRenamed("stream_id", "_s"), (F.col("stream_id") == F.col("_s")) & (F.col("seq") == F.col("at")))
    a, b = F.greatest(F.col("seq").cast("double"), F.col("t0")), F.least(F.col("seq") + 1.0, F.col("t1"))
    p = p.withColumns({"_a": a - F.col("seq"), "_need": (b - a) / F.col("rate")}).where("_need > 0")
    late = F.col("_a") * F.col("_need")
    p = p.withColumns({"_p": (1 - F.col("_a")) * F.col("_need"), "_c": F.when(late > 1e-5, late).otherwise(0.0), "_lost": F.when(late > 1e-5, 0.0).otherwise(late), "seq": F.col("o")})
    return summed(p, ("_p", "_c"), (LOW, HIGH_C), 6, whole=1.0, lost="_lost")


def fixed_spans(frames: DataFrame, rate: float) -> DataFrame:
    """Spans of outputs at one rate, as many as the input frames reach."""
    first = F.floor(F.round(F.col("seq") / rate, 9)).cast("long")
    last = F.greatest(first, (F.ceil(F.round((F.col("seq") + 1) / rate, 9)) - 1).cast("long"))
    o = frames.select("stream_id", F.explode(F.sequence(first, last)).alias("o")).distinct()
    return o.select("stream_id", "o", (F.col("o") * rate).alias("t0"), ((F.col("o") + 1) * rate).alias("t1"), F.lit(rate).alias("rate"))
