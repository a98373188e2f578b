"""Colour conversions as column expressions; each takes and returns three columns.

Double forms keep the fraction; byte forms scale by whole 1/65536 steps, truncate and clamp. Hue and saturation of the
double and byte forms run over a byte's range, those of the unit forms from 0 to 1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]

#: Offsets and coefficients over 256 of the studio-range conversion.
TO_YUV = ((16.0, (65.738, 129.057, 25.064)), (128.0, (-37.945, -74.494, 112.439)), (128.0, (112.439, -94.154, -18.285)))
TO_RGB = ((-222.921, (298.082, 0.0, 408.583)), (135.576, (298.082, -100.291, -208.120)), (-276.836, (298.082, 516.412, 0.0)))


def _affine(rows, c: Triple) -> Triple:
    out = []
    for offset, coefs in rows:
        terms = [x * k / 256 for x, k in zip(c, coefs, strict=True) if k]
        out.append(sum(terms[1:], terms[0]) + offset)
    return tuple(out)


def f_rgb2yuv(c: Triple) -> Triple:
    return _affine(TO_YUV, c)


def f_yuv2rgb(c: Triple) -> Triple:
    return _affine(TO_RGB, c)


def f_rgb2hsv(c: Triple) -> Triple:
    r, g, b = c
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    turn = F.when(high == r, (g - b) / d).when(high == g, 2 + (b - r) / d).otherwise(4 + (r - g) / d)
    h = F.when(d == 0, 0.0).otherwise(turn * 256 / 6)
    s = F.when(high == 0, 0.0).otherwise(d / high * 255)
    return F.when(h < 0, h + 256).otherwise(h), s, high


def f_hsv2rgb(c: Triple) -> Triple:
    h, s, v = c
    turn = h * 6 / 256
    six = turn.cast("int")
    part, depth = turn - six, s / 255
    p, q, t = v * (1 - depth), v * (1 - depth * part), v * (1 - depth * (1 - part))

    def pick(*by_sextant):
        out = F.when(s == 0, v)
        for i, x in enumerate(by_sextant):
            out = out.when(six == i, x)
        return out

    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def f_yuv2hsv(c: Triple) -> Triple:
    return f_rgb2hsv(f_yuv2rgb(c))


def f_hsv2yuv(c: Triple) -> Triple:
    return f_rgb2yuv(f_hsv2rgb(c))


def _byte(x: Column, low: int = 0, high: int = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x.cast("int")))


def _scaled(rows, c: Triple, limits) -> Triple:
    out = []
    for (offset, coefs), (low, high) in zip(rows, limits, strict=True):
        total = F.lit(int(offset) if float(offset).is_integer() else offset)
        for x, k in zip(c, coefs, strict=True):
            step = F.shiftright(x.cast("long") * int(abs(k) * 256), 16)
            total = total + step if k > 0 else total - step if k else total
        out.append(_byte(total, low, high))
    return tuple(out)


def b_rgb2yuv(c: Triple) -> Triple:
    return _scaled(TO_YUV, c, ((16, 235), (16, 240), (16, 240)))


def b_yuv2rgb(c: Triple) -> Triple:
    return _scaled(TO_RGB, c, ((0, 255),) * 3)


def _through(f):
    def run(c: Triple) -> Triple:
        return tuple(_byte(x) for x in f(tuple(x.cast("double") for x in c)))

    return run


b_rgb2hsv, b_hsv2rgb, b_yuv2hsv, b_hsv2yuv = (_through(f) for f in (f_rgb2hsv, f_hsv2rgb, f_yuv2hsv, f_hsv2yuv))


def _unit_hue(r, g, b, high, d) -> Column:
    turn = F.when(high == r, (g - b) / d + F.when(g < b, 6).otherwise(0)).when(high == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    return F.when(d == 0, 0.0).otherwise(turn / 6)


def rgb2hsl(c: Triple) -> Triple:
    r, g, b = (x / 255 for x in c)
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = high - low, (high + low) / 2
    s = F.when(d == 0, 0.0).when(light > 0.5, d / (2 - high - low)).otherwise(d / (high + low))
    return _unit_hue(r, g, b, high, d), s, light


def hsl2rgb(c: Triple) -> Triple:
    h, s, light = c
    q = F.when(light < 0.5, light * (1 + s)).otherwise(light + s - light * s)
    p = 2 * light - q

    def channel(t: Column) -> Column:
        t = F.when(t < 0, t + 1).when(t > 1, t - 1).otherwise(t)
        ramp = F.when(t < 1 / 6, p + (q - p) * 6 * t).when(t < 1 / 2, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6).otherwise(p)
        return F.when(s == 0, light).otherwise(ramp) * 255

    return channel(h + 1 / 3), channel(h), channel(h - 1 / 3)


def rgb2hsv(c: Triple) -> Triple:
    r, g, b = (x / 255 for x in c)
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    return _unit_hue(r, g, b, high, d), F.when(high == 0, 0.0).otherwise(d / high), high


def hsv2rgb(c: Triple) -> Triple:
    h, s, v = c
    turn = F.floor(h * 6)
    f = h * 6 - turn
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)

    def pick(*by_sextant):
        out = F.lit(None).cast("double")
        for i, x in enumerate(by_sextant):
            out = F.when(turn % 6 == i, x).otherwise(out)
        return out * 255

    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def heat(v: Column, alpha: float) -> Column:
    """The heat colour of a value in 0..1 as an rgba() string; values outside are held at the ends."""
    x = F.greatest(F.lit(0.0), F.least(v, F.lit(1.0)))
    rgb = hsv2rgb((1 - x, F.lit(1.0), x))
    return F.concat(F.lit("rgba("), F.concat_ws(",", *[F.floor(c).cast("string") for c in rgb]), F.lit(f",{alpha})"))


def parse_rgb(spec: Column) -> Column:
    """Struct r, g, b of ``#rgb``, ``#rrggbb`` or ``r,g,b``; null for anything else."""
    digit = lambda at, n: F.conv(F.repeat(F.substring(spec, at, n), 3 - n), 16, 10).cast("int")
    short = F.struct(*[digit(2 + i, 1).alias(k) for i, k in enumerate("rgb")])
    long = F.struct(*[digit(2 + 2 * i, 2).alias(k) for i, k in enumerate("rgb")])
    part = F.split(spec, ",")
    plain = F.struct(*[F.get(part, i).try_cast("int").alias(k) for i, k in enumerate("rgb")])
    legal = spec.rlike(r"^\s*[+-]?\d{1,9},\s*[+-]?\d{1,9},\s*[+-]?\d{1,9}$") & plain["r"].between(0, 255) & plain["g"].between(0, 255) & plain["b"].between(0, 255)
    return F.when(spec.rlike("^#[0-9a-fA-F]{3}$"), short).when(spec.rlike("^#[0-9a-fA-F]{6}$"), long).when(legal, plain)
