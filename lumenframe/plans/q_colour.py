"""Colour queries over byte triples from lineitem keys."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import colour as c
from lumenframe.plans.registry import query
from lumenframe.sources.tables import SQL_TRIPLES, triples

IN = ("r", "g", "b")
ID = "l_orderkey, l_linenumber"
SOURCE = f"SELECT {ID}, r::DOUBLE AS a, g::DOUBLE AS b, b::DOUBLE AS c FROM triples"
BYTES = f"SELECT {ID}, r AS a, g AS b, b AS c FROM triples"


def _affine(rows):
    def run(src: str) -> str:
        cols = [f"{' '.join(f'{'+' if k > 0 else '-'} {x} * {abs(k)!r} / 256' for x, k in zip('abc', ks) if k)} + ({o!r}) AS {n}" for n, (o, ks) in zip("abc", rows)]
        return f"SELECT {ID}, {', '.join(x.removeprefix('+ ') for x in cols)} FROM ({src})"

    return run


f_yuv, f_rgb = _affine(c.TO_YUV), _affine(c.TO_RGB)


def f_hsv(src: str) -> str:
    return f"""SELECT {ID}, CASE WHEN h < 0 THEN h + 256 ELSE h END AS a, CASE WHEN mx = 0 THEN 0 ELSE (mx - mn) / mx * 255 END AS b, mx AS c FROM (
  SELECT *, CASE WHEN mx = mn THEN 0 WHEN mx = a THEN (b - c) / (mx - mn) WHEN mx = b THEN 2 + (c - a) / (mx - mn) ELSE 4 + (a - b) / (mx - mn) END * 256 / 6 AS h
  FROM (SELECT *, greatest(a, b, c) AS mx, least(a, b, c) AS mn FROM ({src})))"""


def f_back(src: str) -> str:
    return f"""SELECT {ID}, CASE WHEN b = 0 THEN c WHEN i = 0 THEN c WHEN i = 1 THEN q WHEN i = 2 THEN p WHEN i = 3 THEN p WHEN i = 4 THEN t WHEN i = 5 THEN c END AS a,
  CASE WHEN b = 0 THEN c WHEN i = 0 THEN t WHEN i = 1 THEN c WHEN i = 2 THEN c WHEN i = 3 THEN q WHEN i = 4 THEN p WHEN i = 5 THEN p END AS b,
  CASE WHEN b = 0 THEN c WHEN i = 0 THEN p WHEN i = 1 THEN p WHEN i = 2 THEN t WHEN i = 3 THEN c WHEN i = 4 THEN c WHEN i = 5 THEN q END AS c
FROM (SELECT *, c * (1 - b / 255) AS p, c * (1 - b / 255 * f) AS q, c * (1 - b / 255 * (1 - f)) AS t
  FROM (SELECT *, a * 6 / 256 - trunc(a * 6 / 256) AS f, trunc(a * 6 / 256) AS i FROM ({src})))"""


def b_affine(rows, limits):
    def run(src: str) -> str:
        cols = [f"CAST(greatest({lo}, least({hi}, trunc({o!r} {' '.join(f'{'+' if k > 0 else '-'} (({x}::BIGINT * {int(abs(k) * 256)}) >> 16)' for x, k in zip('abc', ks) if k)}))) AS INTEGER) AS {n}" for n, (o, ks), (lo, hi) in zip("abc", rows, limits)]
        return f"SELECT {ID}, {', '.join(cols)} FROM ({src})"

    return run


def as_bytes(src: str) -> str:
    return f"SELECT {ID}, {', '.join(f'CAST(greatest(0, least(255, trunc({x}))) AS INTEGER) AS {x}' for x in 'abc')} FROM ({src})"


SQL = {
    "f_rgb2yuv": f_yuv(SOURCE),
    "f_yuv2rgb": f_rgb(SOURCE),
    "f_rgb2hsv": f_hsv(SOURCE),
    "f_hsv2rgb": f_back(SOURCE),
    "f_yuv2hsv": f_hsv(f_rgb(SOURCE)),
    "f_hsv2yuv": f_yuv(f_back(SOURCE)),
    "b_rgb2yuv": b_affine(c.TO_YUV, ((16, 235), (16, 240), (16, 240)))(BYTES),
    "b_yuv2rgb": b_affine(c.TO_RGB, ((0, 255),) * 3)(BYTES),
    "b_rgb2hsv": as_bytes(f_hsv(SOURCE)),
    "b_hsv2rgb": as_bytes(f_back(SOURCE)),
    "b_yuv2hsv": as_bytes(f_hsv(f_rgb(SOURCE))),
    "b_hsv2yuv": as_bytes(f_yuv(f_back(SOURCE))),
}


def _conversion(name: str):
    exact = name.startswith("f_")
    cols = ", ".join(f"round({x}, 6) AS {x}" if exact else x for x in "abc")

    @query(f"colour_{name}", f"WITH {SQL_TRIPLES} SELECT {ID}, {cols} FROM ({SQL[name]})")
    def run(spark, d):
        src = tuple(F.col(x).cast("double") if exact else F.col(x) for x in IN)
        out = getattr(c, name)(src)
        return triples(spark, d).select("l_orderkey", "l_linenumber", *[(F.round(x, 6) if exact else x).alias(k) for x, k in zip(out, "abc", strict=True)])


for _name in SQL:
    _conversion(_name)


@query("colour_array", f"WITH {SQL_TRIPLES} SELECT l_orderkey, count(*) AS n, round(sum(a), 4) AS a, round(sum(b), 4) AS b, round(sum(c), 4) AS c FROM ({f_yuv(SOURCE)}) GROUP BY l_orderkey")
def colour_array(spark, d):
    """An order's colours converted as one array; the sums of the converted channels."""
    packed = triples(spark, d).groupBy("l_orderkey").agg(F.collect_list(F.struct("r", "g", "b")).alias("px"))
    conv = F.transform("px", lambda p: F.struct(*[x.alias(k) for x, k in zip(c.f_rgb2yuv(tuple(p[i].cast("double") for i in IN)), "abc", strict=True)]))
    done = packed.select("l_orderkey", F.size("px").cast("long").alias("n"), conv.alias("px"))
    total = lambda k: F.aggregate(F.transform("px", lambda p: p[k]), F.lit(0.0), lambda s, x: s + x)
    return done.select("l_orderkey", "n", *[F.round(total(k), 4).alias(k) for k in "abc"])


@query("colour_f2b", f"WITH {SQL_TRIPLES} SELECT l_orderkey, l_linenumber, {', '.join(f'CAST(greatest(0, least(255, trunc({x} * 1.25::DOUBLE - 20.5))) AS INTEGER) AS {x}' for x in IN)} FROM triples")
def colour_f2b(spark, d):
    return triples(spark, d).select("l_orderkey", "l_linenumber", *[c._byte(F.col(x) * 1.25 - 20.5).alias(x) for x in IN])


@query(
    "parse_rgb",
    f"""WITH {SQL_TRIPLES}, s AS (SELECT l_orderkey, l_linenumber, r, g, b, l_linenumber % 4 AS kind FROM triples)
SELECT l_orderkey, l_linenumber,
  CASE kind WHEN 0 THEN r WHEN 1 THEN r WHEN 2 THEN (r % 16) * 17 END AS r, CASE kind WHEN 0 THEN g WHEN 1 THEN g WHEN 2 THEN (g % 16) * 17 END AS g,
  CASE kind WHEN 0 THEN b WHEN 1 THEN b WHEN 2 THEN (b % 16) * 17 END AS b FROM s""",
)
def parse_rgb(spark, d):
    """Specs of the kinds r,g,b / #rrggbb / #rgb, and one that is none of them."""
    t = triples(spark, d)
    kind = F.col("l_linenumber") % 4
    hexes = lambda n, m: F.concat(F.lit("#"), *[F.lpad(F.lower(F.hex(F.col(x) % m)), n, "0") for x in IN])
    spec = F.when(kind == 0, F.concat_ws(",", *IN)).when(kind == 1, hexes(2, 256)).when(kind == 2, hexes(1, 16)).otherwise(F.concat(F.lit("rgb "), F.col("r")))
    got = c.parse_rgb(F.col("spec"))
    return t.withColumn("spec", spec).select("l_orderkey", "l_linenumber", *[got[x].alias(x) for x in IN])


UNIT = f"SELECT {ID}, a, b, c, greatest(a, b, c) AS mx, least(a, b, c) AS mn FROM (SELECT {ID}, r / 255.0::DOUBLE AS a, g / 255.0::DOUBLE AS b, b / 255.0::DOUBLE AS c FROM triples)"
HUE = "CASE WHEN mx = mn THEN 0 WHEN mx = a THEN (b - c) / (mx - mn) + (CASE WHEN b < c THEN 6 ELSE 0 END) WHEN mx = b THEN (c - a) / (mx - mn) + 2 ELSE (a - b) / (mx - mn) + 4 END / 6.0::DOUBLE"


@query(
    "js_hsl",
    f"""WITH {SQL_TRIPLES} SELECT {ID}, round({HUE}, 6) AS h,
  round(CASE WHEN mx = mn THEN 0 WHEN (mx + mn) / 2 > 0.5 THEN (mx - mn) / (2 - mx - mn) ELSE (mx - mn) / (mx + mn) END, 6) AS s, round((mx + mn) / 2, 6) AS l,
  round(a * 255, 4) AS r, round(b * 255, 4) AS g, round(c * 255, 4) AS b FROM ({UNIT})""",
)
def js_hsl(spark, d):
    """Hue, saturation and lightness, and the way back to the colour."""
    hsl = c.rgb2hsl(tuple(F.col(x).cast("double") for x in IN))
    t = triples(spark, d).select("l_orderkey", "l_linenumber", *[x.alias(k) for x, k in zip(hsl, "hsl", strict=True)])
    back = c.hsl2rgb((F.col("h"), F.col("s"), F.col("l")))
    return t.select("l_orderkey", "l_linenumber", *[F.round(k, 6).alias(k) for k in "hsl"], *[F.round(x, 4).alias(k) for x, k in zip(back, IN, strict=True)])


@query(
    "js_hsv",
    f"""WITH {SQL_TRIPLES} SELECT {ID}, round({HUE}, 6) AS h, round(CASE WHEN mx = 0 THEN 0 ELSE (mx - mn) / mx END, 6) AS s, round(mx, 6) AS v,
  round(a * 255, 4) AS r, round(b * 255, 4) AS g, round(c * 255, 4) AS b FROM ({UNIT})""",
)
def js_hsv(spark, d):
    hsv = c.rgb2hsv(tuple(F.col(x).cast("double") for x in IN))
    t = triples(spark, d).select("l_orderkey", "l_linenumber", *[x.alias(k) for x, k in zip(hsv, "hsv", strict=True)])
    back = c.hsv2rgb((F.col("h"), F.col("s"), F.col("v")))
    return t.select("l_orderkey", "l_linenumber", *[F.round(k, 6).alias(k) for k in "hsv"], *[F.round(x, 4).alias(k) for x, k in zip(back, IN, strict=True)])


@query(
    "heat_colour",
    f"""WITH {SQL_TRIPLES}, u AS (SELECT {ID}, r / 255.0::DOUBLE AS v, 1 - r / 255.0::DOUBLE AS h FROM triples),
k AS (SELECT *, CAST(floor(h * 6) AS INTEGER) % 6 AS i, h * 6 - floor(h * 6) AS f FROM u)
SELECT {ID}, 'rgba(' || CAST(floor(CASE i WHEN 0 THEN v WHEN 1 THEN v * (1 - f) WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN v * (1 - (1 - f)) ELSE v END * 255) AS INTEGER) || ',' ||
  CAST(floor(CASE i WHEN 0 THEN v * (1 - (1 - f)) WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN v * (1 - f) ELSE 0 END * 255) AS INTEGER) || ',' ||
  CAST(floor(CASE i WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN v * (1 - (1 - f)) WHEN 3 THEN v WHEN 4 THEN v ELSE v * (1 - f) END * 255) AS INTEGER) || ',0.9)' AS colour FROM k""",
)
def heat_colour(spark, d):
    return triples(spark, d).select("l_orderkey", "l_linenumber", c.heat(F.col("r") / 255.0, 0.9).alias("colour"))


@query(
    "upsample_rgb",
    f"""WITH {SQL_TRIPLES} SELECT {ID}, {', '.join(f"CAST(greatest(0, least(255, trunc({o!r} {' '.join(f'{'+' if k > 0 else '-'} (({x}::BIGINT * {int(abs(k) * 256)}) >> 16)' for x, k in zip(('y', 'u', 'v'), ks) if k)}))) AS INTEGER) AS {n}" for n, (o, ks) in zip('rgb', c.TO_RGB))}
FROM (SELECT l_orderkey, l_linenumber, r AS y, min(g) OVER w AS u, min(b) OVER w AS v FROM triples WINDOW w AS (PARTITION BY l_orderkey, l_linenumber // 2))""",
)
def upsample_rgb(spark, d):
    """Neighbouring lines share one chroma, the least among them: nearest upsampling, then bytes of RGB."""
    w = Window.partitionBy("l_orderkey", F.floor(F.col("l_linenumber") / 2))
    t = triples(spark, d).select("l_orderkey", "l_linenumber", F.col("r").alias("y"), F.min("g").over(w).alias("u"), F.min("b").over(w).alias("v"))
    out = c.b_yuv2rgb((F.col("y"), F.col("u"), F.col("v")))
    return t.select("l_orderkey", "l_linenumber", *[x.alias(k) for x, k in zip(out, "rgb", strict=True)])
