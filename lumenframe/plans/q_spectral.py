"""Samplers, spectra, profiles and signatures over the embeddings as 8 x 8 planes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenframe.functions import signature as sig
from lumenframe.operators import blocks, planes, samplers, space, spectral
from lumenframe.operators.series import translated
from lumenframe.plans.q_frames import BY as PLANE
from lumenframe.plans.q_frames import ROWS, rows
from lumenframe.plans.registry import query, table
from lumenframe.sources import audio, y4m
from lumenframe.sources.tables import SQL_PIXELS, SQL_PLANES, SQL_SERIES, numbered, planar, series
from lumenframe.streaming import run


def _text(a, digits: int = 7):
    return F.array_join(F.transform(a, lambda x: F.format_string(f"%.{digits}f", F.round(x, digits))), ",")


def luma(spark, d, order, cells: bool = False):
    """(stream_id, seq, signal): the luma planes in a sampler's order."""
    return planes.sampled(planar(spark, d), order, cells).select("stream_id", "seq", F.col("signals")[0].alias("signal"))


def _sampler(name: str, order: str):
    @query(f"sampler_{name}", f"WITH {SQL_PIXELS} SELECT stream_id, seq, string_agg(printf('%.7f', (v - 128) / 128.0::DOUBLE), ',' ORDER BY {order}) AS signal FROM pixels GROUP BY stream_id, seq")
    def run(spark, d):
        return luma(spark, d, samplers.named(name)).select("stream_id", "seq", _text("signal").alias("signal"))


_sampler("raster", "pos")
_sampler("weave", "y * 8 + CASE WHEN y % 2 = 1 THEN 7 - x ELSE x END")
_sampler("zigzag", "x + y, CASE WHEN (x + y) % 2 = 1 THEN y ELSE x END")


def _cells_sql(side: int, a: float, r: float) -> str:
    """points (tag, px, py) of the spiral and tags (x, y, tag), the nearest point of every pixel, of equals the first."""
    at = lambda f, x, y: f"{side // 2} + CAST(trunc({f}({x}) * ({y})) AS INTEGER)"
    return f"""walk AS (SELECT 0 AS n, 0.0::DOUBLE AS a, 1.0::DOUBLE AS r, {at('sin', '0.0', '1.0')} AS px, {at('cos', '0.0', '1.0')} AS py
  UNION ALL SELECT n + 1, a + {a}::DOUBLE / r, r + {r}::DOUBLE / r, {at('sin', f'a + {a}::DOUBLE / r', f'r + {r}::DOUBLE / r')}, {at('cos', f'a + {a}::DOUBLE / r', f'r + {r}::DOUBLE / r')}
  FROM walk WHERE px >= 0 AND px < {side} AND py >= 0 AND py <= {side}),
moves AS (SELECT n, px, py, lag(px, 1, 0) OVER (ORDER BY n) AS lx, lag(py, 1, 0) OVER (ORDER BY n) AS ly FROM walk),
points AS (SELECT row_number() OVER (ORDER BY n) - 1 AS tag, px, py FROM moves WHERE (px <> lx OR py <> ly) AND px >= 0 AND px < {side} AND py >= 0 AND py <= {side}),
tags AS (SELECT x, y, arg_min(tag, ((x - px) * (x - px) + (y - py) * (y - py)) * 1000000 + tag) AS tag FROM range({side}) b(x), range({side}) c(y), points GROUP BY x, y)"""


@query(
    "sampler_spiral",
    f"""WITH RECURSIVE {SQL_PIXELS}, {_cells_sql(8, 1.5, 0.6)}, sizes AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag),
kept AS (SELECT tag FROM sizes WHERE n <= 64 // (SELECT count(*) FROM points) * 4.0),
slots AS (SELECT unnest(range((SELECT max(tag) FROM kept) + 1)) AS slot),
means AS (SELECT stream_id, seq, t.tag, avg((v - 128) / 128.0::DOUBLE) AS m FROM pixels p JOIN tags t ON t.x = p.x AND t.y = p.y JOIN kept k ON k.tag = t.tag GROUP BY stream_id, seq, t.tag),
every AS (SELECT stream_id, seq, slot FROM (SELECT DISTINCT stream_id, seq FROM pixels), slots)
SELECT e.stream_id, e.seq, string_agg(printf('%.7f', round(coalesce(m, 0), 7)), ',' ORDER BY slot) AS signal FROM every e LEFT JOIN means n ON n.stream_id = e.stream_id AND n.seq = e.seq AND n.tag = slot GROUP BY e.stream_id, e.seq""",
)
def sampler_spiral(spark, d):
    cells = lambda w, h: samplers.spiral(w, h, a_rate=1.5, r_rate=0.6, area_limit=4.0)
    return luma(spark, d, cells, True).select("stream_id", "seq", _text("signal").alias("signal"))


@query(
    "voronoi_map",
    """WITH sites AS (SELECT c_custkey AS tag, c_custkey * 37 % 256 AS sx, c_custkey * 101 % 241 AS sy FROM customer),
pixels AS (SELECT DISTINCT p_partkey * 7 % 256 AS x, p_partkey * 11 % 241 AS y FROM part)
SELECT x, y, arg_min(tag, ((x - sx) * (x - sx) + (y - sy) * (y - sy)) * 1000000000 + tag) AS tag FROM pixels, sites GROUP BY x, y""",
)
def voronoi_map(spark, d):
    """The cell of every pixel that a part names on a plane of 256 x 241 with a site for each customer; of equally near sites the first."""
    c, p = F.col("c_custkey"), F.col("p_partkey")
    sites = table(spark, d, "customer").select(c.alias("tag"), (c * 37 % 256).alias("x"), (c * 101 % 241).alias("y"))
    pixels = table(spark, d, "part").select((p * 7 % 256).alias("x"), (p * 11 % 241).alias("y")).distinct()
    near = space.nearest(pixels.withColumn("tag", F.col("y") * 256 + F.col("x")), sites, 256, 241)
    return near.select((F.col("tag") % 256).alias("x"), F.floor(F.col("tag") / 256).alias("y"), F.col("target").alias("tag"))


def spectra(spark, d, compat: bool = False):
    return luma(spark, d, samplers.raster).select("stream_id", "seq", spectral.magnitudes(compat=compat)("signal").alias("spectrum"))


def _dft(limit: str = "") -> str:
    return f"""{SQL_PIXELS}, bins AS (SELECT unnest(range(1, 32)) AS k), spectrum AS (
  SELECT stream_id, seq, k - 1 AS bin, sqrt(power(sum((v - 128) / 128.0::DOUBLE * cos(2 * pi() * k * pos / 64)), 2) + power(sum((v - 128) / 128.0::DOUBLE * sin(2 * pi() * k * pos / 64)), 2)) AS m
  FROM pixels, bins {limit} GROUP BY stream_id, seq, k)"""


def _long(df, value: str, name: str):
    t = df.select("stream_id", "seq", F.posexplode(value).alias("bin", "x"))
    return t.select("stream_id", "seq", F.col("bin").cast("long").alias("bin"), F.round("x", 7).alias(name))


@query("spectrum", f"WITH {_dft()} SELECT stream_id, seq, bin, round(m, 7) AS m FROM spectrum")
def spectrum(spark, d):
    return _long(spectra(spark, d), "spectrum", "m")


@query("spectrum_compat", f"WITH {_dft('WHERE pos < 8')} SELECT stream_id, seq, bin, round(m, 7) AS m FROM spectrum")
def spectrum_compat(spark, d):
    return _long(spectra(spark, d, compat=True), "spectrum", "m")


@query("spectrogram_norm", f"WITH {_dft()}, r AS (SELECT min(m) AS lo, max(m) AS hi FROM spectrum) SELECT stream_id, seq, bin, round(greatest(0, least(1, (m - lo) / (hi - lo) * 30)), 7) AS level FROM spectrum, r")
def spectrogram_norm(spark, d):
    """Magnitudes between the least and greatest of all, raised thirty times and held at 1. The range is one row."""
    s = spectra(spark, d)
    r = s.agg(F.min(F.array_min("spectrum")).alias("lo"), F.max(F.array_max("spectrum")).alias("hi"))
    level = F.transform("spectrum", lambda m: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (m - F.col("lo")) / (F.col("hi") - F.col("lo")) * 30)))
    return _long(s.join(F.broadcast(r)).withColumn("level", level), "level", "level")


SQL_BASE = f"{_dft()}, base AS (SELECT stream_id, bin, exp(avg(CASE WHEN m <= 0 THEN -100 ELSE ln(m) END)) AS level FROM spectrum GROUP BY stream_id, bin)"


@query("profile_baseline", f"WITH {SQL_BASE} SELECT stream_id, bin, round(level, 6) AS level FROM base")
def profile_baseline(spark, d):
    b = spectral.baseline(spectra(spark, d), "stream_id")
    return b.select("stream_id", F.col("bin").cast("long").alias("bin"), F.round("level", 6).alias("level"))


@query("make_profile", f"WITH {SQL_BASE} SELECT stream_id, '{{\"width\":8,\"height\":8,\"sampler\":\"raster\",\"baseline\":[[' || string_agg(CAST(CAST(round(level * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY bin) || ']]}}' AS profile FROM base GROUP BY stream_id")
def make_profile(spark, d):
    """A stream's profile as JSON, levels in whole thousandths."""
    b = spectral.packed_baseline(spectra(spark, d), "stream_id")
    levels = F.array(F.transform("baseline", lambda x: F.round(x * 1000).cast("long")))
    return b.select("stream_id", F.to_json(F.struct(F.lit(8).alias("width"), F.lit(8).alias("height"), F.lit("raster").alias("sampler"), levels.alias("baseline"))).alias("profile"))


@query("json_profile", f"WITH {SQL_BASE} SELECT stream_id, 8 AS width, 'raster' AS sampler, 1 AS smooth, CAST(count(*) AS INTEGER) AS bins, round(sum(round(level * 1000)), 4) AS total FROM base GROUP BY stream_id")
def json_profile(spark, d):
    """A profile read back; a span that it does not give is 1."""
    schema = "width int, height int, sampler string, smooth int, baseline array<array<double>>"
    p = make_profile(spark, d).select("stream_id", F.from_json("profile", schema).alias("p"))
    row = F.col("p.baseline")[0]
    return p.select("stream_id", "p.width", "p.sampler", F.coalesce("p.smooth", F.lit(1)).alias("smooth"), F.size(row).alias("bins"), F.round(F.aggregate(row, F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


def normal(spark, d):
    """Spectra over their stream's baseline; a profile is a row for each stream."""
    s = spectra(spark, d)
    b = spectral.packed_baseline(s, "stream_id")
    return s.join(b, "stream_id").select("stream_id", "seq", spectral.normalised(F.col("spectrum"), F.col("baseline")).alias("norm"))


SQL_NORM = f"{SQL_BASE}, norm AS (SELECT stream_id, seq, bin, m / level AS v FROM spectrum JOIN base USING (stream_id, bin))"


@query("normalise", f"WITH {SQL_NORM} SELECT stream_id, seq, bin, round(v, 7) AS v FROM norm")
def normalise(spark, d):
    return _long(normal(spark, d), "norm", "v")


SQL_SIGNATURE = f"""{SQL_NORM}, diff AS (SELECT stream_id, seq, bin, v - exp(avg(ln(greatest(v, 1e-300::DOUBLE))) OVER (PARTITION BY stream_id, seq ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING)) AS v FROM norm),
cells AS (SELECT stream_id, seq, i, sum(v * (least(bin + 1, (i + 1) * (31 / 256.0::DOUBLE)) - greatest(bin, i * (31 / 256.0::DOUBLE)))) / (31 / 256.0::DOUBLE) AS v
  FROM diff JOIN range(256) o(i) ON bin < (i + 1) * (31 / 256.0::DOUBLE) AND bin + 1 > i * (31 / 256.0::DOUBLE) GROUP BY stream_id, seq, i),
signatures AS (SELECT stream_id, seq, string_agg(CASE WHEN round(v, 9) > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS signature FROM cells GROUP BY stream_id, seq)"""


def signatures(spark, d):
    return normal(spark, d).select("stream_id", "seq", spectral.signatures(7)("norm").alias("signature"))


@query("signature", f"WITH {SQL_SIGNATURE} SELECT stream_id, seq, signature FROM signatures")
def signature(spark, d):
    return signatures(spark, d)


@query(
    "signature_std",
    f"""WITH {SQL_NORM}, r AS (SELECT stream_id, seq, i, sum(v * (least(bin + 1, (i + 1) * (31 / 256.0::DOUBLE)) - greatest(bin, i * (31 / 256.0::DOUBLE)))) / (31 / 256.0::DOUBLE) AS v
  FROM norm JOIN range(256) o(i) ON bin < (i + 1) * (31 / 256.0::DOUBLE) AND bin + 1 > i * (31 / 256.0::DOUBLE) GROUP BY stream_id, seq, i),
s AS (SELECT stream_id, seq, i, v - exp(avg(ln(greatest(v, 1e-300::DOUBLE))) OVER (PARTITION BY stream_id, seq ORDER BY i ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) AS v FROM r)
SELECT stream_id, seq, string_agg(CASE WHEN round(v, 9) > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS signature FROM s GROUP BY stream_id, seq""",
)
def signature_std(spark, d):
    """Resampled first, then compared with its smoothed self, span 15."""
    return normal(spark, d).select("stream_id", "seq", spectral.signatures(15, ceil=True, smooth_first=False)("norm").alias("signature"))


XOR = " + ".join(f"bit_count(xor(CAST(('0b' || substr(a.signature, {1 + 32 * i}, 32)) AS BIGINT), CAST(('0b' || substr(b.signature, {1 + 32 * i}, 32)) AS BIGINT)))::INTEGER" for i in range(8))


@query(
    "signature_nearest",
    f"""WITH {SQL_SIGNATURE}, p AS (SELECT a.stream_id, a.seq, b.seq AS other, {XOR} AS bits FROM signatures a JOIN signatures b ON a.stream_id = b.stream_id AND b.seq < a.seq)
SELECT stream_id, seq, arg_min(other, CAST(bits AS BIGINT) * 1000000000 + other) AS nearest, min(bits) AS bits FROM p GROUP BY stream_id, seq""",
)
def signature_nearest(spark, d):
    """Of all frames before a frame, that with the nearest signature, the earliest among equals."""
    return sig.nearest_before(signatures(spark, d), "stream_id", "seq").select("stream_id", "seq", "nearest", "bits")


@query(
    "y4m_signature_nearest",
    f"""WITH {SQL_SIGNATURE}, p AS (SELECT a.stream_id, a.seq, b.seq AS other, {XOR} AS bits FROM signatures a JOIN signatures b ON a.stream_id = b.stream_id AND b.seq < a.seq)
SELECT CAST(stream_id AS VARCHAR) AS stream_id, seq, arg_min(other, CAST(bits AS BIGINT) * 1000000000 + other) AS nearest, min(bits) AS bits FROM p GROUP BY stream_id, seq""",
)
def y4m_signature_nearest(spark, d):
    """From files to neighbours: streams written as YUV4MPEG2, scanned, sampled, transformed, normalised by their profile, signed and compared."""
    path = f"{run.folder(spark)}/y4m-{uuid.uuid4().hex}"
    y4m.write(planar(spark, d).withColumn("stream_id", F.col("stream_id").cast("string")), path)
    spark.dataSource.register(y4m.Y4mSource)
    f = planes.sampled(spark.read.format("y4m").load(path), samplers.raster).select("stream_id", "seq", F.col("signals")[0].alias("signal"))
    s = f.select("stream_id", "seq", spectral.magnitudes()("signal").alias("spectrum"))
    norm = s.join(spectral.packed_baseline(s, "stream_id"), "stream_id").select("stream_id", "seq", spectral.normalised(F.col("spectrum"), F.col("baseline")).alias("norm"))
    return sig.nearest_before(norm.select("stream_id", "seq", spectral.signatures(7)("norm").alias("signature")), "stream_id", "seq").select("stream_id", "seq", "nearest", "bits")


@query(
    "hamming_pairs",
    f"""WITH {SQL_SIGNATURE}, p AS (SELECT a.stream_id, b.seq AS first, a.seq AS second, {XOR} AS bits FROM signatures a JOIN signatures b ON a.stream_id = b.stream_id AND b.seq < a.seq) SELECT * FROM p WHERE bits <= 80""",
)
def hamming_pairs(spark, d):
    """Pairs of frames of a stream whose signatures differ in at most 80 bits."""
    return sig.pairs_within(signatures(spark, d), "stream_id", "seq", 80)


SQL_STFT = """WITH s AS (SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i, value AS v FROM events),
b AS (SELECT channel, i // 32 AS blk, i % 32 AS j, v FROM s), n AS (SELECT channel, max(i) // 32 AS last FROM s GROUP BY channel),
w AS (SELECT channel, blk AS frame, j AS p, v FROM b UNION ALL SELECT channel, blk - 1, j + 32, v FROM b WHERE blk > 0),
f AS (SELECT w.channel, frame, p, v * 0.5 * (1 - cos(2 * pi() * p / 63)) AS v FROM w JOIN n ON n.channel = w.channel WHERE frame < n.last),
m AS (SELECT channel, frame, k, sqrt(power(sum(v * cos(2 * pi() * k * p / 64)), 2) + power(sum(v * sin(2 * pi() * k * p / 64)), 2)) AS m FROM f, range(1, 32) t(k) GROUP BY channel, frame, k)
SELECT channel, frame, (k - 1) // 4 AS band, round(avg(m), 6) AS level FROM m GROUP BY channel, frame, (k - 1) // 4"""


@query(
    "stft",
    SQL_STFT,
)
def stft(spark, d):
    """Spectra of half-overlapping, windowed frames of 64 values for each event type, the last block filled up with zeros, averaged by four bins."""
    e = spark.read.parquet(f"{d}/events.parquet")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    s = numbered(e, "event_type", day, ["ts", "event_id"]).select(F.col("event_type").alias("channel"), F.col("seq").alias("i"), F.col("value").alias("v"))
    return _bands(spectral.overlapping(s, "channel", 32))


def _bands(f):
    m = f.select("channel", "frame", spectral.magnitudes(window=True)("signal").alias("m"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("m", k * 4 + 1, 4))
    mean = F.transform(bands, lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y) / F.size(x))
    t = m.select("channel", "frame", F.posexplode(mean).alias("band", "level"))
    return t.select("channel", "frame", F.col("band").cast("long").alias("band"), F.round("level", 6).alias("level"))


@query("audio_stft", SQL_STFT)
def audio_stft(spark, d):
    """The same spectra from audio files: a file of samples for each event type, scanned in overlapping blocks."""
    e = spark.read.parquet(f"{d}/events.parquet")
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000)
    s = numbered(e, "event_type", day, ["ts", "event_id"]).select(F.col("event_type").alias("stream_id"), F.col("seq").alias("i"), F.array("value").alias("samples"))
    path = f"{run.folder(spark)}/wav-{uuid.uuid4().hex}"
    audio.write(s, path)
    return _bands(audio.load(spark, path, 32).select(F.col("stream_id").alias("channel"), "frame", F.col("samples").alias("signal")))


SQL_RATES = f"""{SQL_PLANES}, rates AS (SELECT stream_id, seq AS o, 0.5::DOUBLE + 1.5::DOUBLE * (avg(v) / 255) AS rate FROM planes WHERE plane = 0 GROUP BY stream_id, seq),
spans AS (SELECT stream_id, o, rate, coalesce(sum(rate) OVER (PARTITION BY stream_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t0, sum(rate) OVER (PARTITION BY stream_id ORDER BY o) AS t1 FROM rates),
pieces AS (SELECT s.stream_id, o, rate, f.seq, f.plane, f.pos, f.v, n.v AS nv, CASE f.plane WHEN 0 THEN 16 ELSE 128 END AS fill, greatest(f.seq, t0) AS a, least(f.seq + 1, t1) AS b FROM spans s JOIN planes f ON f.stream_id = s.stream_id AND f.seq < t1 AND f.seq + 1 > t0
  LEFT JOIN planes n ON n.stream_id = f.stream_id AND n.seq = f.seq + 1 AND n.plane = f.plane AND n.pos = f.pos),
sums AS (SELECT stream_id, o, plane, pos, sum(v * (1 - (a - seq)) * (b - a) / rate + coalesce(nv, fill) * CASE WHEN (a - seq) * (b - a) / rate > 1e-5 THEN (a - seq) * (b - a) / rate ELSE 0 END) + greatest(0, 1 - sum((b - a) / rate)) * any_value(fill) AS s FROM pieces GROUP BY stream_id, o, plane, pos),
f AS (SELECT stream_id, o AS seq, plane, pos, CAST(floor(greatest(16, least(240, round(s, 6)))) AS INTEGER) AS v FROM sums)"""


@query("timebend_rate", f"WITH {SQL_RATES} {ROWS} FROM f {PLANE}")
def timebend_rate(spark, d):
    """Time-bend at a rate for each output frame, taken from the brightness of the frame of that number.

    Output o lasts one unit and takes in rate(o) units of input, so the running sum of the rates cuts the input.
    """
    f = planar(spark, d)
    rates = planes.info(f).select("stream_id", F.col("seq").alias("o"), (0.5 + 1.5 * F.col("raw_Y_average")).alias("rate"))
    spans = blocks.running(rates, {"t1": F.col("rate")}, key="stream_id", order="o").withColumnRenamed("t1_before", "t0")
    return rows(planes.bent(f, spans))


@query(
    "series_translate",
    f"""WITH {SQL_SERIES}, r AS (SELECT user_id, i, v / 100 + 0.5::DOUBLE AS v, lead(v / 100 + 0.5::DOUBLE) OVER w AS nx, count(*) OVER (PARTITION BY user_id) AS n FROM series WINDOW w AS (PARTITION BY user_id ORDER BY i)),
s AS (SELECT user_id, i, v, n, nx IS NULL AS last, coalesce(nx, 0) AS nx, sum(CASE WHEN nx IS NOT NULL THEN 1 / v END) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS t1,
  coalesce(sum((v + coalesce(nx, 0)) / 2) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM r),
t AS (SELECT *, coalesce(lag(t1) OVER (PARTITION BY user_id ORDER BY i), 0) AS t0 FROM s),
p AS (SELECT user_id, i, n, o, least(t1, o + 1) - greatest(t0, o) AS l, (greatest(t0, o) - t0) * v AS f, c, v, nx FROM t JOIN range(16) k(o) ON NOT last AND o < t1 AND o + 1 > t0),
q AS (SELECT user_id, n, o, l, c + v * f + (nx - v) * f * f / 2 AS a0, least(i + f + l, n) AS e FROM p WHERE l > 0),
x AS (SELECT q.user_id, o, l / (t.c + t.v * (e - t.i) + (t.nx - t.v) * (e - t.i) * (e - t.i) / 2 - a0) AS x FROM q JOIN t ON t.user_id = q.user_id AND t.i = least(CAST(floor(e) AS BIGINT), q.n - 1)),
u AS (SELECT user_id, least(16, coalesce(max(CASE WHEN NOT last THEN t1 END), 0)) AS stop FROM t GROUP BY user_id)
SELECT u.user_id, CAST(k.o AS INTEGER) AS tick, round(coalesce(sum(x), 0), 6) AS value, round(any_value(stop), 6) AS stop FROM u CROSS JOIN range(16) k(o) LEFT JOIN x ON x.user_id = u.user_id AND x.o = k.o GROUP BY u.user_id, k.o""",
)
def series_translate(spark, d):
    """A user's values as rates, played onto an output clock of 16 ticks: what each tick holds and where the clock stops."""
    t = translated(series(spark, d).withColumn("v", F.col("v") / 100 + 0.5), 16)
    return t.select("user_id", "tick", F.round("value", 6).alias("value"), F.round("stop", 6).alias("stop"))
