"""Frame queries over the embeddings as 4:2:0 frames of 8 x 8 pixels, a row for each plane where planes come out."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.operators import blocks, planes
from lumenframe.operators import frames as op
from lumenframe.plans.registry import query, table
from lumenframe.sources.tables import SQL_FRAMES, SQL_PIXELS, SQL_PLANES, frames, planar

INFO = ("average", "min", "max", "rms", "energy")


HEX = "string_agg(printf('%02x', v), '' ORDER BY pos)"
ROWS = f"SELECT stream_id, seq, plane, {HEX} AS px"
BY = "GROUP BY stream_id, seq, plane"


def rows(f):
    """A row for each plane, its bytes as hex, so that both engines compare it alike."""
    p = f.select("stream_id", "seq", F.posexplode(F.array("y", "cb", "cr")).alias("plane", "p"))
    return p.select("stream_id", "seq", "plane", F.lower(F.hex("p")).alias("px"))


@query("passthru", f"WITH {SQL_PLANES} {ROWS} FROM planes {BY}")
def passthru(spark, d):
    return rows(planar(spark, d).transform(lambda f: f))


SQL_INFO = f"""{SQL_PIXELS}, info AS (
  SELECT stream_id, seq, avg(v) / 255 AS average, min(v) / 255 AS min, max(v) / 255 AS max, stddev_pop(v) / 255 AS rms,
         sqrt(var_pop(v) + power(avg(v) - min(v), 2)) / 255 AS energy FROM pixels GROUP BY stream_id, seq)"""


def _info(table: str) -> str:
    return f"""SELECT stream_id, seq, plane, avg(v) / 255 AS average, min(v) / 255 AS min, max(v) / 255 AS max, stddev_pop(v) / 255 AS rms,
  sqrt(var_pop(v) + power(avg(v) - min(v), 2)) / 255 AS energy FROM {table} {BY}"""


@query("frameinfo", f"WITH {SQL_PLANES}, i AS ({_info('planes')}) SELECT stream_id, seq, plane, {', '.join(f'round({c}, 6) AS {c}' for c in INFO)} FROM i")
def frameinfo(spark, d):
    f = planes.info(planar(spark, d))
    each = F.array(*[F.struct(*[F.round(f"raw_{p}_{c}", 6).alias(c) for c in INFO]) for p in ("Y", "Cb", "Cr")])
    return f.select("stream_id", "seq", F.posexplode(each).alias("plane", "i")).select("stream_id", "seq", "plane", "i.*")


SQL_DELTA = f"""{SQL_PLANES}, deltas AS (
  SELECT stream_id, seq, plane, pos, greatest(0, least(255, v - coalesce(lag(v) OVER (PARTITION BY stream_id, plane, pos ORDER BY seq), v) + 128)) AS v FROM planes)"""


@query("delta", f"WITH {SQL_DELTA} {ROWS} FROM deltas {BY}")
def delta(spark, d):
    return rows(planes.delta(planar(spark, d)))


STATS = [(kind, p, c) for kind in ("raw", "delta") for p in ("Y", "Cb", "Cr") for c in INFO]


@query(
    "get_stats",
    f"""WITH {SQL_DELTA}, s AS (SELECT 'raw' AS kind, * FROM ({_info('planes')}) UNION ALL SELECT 'delta', * FROM ({_info('deltas')}))
SELECT stream_id, seq, {', '.join(f"round(max(CASE WHEN kind = '{k}' AND plane = {('Y', 'Cb', 'Cr').index(p)} THEN {c} END), 6) AS {k}_{p}_{c}" for k, p, c in STATS)} FROM s GROUP BY stream_id, seq""",
)
def get_stats(spark, d):
    """The thirty columns of a frame's statistics: its planes as they are, and as differences to the frame before."""
    raw = planes.info(planar(spark, d))
    both = planes.info(planes.delta(raw), "delta")
    return both.select("stream_id", "seq", *[F.round(f"{k}_{p}_{c}", 6).alias(f"{k}_{p}_{c}") for k, p, c in STATS])


@query("delay", f"WITH {SQL_FRAMES} SELECT stream_id, seq, lead(seq, 27) OVER (PARTITION BY stream_id ORDER BY seq) AS out_at FROM frames")
def delay(spark, d):
    """A frame leaves when 27 later ones have come; null: at the end of the stream."""
    late = lambda t, k: t.withColumn("out_at", F.lead("seq", 27).over(Window.partitionBy(k).orderBy("seq")))
    return blocks.sliding(frames(spark, d).select("stream_id", "seq"), 0, 27, late, "stream_id", "seq")


@query("merge_frames", f"WITH {SQL_PLANES}, m AS (SELECT stream_id, seq // 5 AS seq, plane, pos, CAST(floor(sum(v) / 5) AS INTEGER) AS v FROM planes GROUP BY stream_id, seq // 5, plane, pos) {ROWS} FROM m {BY}")
def merge_frames(spark, d):
    return rows(planes.merge(planar(spark, d), 5))


@query(
    "hist_equalise",
    f"""WITH {SQL_PLANES}, h AS (SELECT stream_id, seq, plane, pos, v, count(*) OVER (PARTITION BY stream_id, seq, plane ORDER BY v) * 255.0::DOUBLE / 64 AS c,
       count(*) FILTER (v <= 0) OVER (PARTITION BY stream_id, seq, plane) * 255.0::DOUBLE / 64 AS c0 FROM planes),
q AS (SELECT stream_id, seq, plane, pos, CASE WHEN plane > 0 THEN v ELSE CAST(floor(greatest(16, least(235, CASE WHEN c0 < 255 THEN (c - c0) / (255 - c0) * 219 + 16 ELSE 16 END))) AS INTEGER) END AS v FROM h) {ROWS} FROM q {BY}""",
)
def hist_equalise(spark, d):
    return rows(planes.equalise(planar(spark, d)))


SQL_CENTRE = f"""{SQL_PLANES}, pixels AS (SELECT * FROM planes WHERE plane = 0), t AS (SELECT stream_id, seq, sum(v) // 2 AS half FROM pixels GROUP BY stream_id, seq),
cx AS (SELECT stream_id, seq, min(x) AS cx FROM (SELECT stream_id, seq, x, sum(sum(v)) OVER (PARTITION BY stream_id, seq ORDER BY x) AS c FROM pixels GROUP BY stream_id, seq, x) JOIN t USING (stream_id, seq) WHERE c >= half GROUP BY stream_id, seq),
cy AS (SELECT stream_id, seq, min(y) AS cy FROM (SELECT stream_id, seq, y, sum(sum(v)) OVER (PARTITION BY stream_id, seq ORDER BY y) AS c FROM pixels GROUP BY stream_id, seq, y) JOIN t USING (stream_id, seq) WHERE c >= half GROUP BY stream_id, seq)"""


@query("centre_point", f"WITH {SQL_CENTRE} SELECT stream_id, seq, cx, cy FROM cx JOIN cy USING (stream_id, seq)")
def centre_point(spark, d):
    return planes.centre(planar(spark, d)).select("stream_id", "seq", "cx", "cy")


@query(
    "centre_shift",
    f"""WITH {SQL_CENTRE}, k(plane, w, sub, fill) AS (VALUES (0, 8, 1, 16), (1, 4, 2, 128), (2, 4, 2, 128)),
canvas AS (SELECT stream_id, seq, plane, w, fill, p, p % (2 * w) - (8 - cx) // sub AS sx, p // (2 * w) - (8 - cy) // sub AS sy
  FROM (SELECT *, unnest(range(4 * w * w)) AS p FROM cx JOIN cy USING (stream_id, seq), k)),
m AS (SELECT c.stream_id, c.seq, c.plane, c.p AS pos, coalesce(q.v, fill) AS v FROM canvas c LEFT JOIN planes q ON q.stream_id = c.stream_id AND q.seq = c.seq AND q.plane = c.plane AND q.x = sx AND q.y = sy) {ROWS} FROM m {BY}""",
)
def centre_shift(spark, d):
    return rows(planes.centred(planar(spark, d)))


@query(
    "scale_area",
    f"""WITH {SQL_PLANES}, g AS (SELECT i AS o, j AS p, greatest(0, least(j + 1, (i + 1) * (8 / 6.0::DOUBLE)) - greatest(j, i * (8 / 6.0::DOUBLE))) / (8 / 6.0::DOUBLE) AS share FROM range(6) a(i), range(8) b(j)),
c AS (SELECT stream_id, seq, plane, gy.o * 6 + gx.o AS pos, CAST(floor(round(sum(v * gx.share * gy.share), 9)) AS INTEGER) AS v FROM planes JOIN g gx ON gx.p = x AND gx.share > 1e-12 JOIN g gy ON gy.p = y AND gy.share > 1e-12 GROUP BY stream_id, seq, plane, gy.o, gx.o) {ROWS} FROM c {BY}""",
)
def scale_area(spark, d):
    """To 6 x 6, the chroma planes to 3 x 3."""
    return rows(planes.scale(planar(spark, d), 6, 6))


@query("sub_window", f"WITH {SQL_PLANES} {ROWS} FROM planes WHERE CASE plane WHEN 0 THEN x BETWEEN 2 AND 5 AND y BETWEEN 4 AND 7 ELSE x BETWEEN 1 AND 2 AND y BETWEEN 2 AND 3 END {BY}")
def sub_window(spark, d):
    return rows(planes.window(planar(spark, d), 2, 4, 4, 4))


def as_444(f):
    return f.withColumn("parms", F.map_zip_with("parms", "parms", lambda k, a, b: F.when(k == "C", "444").otherwise(a)))


def as_420(f):
    return f.withColumn("parms", F.map_zip_with("parms", "parms", lambda k, a, b: F.when(k == "C", "420").otherwise(a)))


@query("upsample", f"WITH {SQL_PLANES}, u AS (SELECT stream_id, seq, plane, p AS pos, v FROM planes JOIN range(64) r(p) ON x = p % 8 // (8 // w) AND y = p // 8 // (8 // w)) {ROWS} FROM u {BY}")
def upsample(spark, d):
    """Through floats to 4:4:4."""
    return rows(planes.from_float(as_444(planes.to_float(planar(spark, d)))))


@query("downsample", f"WITH {SQL_PLANES}, b AS (SELECT stream_id, seq, plane, pos, v FROM planes WHERE plane = 0 UNION ALL SELECT stream_id, seq, k, y // 2 * 4 + x // 2, CAST(floor(sum(v) / 4) AS INTEGER) FROM planes, range(1, 3) r(k) WHERE plane = 0 GROUP BY stream_id, seq, k, y // 2, x // 2) {ROWS} FROM b {BY}")
def downsample(spark, d):
    """A 4:4:4 frame whose planes are all the luma, through floats to 4:2:0."""
    f = as_444(planar(spark, d)).withColumns({"cb": F.col("y"), "cr": F.col("y")})
    return rows(planes.from_float(as_420(planes.to_float(f))))


@query("draw_point", f"WITH {SQL_PLANES}, p AS (SELECT stream_id, seq, plane, pos, CASE WHEN (plane = 0 AND (x, y) IN ((3, 5), (6, 6))) OR (plane > 0 AND (x, y) IN ((1, 2), (3, 3))) THEN CASE plane WHEN 0 THEN 235 WHEN 1 THEN 90 ELSE 200 END ELSE v END AS v FROM planes) {ROWS} FROM p {BY}")
def draw_point(spark, d):
    return rows(planes.draw(planar(spark, d), [(3, 5), (9, 2), (6, 6), (-3, 1)], (235, 90, 200)))


@query(
    "draw_line",
    f"""WITH RECURSIVE {SQL_PLANES}, ends(plane, x0, y0, dx, dy) AS (VALUES (0, 1, 1, 5, 6), (1, 0, 0, 3, 3), (2, 0, 0, 3, 3)),
steps AS (SELECT plane, x0 AS x, y0 AS y, dx, dy, (dx + dy) >> 1 AS acc, dy AS left_ FROM ends
  UNION ALL SELECT plane, x + CASE WHEN acc - dx <= 0 THEN 1 ELSE 0 END, y + 1, dx, dy, acc - dx + CASE WHEN acc - dx <= 0 THEN dy ELSE 0 END, left_ - 1 FROM steps WHERE left_ > 0),
p AS (SELECT stream_id, seq, plane, pos, CASE WHEN (plane, x, y) IN (SELECT (plane, x, y) FROM steps) THEN CASE plane WHEN 0 THEN 235 WHEN 1 THEN 90 ELSE 200 END ELSE v END AS v FROM planes) {ROWS} FROM p {BY}""",
)
def draw_line(spark, d):
    """A line from (1, 1) to (6, 7); the SQL walks it by its accumulator."""
    return rows(planes.draw_line(planar(spark, d), 1, 1, 6, 7, (235, 90, 200)))


@query("every_nth", f"WITH {SQL_FRAMES} SELECT stream_id, seq, printf('frame-%05d.png', CAST(seq // 10 AS BIGINT)) AS file FROM frames WHERE seq % 10 = 0")
def every_nth(spark, d):
    return frames(spark, d).where("seq % 10 = 0").select("stream_id", "seq", F.format_string("frame-%05d.png", F.floor(F.col("seq") / 10)).alias("file"))


@query("phase_filter", f"WITH {SQL_FRAMES} SELECT stream_id, seq FROM frames WHERE (seq & 3) = 0")
def phase_filter(spark, d):
    return frames(spark, d).where(F.col("seq").bitwiseAND(3) == 0).select("stream_id", "seq")


@query("tee_branches", f"WITH {SQL_INFO} SELECT 'average' AS branch, stream_id, seq, round(average, 6) AS value FROM info UNION ALL SELECT 'energy', stream_id, seq, round(energy, 6) FROM info")
def tee_branches(spark, d):
    """Both branches come from one scan: the tee is an array of results, not a second read."""
    info = op.frame_info(F.col("px"))
    both = F.array(*[F.struct(F.lit(k).alias("branch"), F.round(info[k], 6).alias("value")) for k in ("average", "energy")])
    return frames(spark, d).select("stream_id", "seq", F.explode(both).alias("b")).select("b.branch", "stream_id", "seq", "b.value")


@query("injector_filter_map", f"WITH {SQL_INFO} SELECT stream_id, seq AS old_seq, row_number() OVER (PARTITION BY stream_id ORDER BY seq) - 1 AS seq, round(average, 6) AS average FROM info WHERE average >= 0.5")
def injector_filter_map(spark, d):
    """A callback that drops frames: those kept are numbered anew."""
    f = frames(spark, d).select("stream_id", F.col("seq").alias("old_seq"), op.frame_info(F.col("px"))["average"].alias("average")).where("average >= 0.5")
    w = Window.partitionBy("stream_id").orderBy("old_seq")
    return f.select("stream_id", "old_seq", (F.row_number().over(w) - 1).cast("long").alias("seq"), F.round("average", 6).alias("average"))


@query(
    "spectrogram_scroll",
    f"""WITH {SQL_INFO} SELECT stream_id, seq, count(*) OVER w AS columns, round(first_value(average) OVER w, 6) AS oldest, round(last_value(average) OVER w, 6) AS newest
FROM info WINDOW w AS (PARTITION BY stream_id ORDER BY seq ROWS BETWEEN 15 PRECEDING AND CURRENT ROW)""",
)
def spectrogram_scroll(spark, d):
    f = op.scrolled(frames(spark, d), op.frame_info(F.col("px"))["average"], 16)
    row = F.col("row")
    return f.select("stream_id", "seq", F.size(row).cast("long").alias("columns"), F.round(row[0], 6).alias("oldest"), F.round(F.element_at(row, -1), 6).alias("newest"))


@query(
    "graph_points",
    f"""WITH {SQL_INFO}, n AS (SELECT a.stream_id, a.seq, b.seq - a.seq + 15 AS x, CAST(trunc((1 - b.average) * 100) AS INTEGER) AS y
  FROM info a JOIN info b ON b.stream_id = a.stream_id AND b.seq BETWEEN a.seq - 15 AND a.seq)
SELECT stream_id, seq, string_agg(x || ':' || y, ' ' ORDER BY x) AS points FROM n GROUP BY stream_id, seq""",
)
def graph_points(spark, d):
    f = op.graph_points(frames(spark, d), op.frame_info(F.col("px"))["average"], 16, 100)
    return f.select("stream_id", "seq", F.array_join(F.transform("points", lambda p: F.concat_ws(":", p["x"], p["y"])), " ").alias("points"))


@query("array_min_max_avg", f"WITH {SQL_FRAMES} SELECT stream_id, seq, list_min(px) AS low, list_max(px) AS high, round(list_avg(px), 6) AS mean FROM frames")
def array_min_max_avg(spark, d):
    px = F.col("px")
    return frames(spark, d).select("stream_id", "seq", F.array_min(px).alias("low"), F.array_max(px).alias("high"), F.round(op.total(px) / F.size(px), 6).alias("mean"))


@query("range_stats", f"WITH {SQL_INFO} SELECT stream_id, round(min(min), 6) AS low, round(max(max), 6) AS high, round(avg(average), 6) AS mean FROM info GROUP BY stream_id")
def range_stats(spark, d):
    f = frames(spark, d).select("stream_id", *[c.alias(k) for k, c in op.frame_info(F.col("px")).items()])
    return f.groupBy("stream_id").agg(F.round(F.min("min"), 6).alias("low"), F.round(F.max("max"), 6).alias("high"), F.round(F.avg("average"), 6).alias("mean"))


@query("plot_scale", f"WITH {SQL_INFO} SELECT stream_id, seq, CAST(greatest(16, least(240, trunc(rms * 2 * (240 - 16) + 16))) AS INTEGER) AS level FROM info")
def plot_scale(spark, d):
    rms = op.frame_info(F.col("px"))["rms"]
    return frames(spark, d).select("stream_id", "seq", op.clamp((rms * 2 * 224 + 16).cast("int"), 16, 240).alias("level"))


@query(
    "plane_geometry",
    """WITH g(cs, xs, ys) AS (VALUES ('420', 2, 2), ('420jpeg', 2, 2), ('420mpeg2', 2, 2), ('420paldv', 2, 2), ('422', 2, 1), ('444', 1, 1)),
p AS (SELECT p_partkey, p_size * 16 AS w, p_size * 8 AS h FROM part)
SELECT p_partkey, cs, plane, w // x AS stride, (w // x) * (h // y) AS size, CASE plane WHEN 0 THEN 16 ELSE 128 END AS fill
FROM (SELECT p_partkey, w, h, cs, plane, CASE plane WHEN 0 THEN 1 ELSE xs END AS x, CASE plane WHEN 0 THEN 1 ELSE ys END AS y FROM p, g, (VALUES (0), (1), (2)) k(plane))""",
)
def plane_geometry(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") * 16).alias("w"), (F.col("p_size") * 8).alias("h"))
    every = F.array(*[F.struct(F.lit(cs).alias("cs"), F.lit(k).alias("plane"), F.lit(xs if k else 1).alias("xs"), F.lit(ys if k else 1).alias("ys")) for cs, (xs, ys) in op.SUBSAMPLING.items() for k in range(3)])
    g = p.select("p_partkey", "w", "h", F.explode(every).alias("g")).select("p_partkey", "w", "h", "g.*")
    stride = F.floor(F.col("w") / F.col("xs")).cast("int")
    size = stride * F.floor(F.col("h") / F.col("ys")).cast("int")
    return g.select("p_partkey", "cs", "plane", stride.alias("stride"), size.alias("size"), F.when(F.col("plane") == 0, op.FILL_Y).otherwise(op.FILL_C).alias("fill"))


@query(
    "lane_layout",
    """WITH g(cs, xs, ys) AS (VALUES ('420', 2, 2), ('422', 2, 1), ('444', 1, 1)), w AS (
  SELECT cs, plane, 1.0::DOUBLE / CASE plane WHEN 0 THEN 1 ELSE xs * ys END AS share FROM g, (VALUES (0), (1), (2)) k(plane)),
p AS (SELECT DISTINCT p_size * 40 AS h FROM part)
SELECT h, cs, plane, CAST(trunc(h * share / sum(share) OVER (PARTITION BY h, cs)) AS INTEGER) AS height FROM p, w""",
)
def lane_layout(spark, d):
    """Heights of the lanes of the three planes in proportion to their pixels."""
    rows = [(cs, k, 1.0 / (xs * ys if k else 1), 1 + 2.0 / (xs * ys)) for cs, (xs, ys) in op.SUBSAMPLING.items() if len(cs) == 3 for k in range(3)]
    every = F.array(*[F.struct(F.lit(a).alias("cs"), F.lit(b).alias("plane"), F.lit(c).alias("share"), F.lit(s).alias("all")) for a, b, c, s in rows])
    p = spark.read.parquet(f"{d}/part.parquet").select((F.col("p_size") * 40).alias("h")).distinct().select("h", F.explode(every).alias("g"))
    return p.select("h", "g.cs", "g.plane", (F.col("h") * F.col("g.share") / F.col("g.all")).cast("int").alias("height"))


@query(
    "testcard_gen",
    """WITH o(n, a, b, c) AS (VALUES (0, 0, 1, 2), (1, 0, 2, 1), (2, 1, 0, 2), (3, 1, 2, 0), (4, 2, 0, 1), (5, 2, 1, 0)),
f AS (SELECT p_partkey, p_partkey % 1536 AS i, unnest([0, 1, 2]) AS plane, unnest([a, b, c]) AS ramp FROM part JOIN o ON n = p_partkey % 1536 // 256),
cells AS (SELECT x * 255 // 63 AS vx, y * 255 // 47 AS vy FROM range(64) a(x), range(48) b(y)),
sums AS (SELECT 0 AS ramp, min(vx) AS low, max(vx) AS high, sum(vx) AS total FROM cells UNION ALL SELECT 1, min(vy), max(vy), sum(vy) FROM cells)
SELECT CAST(p_partkey AS BIGINT) AS p_partkey, CAST(i AS BIGINT) AS frame, plane, CAST(coalesce(low, i % 256) AS INTEGER) AS low, CAST(coalesce(high, i % 256) AS INTEGER) AS high, CAST(coalesce(total, i % 256 * 3072) AS BIGINT) AS total FROM f LEFT JOIN sums USING (ramp)""",
)
def testcard_gen(spark, d):
    """A whole test card of 64 x 48 for each part, the frame that its key numbers; the lowest and highest pixel and the sum of each plane."""
    k = F.col("p_partkey").cast("long")
    cards = planes.testcard(table(spark, d, "part").select(k.alias("stream_id"), (k % 1536).alias("seq")), 64, 48)
    f = planes.mapped(cards, lambda parms, ps: (parms, ps, ([{"low": int(p.min()), "high": int(p.max()), "total": int(p.sum())} for p in ps],)), "t array<struct<low:int,high:int,total:bigint>>", planes=False)
    return f.select(F.col("stream_id").alias("p_partkey"), F.col("seq").alias("frame"), F.posexplode("t").alias("plane", "t")).select("p_partkey", "frame", "plane", "t.low", "t.high", "t.total")
