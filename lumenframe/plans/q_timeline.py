"""Timeline algebra over nations as clips, points over customers, container and streaming queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.operators import properties
from lumenframe.operators import timeline as tl
from lumenframe.operators.series import let, pitch_convolve
from lumenframe.plans.q_series import KERNEL, _convolve_sql
from lumenframe.plans.registry import query, table
from lumenframe.sources import y4m
from lumenframe.sources.tables import SQL_FRAMES, frames, series
from lumenframe.streaming import run, stateful

SQL_CLIPS = """clips AS (SELECT n_nationkey AS clip_id, CAST(n_nationkey + 5 AS BIGINT) AS frames FROM nation),
seq AS (SELECT first + local_frame AS framenum, clip_id, local_frame FROM (SELECT clip_id, first, unnest(range(frames)) AS local_frame
  FROM (SELECT clip_id, frames, CAST(coalesce(sum(frames) OVER (ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first FROM clips)))"""


def clips(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("clip_id"), (F.col("n_nationkey") + 5).cast("long").alias("frames"))


@query("clip_portion", f"WITH {SQL_CLIPS} SELECT clip_id, frames, local_frame, round(local_frame / frames, 6) AS portion FROM (SELECT clip_id, frames, unnest(range(frames)) AS local_frame FROM clips)")
def clip_portion(spark, d):
    return tl.frames_of(clips(spark, d)).withColumn("portion", F.round("portion", 6))


@query("clip_sequence", f"WITH {SQL_CLIPS} SELECT framenum, clip_id, local_frame FROM seq")
def clip_sequence(spark, d):
    return tl.sequence(clips(spark, d))


@query("clip_reverse", f"WITH {SQL_CLIPS} SELECT (SELECT sum(frames)::BIGINT FROM clips) - 1 - framenum AS framenum, clip_id, local_frame FROM seq")
def clip_reverse(spark, d):
    c = clips(spark, d)
    total = c.agg(F.sum("frames").alias("total"))
    return tl.reverse(tl.sequence(c).join(F.broadcast(total)), F.col("total")).drop("total")  # one row


@query("clip_edit", f"WITH {SQL_CLIPS} SELECT framenum - 40 AS framenum, clip_id, local_frame FROM seq WHERE framenum >= 40 AND framenum < 140")
def clip_edit(spark, d):
    return tl.edit(tl.sequence(clips(spark, d)), 40, 100)


@query("clip_overlay", f"WITH {SQL_CLIPS}, m AS (SELECT min(frames) AS total FROM clips) SELECT framenum, clip_id AS layer FROM (SELECT clip_id, unnest(range(frames)) AS framenum FROM clips), m WHERE framenum < total")
def clip_overlay(spark, d):
    """Clips as layers; the whole lasts as long as the shortest."""
    c = clips(spark, d)
    shortest = c.agg(F.min("frames").alias("total"))
    return tl.frames_of(c).join(F.broadcast(shortest)).where("local_frame < total").select(F.col("local_frame").alias("framenum"), F.col("clip_id").alias("layer"))


def _dissolve(name: str, easing, eased: str):
    @query(
        name,
        f"""WITH {SQL_CLIPS}, p AS (SELECT a.clip_id AS a, a.frames AS na, b.frames AS nb, least(8, a.frames, b.frames) AS f FROM clips a JOIN clips b ON b.clip_id = a.clip_id + 1),
u AS (SELECT a, na, f, n, (n - (na - f)) / f::DOUBLE AS x FROM (SELECT *, unnest(range(na)) AS n FROM p)), o AS (SELECT a, na, f, n, n / f::DOUBLE AS x FROM (SELECT *, unnest(range(nb)) AS n FROM p))
SELECT a, n AS framenum, 'under' AS layer, n AS local_frame, round(CASE WHEN n < na - f THEN 1 ELSE 1 - {eased} END, 6)::DOUBLE AS alpha FROM u
UNION ALL SELECT a, na - f + n, 'over', n, round(CASE WHEN n < f THEN {eased} ELSE 1 END, 6)::DOUBLE FROM o""",
    )
    def run_(spark, d):
        c = clips(spark, d)
        nxt = c.select((F.col("clip_id") - 1).alias("clip_id"), F.col("frames").alias("nb"))
        p = c.join(nxt, "clip_id").select(F.col("clip_id").alias("a"), F.col("frames").alias("na"), "nb")
        return tl.dissolve(p, 8, easing).withColumn("alpha", F.round("alpha", 6))


_dissolve("clip_dissolve", lambda x: x, "x")
_dissolve("clip_dissolve_eased", lambda x: x * x * (3 - 2 * x), "x * x * (3 - 2 * x)")

SQL_TAGS = """clips AS (SELECT n_regionkey AS sequence_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS pos, n_name AS tag, CAST(n_nationkey + 5 AS BIGINT) AS frames FROM nation)"""


def tagged(spark, d):
    """The nations of each region as a sequence of clips."""
    pos = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    clip = F.struct(F.col("n_name").alias("tag"), (F.col("n_nationkey") + 5).cast("long").alias("frames"))
    return table(spark, d, "nation").select(F.col("n_regionkey").alias("sequence_id"), pos.cast("long").alias("pos"), clip.alias("clip"))


@query(
    "clip_map",
    f"""WITH {SQL_TAGS}, m AS (SELECT sequence_id, pos, 0 AS sub, 'new ' || tag AS tag, frames * 2 AS frames FROM clips WHERE pos % 3 <> 2 UNION ALL SELECT sequence_id, pos, 1, tag, frames FROM clips WHERE pos % 3 = 1)
SELECT sequence_id, row_number() OVER (PARTITION BY sequence_id ORDER BY pos, sub) - 1 AS pos, tag, frames FROM m""",
)
def clip_map(spark, d):
    """Every third clip goes, every second of three stays beside its new one, the others are replaced."""

    def make(clip, pos):
        new = F.struct(F.concat(F.lit("new "), clip["tag"]).alias("tag"), (clip["frames"] * 2).alias("frames"))
        return F.when(pos % 3 == 0, F.array(new)).when(pos % 3 == 1, F.array(new, clip))

    return tl.mapped(tagged(spark, d), make).select("sequence_id", "pos", "clip.tag", "clip.frames")


@query("clip_reduce", f"WITH {SQL_TAGS} SELECT sequence_id, string_agg(tag, ' and ' ORDER BY pos) AS tag, CAST(sum(frames) AS BIGINT) AS frames FROM clips GROUP BY sequence_id")
def clip_reduce(spark, d):
    pair = lambda a, b: F.struct(F.concat(a["tag"], F.lit(" and "), b["tag"]).alias("tag"), (a["frames"] + b["frames"]).alias("frames"))
    return tl.reduced(tagged(spark, d), pair).select("sequence_id", "clip.tag", "clip.frames")


def _placed_sql(sx: str, sy: str, turn: str, mx: str, my: str, ox: str, oy: str) -> str:
    """Columns of T(origin) S R T(move - origin) on a canvas of 320 x 240."""
    a, b, c, d = f"({sx}) * cos({turn})", f"({sy}) * sin({turn})", f"-({sx}) * sin({turn})", f"({sy}) * cos({turn})"
    ux, uy = f"(({mx}) - ({ox}) * 320)", f"(({my}) - ({oy}) * 240)"
    return f"{a} AS a, {b} AS b, {c} AS c, {d} AS d, {a} * {ux} + {c} * {uy} + ({ox}) * 320 AS e, {b} * {ux} + {d} * {uy} + ({oy}) * 240 AS f"


def _times_sql(m: str, n: str) -> str:
    return f"{m}.a * {n}.a + {m}.c * {n}.b AS a, {m}.b * {n}.a + {m}.d * {n}.b AS b, {m}.a * {n}.c + {m}.c * {n}.d AS c, {m}.b * {n}.c + {m}.d * {n}.d AS d, {m}.a * {n}.e + {m}.c * {n}.f + {m}.e AS e, {m}.b * {n}.e + {m}.d * {n}.f + {m}.f AS f"


@query(
    "transform_nested",
    f"""WITH outer_ AS (SELECT r_regionkey AS k, {_placed_sql('1 + r_regionkey / 10.0::DOUBLE', '2', 'r_regionkey / 5.0::DOUBLE', '10', '-5', '0.5', '0.5')} FROM region),
inner_ AS (SELECT n_nationkey AS clip_id, n_regionkey AS k, {_placed_sql('1', '1', '-n_nationkey / 7.0::DOUBLE', 'n_nationkey', '3', '0', '1')} FROM nation),
raw AS (SELECT 1.0::DOUBLE AS a, 0.25::DOUBLE AS b, -0.5::DOUBLE AS c, 1.5::DOUBLE AS d, 4.0::DOUBLE AS e, -2.0::DOUBLE AS f),
two AS (SELECT clip_id, {_times_sql('outer_', 'inner_')} FROM inner_ JOIN outer_ USING (k)), m AS (SELECT clip_id, {_times_sql('two', 'raw')} FROM two, raw)
SELECT clip_id, round(a * 10 + c * 20 + e, 6) AS x, round(b * 10 + d * 20 + f, 6) AS y FROM m""",
)
def transform_nested(spark, d):
    """Where the point (10, 20) of each nation's clip comes to lie under its region's transform, its own and a raw matrix."""
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    r = F.col("n_regionkey")
    around = n.select(k.alias("clip_id"), F.lit(0).alias("depth"), tl.transform(320, 240, rotate=r / 5.0, scale=(1 + r / 10.0, 2.0), move=(10, -5)).alias("m"))
    own = n.select(k.alias("clip_id"), F.lit(1).alias("depth"), tl.transform(320, 240, origin=(0, 1), rotate=-k / 7.0, move=(k.cast("double"), 3)).alias("m"))
    raw = n.select(k.alias("clip_id"), F.lit(2).alias("depth"), tl.transform(320, 240, raw=(1.0, 0.25, -0.5, 1.5, 4.0, -2.0)).alias("m"))
    x, y = tl.moved(F.col("m"), F.lit(10.0), F.lit(20.0))
    return tl.composed(own.union(raw).union(around), "clip_id").select("clip_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("prop_ramp", f"WITH {SQL_CLIPS} SELECT clip_id, n AS local_frame, round((200 - 50) * (n / frames) + 50, 6) AS v FROM (SELECT clip_id, frames, unnest(range(frames)) AS n FROM clips)")
def prop_ramp(spark, d):
    return tl.frames_of(clips(spark, d)).select("clip_id", "local_frame", F.round(tl.ramp(F.col("portion"), 50.0, 200.0), 6).alias("v"))


@query("prop_circle", f"WITH {SQL_CLIPS} SELECT clip_id, n AS local_frame, round(sin((n / frames * 3 + 0.25) * 2 * pi()) * 20 * 1.5 + 100, 6) AS x, round(cos((n / frames * 3 + 0.25) * 2 * pi()) * 20 * 0.5 + 50, 6) AS y FROM (SELECT clip_id, frames, unnest(range(frames)) AS n FROM clips)")
def prop_circle(spark, d):
    x, y = tl.circle(F.col("portion"), 3, 0.25, 20)
    return tl.frames_of(clips(spark, d)).select("clip_id", "local_frame", F.round(x * 1.5 + 100, 6).alias("x"), F.round(y * 0.5 + 50, 6).alias("y"))


@query(
    "prop_bound",
    f"""WITH {SQL_CLIPS}, p AS (SELECT clip_id, n AS local_frame, n / frames AS portion FROM (SELECT clip_id, frames, unnest(range(frames)) AS n FROM clips)),
r AS (SELECT *, 40 * portion + clip_id AS radius, portion * 2 * pi() AS angle FROM p)
SELECT clip_id, local_frame, round(radius, 6) AS radius, round(100 + radius * cos(angle), 6) AS x, round(60 + radius * sin(angle) / 2, 6) AS y FROM r""",
)
def prop_bound(spark, d):
    """A point on a spiral: its place is bound to a radius and an angle, which are bound to the portion of the clip gone by."""
    props = {
        "x": lambda s: s.origin_x + s.radius * F.cos(s.angle),
        "y": lambda s: s.origin_y + s.radius * F.sin(s.angle) / 2,
        "radius": lambda s: 40 * s.portion + s.clip_id,
        "angle": lambda s: s.portion * 2 * F.pi(),
        "origin_x": 100.0,
        "origin_y": 60.0,
    }
    f = properties.bind(tl.frames_of(clips(spark, d)), props)
    return f.select("clip_id", "local_frame", *[F.round(c, 6).alias(c) for c in ("radius", "x", "y")])


@query("iter_loop", f"WITH {SQL_CLIPS}, m AS (SELECT count(*) AS n FROM seq) SELECT i, clip_id, local_frame FROM (SELECT i, i % n AS k FROM range(1000) t(i), m) JOIN seq ON framenum = k")
def iter_loop(spark, d):
    """A finite sequence played over and over for 1000 frames."""
    s = tl.sequence(clips(spark, d))
    n = s.agg(F.count("*").alias("n"))
    ticks = spark.range(1000).withColumnRenamed("id", "i").join(F.broadcast(n)).select("i", (F.col("i") % F.col("n")).alias("framenum"))
    return ticks.join(s, "framenum").select("i", "clip_id", "local_frame")


POINTS = "points AS (SELECT c_custkey AS tag, c_custkey % 251 AS x, (c_custkey * 7) % 241 AS y FROM customer)"


def points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("tag"), (k % 251).alias("x"), ((k * 7) % 241).alias("y"))


@query("affine", f"WITH {POINTS} SELECT tag, round(2 * (x * cos(0.5) - y * sin(0.5)) + 10, 6) AS x, round(2 * (x * sin(0.5) + y * cos(0.5)) - 5, 6) AS y FROM points")
def affine(spark, d):
    x, y = tl.affine(F.col("x"), F.col("y"), 2, 0.5, 10, -5)
    return points(spark, d).select("tag", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def _twice() -> str:
    """The one-round SQL with its result, unrounded, as the input of the next round."""
    once = _convolve_sql((KERNEL,) * 3, 1.0, True)
    body = once.replace("round(4 / sum(x1 - x0) * sum(term) / 1.0, 6) AS out", "greatest(1e-9, least(500, 4 / sum(x1 - x0) * sum(term))) AS v")
    start = "pitch AS (SELECT user_id, i, v / 100 + 0.5 AS v FROM series)"
    return once.replace(start, f"pitch AS ({body})")


@query("convolve_iterate", _twice())
def convolve_iterate(spark, d):
    """Two rounds of the linear convolution, values held between 1e-9 and 500."""
    s = series(spark, d).withColumn("v", F.col("v") / 100 + 0.5)
    for _ in range(2):
        s = pitch_convolve(s, (KERNEL,), 1.0, True).select("user_id", "i", F.greatest(F.lit(1e-9), F.least(F.lit(500.0), F.col("out"))).alias("v"))
    return s.select("user_id", "i", F.round("v", 6).alias("out"))


SQL_SCAN = f"WITH {SQL_FRAMES} SELECT CAST(stream_id AS VARCHAR) AS stream_id, seq, round(seq / 25.0::DOUBLE, 6) AS elapsed, list_sum(px)::BIGINT AS total FROM frames"


def _written(spark, d) -> str:
    """A folder with the frames as one file for each stream."""
    import uuid

    path = f"{run.folder(spark)}/y4m-{uuid.uuid4().hex}"
    f = frames(spark, d)
    byte = lambda a: F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 2, "0")), ""))
    grey = byte(F.array_repeat(F.lit(128), 16))
    head = F.create_map(*[F.lit(x) for x in ("W", "8", "H", "8", "F", "25:1", "C", "420")])
    y4m.write(f.select(F.col("stream_id").cast("string").alias("stream_id"), "seq", head.alias("parms"), byte(F.col("px")).alias("y"), grey.alias("cb"), grey.alias("cr")), path)
    spark.dataSource.register(y4m.Y4mSource)
    return path


def _totals(scan):
    total = let(F.hex("y"), lambda h: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda s, i: s + F.conv(F.substr(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long")))
    return scan.select("stream_id", "seq", F.round("elapsed", 6).alias("elapsed"), total.alias("total"))


@query("y4m_scan", SQL_SCAN)
def y4m_scan(spark, d):
    """Frames written as one file for each stream and scanned back by the data source."""
    return _totals(spark.read.format("y4m").load(_written(spark, d)))


@query("y4m_live", SQL_SCAN)
def y4m_live(spark, d):
    """The same folder followed as a stream: every frame once, by its place in its file."""
    return run.drain(_totals(spark.readStream.format("y4m").load(_written(spark, d))), "append")


def _events(spark, d):
    return stateful.timed(run.source(spark, d, "events"))


@query("stream_tumbling", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY time_bucket(INTERVAL '1 day', ts), event_type")
def stream_tumbling(spark, d):
    return run.drain(stateful.tumbling(_events(spark, d), "1 day"), "complete")


@query("stream_sliding", "WITH w AS (SELECT time_bucket(INTERVAL '6 hours', ts) - k * INTERVAL '6 hours' AS start, value FROM events, range(2) t(k)) SELECT start, count(*) AS n, round(max(value), 6) AS high FROM w GROUP BY start")
def stream_sliding(spark, d):
    return run.drain(stateful.sliding(_events(spark, d), "12 hours", "6 hours"), "complete")


@query("stream_delta", "SELECT user_id, event_id, round(value - coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), value), 6) AS delta FROM events")
def stream_delta(spark, d):
    return run.drain(stateful.delta(run.source(spark, d, "events")), "append")


@query("stream_average", "SELECT user_id, event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
def stream_average(spark, d):
    return run.drain(stateful.average(run.source(spark, d, "events"), 5), "append")


@query("stream_merge", "WITH s AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 5 AS grp FROM events) SELECT user_id, grp, round(sum(value) / 5, 6) AS mean FROM s GROUP BY user_id, grp HAVING count(*) = 5")
def stream_merge(spark, d):
    return run.drain(stateful.merge(run.source(spark, d, "events"), 5), "append")
