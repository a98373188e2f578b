"""Series queries over the event values of every user."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.operators import blocks, planes
from lumenframe.operators import series as op
from lumenframe.operators.space import kept
from lumenframe.plans.q_frames import BY as PLANE
from lumenframe.plans.q_frames import ROWS, rows
from lumenframe.plans.registry import query, table
from lumenframe.sources.tables import SQL_FRAMES, SQL_PLANES, SQL_SERIES, frames, planar, series

POS = "positive AS (SELECT user_id, i, greatest(v, 1e-9::DOUBLE) AS v FROM series)"
BY = "PARTITION BY user_id ORDER BY i"


def positive(spark, d):
    return series(spark, d).withColumn("v", F.greatest("v", F.lit(1e-9)))


def slid(df, before, after, **cols):
    """Each of ``cols``, made from the keys of its window, over rows ``before`` back to ``after`` ahead, in blocks."""
    made = blocks.sliding(df, before, after, lambda t, k: t.withColumns({n: c(k) for n, c in cols.items()}))
    return out(made, *[(n, F.col(n)) for n in cols])


def out(df, *cols, digits: int = 6):
    return df.select("user_id", "i", *[F.round(c, digits).alias(k) for k, c in cols])


@query("moving_avg", f"WITH {SQL_SERIES} SELECT user_id, i, round(avg(v) OVER ({BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 6) AS mean FROM series")
def moving_avg(spark, d):
    return slid(series(spark, d), 4, 0, mean=lambda k: op.moving(F.col("v"), "avg", 5, k))


@query("moving_min_max", f"WITH {SQL_SERIES} SELECT user_id, i, round(min(v) OVER w, 6) AS low, round(max(v) OVER w, 6) AS high FROM series WINDOW w AS ({BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def moving_min_max(spark, d):
    return slid(series(spark, d), 4, 0, low=lambda k: op.moving(F.col("v"), "min", 5, k), high=lambda k: op.moving(F.col("v"), "max", 5, k))


@query("moving_geomean", f"WITH {SQL_SERIES}, {POS} SELECT user_id, i, round(exp(avg(ln(v)) OVER ({BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), 6) AS mean FROM positive")
def moving_geomean(spark, d):
    return slid(positive(spark, d), 4, 0, mean=lambda k: op.moving(F.col("v"), "log", 5, k))


@query("smooth_log", f"WITH {SQL_SERIES}, {POS} SELECT user_id, i, round(exp(avg(ln(v)) OVER ({BY} ROWS BETWEEN 4 PRECEDING AND 2 FOLLOWING)), 6) AS smooth FROM positive")
def smooth_log(spark, d):
    return slid(positive(spark, d), 4, 2, smooth=lambda k: op.smooth(F.col("v"), 7, k))


@query("js_smooth", f"WITH {SQL_SERIES}, {POS} SELECT user_id, i, round(exp(avg(ln(v)) OVER ({BY} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), 6) AS smooth FROM positive")
def js_smooth(spark, d):
    return slid(positive(spark, d), 3, 3, smooth=lambda k: op.smooth(F.col("v"), 7, k, ceil=True))


@query("iter_window", f"WITH {SQL_SERIES} SELECT user_id, i, round(min(v) OVER ({BY} ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING), 6) AS low, round(avg(v) OVER ({BY} ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING), 6) AS mean FROM series")
def iter_window(spark, d):
    return slid(series(spark, d), 0, 49, low=lambda k: op.lookahead(F.col("v"), "min", 25, k), mean=lambda k: op.lookahead(F.col("v"), "avg", 100, k))


@query(
    "rate_from_rms",
    f"""WITH {SQL_SERIES}, a AS (SELECT user_id, i, avg(v / 500) OVER ({BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS x FROM series),
m AS (SELECT user_id, i, greatest(1, least(100, power(0.1 / greatest(max(x) OVER ({BY} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 1e-9), 1.5))) AS r FROM a)
SELECT user_id, i, round(avg(r) OVER ({BY} ROWS BETWEEN 24 PRECEDING AND CURRENT ROW), 6) AS rate FROM m""",
)
def rate_from_rms(spark, d):
    def rates(t, k):
        t = t.withColumn("x", F.avg(F.col("v") / 500).over(op.rows(k, "i", 4, 0)))
        high = F.greatest(F.max("x").over(op.rows(k, "i", 24, 0)), F.lit(1e-9))
        t = t.withColumn("r", F.greatest(F.lit(1.0), F.least(F.lit(100.0), F.pow(0.1 / high, 1.5))))
        return t.withColumn("rate", F.avg("r").over(op.rows(k, "i", 24, 0)))

    return out(blocks.sliding(series(spark, d), 52, 0, rates), ("rate", F.col("rate")))


@query("mk_timebend_rate", f"WITH {SQL_SERIES}, z AS (SELECT user_id, i, v / 500 AS v, avg(v / 500) OVER (PARTITION BY user_id) / 2 AS zero FROM series) SELECT user_id, i, round(greatest(1, least(50, 50 * power(100.0::DOUBLE, greatest(-6, least(0, (zero - v) * 100))))), 6) AS rate FROM z")
def mk_timebend_rate(spark, d):
    return out(op.bend_rates(series(spark, d).withColumn("v", F.col("v") / 500)), ("rate", F.col("rate")))


def _bent_sql(source: str) -> str:
    return f"""(WITH a AS (SELECT user_id, i, v, coalesce(lead(v) OVER w, v) AS nx, coalesce(lead(rate) OVER w, rate) AS r FROM {source} WINDOW w AS ({BY})),
  b AS (SELECT *, sum(1 / r) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS t1 FROM a), c AS (SELECT *, coalesce(lag(t1) OVER ({BY}), 0) AS t0, floor(max(t1) OVER (PARTITION BY user_id) + 1e-9) AS n FROM b),
  d AS (SELECT *, unnest(range(CAST(floor(t0) AS BIGINT), greatest(CAST(floor(t0) AS BIGINT), CAST(ceil(t1) AS BIGINT) - 1) + 1)) AS o FROM c),
  e AS (SELECT user_id, o, n, least(t1, o + 1) - greatest(t0, o) AS need, 1 - (greatest(t0, o) - t0) * r AS rest, v, nx FROM d)
  SELECT user_id, o AS i, sum(need * (v * rest + nx * (1 - rest))) AS v FROM e WHERE o < n GROUP BY user_id, o)"""


@query(
    "mk_timebend",
    f"""WITH {SQL_SERIES}, z AS (SELECT user_id, i, v / 500 AS v, avg(v / 500) OVER (PARTITION BY user_id) / 2 AS zero FROM series),
rates AS (SELECT user_id, i, r AS v, r AS rate FROM (SELECT user_id, i, greatest(1, least(50, 50 * power(100.0::DOUBLE, greatest(-6, least(0, (zero - v) * 100))))) AS r FROM z)),
scaled AS {_bent_sql('rates')},
means AS (SELECT user_id, i, avg(v) OVER ({BY} ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS m, 1 / v AS rate FROM scaled),
lows AS (SELECT user_id, i, min(m) OVER ({BY} ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS v, rate FROM means),
jiffed AS {_bent_sql('lows')},
again AS (SELECT user_id, i, v, (SELECT count(*) FROM jiffed k WHERE k.user_id = j.user_id) / (SELECT count(*) FROM rates r WHERE r.user_id = j.user_id)::DOUBLE AS rate FROM jiffed j)
SELECT user_id, i, round(v, 6) AS rate FROM {_bent_sql('again')} x""",
)
def mk_timebend(spark, d):
    """A time-bend's schedule from a user's values: rates bent by themselves, evened out, bent back, and scaled to the first length.

    Each step reads its source several times, so the two in between are written.
    """
    rates = op.bend_rates(series(spark, d).withColumn("v", F.col("v") / 500)).select("user_id", "i", F.col("rate").alias("v"))
    scaled = kept(op.bent(rates.withColumn("rate", F.col("v"))), "scaled")
    even = lambda t, k: t.withColumn("m", op.lookahead(F.col("v"), "avg", 100, k)).withColumn("low", op.lookahead(F.col("m"), "min", 25, k))
    jiffed = kept(op.bent(blocks.sliding(scaled, 0, 61, even).select("user_id", "i", F.col("low").alias("v"), (1 / F.col("v")).alias("rate"))), "jiffed")
    size = lambda t, n: t.groupBy(F.col("user_id").alias("_u")).agg(F.count("*").alias(n))
    both = size(jiffed, "a").join(size(rates, "b"), "_u").select("_u", (F.col("a") / F.col("b")).alias("rate"))
    return op.bent(jiffed.join(both, F.col("user_id") == F.col("_u")).drop("_u")).select("user_id", "i", F.round("v", 6).alias("rate"))


@query("power_norm", f"WITH {SQL_SERIES} SELECT user_id, i, round(exp(-0.45 * power(ln(i + 1), 1.2) + 4.15), 6) AS norm, round(v / exp(-0.45 * power(ln(i + 1), 1.2) + 4.15), 6) AS scaled FROM series")
def power_norm(spark, d):
    norm = F.exp(-0.45 * F.pow(F.ln(F.col("i") + 1), 1.2) + 4.15)
    return out(series(spark, d), ("norm", norm), ("scaled", F.col("v") / norm))


@query("lin_log_roundtrip", f"WITH {SQL_SERIES}, {POS} SELECT user_id, i, round(ln(v), 6) AS log, round(v, 6) AS back FROM positive")
def lin_log_roundtrip(spark, d):
    return out(positive(spark, d), ("log", F.ln("v")), ("back", F.exp(F.ln("v"))))


@query("num_format", f"WITH {SQL_SERIES} SELECT user_id, string_agg(printf('%.3f', floor(v * 1000) / 1000), ', ' ORDER BY i) AS text FROM series GROUP BY user_id")
def num_format(spark, d):
    """Three decimals, cut, not rounded."""
    s = series(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("xs"))
    return s.select("user_id", F.array_join(F.transform("xs", lambda x: F.format_string("%.3f", F.floor(x["v"] * 1000) / 1000)), ", ").alias("text"))


@query("seek_limit", f"WITH {SQL_SERIES} SELECT user_id, i - 25 AS i, v FROM series WHERE i >= 25 AND i < 75")
def seek_limit(spark, d):
    """From second 1 for two seconds at 25 values a second."""
    return series(spark, d).where("i >= 25 and i < 75").select("user_id", (F.col("i") - 25).alias("i"), "v")


@query(
    "history_trace",
    f"""WITH {SQL_SERIES} SELECT a.user_id, a.i, count(*) AS lines, round(sum(power(0.975::DOUBLE, a.i - b.i)), 6) AS ink
FROM series a JOIN series b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 99 AND a.i AND power(0.975::DOUBLE, a.i - b.i) * 0.9 >= 1 / 255.0 AND power(0.975::DOUBLE, a.i - b.i) * 2 >= 0.05 GROUP BY a.user_id, a.i""",
)
def history_trace(spark, d):
    """Rows that a zoomed history of up to 100 draws before it is too faint or too thin, and the sum of their factors."""
    depth = [0.975**k for k in range(100) if 0.975**k * 0.9 >= 1 / 255 and 0.975**k * 2 >= 0.05]
    n = F.least(F.col("i") + 1, F.lit(len(depth)).cast("long"))
    sums = [sum(depth[:k]) for k in range(len(depth) + 1)]
    return series(spark, d).select("user_id", "i", n.alias("lines"), F.round(F.element_at(F.array(*[F.lit(x) for x in sums]), n.cast("int") + 1), 6).alias("ink"))


def _numpipe(how: str, sql: str):
    @query(
        f"numpipe_{how}",
        f"""WITH {SQL_SERIES}, b AS (SELECT user_id, CAST(floor(i * 2 / 7) * (1 + i % 2) AS BIGINT) AS epoch, {sql} AS x FROM series GROUP BY user_id, CAST(floor(i * 2 / 7) * (1 + i % 2) AS BIGINT)),
e AS (SELECT user_id, unnest(range(m + 1)) AS epoch FROM (SELECT user_id, max(epoch) AS m FROM b GROUP BY user_id))
SELECT user_id, e.epoch, round(coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY e.epoch), -1), 6) AS value FROM e LEFT JOIN b USING (user_id, epoch)""",
    )
    def run(spark, d):
        epoch = (F.floor(F.col("i") * 2 / 7) * (1 + F.col("i") % 2)).cast("long")
        got = op.latest(series(spark, d), {"avg": "average"}.get(how, how), epoch, -1.0)
        return got.select("user_id", "epoch", F.round("value", 6).alias("value"))


_numpipe("first", "arg_min(v, i)")
_numpipe("avg", "avg(v)")
_numpipe("last", "arg_max(v, i)")


@query(
    "decay_ewma",
    f"""WITH {SQL_SERIES} SELECT a.user_id, a.i, round(sum(b.v * power(0.9::DOUBLE, a.i - b.i)) / (power(0.9::DOUBLE, a.i + 1) + sum(power(0.9::DOUBLE, a.i - b.i))), 6) AS decayed
FROM series a JOIN series b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.user_id, a.i""",
)
def decay_ewma(spark, d):
    return op.decayed(series(spark, d), 0.9).select("user_id", "i", F.round("out", 6).alias("decayed"))


SQL_EWMA = "sum(b.{x} * power(0.9::DOUBLE, a.i - b.i)) / (power(0.9::DOUBLE, a.i + 1) + sum(power(0.9::DOUBLE, a.i - b.i)))"


@query(
    "ewma_rms",
    f"""WITH {SQL_SERIES}, m AS (SELECT a.user_id, a.i, any_value(a.v) - {SQL_EWMA.format(x='v')} AS dy FROM series a JOIN series b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.user_id, a.i),
q AS (SELECT user_id, i, dy * dy AS y FROM m)
SELECT a.user_id, a.i, round(sqrt({SQL_EWMA.format(x='y')}), 5) AS rms FROM q a JOIN q b ON a.user_id = b.user_id AND b.i <= a.i GROUP BY a.user_id, a.i""",
)
def ewma_rms(spark, d):
    """Decayed mean of the squared distance from the decayed mean, as a root."""
    s = op.decayed(series(spark, d), 0.9).withColumn("y", (F.col("v") - F.col("out")) * (F.col("v") - F.col("out"))).drop("out")
    return op.decayed(s, 0.9, v="y").select("user_id", "i", F.round(F.sqrt("out"), 5).alias("rms"))


@query(
    "bit_change",
    f"""WITH {SQL_SERIES}, b AS (SELECT user_id, i, CAST(v > 50 AS INTEGER) AS bit FROM series), c AS (SELECT *, coalesce(CAST(bit <> lag(bit) OVER ({BY}) AS INTEGER), 0) AS changed FROM b),
k AS (SELECT *, max(CASE WHEN changed = 1 THEN i END) OVER ({BY}) AS since FROM c)
SELECT user_id, i, bit, changed, round(CASE WHEN changed = 1 THEN 0 ELSE (1 - power(0.9::DOUBLE, n)) / 0.1::DOUBLE / (5 * power(0.9::DOUBLE, n) + (1 - power(0.9::DOUBLE, n)) / 0.1::DOUBLE) END, 6) AS glow
FROM (SELECT *, CASE WHEN since IS NULL THEN i + 1 ELSE i - since END AS n FROM k)""",
)
def bit_change(spark, d):
    """Steps since a bit last changed, and the decayed mean of ones since then from 0 with a scale of 5."""
    before = lambda t, k: t.withColumn("changed", F.coalesce((F.col("bit") != F.lag("bit").over(Window.partitionBy(k).orderBy("i"))).cast("int"), F.lit(0)))
    b = blocks.sliding(series(spark, d).withColumn("bit", (F.col("v") > 50).cast("int")), 1, 0, before)
    b = blocks.running(b, {"since": F.when(F.col("changed") == 1, F.col("i"))}, "max")
    n = F.when(F.col("since").isNull(), F.col("i") + 1).otherwise(F.col("i") - F.col("since"))
    left = F.pow(F.lit(0.9), n)
    ones = (1 - left) / 0.1
    glow = F.when(F.col("changed") == 1, 0.0).otherwise(ones / (5 * left + ones))
    return b.select("user_id", "i", "bit", "changed", F.round(glow, 6).alias("glow"))


@query("log_scrape_chunk_avg", "WITH l AS (SELECT event_id, 'raw_rate: ' || printf('%.6f', value) || ', user ' || user_id AS line FROM events), r AS (SELECT event_id, CAST(regexp_extract(line, 'raw_rate:\\s+(\\d+\\.\\d+),', 1) AS DOUBLE) AS rate FROM l), k AS (SELECT sqrt(0.02 / rate) AS s, (event_id // 36) AS chunk FROM r WHERE rate > 0) SELECT chunk, count(*) AS n, round(avg(s), 6) AS mean FROM k GROUP BY chunk")
def log_scrape_chunk_avg(spark, d):
    """Rates scraped from log lines, those at zero dropped; sqrt(0.02 / rate) averaged by 36 lines of the log."""
    e = spark.read.parquet(f"{d}/events.parquet")
    line = F.concat(F.lit("raw_rate: "), F.format_string("%.6f", "value"), F.lit(", user "), F.col("user_id"))
    rate = F.regexp_extract(line, r"raw_rate:\s+(\d+\.\d+),", 1).try_cast("double")
    k = e.select(F.floor(F.col("event_id") / 36).alias("chunk"), rate.alias("rate")).where("rate > 0")
    return k.groupBy("chunk").agg(F.count("*").alias("n"), F.round(F.avg(F.sqrt(0.02 / F.col("rate"))), 6).alias("mean"))


@query("series_elapsed", f"WITH {SQL_SERIES}, f AS (SELECT *, sum(CAST(abs(v) < 1e-9 AS INTEGER)) OVER ({BY}) AS stop FROM series) SELECT user_id, count(*) FILTER (stop = 0) AS n, round(coalesce(sum(1 / v) FILTER (stop = 0), 0), 6) AS elapsed FROM f GROUP BY user_id")
def series_elapsed(spark, d):
    """Sum of 1 / v up to the first zero."""
    s = blocks.running(series(spark, d), {"stops": (F.abs("v") < 1e-9).cast("int")}).withColumn("live", F.col("stops") == 0)
    return s.groupBy("user_id").agg(F.count_if("live").alias("n"), F.round(F.coalesce(F.sum(F.when(F.col("live"), 1 / F.col("v"))), F.lit(0.0)), 6).alias("elapsed"))


@query("kernel_unity", f"WITH {SQL_SERIES}, p AS (SELECT user_id, i, v, (v + lead(v) OVER ({BY})) / 2 AS part FROM series), a AS (SELECT user_id, i, v, sum(part) OVER (PARTITION BY user_id) AS area FROM p) SELECT user_id, i, round(v / area, 6) AS coef FROM a WHERE area > 0")
def kernel_unity(spark, d):
    """A user's values as a kernel scaled to a trapezoid area of 1."""
    part = lambda t, k: t.withColumn("part", (F.col("v") + F.lead("v").over(Window.partitionBy(k).orderBy("i"))) / 2)
    s = blocks.sliding(series(spark, d), 0, 1, part)
    s = s.join(s.groupBy("user_id").agg(F.sum("part").alias("area")), "user_id").where("area > 0")
    return out(s, ("coef", F.col("v") / F.col("area")))


KERNEL = [0.0, 0.25, 0.5, 0.25, 0.0]
NEGATIVE, POSITIVE = [0.1, 0.2, 0.3, 0.2, 0.2], [0.3, 0.2, 0.1, 0.3, 0.1]


def _area_sql(coefs: list[float], x: str) -> str:
    total, parts = 0.0, []
    for n, (a, b) in enumerate(zip(coefs, coefs[1:], strict=False)):
        parts.append(f"WHEN {x} < {n + 1} THEN {total!r} + {a!r}::DOUBLE * ({x} - {n}) + {b - a!r}::DOUBLE * ({x} - {n}) * ({x} - {n}) / 2")
        total += (a + b) / 2
    return f"CASE {' '.join(parts)} ELSE {total!r}::DOUBLE END"


SQL_PITCH = f"{SQL_SERIES}, pitch AS (SELECT user_id, i, v / 100 + 0.5 AS v FROM series)"


@query("kernel_integral", f"WITH {SQL_SERIES}, x AS (SELECT user_id, i, (v * 7) - floor(v * 7) AS f, i % 4 AS n FROM series) SELECT user_id, i, round({_area_sql(KERNEL, '(n + f)')}, 6) AS area FROM x")
def kernel_integral(spark, d):
    s = series(spark, d).withColumn("x", F.col("i") % 4 + (F.col("v") * 7 - F.floor(F.col("v") * 7)))
    return out(s, ("area", op.kernel_area(KERNEL, F.col("x"))))


def _convolve_sql(kernels, prescale: float, linear: bool) -> str:
    def area(k):
        return f"({_area_sql(k, 'x1')}) - ({_area_sql(k, 'x0')})"

    value = f"pv * {prescale!r}::DOUBLE" if linear else f"ln(pv * {prescale!r}::DOUBLE)"
    body = "4 / sum(x1 - x0) * sum(term)"
    return f"""WITH {SQL_PITCH}, t AS (SELECT user_id, i, v, 1 / v AS sa, coalesce(sum(1 / v) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM pitch),
p AS (SELECT h.user_id, h.i, h.v, s.v AS pv, greatest(0, s.t - (h.t - 2 + h.sa / 2)) AS x0, least(4, s.t + s.sa - (h.t - 2 + h.sa / 2)) AS x1 FROM t h JOIN t s ON h.user_id = s.user_id),
w AS (SELECT user_id, i, x0, x1, ({value}) * (CASE WHEN pv < v THEN {area(kernels[0])} WHEN pv > v THEN {area(kernels[2])} ELSE {area(kernels[1])} END) AS term FROM p WHERE x1 > x0)
SELECT user_id, i, round({body if linear else f'exp({body})'} / {prescale!r}, 6) AS out FROM w GROUP BY user_id, i"""


def _convolve(name: str, kernels, prescale: float, linear: bool):
    @query(name, _convolve_sql(kernels if len(kernels) == 3 else kernels * 3, prescale, linear))
    def run(spark, d):
        s = series(spark, d).withColumn("v", F.col("v") / 100 + 0.5)
        return op.pitch_convolve(s, kernels, prescale, linear).select("user_id", "i", F.round("out", 6).alias("out"))


_convolve("tb_convolve", (KERNEL,), 1.3, False)
_convolve("tb_convolve_linear", (KERNEL,), 1.0, True)
_convolve("tb_convolve_signed", (NEGATIVE, KERNEL, POSITIVE), 1.0, False)


@query(
    "hist_interp",
    """WITH h AS (SELECT CAST(floor(value) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1), m AS (SELECT max(k) AS top FROM h), g AS (SELECT unnest(range(top + 1)) AS k FROM m),
j AS (SELECT g.k, n, max(CASE WHEN n IS NOT NULL THEN g.k END) OVER (ORDER BY g.k) AS k0, min(CASE WHEN n IS NOT NULL THEN g.k END) OVER (ORDER BY g.k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS k1 FROM g LEFT JOIN h USING (k))
SELECT j.k AS bin, round(CASE WHEN j.n IS NOT NULL THEN j.n WHEN a.n IS NULL THEN b.n * (j.k + 0.0::DOUBLE) / k1 ELSE a.n + (b.n - a.n) * (j.k - k0) / (k1 - k0)::DOUBLE END, 6) AS level FROM j LEFT JOIN h a ON a.k = k0 LEFT JOIN h b ON b.k = k1""",
)
def hist_interp(spark, d):
    """Counts of whole values, gaps bridged by straight lines; before the first count the line starts at 0."""
    e = spark.read.parquet(f"{d}/events.parquet")
    h = e.groupBy(F.floor("value").cast("long").alias("k")).agg(F.count("*").alias("n"))
    h = blocks.beside(h.withColumn("all", F.lit(0)), ["k", "n"], True, "all", "k").withColumnRenamed("_n", "next")
    h = h.join(h.agg(F.min("k").alias("least"))).withColumn("first", F.col("k") == F.col("least"))
    up = h.select("k", F.col("n").cast("double").alias("n"), F.coalesce("next.k", F.col("k") + 1).alias("k1"), F.coalesce("next.n", "n").cast("double").alias("n1"))
    lead = h.where("first and k > 0").select(F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("n"), F.col("k").alias("k1"), F.col("n").cast("double").alias("n1"))
    g = up.union(lead).withColumn("bin", F.explode(F.sequence("k", F.col("k1") - 1)))
    return g.select("bin", F.round(F.col("n") + (F.col("n1") - F.col("n")) * (F.col("bin") - F.col("k")) / (F.col("k1") - F.col("k")), 6).alias("level"))


def _lines(name: str, known: str) -> str:
    """All levels of ``known`` (stream_id, i, v), ends filled in, on straight lines between those it has."""
    return f"""{name}_k AS (SELECT stream_id, i, CAST(v AS DOUBLE) AS v FROM {known} UNION ALL SELECT stream_id, e.i, e.i FROM keys, (VALUES (0), (255)) e(i) WHERE NOT EXISTS (SELECT 1 FROM {known} k WHERE k.stream_id = keys.stream_id AND k.i = e.i)),
{name}_r AS (SELECT *, lead(i) OVER (PARTITION BY stream_id ORDER BY i) AS i1, lead(v) OVER (PARTITION BY stream_id ORDER BY i) AS v1 FROM {name}_k),
{name} AS (SELECT r.stream_id, CAST(l.i AS BIGINT) AS level, CASE WHEN l.i = r.i THEN r.v ELSE r.v + (v1 - r.v) * (l.i - r.i) / (i1 - r.i) END AS v FROM {name}_r r JOIN range(256) l(i) ON l.i = r.i OR l.i > r.i AND l.i < r.i1)"""


@query(
    "hist_balance",
    f"""WITH RECURSIVE {SQL_FRAMES}, px AS (SELECT stream_id, unnest(px) AS level FROM frames), keys AS (SELECT DISTINCT stream_id FROM px),
n AS (SELECT stream_id, level, count(*) AS n FROM px GROUP BY stream_id, level),
c AS (SELECT k.stream_id, i, coalesce((SELECT sum(n) FROM n WHERE n.stream_id = k.stream_id AND level < i), 0) AS c FROM keys k, range(257) t(i)),
w AS (SELECT stream_id, list(c ORDER BY i) AS c FROM c GROUP BY stream_id),
tree AS (SELECT stream_id, c, 0 AS lo, 256 AS hi, 0 AS clo, 256 AS chi, 0 AS a, 256 AS b FROM w
  UNION ALL SELECT stream_id, c, lo, hi, clo, chi, a, b FROM (
    SELECT stream_id, c, CASE WHEN a < b OR side = 0 THEN lo ELSE (lo + hi) // 2 + 1 END AS lo, CASE WHEN a < b OR side = 1 THEN hi ELSE (lo + hi) // 2 - 1 END AS hi,
      CASE WHEN a < b OR side = 0 THEN clo ELSE a + 1 END AS clo, CASE WHEN a < b OR side = 1 THEN chi ELSE a - 1 END AS chi,
      CASE WHEN a < b THEN CASE WHEN c[(a + b) // 2 + 1] < (c[clo + 1] + c[chi]) / 2 THEN (a + b) // 2 + 1 ELSE a END WHEN side = 0 THEN clo ELSE a + 1 END AS a,
      CASE WHEN a < b THEN CASE WHEN c[(a + b) // 2 + 1] < (c[clo + 1] + c[chi]) / 2 THEN b ELSE (a + b) // 2 - 1 END WHEN side = 1 THEN chi ELSE a - 1 END AS b
    FROM tree, (VALUES (0), (1)) s(side) WHERE a >= b OR side = 0) WHERE lo < hi AND clo < chi),
known AS (SELECT stream_id, (lo + hi) // 2 AS i, a AS v FROM tree WHERE a >= b), {_lines("map", "known")},
back AS (SELECT stream_id, CAST(floor(v) AS INTEGER) AS i, max(level) AS v FROM map GROUP BY 1, 2), {_lines("inv", "back")}
SELECT map.stream_id, map.level, round(map.v, 6) AS mapped, round(inv.v, 6) AS inverse FROM map JOIN inv ON map.stream_id = inv.stream_id AND map.level = inv.level""",
)
def hist_balance(spark, d):
    """The map that balances the luma of each stream by splits at medians, and its inverse."""
    n = frames(spark, d).select("stream_id", F.explode("px").alias("level")).groupBy("stream_id", "level").agg(F.count("*").alias("n"))
    return op.balanced(n, "stream_id").select("stream_id", "level", *[F.round(c, 6).alias(c) for c in ("mapped", "inverse")])


@query("fake_trace", "SELECT s_suppkey AS frame, count(*) AS points, round(min(v), 6) AS low, round(max(v), 6) AS high, round(avg(v), 6) AS mean FROM (SELECT s_suppkey, sin(0.217 * s_suppkey + 0.321 * p) + 20 AS v FROM supplier, range(200) b(p)) f GROUP BY s_suppkey")
def fake_trace(spark, d):
    """A frame of 200 points for each supplier, on a sine that moves on by a phase with its number."""
    f = table(spark, d, "supplier").select(F.col("s_suppkey").alias("frame"))
    v = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda p: F.sin(0.217 * F.col("frame") + 0.321 * p) + 20)
    f = f.withColumn("v", v)
    mean = F.aggregate("v", F.lit(0.0), lambda s, x: s + x) / F.size("v")
    return f.select("frame", F.size("v").cast("long").alias("points"), *[F.round(x, 6).alias(k) for k, x in (("low", F.array_min("v")), ("high", F.array_max("v")), ("mean", mean))])


@query("mk_sin", "SELECT p_partkey, i, round(sin(i * 2 * pi() / (p_size + 1) - pi() / 2) + 1, 6) AS coef FROM (SELECT p_partkey, p_size, unnest(range(p_size + 2)) AS i FROM part)")
def mk_sin(spark, d):
    """A raised sine as a kernel for each part, one period over as many steps as its size and one more."""
    t = table(spark, d, "part").select("p_partkey", "p_size", F.explode(op.sine_kernel(F.col("p_size") + 1)).alias("k"))
    return t.select("p_partkey", F.col("k.i").alias("i"), F.round("k.coef", 6).alias("coef"))


def _resample(name: str, size: int):
    @query(
        name,
        f"""WITH {SQL_FRAMES}, s AS (SELECT stream_id, seq, unnest(range(64)) AS j, unnest(px) AS v FROM frames), o AS (SELECT i FROM range({size}) t(i))
SELECT stream_id, seq, i, round(sum(v * (least(j + 1, (i + 1) * (64 / {size}.0::DOUBLE)) - greatest(j, i * (64 / {size}.0::DOUBLE)))) / (64 / {size}.0::DOUBLE), 6) AS v
FROM s JOIN o ON j < (i + 1) * (64 / {size}.0::DOUBLE) AND j + 1 > i * (64 / {size}.0::DOUBLE) GROUP BY stream_id, seq, i""",
    )
    def run(spark, d):
        f = frames(spark, d).withColumn("v", F.transform("px", lambda x: x.cast("double")))
        f = f.select("stream_id", "seq", F.posexplode(op.resampled(F.col("v"), size)).alias("i", "v"))
        return f.select("stream_id", "seq", F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v"))


_resample("resample_down", 10)
_resample("resample_up", 100)
_resample("resample_scale", -(-64 * 3 // 4))


SQL_BEND = f"""{SQL_PLANES}, n AS (SELECT *, lead(v) OVER (PARTITION BY stream_id, plane, pos ORDER BY seq) AS nx, CASE plane WHEN 0 THEN 16 ELSE 128 END AS fill,
  unnest(range(CAST(floor(round(seq / 1.7::DOUBLE, 9)) AS BIGINT), greatest(CAST(floor(round(seq / 1.7::DOUBLE, 9)) AS BIGINT), CAST(ceil(round((seq + 1) / 1.7::DOUBLE, 9)) AS BIGINT) - 1) + 1)) AS o FROM planes),
b AS (SELECT *, greatest(seq, o * 1.7::DOUBLE) AS t0, least(seq + 1, (o + 1) * 1.7::DOUBLE) AS t1 FROM n),
w AS (SELECT *, (1 - (t0 - seq)) * greatest((t1 - t0) / 1.7::DOUBLE, 0) AS p, (t0 - seq) * greatest((t1 - t0) / 1.7::DOUBLE, 0) AS c FROM b),
s AS (SELECT stream_id, o AS seq, plane, pos, sum(v * p + CASE WHEN c > 1e-5 THEN coalesce(nx, fill) * c ELSE 0 END) + greatest(0, 1 - sum(p + c)) * any_value(fill) AS s FROM w GROUP BY stream_id, o, plane, pos),
f AS (SELECT *, CAST(floor(greatest(16, least(240, round(s, 6)))) AS INTEGER) AS v FROM s)"""


@query("timebend_fixed", f"WITH {SQL_BEND} {ROWS} FROM f {PLANE}")
def timebend_fixed(spark, d):
    """Frames at 1.7 times their speed; a last, partial output is filled up with black."""
    f = planar(spark, d)
    return rows(planes.bent(f, planes.fixed_spans(f, 1.7)))
