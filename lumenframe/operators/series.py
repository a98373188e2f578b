"""Operators on numeric series (key, i, v): windows, folds, resampling and kernels.

Sliding operators are window frames, to be used inside ``blocks.sliding``. Running sums and folds with a decay go by blocks of
fixed length, a block's start being composed from the blocks before it. Joins of intervals are equi-joins on buckets of the axis.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import blocks

BLOCK = 4096
Key = str | Sequence[str]


def rows(key: Key, order: str, before: int, after: int) -> Window:
    return Window.partitionBy(key).orderBy(order).rowsBetween(-before, after)


def moving(v: Column, how: str, length: int, key: Key = "user_id", order: str = "i") -> Column:
    """avg, min or max of the last ``length`` values; ``log``: their geometric mean."""
    w = rows(key, order, length - 1, 0)
    if how == "log":
        return F.exp(F.avg(F.ln(v)).over(w))
    return getattr(F, how)(v).over(w)


def smooth(v: Column, span: int, key: Key = "user_id", order: str = "i", ceil: bool = False) -> Column:
    """Centred geometric mean of ``span`` values, shrinking at both ends. Odd spans lean back, or with ``ceil`` ahead."""
    half = -(-span // 2) if ceil else span // 2
    return F.exp(F.avg(F.ln(v)).over(rows(key, order, span - half, half - 1)))


def lookahead(v: Column, how: str, width: int, key: Key = "user_id", order: str = "i") -> Column:
    """avg or min of the value and those ahead of it, half a window in all, shrinking at the end."""
    return getattr(F, how)(v).over(rows(key, order, 0, -(-width // 2) - 1))


def decayed(df: DataFrame, rate: float, v: str = "v", out: str = "out", value: float = 0.0, scale: float = 1.0, key: str = "user_id") -> DataFrame:
    """Add the running decayed mean: value = value * rate + x, scale = scale * rate + 1, value / scale, from the given start.

    Series are folded in blocks of ``BLOCK`` rows; rates from 0 up to, but not at, 1. A block takes a start (a, s) to
    (a * rate ^ n + tail, s * rate ^ n + tail), so what each block starts from is a fold over one row for each block, at any rate.
    """
    if not 0 <= rate < 1:
        raise ValueError("the rate must be at least 0 and under 1")
    packed = df.withColumn("_b", F.floor(F.col("i") / BLOCK)).groupBy(key, "_b").agg(F.sort_array(F.collect_list(F.struct("i", F.col(v).cast("double").alias("x"), F.struct(*df.columns).alias("row")))).alias("xs"))

    @F.pandas_udf("struct<a:double,s:double>")
    def tail(xs: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_fold(x, rate, 0.0, 0.0)[-1] for x in xs], columns=["a", "s"])

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, a, s = [], value, scale  # a list holds the key, as a key may be null
        for b in batches:
            begin = []
            for k, n, x, y in zip(*(b.column(c).to_pylist() for c in ("_k", "n", "a", "s")), strict=True):
                if now != [k]:
                    now, a, s = [k], value, scale
                begin.append((a, s))
                a, s = a * rate**n + x, s * rate**n + y
            yield pa.RecordBatch.from_arrays([b.column("_k"), b.column("_c"), *(pa.array([float(p[j]) for p in begin], pa.float64()) for j in (0, 1))], names=["_k", "_c", "_a", "_s"])

    @F.pandas_udf("array<double>")
    def states(xs: pd.Series, a: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([[p / q for p, q in _fold(x, rate, a0, s0)] for x, a0, s0 in zip(xs, a, s, strict=True)])

    ends = packed.select(F.col(key).alias("_k"), F.col("_b").alias("_c"), F.size("xs").alias("n"), tail("xs.x").alias("t")).select("_k", "_c", "n", "t.a", "t.s")
    kind = df.schema[key].dataType.simpleString()
    begin = ends.repartition("_k").sortWithinPartitions("_k", "_c").mapInArrow(carry, f"_k {kind}, _c long, _a double, _s double")
    packed = packed.join(begin, packed[key].eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_c")))
    rows_ = packed.select(F.explode(F.arrays_zip("xs", states("xs.x", "_a", "_s").alias("st"))).alias("z"))
    return rows_.select("z.xs.row.*", F.col("z.st").alias(out))


def _fold(xs, rate: float, a: float, s: float) -> list[tuple[float, float]]:
    out = []
    for x in xs:
        a, s = a * rate + x, s * rate + 1
        out.append((a, s))
    return out


#: The least and greatest rate of a time-bend, and how steeply it falls with the value.
RATE_MIN, RATE_MAX, RATE_BASE, RATE_BOOST = 1.0, 50.0, 100.0, 100.0


def bend_rates(df: DataFrame, key: str = "user_id") -> DataFrame:
    """Add ``rate`` to (key, v): RATE_MAX * RATE_BASE ^ ((half the key's mean - v) * RATE_BOOST), held between RATE_MIN and RATE_MAX.

    Means come from one partial aggregation, so a key with most rows is no task of its own. The power is held where both limits
    are passed long since, so that no value overflows.
    """
    mean = df.groupBy(F.col(key).alias("_k")).agg((F.avg("v") / 2).alias("_zero"))
    t = df.join(mean, df[key].eqNullSafe(F.col("_k"))).drop("_k")
    power = F.greatest(F.lit(-6.0), F.least(F.lit(0.0), (F.col("_zero") - F.col("v")) * RATE_BOOST))
    return t.withColumn("rate", F.greatest(F.lit(RATE_MIN), F.least(F.lit(RATE_MAX), RATE_MAX * F.pow(F.lit(RATE_BASE), power)))).drop("_zero")


def bent(df: DataFrame, v: str = "v", rate: str = "rate", key: str = "user_id") -> DataFrame:
    """Time-bend a series (key, i, v, rate) to whole ticks of output time: (key, i, v).

    The way from a value to the next takes 1 / rate of output time, the rate being that of the next value; the last value
    stays for one such way more. A tick holds the values that pass in it, each piece at the mix where it begins. A last tick
    that is not filled goes.
    """
    n = blocks.LENGTH
    # null keys are one key: in a struct they are equal, so that windows and the join go by the same columns and rows are dealt and sorted once
    t = df.select(F.struct(F.col(key).alias("k")).alias("_s"), "i", F.col(v).alias("v"), F.col(rate).alias("_r"))
    t = t.withColumn("_blk", F.explode(F.sequence(F.floor(F.greatest(F.col("i") - 1, F.lit(0)) / n), F.floor(F.col("i") / n))))
    w = Window.partitionBy("_s", "_blk").orderBy("i")
    t = t.withColumns({c: F.coalesce(F.lead(x).over(w), F.col(x)) for c, x in (("nx", "v"), ("r", "_r"))}).drop("_r")
    way = lambda end: F.sum(1 / F.col("r")).over(w.rowsBetween(Window.unboundedPreceding, end))
    t = t.withColumns({"t1": way(0), "t0": F.coalesce(way(-1), F.lit(0.0))}).where(F.col("_blk") == F.floor(F.col("i") / n))
    totals = t.groupBy(F.col("_s").alias("_k"), F.col("_blk").alias("_c")).agg(F.max_by("t1", "i").alias("x"))
    upto = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_t", F.coalesce(F.sum("x").over(upto), F.lit(0.0)))
    totals = totals.select("_k", "_c", "_t", F.floor(F.max(F.col("_t") + F.col("x")).over(Window.partitionBy("_k")) + 1e-9).alias("_n"))
    t = t.join(totals, (F.col("_s") == F.col("_k")) & (F.col("_blk") == F.col("_c")))
    t = t.select("_s", "v", "nx", "r", (F.col("_t") + F.col("t0")).alias("t0"), (F.col("_t") + F.col("t1")).alias("t1"), "_n")
    t = t.withColumn("lo", F.floor("t0")).withColumn("hi", F.greatest("lo", F.ceil("t1") - 1))

    def mix(begin: Column) -> Column:
        left = 1 - (begin - F.col("t0")) * F.col("r")
        return F.col("v") * left + F.col("nx") * (1 - left)

    def piece(o: Column) -> Column:
        begin, end = F.greatest("t0", o.cast("double")), F.least("t1", o + 1.0)
        return F.struct(o.alias("o"), ((end - begin) * mix(begin)).alias("x"), F.lit(None).cast("long").alias("e"))

    # ways share ticks only at their two ends; the ticks between stay one row up to the last of them, e, until the ends are added up
    inner = F.struct((F.col("lo") + 1).alias("o"), F.lit(None).cast("double").alias("x"), F.least(F.col("hi"), F.col("_n")).alias("e"))
    ends = F.array(piece(F.col("lo")), F.when(F.col("hi") > F.col("lo"), piece(F.col("hi"))), F.when(F.col("hi") > F.col("lo") + 1, inner))
    t = t.select("*", F.explode(ends).alias("p")).where(F.col("p.o") < F.col("_n"))
    held = [F.max(F.when(F.col("p.e").isNotNull(), F.col(c))).alias(c) for c in ("t0", "r", "v", "nx")]
    out = t.groupBy("_s", F.col("p.o").alias("o")).agg(F.sum("p.x").alias("x"), F.max("p.e").alias("e"), *held)
    out = out.withColumn("i", F.explode(F.sequence("o", F.coalesce(F.col("e") - 1, "o"))))
    return out.select(F.col("_s.k").alias(key), F.col("i").cast("long").alias("i"), F.when(F.col("e").isNull(), F.col("x")).otherwise(mix(F.col("i"))).alias("v"))


def translated(df: DataFrame, ticks: int, key: str = "user_id") -> DataFrame:
    """Rates (key, i, v > 0) played onto an output clock of ``ticks`` ticks: (key, tick, value, stop).

    The way from a value to the next takes 1 / v of output time; it is cut at whole ticks. A piece adds its length over the
    area under the rates, joined by lines and falling to 0 after the last, on as long a stretch of input from where it
    begins. ``stop`` is where the clock stands when the input ends, ``ticks`` at most.
    """
    size = df.groupBy(F.col(key).alias("_z")).agg(F.count("*").alias("n"))
    t = blocks.sliding(df.select(key, "i", "v"), 0, 1, lambda t, k: t.withColumn("nx", F.lead("v").over(Window.partitionBy(k).orderBy("i"))), key)
    t = t.join(size, F.col(key).eqNullSafe(F.col("_z"))).drop("_z")
    passed = F.when(F.col("nx").isNotNull(), 1 / F.col("v"))
    t = blocks.running(t, {"t1": passed, "c1": (F.col("v") + F.coalesce("nx", F.lit(0.0))) / 2}, key=key)
    t = t.withColumns({"t0": F.col("t1_before"), "c": F.col("c1_before"), "last": F.col("nx").isNull(), "nx": F.coalesce("nx", F.lit(0.0))})
    clock = F.array(*[F.struct(F.lit(o).alias("tick"), F.lit(0.0).alias("x")) for o in range(ticks)])
    every = t.groupBy(key).agg(F.least(F.lit(float(ticks)), F.coalesce(F.max(F.when(~F.col("last"), F.col("t1"))), F.lit(0.0))).alias("stop"))
    p = t.where(~F.col("last") & (F.col("t0") < ticks)).withColumn("tick", F.explode(F.sequence(F.floor("t0"), F.least(F.lit(ticks - 1), F.greatest(F.floor("t0"), F.ceil("t1") - 1)))))
    a, b = F.greatest("t0", F.col("tick").cast("double")), F.least("t1", F.col("tick") + 1.0)
    p = p.withColumns({"_l": b - a, "_f": (a - F.col("t0")) * F.col("v")}).where("_l > 0")
    area = lambda c, v, nx, f: c + v * f + (nx - v) * f * f / 2
    end = F.least(F.col("i") + F.col("_f") + F.col("_l"), F.col("n").cast("double"))
    p = p.select(F.col(key).alias("_k"), "tick", "_l", area(F.col("c"), F.col("v"), F.col("nx"), F.col("_f")).alias("_from"), end.alias("_e"), F.least(F.floor(end), F.col("n") - 1).alias("_i"))
    p = p.join(t.select(key, "i", "c", "v", "nx"), F.col("_k").eqNullSafe(F.col(key)) & (F.col("_i") == F.col("i")))
    p = p.select(key, "tick", (F.col("_l") / (area(F.col("c"), F.col("v"), F.col("nx"), F.col("_e") - F.col("_i")) - F.col("_from"))).alias("x"))
    full = p.unionByName(every.select(key, F.inline(clock))).groupBy(key, "tick").agg(F.sum("x").alias("value"))
    return full.join(every, key).select(key, F.col("tick").cast("int").alias("tick"), "value", "stop")


def sine_kernel(steps: Column) -> Column:
    """One period of a raised sine over ``steps`` steps, lowest at both ends: an array of (i, coef)."""
    every = F.sequence(F.lit(0).cast("long"), steps.cast("long"))
    return F.transform(every, lambda i: F.struct(i.alias("i"), (F.sin(i * 2 * F.pi() / steps - F.pi() / 2) + 1).alias("coef")))


def kernel_area(coefs: list[float], x: Column) -> Column:
    """Integral from 0 to x of the piecewise-linear kernel through the coefficients at 0, 1, 2, ...; x within the kernel."""
    total, out = 0.0, None
    for n, (a, b) in enumerate(zip(coefs, coefs[1:], strict=False)):
        part = total + a * (x - n) + (b - a) * (x - n) * (x - n) / 2
        out = F.when(x < n + 1, part) if out is None else out.when(x < n + 1, part)
        total += (a + b) / 2
    return F.lit(total) if out is None else out.otherwise(total)


def pitch_convolve(df: DataFrame, kernels: tuple[list[float], ...], prescale: float = 1.0, linear: bool = False, key: str = "user_id") -> DataFrame:
    """Convolve (key, i, v), v >= 0, with a kernel whose axis runs at 1 / v: fast samples pass it quickly, one of zero takes half the kernel.

    A sample is the interval [T, T + 1 / v) of the axis, T the sum of 1 / v before it. At home sample h the kernel lies on
    [T_h - centre + 1 / (2 v_h), + width]. Three kernels apply to samples under, at and over the home value. The overlap
    join goes by buckets of the kernel's width. However long a sample is, only its ends and its middle are in reach of a kernel,
    its own or a neighbour's, so it stands in a few buckets. Kernels of one coefficient have no width and so no area: out is NaN.
    """
    kernels = kernels if len(kernels) == 3 else kernels * 3
    width = len(kernels[0]) - 1
    if any(len(k) - 1 != width for k in kernels) or width < 0:
        raise ValueError("the kernels must have one length, of at least one coefficient")
    if width == 0:
        return df.select(key, "i", F.lit(float("nan")).alias("out"))
    step = F.when(F.abs("v") < 1e-5, width / 2).otherwise(1 / F.when(F.abs("v") >= 1e-5, F.col("v")))
    t = blocks.running(df.withColumn("sa", step), {"_t": F.col("sa")}, key=key).drop("_t").withColumnRenamed("_t_before", "t")
    bucket = lambda x: F.floor(x / width)
    between = lambda x, y: F.sequence(bucket(x), bucket(y))
    begin, end, half = F.col("t"), F.col("t") + F.col("sa"), F.col("t") + F.col("sa") / 2
    reach = F.array_distinct(F.concat(between(begin, begin + width), between(half - width / 2, half + width / 2), between(end - width, end)))
    reach = F.when(F.col("sa") <= 3 * width, between(begin, end)).otherwise(reach)
    samples = t.select(F.col(key), F.col("i").alias("p"), F.col("v").alias("pv"), F.col("t").alias("pt"), "sa", F.explode(reach).alias("_b"))
    low = F.col("t") - width / 2 + F.col("sa") / 2
    homes = t.select(F.col(key), "i", "v", low.alias("low"), F.explode(F.sequence(bucket(low), bucket(low + width))).alias("_b"))
    pairs = homes.join(samples, [key, "_b"])
    begin = F.greatest(F.col("pt") - F.col("low"), F.lit(0.0))
    end = F.least(F.col("pt") + F.col("sa") - F.col("low"), F.lit(float(width)))
    # a pair that meets in two buckets counts where its overlap begins
    once = F.col("_b") == F.greatest(bucket(F.col("pt")), bucket(F.col("low")))
    pairs = pairs.where(once).withColumns({"x0": begin, "x1": end}).where("x1 > x0")
    area = lambda k: kernel_area(k, F.col("x1")) - kernel_area(k, F.col("x0"))
    weight = F.when(F.col("pv") < F.col("v"), area(kernels[0])).when(F.col("pv") > F.col("v"), area(kernels[2])).otherwise(area(kernels[1]))
    value = F.col("pv") * prescale
    term = (value if linear else F.ln(value)) * weight
    got = pairs.groupBy(key, "i").agg((width / F.sum(F.col("x1") - F.col("x0")) * F.sum(term)).alias("s"))
    out = F.col("s") if linear else F.exp("s")
    return got.select(key, "i", (out / prescale).alias("out"))


def let(x: Column, use) -> Column:
    """``use(x)`` with x computed once a row, however often the expression names it."""
    return F.transform(F.array(x), use)[0]


def resampled(v: Column, size: int) -> Column:
    """Area resampling of an array to ``size`` values: overlap-weighted means; empty input gives zeros."""
    return let(v, lambda x: _resampled(x, size))


def _resampled(v: Column, size: int) -> Column:
    n = F.size(v)
    s = n / F.lit(float(size))

    def cell(i: Column) -> Column:
        lo, hi = i * s, (i + 1) * s
        first = F.floor(lo).cast("int")
        count = F.least(n, F.ceil(hi).cast("int")) - first
        part = F.transform(F.slice(v, first + 1, F.greatest(count, F.lit(0))), lambda x, j: x * F.greatest(F.lit(0.0), F.least(j + first + 1, hi) - F.greatest(j + first, lo)))
        return F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / s

    cells = F.sequence(F.lit(0), F.lit(size - 1))
    return F.when(n == 0, F.transform(cells, lambda _: F.lit(0.0))).when(n == size, v).otherwise(F.transform(cells, cell))


def latest(df: DataFrame, how: str, epoch: Column, default: float, key: str = "user_id") -> DataFrame:
    """Rate matching: what a reader gets at every epoch, first, average or last of the values put since the one before, else again what it got."""
    put = df.withColumn("epoch", epoch)
    value = {"first": F.min_by("v", "i"), "average": F.avg("v"), "last": F.max_by("v", "i")}[how]
    got = put.groupBy(key, "epoch").agg(value.alias("x"))
    most = got.groupBy(key).agg(F.max("epoch").alias("m"))
    every = most.select(key, F.explode(F.sequence(F.lit(0).cast("long"), "m")).alias("epoch"))
    t = every.join(got, [key, "epoch"], "left")
    held = blocks.running(t, {"_h": F.when(F.col("x").isNotNull(), F.struct("epoch", "x"))}, "max", key, "epoch")  # the latest put so far
    return held.select(key, "epoch", F.coalesce("_h.x", F.lit(default)).alias("value"))


#: Levels of a histogram, and how often their range can be halved.
LEVELS, HALVINGS = 256, 9


def _median(upto: Column, lo: Column, hi: Column) -> Column:
    """Place in [lo, hi) of a cumulative histogram where half the counts between are passed, found by halving steps."""
    half = (upto[lo] + upto[hi - 1]) / 2

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s.lo + s.hi) / 2).cast("int")
        low = upto[mid] < half
        return F.when(s.lo >= s.hi, s).otherwise(F.struct(F.when(low, mid + 1).otherwise(s.lo).alias("lo"), F.when(low, s.hi).otherwise(mid - 1).alias("hi")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(HALVINGS)), F.struct(lo.alias("lo"), hi.alias("hi")), step).lo


def _bridged(known: Column) -> Column:
    """An array of LEVELS values from a map of some of them: lines between neighbours, 0 and LEVELS - 1 at ends that the map lacks."""
    ends = lambda i: F.when(i == 0, F.lit(0)).when(i == LEVELS - 1, F.lit(LEVELS - 1))
    level = F.sequence(F.lit(0), F.lit(LEVELS - 1))
    whole = F.transform(level, lambda i: F.struct(i.alias("i"), F.coalesce(known[i], ends(i)).cast("double").alias("v")))

    def lines(knots: Column) -> Column:
        runs = F.zip_with(F.slice(knots, 1, F.size(knots) - 1), F.slice(knots, 2, F.size(knots) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        points = lambda r: F.transform(F.sequence(r.a.i, r.b.i - 1), lambda i: r.a.v + (r.b.v - r.a.v) * (i - r.a.i) / (r.b.i - r.a.i))
        return F.concat(F.flatten(F.transform(runs, points)), F.array(F.element_at(knots, -1).v))

    return let(F.filter(whole, lambda p: p.v.isNotNull()), lines)


def balanced(counts: DataFrame, key: str) -> DataFrame:
    """Histograms (key, level, n), level from 0 to 255, -> (key, level, mapped, inverse): the map that balances each, and its inverse.

    The middle of a range of outputs takes the median of its range of inputs; the ranges on both sides follow, level by level,
    each without its neighbour of the middle below. What is left between is bridged by straight lines, and so is the inverse,
    where of levels with one whole output the last counts. A key is one array of 256 counts, whatever its rows were, so the
    splitting needs no shuffle. Null keys are one key; levels and counts that are null count nothing; others out of range are
    an error. No rows: no rows.
    """
    inside = F.when(F.col("level").isNull() | F.col("level").between(0, LEVELS - 1), F.col("level")).otherwise(F.raise_error(F.lit("a level is out of range")))
    some = counts.select(key, inside.cast("int").alias("level"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    some = some.groupBy(key, "level").agg(F.sum("n").alias("n"))
    h = some.groupBy(key).agg(F.map_from_entries(F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", "n")))).alias("_h"))
    count = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda i: F.coalesce(F.col("_h")[i], F.lit(0).cast("long")))
    h = h.withColumn("_n", count)
    grow = lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x))
    h = h.withColumn("_c", F.aggregate("_n", F.array(F.lit(0).cast("long")), grow))

    def node(lo, hi, clo, chi):
        return F.struct(lo.alias("lo"), hi.alias("hi"), clo.alias("clo"), chi.alias("chi"))

    def split(s: Column, _: Column) -> Column:
        cut = F.transform(s.todo, lambda r: F.struct(r.alias("r"), F.floor((r.lo + r.hi) / 2).cast("int").alias("mid"), _median(F.col("_c"), r.clo, r.chi).alias("half")))

        def after(t: Column) -> Column:
            both = F.flatten(F.transform(t, lambda x: F.array(node(x.r.lo, x.mid - 1, x.r.clo, x.half - 1), node(x.mid + 1, x.r.hi, x.half + 1, x.r.chi))))
            done = F.concat(s.done, F.transform(t, lambda x: F.struct(x.mid.alias("i"), x.half.alias("v"))))
            return F.struct(F.filter(both, lambda r: (r.lo < r.hi) & (r.clo < r.chi)).alias("todo"), done.alias("done"))

        return let(cut, after)

    zero, top = F.lit(0), F.lit(LEVELS)
    start = F.struct(F.array(node(zero, top, zero, top)).alias("todo"), F.array().cast("array<struct<i:int,v:int>>").alias("done"))
    h = h.withColumn("_done", F.aggregate(F.sequence(F.lit(0), F.lit(HALVINGS)), start, split).done)
    h = h.withColumn("_map", _bridged(F.map_from_entries("_done")))
    back = F.transform("_map", lambda v, i: F.struct(F.floor(v).cast("int").alias("o"), i.alias("i")))
    last = lambda pairs: F.filter(pairs, lambda p: ~F.exists(pairs, lambda q: (q.o == p.o) & (q.i > p.i)))
    h = h.withColumn("_back", back).withColumn("_inv", _bridged(F.map_from_entries(last(F.col("_back")))))
    return h.select(key, F.posexplode(F.arrays_zip(F.col("_map").alias("m"), F.col("_inv").alias("v"))).alias("level", "z")).select(key, F.col("level").cast("long").alias("level"), F.col("z.m").alias("mapped"), F.col("z.v").alias("inverse"))
