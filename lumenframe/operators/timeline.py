"""Clip algebra as rows of (framenum, clip_id, local_frame): every composition is arithmetic on ranges and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frames_of(clips: DataFrame) -> DataFrame:
    """A row for each frame of clips (clip_id, frames), with its portion of the clip gone by."""
    t = clips.select("clip_id", "frames", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)).alias("local_frame"))
    return t.withColumn("portion", F.col("local_frame") / F.col("frames"))


def sequence(clips: DataFrame, order: str = "clip_id") -> DataFrame:
    """Clips one after another: each begins where those before it end."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)  # a row for each clip
    placed = clips.withColumn("first", F.coalesce(F.sum("frames").over(w), F.lit(0)))
    t = placed.select("clip_id", "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)).alias("local_frame"))
    return t.select((F.col("first") + F.col("local_frame")).alias("framenum"), "clip_id", "local_frame")


def reverse(timeline: DataFrame, total: Column) -> DataFrame:
    return timeline.withColumn("framenum", total - 1 - F.col("framenum"))


def edit(timeline: DataFrame, start: int, frames: int) -> DataFrame:
    """A cut of ``frames`` frames from ``start``, as far as the timeline goes, numbered from 0."""
    return timeline.where((F.col("framenum") >= start) & (F.col("framenum") < start + frames)).withColumn("framenum", F.col("framenum") - start)


def ramp(portion: Column, low: float, high: float) -> Column:
    return (high - low) * portion + low


def circle(portion: Column, turns: float, phase: float, amp: float) -> tuple[Column, Column]:
    angle = (portion * turns + phase) * 2 * F.pi()
    return F.sin(angle) * amp, F.cos(angle) * amp


def dissolve(pairs: DataFrame, frames: int, easing=lambda x: x) -> DataFrame:
    """(a, na, nb) -> (a, framenum, layer, local_frame, alpha): clip a gives way to the next over ``frames`` frames, or as many as both have.

    While they overlap the lower clip has 1 - mix and the upper one mix, the eased share of the overlap gone by; outside it a
    clip stands alone.
    """
    zero = F.lit(0).cast("long")
    p = pairs.withColumn("f", F.least(F.lit(frames), "na", "nb")).withColumn("start", F.col("na") - F.col("f"))

    def mix(n: Column) -> Column:
        return easing(n / F.when(F.col("f") > 0, F.col("f")))

    under = p.withColumn("n", F.explode(F.sequence(zero, F.col("na") - 1)))
    fading = F.when(F.col("n") < F.col("start"), 1.0).otherwise(1 - mix(F.col("n") - F.col("start")))
    under = under.select("a", F.col("n").alias("framenum"), F.lit("under").alias("layer"), F.col("n").alias("local_frame"), fading.alias("alpha"))
    over = p.withColumn("n", F.explode(F.sequence(zero, F.col("nb") - 1)))
    rising = F.when(F.col("n") < F.col("f"), mix(F.col("n"))).otherwise(1.0)
    over = over.select("a", (F.col("start") + F.col("n")).alias("framenum"), F.lit("over").alias("layer"), F.col("n").alias("local_frame"), rising.alias("alpha"))
    return under.unionByName(over)


def mapped(clips: DataFrame, make, key: str = "sequence_id") -> DataFrame:
    """Sequences (key, pos, clip) with every clip replaced by those ``make(clip, pos)`` gives, an array that may be empty or null, numbered anew."""
    t = clips.select(key, F.col("pos").alias("_p"), F.posexplode(make(F.col("clip"), F.col("pos"))).alias("_q", "clip"))
    pos = F.row_number().over(Window.partitionBy(key).orderBy("_p", "_q")) - 1
    return t.select(key, pos.cast("long").alias("pos"), "clip")


def reduced(clips: DataFrame, merge, key: str = "sequence_id") -> DataFrame:
    """(key, clip): the clips of each sequence, first to last, folded by ``merge(sofar, clip)``; where that is null the fold stays as it was. A sequence's clips are one array."""
    t = clips.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "clip"))).alias("xs"))
    fold = F.aggregate(F.slice("xs", 2, F.size("xs")), F.element_at("xs", 1)["clip"], lambda sofar, x: F.coalesce(merge(sofar, x["clip"]), sofar))
    return t.select(key, fold.alias("clip"))


MATRIX = ("a", "b", "c", "d", "e", "f")


def matrix(*values) -> Column:
    """A 2 x 3 matrix as a struct: x' = a x + c y + e, y' = b x + d y + f."""
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("double").alias(n) for n, v in zip(MATRIX, values, strict=True)])


def times(m: Column, n: Column) -> Column:
    """The matrix that applies n first, then m."""
    return matrix(
        m["a"] * n["a"] + m["c"] * n["b"], m["b"] * n["a"] + m["d"] * n["b"], m["a"] * n["c"] + m["c"] * n["d"], m["b"] * n["c"] + m["d"] * n["d"],
        m["a"] * n["e"] + m["c"] * n["f"] + m["e"], m["b"] * n["e"] + m["d"] * n["f"] + m["f"],
    )


def transform(width: float, height: float, origin=(0.5, 0.5), rotate=0.0, scale=(1.0, 1.0), move=(0.0, 0.0), raw=(1.0, 0.0, 0.0, 1.0, 0.0, 0.0)) -> Column:
    """A clip's transform on a canvas: about the origin scale, rotate and move, then the raw matrix, each in the axes the former left. Numbers or columns."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    ox, oy = lit(origin[0]) * width, lit(origin[1]) * height
    sx, sy, turn = lit(scale[0]), lit(scale[1]), lit(rotate)
    a, b, c, d = sx * F.cos(turn), sy * F.sin(turn), -sx * F.sin(turn), sy * F.cos(turn)
    ux, uy = lit(move[0]) - ox, lit(move[1]) - oy
    placed = matrix(a, b, c, d, a * ux + c * uy + ox, b * ux + d * uy + oy)
    return times(placed, matrix(*raw))


def composed(nested: DataFrame, key: str, depth: str = "depth", m: str = "m") -> DataFrame:
    """(key, m): the transforms (key, depth, m) around each clip, the outermost at the least depth, as one matrix. A clip's nesting is one array."""
    t = nested.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(depth).alias("depth"), F.col(m).alias("m")))).alias("xs"))
    return t.select(key, F.aggregate("xs", matrix(1, 0, 0, 1, 0, 0), lambda whole, x: times(whole, x["m"])).alias("m"))


def moved(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def affine(x: Column, y: Column, scale: float, turn: float, dx: float, dy: float) -> tuple[Column, Column]:
    """Scale, rotate by ``turn`` radians, then move."""
    s, c = F.sin(F.lit(turn)), F.cos(F.lit(turn))
    return scale * (x * c - y * s) + dx, scale * (x * s + y * c) + dy
