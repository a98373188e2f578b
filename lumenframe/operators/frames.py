"""Values of planes as column expressions, and graphs over streams of frames; whole frames are in ``planes``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import blocks

#: Fill of luma and chroma, and the legal output ranges.
FILL_Y, FILL_C, LOW, HIGH_Y, HIGH_C = 16, 128, 16, 235, 240
#: Subsampling of the chroma planes by colourspace, aliases included.
SUBSAMPLING = {"420": (2, 2), "420jpeg": (2, 2), "420mpeg2": (2, 2), "420paldv": (2, 2), "422": (2, 1), "444": (1, 1)}


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def frame_info(px: Column) -> dict[str, Column]:
    """average, min, max, rms, energy of a plane, each over 255; rms is the population deviation, energy that around the minimum."""
    n = F.size(px)
    mean = total(px) / n
    low, high = F.array_min(px), F.array_max(px)
    var = F.aggregate(px, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    return {
        "average": mean / 255,
        "min": low / 255,
        "max": high / 255,
        "rms": F.sqrt(var) / 255,
        "energy": F.sqrt(var + (mean - low) * (mean - low)) / 255,
    }


def clamp(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def scrolled(frames: DataFrame, value: Column, width: int) -> DataFrame:
    """The last ``width`` values as a plot row, newest last, older columns to the left. ``seq`` counts from 0 without gaps."""
    row = lambda t, k: t.withColumn("row", F.collect_list("_v").over(Window.partitionBy(k).orderBy("seq").rowsBetween(-(width - 1), 0)))
    return blocks.sliding(frames.withColumn("_v", value), width - 1, 0, row, "stream_id", "seq").drop("_v")


def graph_points(frames: DataFrame, value: Column, width: int, height: int) -> DataFrame:
    """Graph of the last ``width`` values: points (x, y) with y falling as the value rises, drawn against the right edge."""
    kept = scrolled(frames, value, width)
    x = lambda i: (i + width - F.size("row")).cast("int")
    points = F.transform("row", lambda v, i: F.struct(x(i).alias("x"), ((1 - v) * height).cast("int").alias("y")))
    return kept.withColumn("points", points).drop("row")
