"""Points in the plane: an adaptive quadtree as a table, and nearest neighbours by descending it.

Cells are named by level and by their column and row on that level, which are prefixes of a point's Morton code. A cell with more
than ``CAP`` places is internal; its four quarters follow on the next level. Which cells exist depends on the points alone, not
on the order in which they come, so one aggregation over prefixes gives the whole tree.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.streaming import run

#: Fixed value: the most points of a leaf.
CAP = 20
#: Levels whose cells, at most 4 ** TOP, are sent to every task; below, cells are joined by their names.
TOP = 6
CELL = ["level", "cx", "cy"]


def levels_of(width: int, height: int) -> int:
    """Halvings from the square that holds the plane, its side a power of two, down to a unit."""
    return max(0, (max(width, height) - 1).bit_length())


def within(points: DataFrame, width: int, height: int) -> DataFrame:
    """Points (tag, x, y) that the plane takes: null coordinates and those outside [0, width) x [0, height) go."""
    return points.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def cells(points: DataFrame, levels: int, cap: int = CAP) -> DataFrame:
    """Every cell of the tree that holds points (x, y, whole numbers): CELL, n, the tight box lx, ly, hx, hy, and ``leaf``.

    Places are counted first, so rows that repeat a place are folded before anything is spread over levels. A cell is part of the
    tree when the one above it holds more than ``cap`` points; a unit cell is a leaf however many points lie on it.
    """
    place = points.groupBy("x", "y").agg(F.count("*").alias("n"))
    spread = place.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    up = lambda c: F.expr(f"shiftright({c}, {levels} - level)").cast("long")
    named = spread.select("level", up("x").alias("cx"), up("y").alias("cy"), "x", "y", "n")
    box = [F.min("x").alias("lx"), F.min("y").alias("ly"), F.max("x").alias("hx"), F.max("y").alias("hy")]
    every = named.groupBy(*CELL).agg(F.sum("n").alias("n"), *box)
    full = every.where(F.col("n") > cap)
    above = full.select((F.col("level") + 1).alias("level"), F.col("cx").alias("_x"), F.col("cy").alias("_y"))
    half = lambda c: F.shiftright(c, 1)
    below = every.where("level > 0").join(above, (every["level"] == above["level"]) & (half(every["cx"]) == F.col("_x")) & (half(every["cy"]) == F.col("_y")), "left_semi")
    tree = every.where("level = 0").unionByName(below)
    return tree.withColumn("leaf", (F.col("n") <= cap) | (F.col("level") == levels))


def leaves(points: DataFrame, width: int, height: int, cap: int = CAP) -> DataFrame:
    """Leaves of the quadtree over the plane: level, the corners x0, y0, x1, y1 of the cell, and n, its points."""
    levels = levels_of(width, height)
    side = F.expr(f"shiftleft(1L, {levels} - level)")
    t = cells(within(points, width, height), levels, cap).where("leaf")
    return t.select("level", (F.col("cx") * side).alias("x0"), (F.col("cy") * side).alias("y0"), ((F.col("cx") + 1) * side).alias("x1"), ((F.col("cy") + 1) * side).alias("y1"), "n")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: what several steps read is computed once and outlives executors."""
    spark, path = df.sparkSession, f"{run.folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _least(lo: str, hi: str, q: str) -> Column:
    d = F.greatest(F.col(lo) - F.col(q), F.col(q) - F.col(hi), F.lit(0))
    return d * d


def _most(lo: str, hi: str, q: str) -> Column:
    d = F.greatest(F.abs(F.col(q) - F.col(lo)), F.abs(F.col(q) - F.col(hi)))
    return d * d


def nearest(queries: DataFrame, points: DataFrame, width: int, height: int, cap: int = CAP) -> DataFrame:
    """(tag, x, y) of ``queries`` -> tag, dist (squared), target, visited: the nearest of ``points`` (tag, x, y), of equals the least tag.

    Places that repeat count once on both sides, so neither a crowd of queries nor of points at one place is compared twice.
    Queries go down the tree level by level and keep the cells whose boxes begin no farther than the least far end of any box they
    have: some point lies that near. Of the leaves left, the one that begins nearest is looked into first; the others only where
    they begin no farther than what it gave. ``visited`` counts the places a query was compared with. Queries may lie anywhere; a null
    coordinate, or no points, gives no row.
    """
    levels = levels_of(width, height)
    targets = within(points, width, height).groupBy("x", "y").agg(F.min("tag").alias("target"))
    tree = kept(cells(targets, levels, cap), "tree")
    asked = queries.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(F.col("x").alias("qx"), F.col("y").alias("qy")).distinct()
    by = Window.partitionBy("qx", "qy")

    def bounded(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"lb": _least("lx", "hx", "qx") + _least("ly", "hy", "qy"), "ub": _most("lx", "hx", "qx") + _most("ly", "hy", "qy")})
        return rows.withColumn("reach", F.min("ub").over(by)).where("lb <= reach").drop("ub", "reach")

    front = bounded(asked.join(F.broadcast(tree.where("level = 0"))))  # the root, one row
    for level in range(levels):
        kids = tree.where(F.col("level") == level + 1).select(F.shiftright("cx", 1).alias("_x"), F.shiftright("cy", 1).alias("_y"), *[F.col(c).alias(f"_{c}") for c in tree.columns])
        kids = F.broadcast(kids) if level < TOP else kids
        # a leaf meets no child and stays as it is; an internal cell gives way to its children
        aside = -1 - F.pmod(F.xxhash64("qx", "qy"), F.lit(1 << 20))  # no cell's name, and not one for all leaves
        front = front.withColumns({"_px": F.when(~F.col("leaf"), F.col("cx")).otherwise(aside), "_py": F.when(~F.col("leaf"), F.col("cy")).otherwise(aside)})
        grown = front.join(kids, (F.col("_px") == F.col("_x")) & (F.col("_py") == F.col("_y")), "left")
        front = bounded(grown.select("qx", "qy", *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in tree.columns]))
    front = kept(front.withColumn("turn", F.row_number().over(by.orderBy("lb", *CELL))), "front")

    # every place with the name of its leaf, by the levels that leaves have
    some = tree.where("leaf").select(*CELL)
    at = targets.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    at = at.withColumns({"cx": F.expr(f"shiftright(x, {levels} - level)").cast("long"), "cy": F.expr(f"shiftright(y, {levels} - level)").cast("long")}).join(some, CELL, "left_semi")
    gap = (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx")) + (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy"))

    def looked(rows: DataFrame) -> DataFrame:
        met = rows.join(at, CELL).groupBy("qx", "qy").agg(F.min(F.struct(gap.cast("long").alias("dist"), "target")).alias("best"), F.count("*").alias("visited"))
        return met.select("qx", "qy", "best", "visited")

    first = looked(front.where("turn = 1"))
    rest = front.where("turn > 1").join(first.select("qx", "qy", F.col("best.dist").alias("d")), ["qx", "qy"]).where("lb <= d")
    both = first.unionByName(looked(rest)).groupBy("qx", "qy").agg(F.min("best").alias("best"), F.sum("visited").alias("visited"))
    return queries.join(both, (F.col("x") == F.col("qx")) & (F.col("y") == F.col("qy"))).select("tag", F.col("best.dist").alias("dist"), F.col("best.target").alias("target"), "visited")
