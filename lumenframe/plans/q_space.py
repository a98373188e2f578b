"""The quadtree and nearest neighbours over points made from customers, suppliers and nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import space
from lumenframe.plans.registry import query, table

WIDTH, HEIGHT, LEVELS = 251, 241, 8
POINTS = "points AS (SELECT c_custkey AS tag, c_custkey % 251 AS x, (c_custkey * 7) % 241 AS y FROM customer)"
#: A third of the points crowd on 35 places, another third along a line.
CROWDED = """points AS (SELECT c_custkey AS tag, CASE c_custkey % 3 WHEN 0 THEN c_custkey % 7 WHEN 1 THEN c_custkey % 251 ELSE (c_custkey * 13) % 251 END AS x,
  CASE c_custkey % 3 WHEN 0 THEN c_custkey % 5 WHEN 1 THEN 3 ELSE (c_custkey * 7) % 241 END AS y FROM customer)"""


def points(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("tag"), (k % 251).alias("x"), ((k * 7) % 241).alias("y"))


def crowded(spark, d):
    k = F.col("c_custkey")
    x = F.when(k % 3 == 0, k % 7).when(k % 3 == 1, k % 251).otherwise((k * 13) % 251)
    y = F.when(k % 3 == 0, k % 5).when(k % 3 == 1, F.lit(3)).otherwise((k * 7) % 241)
    return table(spark, d, "customer").select(k.alias("tag"), x.alias("x"), y.alias("y"))


def _split_sql(source: str) -> str:
    """Splitting from the root down: every round halves the cells that still hold more than a leaf may."""
    return f"""WITH RECURSIVE {source}, inside AS (SELECT * FROM points WHERE x BETWEEN 0 AND {WIDTH - 1} AND y BETWEEN 0 AND {HEIGHT - 1}),
cell AS (SELECT tag, x, y, 0 AS level, (SELECT count(*) FROM inside) AS n FROM inside
  UNION ALL SELECT tag, x, y, level + 1, count(*) OVER (PARTITION BY x >> ({LEVELS} - 1 - level), y >> ({LEVELS} - 1 - level)) FROM cell WHERE n > {space.CAP} AND level < {LEVELS}),
leaf AS (SELECT level, x >> ({LEVELS} - level) AS cx, y >> ({LEVELS} - level) AS cy, count(*) AS n FROM cell WHERE n <= {space.CAP} OR level = {LEVELS} GROUP BY ALL)
SELECT level, cx * (1 << ({LEVELS} - level)) AS x0, cy * (1 << ({LEVELS} - level)) AS y0, (cx + 1) * (1 << ({LEVELS} - level)) AS x1, (cy + 1) * (1 << ({LEVELS} - level)) AS y1, n FROM leaf"""


@query("quadtree_leaves", _split_sql(POINTS))
def quadtree_leaves(spark, d):
    return space.leaves(points(spark, d), WIDTH, HEIGHT)


@query("quadtree_crowded", _split_sql(CROWDED))
def quadtree_crowded(spark, d):
    """Leaves of uneven points: deep where they crowd, whole quarters where there are few."""
    return space.leaves(crowded(spark, d), WIDTH, HEIGHT)


@query("quadtree_bucket", f"WITH {POINTS} SELECT x // 16 AS bx, y // 16 AS by_, count(*) AS n, min(tag) AS first FROM points GROUP BY x // 16, y // 16")
def quadtree_bucket(spark, d):
    cell = lambda c: F.floor(F.col(c) / 16)
    return points(spark, d).groupBy(cell("x").alias("bx"), cell("y").alias("by_")).agg(F.count("*").alias("n"), F.min("tag").alias("first"))


@query("quadtree_sorted", f"WITH {POINTS} SELECT x, y, string_agg(tag, ',' ORDER BY tag) AS tags, CAST(count(*) AS INTEGER) AS n FROM points GROUP BY x, y")
def quadtree_sorted(spark, d):
    """Tags at each place, in order."""
    g = points(spark, d).groupBy("x", "y").agg(F.sort_array(F.collect_list("tag")).alias("t"))
    return g.select("x", "y", F.array_join(F.transform("t", lambda t: t.cast("string")), ",").alias("tags"), F.size("t").alias("n"))


def _nearest_sql(source: str, targets: str) -> str:
    return f"""WITH {source}, targets AS ({targets}),
d AS (SELECT tag, target, (x - tx) * (x - tx) + (y - ty) * (y - ty) AS dist FROM points, targets)
SELECT tag, CAST(min(dist) AS BIGINT) AS dist, arg_min(target, dist * 1000000 + target) AS target FROM d GROUP BY tag"""


@query("nearest_point", _nearest_sql(POINTS, "SELECT n_nationkey AS target, n_nationkey * 37 % 251 AS tx, n_nationkey * 53 % 241 AS ty FROM nation"))
def nearest_point(spark, d):
    """The nearest of the nations' points; of equals the least."""
    k = F.col("n_nationkey")
    t = table(spark, d, "nation").select(k.alias("tag"), (k * 37 % 251).alias("x"), (k * 53 % 241).alias("y"))
    return space.nearest(points(spark, d), t, WIDTH, HEIGHT).select("tag", "dist", "target")


@query("nearest_supplier", _nearest_sql(CROWDED, "SELECT s_suppkey AS target, s_suppkey * 37 % 251 AS tx, s_suppkey * s_suppkey % 241 AS ty FROM supplier"))
def nearest_supplier(spark, d):
    """The nearest supplier's point to each of the crowded ones."""
    k = F.col("s_suppkey")
    t = table(spark, d, "supplier").select(k.alias("tag"), (k * 37 % 251).alias("x"), (k * k % 241).alias("y"))
    return space.nearest(crowded(spark, d), t, WIDTH, HEIGHT).select("tag", "dist", "target")
