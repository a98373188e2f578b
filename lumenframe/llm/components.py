"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import Workspace


def components(edges: DataFrame, ws: Workspace, most_rounds: int = 50) -> DataFrame:
    """(a, b) links of comparable ids -> (node, root), root the smallest id its component holds.

    Every round hangs neighbours on a smaller neighbour; it ends when a round changes nothing. Only the number of edges
    and their checksum reach the driver. Stars at hot nodes are folded with ``min`` before the shuffle.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b"), F.col("a")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("m", "u").alias("m"))
        joined = both.join(low, both.u == low.k)
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("k"), F.col("m")))
        return out.where("a <> b").distinct()

    now = ws.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = None
    for _ in range(most_rounds):
        new = ws.write(star(star(now, True), False), "edges")
        ws.drop(now)
        now = new
        h = F.xxhash64("a", "b")
        row = now.agg(F.count("*"), F.bit_xor(h), F.min(h), F.max(h)).first()
        if tuple(row) == sign:
            break
        sign = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b"))).distinct()


def merged(groups: DataFrame | None, edges: DataFrame, ws: Workspace) -> DataFrame:
    """(node, root) of the groups so far, put together by new edges (a, b); only edges between roots are followed."""
    if groups is None:
        return components(edges, ws)
    for c in ("a", "b"):
        edges = edges.join(groups.select(F.col("node").alias(c), "root"), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
    new = ws.write(components(edges.where("a <> b").distinct(), ws), "joined")
    up = new.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return groups.join(up, "root", "left").select("node", F.coalesce("top", "root").alias("root")).union(new.select("node", "root")).distinct()
