"""Driver tables read as frames, pixels, series and colours, and the same as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 8


def numbered(df: DataFrame, key: str, block: Column, order: list[str]) -> DataFrame:
    """Add ``seq``, the number of a row within its key by ``order``, in two passes: rows before its block, and its place inside.

    ``block`` must rise with the order. Only the block totals are summed by key, so a key that holds most rows is numbered by
    as many tasks as it has blocks.
    """
    t = df.withColumn("_b", block)
    base = F.sum("n").over(Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1))
    totals = t.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_c")).agg(F.count("*").alias("n"))
    totals = totals.select("_k", "_c", F.coalesce(base, F.lit(0)).alias("_n"))
    place = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order)) - 1
    t = t.withColumn("_i", place).join(totals, t[key].eqNullSafe(F.col("_k")) & t["_b"].eqNullSafe(F.col("_c")))
    return t.withColumn("seq", (F.col("_n") + F.col("_i")).cast("long")).drop("_b", "_i", "_k", "_c", "_n")


def _byte(x: Column, gain: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + gain * x.cast("double")))).cast("int")


def _streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return numbered(e.withColumnRenamed("label", "stream_id"), "stream_id", F.floor(F.col("vec_id") / 16384), ["vec_id"])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, seq, px): one 8 x 8 luma plane for each embedding, px in raster order, streams ordered by vec_id."""
    return _streams(spark, sf_dir).select("stream_id", "seq", F.transform("embedding", lambda x: _byte(x, 128)).alias("px"))


def planar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, seq, parms, y, cb, cr): a 4:2:0 frame of 8 x 8 pixels for each embedding; every fourth component makes Cb, the one after it Cr."""

    def packed(gain: int, first: int, step: int) -> Column:
        some = F.transform(F.sequence(F.lit(first), F.lit(64), F.lit(step)), lambda i: F.element_at("embedding", i))
        return F.unhex(F.array_join(F.transform(some, lambda x: F.lpad(F.hex(_byte(x, gain)), 2, "0")), ""))

    parms = F.create_map(*[F.lit(x) for x in ("W", "8", "H", "8", "C", "420")])
    e = _streams(spark, sf_dir)
    return e.select("stream_id", "seq", parms.alias("parms"), packed(128, 1, 1).alias("y"), packed(256, 1, 4).alias("cb"), packed(256, 2, 4).alias("cr"))


def pixels(f: DataFrame, keys: tuple[str, ...] = ("stream_id", "seq"), width: int = SIDE) -> DataFrame:
    """Long form (keys, pos, x, y, v) of packed planes."""
    long = f.select(*keys, F.posexplode("px").alias("pos", "v"))
    return long.select(*keys, "pos", (F.col("pos") % width).alias("x"), F.floor(F.col("pos") / width).cast("int").alias("y"), "v")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, v): event values of a user in time order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    week = F.floor(F.unix_micros("ts") / (7 * 86_400_000_000))
    return numbered(e.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", week, ["ts", "event_id"]).select("user_id", F.col("seq").alias("i"), F.col("value").alias("v"))


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, r, g, b): byte colours from lineitem keys; id is the order key and line."""
    t = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    byte = lambda c: (F.col(c) % 256).cast("int")
    return t.select("l_orderkey", "l_linenumber", byte("l_partkey").alias("r"), byte("l_suppkey").alias("g"), byte("l_orderkey").alias("b"))


SQL_FRAMES = """frames AS (
  SELECT label AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq,
         list_transform(embedding, lambda e: CAST(greatest(0, least(255, floor(128 + 128 * e::DOUBLE))) AS INTEGER)) AS px
  FROM embeddings)"""
SQL_PIXELS = SQL_FRAMES + """, pixels AS (
  SELECT stream_id, seq, CAST(pos AS INTEGER) AS pos, CAST(pos % 8 AS INTEGER) AS x, CAST(pos // 8 AS INTEGER) AS y, v
  FROM (SELECT stream_id, seq, unnest(range(64)) AS pos, unnest(px) AS v FROM frames))"""
SQL_PLANES = """e AS (SELECT label AS stream_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq, embedding FROM embeddings),
cells AS (SELECT 0 AS plane, 8 AS w, 128 AS gain, 1 AS first, 1 AS step, unnest(range(64)) AS pos UNION ALL SELECT 1, 4, 256, 1, 4, unnest(range(16)) UNION ALL SELECT 2, 4, 256, 2, 4, unnest(range(16))),
planes AS (SELECT stream_id, seq, plane, w, CAST(pos AS INTEGER) AS pos, CAST(pos % w AS INTEGER) AS x, CAST(pos // w AS INTEGER) AS y,
  CAST(greatest(0, least(255, floor(128 + gain * embedding[first + step * pos]::DOUBLE))) AS INTEGER) AS v FROM e, cells)"""
SQL_SERIES = """series AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value AS v FROM events)"""
SQL_TRIPLES = """triples AS (
  SELECT l_orderkey, l_linenumber, CAST(l_partkey % 256 AS INTEGER) AS r, CAST(l_suppkey % 256 AS INTEGER) AS g,
         CAST(l_orderkey % 256 AS INTEGER) AS b FROM lineitem)"""
