"""Windows over keys of any length: blocks of numbered rows, with the rows that a block borders on, or sums carried into it.

A window by key alone is one task for each key, however many rows it has. Here the task is a block of a key; what moves besides
are the rows at its borders, or one row of totals for each block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a key in one block.
LENGTH = 4096


def sliding(df: DataFrame, before: int, after: int, make: Callable[[DataFrame, Sequence[str]], DataFrame], key: str = "user_id", order: str = "i", length: int | None = None) -> DataFrame:
    """``make(t, keys)`` with windows by ``keys`` that reach ``before`` rows back and ``after`` ahead, in all, of a row's own.

    ``order`` numbers the rows of a key from 0 without gaps. A row stands in its own block and in those that can see it, so only
    rows near a border are repeated; the copies go at the end. ``make`` keeps every row. Null keys are one key.
    """
    n = max(LENGTH if length is None else length, before, after, 1)
    at = F.col(order)
    t = df.withColumn("_blk", F.explode(F.sequence(F.floor(F.greatest(at - after, F.lit(0)) / n), F.floor((at + before) / n))))
    return make(t, [key, "_blk"]).where(F.col("_blk") == F.floor(at / n)).drop("_blk")


def running(df: DataFrame, values: dict[str, Column], how: str = "sum", key: str = "user_id", order: str = "i", length: int | None = None) -> DataFrame:
    """Add for each name the ``sum`` or ``max`` of its values up to the row, and as ``<name>_before`` that of the rows before it.

    A block's totals are aggregated before they move, and only they are summed by key. Null values count nothing; where there is
    no value a sum is 0 and a maximum null. ``order`` must be a whole number of at least 0, gaps are no matter.
    """
    n = LENGTH if length is None else length
    pick = {"sum": F.sum, "max": F.max}[how]
    join = (lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))) if how == "sum" else F.greatest
    t = df.withColumns({"_blk": F.floor(F.col(order) / n), **{f"_v_{k}": v for k, v in values.items()}})
    past = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    totals = t.groupBy(F.col(key).alias("_k"), F.col("_blk").alias("_c")).agg(*[pick(f"_v_{k}").alias(f"_t_{k}") for k in values])
    totals = totals.select("_k", "_c", *[pick(f"_t_{k}").over(past).alias(f"_b_{k}") for k in values])
    w = Window.partitionBy(key, "_blk").orderBy(order)
    upto, until = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({f"_i_{k}": pick(f"_v_{k}").over(upto) for k in values} | {f"_j_{k}": pick(f"_v_{k}").over(until) for k in values})
    t = t.join(totals, t[key].eqNullSafe(F.col("_k")) & (F.col("_blk") == F.col("_c")))
    made = {k: join(F.col(f"_b_{k}"), F.col(f"_i_{k}")) for k in values} | {f"{k}_before": join(F.col(f"_b_{k}"), F.col(f"_j_{k}")) for k in values}
    return t.withColumns(made).select(*df.columns, *made)


def beside(df: DataFrame, columns: Sequence[str], ahead: bool, key: str, order: str, length: int | None = None) -> DataFrame:
    """Add ``_n``, a struct of ``columns`` of the row before, or with ``ahead`` after, within the key; null at its end.

    Numbers may have gaps. Each block lends the row at its far end to the next block that has rows, which is found among the
    blocks' numbers alone; so heavy columns move once, and one more row for each block.
    """
    n = LENGTH if length is None else length
    t = df.withColumn("_blk", F.floor(F.col(order) / n))
    edge = F.min_by if ahead else F.max_by
    ends = t.groupBy(F.col(key).alias("_k"), F.col("_blk").alias("_c")).agg(edge(F.struct(*df.columns), F.col(order)).alias("_end"))
    w = Window.partitionBy("_f").orderBy("_d")
    to = t.select(F.col(key).alias("_f"), F.col("_blk").alias("_d")).distinct().select("_f", "_d", (F.lag if ahead else F.lead)("_d").over(w).alias("_to")).where("_to is not null")
    lent = ends.join(to, F.col("_k").eqNullSafe(F.col("_f")) & (F.col("_c") == F.col("_d"))).select("_end.*", F.col("_to").alias("_blk"), F.lit(False).alias("_own"))
    # both sides come out of a generator: constraints on computed columns that the optimiser would carry into the union end there
    both = t.withColumn("_own", F.lit(True)).select(F.inline(F.array(F.struct(*t.columns, "_own")))).unionByName(lent.select(F.inline(F.array(F.struct(*lent.columns)))))
    near = (F.lead if ahead else F.lag)(F.struct(*columns)).over(Window.partitionBy(key, "_blk").orderBy(order))
    return both.withColumn("_n", near).where("_own").drop("_own", "_blk")
