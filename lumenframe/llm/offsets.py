"""Global running sums in two passes: totals of bounded blocks first, then sums inside each block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_offsets(df: DataFrame, group: str, order: list[str], value: str, rows_per_block: int = 8_000, total: int | None = None) -> DataFrame:
    """Add ``_before``: the sum of ``value`` over the rows of the same ``group`` that come first by ``order[0]``, then the rest.

    ``order[0]`` must be a 32-digit lower-case hex digest; its leading bits cut every group into blocks of about
    ``rows_per_block`` rows, so a group that holds most rows is still summed by many tasks. Only block totals are summed
    by group, one row for each block. Rows that agree on every order column share their digest and may stand in either order.
    """
    n = df.count() if total is None else total
    bits = min(24, max(0, (n // rows_per_block).bit_length()))
    lead = F.conv(F.substring(order[0], 1, 6), 16, 10).cast("long")
    df = df.withColumn("_block", F.shiftright(lead, 24 - bits))
    blocks = df.groupBy(group, "_block").agg(F.sum(value).alias("_sum"))
    by = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_sum").over(by), F.lit(0))).drop("_sum")
    inner = Window.partitionBy(group, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    same = blocks.select(F.col(group).alias("_g"), F.col("_block").alias("_b"), "_base")
    df = df.join(same, df[group].eqNullSafe(F.col("_g")) & (df["_block"] == F.col("_b")))
    return df.withColumn("_before", F.col("_base") + F.col("_inner")).drop("_block", "_base", "_inner", "_g", "_b")
