"""Vector columns as packed bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(col: str) -> Column:
    """True for a vector that is not null, not empty and holds only finite numbers."""
    bad = F.exists(F.col(col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(col).isNotNull() & (F.size(col) > 0) & ~bad


def usable(df: DataFrame, key: str, col: str) -> DataFrame:
    """Distinct (id, v) of the rows with a key and a finite vector as doubles; vectors of every size, and all vectors of an id, take part."""
    rows = df.where(F.col(key).isNotNull() & finite(col)).select(F.col(key).cast("long").alias("id"), F.col(col).cast("array<double>").alias("v"))
    return rows.distinct()
