"""Structured Streaming forms: event-time windows on the JVM, and stateful operators that remember a stream's last values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def timed(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows with an event time fit for a watermark; rows later than ``late`` are dropped by stateful operators."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, length: str) -> DataFrame:
    w = F.window("ts", length)
    g = events.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean")


def sliding(events: DataFrame, length: str, step: str) -> DataFrame:
    g = events.groupBy(F.window("ts", length, step)).agg(F.count("*").alias("n"), F.round(F.max("value"), 6).alias("high"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "n", "high")


def _ordered(pdfs) -> pd.DataFrame:
    """All chunks of a key in a batch, by time: a key's rows can come in several chunks and in any order."""
    return pd.concat([p for p in pdfs if len(p)]).sort_values(["ts", "event_id"], kind="stable")


def delta(events: DataFrame) -> DataFrame:
    """Each user's value less the one before it; the first against itself."""

    def run(key, pdfs, state: GroupState):
        rows = _ordered(pdfs)
        before = rows["value"].shift(1)
        before.iloc[0] = state.get[0] if state.exists else rows["value"].iloc[0]
        state.update((float(rows["value"].iloc[-1]),))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"], "delta": (rows["value"] - before).round(6)})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, delta double", "last double", "append", GroupStateTimeout.NoTimeout)


def average(events: DataFrame, length: int) -> DataFrame:
    """Each user's mean of the last ``length`` values."""

    def run(key, pdfs, state: GroupState):
        rows = _ordered(pdfs)
        held = list(state.get[0]) if state.exists else []
        every = pd.Series([*held, *rows["value"]])
        mean = every.rolling(length, min_periods=1).mean().iloc[len(held) :]
        state.update((every.iloc[-(length - 1) :].tolist() if length > 1 else [],))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "mean": mean.round(6).to_numpy()})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, mean double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def merge(events: DataFrame, n: int) -> DataFrame:
    """Sums of every n values of a user, put out when complete."""

    def run(key, pdfs, state: GroupState):
        rows = _ordered(pdfs)
        group, held = state.get if state.exists else (0, [])
        every, out = [*held, *rows["value"]], []
        while len(every) >= n:
            out.append((key[0], group, round(sum(every[:n]) / n, 6)))
            group, every = group + 1, every[n:]
        state.update((group, every))
        yield pd.DataFrame(out, columns=["user_id", "grp", "mean"])

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, grp long, mean double", "grp long, held array<double>", "append", GroupStateTimeout.NoTimeout)
