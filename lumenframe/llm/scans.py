"""Running places, sums and polynomial fingerprints inside keys, whatever share of the rows a key holds.

Rows are range-partitioned by key and order, so a large key runs over several partitions. A numpy scan goes through each
partition; what the last key of a partition has come to, a row for each partition, is carried on to the partitions after it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import Workspace, parallelism

#: An odd multiplier, so that it has an inverse among 64-bit numbers.
BASE = 0x9E3779B97F4A7C15


def power(exponent: np.ndarray, base: int = BASE) -> np.ndarray:
    """base ** exponent among unsigned 64-bit numbers."""
    left, out, square = exponent.astype(np.uint64), np.ones(len(exponent), np.uint64), np.full(1, base % (1 << 64), np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square, out)
        square = square * square
        left = left >> np.uint64(1)
    return out


def _unsigned(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def running(df: DataFrame, ws: Workspace, key: str, order: list[Column], sums: tuple[str, ...] = (), poly: str | None = None) -> DataFrame:
    """``df`` (``key`` a long without nulls) with ``pos``, the place in its key from 0, ``<c>_sum`` for each of ``sums``, this row's value
    included, and for ``poly`` the fingerprints ``before`` and ``upto``: sums of value times BASE ** pos among 64-bit numbers.

    ``order`` must not leave rows of a key equal that differ in what follows from their places.
    """
    names = df.columns
    added = ["part", "pos", *(f"{c}_sum" for c in sums), *(("before", "upto") if poly else ())]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", part int, " + ", ".join(f"`{c}` long" for c in added[1:])

    def scan(batches):
        part, last, n, so_far, print_ = TaskContext.get().partitionId(), None, 0, [np.uint64(0)] * len(sums), np.uint64(0)
        for b in batches:
            if not b.num_rows:
                continue
            k = b.column(key).to_numpy(zero_copy_only=False)
            begin = np.r_[True, k[1:] != k[:-1]]
            first = np.maximum.accumulate(np.where(begin, np.arange(len(k)), 0))
            goes_on = (first == 0) & (k == last) if last is not None else np.zeros(len(k), bool)
            pos = np.arange(len(k)) - first + np.where(goes_on, n, 0)

            def within(v, carried, first=first, goes_on=goes_on):
                c = np.cumsum(v, dtype=np.uint64)
                return c - np.where(first > 0, c[first - 1], np.uint64(0)) + np.where(goes_on, carried, np.uint64(0))

            totals = [within(_unsigned(b.column(c)), s) for c, s in zip(sums, so_far, strict=True)]
            out = [pa.array(np.full(len(k), part, np.int32)), pa.array(pos), *(pa.array(t.view(np.int64)) for t in totals)]
            if poly:
                term = _unsigned(b.column(poly)) * power(pos)
                upto = within(term, print_)
                out += [pa.array((upto - term).view(np.int64)), pa.array(upto.view(np.int64))]
                print_ = upto[-1]
            last, n, so_far = k[-1], int(pos[-1]) + 1, [t[-1] for t in totals]
            yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*names, *added])

    placed = df.repartitionByRange(parallelism(ws.spark), F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    rows = ws.write(placed.mapInArrow(scan, schema), "scanned")
    ends = F.max_by(F.struct("pos", *(f"{c}_sum" for c in sums), *(["upto"] if poly else [])), F.struct(key, "pos"))
    carry, held = {}, None
    for r in sorted(rows.groupBy("part").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), ends.alias("end")).collect()):  # a row for each partition
        end = [r["end"]["pos"] + 1, *r["end"][1:]]
        if held and held[0] == r["lo"]:
            carry[r["part"]] = held
            if r["lo"] == r["hi"]:
                n = held[1]
                end = [n + end[0], *(a + b for a, b in zip(held[2 : 2 + len(sums)], end[1:], strict=False)), *([held[-1] + pow(BASE, n, 1 << 64) * end[-1]] if poly else [])]
        held = [r["hi"], *end]
    if not carry:
        return rows.drop("part")
    told = ws.spark.sparkContext.broadcast(carry)

    def carried(batches):
        for b in batches:
            k, part = b.column(key).to_numpy(zero_copy_only=False), b.column("part").to_numpy(zero_copy_only=False)
            cols = {c: _unsigned(b.column(c)) for c in added[1:]}
            for p in np.unique(part).tolist():
                if p not in told.value:
                    continue
                own, n, *more = told.value[p]
                at = (part == p) & (k == own)
                cols["pos"] = cols["pos"] + np.where(at, np.uint64(n), np.uint64(0))
                for c, s in zip(sums, more, strict=False):
                    cols[f"{c}_sum"] = cols[f"{c}_sum"] + np.where(at, np.uint64(s % (1 << 64)), np.uint64(0))
                if poly:
                    shift, base = np.uint64(pow(BASE, n, 1 << 64)), np.uint64(more[-1] % (1 << 64))
                    for c in ("before", "upto"):
                        cols[c] = np.where(at, cols[c] * shift + base, cols[c])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(cols[c].view(np.int64)) for c in added[1:])], names=[*names, *added[1:]])

    out = ws.write(rows.mapInArrow(carried, schema.replace(", part int", "", 1)), "carried")
    ws.drop(rows)
    return out
