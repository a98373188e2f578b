"""Product codes of vectors, each part's nearest codebook entry found by annular norm pruning.

Components become whole numbers and vectors fall into equal parts, each with a codebook. The entries of a codebook are sorted
by norm. A part starts at the entry nearest in norm; with the best distance d so far, only entries whose norm lies within d of
the part's own can be as near, an interval that a binary search finds and that shrinks with d. Entries inside it, both ends
included, are evaluated exactly. Training is rounds of assignment and floored means: a task sums what it assigns, and sums of
16 entries a part are all that reach the driver, whatever the number of vectors. Whole numbers make every round the same at any
partitioning and after any retry.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import Workspace, arrow_rows, spread

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Sums travel as signed limbs of this many bits, so that tasks' limbs add up in a long.
LIMB = 31
_isqrt = np.frompyfunc(math.isqrt, 1, 1)


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit numbers, or as Python's where one leaves 52 bits."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not len(x) or np.abs(y).max(initial=0) < 2.0**52:
        return y.astype(np.int64)
    exact = [int(v) if abs(v) < math.inf else int(u) * scale for v, u in zip(y.ravel().tolist(), x.ravel().tolist(), strict=True)]
    return np.array(exact, object).reshape(x.shape)


def _fits(width: int) -> int:
    """Greatest component whose squared distances over ``width`` components stay in 64 bits."""
    return math.isqrt((1 << 60) // max(1, width))


def _greatest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def _root(x: np.ndarray) -> np.ndarray:
    """Whole square roots, off by one at most."""
    return _isqrt(x) if x.dtype == object else np.sqrt(x.astype(np.float64)).astype(np.int64)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x -> index of the nearest row of ``book`` (ties to the lower), squared distance, and how many entries were evaluated."""
    if len(x) and max(_greatest(x), _greatest(book)) > _fits(x.shape[1]):
        x, book = x.astype(object), book.astype(object)
    norm = _root((book * book).sum(1)) if book.shape[1] else np.zeros(len(book), np.int64)
    order = np.argsort(norm, kind="stable")
    norm, book, n, last = norm[order], book[order], len(x), len(order) - 1
    own = _root((x * x).sum(1)) if x.shape[1] else np.zeros(n, np.int64)
    start = np.minimum(np.searchsorted(norm, own), last)
    below = np.maximum(start - 1, 0)
    start = np.where(own - norm[below] < norm[start] - own, below, start)

    def distance(rows, at):
        d = x[rows] - book[at]
        return (d * d).sum(1) if x.shape[1] else np.zeros(len(rows), x.dtype)

    best, code, seen = distance(np.arange(n), start), order[start], np.ones(n, np.int64)

    def annulus(rows):
        reach = _root(best[rows]) + 3  # roots are floored, so both ends are included for certain
        return np.searchsorted(norm, own[rows] - reach, "left"), np.searchsorted(norm, own[rows] + reach, "right")

    lo, hi = annulus(np.arange(n))
    for step in range(1, len(order)):
        for side in (-step, step):
            at = start + side
            rows = np.flatnonzero((at >= lo) & (at < hi))
            if not len(rows):
                continue
            d, entry = distance(rows, at[rows]), order[at[rows]]
            seen[rows] += 1
            better = ((d < best[rows]) | ((d == best[rows]) & (entry < code[rows]))).astype(bool)
            rows = rows[better]
            best[rows], code[rows] = d[better], entry[better]
            lo[rows], hi[rows] = annulus(rows)
    return code, best, seen


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """A list column as a matrix of doubles, short rows filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def integers(vectors: DataFrame, ws: Workspace, vector: str = "embedding", parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """Kept rows of ``vectors`` with ``packed`` instead of the vector, and the components of a part.

    ``packed`` is little-endian 64-bit numbers, or after a leading byte 1 decimal text where a number is greater. Kept rows hold
    a vector without null or non-finite components; vectors shorter than the longest are filled with zeros.
    """
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    kept = vectors.where(F.col(vector).isNotNull() & ~bad).withColumn(vector, F.col(vector).cast("array<double>"))
    longest = kept.agg(F.max(F.size(vector))).first()[0] or 0
    width = -(-longest // parts)
    names = [c for c in kept.columns if c != vector]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields if f.name != vector)

    def run(batches):
        for b in batches:
            x = _rows(b.column(vector), parts * width)
            y = whole(x, scale)
            if y.dtype == object:
                packed = [b"\0" + np.array(r, "<i8").tobytes() if max(map(abs, r), default=0) < 1 << 62 else b"\1" + ",".join(map(str, r)).encode() for r in y.tolist()]
            else:
                packed = [b"\0" + r.tobytes() for r in y.astype("<i8")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(packed, pa.binary())], names=[*names, "packed"])

    return ws.write(kept.mapInArrow(run, f"{schema}, packed binary"), "integers"), width


def _unpack(packed: list[bytes], parts: int, width: int):
    """Yields (row numbers, numbers as rows x parts x width) of like kind."""
    plain = [i for i, p in enumerate(packed) if p[0] == 0]
    if plain:
        x = np.frombuffer(b"".join(packed[i][1:] for i in plain), "<i8").reshape(len(plain), parts, width)
        big = np.abs(x).max(axis=(1, 2), initial=0) > _fits(width)
        for at in (np.flatnonzero(~big), np.flatnonzero(big)):
            if len(at):
                yield np.array(plain)[at], x[at]
    other = [i for i, p in enumerate(packed) if p[0]]
    if other:
        yield np.array(other), np.array([[int(v) for v in packed[i][1:].split(b",")] for i in other], object).reshape(len(other), parts, width)


def train(rows: DataFrame, width: int, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """A codebook for each part, entries x width: first the parts of the rows that come first by key (nulls last, ties by content), then floored means."""
    spark = rows.sparkSession
    first = rows.select(F.col(key).isNull().alias("n"), F.col(key).alias("k"), "packed").orderBy("n", "k", "packed").limit(entries).collect()
    seeds = [np.zeros(0)] * len(first)
    for at, x in _unpack([bytes(r["packed"]) for r in first], parts, width):
        for i, v in zip(at.tolist(), x, strict=True):
            seeds[i] = v.astype(object)
    books = [_narrow(np.array([s[p] for s in seeds], object).reshape(len(seeds), width)) for p in range(parts)]
    if not first:
        return books
    for _ in range(rounds):
        told = spark.sparkContext.broadcast(books)

        def sums(batches, told=told):
            books = told.value
            total = [np.zeros((len(books[0]), width), object) for _ in range(parts)]
            count = np.zeros((parts, len(books[0])), np.int64)
            for b in batches:
                for _, x in _unpack(b.column("packed").to_pylist(), parts, width):
                    for p in range(parts):
                        code, _, _ = nearest(x[:, p], books[p])
                        count[p] += np.bincount(code, minlength=len(books[p]))
                        for e in np.unique(code):
                            total[p][e] += x[code == e, p].astype(object).sum(0) if x.dtype == object or _greatest(x) > 1 << 40 else x[code == e, p].sum(0).astype(object)
            out = []
            for p in range(parts):
                for e in np.flatnonzero(count[p]).tolist():
                    out.append((p, e, -1, 0, int(count[p, e])))
                    for pos, v in enumerate(total[p][e].tolist()):
                        out += [(p, e, pos, i, limb) for i, limb in enumerate(_limbs(int(v)))]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:4]), pa.array(cols[4], pa.int64())], names=["part", "entry", "pos", "limb", "total"])

        got = rows.select("packed").mapInArrow(sums, "part int, entry int, pos int, limb int, total long").groupBy("part", "entry", "pos", "limb").agg(F.sum("total").alias("total"))
        count, total = {}, {}
        for r in got.collect():  # at most entries x (components + parts) numbers, in limbs
            if r["pos"] < 0:
                count[r["part"], r["entry"]] = r["total"]
            else:
                at = r["part"], r["entry"], r["pos"]
                total[at] = total.get(at, 0) + (r["total"] << (LIMB * r["limb"]))
        new = [b.astype(object) for b in books]
        for (p, e), n in count.items():
            new[p][e] = [total.get((p, e, pos), 0) // n for pos in range(width)]
        told.unpersist()
        books = [_narrow(b) for b in new]
    return books


def _limbs(v: int) -> list[int]:
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while v:
        out.append(sign * (v & ((1 << LIMB) - 1)))
        v >>= LIMB
    return out


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype(np.int64) if _greatest(book) < 1 << 62 else book


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for b in books for row in b.tolist() for v in row).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """``rows`` with ``code``, one byte a part in hex, ``error``, the squared distance over all parts, and ``evaluated``, the entries looked at."""
    told, parts = rows.sparkSession.sparkContext.broadcast(books), len(books)
    names = [c for c in rows.columns if c != "packed"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "packed")

    def run(batches):
        for b in batches:
            n = b.num_rows
            codes, error, seen = np.zeros((n, parts), np.uint8), [0] * n, np.zeros(n, np.int64)
            for at, x in _unpack(b.column("packed").to_pylist(), parts, width):
                total = [0] * len(at)
                for p, book in enumerate(told.value):
                    codes[at, p], d, k = nearest(x[:, p], book)
                    total = [s + v for s, v in zip(total, d.tolist(), strict=True)]
                    seen[at] += k
                for i, v in zip(at.tolist(), total, strict=True):
                    error[i] = v if v < 1 << 63 else None
            cols = [pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64()), pa.array(seen)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *cols], names=[*names, "code", "error", "evaluated"])

    return rows.mapInArrow(run, f"{schema}, code string, error long, evaluated long")


def compress(vectors: DataFrame, ws: Workspace, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """Every kept row's columns but the vector, with code, error and evaluated; and the codebooks."""
    arrow_rows(ws.spark, 8192)
    packed, width = integers(vectors, ws, vector, parts)
    books = train(packed, width, key, parts, entries, rounds)
    return ws.write(encode(packed, books, width), "codes"), books


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every kept vector of ``embeddings``.

    Dropped are vectors that are null or hold a null or non-finite component. Vectors shorter than the longest, empty ones too, are
    filled with zeros to its size and that to a multiple of eight. Of fewer than 16 kept vectors each is an entry. A null vec_id comes last
    among the first entries, rows of one vec_id by their numbers; repeated rows stay. Equally near entries: the lower index. Numbers of
    any size are exact; an error or a sum of errors that no long holds is null. Empty table: no rows.
    """
    ws = Workspace(spark, "codes")
    coded, books = compress(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")), ws)
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    held = (F.count("error") == F.count("*")) & (total <= 2**63 - 1)
    sums = coded.groupBy("label").agg(F.when(held, total).cast("long").alias("label_error")).withColumnRenamed("label", "_label")
    out = coded.join(sums, coded["label"].eqNullSafe(F.col("_label")))
    return ws.finish(out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")))


def _sql() -> str:
    rounds = []
    for k in range(ROUNDS + 1):
        rounds.append(
            f"near{k} AS MATERIALIZED (SELECT vec_id, part, min(d * {ENTRIES} + entry) AS best FROM (SELECT vec_id, part, entry, sum((v - c) * (v - c)) AS d "
            f"FROM parts JOIN book{k} USING (part, pos) GROUP BY ALL) GROUP BY ALL)"
        )
        if k < ROUNDS:
            rounds.append(
                f"mean{k} AS (SELECT part, best % {ENTRIES} AS entry, pos, sum(v) AS s, count(*) AS n FROM parts JOIN near{k} USING (vec_id, part) GROUP BY ALL), "
                f"book{k + 1} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN n IS NULL THEN c ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS c "
                f"FROM book{k} LEFT JOIN mean{k} USING (part, entry, pos))"
            )
    return f"""
WITH kept AS (SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
flat AS (SELECT vec_id, len(embedding) // {PARTS} AS d, embedding, unnest(range(len(embedding))) AS i FROM kept),
parts AS MATERIALIZED (SELECT vec_id, i // d AS part, i % d AS pos, CAST(floor({SCALE} * CAST(embedding[i + 1] AS DOUBLE)) AS BIGINT) AS v FROM flat),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {ENTRIES})),
book0 AS MATERIALIZED (SELECT part, entry, pos, v AS c FROM parts JOIN seeds USING (vec_id)),
{", ".join(rounds)},
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(best % {ENTRIES} AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error
  FROM near{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book{ROUNDS}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)"""


SQL = _sql()
