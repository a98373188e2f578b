"""Exact top-k by inner product with ball trees.

The top of a ball tree, fitted on a bounded sample, deals the distinct vectors to regions, so that a region's ball is small
where the data have clusters; a region of many rows is parted into shards by a hash. Every shard has a ball tree of its own.
Queries go to the shards of a region in waves: first to the region of the greatest upper bound <q, centre> + |q| radius,
then, with the kth score found so far as a floor, to the next ones by bound and to the rest, always leaving out regions whose
bound is under the floor. Inside a shard queries take the leaves by falling bound, in rounds of twice as many, up to the first
one under the kth score; all that meet at a leaf are scored by one matrix product. Equal vectors share one entry with their k + 1 smallest ids, so copies cannot swell a shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import Workspace, arrow_rows, parallelism
from lumenframe.llm.vectors import usable

LEAF = 128
SHARD_ROWS = 8192
#: Queries that meet a shard at once.
BLOCK_ROWS = 1 << 15
#: Queries that walk a tree together, and the hits that they hold before the best are chosen.
QUERY_ROWS, HELD = 512, 1 << 18
#: Bounds of the sample that shapes the regions, of the regions, and of the numbers in their centres, which all executors get.
SAMPLE_ROWS, MOST_REGIONS, MOST_NUMBERS = 1 << 16, 4096, 1 << 21


def halves(x: np.ndarray) -> np.ndarray:
    """Direction from the mean to the farthest row; zeros if all rows are equal."""
    d = x - x.mean(0)
    n = np.einsum("ij,ij->i", d, d)
    return d[n.argmax()]


class Regions:
    """Half-spaces down to ``most`` leaves of about equal shares of a sample."""

    def __init__(self, sample: np.ndarray, most: int):
        self.nodes: list[tuple] = []  # (direction, threshold, left, right) or the number of a leaf
        self.leaves = 0
        todo = [(np.arange(len(sample)), most, -1, 0)]
        while todo:
            rows, share, parent, side = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][2 + side] = at
            way = halves(sample[rows]) if share > 1 and len(rows) > 1 else None
            if way is None or not way.any():
                self.nodes.append(self.leaves)
                self.leaves += 1
                continue
            on = sample[rows] @ way
            cut = np.sort(on)[int(len(rows) * (share // 2 / share))]
            if not (on < cut).any():
                cut = on[on > cut].min() if (on > cut).any() else cut
            self.nodes.append([way, cut, 0, 0])
            todo += [(rows[on >= cut], share - share // 2, at, 1), (rows[on < cut], share // 2, at, 0)]

    def of(self, x: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                low = x[rows] @ node[0] < node[1]
                todo += [(node[2], rows[low]), (node[3], rows[~low])]
        return out


class BallTree:
    """Rows halved along the direction of greatest spread. Nodes hold centre, radius, children or a slice of ``order``."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float64)
        self.order = np.arange(len(x))
        self.nodes: list[tuple[int, int, int, int]] = []
        centres, radii = [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            at = len(self.nodes)
            if parent >= 0:
                a, b, left, right = self.nodes[parent]
                self.nodes[parent] = (a, b, at, right) if side == 0 else (a, b, left, at)
            own = self.x[self.order[lo:hi]]
            c = own.mean(0)
            d = own - c
            centres.append(c)
            radii.append(np.sqrt(np.einsum("ij,ij->i", d, d).max()))
            self.nodes.append((lo, hi, -1, -1))
            if hi - lo > LEAF and radii[-1] > 0:
                half = (hi - lo) // 2
                self.order[lo:hi] = self.order[lo:hi][np.argsort(d @ halves(own), kind="stable")]
                todo += [(lo + half, hi, at, 1), (lo, lo + half, at, 0)]
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.norm = float(np.sqrt(np.einsum("ij,ij->i", self.x, self.x).max()))
        self.sorted: dict[type, np.ndarray] = {}

    def search(self, q: np.ndarray, k: int, ids: np.ndarray, ends: np.ndarray, own: np.ndarray, floor: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Rows of ``q``, ids and scores of the best k at or over each row's ``floor``, ties to smaller ids, and the number of pairs scored.

        A query takes its leaves by falling bound, 1, 1, 2, 4 and so on at a time, and its kth score so far closes the others; the queries at
        a leaf are scored by one product. Row i of the tree has ``ids[ends[i]:ends[i + 1]]``; a query's own id is left out.
        """
        size = np.sqrt(np.einsum("ij,ij->i", q, q))
        up = self.centres @ q.T + self.radii[:, None] * size
        up += 1e-9 * (np.abs(up) + 1)
        for node, (_, _, left, right) in enumerate(self.nodes):  # children come after their parents
            if left >= 0:
                up[[left, right]] = np.minimum(up[[left, right]], up[node])
        leaves = [(lo, hi) for lo, hi, left, _ in self.nodes if left < 0]
        up = up[[left < 0 for _, _, left, _ in self.nodes]]
        turn = np.argsort(np.argsort(-up, axis=0, kind="stable"), axis=0)
        # whole numbers: no partial sum passes the product of the norms, so single precision is exact under 2^24
        kind = np.float32 if size.max() * max(1.0, self.norm) < 2**24 else np.float64
        x, q = self.rows(kind), q.astype(kind)
        start, copies = ends[self.order], np.diff(ends)[self.order]
        kth, scored, first, last = floor.copy(), 0, 0, 1
        best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind)]
        hits: list[tuple] = []

        def merged(best: list[np.ndarray]) -> list[np.ndarray]:
            row, at, score = (np.concatenate(c) for c in zip(*hits, strict=True))
            n = copies[at]
            each = np.repeat(np.arange(len(at)), n)
            v = ids[np.arange(len(each)) + np.repeat(start[at] - (np.cumsum(n) - n), n)]
            each, v = each[other := v != own[row[each]]], v[other]
            row, v, score = (np.concatenate(c) for c in zip(best, (row[each], v, score[each]), strict=True))
            by = np.lexsort((v, -score, row))
            row = row[by]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            by, row, place = by[place < k], row[place < k], place[place < k]
            full = place == k - 1
            kth[row[full]] = np.maximum(kth[row[full]], score[by[full]])
            hits.clear()
            return [row, v[by], score[by]]

        while first < len(leaves):
            due = (turn >= first) & (turn < last) & (up >= kth)
            held = 0
            for leaf in np.flatnonzero(due.any(1)):
                lo, hi = leaves[leaf]
                at = np.flatnonzero(due[leaf])
                got = q[at] @ x[lo:hi].T
                scored += got.size
                i, j = np.nonzero(got >= kth[at, None].astype(kind))
                hits.append((at[i], lo + j, got[i, j]))
                held += int(copies[lo + j].sum())
                if held > HELD:
                    best, held = merged(best), 0
            if hits:
                best = merged(best)
            first, last = last, 2 * last
        return best, scored

    def rows(self, kind: type) -> np.ndarray:
        """The rows in the order of the leaves, in single or double precision."""
        if kind not in self.sorted:
            self.sorted[kind] = self.x[self.order].astype(kind)
        return self.sorted[kind]


def scaled(v, scale: int = 64):
    """Whole numbers as doubles. From 2^52 on a double is whole as it is, and would not fit the long that ``floor`` gives."""
    return F.transform(v, lambda x: F.when(F.abs(x * scale) < 2.0**52, F.floor(x * scale).cast("double")).otherwise(x * scale))


def _huge(v):
    """True where partial sums of the squares can leave the doubles' whole numbers."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x) >= 2.0**53


def exact(pairs: DataFrame) -> DataFrame:
    """(query_id, vec_id, q, v) -> (query_id, vec_id, score, beyond) in Python's integers; a score no long can hold is held at its limit, and ``beyond`` orders it."""

    def run(batches):
        top = 2**63 - 1
        for b in batches:
            score, beyond = [], []
            for q, v in zip(b.column("q").to_pylist(), b.column("v").to_pylist(), strict=True):
                s = sum(int(x) * int(y) for x, y in zip(q, v, strict=True))
                score.append(max(-top, min(top, s)))
                beyond.append(None if abs(s) < top else (s + (1 << 2200)).to_bytes(280, "big"))
            cols = [b.column("query_id"), b.column("vec_id"), pa.array(score, pa.int64()), pa.array(beyond, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score", "beyond"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long, beyond binary")


def _matrix(column) -> np.ndarray:
    """The vectors of a list column, all of one size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_size(column):
    """(size, rows, matrix) for each vector size in a list column."""
    size = np.diff(column.offsets.to_numpy())
    for d in np.unique(size):
        at = np.flatnonzero(size == d)
        yield int(d), at, _matrix(column.take(pa.array(at)))


def regions(entries: DataFrame) -> dict[int, Regions]:
    """Regions of the sizes that have more vectors than a shard; a hash of the vector chooses the sample, and other sizes are one region each."""
    counts = {r["d"]: r["count"] for r in entries.groupBy(F.size("v").alias("d")).count().where(F.col("count") > SHARD_ROWS).collect()}
    out = {}
    for d, n in counts.items():
        few = entries.where(F.size("v") == d).where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_ROWS / n)) + 1)
        sample = _matrix(few.select("v").toArrow().column("v"))
        out[d] = Regions(sample, max(2, min(MOST_REGIONS, MOST_NUMBERS // d, n // SHARD_ROWS)))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, ws: Workspace, k: int, tally: list | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): ``vectors`` and ``queries`` are (id, v) with whole-number components held as doubles.

    Vectors meet those of their own size; an id may have several. Rows so large that a partial sum could pass 2^53 are few
    and are scored beside the trees in whole numbers. ``tally`` gets the number of rows scored.
    """
    spark = ws.spark
    arrow_rows(spark, 4096)
    every, asking = vectors, queries
    large = every.where(_huge("v")).limit(1).count() > 0
    vectors, queries = every.where(~_huge("v")), asking.where(~_huge("v"))
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = vectors.withColumn("r", rank).where(F.col("r") <= k + 1)
    entries = ws.write(few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    shape = spark.sparkContext.broadcast(regions(entries))

    def deal(batches):
        for b in batches:
            region = np.zeros(b.num_rows, np.int64)
            for d, at, x in _by_size(b.column("v")):
                region[at] = (d << 32) + (shape.value[d].of(x) if d in shape.value else 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(region)], names=[*b.schema.names, "region"])

    placed = ws.write(entries.mapInArrow(deal, "v array<double>, ids array<long>, region long"), "placed")
    cuts = placed.groupBy("region").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("cuts"))
    placed = placed.join(cuts, "region").withColumn("shard", F.concat_ws("/", "region", F.pmod(F.xxhash64("v"), F.col("cuts"))))

    def packed(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("v"))
        c = x.mean(0)
        d = x - c
        ids = t.column("ids").combine_chunks()
        cells = [t.column("region")[0].as_py(), t.column("shard")[0].as_py(), t.num_rows, float(np.sqrt(np.einsum("ij,ij->i", d, d).max())), c.tobytes(), x.tobytes(), ids.flatten().to_pylist(), ids.offsets.to_pylist()]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.table([pa.array([c], t_) for c, t_ in zip(cells, kinds, strict=True)], names=["region", "shard", "n", "radius", "centre", "x", "ids", "ends"])

    shards = ws.write(placed.groupBy("shard").applyInArrow(packed, "region long, shard string, n long, radius double, centre binary, x binary, ids array<long>, ends array<int>"), "shards")
    # balls of the shards: bounded by the regions and, in regions of many rows, joined to one ball of the region on the way
    balls: dict[int, list] = {}
    for r in shards.groupBy("region").agg(F.min_by("centre", "shard").alias("c"), F.collect_set("shard").alias("s")).collect():
        balls.setdefault(r["region"] >> 32, []).append((r["region"], np.frombuffer(r["c"], float), sorted(r["s"])))
    reach = {r["region"]: r["reach"] for r in shards.join(F.broadcast(shards.groupBy("region").agg(F.min_by("centre", "shard").alias("c"))), "region").select("region", "radius", "centre", "c").mapInArrow(_spread, "region long, reach double").groupBy("region").agg(F.max("reach").alias("reach")).collect()}
    known = spark.sparkContext.broadcast({d: ([b[0] for b in bs], np.array([b[1] for b in bs]), np.array([reach[b[0]] for b in bs]), [b[2] for b in bs]) for d, bs in balls.items()})
    most = max([len(bs) for bs in balls.values()], default=0)
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))

    def ask(first: int, last: int):
        """Rows of queries for the shards of the regions of rank first .. last - 1 by bound, if that is not under the floor."""

        def run(batches):
            for b in batches:
                floor = b.column("floor").to_numpy(zero_copy_only=False)
                for d, at, q in _by_size(b.column("v")):
                    if d not in known.value:
                        continue
                    _, centre, radius, own = known.value[d]
                    bound = q @ centre.T + np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * radius
                    bound += 1e-9 * (np.abs(bound) + 1)
                    best = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                    low = np.nan_to_num(floor[at].astype(float), nan=-np.inf)
                    row, col = np.nonzero(np.take_along_axis(bound, best, 1) >= low[:, None])
                    asked = [(i, s) for i, r in zip(at[row].tolist(), best[row, col].tolist(), strict=True) for s in own[r]]
                    take = pa.array([i for i, _ in asked], pa.int64())
                    yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns), pa.array([s for _, s in asked], pa.string())], names=[*b.schema.names, "shard"])

        return run

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x = np.frombuffer(left.column("x")[0].as_py()).reshape(left.column("n")[0].as_py(), -1)
        ids, ends = (left.column(c)[0].values.to_numpy(zero_copy_only=False) for c in ("ids", "ends"))
        tree, q, asked = BallTree(x), _matrix(right.column("v")), right.column("id").to_numpy()
        floor = np.nan_to_num(right.column("floor").to_numpy().astype(float), nan=-np.inf)
        out, scored = [], 0
        for lo in range(0, len(q), QUERY_ROWS):
            some = slice(lo, lo + QUERY_ROWS)
            (row, v, score), n = tree.search(q[some], k, ids, ends, asked[some], floor[some])
            scored += n
            out.append(pa.table([asked[some][row], v, score.astype(np.int64)], schema=schema))
        return pa.concat_tables([*out, pa.table([pa.array([c], pa.int64()) for c in (None, None, scored)], schema=schema)])

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    block = F.pmod(F.xxhash64("id"), F.lit(blocks))
    held = shards.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    found, floors, stops = None, None, sorted({0, 1, max(1, most // 4), most})
    for first, last in zip(stops[:-1], stops[1:], strict=True):
        asks = queries.select("id", "v").withColumn("floor", F.lit(None).cast("long")) if floors is None else queries.join(floors, "id", "left").select("id", "v", "floor")
        asks = asks.mapInArrow(ask(first, last), "id long, v array<double>, floor long, shard string").withColumn("block", block)
        got = held.groupBy("shard", "block").cogroup(asks.groupBy("shard", "block")).applyInArrow(walk, "query_id long, vec_id long, score long")
        got = ws.write(got, "wave")
        if tally is not None:
            tally.append(got.where("query_id is null").agg(F.sum("score")).first()[0] or 0)
        got = got.where("query_id is not null").withColumn("beyond", F.lit(None).cast("binary"))
        found = ws.write(best(got if found is None else found.union(got)).drop("rank"), "best")
        floors = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor")).withColumnRenamed("query_id", "id")
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long, beyond binary")
    if large:
        q, c = asking.select(F.col("id").alias("query_id"), F.col("v").alias("q")), every.select(F.col("id").alias("vec_id"), "v")
        on = (F.size("q") == F.size("v")) & (F.col("query_id") != F.col("vec_id"))
        pairs = q.join(F.broadcast(c.where(_huge("v"))), on).select("query_id", "vec_id", "q", "v")
        pairs = pairs.union(F.broadcast(q.where(_huge("q"))).join(c.where(~_huge("v")), on).select("query_id", "vec_id", "q", "v"))
        found = found.union(exact(pairs))
    return best(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _spread(batches):
    """From the first centre of a region to the far side of each of its shards' balls."""
    for b in batches:
        far = [float(np.linalg.norm(np.frombuffer(x, float) - np.frombuffer(y, float))) + r for x, y, r in zip(b.column("centre").to_pylist(), b.column("c").to_pylist(), b.column("radius").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("region"), pa.array(far, pa.float64())], names=["region", "reach"])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 best of each query.

    Rows with a null id or a vector that is null, empty or not finite take no part. Vectors meet those of their own size. Rows that repeat id and vector count once; an id with several vectors
    is a candidate with each. Scores are exact; one that no long can hold is held at its limit, its rank still exact. Fewer
    than 20 candidates: all of them. Empty table: no rows.
    """
    ws = Workspace(spark, "topk")
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    rows = ws.write(rows.select("id", scaled(F.col("v")).alias("v")).distinct(), "vectors")
    return ws.finish(top_k(rows, rows.where("id % 20 = 0"), ws, 20))


SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
