"""Approximate nearest neighbours by NN-descent and greedy graph search, in shards.

Equal vectors are one node. Half-spaces fitted on a bounded sample deal the nodes to shards, so that rows near each other meet
where the data have clusters. Each shard gets a graph of its own by NN-descent from random-projection leaves (``nngraph``). A
query goes to the shards whose centres are nearest and keeps a pool in each, until the pool is expanded throughout. A whole
pool is measured again in double precision on the original vectors. A sample of the queries is searched
exhaustively, and in every shard with several pools: the cheapest pool and number of shards that find enough of its true
neighbours serve all queries, so these are searched once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm import nngraph
from lumenframe.llm.common import Workspace, arrow_rows, parallelism
from lumenframe.llm.topk import Regions
from lumenframe.llm.vectors import usable

LEAF_ROWS = 384
#: Shards grow with the root of the nodes, between these bounds; the second one is of numbers.
SHARD_ROWS, SHARD_NUMBERS = 4096, 1 << 23
#: Bounds of the sample that shapes the regions and of their number; queries that meet a shard at once.
SAMPLE_ROWS, MOST_REGIONS, QUERY_ROWS = 1 << 15, 4096, 1 << 15
#: Partitions of shards for each one of other rows: shards are few and heavy, so no two should meet in a task.
SPREAD = 8
#: Pools that are tried at once, as multiples of the first.
POOLS = (1, 1.5, 2, 3, 4, 6, 8)


def _matrix(column) -> np.ndarray:
    """The vectors of a list column, all of one size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _packed(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def nodes(vectors: DataFrame, ws: Workspace, k: int) -> DataFrame:
    """(node, v, ids): distinct vectors, named by their least id (a hash where that names another as well), with their k + 1 least ids."""
    rank = F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))  # the hash spares the sort most comparisons of vectors
    few = vectors.withColumn("h", F.xxhash64("v")).withColumn("r", rank).where(F.col("r") <= k + 1)
    few = few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    few = ws.write(few.select(F.element_at("ids", 1).alias("node"), "v", "ids"), "nodes")
    shared = few.groupBy("node").count().where("count > 1").select("node", F.lit(True).alias("shared"))
    if shared.limit(1).count():
        few = few.join(shared, "node", "left")
        few = ws.write(few.select(F.when(F.col("shared"), F.xxhash64("node", "v")).otherwise(F.col("node")).alias("node"), "v", "ids"), "nodes")
    return few


def sharded(points: DataFrame, n: int, ws: Workspace) -> DataFrame:
    """(shard, node, v): the nodes dealt to regions of about equal shares, a region of too many rows by a hash to several shards."""
    dims = points.select(F.size("v")).first()[0]
    rows = max(1, min(SHARD_NUMBERS // dims, max(SHARD_ROWS, int(48 * n**0.5))))
    most = min(MOST_REGIONS, -(-n // rows))
    few = points.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE_ROWS / n)) + 1)
    regions = Regions(_matrix(few.select("v").toArrow().column("v")), most) if most > 1 else None

    def deal(batches):
        for b in batches:
            at = regions.of(_matrix(b.column("v"))) if regions else np.zeros(b.num_rows, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column("node"), b.column("v")], names=["region", "node", "v"])

    dealt = ws.write(points.select("node", "v").mapInArrow(deal, "region long, node long, v array<double>"), "dealt")
    cuts = dealt.groupBy("region").agg(F.ceil(F.count("*") / (1.25 * rows)).alias("cuts"))
    shard = F.concat_ws("/", "region", F.pmod(F.xxhash64("v"), F.col("cuts")))
    return dealt.join(F.broadcast(cuts), "region").select(shard.alias("shard"), "node", "v")


def graphs(shards: DataFrame, ws: Workspace) -> DataFrame:
    """(shard, node, vec, near, centre, scale): each shard's graph, ``vec`` holding doubles and ``near`` places in the order of nodes; ``centre`` and ``scale``, by which its vectors go to single precision, stand in its first row."""

    def build(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        v = _matrix(t.column("v"))
        centre, scale = nngraph.framed(v)
        x = nngraph.single(v, centre, scale)
        near, rest = nngraph.graph(x), [None] * (len(x) - 1)
        cells = [t.column("shard"), t.column("node"), pa.array([r.tobytes() for r in v], pa.binary()), pa.array([r.tobytes() for r in near], pa.binary()), pa.array([centre.tolist(), *rest], pa.list_(pa.float64())), pa.array([scale, *rest], pa.float64())]
        return pa.table(cells, names=["shard", "node", "vec", "near", "centre", "scale"])

    return ws.write(shards.repartition(SPREAD * parallelism(ws.spark), "shard").groupBy("shard").applyInArrow(build, "shard string, node long, vec binary, near binary, centre array<double>, scale double"), "graphs")


def search(index: DataFrame, asked: DataFrame, pools: list[int], most: int, keep: int) -> DataFrame:
    """(query, node, d, pool, turn): the ``keep`` nearest, measured in double precision, of the pool, for each pool size, that each query of ``asked`` (query, v; a query is a node's name) has in each of the ``most`` shards with the nearest centres.

    ``d`` is a squared distance; ``turn`` counts a query's shards from the nearest. The pool sizes ascend.
    """
    known = index.where("scale is not null").select("shard", "centre").orderBy("shard").toArrow()
    names, centres = known.column("shard").combine_chunks(), _matrix(known.column("centre"))

    def ask(batches):
        for b in batches:
            v = _matrix(b.column("v"))
            d = np.array([np.einsum("ij,ij->i", centres - q, centres - q) for q in v]).reshape(len(v), -1)
            near = np.argsort(d, axis=1, kind="stable")[:, :most]
            row, turn = (a.ravel() for a in np.indices(near.shape))
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(near.ravel())), b.column("query").take(at), b.column("v").take(at), pa.array(turn.astype(np.int32))], names=["shard", "query", "v", "turn"])

    schema = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("d", pa.float64()), ("pool", pa.int32()), ("turn", pa.int32())])

    def walk(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left = left.sort_by("node")
        node, v, near = left.column("node").to_numpy(), _packed(left.column("vec"), "<f8"), _packed(left.column("near"), "<i4")
        first = int(np.flatnonzero(left.column("scale").is_valid().to_numpy())[0])
        centre, scale = np.array(left.column("centre")[first].as_py()), left.column("scale")[first].as_py()
        query, turn = right.column("query").to_numpy(), right.column("turn").to_numpy()
        asking = _matrix(right.column("v"))
        x, q = (nngraph.single(a, centre, scale) for a in (v, asking))
        own = np.searchsorted(node, query)
        own = np.where(node[np.minimum(own, len(node) - 1)] == query, own, len(node))
        out = [schema.empty_table()]
        for pool in pools:
            for lo in range(0, len(q), nngraph.QUERIES):
                some = slice(lo, lo + nngraph.QUERIES)
                if pool < len(node):
                    ids = nngraph.search(x, near, q[some], own[some], pool)[0]
                else:  # every node is in the pool
                    ids = np.tile(np.arange(len(node)), (len(q[some]), 1))
                d = nngraph.measured(v, asking[some], ids)
                by = np.argsort(d, axis=1, kind="stable")[:, :keep]
                ids, d = np.take_along_axis(ids, by, 1), np.take_along_axis(d, by, 1)
                row, col = np.nonzero(ids < len(node))
                out.append(pa.table([query[some][row], node[ids[row, col]], d[row, col], np.full(len(row), pool, np.int32), turn[some][row]], schema=schema))
        return pa.concat_tables(out)

    spark, n = index.sparkSession, asked.count()
    blocks = max(1, -(-n // QUERY_ROWS), min(n // 1024, -(-2 * spark.sparkContext.defaultParallelism // len(names))))
    tasks, unit = SPREAD * parallelism(spark), ["shard", "block"]
    asks = asked.select("query", "v").mapInArrow(ask, "shard string, query long, v array<double>, turn int").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    held = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    return held.repartition(tasks, *unit).groupBy(*unit).cogroup(asks.repartition(tasks, *unit).groupBy(*unit)).applyInArrow(walk, "query long, node long, d double, pool int, turn int")


def truth(points: DataFrame, sample: DataFrame, k: int) -> DataFrame:
    """(query, node): the k nearest other nodes of the queries of a bounded ``sample``, from a scan of all points."""
    some = sample.select("query", "v").toArrow()
    ids, q = some.column("query").to_numpy(), _matrix(some.column("v"))

    def scan(batches):
        for b in batches:
            node, x = b.column("node").to_numpy(), _matrix(b.column("v"))
            at, gap = [], []
            for i, own in zip(ids, q, strict=True):
                y = x - own
                d = np.einsum("ij,ij->i", y, y)
                d[node == i] = np.inf
                at.append(np.argpartition(d, min(k, len(d)) - 1)[:k])
                gap.append(d[at[-1]])
            at, gap = np.array(at), np.array(gap)
            row, col = np.nonzero(np.isfinite(gap))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(node[at[row, col]]), pa.array(gap[row, col])], names=["query", "node", "d"])

    order = Window.partitionBy("query").orderBy("d", "node")
    near = points.select("node", "v").mapInArrow(scan, "query long, node long, d double").withColumn("r", F.row_number().over(order))
    return near.where(F.col("r") <= k).select("query", "node")


def fitted(index: DataFrame, sample: DataFrame, real: DataFrame, ws: Workspace, keep: int, pool: int, least_recall: float) -> tuple[int, int]:
    """The pool and the number of shards, cheapest first, that find ``least_recall`` of the true neighbours ``real`` of a sample of the queries."""
    sizes = [r["count"] for r in index.groupBy("shard").count().collect()]
    wanted, largest = real.count(), max(sizes)
    while True:
        pools = sorted({max(keep, int(pool * m)) for m in POOLS})
        found = ws.write(search(index, sample, pools, len(sizes), keep), "tried")
        hits = np.zeros((len(pools), len(sizes)))
        for r in found.join(real, ["query", "node"]).groupBy("pool", "turn").count().collect():
            hits[pools.index(r["pool"]), r["turn"]] = r["count"]
        enough = np.argwhere(np.cumsum(hits, axis=1) >= least_recall * wanted)
        if len(enough):
            at, turn = min(enough.tolist(), key=lambda c: ((pools[c[0]] + 32) * (c[1] + 1), c))
            return pools[at], turn + 1
        if pools[-1] >= largest:
            return pools[-1], len(sizes)
        pool = 2 * pools[-1]


def nearest(vectors: DataFrame, asked: DataFrame, ws: Workspace, k: int, pool: int = 64, least_recall: float = 0.95, most: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found; ``vectors`` (id, v) are indexed whole, ``asked`` holds (id, v) of theirs.

    Pools start at ``pool`` and grow until the search finds ``least_recall`` of the true neighbours of ``most`` queries, chosen by a hash.
    """
    arrow_rows(ws.spark, 4096)
    points, keep = nodes(vectors, ws, k), 2 * k
    named = asked.select("id", "v").distinct().join(points.select("v", "node"), "v")
    named = ws.write(named.select(F.col("id").alias("query_id"), "node", "v"), "asked")
    index = graphs(sharded(points, points.count(), ws), ws)
    # a query is a node, so equal ones are searched once and an id may have several
    once = ws.write(named.select(F.col("node").alias("query"), "v").dropDuplicates(["query"]), "once")
    sample = ws.write(once.orderBy(F.xxhash64("query"), "query").limit(most), "sample")
    size, shards = fitted(index, sample, ws.write(truth(points, sample, k), "truth"), ws, keep, pool, least_recall)
    found = search(index, once.repartition(parallelism(ws.spark)), [size], shards, keep)
    order = Window.partitionBy("query").orderBy("d", "node")
    found = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * keep)
    found = ws.write(found.select("query", "node"), "found")
    found = found.join(points.select("node", "ids", F.col("v").alias("w")), "node")
    found = found.join(named.select("query_id", F.col("node").alias("query"), "v"), "query")
    return ranked(found.select("query_id", F.explode("ids").alias("vec_id"), "v", "w"), k)


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, v, w) -> (query_id, rank, vec_id, score) of the k nearest by the original vectors."""
    gap = F.aggregate(F.zip_with("v", "w", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    return best(pairs.where("vec_id <> query_id").select("query_id", "vec_id", F.sqrt(gap).alias("score")), k)


def best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def by_size(vectors: DataFrame, asked: DataFrame, ws: Workspace, k: int) -> DataFrame:
    """``nearest`` among the vectors of each size. Sizes of at most ``LEAF_ROWS`` vectors are searched exhaustively, together."""
    size = F.size("v")
    asks = asked.select(size.alias("d")).distinct()
    counts = {r["d"]: r["count"] for r in vectors.groupBy(size.alias("d")).count().join(asks, "d").collect()}
    few = [d for d, n in counts.items() if n <= LEAF_ROWS]
    found = []
    if few or not counts:
        c = vectors.where(size.isin(few)).select(F.col("id").alias("vec_id"), F.col("v").alias("w"), size.alias("d"))
        q = asked.where(size.isin(few)).select(F.col("id").alias("query_id"), "v", size.alias("d"))
        found.append(ranked(q.join(c, "d").select("query_id", "vec_id", "v", "w"), k))
    for d in sorted(set(counts) - set(few)):
        found.append(nearest(vectors.where(size == d), asked.where(size == d), ws, k))
    if len(found) == 1:
        return found[0]
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return best(out.drop("rank"), k)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: the 10 nearest found of each query.

    Rows with a null id or a vector that is null, empty, zero or not finite take no part. Vectors meet those of their
    own size. Rows that repeat id and vector count once; an id with several vectors is a candidate with each. Up to 384
    vectors of a size are searched exhaustively. Empty table: no rows.
    """
    ws = Workspace(spark, "neighbours")
    rows = usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    rows = ws.write(rows.where(F.exists("v", lambda x: x != 0)), "vectors")
    return ws.finish(by_size(rows, rows.where("id % 100 = 0"), ws, 10))
