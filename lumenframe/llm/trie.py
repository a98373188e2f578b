"""Prefix trie of conversations by rolling fingerprints.

A numpy scan gives every turn the polynomial fingerprint of its conversation up to it. Because the multiplier has an inverse,
conversations that are cut and put together anew keep their fingerprints by one shift each, without another scan. Members of a
(depth, fingerprint) are candidates for one node: their turns at that depth are compared with the representative's, the smallest
conv_id, and equal turns all the way up are equal prefixes. Where a turn differs, the conversations concerned are split level by
level on their texts. The rollup needs no walk over levels: what a node adds is put on its representative's path, summed from the
end of that path, and added up over the members of each node above.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import Workspace, arrow_rows, parallelism
from lumenframe.llm.scans import BASE, running

#: Conversations in a block share the first turns of its first one; up to three turns are shared.
BLOCK, SHARED = 20, 4
#: Bytes of ids in a row that goes on to the task that ends a node's digest.
CHUNK = 1 << 16
NODE = ["depth", "print", "side"]
EMPTY = hashlib.sha256(b"").hexdigest()


def words(text: str) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def turns_of(conversations: DataFrame, ws: Workspace) -> DataFrame:
    """(conv, pos, role, text, words, before, upto): turns in order, with the fingerprints of the conversation before and up to each.

    Null turns come first; equal ones stand by role, the first 64 characters of the text, then a hash of the whole.
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.select("*", F.xxhash64("role", "text").alias("turn_print"), words("text").cast("long").alias("words"), F.substring("text", 1, 64).alias("start"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("start"), F.col("turn_print"), F.col("uid")]
    return running(rows.withColumn("uid", F.monotonically_increasing_id()), ws, "conv", order, poly="turn_print").drop("uid", "start", "turn", "turn_print")


def rebuilt(turns: DataFrame, ws: Workspace, mask: int) -> DataFrame:
    """A row for each turn of each rebuilt conversation, and one at depth 0: conv, depth, print, before, words, size, and its source (from_conv, from_pos)."""
    upto = [F.max(F.when(F.col("pos") == i, F.col("upto"))).alias(f"upto{i + 1}") for i in range(SHARED - 1)]
    own = ws.write(turns.groupBy("conv").agg(F.count("*").alias("n"), *upto), "conversations")
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED).cast("int")

    def after(side: str, k: Column) -> Column:
        at = F.lit(0).cast("long")
        for i in range(1, SHARED):
            at = F.when(k == i, F.col(f"{side}upto{i}")).otherwise(at)
        return at

    head = own.select(F.col("conv").alias("block"), F.col("n").alias("block_n"), *(F.col(f"upto{i}").alias(f"block_upto{i}") for i in range(1, SHARED)))
    plan = own.withColumn("block", F.col("conv") - F.col("conv") % BLOCK).withColumn("h", h).join(head, "block", "left")
    plan = plan.withColumn("m", F.least("h", F.coalesce("block_n", F.lit(0))).cast("int"))
    plan = plan.withColumn("size", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    plan = ws.write(plan.select("conv", "block", "h", "m", "size", after("block_", F.col("m")).alias("head"), after("", F.col("h")).alias("cut")), "plan")
    narrow = turns.select("conv", "pos", "words", "before", "upto")
    mine = narrow.join(plan, "conv").where("pos >= h")
    mine = mine.select("conv", (F.col("pos") - F.col("h") + F.col("m") + 1).alias("depth"), "before", "upto", "head", "cut", (F.col("h") - F.col("m")).alias("back"), "words", "size", F.col("conv").alias("from_conv"), F.col("pos").alias("from_pos"))
    first = narrow.where(F.col("pos") < SHARED - 1).withColumnRenamed("conv", "from_conv")
    lent = first.join(plan, F.col("from_conv") == F.col("block")).where("pos < m")
    zero = F.lit(0).cast("long")
    lent = lent.select("conv", (F.col("pos") + 1).alias("depth"), "before", "upto", zero.alias("head"), zero.alias("cut"), F.lit(0).alias("back"), "words", "size", "from_conv", F.col("pos").alias("from_pos"))
    back = np.array([pow(BASE, -i, 1 << 64) for i in range(SHARED)], np.uint64)

    def shifted(batches):
        for b in batches:
            x = {c: b.column(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in ("before", "upto", "head", "cut")}
            by = back[b.column("back").to_numpy(zero_copy_only=False)]
            at = [pa.array(((x["head"] + (x[c] - x["cut"]) * by) & np.uint64(mask)).view(np.int64)) for c in ("upto", "before")]
            rest = ("words", "size", "from_conv", "from_pos")
            yield pa.RecordBatch.from_arrays([b.column("conv"), b.column("depth"), *at, *(b.column(c) for c in rest)], names=["conv", "depth", "print", "before", *rest])

    rows = mine.union(lent).mapInArrow(shifted, "conv long, depth long, print long, before long, words long, size long, from_conv long, from_pos long")
    root = plan.select("conv", zero.alias("depth"), zero.alias("print"), zero.alias("before"), zero.alias("words"), "size", zero.alias("from_conv"), zero.alias("from_pos"))
    return ws.write(rows.union(root), "rebuilt")


def colliding(rows: DataFrame, turns: DataFrame, ws: Workspace) -> DataFrame:
    """(depth, print) of the candidate nodes in which a member's turn differs from the representative's."""
    source = F.struct("from_conv", "from_pos")
    groups = rows.where("depth > 0").groupBy("depth", "print").agg(F.min_by(source, "conv").alias("rep"), F.min(source).alias("lo"), F.max(source).alias("hi"))
    groups = ws.write(groups.where("lo <> hi").select("depth", "print", "rep"), "candidates")  # one source is one turn
    text = turns.select(F.col("conv").alias("from_conv"), F.col("pos").alias("from_pos"), "role", "text")
    asked = rows.where("depth > 0").join(groups.select("depth", "print"), ["depth", "print"], "left_semi").select("depth", "print", "from_conv", "from_pos").distinct()
    asked = asked.join(text, ["from_conv", "from_pos"])
    own = groups.select("depth", "print", F.col("rep.from_conv").alias("from_conv"), F.col("rep.from_pos").alias("from_pos")).join(text, ["from_conv", "from_pos"])
    own = own.select("depth", "print", F.col("role").alias("rep_role"), F.col("text").alias("rep_text"))
    differs = (F.col("role") != F.col("rep_role")) | (F.col("text") != F.col("rep_text"))
    return ws.write(asked.join(own, ["depth", "print"]).where(differs).select("depth", "print").distinct(), "colliding")


def split(rows: DataFrame, turns: DataFrame, bad: DataFrame, ws: Workspace) -> DataFrame:
    """``rows`` with side and before_side: in conversations that meet in a colliding node, the node's smallest member by texts from that depth on; else 0.

    All members of a node below a colliding one pass through it as well, so nodes are split whole.
    """
    zero = F.lit(0).cast("long")
    if not bad.limit(1).count():
        return rows.withColumn("side", zero).withColumn("before_side", zero)
    least = bad.agg(F.min("depth")).first()[0]
    convs = ws.write(rows.join(bad, ["depth", "print"], "left_semi").select("conv").distinct(), "split-convs")
    hit = rows.where(F.col("depth") >= least).join(convs, "conv", "left_semi")
    text = turns.select(F.col("conv").alias("from_conv"), F.col("pos").alias("from_pos"), "role", "text")
    hit = ws.write(hit.join(text, ["from_conv", "from_pos"]).select("conv", "depth", "before", "role", "text"), "split-turns")
    last, depth, done = hit.agg(F.max("depth")).first()[0], least, []
    above = convs.withColumn("above", zero)
    while depth <= last:
        now = hit.where(F.col("depth") == depth).join(above, "conv")
        by = ["above", *(["before"] if depth == least else []), "role", "text"]
        names = now.groupBy(*by).agg(F.min("conv").alias("side"))
        now = ws.write(now.join(names, by).select("conv", "depth", "side", F.col("above").alias("before_side")), "split-level")
        done.append(now)
        above, depth = now.select("conv", F.col("side").alias("above")), depth + 1
    sides = done[0]
    for d in done[1:]:
        sides = sides.union(d)
    out = rows.join(sides, ["conv", "depth"], "left")
    return ws.write(out.withColumns({c: F.coalesce(c, zero) for c in ("side", "before_side")}), "split")


def ends(rows: DataFrame, ws: Workspace) -> DataFrame:
    """(depth, print, side) -> sha: SHA-256 of the comma-joined ids, ascending, of the conversations that end there.

    Ids lie sorted over partitions. A node inside one partition is hashed there; a node that reaches a partition's border sends
    its ids on in chunks, which a second pass streams through one hash.
    """
    at = rows.where("depth = size").select(*NODE, "conv")
    order = [*NODE, "conv"]
    at = at.repartitionByRange(parallelism(ws.spark), *order).sortWithinPartitions(*order)
    schema = "depth long, print long, side long, sha string, ids binary, first long"

    def runs(batches):
        kept: list[tuple] = []  # closed nodes
        now, held, first, border = None, [], 0, True  # the first node of a partition may have begun before it

        def chunked(node, ids):
            return [(*node, None, ",".join(map(str, ids[i : i + CHUNK // 8])).encode(), ids[i]) for i in range(0, len(ids), CHUNK // 8)]

        def emit(rows_):
            cols = list(zip(*rows_, strict=True)) if rows_ else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["depth", "print", "side", "sha", "ids", "first"])

        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in order]
            cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:3]], axis=0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                node = tuple(int(c[lo]) for c in cols[:3])
                if node != now:
                    if now is not None:
                        kept += chunked(now, held) if border else [(*now, hashlib.sha256(",".join(map(str, held)).encode()).hexdigest(), None, 0)]
                        border = False
                    now, held = node, []
                held += cols[3][lo:hi].tolist()
                if len(held) >= CHUNK:  # a node this large goes on in chunks wherever it ends
                    kept += chunked(now, held)
                    held, border = [], True
            yield emit(kept)
            kept = []
        if now is not None and held:
            yield emit(chunked(now, held))

    found = ws.write(at.mapInArrow(runs, schema), "ends")
    open_ = found.where("sha is null").select(*NODE, "first", "ids").repartition(parallelism(ws.spark), *NODE).sortWithinPartitions(*NODE, "first")

    def join(batches):
        now, h = None, None
        for b in batches:
            out = []
            for *node, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids")), strict=True):
                if node != now:
                    if now is not None:
                        out.append((*now, h.hexdigest()))
                    now, h = node, hashlib.sha256(ids)
                else:
                    h.update(b"," + ids)
            yield table(out)
        if now is not None:
            yield table([(*now, h.hexdigest())])

    def table(out):
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["depth", "print", "side", "sha"])

    return found.where("sha is not null").select(*NODE, "sha").union(open_.mapInArrow(join, "depth long, print long, side long, sha string"))


def trie(conversations: DataFrame, ws: Workspace, bits: int = 64) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for every node. ``bits`` of the fingerprints are used."""
    arrow_rows(ws.spark)
    turns = turns_of(conversations, ws)
    rows = rebuilt(turns, ws, (1 << bits) - 1)
    rows = split(rows, turns, colliding(rows, turns, ws), ws)
    nodes = rows.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"), F.min("words").alias("words"), F.min("before").alias("up"), F.min("before_side").alias("up_side"))
    nodes = ws.write(nodes, "nodes")
    up = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("print"), F.col("up_side").alias("side")).agg(F.count("*").alias("n_children"))
    nodes = ws.write(nodes.join(up, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "children")
    # what a node adds stands on its representative's path
    adds = nodes.select(F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    path = rows.select("conv", *NODE).join(adds, ["conv", "depth"], "left").fillna(0, ["saved", "leaf"])
    path = running(path, ws, "conv", [F.col("depth").desc()], sums=("saved", "leaf"))
    below = path.groupBy(*NODE).agg(F.sum("leaf_sum").alias("n_leaves"), F.sum("saved_sum").alias("saved_tokens"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("up"), F.col("side").alias("up_side"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, NODE).join(parents, ["depth", "up", "up_side"], "left").join(ends(rows, ws), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for every node of the rebuilt ``conversations``.

    Rows without a conv_id belong to no conversation. Null roles and texts are empty; null turns come first; equal turns stand by role and
    text, and repeated rows are turns of their own. Texts of any length are hashed and compared whole. A negative conv_id belongs to the
    block towards zero, as SQL's remainder has it. Empty table: no rows, not even the root.
    """
    ws = Workspace(spark, "trie")
    return ws.finish(trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"), ws))


SQL = r"""
WITH RECURSIVE
crc(i, k, c) AS (SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
step AS (SELECT i, c FROM crc WHERE k = 8),
walk(conv_id, s, n, c) AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR), 0, 4294967295 FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT conv_id, s, n + 1, xor(w.c >> 8, t.c) FROM walk w JOIN step t ON t.i = xor(w.c & 255, ascii(s[n + 1])) WHERE n < length(s)),
shared AS (SELECT conv_id, xor(c, 4294967295) % 4 AS h FROM walk WHERE n = length(s)),
turns AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
built AS (SELECT conv_id, list_concat(coalesce(b.own[1:h], []), t.own[h + 1:]) AS seq
  FROM turns t JOIN shared USING (conv_id) LEFT JOIN (SELECT conv_id AS block, own FROM turns) b ON b.block = conv_id - conv_id % 20),
paths AS (SELECT conv_id, depth, seq[1:depth] AS path, len(seq) AS size FROM (SELECT *, unnest(range(len(seq) + 1)) AS depth FROM built)),
nodes AS MATERIALIZED (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  (count(*) - 1) * (CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(any_value(path[depth].text), '[^\x20\x09-\x0D]+')) END) AS saved,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM paths GROUP BY path, depth),
kids AS MATERIALIZED (SELECT v.path, v.depth, any_value(v.conv_id) AS conv_id, count(c.path) AS n_children FROM nodes v
  LEFT JOIN nodes c ON c.depth = v.depth + 1 AND c.path[1:v.depth] = v.path GROUP BY v.path, v.depth),
below AS (SELECT v.path, v.depth, CAST(sum(u.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves FROM nodes v
  JOIN nodes u ON u.depth >= v.depth AND u.path[1:v.depth] = v.path JOIN kids k ON k.path = u.path AND k.depth = u.depth GROUP BY v.path, v.depth)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, k.n_children, b.n_leaves, b.saved_tokens, n.ends_sha256
FROM nodes n JOIN kids k ON k.path = n.path AND k.depth = n.depth JOIN below b ON b.path = n.path AND b.depth = n.depth
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]"""
