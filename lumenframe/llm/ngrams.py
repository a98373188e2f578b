"""Jaccard join of word n-gram sets by grouped prefixes.

Shingles have a global order: by how often their hash bucket occurs in all documents, on a logarithmic scale, then by hash, so
that rare ones come first. Two sets that reach the similarity share one of the first few members of each in that order, its
prefix. Documents of one size and one prefix collapse into a group; only groups are posted under their prefix members, and pairs
of groups are filtered by size and by the place of the shared member. Groups that meet are expanded to their distinct sets, whose
pairs are filtered by parity sketches (``sketch``) and then verified on the whole sets. Filters drop no pair that links.

The result is components, so a list of many close sets emits its pairs only while they are few for its members, else the nearest
of each member. What verifies is one class from then on; lists that held pairs back emit more of those between different classes,
until none is left. A list of more than ``LIST_ROWS`` sets is compared as pairs of blocks, by as many tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import sketch
from lumenframe.llm.common import Workspace, arrow_rows, parallelism, spread
from lumenframe.llm.components import components, merged

WIDTH = 3
#: Least similarity as a fraction: intersection >= NUM / DEN of the union.
NUM, DEN = 90, 100
LIST_ROWS = 2048
#: Bounds of the buckets in which occurrences are counted; all executors get a byte for each.
LEAST_BUCKETS, MOST_BUCKETS, CHUNK = 1 << 14, 1 << 22, 1 << 12
#: Bits of the table that tells texts to verify from others.
FILTER_BITS = 1 << 26
#: Words whose hashes a task remembers.
KNOWN = 1 << 20
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _Words(dict):
    def __missing__(self, word):
        if len(self) >= KNOWN:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 11)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    x = (x ^ (x >> np.uint64(29))) * _ODD[4]
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: dict, width: int = WIDTH) -> np.ndarray:
    """Distinct 64-bit hashes of the word n-grams of the whole text, ascending; fewer words are one n-gram, no words none."""
    said = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not said:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, said), np.uint64, len(said))
    n = min(width, len(h))
    total = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        total = _mixed(total * _ODD[0] + h[i : len(h) - n + 1 + i] * _ODD[1])
    return np.unique(total)


def _sets(column, width: int, words: dict):
    """The sets of a batch of texts; equal neighbours are hashed once."""
    last, own = None, None
    for t in column.to_pylist():
        if own is None or t != last:
            last, own = t, shingles(t, words, width)
        yield own


def levels(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """Rank of each hash bucket by the number of documents' members in it: a quarter of an octave is a level."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << int(size / 512).bit_length()))
    shift = np.uint64(64 - (buckets.bit_length() - 1))

    def count(batches):
        total, words = np.zeros(buckets, np.uint32), _Words()
        for b in batches:
            for s in _sets(b.column("text"), width, words):
                np.add.at(total, (s >> shift).astype(np.int64), 1)
        some = [i for i in range(0, buckets, CHUNK) if total[i : i + CHUNK].any()]
        packed = [(lambda c: c.astype(f"<u{1 if c.max() < 1 << 8 else 2 if c.max() < 1 << 16 else 4}").tobytes())(total[i : i + CHUNK]) for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(packed, pa.binary())], names=["first", "n"])

    def add(batches):
        now, total = None, None
        for b in batches:
            done = []
            for first, n in zip(b.column("first").to_pylist(), b.column("n").to_pylist(), strict=True):
                if first != now:
                    if now is not None:
                        done.append((now, rank(total)))
                    now, total = first, np.zeros(CHUNK, np.int64)
                total += np.frombuffer(n, f"<u{len(n) // CHUNK}")
            yield table(done)
        if now is not None:
            yield table([(now, rank(total))])

    def rank(total):
        return np.minimum(255, 4 * np.log2(1.0 + total)).astype(np.uint8).tobytes()

    def table(done):
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.binary())], names=["first", "n"])

    counted = docs.select("text").mapInArrow(count, "first long, n binary")
    summed = counted.repartition(max(1, min(parallelism(docs.sparkSession), buckets // CHUNK)), "first").sortWithinPartitions("first").mapInArrow(add, "first long, n binary")
    out = np.zeros(buckets, np.uint8)
    for r in summed.collect():  # MOST_BUCKETS bytes at most
        out[r["first"] : r["first"] + CHUNK] = np.frombuffer(r["n"], np.uint8)
    return out


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    return n - -(-num * n // den) + 1


def index_length(n, num: int = NUM, den: int = DEN):
    """Members under which a set can meet a set at least as large."""
    return n - -(-2 * num * n // (num + den)) + 1


def described(docs: DataFrame, level: np.ndarray, num: int = NUM, den: int = DEN, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, text_hash) -> doc_id, text_hash, n, and for sets that are not empty: node (a digest of the set), kin (of size and prefix), prefix, sketch."""
    told = docs.sparkSession.sparkContext.broadcast(level)
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "text_hash", "n", "node", "kin", "prefix", "sketch"]

    def run(batches):
        level, words = told.value, _Words()
        shift = np.uint64(64 - (len(level).bit_length() - 1))
        for b in batches:
            out, last, own = [], None, None
            for s in _sets(b.column("text"), width, words):
                if own is None or s is not last:
                    n, last = len(s), s
                    if n:
                        first = s[np.argsort(level[(s >> shift).astype(np.int64)], kind="stable")[: prefix_length(n, num, den)]].tobytes()
                        own = n, xxhash.xxh128_digest(s.tobytes()), xxhash.xxh128_digest(first, n), first, sketch.parity(s)
                    else:
                        own = 0, None, None, None, None
                out.append(own)
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.int64(), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, f"doc_id {kind}, text_hash long, n long, node binary, kin binary, prefix binary, sketch binary")


def postings(groups: DataFrame) -> DataFrame:
    """(kin_id, n, members, prefix) -> a row for each prefix member: token, kin_id, n, members, place."""

    def run(batches):
        for b in batches:
            tokens = [np.frombuffer(p, np.int64) for p in b.column("prefix").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(tokens)), [len(t) for t in tokens]))
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(t)) for t in tokens)])
            token = np.concatenate([np.zeros(0, np.int64), *tokens])
            yield pa.RecordBatch.from_arrays([pa.array(token), *(b.column(c).take(at) for c in ("kin_id", "n", "members")), pa.array(place)], names=["token", "kin_id", "n", "members", "place"])

    return groups.select("kin_id", "n", "members", "prefix").mapInArrow(run, "token long, kin_id long, n long, members long, place long")


LIST = ["kind", "token", "i", "j"]


def lists(groups: DataFrame, classes: DataFrame, ws: Workspace, num: int = NUM, den: int = DEN) -> DataFrame:
    """Rows of the lists in which sets meet: LIST, own (its block), node_id, kin_id, n, place, sketch. Kind 0: groups that share a member; kind 1: sets of one group."""
    posts = postings(groups)
    held = F.sum((F.col("place") < F.col("n") - F.ceil(2 * num * F.col("n") / (num + den)) + 1).cast("long"))
    size = posts.groupBy("token").agg(F.count("*").alias("groups"), F.sum("members").alias("rows"), held.alias("held"))
    size = ws.write(size.where("groups > 1 and held > 0").select("token", "rows"), "lists")
    met = posts.join(size, "token").select(F.lit(0).alias("kind"), "token", "kin_id", "place", "rows")
    alone = groups.where("members > 1").select(F.lit(1).alias("kind"), F.col("kin_id").alias("token"), "kin_id", F.lit(0).cast("long").alias("place"), F.col("members").alias("rows"))
    rows = met.union(alone).join(classes.select("kin_id", "node_id", "n", "sketch"), "kin_id")
    blocks = F.ceil(F.col("rows") / LIST_ROWS).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return ws.write(rows.select("kind", "token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node_id", "kin_id", "n", "place", "sketch"), "members")


def close_pairs(kind: int, i: int, j: int, rows: dict[str, np.ndarray], step: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Index pairs of different classes that pass every filter: all while they are at most four for each row, else the ``step`` nearest of each; and whether some were held back."""
    n, place, cls, kin, bits, own = (rows[c] for c in ("n", "place", "cls", "kin_id", "sketch", "own"))
    left, right = (np.flatnonzero(own == i), np.flatnonzero(own == j)) if i != j else (np.arange(len(n)), np.arange(len(n)))
    index = index_length(n, num, den)
    found = []
    for lo in range(0, len(left), 256):
        x, y = left[lo : lo + 256, None], right[None, :]
        nx, ny = n[x], n[y]
        both = -(-(num * (nx + ny)) // (num + den))
        ok = (cls[x] != cls[y]) & (both <= np.minimum(nx, ny))
        if i == j:
            ok &= x < y
        if kind == 0:
            small = np.where(nx < ny, place[x] < index[x], np.where(ny < nx, place[y] < index[y], (place[x] < index[x]) | (place[y] < index[y])))
            ok &= small & (kin[x] != kin[y]) & (place[x] <= nx - both) & (place[y] <= ny - both)
        p, q = np.nonzero(ok)
        p, q = left[lo + p], right[q]
        d = sketch.apart(bits[p], bits[q])
        ok = d <= sketch.may_differ(n[p], n[q], num, den)
        found.append((p[ok], q[ok], d[ok]))
    a, b, d = (np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*found, strict=True))
    if len(a) <= 4 * len(n):
        return a, b, False
    one, two, d = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([d, d])
    order = np.lexsort((two, d, one))
    one, two = one[order], two[order]
    begin = np.flatnonzero(np.r_[True, one[1:] != one[:-1]])
    nth = np.arange(len(one)) - np.repeat(begin, np.diff(np.r_[begin, len(one)]))
    return one[nth < step], two[nth < step], bool((nth >= step).any())


def candidates(rows: DataFrame, step: int, tasks: int, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b, nulls) for close pairs of each list in ``rows`` (with cls), and (null, null, LIST) of the lists that held pairs back."""
    rows = rows.repartition(tasks, *LIST).sortWithinPartitions(*LIST)
    names = ["node_id", "kin_id", "n", "place", "cls", "own"]
    schema = "a long, b long, kind int, token long, i int, j int"

    def run(batches):
        last, held = None, []

        def close(out):
            cols = {c: np.concatenate([h[c] for h in held]) for c in (*names, "sketch")}
            a, b, more = close_pairs(last[0], last[2], last[3], cols, step, num, den)
            ids = cols["node_id"]
            out.append((np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b]), last if more else None))

        def table(out):
            a, b = (np.concatenate([np.zeros(0, np.int64), *(o[k] for o in out)]) for k in (0, 1))
            keys = [o[2] for o in out if o[2] is not None]
            none, gap = [None] * len(a), [None] * len(keys)
            cols = [pa.array([*a.tolist(), *gap], pa.int64()), pa.array([*b.tolist(), *gap], pa.int64())]
            cols += [pa.array([*none, *(int(k[c]) for k in keys)], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int32()))]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", *LIST])

        for b in batches:
            if not b.num_rows:
                continue
            key = [b.column(c).to_numpy(zero_copy_only=False) for c in LIST]
            cols = {c: b.column(c).to_numpy(zero_copy_only=False) for c in names} | {"sketch": sketch.matrix(b.column("sketch").to_pylist())}
            cut = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1).tolist(), b.num_rows]
            out: list = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                this = tuple(int(k[lo]) for k in key)
                if this != last:
                    if held:
                        close(out)
                    last, held = this, []
                held.append({c: v[lo:hi] for c, v in cols.items()})
            yield table(out)
        if held:
            out = []
            close(out)
            yield table(out)

    return rows.select(*LIST, *names, "sketch").mapInArrow(run, schema)


def among(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` can be in ``wanted``: a bit table of FILTER_BITS, so at most FILTER_BITS / 64 rows, goes to every task and keeps other rows out of a shuffle."""
    word, bit = f"cast(shiftright(pmod(xxhash64({key}), {FILTER_BITS}L), 6) as long)", f"cast(pmod(xxhash64({key}), 64L) as int)"
    bits = wanted.groupBy(F.expr(word).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("_bits"))
    near = rows.withColumn("_word", F.expr(word)).join(F.broadcast(bits), "_word")
    return near.where(F.expr(f"shiftright(_bits, {bit}) & 1L = 1L")).select(*rows.columns)


def whole_sets(docs: DataFrame, nodes: DataFrame, ws: Workspace, width: int = WIDTH) -> DataFrame:
    """(node_id, node, text_hash) -> (node_id, set) from the texts; a text that only shares the hash has another digest and is left out."""

    def run(batches):
        words = _Words()
        for b in batches:
            keep, sets, seen = [], [], set()
            for at, (s, i, node) in enumerate(zip(_sets(b.column("text"), width, words), b.column("node_id").to_pylist(), b.column("node").to_pylist(), strict=True)):
                if i not in seen and xxhash.xxh128_digest(s.tobytes()) == node:
                    seen.add(i)
                    keep.append(at)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("node_id").take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary())], names=["node_id", "set"])

    texts = among(docs.select("text_hash", "text"), nodes, "text_hash").join(nodes, "text_hash").select("node_id", "node", "text")
    return ws.write(texts.mapInArrow(run, "node_id long, set binary").groupBy("node_id").agg(F.any_value("set").alias("set")), "sets")


def verified(pairs: DataFrame, sets: DataFrame, ws: Workspace, num: int = NUM, den: int = DEN) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are similar enough."""

    def run(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(den * both >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.select(F.col("node_id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node_id").alias("b"), F.col("set").alias("y")), "b")
    return ws.write(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "verified")


def join_components(rows: DataFrame, docs: DataFrame, classes: DataFrame, ws: Workspace, num: int = NUM, den: int = DEN, width: int = WIDTH) -> DataFrame:
    """(node, root) of the sets in ``rows`` (as ``lists`` gives them) that link to another."""
    roots, sets, step, tasks = None, None, 1, parallelism(ws.spark)
    rows = rows.withColumn("cls", F.col("node_id"))
    while True:
        found = ws.write(candidates(rows, step, tasks, num, den), "candidates")
        pairs = ws.write(found.where("kind is null").select("a", "b").distinct(), "pairs")
        if sets is None:  # each row with a close partner is in a pair of the first round
            nodes = pairs.select(F.col("a").alias("node_id")).union(pairs.select("b")).distinct()
            sets = whole_sets(docs, classes.join(nodes, "node_id").select("node_id", "node", "text_hash"), ws, width)
            asked = sets
        else:
            asked = among(sets, pairs.select(F.explode(F.array("a", "b")).alias("node_id")), "node_id")
        roots = ws.write(merged(roots, verified(pairs, asked, ws, num, den), ws), "roots")
        more = found.where("kind is not null").select(*LIST)
        if not more.limit(1).count():
            return roots
        again = among(rows, more, "token").join(more, LIST, "left_semi").drop("cls").join(roots.select(F.col("node").alias("node_id"), F.col("root").alias("cls")), "node_id", "left")
        rows = ws.write(again.withColumn("cls", F.coalesce("cls", "node_id")), "held")
        step *= 8


def similar(docs: DataFrame, ws: Workspace, num: int = NUM, den: int = DEN, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (columns doc_id, text), linked where intersection >= num / den of the union."""
    arrow_rows(ws.spark)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    told = ws.write(described(docs, levels(docs, width), num, den, width), "described")
    one = {c: F.any_value(c).alias(c) for c in ("n", "kin", "prefix", "sketch")}
    wide = told.where("n > 0").groupBy("node").agg(F.min("text_hash").alias("text_hash"), F.min("doc_id").alias("least"), *one.values())
    wide = ws.write(wide.withColumn("node_id", F.monotonically_increasing_id()), "classes")
    rows = ws.write(told.select("doc_id", "n", "node"), "documents")
    ws.drop(told)
    groups = wide.groupBy("kin").agg(F.count("*").alias("members"), one["n"], one["prefix"])
    groups = ws.write(groups.withColumn("kin_id", F.monotonically_increasing_id()), "groups")
    named = ws.write(wide.join(groups.select("kin", "kin_id"), "kin").select("node_id", "kin_id", "n", "sketch"), "named")
    classes = ws.write(wide.select("node", "node_id", "text_hash", "least"), "nodes")
    ws.drop(wide)
    met = lists(groups, named, ws, num, den)
    ws.drop(groups, named)
    roots = join_components(met, docs, classes, ws, num, den, width)
    top = classes.select("node", "node_id", "least").join(roots.select(F.col("node").alias("node_id"), "root"), "node_id", "left").withColumn("root", F.coalesce("root", "node_id"))
    top = ws.write(top.join(top.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id"), "components")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.where("n > 0").join(top, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``documents``.

    Null, empty and wordless texts have no shingles and link to nothing; one or two words are one shingle. Texts of any length
    are taken whole. Rows are documents: repeated ids and copies keep their rows and link like others. A null doc_id joins its
    component but never names it; a component of null ids only has a null component_id. A shingle is its 64-bit hash: two
    different ones of a document agree with a chance of about n * n / 2^65. Empty table: no rows.
    """
    ws = Workspace(spark, "ngrams")
    return ws.finish(similar(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), ws))


SQL = r"""
WITH RECURSIVE
said AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM said),
flat AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND b.n * 10 >= a.n * 9 AND a.n * 10 >= b.n * 9
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reach(a, b) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
SELECT doc_id, len(s) AS n_shingles, component_id FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = doc_id"""
