"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into parts, correlated bits together. For a query fingerprint each part i gets a threshold
t_i >= -1 with sum(t_i + 1) = distance + 1; any fingerprint within the distance then agrees with the query to within t_i
bits on some part i (a part at -1 is not probed). A dynamic programme picks the thresholds of each query by the candidate
counts that a sample of the fingerprints predicts. Probes meet the indexed fingerprints in buckets (part, value), and
every candidate is verified on all bits. A bucket emits a spanning forest of its links, not its pairs. A bucket of more
than ``BUCKET`` squared comparisons is divided by the remaining bits, again by the pigeonhole principle, so no group is unbounded
and no link is lost.

The pipeline's stage takes the fingerprints for candidates only and verifies each on the five-word shingles of the texts, after
sizes and parity sketches of the shingle sets have told most pairs of a bucket that cannot reach the similarity.
There a bucket emits its pairs while they are few for its members, else the nearest of each member; what verifies is one
class from then on, and the buckets that held pairs back emit more of those between different classes, until none is left.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import sketch
from lumenframe.llm.common import Workspace, arrow_rows, parallelism, spread, stage_workspace
from lumenframe.llm.components import components, merged
from lumenframe.llm.ngrams import among

BUCKET = 2048
#: Bits of a parity sketch of a text's five-word shingles.
SKETCH = 512
#: By then at most four bits of a path are open.
DEPTH = 8


def fingerprint(text: str | None, width: int = 3, repeats: bool = True) -> int:
    """SimHash of the word shingles of the whole text as an unsigned 64-bit number; without ``repeats`` each shingle counts once."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    else:
        s, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        digest, start, hashes = xxhash.xxh64_intdigest, 0, []
        for i in range(width - 1, len(words)):
            hashes.append(digest(s[start : ends[i]], 42))
            start = ends[i - width + 1] + 1
    if not repeats:
        hashes = list(set(hashes))
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        h = np.array(hashes[i : i + (1 << 16)], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3, repeats: bool = True, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with ``_fp``, the fingerprint as a signed long."""
    arrow_rows(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        for b in batches:
            last, out = {}, []
            for t in b.column(text).to_pylist():
                if t not in last:
                    last[t] = fingerprint(t, width, repeats)
                out.append(last[t])
            fp = pa.array(np.array(out, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*b.columns, fp], names=[*b.schema.names, "_fp"])

    return docs.mapInArrow(run, f"{schema}, _fp long")


def partition_bits(sample: np.ndarray, parts: int) -> list[np.ndarray]:
    """64 bits in ``parts`` near-equal groups, each grown around its first bit by absolute correlation on the sample."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((1, 64))
    bits -= bits.mean(0)
    scale = np.sqrt((bits**2).sum(0)) + 1e-9
    corr = np.abs(bits.T @ bits) / np.outer(scale, scale)
    left, groups = list(range(64)), []
    for p in range(parts):
        size = (64 - sum(map(len, groups))) // (parts - p)
        own = [left.pop(0)]
        while len(own) < size:
            best = max(left, key=lambda j: (corr[j, own].sum(), -j))
            left.remove(best)
            own.append(best)
        groups.append(np.array(sorted(own)))
    return groups


def values(fp: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The chosen bits of each fingerprint, packed into a number."""
    out = np.zeros(len(fp), np.int64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    return out


def allocate(costs: np.ndarray, distance: int) -> np.ndarray:
    """costs[n, part, t + 1] of threshold t in -1..distance -> thresholds[n, part] of least total with sum(t + 1) = distance + 1."""
    n, parts, levels = costs.shape
    best = np.full((n, distance + 2), np.inf)
    best[:, 0] = 0
    choice = np.zeros((n, parts, distance + 2), np.int8)
    for p in range(parts):
        new = np.full_like(best, np.inf)
        for spend in range(min(levels, distance + 2)):
            cand = np.full_like(best, np.inf)
            cand[:, spend:] = best[:, : distance + 2 - spend] + costs[:, p, spend, None]
            better = cand < new
            new[better] = cand[better]
            choice[:, p][better] = spend
        best = new
    out, left, rows = np.zeros((n, parts), np.int64), np.full(n, distance + 1), np.arange(n)
    for p in reversed(range(parts)):
        spend = choice[rows, p, left]
        out[:, p] = spend.astype(np.int64) - 1
        left = left - spend
    return out


class Plan:
    """Parts, and for each the sample's counts of values and of values one bit away."""

    def __init__(self, sample: np.ndarray, distance: int, total: int, parts: int = 4):
        if distance + 1 > 2 * parts:
            raise ValueError("thresholds go to 1, so the distance must be under twice the parts")
        self.distance = distance
        self.parts = partition_bits(sample, parts)
        self.scale = max(1.0, total / max(1, len(sample)))
        self.tables = []
        for bits in self.parts:
            v, n = np.unique(values(sample, bits), return_counts=True)
            self.tables.append((v, n.astype(float)))

    def _count(self, p: int, v: np.ndarray) -> np.ndarray:
        keys, n = self.tables[p]
        if not len(keys):
            return np.zeros(len(v))
        at = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
        return np.where(keys[at] == v, n[at], 0.0)

    def probes(self, fp: np.ndarray):
        """Yields (part, value, index into fp, own): every fingerprint's own value in each part, marked 1 where it is also probed, and flipped probes."""
        vals = [values(fp, b) for b in self.parts]
        costs = np.full((len(fp), len(self.parts), 3), np.inf)
        for p, v in enumerate(vals):
            exact = self._count(p, v)
            near = exact + sum(self._count(p, v ^ (1 << i)) for i in range(len(self.parts[p])))
            costs[:, p, 0] = 0
            costs[:, p, 1] = 1 + exact * self.scale
            costs[:, p, 2] = 1 + len(self.parts[p]) + near * self.scale
        t = allocate(costs, self.distance)
        every = np.arange(len(fp))
        for p, v in enumerate(vals):
            yield p, v, every, (t[:, p] >= 0).astype(np.int8)
            far = every[t[:, p] >= 1]
            for i in range(len(self.parts[p])):
                yield p, v[far] ^ (1 << i), far, np.full(len(far), 2, np.int8)


def meets(own: np.ndarray, i, j) -> np.ndarray:
    """True where one of two members of a bucket is indexed there and the other probes it: own is 0 indexed, 1 both, 2 a flipped probe."""
    return (own[i] + own[j] > 0) & (own[i] + own[j] < 4)


def forest(fp: np.ndarray, own: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest, as index pairs, of the links within ``distance`` among distinct fingerprints: one comparison row for each member."""
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            near = (np.bitwise_count(fp[left] ^ fp[i]) <= distance) & meets(own, left, i)
            if near.any():
                found = left[near]
                a.append(np.full(len(found), i))
                b.append(found)
                stack += found.tolist()
                left = left[~near]
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(a), np.concatenate(b)


def pairs_of(fp: np.ndarray, own: np.ndarray, cls: np.ndarray, distance: int, step: int, n: np.ndarray, bits: np.ndarray, least: Fraction) -> tuple[np.ndarray, np.ndarray, bool]:
    """Index pairs within ``distance`` of different classes that can be as similar as ``least``: all while they are at most four for each member, else the ``step`` nearest of each member; and whether some were held back.

    n and bits are the sizes and parity sketches of the members' shingle sets: they tell exactly that most pairs are too far apart.
    All zero, they tell nothing and leave every pair in. A step of 0 gives all pairs or none.
    """
    m, at, all_a, all_b, some_a, some_b, total, cut = len(fp), np.flatnonzero(own < 2), [], [], [], [], 0, False
    rows = max(1, min(256, (1 << 20) // max(1, m)))
    for lo in range(0, len(at), rows):
        i, j = at[lo : lo + rows, None], np.arange(m)[None, :]
        d = np.bitwise_count(fp[i] ^ fp[j])
        ok = (d <= distance) & meets(own, i, j) & (cls[i] != cls[j])
        x, y = np.nonzero(ok)
        far_apart = sketch.apart(bits[at[lo + x]], bits[y]) > sketch.may_differ(n[at[lo + x]], n[y], least.numerator, least.denominator)
        ok[x[far_apart], y[far_apart]] = False
        if not ok.any():
            continue
        x, y = np.nonzero(ok & ((i < j) | (own[j] == 2)))
        total += len(x)
        if total <= 4 * m:
            all_a.append(at[lo + x])
            all_b.append(y)
        cut |= bool((ok.sum(1) > step).any())
        if step:
            far = np.where(ok, d, 100)
            near = np.argsort(far, axis=1, kind="stable")[:, :step]
            keep = np.take_along_axis(far, near, 1) < 100
            some_a.append(np.repeat(at[lo : lo + rows], keep.sum(1)))
            some_b.append(near[keep])
    few = total <= 4 * m
    a, b = (all_a, all_b) if few else (some_a, some_b)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(none + a), np.concatenate(none + b), cut and not few


def buckets(fps: DataFrame, ws: Workspace, distance: int, parts: int = 4, sample_rows: int = 20_000, prune: bool = True) -> list[DataFrame]:
    """(fp, node) -> tables of (path, value, fp, own, node), whose buckets (path, value) hold all links between them.

    ``prune`` joins away the buckets of one member, which pays where most are; elsewhere the join moves more than it saves.

    No bucket but those of the last depth, whose members agree on all but a few bits, needs more than ``BUCKET`` squared
    comparisons of an indexed row with another.
    """
    total = fps.count()
    # bounded in expectation by sample_rows: a hash of the fingerprint chooses
    few = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(1, total)))).select("fp")
    sample = np.array([r[0] for r in few.collect()], np.int64).view(np.uint64)
    plan = ws.spark.sparkContext.broadcast(Plan(sample, distance, total, parts))

    def post(batches):
        for b in batches:
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for p, v, at, own in plan.value.probes(fp):
                if len(at):
                    key = pa.array([str(p)] * len(at), pa.string())
                    yield pa.RecordBatch.from_arrays([key, pa.array(v), _signed(fp[at]), pa.array(own), b.column("node").take(pa.array(at))], names=NAMES)

    posted = fps.select("fp", "node").mapInArrow(post, BUCKETS)
    out = []
    for depth in range(DEPTH):
        posted = ws.write(posted, "postings")
        held = F.count(F.when(F.col("own") < 2, 1))
        size = posted.groupBy("path", "value").agg(F.count("*").alias("n"), F.max("own").alias("probed"), held.alias("held"))
        size = ws.write(size.where("n > 1 and probed > 0 and held > 0").select("path", "value", (F.col("n") * F.col("held")).alias("work")), "buckets")
        live = posted.join(size, ["path", "value"])
        last = depth == DEPTH - 1 or not size.where(F.col("work") > BUCKET**2).limit(1).count()
        out.append(posted if last and not prune else (live if last else live.where(F.col("work") <= BUCKET**2)).drop("work"))
        if last:
            break
        posted = _divide(live.where(F.col("work") > BUCKET**2).drop("work"), plan, distance)
    return out


NAMES = ["path", "value", "fp", "own", "node"]
BUCKETS = "path string, value long, fp long, own byte, node long"


def links(fps: DataFrame, ws: Workspace, distance: int = 2) -> DataFrame:
    """Distinct fingerprints (column fp) -> (a, b) links that span every component within ``distance`` bits."""

    def spanning(path, value, fp, own, node, cls, n, bits):
        a, b = forest(fp, own, distance)
        return node[a], node[b], False

    tasks = parallelism(ws.spark)
    found = [_within(t, spanning, tasks).where("path is null").select("a", "b") for t in buckets(fps.withColumn("node", F.col("fp")), ws, distance)]
    return ws.write(_union(found).distinct(), "links")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _within(rows: DataFrame, emit, tasks: int) -> DataFrame:
    """(a, b, null, null) for the pairs that ``emit`` finds in each bucket, and (null, null, path, value) of those with more.

    ``rows`` may have columns cls, the class of each node so far, and n and sketch, the size and parity sketch of its set. Buckets
    arrive side by side in sorted partitions, several to an Arrow batch.
    """
    if "cls" not in rows.columns:
        rows = rows.withColumn("cls", F.col("node"))
    sized = "sketch" in rows.columns
    rows = rows.select(*NAMES, "cls", *(("n", "sketch") if sized else ())).repartition(tasks, "path", "value").sortWithinPartitions("path", "value")

    def run(batches):
        held: list[list[np.ndarray]] = []
        last = None

        def close(out):
            a, b, more = emit(*last, *(np.concatenate(c) for c in zip(*held, strict=True)))
            out.append((a, b, last if more else None))

        for t in batches:
            if not t.num_rows:
                continue
            path = t.column("path").to_numpy(zero_copy_only=False)
            value, fp, own, node, cls = (t.column(c).to_numpy(zero_copy_only=False) for c in ("value", "fp", "own", "node", "cls"))
            n = t.column("n").to_numpy(zero_copy_only=False) if sized else np.zeros(len(fp), np.int64)
            bits = sketch.matrix(t.column("sketch").to_pylist()) if sized else np.zeros((len(fp), 1), np.uint64)
            cut = [0, *(np.flatnonzero((value[1:] != value[:-1]) | (path[1:] != path[:-1])) + 1).tolist(), len(path)]
            found: list = []
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                key = (path[lo], value[lo])
                if key != last:
                    if held:
                        close(found)
                    held, last = [], key
                held.append([fp[lo:hi].view(np.uint64), own[lo:hi], node[lo:hi], cls[lo:hi], n[lo:hi], bits[lo:hi]])
            yield _edges(found)
        if held:
            found = []
            close(found)
            yield _edges(found)

    return rows.mapInArrow(run, "a long, b long, path string, value long")


def _edges(found: list) -> pa.RecordBatch:
    a = np.concatenate([np.zeros(0, np.int64), *(x[0] for x in found)])
    b = np.concatenate([np.zeros(0, np.int64), *(x[1] for x in found)])
    more = [x[2] for x in found if x[2] is not None]
    none = [None] * len(a)
    cols = [pa.array([*a.tolist(), *[None] * len(more)], pa.int64()), pa.array([*b.tolist(), *[None] * len(more)], pa.int64())]
    cols += [pa.array([*none, *(k[0] for k in more)], pa.string()), pa.array([*none, *(int(k[1]) for k in more)], pa.int64())]
    return pa.RecordBatch.from_arrays(cols, names=["a", "b", "path", "value"])


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _divide(rows: DataFrame, plan, distance: int) -> DataFrame:
    """Large buckets anew by parts of the bits that their path has not fixed: within the distance, one of distance + 1 parts is equal."""

    def run(batches):
        for b in batches:
            path = b.column("path").to_pylist()
            value = b.column("value").to_numpy(zero_copy_only=False)
            fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for one in sorted(set(path)):
                at = np.array([i for i, x in enumerate(path) if x == one])
                own, node = b.column("own").take(pa.array(at)), b.column("node").take(pa.array(at))
                for i, bits in enumerate(np.array_split(free_bits(plan.value.parts, one, distance), distance + 1)):
                    key = pa.array([f"{one}.{i}"] * len(at), pa.string())
                    v = values(fp[at], bits) * 1_000_003 ^ value[at] * 7_368_787  # a clash only joins two buckets
                    yield pa.RecordBatch.from_arrays([key, pa.array(v), _signed(fp[at]), own, node], names=NAMES)

    return rows.mapInArrow(run, BUCKETS)


def free_bits(parts: list[np.ndarray], path: str, distance: int) -> np.ndarray:
    """Bits that the path leaves open. A flipped probe differs in one bit of the first part, so only later parts are fixed exactly."""
    first, *then = map(int, path.split("."))
    free = np.array(sorted(set(range(64)) - set(parts[first].tolist())))
    for i in then:
        own = np.array_split(free, distance + 1)[i]
        free = np.array(sorted(set(free.tolist()) - set(own.tolist())))
    return free


def groups(fps: DataFrame, ws: Workspace, distance: int = 2) -> DataFrame:
    """Distinct fingerprints (column fp) -> (fp, root) for those that link to another; root names the component."""
    found = components(links(fps, ws, distance), ws)
    return found.select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, ws: Workspace, width: int = 3, distance: int = 2, repeats: bool = True) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (columns doc_id, text); doc_id can be of any ordered type."""
    rows = ws.write(fingerprints(docs.select("doc_id", "text"), width, repeats).select("doc_id", F.col("_fp").alias("fp")), "fingerprints")
    least = ws.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = ws.write(groups(least.select("fp"), ws, distance), "groups")
    named = least.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = ws.write(named.join(lowest, "root").select("fp", "component_id"), "named")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def hex64(fp: str):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id for every row.

    Null and wordless texts have fingerprint zero and link like any other. Null doc_id: its row joins its component but
    never names it; a component of null ids only has a null component_id. Repeated rows stay. Empty table: no rows.
    """
    ws = Workspace(spark, "simhash")
    out = near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), ws)
    return ws.finish(out.select("doc_id", hex64("fp").alias("fingerprint"), "component_id"))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of the whole text, sorted; fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    few = [b" ".join(words)] if len(words) <= width else {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}
    return np.unique(np.array([xxhash.xxh64_intdigest(x, 7) for x in few], np.uint64))


def described(docs: DataFrame) -> DataFrame:
    """(id, text) -> (id, fp, sig, n, sketch): the fingerprint of the set of words, and digest, size and parity sketch of the set of five-word shingles."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            known: dict = {}
            for t in b.column("text").to_pylist():
                if t not in known:
                    s = shingles(t)
                    known[t] = fingerprint(t, 1, False), xxhash.xxh128_digest(s.tobytes()), len(s), sketch.parity(s, SKETCH)
            got = [known[t] for t in b.column("text").to_pylist()]
            fp = pa.array(np.array([g[0] for g in got], np.uint64).view(np.int64))
            rest = [pa.array([g[i] for g in got], k) for i, k in ((1, pa.binary()), (2, pa.int64()), (3, pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), fp, *rest], names=["id", "fp", "sig", "n", "sketch"])

    return docs.select("id", "text").mapInArrow(run, f"id {kind}, fp long, sig binary, n long, sketch binary")


def within_reach(pairs: DataFrame, sizes: DataFrame, least: Fraction) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes and parity sketches (node, n, sketch) leave room for a similarity of ``least``."""

    def run(batches):
        for t in batches:
            n, m = (t.column(c).to_numpy(zero_copy_only=False) for c in ("n", "m"))
            bits = sketch.apart(sketch.matrix(t.column("x").to_pylist()), sketch.matrix(t.column("y").to_pylist()))
            ok = bits <= sketch.may_differ(n, m, least.numerator, least.denominator)
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    first = sizes.select(F.col("node").alias("a"), "n", F.col("sketch").alias("x"))
    second = sizes.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("y"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, ws: Workspace, least: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts (node, text) have a five-word shingle similarity of ``least`` or more."""

    def sets(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([shingles(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], names=["node", "set"])

    def compare(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(both >= least * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = ws.write(among(texts, nodes, "node").join(nodes, "node", "left_semi").select("node", "text").mapInArrow(sets, "node long, set binary"), "sets")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return ws.write(both.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "verified")


def same_texts(docs: DataFrame, ws: Workspace, distance: int = 7, least: float = 0.8) -> DataFrame:
    """(id, text), id long and distinct -> (id, root): rows of a group, joined by five-word shingle similarity of ``least`` or more, share their root.

    Texts with equal shingle sets are one node. Candidates are the nodes whose word-set fingerprints lie within ``distance`` and
    whose sizes and parity sketches leave room for the similarity. The first round goes without sketches and gives the pairs of
    all buckets that have few, sketched afterwards; only the buckets it holds back take sketches along.
    """
    told = ws.write(described(docs), "described")
    nodes = ws.write(told.groupBy("fp", "sig").agg(F.min("id").alias("node"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "nodes")
    rows = ws.write(told.select("id", "fp", "sig"), "rows")
    ws.drop(told)
    texts, size = docs.select(F.col("id").alias("node"), "text"), nodes.select("node", "n", "sketch")
    tables, tasks, bound = buckets(nodes, ws, distance, 5, prune=False), parallelism(ws.spark), Fraction(least).limit_denominator(1000)
    groups_, step = None, 0
    while True:
        def emit(path, value, fp, own, node, cls, n, bits, step=step):
            a, b, more = pairs_of(fp, own, cls, distance, step, n, bits, bound)
            return node[a], node[b], more

        found = ws.write(_union([_within(t, emit, tasks) for t in tables]), "candidates")
        pairs = found.where("path is null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs = pairs if step else within_reach(pairs, size, bound)
        groups_ = ws.write(merged(groups_, verified(ws.write(pairs, "pairs"), texts, ws, least), ws), "groups")
        more = found.where("path is not null").select("path", "value")
        if not more.limit(1).count():
            break
        held = _union([t.drop("cls").join(more, ["path", "value"], "left_semi") for t in tables])
        held = held.join(groups_.select("node", F.col("root").alias("cls")), "node", "left").withColumn("cls", F.coalesce("cls", "node"))
        tables = [ws.write(held if step else held.join(size, "node"), "held")]
        step = step * 16 or 2
    named = nodes.join(groups_, "node", "left").select("fp", "sig", F.coalesce("root", "node").alias("root"))
    return rows.join(named, ["fp", "sig"]).select("id", "root")


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str, distance: int = 7, least: float = 0.8) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the row of the smallest doc_id stays, a null id last, of equal ids the first.

    Texts are near-duplicates at a five-word shingle similarity of 0.8 or more, verified on the texts. Candidates come from
    fingerprints of the set of words within 7 bits: on sf0.1, 45 of the 48 pairs of different texts that reach 0.8 do. Null
    and wordless texts are one group. Columns of any name pass through.
    """
    ws = stage_workspace(spark, "simhash", docs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("id"))
    rows = ws.write(packed, "documents")
    root = ws.write(same_texts(rows.select("id", F.col("doc.text").alias("text")), ws, distance, least), "roots")
    name = F.struct(F.col("doc.doc_id").isNull().alias("n"), F.col("doc.doc_id").alias("d"), "id")
    named = rows.select("id", name.alias("name")).join(root, "id")
    keep = named.groupBy("root").agg(F.min("name").alias("name")).select(F.col("name.id").alias("id"))
    return rows.join(keep, "id", "left_semi").select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
