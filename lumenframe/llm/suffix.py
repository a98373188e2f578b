"""Repeated passages by a common-prefix-aware distributed merge sort of suffixes.

A byte is repeated when a string of ``length`` bytes that covers it also starts somewhere else. Sorting every suffix would
move the corpus ``length`` times over, so each start s is represented by its anchor: the leftmost least hash of the
8-byte strings at s .. s + span - 1. Equal strings have the same anchor at the same distance, hence two starts are equal
exactly if the suffixes at their anchors agree on ``length - d`` bytes and the texts before them on d bytes, d being that
distance. One suffix, with what stands before it, then decides all starts of its anchor.

1. Duplicate detection by hashes of the ``core``, the bytes that any match must share: a suffix whose core occurs once
   cannot repeat and is not exchanged. This finds the prefix that tells suffixes apart without moving them.
2. Every chunk of the corpus sorts its remaining distinct suffixes, and sends each range of the order as a front-coded run.
3. Every range merges its runs with a loser tree whose players carry the length of the prefix they share with the last
   winner: known prefixes are never compared again, and the merge yields the longest-common-prefix array for nothing.
4. From the array, and that of the reversed texts before the anchors, the classes of equal strings follow for each
   distance; the marked starts go back to their chunk, which cuts the covered bytes.

Suffixes that agree entirely are exchanged once for each chunk, however often they occur there. A core that more than ``HOT``
suffixes share, that of a passage in very many documents, would still meet in one range. Its starts are told apart by
128-bit digests of their strings instead, counted with partial sums before the exchange.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import Workspace, arrow_rows, parallelism, stage_workspace

SPAN = 200
GRAM = 8
CHUNK_BYTES = 4 << 20
SEGMENT = 1 << 20
#: Suffixes with one core above which their starts are compared by digests.
HOT = 20_000
#: Suffixes that a range of the order holds, about.
RANGE_ROWS = 100_000
SPACES = np.frombuffer(b" \t\n\v\f\r", np.uint8)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def span_of(length: int) -> int:
    """Positions among which a start has its anchor."""
    return min(SPAN, length // 2)


class Units:
    """The anchors of some texts that stand one after another in ``data``; ``ends`` closes each text.

    For unit i, x[i] is the anchor and lo[i] .. hi[i] are the distances of its starts.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, length: int):
        self.data, self.length, n = data, length, len(data)
        span = span_of(length)
        self.core = length - span + 1
        self.x = self.lo = self.hi = np.zeros(0, np.int64)
        self.hash = np.zeros(0, np.uint64)
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
        ok = ends - starts >= length
        if not ok.any():
            return
        step = np.zeros(n + 1, np.int8)
        np.add.at(step, starts[ok], 1)
        np.add.at(step, ends[ok] - length + 1, -1)
        valid = np.cumsum(step[:n], dtype=np.int8)
        found = [f for a in range(0, n - length + 1, SEGMENT) if (f := self._segment(a, valid[a : a + SEGMENT], span))]
        self.x, self.lo, self.hi, self.hash = (np.concatenate(c) for c in zip(*found, strict=True))

    def _segment(self, at: int, valid: np.ndarray, span: int):
        """The anchors of the starts from ``at`` on. A unit that lies across two segments becomes two, each with its own starts."""
        s = np.flatnonzero(valid)
        if not len(s):
            return None
        data = self.data[at : at + len(valid) + self.length + GRAM]
        v = np.lib.stride_tricks.as_strided(data, (len(data) - GRAM + 1, GRAM), (1, 1)).copy().view("<u8").ravel()
        v = ((v * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) << np.uint64(32)
        v |= np.arange(len(v), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            v = np.minimum(v[:-width], v[width:])
            width *= 2
        v = np.minimum(v[: len(v) - (span - width)], v[span - width :])
        p = (v[s] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero((p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]]) - 1
        x = p[first]
        power = np.full(len(data), BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
        power.fill(INVERSE)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        h = (total[x + self.core] - total[x]) * power[x]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return x + at, x - s[last], x - s[first], h ^ (h >> np.uint64(32))

    def contexts(self, which: np.ndarray):
        """Yields (suffix, reversed text before it) of the chosen units, as far as their starts reach."""
        raw, length = memoryview(self.data), self.length
        for part in range(0, len(which), 1 << 14):
            w = which[part : part + (1 << 14)]
            for a, b, c in zip(self.x[w].tolist(), self.lo[w].tolist(), self.hi[w].tolist(), strict=True):
                yield bytes(raw[a : a + length - b]), bytes(raw[a - c : a])[::-1]

    def digests(self, which: np.ndarray):
        """Yields (start, 128-bit digest of the string there) for every start of the chosen units."""
        raw, length = memoryview(self.data), self.length
        for i in which.tolist():
            x = int(self.x[i])
            for start in range(x - int(self.hi[i]), x - int(self.lo[i]) + 1):
                yield start, xxhash.xxh3_128_digest(raw[start : start + length])


def common(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of a and b, known to be at least ``start``."""
    n = min(len(a), len(b))
    x = a[start:n]
    y = b[start:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def encode(run: list[tuple[bytes, bytes, int, bool]]) -> bytes:
    """Front-code a sorted run of (suffix, before, unit, repeated): each suffix without what it shares with the one ahead."""
    shared, last = [], b""
    for r, *_ in run:
        shared.append(common(last, r))
        last = r
    rest = b"".join(r[k:] for (r, *_), k in zip(run, shared, strict=True))
    before = b"".join(x[1] for x in run)
    heads = np.array([[k, len(r), len(b)] for k, (r, b, *_) in zip(shared, run, strict=True)], "<u2").tobytes()
    units = np.array([x[2] for x in run], "<u4").tobytes()
    flags = np.array([x[3] for x in run], np.uint8).tobytes()
    return struct.pack("<II", len(run), len(rest)) + heads + units + flags + rest + before


def decode(blob: bytes):
    """Yields (suffix, shared with the one ahead, before, unit, repeated) of a front-coded run."""
    n, size = struct.unpack_from("<II", blob)
    at = 8
    heads = np.frombuffer(blob, "<u2", 3 * n, at).reshape(n, 3).tolist()
    units = np.frombuffer(blob, "<u4", n, at + 6 * n).tolist()
    flags = np.frombuffer(blob, np.uint8, n, at + 10 * n).tolist()
    at += 11 * n
    left, last = at + size, b""
    for (k, r, b), u, f in zip(heads, units, flags, strict=True):
        last = last[:k] + blob[at : at + r - k]
        at += r - k
        yield last, k, blob[left : left + b], u, f
        left += b


def merge(runs: list):
    """Merge sorted runs of (suffix, shared, ...) with a loser tree; yields (shared with the last output, run number, item).

    A node keeps the loser of its match and the prefix it shares with the winner that passed. Of two players, that with the
    longer shared prefix is less; only at a tie are bytes compared, from the end of the known prefix on.
    """
    iters = [iter(r) for r in runs]
    size = 1
    while size < max(1, len(iters)):
        size *= 2
    items = [next(i, None) for i in iters] + [None] * (size - len(iters))
    who, known = [0] * size, [0] * size

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            i = node - size
            return i, 0 if items[i] is not None else -1
        a, ha = build(2 * node)
        b, hb = build(2 * node + 1)
        if ha != hb:
            win, lose = ((a, ha), (b, hb)) if ha > hb else ((b, hb), (a, ha))
        elif ha < 0:
            win, lose = (a, ha), (b, hb)
        else:
            x, y = items[a][0], items[b][0]
            k = common(x, y, ha)
            first = len(x) == k or (len(y) > k and x[k] < y[k])
            win, lose = ((a, ha), (b, k)) if first else ((b, hb), (a, k))
        who[node], known[node] = lose
        return win

    run, h = build(1)
    while h >= 0:
        item = items[run]
        yield h, run, item
        items[run] = now = next(iters[run], None)
        h = -1 if now is None else now[1]
        node = (run + size) >> 1
        while node:
            k = known[node]
            if k > h:
                other = who[node]
                who[node], known[node] = run, h
                run, h = other, k
            elif k == h and h >= 0:
                other = who[node]
                x, y = items[run][0], items[other][0]
                c = common(x, y, h)
                if len(x) == c or (len(y) > c and x[c] < y[c]):
                    known[node] = c
                else:
                    who[node], known[node] = run, c
                    run = other
            node >>= 1


def classes(merged, length: int) -> dict[int, list[tuple[int, bytes | None]]]:
    """Run number -> (unit, mask) of the units with a repeated start; the mask's bits are distances, None is all of them."""
    span = span_of(length)
    core = length - span + 1
    lcp, run, unit, right, left, many = [], [], [], [], [], []
    for h, r, (s, _, before, u, f) in merged:
        lcp.append(h)
        run.append(r)
        unit.append(u)
        right.append(len(s))
        left.append(before)
        many.append(f)
    out: dict[int, list[tuple[int, bytes | None]]] = {}
    if not lcp:
        return out
    h, r_len = np.array(lcp), np.array(right)
    seg = np.cumsum(h < core)
    alone = np.bincount(seg)[seg] == 1
    rows = np.flatnonzero(~alone | (np.array(many) > 0)).tolist()
    # equal (suffix, before) pairs are one member of the classes
    full = np.cumsum((h < r_len) | np.concatenate([[True], r_len[:-1] != r_len[1:]])).tolist()
    member: dict[tuple[int, bytes], int] = {}
    of, count, top = [], [], []
    for i in rows:
        g = member.setdefault((full[i], left[i]), len(member))
        if g == len(count):
            count.append(0)
            top.append(i)
        count[g] += 2 if many[i] else 1
        of.append(g)
    if not top:
        return out
    whole = np.array(count) > 1
    gseg = seg[top]
    open_segment = np.zeros(seg[-1] + 1, bool)
    open_segment[gseg[~whole]] = True
    live = np.flatnonzero(open_segment[gseg])
    mask = np.zeros((len(top), SPAN), bool)
    if len(live):
        rows_of = np.array(top)[live]
        # prefix shared by neighbours in the merge order is the least on the way between them
        share = np.array([0, *(h[a + 1 : b + 1].min() if b > a else 0 for a, b in zip(rows_of[:-1].tolist(), rows_of[1:].tolist(), strict=True))])
        low, texts = length - r_len[rows_of], [left[i] for i in rows_of.tolist()]
        high = np.array([len(t) for t in texts])
        order = np.array(sorted(range(len(texts)), key=texts.__getitem__))
        near = np.array([0, *(common(texts[a], texts[b]) for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True))])
        for d in range(span):
            on = np.flatnonzero((low <= d) & (d <= high))
            if len(on) < 2:
                continue
            by_left = np.empty(len(texts), np.int64)
            by_left[order] = np.cumsum(near < d)
            key = np.cumsum(share < length - d)[on] * (len(texts) + 1) + by_left[on]
            at = np.argsort(key, kind="stable")
            same = key[at][1:] == key[at][:-1]
            hit = np.zeros(len(on), bool)
            hit[at[1:][same]] = True
            hit[at[:-1][same]] = True
            mask[live[on[hit]], d] = True
    packed = np.packbits(mask, axis=1)
    some = mask.any(1)
    for i, g in zip(rows, of, strict=True):
        if whole[g]:
            out.setdefault(run[i], []).append((unit[i], None))
        elif some[g]:
            out.setdefault(run[i], []).append((unit[i], packed[g].tobytes()))
    return out


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    raw = [b or b"" for b in table.column("body").to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(b) for b in raw], dtype=np.int64)


def _units(table: pa.Table, length: int) -> Units:
    data, ends = _texts(table)
    return Units(data, ends, length)


def repeated(docs: DataFrame, ws: Workspace, length: int = 400) -> tuple[DataFrame, DataFrame]:
    """Chunks of the corpus (chunk, rid, body and the columns of ``docs``) and the marks (chunk, marks) of their repeated starts."""
    if length < 8 * GRAM:
        raise ValueError(f"length must be at least {8 * GRAM}")
    spark = ws.spark
    arrow_rows(spark)
    kept = [c for c in docs.columns if c != "text"]
    named = docs.withColumns({"rid": F.monotonically_increasing_id(), "body": F.coalesce(F.col("text"), F.lit("")).cast("binary")}).select("rid", "body", *kept)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields)

    def deal(batches):
        from pyspark import TaskContext

        part, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            before = size + np.concatenate([[0], np.cumsum([len(x) for x in b.column("body").to_pylist()], dtype=np.int64)])
            size = int(before[-1])
            chunk = pa.array(part + before[:-1] // CHUNK_BYTES, pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, chunk], names=[*b.schema.names, "chunk"])

    chunks = ws.write(named.mapInArrow(deal, f"{kinds}, chunk long"), "chunks")
    total = chunks.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    # one core in so many goes to the driver as a candidate splitter, about 20,000 of them whatever the size
    sampled = max(1, int(total // 100 // 20_000))

    def detect(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            chunk = b.column("chunk").to_numpy()
            data, ends = _texts(t)
            u = Units(data, ends, length)
            owner = chunk[np.searchsorted(ends, u.x, side="right")] if len(u.x) else chunk[:0]
            raw = memoryview(data)
            for c in np.unique(owner):
                own = np.flatnonzero(owner == c)
                h, first, n = np.unique(u.hash[own], return_index=True, return_counts=True)
                some = h % np.uint64(sampled) == 0
                x = u.x[own[first]]
                cores = [bytes(raw[x[i] : x[i] + u.core]) if some[i] else None for i in range(len(h))] if some.any() else [None] * len(h)
                cols = [pa.array(h.view(np.int64)), pa.array(np.full(len(h), c)), pa.array(n.astype(np.int32)), pa.array(cores, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["hash", "chunk", "n", "core"])

    hashes = ws.write(chunks.select("body", "chunk").mapInArrow(detect, "hash long, chunk long, n int, core binary"), "hashes")
    twice = hashes.groupBy("hash").agg(F.sum("n").alias("n"), F.max("core").alias("core")).where("n > 1")
    twice = ws.write(twice.select("hash", "n", "core", (F.col("n") > HOT).alias("hot")), "twice")
    cores = sorted(bytes(r[0]) for r in twice.where("core is not null and not hot").select("core").collect())
    shared = twice.where("not hot").agg(F.sum("n")).first()[0] or 0
    ranges = min(len(cores), max(2 * parallelism(spark), shared // RANGE_ROWS))
    splits = sorted({cores[len(cores) * i // ranges] for i in range(1, ranges)})
    pairs = hashes.select("hash", "chunk").join(twice.select("hash", "hot"), "hash")

    def runs(key, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("run", pa.binary())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        u = _units(left.sort_by("rid"), length)
        hash_, hot = right.column("hash").to_numpy().view(np.uint64), right.column("hot").to_numpy()
        which = np.flatnonzero(np.isin(u.hash, hash_[~hot]))
        seen: dict[tuple[bytes, bytes], list] = {}
        for c, i in zip(u.contexts(which), which.tolist(), strict=True):
            had = seen.get(c)
            if had is None:
                seen[c] = [i, False]
            else:
                had[1] = True
        parts: dict[int, list] = {}
        for (r, b), (i, many) in sorted(seen.items()):
            parts.setdefault(bisect_right(splits, r[: u.core]), []).append((r, b, i, many))
        blobs = {k: encode(x) for k, x in parts.items()}
        if hot.any():
            counts = Counter(d for _, d in u.digests(np.flatnonzero(np.isin(u.hash, hash_[hot]))))
            blobs[-1] = b"".join(d + (b"2" if n > 1 else b"1") for d, n in counts.items())
        return pa.table([pa.array(list(blobs), pa.int32()), pa.array([key[0].as_py()] * len(blobs), pa.int64()), pa.array(list(blobs.values()), pa.binary())], schema=schema)

    sent = chunks.select("chunk", "rid", "body").groupBy("chunk").cogroup(pairs.groupBy("chunk")).applyInArrow(runs, "part int, chunk long, run binary")
    sent = ws.write(sent, "runs")

    def match(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk").to_pylist()
        found = classes(merge([decode(b) for b in table.column("run").to_pylist()]), length)
        who, blobs = [], []
        for i, marks in found.items():
            who.append(chunk[i])
            some = [m for _, m in marks if m is not None]
            head = struct.pack("<II", len(marks), len(some))
            blobs.append(head + np.array([u for u, _ in marks], "<u4").tobytes() + bytes(m is None for _, m in marks) + b"".join(some))
        return pa.table([pa.array(who, pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "marks"])

    def spelled(batches):
        for b in batches:
            for chunk, run in zip(b.column("chunk").to_pylist(), b.column("run").to_pylist(), strict=True):
                for lo in range(0, len(run), 17 * 50_000):
                    some = [run[i : i + 17] for i in range(lo, min(len(run), lo + 17 * 50_000), 17)]
                    cols = [pa.array([x[:16] for x in some], pa.binary()), pa.array([chunk] * len(some), pa.int64()), pa.array([x[16] - 48 for x in some], pa.int32())]
                    yield pa.RecordBatch.from_arrays(cols, names=["digest", "chunk", "n"])

    marks = sent.where("part >= 0").groupBy("part").applyInArrow(match, "chunk long, marks binary")
    hot = twice.where("hot").select("hash")
    if hot.limit(1).count():
        spelt = ws.write(sent.where("part < 0").select("chunk", "run").mapInArrow(spelled, "digest binary, chunk long, n int"), "digests")
        again = spelt.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest")
        told = spelt.join(again, "digest").groupBy("chunk").agg(F.collect_list("digest").alias("d"))
        own = hashes.select("hash", "chunk").join(hot, "hash").groupBy("chunk").agg(F.collect_list("hash").alias("h"))
        marks = marks.unionByName(told.join(own, "chunk").mapInArrow(_keys, "chunk long, marks binary"))
    marks = ws.write(marks, "marks")
    ws.drop(sent, hashes, twice)
    return chunks, marks


def _keys(batches):
    """Marks of hot cores: their hashes and the digests of their repeated starts, behind a count that no other blob has."""
    for b in batches:
        blobs = [struct.pack("<II", 0, len(h)) + np.array(h, np.int64).tobytes() + b"".join(d) for h, d in zip(b.column("h").to_pylist(), b.column("d").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("chunk"), pa.array(blobs, pa.binary())], names=["chunk", "marks"])


def covered(table: pa.Table, marks: list[bytes], length: int, least_words: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, ends, mask of the repeated bytes) of a chunk in the order of ``rid``.

    With ``least_words``, only runs of repeated starts count that hold so many whole words.
    """
    u = _units(table, length)
    data, ends = u.data, _texts(table)[1]
    start = np.zeros(len(data) + 1, np.int32)
    masks: dict[int, bytes | None] = {}
    for blob in marks:
        n, other = struct.unpack_from("<II", blob)
        if not n:
            hashes = np.frombuffer(blob, np.int64, other, 8).view(np.uint64)
            at = 8 + 8 * other
            digests = {blob[i : i + 16] for i in range(at, len(blob), 16)}
            for s, d in u.digests(np.flatnonzero(np.isin(u.hash, hashes))):
                if d in digests:
                    start[s] += 1
                    start[s + 1] -= 1
            continue
        units = np.frombuffer(blob, "<u4", n, 8).tolist()
        at = 8 + 5 * n
        for x, whole in zip(units, blob[8 + 4 * n : at], strict=True):
            masks[x] = None if whole else blob[at : (at := at + SPAN // 8)]
    if masks:
        chosen = np.array(sorted(masks))
        known = dict(zip(u.contexts(chosen), (masks[i] for i in chosen.tolist()), strict=True))
        which = np.flatnonzero(np.isin(u.hash, u.hash[chosen]))
        for c, i in zip(u.contexts(which), which.tolist(), strict=True):
            if c not in known:
                continue
            m, x, lo, hi = known[c], int(u.x[i]), int(u.lo[i]), int(u.hi[i])
            if m is None:
                start[x - hi] += 1
                start[x - lo + 1] -= 1
            else:
                for d in np.flatnonzero(np.unpackbits(np.frombuffer(m, np.uint8))[: hi + 1]).tolist():
                    start[x - d] += 1
                    start[x - d + 1] -= 1
    edge = np.diff(np.concatenate([[0], np.cumsum(start[:-1]) > 0, [0]]).astype(np.int8))
    first, last = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0) + length - 1
    if least_words and len(first):
        long = words_inside(data, ends, first, last) >= least_words
        first, last = first[long], last[long]
    step = np.zeros(len(data) + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    return data, ends, np.cumsum(step[:-1]) > 0


def words_inside(data: np.ndarray, ends: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whole words in the bytes first[i] .. last[i] - 1."""
    letter = ~np.isin(data, SPACES)
    border = np.zeros(len(data) + 1, bool)
    border[ends] = border[0] = True
    ended = letter & (border[1:] | ~np.append(letter[1:], False))
    begun = letter & (border[:-1] | ~np.append(False, letter[:-1]))
    count = np.concatenate([[0], np.cumsum(ended)])
    return count[last] - count[first] - (letter[first] & ~begun[first])


def cut(chunks: DataFrame, marks: DataFrame, keep: list[str], with_text: bool, length: int = 400, least_words: int = 0) -> DataFrame:
    """A row for each document: the columns ``keep`` and n_bytes, n_removed, n_spans, kept_sha256, and the remaining text if asked for."""
    fields = {f.name: f.dataType.simpleString() for f in chunks.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in keep), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", *(["kept string"] if with_text else [])])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("rid")
        data, ends, gone = covered(left, right.column("marks").to_pylist(), length, least_words)
        out: list[list] = [[] for _ in range(4 + with_text)]
        begin = 0
        for end in ends.tolist():
            own, body = gone[begin:end], data[begin:end]
            kept = body[~own].tobytes() if own.any() else body.tobytes()
            out[0].append(end - begin)
            out[1].append(end - begin - len(kept))
            out[2].append(int(own[:1].sum() + np.count_nonzero(own[1:] & ~own[:-1])))
            out[3].append(hashlib.sha256(kept).hexdigest())
            if with_text:
                out[4].append(kept.decode("utf-8", "ignore"))
            begin = end
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        cols = [*(left.column(c) for c in keep), *(pa.array(x, k) for x, k in zip(out, kinds, strict=False))]
        return pa.table(cols, names=[*keep, *names[: len(out)]])

    chosen = chunks.select("chunk", "rid", "body", *[c for c in keep if c not in ("chunk", "rid", "body")])
    return chosen.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(run, schema)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Null text is empty. Rows that repeat, whatever their ids, repeat each other's passages. Null doc_ids stay. Texts under
    400 bytes keep all. Empty table: no rows.
    """
    ws = Workspace(spark, "suffix")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    chunks, marks = repeated(docs, ws)
    return ws.finish(cut(chunks, marks, ["doc_id"], False))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str, least_words: int = 51) -> DataFrame:
    """Pipeline stage: every document without its passages of over fifty words that start anywhere else too.

    Such a passage has at least 101 bytes, so repeated strings of 101 bytes find them all; runs of their starts that hold
    fewer words stay. A character cut in two goes, and n_chars follows. A document of which nothing is left stays, empty;
    a null text becomes empty. Rows that repeat cut each other. Columns of any name pass through.
    """
    ws = stage_workspace(spark, "suffix", docs)
    length = max(8 * GRAM, 2 * least_words - 1)
    inner = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    chunks, marks = repeated(inner, ws, length)
    out = cut(chunks, marks, ["row"], True, length, least_words)
    text = F.col("kept")
    return out.select(*[text.alias("text") if c == "text" else F.length(text).cast("long").alias(c) if c == "n_chars" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
