"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The examples are a bounded, documented sample of the labelled rows outside the held-out fold. Every word of theirs and every
word beginning of 4 or 5 letters is a term; none is left out. A term weighs log frequency times inverse document frequency,
times ``relevance``, the root of one plus its log-likelihood ratio against the label: at least 1 for every term, so the
cosine stays one over the whole vocabulary, in which terms that tell the labels apart count for more.

Examples stand in blocks; for every term the index keeps its postings by block and the block's greatest weight. A query
ranks the blocks by the sum of those maxima, an upper bound of every cosine inside, and scores blocks until the next bound
falls under its kth cosine: the neighbours are exact. Their votes count by inverse distance, and a monotone curve fitted on
leave-one-out votes makes them scores.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import arrow_rows, fold, held_out, spread

LETTERS = re.compile(r"[^\W\d_]+")
BLOCK = 32
#: Queries that go through one product.
TOGETHER = 256
#: Terms that one example in so many holds are common.
COMMON = 32
#: Lengths of the word beginnings that are terms too; families of one stem then count together.
HEADS = (4, 5)


def names_of(word: str) -> list[str]:
    """The terms of a word: itself and, marked with a tilde, its beginnings."""
    return [word, *(word[:n] + "~" for n in HEADS if len(word) > n)]


def terms(words: dict[str, int]) -> dict[str, int]:
    out: Counter = Counter()
    for w, c in words.items():
        for t in names_of(w):
            out[t] += c
    return out


def _g2(a: np.ndarray, df: np.ndarray, pos: int, n: int) -> np.ndarray:
    """Log-likelihood ratio of term presence against the label: a of df holders are positive, pos of n in all."""
    out = np.zeros(len(df))
    for o, row, col in ((a, df, pos), (df - a, df, n - pos), (pos - a, n - df, pos), (n - pos - df + a, n - df, n - pos)):
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(o > 0, 2 * o * np.log(o * n / (row * col)), 0.0)
    return np.maximum(out, 0)


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start .. end - 1, one range after another."""
    n = end - start
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Words(dict):
    """Numbers of the words met so far, each with the terms of an index that it holds: ``held[at[n]] .. held[at[n + 1] - 1]`` for word n."""

    def __init__(self, index: Index):
        super().__init__()
        self.terms, self.heads, self.at, self.held = index.terms, index.heads, array("q", [0]), array("q")

    def __missing__(self, word: str) -> int:
        i = self.terms.get(word)
        if i is not None:
            self.held.append(i)
        for size, ids in self.heads:
            if len(word) > size:
                i = ids.get(word[:size])
                if i is not None:
                    self.held.append(i)
        self.at.append(len(self.held))
        self[word] = n = len(self)
        return n


class Index:
    """Block-max inverted index of unit TF-IDF vectors of examples (id, label, word counts)."""

    def __init__(self, examples: list[tuple[int, int, dict[str, int]]], k: int = 15, relevance: bool = True, shares: tuple[float, float] = (1.0, 1.0)):
        self.k, n = k, len(examples)
        labels = np.array([e[1] for e in examples], np.int64)
        bags = [terms(words) for _, _, words in examples]
        self.terms = {t: i for i, t in enumerate(sorted(set().union(*bags)))}
        self.heads = [(size, {t[:-1]: i for t, i in self.terms.items() if len(t) == size + 1 and t[-1] == "~"}) for size in HEADS]
        df, pos = np.zeros(len(self.terms)), np.zeros(len(self.terms))
        where = [np.array([self.terms[t] for t in bag], np.int64) for bag in bags]
        for t, y in zip(where, labels.tolist(), strict=True):
            df[t] += 1
            pos[t] += y
        self.weight = np.log(1 + n / np.maximum(df, 1))
        if relevance:
            self.weight = self.weight * np.sqrt(1 + _g2(pos, df, int(labels.sum()), n))
        vectors = [self._unit(t, np.array(list(bag.values()), float)) for t, bag in zip(where, bags, strict=True)]
        # examples of one label and heaviest term side by side, so that block maxima are tight
        lead = [int(t[np.argmax(w)]) if len(t) else -1 for t, w in vectors]
        order = sorted(range(n), key=lambda i: (labels[i], lead[i], examples[i][0]))
        self.ids = np.array([examples[i][0] for i in order], np.int64)
        self.labels = labels[order]
        self.blocks = max(1, -(-n // BLOCK))
        vectors = [vectors[i] for i in order]
        term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in vectors)])
        place = np.repeat(np.arange(n), [len(t) for t, _ in vectors])
        weight = np.concatenate([np.zeros(0), *(w for _, w in vectors)]).astype(np.float32)
        # common terms: columns of a matrix, one product for many queries
        often = np.flatnonzero(df >= max(8, n / COMMON))
        self.column = np.full(len(self.terms), -1)
        self.column[often] = np.arange(len(often))
        common = self.column[term] >= 0
        self.dense = np.zeros((self.blocks * BLOCK, len(often)), np.float32)
        self.dense[place[common], self.column[term[common]]] = weight[common]
        term, place, weight = term[~common], place[~common], weight[~common]
        at = np.lexsort((place, term))
        term, self.place, self.value = term[at], place[at].astype(np.int32), weight[at]
        # entry e: the postings first[e] .. first[e + 1] - 1 of a term in block[e], the greatest of weight top[e]
        key = term * self.blocks + self.place // BLOCK
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        self.first = np.concatenate([starts, [len(key)]])
        self.block = (self.place[starts] // BLOCK).astype(np.int32)
        self.top = np.maximum.reduceat(self.value, starts) if len(starts) else np.zeros(0, np.float32)
        self.entry = np.searchsorted(term[starts], np.arange(len(self.terms) + 1))
        self._calibrate(vectors, shares)

    def _unit(self, t: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.weight[t]
        size = math.sqrt(float(w @ w))
        return t, w / size if size else w

    def vectors(self, bags: list[dict[str, int]], known: Words | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each bag of words the terms of the index that it holds, rising, and their unit weights. ``known`` remembers the terms of a word."""
        out, known = [], Words(self) if known is None else known
        for lo in range(0, len(bags), TOGETHER):
            some = bags[lo : lo + TOGETHER]
            words = np.fromiter(map(known.__getitem__, chain.from_iterable(some)), np.int64)
            counts = np.fromiter(chain.from_iterable(b.values() for b in some), np.int64)
            at, held = np.array(known.at), np.array(known.held)
            n = at[words + 1] - at[words]
            key = np.repeat(np.repeat(np.arange(len(some)), [len(b) for b in some]), n) * len(self.terms) + held[_ranges(at[words], at[words + 1])]
            order = np.argsort(key)
            key, counts = key[order], np.repeat(counts, n)[order]
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            key, counts = key[starts], np.add.reduceat(counts, starts) if len(starts) else counts
            bag, t = np.divmod(key, max(1, len(self.terms)))
            w = (1 + np.log(counts)) * self.weight[t]
            size = np.sqrt(np.bincount(bag, w * w, len(some)))[bag]
            w = np.divide(w, size, out=w, where=size > 0)
            ends = np.searchsorted(bag, np.arange(len(some) + 1))
            out.extend((t[i:j], w[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True))
        return out

    def vector(self, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        return self.vectors([words])[0]

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each vector the k greatest positive cosines as (cosine, place), ties to the smaller place; ``skip`` has a place to leave out for each."""
        out = []
        for lo in range(0, len(vectors), TOGETHER):
            some = vectors[lo : lo + TOGETHER]
            q = np.zeros((len(some), self.dense.shape[1]), np.float32)
            for row, (t, w) in zip(q, some, strict=True):
                c = self.column[t]
                row[c[c >= 0]] = w[c >= 0]
            for i, ((t, w), base) in enumerate(zip(some, q @ self.dense.T, strict=True)):
                out.append(self._walk(t, w, base, -1 if skip is None else skip[lo + i]))
        return out

    def _walk(self, t: np.ndarray, w: np.ndarray, base: np.ndarray, skip: int) -> list[tuple[float, int]]:
        """Blocks by falling bound, the first few and then those over the kth cosine.

        ``base`` has the cosines' part of the common terms in single precision, off by ``slack`` at most, which bounds and the
        choice of candidates allow for. Candidates get that part anew in double precision.
        """
        column = self.column[t]
        rare = column < 0
        slack = (np.count_nonzero(~rare) + 8) * 2.0**-24
        lo, hi = self.entry[t[rare]], self.entry[t[rare] + 1]
        entries, q = _ranges(lo, hi), np.repeat(w[rare], hi - lo)
        block = self.block.take(entries)
        bound = np.bincount(block, q * self.top.take(entries), self.blocks) + base.reshape(self.blocks, BLOCK).max(1)
        order = np.argsort(-bound, kind="stable")
        order = order[: np.count_nonzero(bound > 0)]
        scores, parts, places, kth, done = np.zeros(0), np.zeros(0), np.zeros(0, np.int64), -1.0, 0
        for last in (8, len(order)):
            now = order[done:last]
            now = now[bound[now] + 2 * slack >= kth]
            if not len(now):
                break
            turn = np.zeros(self.blocks, bool)
            turn[now] = True
            on = np.flatnonzero(turn.take(block))
            some = entries.take(on)
            a, b = self.first.take(some), self.first.take(some + 1)
            p = _ranges(a, b)
            part = np.bincount(self.place.take(p), np.repeat(q.take(on), b - a) * self.value.take(p), self.blocks * BLOCK)
            place = (now[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            got = base[place] + part[place]
            place = place[(got > max(0.0, kth - 2 * slack)) & (place != skip)]
            places, parts = np.concatenate([places, place]), np.concatenate([parts, part[place]])
            scores = base[places] + parts
            if len(scores) >= self.k:
                kth = np.partition(scores, -self.k)[-self.k]
                best = scores >= kth - 2 * slack
                places, parts = places[best], parts[best]
            done = last
        scores = self.dense[places][:, column[~rare]] @ w[~rare] + parts
        best = np.lexsort((places, -scores))[: self.k]
        return list(zip(scores[best].tolist(), places[best].tolist(), strict=True))

    def vote(self, found: list[tuple[float, int]]) -> float:
        weights = [1.0 / (0.05 + max(0.0, 1.0 - s)) for s, _ in found]
        return sum(x * self.labels[i] for x, (_, i) in zip(weights, found, strict=True)) / sum(weights)

    def _calibrate(self, vectors, shares: tuple[float, float]) -> None:
        """Pool adjacent violators over leave-one-out votes, weighted back to the labels' shares before sampling; a prior of one half of a row in each pool."""
        votes, silent = [], [0.0, 0.0]
        for i, found in enumerate(self.nearest(vectors, list(range(len(vectors))))):
            y = int(self.labels[i])
            weight = 1.0 / max(shares[y], 1e-12)
            if found:
                votes.append((self.vote(found), y * weight, weight))
            else:
                silent[y] += weight
        self.silent = (silent[1] + 0.5 * bool(sum(silent))) / (sum(silent) + 1) if sum(silent) else 0.0
        pools: list[list[float]] = []
        for v, y, weight in sorted(votes):
            pools.append([v, v, y, weight])
            while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
                last = pools.pop()
                pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        self.curve_x = [x for p in pools for x in (p[0], p[1])]
        self.curve_y = [y for p in pools for y in [(p[2] + 0.25) / (p[3] + 0.5)] * 2]

    def score(self, bags: list[dict[str, int]], known: Words | None = None) -> list[tuple[float, list[tuple[int, float, int]]]]:
        """(score, evidence) for each bag of words: evidence lists the nearest examples as (doc_id, cosine, label)."""
        out = []
        for found in self.nearest(self.vectors(bags, known)):
            p = float(np.interp(self.vote(found), self.curve_x, self.curve_y)) if found and self.curve_x else self.silent
            out.append((p, [(int(self.ids[i]), s, int(self.labels[i])) for s, i in found[:3]]))
        return out


def examples(docs: DataFrame, labels: DataFrame, most: int = 4096) -> tuple[list, tuple[float, float]]:
    """A sample of the labelled rows outside the held-out fold, in expected number ``most`` at most, half of it toxic where there are enough, and the shares kept of both classes.

    A hash of the id chooses. Rows of ``labels`` with equal ids count once, toxic if any is.
    """
    labels = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    counts = {r["y"]: r["count"] for r in labels.groupBy("y").count().collect()}
    toxic = min(counts.get(1, 0), most // 2)
    shares = (min(1.0, (most - toxic) / max(1, counts.get(0, 0))), min(1.0, toxic / max(1, counts.get(1, 0))))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    few = labels.where(chance < F.when(F.col("y") == 1, shares[1]).otherwise(shares[0]))

    def count(batches):
        for b in batches:
            words = [Counter(LETTERS.findall((t or "").lower())) for t in b.column("text").to_pylist()]
            cols = [b.column("doc_id"), b.column("y"), pa.array([list(w) for w in words], pa.list_(pa.string())), pa.array([list(w.values()) for w in words], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "y", "words", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(few), "doc_id").select("doc_id", "y", "text")
    got = rows.mapInArrow(count, "doc_id long, y int, words array<string>, n array<int>").toArrow()  # bounded by ``most`` documents
    found = [(i, y, dict(zip(w, n, strict=True))) for i, y, w, n in zip(*(got.column(c).to_pylist() for c in got.column_names), strict=True)]
    return sorted(found, key=lambda x: (x[0], sorted(x[2]))), shares


def score(docs: DataFrame, index: Index, threshold: float = 0.7) -> DataFrame:
    """Every row of ``docs`` (column text) with score, predicted and evidence; columns of these names are replaced."""
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.drop("score", "predicted", "evidence")
    sent = spark.sparkContext.broadcast(index)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches):
        x = sent.value
        cache = Words(x)
        for b in batches:
            if len(cache) > 200_000:
                cache = Words(x)
            texts = b.column("text").to_pylist()
            once = list(dict.fromkeys(texts))
            known = dict(zip(once, x.score([Counter(LETTERS.findall((t or "").lower())) for t in once], cache), strict=True))
            got = [known[t] for t in texts]
            evidence = [[{"doc_id": i, "cosine": s, "toxic": y} for i, s, y in g[1]] for g in got]
            cols = [*b.columns, pa.array([g[0] for g in got], pa.float64()), pa.array([int(g[0] >= threshold) for g in got], pa.int32()), pa.array(evidence, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "score", "predicted", "evidence"])

    return docs.mapInArrow(run, f"{schema}, score double, predicted int, evidence array<struct<doc_id:bigint,cosine:double,toxic:int>>")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence for every row.

    Null and empty texts, and texts that share no word beginning with any example, get the rate of toxic examples that are as silent. Null
    doc_id: not held out and never an example. Without labelled rows every score is 0. Repeated rows are scored alike. Empty table: no rows.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found, shares = examples(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    index = Index(found, shares=shares)
    out = score(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), index)
    return out.select("doc_id", "held_out", "score", "predicted", "evidence")
