"""Language ID by word-first backoff.

Known words score by their log frequency in each language. A word that no language knows falls back to character
n-grams, the longest length first; the first length at which any n-gram of the word is known decides. The word and n-gram
tables hold everything in a bounded, documented sample of the labelled rows, so the model can be sent to every executor.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import arrow_rows, fold, held_out, spread

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. Numerals that are no digits, like one half or a raised two, are no letters."""
    out = []
    for w in LETTERS.findall(text.lower()):
        if w.isalpha():
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word within boundary marks; single characters come without marks."""
    s = f"^{word}$" if n > 1 else word
    return [s[i : i + n] for i in range(len(s) - n + 1)]


def _counts(batches):
    """Per partition: (kind, lang, token, n), kind 0 for words and n for n-grams."""
    held: Counter = Counter()
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w, n in Counter(words_of(text)).items():
                held[0, lang, w] += n
                for k in ORDERS:
                    for g in grams(w, k):
                        held[k, lang, g] += n
        if len(held) > 400_000:
            yield _rows(held)
            held.clear()
    if held:
        yield _rows(held)


def _rows(held: Counter) -> pa.RecordBatch:
    kind, lang, token = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(lang, pa.string()), pa.array(token, pa.string()), pa.array(list(held.values()), pa.int64())],
        names=["kind", "lang", "token", "n"],
    )


class Model:
    """Log frequencies centred over the languages: ``rows[kinds[k][token]]`` is a vector over ``langs``."""

    def __init__(self, langs: list[str], kinds: dict[int, dict[str, int]], rows: np.ndarray):
        self.langs, self.kinds, self.rows = langs, kinds, rows

    @classmethod
    def of(cls, counts: list[tuple[int, str, str, int]], alpha: float = 0.5) -> "Model":
        langs = sorted({r[1] for r in counts})
        at = {x: i for i, x in enumerate(langs)}
        raw: dict[int, dict[str, np.ndarray]] = {k: {} for k in (0, *ORDERS)}
        total = {k: np.zeros(len(langs)) for k in raw}
        for kind, lang, token, n in counts:
            raw[kind].setdefault(token, np.zeros(len(langs)))[at[lang]] += n
            total[kind][at[lang]] += n
        kinds, parts, first = {}, [np.zeros((0, len(langs)))], 0
        for k, table in raw.items():
            kinds[k] = {t: first + i for i, t in enumerate(table)}
            first += len(table)
            if table:
                m = np.log(np.array(list(table.values())) + alpha) - np.log(total[k] + alpha * len(table))
                parts.append(m - m.mean(axis=1, keepdims=True))
        return cls(langs, kinds, np.concatenate(parts).astype("float32"))

    def unseen(self, word: str) -> tuple[list[int], float]:
        """Rows of the word's n-grams of the greatest length at which any is known, and the weight of each."""
        for k in ORDERS:
            table = self.kinds[k]
            s = f"^{word}$" if k > 1 else word
            found = [i for j in range(len(s) - k + 1) if (i := table.get(s[j : j + k])) is not None]
            if found:
                return found, 1.0 / k
        return [], 0.0

    def predict(self, text: str | None, cache: dict, most_evidence: float = 24.0) -> tuple[str, float]:
        """(language, posterior). Evidence of a long text counts as that of ``most_evidence`` mean words."""
        words = Counter(words_of(text)) if text else None
        if not words or not self.langs:
            return "und", 0.0
        known, at, weight = self.kinds[0], [], []
        for w, n in words.items():
            i = known.get(w)
            if i is not None:
                at.append(i)
                weight.append(n)
                continue
            if w not in cache:
                if len(cache) > 100_000:
                    cache.clear()
                cache[w] = self.unseen(w)
            found, each = cache[w]
            at += found
            weight += [n * each] * len(found)
        seen = sum(words.values())
        total = np.array(weight) @ self.rows[at].astype(float) if at else np.zeros(len(self.langs))
        total *= min(seen, most_evidence) / seen
        best = int(total.argmax())
        return self.langs[best], 1.0 / float(np.exp(total - total[best]).sum())


def train(docs: DataFrame, docs_per_lang: int = 1000) -> Model:
    """Fit on the labelled rows of ``docs`` (columns doc_id, text, lang) outside the held-out fold.

    ``docs_per_lang`` bounds the sample: a language with more labelled rows keeps those whose id hashes lowest, in that
    expected number. All words and n-grams of the sample are in the model.
    """
    labelled = docs.where((fold(F.col("doc_id")) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count().withColumn("share", F.lit(float(docs_per_lang)) / F.col("count")).drop("count")
    share = {r["lang"]: r["share"] for r in counts.collect()}  # a row for each language
    if not share:
        return Model.of([])
    levels = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])
    chance = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.where(chance < levels[F.col("lang")]).select("lang", "text")
    rows = sample.mapInArrow(_counts, "kind int, lang string, token string, n long")
    table = rows.groupBy("kind", "lang", "token").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    return Model.of(list(zip(*(table.column(c).to_pylist() for c in ("kind", "lang", "token", "n")), strict=True)))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` with lang_pred and score; a column of either name is replaced."""
    spark = docs.sparkSession
    arrow_rows(spark)
    docs = docs.drop("lang_pred", "score")
    sent = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        m, cache = sent.value, {}
        for b in batches:
            texts = b.column(text).to_pylist()
            known = {t: m.predict(t, cache) for t in set(texts)}
            out = [known[t] for t in texts]
            cols = [*b.columns, pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row.

    Null or letterless text: ``und`` with score 0. Null doc_id: not held out and never learned from. Repeated rows and
    ties: each row is scored alone; equal scores go to the first language in code-point order. Empty table: no rows.
    """
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
    model = train(docs)
    out = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str, min_score: float = 0.3) -> DataFrame:
    """Pipeline stage: documents whose language can be told; ``und`` and scores under ``min_score`` go. ``lang`` becomes the prediction.

    Null, empty and letterless texts are ``und``. Repeated rows fare alike. Columns of any name pass through.
    """
    model = train(docs.select("doc_id", "text", "lang"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    out = identify(packed, model).where((F.col("lang_pred") != "und") & (F.col("score") >= min_score))
    return out.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
