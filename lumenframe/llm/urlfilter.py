"""URL filter by a cascade of Bloom filters; built and probed with SQL functions alone.

A rule is a host with a path prefix. The keys a url can match are its host suffixes at dots, of as many labels as the rules
have, each with the path prefixes of the lengths that the rules have. Over the complete universe of such keys, level 0 of a cascade encodes the listed
keys, level 1 the keys of the universe that level 0 passes wrongly, level 2 the listed keys that level 1 passes, and so
on until no key is passed wrongly. For any key of the universe membership is then exact, and judging is a projection: the
bit arrays are literals of the plan and no join is needed. Levels over ``MOST_BITS`` are refused: the rules are then too
many to send to every task and belong in a join.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import Workspace

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_BITS = 1 << 26
#: The rules of the query, as (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty for null and for a url without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def candidates(host: Column, path: Column, lengths: list[int], depths: list[int]) -> Column:
    """Keys of the host suffixes of ``depths`` labels with the path prefixes of ``lengths``: those that a rule can have."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    some = F.filter(F.array(*[F.lit(k) for k in depths]), lambda k: k <= n)
    suffixes = F.transform(some, lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))
    fit = F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: k <= F.length(path))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(fit, lambda k: F.concat(s, F.substr(path, F.lit(1), k)))))


class Level:
    """One Bloom filter: ``bits`` bits in 64-bit words, ``hashes`` positions for a key."""

    def __init__(self, keys: DataFrame, n: int, rate: float, seed: int):
        bits = -n * math.log(rate) / math.log(2) ** 2
        self.bits = max(64, 64 * math.ceil(bits / 64))
        if self.bits > MOST_BITS:
            raise ValueError(f"a level of {self.bits} bits is over the bound of {MOST_BITS}")
        self.hashes = max(1, min(24, round(self.bits / max(1, n) * math.log(2))))
        self.seed = seed
        at = keys.select(F.explode(F.array(*[self._at(F.col("key"), i) for i in range(self.hashes)])).alias("p"))
        bit = F.expr("shiftleft(1L, cast(p % 64 as int))")
        rows = at.groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.bit_or(bit).alias("b")).collect()  # at most bits / 64 rows
        words = [0] * (self.bits // 64)
        for r in rows:
            words[r["w"]] = r["b"]
        self.words = F.from_json(F.lit("[" + ",".join(map(str, words)) + "]"), "array<bigint>")

    def _at(self, key: Column, i: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(self.seed * 64 + i)), F.lit(self.bits))

    def has(self, key: Column) -> Column:
        found = F.lit(True)
        for i in range(self.hashes):
            p = self._at(key, i)
            word = F.element_at(self.words, (p / 64).cast("int") + 1)
            found = found & (word.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (p % 64).cast("int"))) != 0)
        return found


class Cascade:
    """Exact membership in ``listed`` (column key, distinct) for every key of ``listed`` and ``others``."""

    def __init__(self, listed: DataFrame, others: DataFrame, seed: int, most_levels: int = 64):
        self.levels: list[Level] = []
        inside, outside = listed, others
        n, total = inside.count(), outside.count()
        rate = min(0.5, max(n / (math.sqrt(2) * max(1, total)), 1e-7))
        while n:
            if len(self.levels) == most_levels:
                raise RuntimeError("the cascade did not end")
            level = Level(inside, n, rate, seed + len(self.levels))
            self.levels.append(level)
            inside, outside = outside.where(level.has(F.col("key"))), inside
            n, rate = inside.count(), 0.5

    def has(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(~self.levels[i].has(key), F.lit(i % 2 == 1)).otherwise(out)
        return out


def judge(pages: DataFrame, rules: DataFrame, ws: Workspace, unlisted: str = "allow") -> DataFrame:
    """Every row of ``pages`` (column url) with host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block). The longest rule that fits wins; a url that none fits gets
    ``unlisted``. A rule listed with both verdicts blocks.
    """
    rules = rules.select(F.concat(F.translate("host", UPPER, LOWER), "path").alias("key"), F.length("path").alias("n"), F.size(F.split("host", r"\.")).alias("d"), (F.col("verdict") == "block").alias("block"))
    rules = rules.groupBy("key", "n", "d").agg(F.max("block").alias("block"))
    shape = rules.agg(F.sort_array(F.collect_set("n")).alias("n"), F.sort_array(F.collect_set("d")).alias("d")).first()
    lengths, depths = shape["n"], shape["d"]
    host, path = parts(F.col("url"))
    read = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    keys = read.select(F.explode(candidates(F.col("host"), F.col("path"), lengths, depths)).alias("key"))
    every = keys.withColumn("block", F.lit(None).cast("boolean")).unionByName(rules.select("key", "block"))
    every = ws.write(every.groupBy("key").agg(F.max("block").alias("block")), "universe")  # null: not listed
    blocked, allowed = every.where("block"), every.where("not block")
    stops = Cascade(blocked, every.where("block is null or not block"), 0)
    passes = Cascade(allowed, every.where("block is null or block"), 64)
    ws.drop(every)
    cands = candidates(F.col("host"), F.col("path"), lengths, depths)
    hit = F.transform(cands, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"), stops.has(k).alias("block"), passes.has(k).alias("allow")))
    best = F.array_max(F.filter(hit, lambda h: h["block"] | h["allow"]))
    out = read.withColumn("_best", best)
    verdict = F.when(F.col("_best").isNull(), unlisted).when(F.col("_best.block"), "block").otherwise("allow")
    return out.withColumns({"rule": F.col("_best.key"), "verdict": verdict}).drop("_best")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    Null url or one without ``://``: empty host and path, no rule, allow. Null page_id and repeated rows are judged like
    any other. Empty table: no rows.
    """
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    out = judge(pages, rules, Workspace(spark, "urlfilter"))
    return out.select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), named AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM named
), rules(h, p, v) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), numbered AS (SELECT *, row_number() OVER () AS rn FROM split),
best AS (
  SELECT rn, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rn
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM numbered LEFT JOIN best USING (rn)
"""
