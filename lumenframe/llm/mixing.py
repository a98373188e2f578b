"""Mixing of sources to target weights with a time-varying curriculum.

Targets are water-filled: each source asks for a share by weight, a source that would exceed ``most_epochs`` times its own
size is held there, and the excess goes to the others by weight. Every source has a schedule, the density of its demand
over training time from 0 to 1. The integral of the schedule, scaled to the target, is the cumulative demand; the inverse
of it turns a running word count of the source into a training position. Documents are laid out in a fixed shuffled
order, again for each further epoch; the last one is cut where the target is met. A range sort by position gives the
training order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import Workspace, stage_workspace
from lumenframe.llm.offsets import running_offsets

WORD = r"[^\x20\x09-\x0D]+"
#: Linear densities of demand at times 0 and 1, dealt to the sources in turn: steady, fading out, fading in.
SCHEDULES = ((1.0, 1.0), (1.5, 0.5), (0.5, 1.5))


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, ws: Workspace, weights: tuple[int, ...] = (1, 2, 3), most_epochs: float = 3.0, most_rounds: int = 200) -> DataFrame:
    """(source, source_size) -> those with w, target and schedule start and end.

    The water level is the fixed point of: a source is capped where its cap is below level times weight. Every round is
    one aggregate over the table of sources and only raises the level; it ends when the capped weight no longer changes.
    """
    # one row for each source, dealt by rank
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))) - 1
    pick = F.lit(None)
    a = b = F.lit(None)
    for i, w in enumerate(weights):
        pick = F.when(F.col("_r") % len(weights) == i, float(w)).otherwise(pick)
    for i, (x, y) in enumerate(SCHEDULES):
        a = F.when(F.col("_r") % len(SCHEDULES) == i, x).otherwise(a)
        b = F.when(F.col("_r") % len(SCHEDULES) == i, y).otherwise(b)
    t = ws.write(sizes.withColumn("_r", rank).select("source", "source_size", pick.alias("w"), a.alias("d0"), b.alias("d1")), "weights")
    cap = F.col("source_size") * F.lit(most_epochs)
    level, before = 0.0, -1.0
    for _ in range(most_rounds):
        held = cap <= F.lit(level) * F.col("w")
        row = t.agg(
            F.sum("source_size").alias("all"), F.sum(F.when(held, cap)).alias("capped"), F.sum(F.when(~held, F.col("w"))).alias("open"), F.sum("w").alias("w")
        ).first()
        left = row["open"] or 0.0
        if left == before or not left:
            level = level if left else float("inf")
            break
        before, level = left, (row["all"] - (row["capped"] or 0.0)) / left
    else:
        raise RuntimeError("the water level did not settle")
    goal = F.least(cap, F.lit(level) * F.col("w")) if level != float("inf") else cap
    return t.withColumn("target", goal)


def position(done, whole, d0, d1) -> F.Column:
    """Training time at which cumulative demand reaches ``done`` words of ``whole``; null from the end of demand on.

    The inverse of (d0 t + (d1 - d0) t^2 / 2) / ((d0 + d1) / 2) * whole.
    """
    share = done / whole * (d0 + d1) / 2
    root = F.sqrt(F.greatest(d0 * d0 + 2 * (d1 - d0) * share, F.lit(0.0)))
    return F.when(done < whole, 2 * share / (d0 + root))


def mix(docs: DataFrame, ws: Workspace, **rules) -> DataFrame:
    """Every row of ``docs`` (columns doc_id, text, source and perhaps _row) without its text, with size, source_size, target, whole (the target in words) and the schedule.

    ``_before`` is the running word count of its source ahead of it.
    """
    also = [c for c in ("_row",) if c in docs.columns]
    rows = docs.select("doc_id", "source", *also, word_count(F.col("text")).alias("size"), F.md5(F.col("text").cast("binary")).alias("_t"))
    rows = ws.write(rows.withColumn("_key", F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("_t")).cast("binary"))), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = ws.write(targets(sizes, ws, **rules), "targets")
    placed = running_offsets(rows, "source", ["_key"], "size")
    named = goals.withColumnRenamed("source", "_s")
    placed = placed.join(named, placed["source"].eqNullSafe(named["_s"])).drop("_s")
    return ws.write(placed.withColumn("whole", F.round("target").cast("long")), "mix")


def laid_out(m: DataFrame) -> DataFrame:
    """A row for each row of ``mix`` and epoch in which demand reaches it, with epoch, position and words.

    A source is laid out again for each epoch. The position of a document is the time at which the demand of its source
    arrives at its first word; a document that no time reaches is not taken. Of the last one only the words ahead of the
    end of demand are.
    """
    epochs = F.when(F.col("source_size") > 0, F.ceil(F.col("whole") / F.col("source_size"))).otherwise(0).cast("int")
    m = m.where("size > 0").withColumn("epoch", F.explode(F.slice(F.sequence(F.lit(0), F.greatest(epochs, F.lit(1))), 1, epochs)))
    done = F.col("_before") + F.col("epoch") * F.col("source_size")
    m = m.withColumn("position", position(done, F.col("whole"), F.col("d0"), F.col("d1"))).where("position is not null")
    return m.withColumn("words", F.least(F.col("size"), F.col("whole") - done))


def schedule(docs: DataFrame, ws: Workspace, **rules) -> DataFrame:
    """The training order: the rows of ``laid_out``, range-sorted by position."""
    return laid_out(mix(docs, ws, **rules)).sort("position", "_key", "epoch")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, position for every row, in training order: by first position, rows of which nothing is taken last.

    ``taken`` sums the words of a row's epochs in the written schedule; ``position`` is its first, rounded to nine digits,
    null where nothing is taken. Null and wordless texts have size 0 and taken 0. A null source is a source, last by rank.
    Rows that repeat entirely share their place, which does not change what is taken in all. Null doc_id: the text alone
    orders it. Empty table: no rows.
    """
    ws = Workspace(spark, "mixing")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").withColumn("_row", F.monotonically_increasing_id())
    m = mix(docs, ws)
    order = ws.write(laid_out(m).sort("position", "_key", "epoch"), "schedule")
    used = order.groupBy("_row").agg(F.sum("words").alias("taken"), F.round(F.min("position"), 9).alias("position"))
    out = m.join(used, "_row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))
    out = ws.finish(out.select("doc_id", "size", "source_size", "target", "taken", "position", "_key", "_row"))
    # files do not keep their order when read, so the result is sorted as it is read
    return out.sort(F.asc_nulls_last("position"), "_key", "_row").select("doc_id", "size", "source_size", "target", "taken", "position")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents in training order, once for each epoch that takes them, a last one cut at the word where its source's target is met.

    Null and wordless texts are never taken. Rows that repeat are laid out each. Columns of any name pass through.
    """
    ws = stage_workspace(spark, "mixing", docs)
    rows = ws.write(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("_row")), "documents")
    order = schedule(rows.select("doc.doc_id", "doc.text", "doc.source", "_row"), ws).select("_row", "size", "epoch", "words", "position", "_key")
    words = F.slice(F.regexp_extract_all("doc.text", F.lit(f"({WORD})")), 1, F.col("words").cast("int"))
    cut = F.when(F.col("words") < F.col("size"), F.array_join(words, " ")).otherwise(F.col("doc.text"))
    out = rows.join(order, "_row").orderBy("position", "_key", "epoch")
    return out.select(*[cut.alias("text") if c == "text" else F.length(cut).cast("long").alias("n_chars") if c == "n_chars" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws('/', coalesce(CAST(doc_id AS VARCHAR), '-'), md5(text))) AS k FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS DOUBLE) AS w FROM d GROUP BY source
), r AS (
  SELECT *, 3.0::DOUBLE * source_size AS cap, row_number() OVER (ORDER BY source_size / w, source) AS n FROM s
), c AS (
  SELECT *, sum(cap) OVER (ORDER BY n) AS capped, sum(w) OVER (ORDER BY n) AS gone, sum(source_size) OVER () AS total, sum(w) OVER () AS every FROM r
), l AS (  -- the water level after the first n sources by size over weight are held at their caps
  SELECT 0 AS n, any_value(total) / any_value(every) AS level FROM c
  UNION ALL SELECT n, (total - capped) / nullif(every - gone, 0) FROM c
), f AS (
  SELECT level FROM l LEFT JOIN r ON r.n = l.n + 1 WHERE r.n IS NULL OR r.cap > l.level * r.w ORDER BY l.n LIMIT 1
), t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * w) END AS target FROM r, f),
b AS (SELECT d.*, row_number() OVER () AS n, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d),
z AS (SELECT source, source_size, target, CAST(round(target) AS BIGINT) AS whole, rank % 3 AS m FROM (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM t)),
y AS (SELECT *, CASE m WHEN 0 THEN 1.0 WHEN 1 THEN 1.5 ELSE 0.5 END::DOUBLE AS d0, CASE m WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 1.5 END::DOUBLE AS d1 FROM z),
e AS (SELECT n, size, whole, d0, d1, before + e.i * source_size AS done FROM b JOIN y ON b.source IS NOT DISTINCT FROM y.source JOIN range(4) e(i) ON size > 0 AND before + e.i * source_size < whole),
h AS (SELECT n, least(size, whole - done) AS words, done::DOUBLE / whole * (d0 + d1) / 2 AS share, d0, d1 FROM e),
u AS (SELECT n, CAST(sum(words) AS BIGINT) AS taken, round(min(2 * share / (d0 + sqrt(greatest(d0 * d0 + 2 * (d1 - d0) * share, 0)))), 9) AS position FROM h GROUP BY n)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken, position FROM b JOIN y ON b.source IS NOT DISTINCT FROM y.source LEFT JOIN u ON u.n = b.n
"""
