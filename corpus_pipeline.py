"""Language ID, SimHash near-dedup, suffix-array dedup, mixing and packing over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import langid, mixing, packing, simhash, suffix

STAGES = [
    ("language_id", langid.keep_identified),
    ("simhash_near_dedup", simhash.keep_representatives),
    ("suffix_dedup", suffix.cut_repeats),
    ("source_mixing", mixing.mix_sources),
    ("packing", packing.pack_documents),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each over a written copy of what its predecessor kept; a copy goes once the next one is written."""
    from lumenframe.llm.common import Workspace

    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES:
        docs = ws.write(stage(spark, docs, sf_dir), name)
        if before is not None:
            ws.drop(before)
        before = docs
    return docs
