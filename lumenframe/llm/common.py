"""What the corpus operators share: work tables in the cluster's shared folder, bounded Arrow batches, row folds."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see. Only a local session that names none gets a temporary one (tests); on a cluster its absence is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"file://{tempfile.mkdtemp(prefix='lumenframe-')}"
    spark.sparkContext.setCheckpointDir(path)
    return path


def arrow_rows(spark: SparkSession, most: int = 1000, most_bytes: int = 32 << 20) -> None:
    """Lower the rows and bytes of an Arrow batch so that a batch of long texts stays within a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= most:
        spark.conf.set(key, str(most))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most_bytes))


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def spread(scan: DataFrame) -> DataFrame:
    """A scan in fewer partitions than the cluster has cores, dealt out to all of them; any other as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


class Workspace:
    """Parquet tables under the shared folder. They cut lineage, outlive executors, and go when ``finish`` is called."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.work_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads, and let the driver's cleaner free the shuffle files that made them."""
        for t in tables:
            self._delete(t.work_path)
        self.spark._jvm.System.gc()

    def finish(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """Write the result, drop every other table of this workspace, and return the result as a scan."""
        out = self.write(df, "result")
        spark = self.spark
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for s in fs.listStatus(path):
            p = s.getPath().toString()
            if s.getPath().getName() != out.work_path.rsplit("/", 1)[1] and not any(p.endswith(k.rsplit("/", 1)[1]) for k in keep):
                fs.delete(s.getPath(), True)
        return out

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: For each thread the workspaces of its pipeline stages: a stage's result is read from its tables until the next stage has it.
_HELD = threading.local()


def stage_workspace(spark: SparkSession, name: str, docs: DataFrame) -> Workspace:
    """A workspace for a pipeline stage over ``docs``. Those of this thread's former stages go, except one that ``docs`` itself still reads."""
    read = docs.inputFiles()
    stays = [ws for ws in getattr(_HELD, "stages", []) if any(ws.root.rsplit("/", 1)[1] in f for f in read)]
    for ws in getattr(_HELD, "stages", []):
        if ws not in stays:
            ws.clear()
    ws = Workspace(spark, name)
    _HELD.stages = [*stays, ws]
    return ws


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))
