import time
from types import SimpleNamespace

from pyspark.sql import functions as F

from lumenframe.streaming import progress


def frames(spark, n, first=0):
    return spark.range(first, first + n).select(F.lit("a").alias("stream_id"), F.col("id").alias("seq"), (F.col("id") / 25).alias("elapsed"))


def test_timecode():
    assert progress.timecode(0) == "00:00:00.000"
    assert progress.timecode(3723.0625) == "01:02:03.062"


def test_batch(spark, tmp_path):
    r = progress.measured(frames(spark, 101), lambda df: df.write.parquet(f"{tmp_path}/out"))
    assert (r.frames, r.media) == (101, 4.0) and r.seconds > 0 and abs(r.rate - 101 / r.seconds) < 1e-9
    assert r.summary().startswith("Processed 101 frames in 00:00:") and "Media time: 00:00:04.000" in r.line()
    none = progress.measured(frames(spark, 0), lambda df: df.write.parquet(f"{tmp_path}/none"), "none")
    assert (none.frames, none.media) == (0, 0.0)


def test_stream_over_batches_and_a_restart(spark, tmp_path):
    said = []
    listener = progress.Listener(said.append)
    spark.streams.addListener(listener)
    try:
        for part in range(3):
            frames(spark, 50, part * 50).write.mode("append").parquet(f"{tmp_path}/in")
            stream = spark.readStream.schema(frames(spark, 1).schema).parquet(f"{tmp_path}/in")
            q = progress.observed(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
        end = time.time() + 20
        while len(said) < 3 and time.time() < end:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert [r.frames for r in said] == [50, 50, 50]  # each start counts its own frames, and none comes twice
    assert [r.media for r in said] == [49 / 25, 99 / 25, 149 / 25]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 150


def test_a_batch_told_after_the_next_start_counts_in_its_own_run():
    said = []
    listener = progress.Listener(said.append)

    def batch(run, frames, media):
        listener.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(id="q", runId=run, observedMetrics={"progress": {"frames": frames, "media": media}})))

    listener.onQueryStarted(SimpleNamespace(id="q", runId="a"))
    batch("a", 50, 2.0)
    listener.onQueryStarted(SimpleNamespace(id="q", runId="b"))
    batch("a", 10, 3.0)
    assert listener.reports["q"].frames == 0
    listener.onQueryTerminated(SimpleNamespace(id="q", runId="a"))
    batch("b", 20, 4.0)
    batch("b", 5, 3.5)
    assert [(r.frames, r.media) for r in said] == [(50, 2.0), (60, 3.0), (20, 4.0), (25, 4.0)]
    assert listener.reports["q"] == said[-1]
