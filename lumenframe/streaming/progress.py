"""Progress of frames through a batch or a stream, from metrics observed on the way: no second pass, nothing kept."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def timecode(seconds: float) -> str:
    ms = int(seconds * 1000)
    return f"{ms // 3_600_000:02d}:{ms // 60_000 % 60:02d}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


@dataclass(frozen=True)
class Report:
    """Frames seen, the media time of the last of them, and the real time it took, in seconds."""

    frames: int
    media: float
    seconds: float

    @property
    def rate(self) -> float:
        return self.frames / self.seconds if self.seconds > 0 else 0.0

    def summary(self) -> str:
        return f"Processed {self.frames} frames in {timecode(self.seconds)} ({self.rate:.2f} FPS)"

    def line(self) -> str:
        return f"Frame: {self.frames:14d}, Media time: {timecode(self.media)}, Real time: {timecode(self.seconds)}, Rate: {self.rate:9.2f} FPS"


def _metrics():
    return F.count(F.lit(1)).alias("frames"), F.max("elapsed").alias("media")


def measured(frames: DataFrame, action: Callable[[DataFrame], object], name: str = "progress") -> Report:
    """Run ``action`` on ``frames`` (with a column elapsed) and report on what went through. No frames, or no times: zeros."""
    seen = Observation(name)
    began = time.monotonic()
    action(frames.observe(seen, *_metrics()))
    took = time.monotonic() - began
    got = seen.get
    return Report(got["frames"], got["media"] or 0.0, took)


def observed(frames: DataFrame, name: str = "progress") -> DataFrame:
    """A stream of frames (with a column elapsed) that a ``Listener`` of the same name follows."""
    return frames.observe(name, *_metrics())


class Listener(StreamingQueryListener):
    """Calls ``say`` with a Report after every batch, frames and times since the stream's start; ``reports`` has the last one of each query.

    A start is told at once, batches some time later, so those of a run can come in after the next start. Each run counts by itself.
    """

    def __init__(self, say: Callable[[Report], object] = lambda report: None, name: str = "progress"):
        self.say, self.name, self.reports, self.runs, self.latest = say, name, {}, {}, {}

    def onQueryStarted(self, event):
        key, run = str(event.id), str(event.runId)
        self.runs[run] = time.monotonic(), Report(0, 0.0, 0.0)
        self.latest[key], self.reports[key] = run, self.runs[run][1]

    def onQueryProgress(self, event):
        key, run, got = str(event.progress.id), str(event.progress.runId), event.progress.observedMetrics.get(self.name)
        if got is None or not got["frames"]:
            return
        began, before = self.runs.get(run, (time.monotonic(), Report(0, 0.0, 0.0)))
        report = Report(before.frames + got["frames"], max(before.media, got["media"] or 0.0), time.monotonic() - began)
        self.runs[run] = began, report
        if self.latest.setdefault(key, run) == run:
            self.reports[key] = report
        self.say(report)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.runs.pop(str(event.runId), None)
