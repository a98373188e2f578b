"""WAVE files: a Spark data source ``wav`` of half-overlapping blocks of samples, and a sink.

A file is split where blocks begin. A split reads its own blocks and the one after them, so that every pair of neighbouring blocks
is in one row without any exchange of samples. The last block of a file is filled up with zeros.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenframe.sources.files import FileWriter, filesystem

SCHEMA = "stream_id string, channel int, frame long, samples array<double>"
#: Format tags of whole and floating samples, and the length that stands for an open end.
PCM, FLOAT, EXTENSIBLE, OPEN_END = 1, 3, 0xFFFE, 0xFFFFFFFF


class Layout:
    """Where and how the samples of a file lie."""

    def __init__(self, stream, size: int):
        if stream.read(4) != b"RIFF":
            raise ValueError("not a WAVE file")
        stream.read(4)
        if stream.read(4) != b"WAVE":
            raise ValueError("not a WAVE file")
        at, self.kind = 12, None
        while True:
            head = stream.read(8)
            if len(head) < 8:
                raise ValueError("a WAVE file without samples")
            name, length = head[:4], struct.unpack("<I", head[4:])[0]
            at += 8
            if name == b"data":
                if self.kind is None:
                    raise ValueError("samples before their format")
                self.start = at
                whole = size - at if length in (0, OPEN_END) else min(length, size - at)
                self.frames = whole // (self.channels * self.bits // 8)
                return
            body = stream.read(length + length % 2)
            at += length + length % 2
            if name == b"fmt ":
                self.kind, self.channels, self.rate, _, _, self.bits = struct.unpack("<HHIIHH", body[:16])
                if self.kind == EXTENSIBLE:
                    self.kind = struct.unpack("<H", body[24:26])[0]
                if (self.kind, self.bits) not in {(PCM, 8), (PCM, 16), (PCM, 24), (PCM, 32), (FLOAT, 32), (FLOAT, 64)}:
                    raise ValueError(f"samples of kind {self.kind} and {self.bits} bits")

    @property
    def step(self) -> int:
        return self.channels * self.bits // 8

    def decode(self, raw: bytes) -> np.ndarray:
        """Samples as frames x channels; whole numbers become fractions of their range."""
        raw = raw[: len(raw) - len(raw) % self.step]
        if self.kind == FLOAT:
            x = np.frombuffer(raw, f"<f{self.bits // 8}").astype(float)
        elif self.bits == 8:
            x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
        elif self.bits == 24:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
        else:
            x = np.frombuffer(raw, f"<i{self.bits // 8}").astype(float) / float(1 << (self.bits - 1))
        return x.reshape(-1, self.channels)


class Blocks(InputPartition):
    def __init__(self, path: str, size: int, first: int, count: int):
        self.path, self.size, self.first, self.count = path, size, first, count


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.stride = int(options.get("stride", "8192"))
        self.most = max(1, int(options.get("framesperpartition", "4096")))
        if self.stride < 1:
            raise ValueError("the stride must be at least 1")

    def partitions(self):
        from pyarrow import fs as pafs

        fs, root = filesystem(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else [i for i in fs.get_file_info(pafs.FileSelector(root)) if i.path.endswith(".wav")]
        out = []
        for i in sorted(found, key=lambda x: x.path):
            with fs.open_input_stream(i.path) as f:
                pairs = -(-Layout(f, i.size).frames // self.stride) - 1  # a pair for each block that follows another
            out += [Blocks(i.path, i.size, a, min(self.most, pairs - a)) for a in range(0, pairs, self.most)]
        return out

    def read(self, part: Blocks):
        import pyarrow as pa

        fs, _ = filesystem(self.path)
        name = part.path.rsplit("/", 1)[1].removesuffix(".wav")
        with fs.open_input_stream(part.path) as f:
            lay = Layout(f, part.size)
        n, rows = self.stride, max(1, (1 << 20) // self.stride)
        with fs.open_input_file(part.path) as f:
            for a in range(part.first, part.first + part.count, rows):
                many = min(rows, part.first + part.count - a)
                f.seek(lay.start + a * n * lay.step)
                x = lay.decode(f.read(min((many + 1) * n, lay.frames - a * n) * lay.step))
                x = np.concatenate([x, np.zeros(((many + 1) * n - len(x), lay.channels))]).reshape(many + 1, n, lay.channels)
                pairs = np.concatenate([x[:-1], x[1:]], axis=1).transpose(0, 2, 1).reshape(many * lay.channels, 2 * n)
                cols = [
                    pa.array([name] * len(pairs)),
                    pa.array(np.tile(np.arange(lay.channels, dtype=np.int32), many)),
                    pa.array(np.repeat(np.arange(a, a + many), lay.channels)),
                    pa.ListArray.from_arrays(np.arange(0, 2 * n * len(pairs) + 1, 2 * n, dtype=np.int32), pa.array(np.ascontiguousarray(pairs).ravel())),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["stream_id", "channel", "frame", "samples"])


class Writer(FileWriter):
    """A file of 64-bit floating samples for each run of rows of one stream_id."""

    def __init__(self, options):
        super().__init__(options)
        self.rate = int(options.get("rate", "44100"))

    def store(self, batches, create):
        name = out = width = None
        for b in batches:
            ids = b.column("stream_id").to_pylist()
            samples = b.column("samples")
            for at, (i, x) in enumerate(zip(ids, samples.to_pylist(), strict=True)):
                if at == 0 or i != name:
                    if i != name:
                        name, width = i, len(x)
                        out = create(f"{name}.wav")
                        body = struct.pack("<HHIIHH", FLOAT, width, self.rate, self.rate * width * 8, width * 8, 64)
                        out.write(b"RIFF" + struct.pack("<I", OPEN_END) + b"WAVEfmt " + struct.pack("<I", len(body)) + body + b"data" + struct.pack("<I", OPEN_END))
                if len(x) != width:
                    raise ValueError("a sample has another number of channels than its stream")
                out.write(struct.pack(f"<{width}d", *x))


class WavSource(DataSource):
    """``spark.read.format("wav").option("stride", 8192).load(path)``: each channel's blocks of 2 x stride samples, a stride apart."""

    @classmethod
    def name(cls):
        return "wav"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


def write(samples: DataFrame, path: str, rate: int = 44_100) -> None:
    """Write (stream_id, i, samples: one for each channel) as ``<stream_id>.wav`` files in the order of i; a stream goes through one task in bounded batches."""
    samples.sparkSession.dataSource.register(WavSource)
    ordered = samples.repartition("stream_id").sortWithinPartitions("stream_id", "i").selectExpr("cast(stream_id as string) as stream_id", "samples")
    ordered.write.format("wav").option("rate", rate).mode("append").save(path)


def load(spark, path: str, stride: int, **options) -> DataFrame:
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").options(stride=stride, **options).load(path)
