"""YUV4MPEG2 streams: a pure codec, and a Spark data source ``y4m`` over files of them.

A file is split by frame ranges. As long as frame headers are bare, a frame's place follows from its number; the sink leaves an
index beside a file whose frames have parameters, so that such files split as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from lumenframe.operators.frames import SUBSAMPLING
from lumenframe.sources.files import FileWriter
from lumenframe.sources.files import filesystem as _filesystem

#: The words that open a stream and a frame, and the longest header line.
MAGIC, FRAME, MOST_HEADER = b"YUV4MPEG2", b"FRAME", 1024
SCHEMA = "stream_id string, seq long, elapsed double, parms map<string,string>, y binary, cb binary, cr binary"


def parse_params(words: bytes) -> dict[str, str]:
    """``Xvalue`` words; the last of a letter counts."""
    out = {}
    for w in words.decode("ascii").split():
        if not ("A" <= w[0] <= "Z"):
            raise ValueError(f"bad parameter {w!r}")
        out[w[0]] = w[1:]
    return out


def format_params(m: dict[str, str]) -> str:
    return "".join(f" {k}{m[k]}" for k in sorted(m))


def plane_sizes(parms: dict[str, str]) -> tuple[int, int, int]:
    cs = parms.get("C", "420")
    if cs not in SUBSAMPLING:
        raise ValueError(f"unknown colourspace {cs!r}")
    w, h = int(parms["W"]), int(parms["H"])
    xs, ys = SUBSAMPLING[cs]
    return w * h, (w // xs) * (h // ys), (w // xs) * (h // ys)


def _length(parms: dict[str, str]) -> tuple[int, int]:
    """Length of a frame in seconds, as numerator and denominator; 0 without a rate."""
    if "F" not in parms:
        return 0, 1
    num, sep, den = parms["F"].partition(":")
    if not (sep and num.isdigit() and den.isdigit() and int(num)):
        raise ValueError(f"bad rate {parms['F']!r}")
    return int(den), int(num)


def seconds(parms: dict[str, str]) -> float:
    """Length of a frame; 0 without a rate."""
    den, num = _length(parms)
    return den / num


def encode(parms: dict[str, str], frames: Iterable[tuple[bytes, bytes, bytes]]) -> bytes:
    sizes = plane_sizes(parms)
    out = [MAGIC + format_params(parms).encode() + b"\n"]
    for planes in frames:
        if tuple(map(len, planes)) != sizes:
            raise ValueError("a plane has another size than its header gives")
        out += [FRAME + b"\n", *planes]
    return b"".join(out)


def _line(stream) -> bytes | None:
    got = stream.readline(MOST_HEADER)
    if not got:
        return None
    if not got.endswith(b"\n"):
        raise ValueError("a header line is too long or cut off")
    return got[:-1]


def decode(stream, first: int = 0, count: int | None = None, header: dict[str, str] | None = None, elapsed: float | None = None) -> Iterator[tuple[int, float, dict[str, str], bytes, bytes, bytes]]:
    """(seq, elapsed, parms, y, cb, cr) of a binary file object; frame headers add to the stream's parameters."""
    if header is None:
        line = _line(stream)
        if line is None:
            return
        if line.split(b" ")[0] != MAGIC:
            raise ValueError("not a YUV4MPEG2 stream")
        header = parse_params(line[len(MAGIC) :])
    seq, elapsed = first, first * seconds(header) if elapsed is None else elapsed
    while count is None or seq < first + count:
        line = _line(stream)
        if line is None:
            return
        if line.split(b" ")[0] != FRAME:
            raise ValueError(f"expected a frame, found {line[:20]!r}")
        parms = header | parse_params(line[len(FRAME) :])
        planes = [stream.read(n) for n in plane_sizes(parms)]
        if tuple(map(len, planes)) != plane_sizes(parms):
            raise ValueError("the stream ends inside a frame")
        yield (seq, elapsed, parms, *planes)
        seq += 1
        elapsed += seconds(parms)


class Range(InputPartition):
    """Frames from ``first`` at byte ``at``, ``elapsed`` seconds in, up to ``count`` of them or byte ``end``."""

    def __init__(self, path: str, first: int, count: int | None, at: int, elapsed: float, end: int | None):
        self.path, self.first, self.count, self.at, self.elapsed, self.end = path, first, count, at, elapsed, end


#: An index: places and times of every INDEXED-th frame and of the end, as pairs of a 64-bit whole and a 64-bit floating number.
INDEX, INDEXED = ".idx", 64


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.step = int(options.get("framesperpartition", "256"))
        self.most_bytes = int(options.get("batchbytes", str(16 << 20)))

    def partitions(self):
        from pyarrow import fs as pafs

        fs, root = _filesystem(self.path)
        info = fs.get_file_info(root)
        every = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root))
        index = {i.path for i in every if i.path.endswith(INDEX)}
        out = []
        for i in sorted((i for i in every if info.type == pafs.FileType.File or i.path.endswith(".y4m")), key=lambda x: x.path):
            if i.path + INDEX in index or (info.type == pafs.FileType.File and fs.get_file_info(i.path + INDEX).type == pafs.FileType.File):
                out += self._indexed(fs, i.path)
            else:
                out += self._even(fs, i)
        return out

    def _indexed(self, fs, path: str):
        import numpy as np

        with fs.open_input_stream(path + INDEX) as f:
            raw = np.frombuffer(f.read(), np.dtype([("at", "<i8"), ("elapsed", "<f8")]))
        every = max(1, self.step // INDEXED)
        marks = [*range(0, len(raw) - 1, every), len(raw) - 1]
        return [Range(path, a * INDEXED, None, int(raw["at"][a]), float(raw["elapsed"][a]), int(raw["at"][b])) for a, b in zip(marks[:-1], marks[1:], strict=True)]

    def _even(self, fs, info):
        """Ranges by division, where every range then begins with a bare frame header; else the file as one."""
        with fs.open_input_file(info.path) as f:
            line = f.read(MOST_HEADER).split(b"\n")[0]
            header = parse_params(line[len(MAGIC) :])
            start, size = len(line) + 1, len(FRAME) + 1 + sum(plane_sizes(header))
            frames, rest = divmod(info.size - start, size)

            def bare(n: int) -> bool:
                f.seek(start + n * size)
                return f.read(len(FRAME) + 1) == FRAME + b"\n"

            firsts = range(0, frames, self.step)
            if rest or not all(bare(a) for a in firsts):
                return [Range(info.path, 0, None, start, 0.0, None)]
        return [Range(info.path, a, min(self.step, frames - a), start + a * size, a * seconds(header), start + min(frames, a + self.step) * size) for a in firsts]

    def read(self, part: Range):
        import io

        import pyarrow as pa

        fs, _ = _filesystem(self.path)
        name = part.path.rsplit("/", 1)[1].removesuffix(".y4m")
        kinds = [pa.int64(), pa.float64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.binary(), pa.binary()]

        def batch(rows):
            cols = [pa.array([name] * len(rows)), *(pa.array([list(r[i].items()) if i == 2 else r[i] for r in rows], k) for i, k in enumerate(kinds))]
            return pa.RecordBatch.from_arrays(cols, names=["stream_id", "seq", "elapsed", "parms", "y", "cb", "cr"])

        with fs.open_input_file(part.path) as raw:
            f = io.BufferedReader(_Raw(raw))
            header = parse_params(_line(f)[len(MAGIC) :])
            f.seek(part.at)
            held, size = [], 0
            for row in decode(f, part.first, part.count, header, part.elapsed):
                held.append(row)
                size += sum(map(len, row[3:]))
                if size >= self.most_bytes:
                    yield batch(held)
                    held, size = [], 0
                if part.count is None and part.end is not None and f.tell() >= part.end:
                    break
            if part.end is not None and f.tell() != part.end:
                raise ValueError(f"{part.path}: frames have parameters and no index tells where they are")
            if held:
                yield batch(held)


class LiveReader(DataSourceStreamReader):
    """Frames of files that grow, and of files that appear: every whole frame once, by its place in its file.

    An offset holds, for each file, the frames seen, the byte after them and their length in seconds, as an exact
    fraction, so that an offset is the same whether it was reached in one step or many. A frame that is not all
    there yet waits, so does a file without its whole header. The driver looks at frame headers only; where they are bare, at one
    in ``framesperpartition``. A file that shrinks below its offset is an error. Files keep their names and are only appended to.
    """

    def __init__(self, options):
        self.batches = Reader(options)
        self.seen: dict[str, list] = {}
        self.starts: dict[str, tuple[int, dict[str, str]]] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        from pyarrow import fs as pafs

        fs, root = _filesystem(self.batches.path)
        for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if i.path.endswith(".y4m"):
                self._look(fs, i.path)
        return {k: list(v) for k, v in self.seen.items()}

    def _start(self, f, path: str) -> tuple[int, dict[str, str]] | None:
        """Where a file's frames begin, and its parameters; None as long as its header is not all there."""
        if path not in self.starts:
            f.seek(0)
            line, end, _ = f.read(MOST_HEADER).partition(b"\n")
            if not end:
                return None
            if line.split(b" ")[0] != MAGIC:
                raise ValueError(f"{path} is not a YUV4MPEG2 stream")
            self.starts[path] = len(line) + 1, parse_params(line[len(MAGIC) :])
        return self.starts[path]

    def _look(self, fs, path: str) -> None:
        """Move the file's offset behind its last whole frame."""
        with fs.open_input_file(path) as f:
            whole = f.size()
            start = self._start(f, path)
            if start is None:
                return
            n, at, elapsed = self.seen.get(path, [0, start[0], "0"])
            elapsed = Fraction(elapsed)
            if whole < at:
                raise ValueError(f"{path} has become shorter than what was read of it")
            bare = FRAME + b"\n"
            size = len(bare) + sum(plane_sizes(start[1]))
            more = (whole - at) // size
            looked = {*range(0, more, self.batches.step), *range(max(0, more - 1), more)}
            rest = at + more * size

            def head(place: int) -> bytes:
                f.seek(place)
                return f.read(MOST_HEADER).partition(b"\n")[0] + b"\n"

            if all(head(at + i * size) == bare for i in looked) and (rest == whole or bare.startswith(head(rest)[: min(len(bare), whole - rest)])):
                n, at, elapsed = n + more, rest, elapsed + more * Fraction(*_length(start[1]))
            else:
                while at < whole:
                    line = head(at)
                    if at + len(line) > whole:
                        break
                    if line.split(b" ")[0].rstrip(b"\n") != FRAME:
                        raise ValueError(f"{path}: expected a frame, found {line[:20]!r}")
                    parms = start[1] | parse_params(line[len(FRAME) :])
                    end = at + len(line) + sum(plane_sizes(parms))
                    if end > whole:
                        break
                    n, at, elapsed = n + 1, end, elapsed + Fraction(*_length(parms))
            self.seen[path] = [n, at, str(elapsed)]

    def partitions(self, start, end):
        fs, _ = _filesystem(self.batches.path)
        out = []
        for path, (n, at, elapsed) in sorted(end.items()):
            with fs.open_input_file(path) as f:
                first, header = self._start(f, path)
            n0, at0, elapsed0 = start.get(path, [0, first, "0"])
            elapsed0 = Fraction(elapsed0)
            size, step = len(FRAME) + 1 + sum(plane_sizes(header)), self.batches.step
            if n <= n0:
                continue
            if at - at0 != (n - n0) * size:
                out.append(Range(path, n0, None, at0, float(elapsed0), at))
                continue
            for a in range(0, n - n0, step):
                b = min(n - n0, a + step)
                out.append(Range(path, n0 + a, b - a, at0 + a * size, float(elapsed0 + a * Fraction(*_length(header))), at0 + b * size))
            self.seen.setdefault(path, [n, at, elapsed])
        return out

    def read(self, partition):
        return self.batches.read(partition)


def _Raw(raw):
    import io

    class Raw(io.RawIOBase):
        def readable(self):
            return True

        def seekable(self):
            return True

        def seek(self, at, whence=0):
            raw.seek(at, whence)
            return raw.tell()

        def tell(self):
            return raw.tell()

        def readinto(self, b):
            got = raw.read(len(b))
            b[: len(got)] = got
            return len(got)

    return Raw()


class Y4mSource(DataSource):
    """``spark.dataSource.register(Y4mSource)``, then ``spark.read.format("y4m").load(path)``, or ``readStream`` to follow a folder."""

    @classmethod
    def name(cls):
        return "y4m"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)

    def streamReader(self, schema):
        return LiveReader(self.options)

    def writer(self, schema, overwrite):
        return Writer(self.options)


class Writer(FileWriter):
    """A file for each run of rows of one stream_id, and an index beside it if its frames have parameters.

    The first frame's parameters head the file; a later frame carries those of its own that differ.
    """

    def store(self, batches, create):
        import struct

        name = out = head = None
        at, elapsed, n, marks, differ = 0, 0.0, 0, [], False

        def close():
            if name is not None and differ:
                create(f"{name}.y4m{INDEX}").write(b"".join(struct.pack("<qd", *m) for m in [*marks, (at, elapsed)]))

        for b in batches:
            for r in b.to_pylist():
                parms = dict(r["parms"])
                if r["stream_id"] != name:
                    close()
                    name, head = r["stream_id"], parms
                    out = create(f"{name}.y4m")
                    line = MAGIC + format_params(head).encode() + b"\n"
                    out.write(line)
                    at, elapsed, n, marks, differ = len(line), 0.0, 0, [], False
                own = {k: v for k, v in parms.items() if head.get(k) != v}
                if n % INDEXED == 0:
                    marks.append((at, elapsed))
                frame = FRAME + format_params(own).encode() + b"\n" + r["y"] + r["cb"] + r["cr"]
                out.write(frame)
                at, elapsed, n, differ = at + len(frame), elapsed + seconds(head | own), n + 1, differ or bool(own)
        close()


def write(frames, path: str) -> None:
    """Write (stream_id, seq, parms, y, cb, cr) as one file for each stream under ``path``; a stream goes through one task in order."""
    frames.sparkSession.dataSource.register(Y4mSource)
    ordered = frames.repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    ordered.selectExpr("cast(stream_id as string) as stream_id", "seq", "parms", "y", "cb", "cr").write.format("y4m").mode("append").save(path)


def png(width: int, height: int, rgb: bytes) -> bytes:
    """An 8-bit RGB image file."""
    import struct
    import zlib

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + rgb[3 * width * y : 3 * width * (y + 1)] for y in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def rgb(parms: dict[str, str], y: bytes, cb: bytes, cr: bytes) -> bytes:
    """Interleaved RGB of a frame: chroma by nearest pixels, then the fixed-point transform of ``colour.b_yuv2rgb``."""
    import numpy as np

    from lumenframe.functions.colour import TO_RGB

    w, h = int(parms["W"]), int(parms["H"])
    xs, ys = SUBSAMPLING[parms.get("C", "420")]
    planes = [np.frombuffer(y, np.uint8).reshape(h, w).astype(np.int64)]
    for p in (cb, cr):
        small = np.frombuffer(p, np.uint8).reshape(h // ys, w // xs)
        big = np.repeat(np.repeat(small, ys, axis=0), xs, axis=1)
        planes.append(np.pad(big, ((0, h - big.shape[0]), (0, w - big.shape[1])), mode="edge").astype(np.int64))
    out = np.zeros((h, w, 3), np.uint8)
    for i, (offset, coefs) in enumerate(TO_RGB):
        total = np.full((h, w), float(offset))
        for p, k in zip(planes, coefs, strict=True):
            total += np.sign(k) * ((p * int(abs(k) * 256)) >> 16)
        out[:, :, i] = np.clip(np.trunc(total), 0, 255)
    return out.tobytes()


class PngWriter(FileWriter):
    """A PNG file for each row (name, parms, y, cb, cr), under its name."""

    def store(self, batches, create):
        for b in batches:
            for r in b.to_pylist():
                parms = dict(r["parms"])
                create(r["name"]).write(png(int(parms["W"]), int(parms["H"]), rgb(parms, r["y"], r["cb"], r["cr"])))


class PngSink(DataSource):
    @classmethod
    def name(cls):
        return "y4m_png"

    def schema(self):
        return "name string, parms map<string,string>, y binary, cb binary, cr binary"

    def writer(self, schema, overwrite):
        return PngWriter(self.options)


def dump(frames, path: str, every: int = 1) -> None:
    """Write every ``every``-th frame of each stream as ``<stream_id>-<number, five digits>.png``; a file a row, wherever the row is."""
    from pyspark.sql import functions as F

    frames.sparkSession.dataSource.register(PngSink)
    few = frames.where(F.col("seq") % every == 0)
    name = F.format_string("%s-%05d.png", F.col("stream_id").cast("string"), F.floor(F.col("seq") / every))
    few.select(name.alias("name"), "parms", "y", "cb", "cr").write.format("y4m_png").mode("append").save(path)
