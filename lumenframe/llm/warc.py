"""Deterministic sharded WARC archives.

Records are range-sorted by key into shards whose bounds depend on the data alone. Each shard is written as gzip members,
one for each record, into files that roll at a compressed size. Headers, record ids and digests are made anew from the
record, with a fixed date, so the same input gives the same bytes; only rows that agree in all columns are parted by where they stood. A task writes under names of its own attempt; the driver
renames the files of the attempts that succeeded and then publishes a manifest. Only files in the manifest are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.common import Workspace, arrow_rows

#: Fixed value: the profile of a revisit by payload digest in WARC 1.1.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("6f0c3c58-0c0e-5f0a-9a55-4a4f8d0f6b11")


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{key}/{digest}')}>"


def record(key: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """An uncompressed response record, or a revisit without its payload where ``refers_to`` is given."""
    sha = hashlib.sha1(payload).digest()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or "") or f"urn:page:{key}"
    b32 = lambda b: "sha1:" + base64.b32encode(b).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(key, sha.hex())}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: {b32(sha)}",
        f"WARC-Block-Digest: {b32(hashlib.sha1(block).digest())}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if key is not None:
        head.append(f"X-Record-Key: {key}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, sha.hex())}", f"X-Refers-To-Key: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(stream, chunk: int = 1 << 20):
    """(headers, block) of each gzip member of a stream, checked against its block digest."""
    held = b""
    while True:
        if not held and not (held := stream.read(chunk)):
            return
        z, out = zlib.decompressobj(31), []
        while not z.eof:
            if not held and not (held := stream.read(chunk)):
                raise ValueError("the archive ends inside a record")
            out.append(z.decompress(held))
            held = z.unused_data
        head, _, rest = b"".join(out).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        names = dict(x.split(": ", 1) for x in lines[1:])
        block = rest[: int(names["Content-Length"])]
        if "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode() != names["WARC-Block-Digest"]:
            raise ValueError(f"the block of {names['WARC-Record-ID']} does not match its digest")
        yield names, block


#: Payload groups up to which their table is sent to all executors, about 100 bytes each.
MOST_SENT = 100_000


def decide(pages: DataFrame, ws: Workspace, least: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, refers_to: of equal payloads of ``least`` bytes or more, rows of the largest page_id answer, the others revisit it.

    Groups are counted without their payloads, with partial sums before the exchange. Where they are few, their table goes
    to the pages and payloads stay where they are.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    groups = rows.where(F.col("n") >= least).groupBy("digest", "n").agg(F.max("page_id").alias("top"), F.count("*").alias("copies")).where("copies > 1")
    groups = ws.write(groups.select(F.col("digest").alias("_d"), F.col("n").alias("_n"), "top"), "groups")
    if groups.count() <= MOST_SENT:
        groups = F.broadcast(groups)
    rows = rows.join(groups, (rows["digest"] == F.col("_d")) & (rows["n"] == F.col("_n")), "left")
    other = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return rows.select("page_id", "url", "payload", "digest", F.when(other, F.col("top")).alias("refers_to"))


def place() -> F.Column:
    """Text that sorts as the records do: by page_id, null first, then payload, url and a number that parts equal rows."""
    number = F.lpad(F.hex(F.col("page_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    rest = F.concat(F.substring("digest", 1, 12), F.lpad(F.hex(F.xxhash64("url")), 16, "0"), F.lpad(F.hex(F.pmod("_n", F.lit(256))), 2, "0"))
    return F.concat(F.coalesce(number, F.lit("!")), rest)


def bounds(rows: DataFrame, shard_bytes: int, sample_rows: int = 20_000) -> list[str]:
    """Places that start shards 1, 2, ...: quantiles by payload bytes of a sample chosen by a hash of the place, in expected number ``sample_rows``."""
    size = F.octet_length("payload")
    total = rows.agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    shards = -(-(total["b"] or 0) // shard_bytes)
    if shards < 2:
        return []
    share = min(1.0, sample_rows / total["n"])
    few = rows.where(F.pmod(F.xxhash64("place"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    got = sorted((r[0], r[1]) for r in few.select("place", size).collect())
    if not got:
        return []
    sums = np.cumsum([x[1] for x in got])
    at = np.searchsorted(sums, sums[-1] * np.arange(1, shards) / shards)
    return sorted({got[i][0] for i in at})


def write(pages: DataFrame, out: str, ws: Workspace, shard_bytes: int = 32 << 20, roll_bytes: int = 16 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html) under the folder ``out`` and return the manifest's rows: file, records, bytes, sha1."""
    spark = ws.spark
    arrow_rows(spark, 500)
    rows = ws.write(decide(pages, ws).withColumn("_n", F.monotonically_increasing_id()).withColumn("place", place()).drop("_n"), "records")
    starts = np.array(bounds(rows, shard_bytes), "S64")

    @F.pandas_udf("int")
    def shard_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(starts, key.to_numpy().astype("S64"), side="right").astype("int32"))

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(out)
        temp = f"{root}/_temporary/{uuid.uuid4().hex}"
        shard, seq, stream, done = None, 0, None, []

        def close():
            stream.close()
            done.append((shard, seq, name, size, count, sha.hexdigest()))

        for b in batches:
            for key, url, payload, refers, s in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to", "shard")), strict=True):
                if stream is not None and (s != shard or size >= roll_bytes):
                    close()
                    stream = None
                if s != shard:
                    shard, seq = s, -1
                if stream is None:
                    seq += 1
                    fs.create_dir(temp, recursive=True)
                    name, size, count, sha = f"{temp}/{shard:06d}-{seq:06d}.warc.gz", 0, 0, hashlib.sha1()
                    stream = fs.open_output_stream(name, compression=None)
                z = zlib.compressobj(6, wbits=31)
                member = z.compress(record(key, url, payload, refers, date)) + z.flush()
                stream.write(member)
                sha.update(member)
                size += len(member)
                count += 1
        if stream is not None:
            close()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        cols = [pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(cols, names=["shard", "seq", "temp", "bytes", "records", "sha1"])

    dealt = rows.withColumn("shard", shard_of("place")).repartitionById(len(starts) + 1, "shard")
    dealt = dealt.sortWithinPartitions("shard", "place")
    written = ws.write(dealt.mapInArrow(run, "shard int, seq int, temp string, bytes long, records long, sha1 string"), "written")
    fs, root = pafs.FileSystem.from_uri(out)
    manifest = []
    for r in sorted(written.collect()):  # a row for each file
        name = f"part-{r['shard']:06d}-{r['seq']:06d}.warc.gz"
        fs.move(r["temp"], f"{root}/{name}")
        manifest.append({"file": name, "records": r["records"], "bytes": r["bytes"], "sha1": r["sha1"]})
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/_manifest.tmp", compression=None) as f:
        f.write("".join(json.dumps(m) + "\n" for m in manifest).encode())
    fs.move(f"{root}/_manifest.tmp", f"{root}/manifest.jsonl")
    if fs.get_file_info(f"{root}/_temporary").type == pafs.FileType.Directory:
        fs.delete_dir(f"{root}/_temporary")
    return spark.createDataFrame([tuple(m.values()) for m in manifest], "file string, records long, bytes long, sha1 string")


def read(spark: SparkSession, out: str) -> DataFrame:
    """Records of the files that the manifest in ``out`` lists: page_id, url, record_type, payload (null for revisits), payload_bytes, payload_digest, refers_to."""
    files = spark.read.schema("file string, records long, bytes long, sha1 string").json(f"{out}/manifest.jsonl")
    n = max(1, files.count())
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"

    def run(batches):
        fs, root = pafs.FileSystem.from_uri(out)
        for b in batches:
            for file, records in zip(b.column("file").to_pylist(), b.column("records").to_pylist(), strict=True):
                seen, held = 0, []
                with fs.open_input_stream(f"{root}/{file}", compression=None) as f:
                    for names, block in parse(f):
                        seen += 1
                        held.append(_row(names, block))
                        if len(held) == 500:
                            yield _batch(held)
                            held = []
                if seen != records:
                    raise ValueError(f"{file} has {seen} records; the manifest says {records}")
                if held:
                    yield _batch(held)

    return files.repartition(n).mapInArrow(run, schema)


def _row(names: dict, block: bytes) -> tuple:
    number = lambda k: int(names[k]) if k in names else None
    head = (number("X-Record-Key"), names["WARC-Target-URI"], names["WARC-Type"])
    digest = base64.b32decode(names["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if head[2] == "revisit":
        return (*head, None, number("X-Payload-Length"), digest, number("X-Refers-To-Key"))
    payload = block.partition(b"\r\n\r\n")[2]
    if hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {names['WARC-Record-ID']} does not match its digest")
    return (*head, payload, len(payload), digest, None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
    names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to for every row, read back from the archives.

    Null html is an empty payload. Rows that share the largest page_id of their payload are all responses. A null page_id
    is never the largest unless the group has no other; a null url becomes urn:page. Empty table: an empty manifest, no rows.
    """
    ws = Workspace(spark, "warc")
    out = f"{ws.root}/archive"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), out, ws)
    back = read(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return ws.finish(back)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, payload, octet_length(encode(payload)) AS payload_bytes FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS top FROM d)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM m
"""
