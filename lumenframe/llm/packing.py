"""Packing by concatenate and cut.

Pass one tokenises every document once, writes the ids to the shared folder, and sums tokens by partition. The running
sum of those totals, a row for each partition, gives each partition its global offset. Pass two cuts every document at the
window boundaries it crosses, with no exchange of ids: a document's place is its partition's offset plus its own within.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lumenframe.llm.common import Workspace, arrow_rows, spread, stage_workspace


class ByteBpe:
    """Ids of a byte-level BPE file of ``tokenizers``.

    The file's vocabulary and split pattern also run in tiktoken, several times as fast; texts with a special token or with
    characters outside UTF-8 go through ``tokenizers`` itself, as does everything when the file is of another kind.
    """

    #: Fixed value: the split pattern that the byte-level pre-tokenizer stands for.
    PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

    def __init__(self, path: str):
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        plain = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.fast = self._encoding(spec) if plain else None

    def _encoding(self, spec: dict):
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown}
        back |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in set(self.special)}
        # ids must rise in the order of the merges for ranks to stand for them
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:])) or (merged and merged[0] < len(vocab) - len(merged)):
            return None
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        try:
            return self.fast.encode_ordinary(text)
        except (KeyboardInterrupt, SystemExit):
            raise
        except BaseException:  # its pattern engine panics on runs of about a million spaces
            return self.slow.encode(text, add_special_tokens=False).ids


def tokenise(docs: DataFrame, tokenizer: str | None = None, end: int = 1) -> DataFrame:
    """(doc_id, ids as little-endian 32-bit numbers with ``end`` appended, part, local): local counts the tokens before it in its partition."""
    arrow_rows(docs.sparkSession)

    def run(batches):
        import public_tokenizers
        from pyspark import TaskContext

        bpe = ByteBpe(tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
        part, at, close = TaskContext.get().partitionId(), 0, np.array([end], "<u4")
        for b in batches:
            ids, local, known = [], [], {}
            for t in b.column("text").to_pylist():
                t = t or ""
                if t not in known:
                    known[t] = np.concatenate([np.array(bpe.encode(t), "<u4"), close]).tobytes()
                ids.append(known[t])
                local.append(at)
                at += len(known[t]) // 4
            cols = [b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([part] * len(ids), pa.int32()), pa.array(local, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "part", "local"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, part int, local long")


def pack(docs: DataFrame, ws: Workspace, window: int = 2048, **how) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset. Every sequence but the last is full."""
    rows = ws.write(tokenise(docs, **how), "tokens")
    totals = rows.groupBy("part").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("tokens"))
    # a row for each input partition, so one task sums them
    base = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(ws.write(totals.select("part", base.alias("base")), "totals"), "part")
    placed = placed.select("doc_id", "ids", (F.col("base") + F.col("local")).alias("at"))

    def cut(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            rows_at = []
            for i, (ids, at) in enumerate(zip(b.column("ids").to_pylist(), b.column("at").to_pylist(), strict=True)):
                n, start = len(ids) // 4, 0
                while start < n:
                    seq, off = divmod(at + start, window)
                    length = min(n - start, window - off)
                    rows_at.append(i)
                    for x, v in zip(out, (start, length, ids[4 * start : 4 * (start + length)], n, seq, off), strict=True):
                        x.append(v)
                    start += length
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            cols = [b.column("doc_id").take(pa.array(rows_at, pa.int64())), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece.

    Null and empty texts are the end id alone. Null doc_ids and repeated rows are packed like any other row. Empty table: no rows.
    """
    ws = Workspace(spark, "packing")
    return ws.finish(digest(pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), ws)))


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of every document with their ids; other columns go.

    Null and empty texts are the end id alone. Null doc_ids and repeated rows are packed like any other row.
    """
    return pack(docs.select("doc_id", "text"), stage_workspace(spark, "packing", docs))
