"""256-bit signatures: eight 32-bit words in longs, the most significant first, and their two text forms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, BITS = 8, 256


def parse(text: Column) -> Column:
    """Words of 64 hexadecimal or 256 binary digits; null for anything else."""
    word = lambda width, base: F.array(*[F.conv(F.substring(text, 1 + width * i, width), base, 10).cast("long") for i in range(WORDS)])
    return F.when(text.rlike("^[0-9a-fA-F]{64}$"), word(8, 16)).when(text.rlike("^[01]{256}$"), word(32, 2))


def to_hex(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 8, "0")), "")


def to_binary(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.lpad(F.bin(w), 32, "0")), "")


def bits_set(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda s, w: s + F.bit_count(w))


def xor(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y))


def distance(a: Column, b: Column) -> Column:
    """Hamming distance."""
    return bits_set(xor(a, b))


def of_values(values: Column) -> Column:
    """Binary text with 1 where a value is over zero; values count to nine decimals, so that ties at zero agree everywhere."""
    return F.array_join(F.transform(values, lambda v: F.when(F.round(v, 9) > 0, "1").otherwise("0")), "")


#: Signatures of a stream that are compared as one block, and blocks of earlier ones that meet the later ones in one task.
BLOCK, GROUP = 2048, 4

#: Later signatures that are compared with a block at once: what a comparison holds does not grow with the rows of a task.
STRIP = 256


def _blocks(signatures: DataFrame, key: str, order: str) -> DataFrame:
    """(key, blk, at, words): signatures of each key in blocks by ``order``, a whole number from 0 up; null ones take no part."""

    def packed(t: pa.Table) -> pa.Table:
        words = np.packbits(np.array([np.frombuffer(s.encode(), np.uint8) - 48 for s in t.column("signature").to_pylist()], np.uint8), axis=1)
        cells = [t.column(key)[0].as_py(), t.column("blk")[0].as_py(), np.asarray(t.column(order)).astype("<i8").tobytes(), words.tobytes()]
        kinds = [t.schema.field(key).type, pa.int64(), pa.binary(), pa.binary()]
        return pa.table([pa.array([c], k) for c, k in zip(cells, kinds, strict=True)], names=[key, "blk", "at", "words"])

    kind = signatures.schema[key].dataType.simpleString()
    t = signatures.where("signature is not null").select(key, order, "signature", F.floor(F.col(order) / BLOCK).cast("long").alias("blk"))
    return t.groupBy(key, "blk").applyInArrow(packed, f"{key} {kind}, blk long, at binary, words binary")


def _compared(signatures: DataFrame, key: str, order: str, emit) -> DataFrame:
    """Rows (key, second, first, bits) that ``emit(distances, ok)`` chooses of each pair of blocks, ok marking the pairs of a row and an earlier one.

    A block goes once to each group of ``GROUP`` blocks up to its own, so a stream's pairs are dealt over as many tasks as it has groups.
    """
    b = _blocks(signatures, key, order).withColumn("_g", F.floor(F.col("blk") / GROUP))
    late = b.select(F.col(key).alias("k"), F.col("blk").alias("b"), F.col("at").alias("a"), F.col("words").alias("w"), F.explode(F.sequence(F.lit(0).cast("long"), "_g")).alias("_h"))
    pairs = late.join(b, F.col("k").eqNullSafe(F.col(key)) & (F.col("_h") == F.col("_g")) & (F.col("blk") <= F.col("b")))

    def run(batches):
        for t in batches:
            for i in range(t.num_rows):
                a, p = (np.frombuffer(t.column(c)[i].as_py(), "<i8") for c in ("a", "at"))
                x, y = (np.frombuffer(t.column(c)[i].as_py(), np.uint64).reshape(len(n), -1) for c, n in (("w", a), ("words", p)))
                for lo in range(0, len(a), STRIP):
                    own, some = a[lo : lo + STRIP], x[lo : lo + STRIP]
                    bits = np.zeros((len(own), len(p)), np.int32)
                    for j in range(x.shape[1]):
                        bits += np.bitwise_count(some[:, j, None] ^ y[None, :, j])
                    r, c = emit(bits, p[None, :] < own[:, None], p)
                    key_ = pa.array([t.column("k")[i].as_py()] * len(r), t.schema.field("k").type)
                    yield pa.RecordBatch.from_arrays([key_, pa.array(own[r]), pa.array(p[c]), pa.array(bits[r, c])], names=[key, "second", "first", "bits"])

    kind = signatures.schema[key].dataType.simpleString()
    return pairs.select("k", "a", "w", "at", "words").mapInArrow(run, f"{key} {kind}, second long, first long, bits int")


def nearest_before(signatures: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order, nearest, bits): for each signature the nearest of all earlier ones of its key, the earliest among equals.

    Exact over streams of any length: blocks of a stream meet in pairs, each giving one row for each later signature.
    """

    def emit(bits, ok, at):
        far = np.where(ok, bits, 1 << 20)
        turn = np.argsort(at, kind="stable")
        c = turn[far[:, turn].argmin(1)]
        r = np.flatnonzero(ok.any(1))
        return r, c[r]

    found = _compared(signatures, key, order, emit).groupBy(key, "second").agg(F.min(F.struct("bits", "first")).alias("m"))
    return found.select(key, F.col("second").alias(order), F.col("m.first").alias("nearest"), F.col("m.bits").alias("bits"))


def pairs_within(signatures: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """(key, first, second, bits): all pairs of a key's signatures that differ in at most ``most`` bits."""
    return _compared(signatures, key, order, lambda bits, ok, at: np.nonzero(ok & (bits <= most))).select(key, "first", "second", "bits")
