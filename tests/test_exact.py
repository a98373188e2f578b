"""Results whose last bits count, against their SQL on rows that bring it out."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import parse
from lumenframe.functions import signature as sig
from lumenframe.operators import planes, spectral
from lumenframe.plans import catalog


def same(spark, folder, name, table, rows):
    pq.write_table(rows, folder / f"{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder / table}.parquet'")
    got = con.execute(catalog.ORACLES[name])
    cols = [c[0] for c in got.description]
    want = sorted(map(repr, got.fetchall()))
    assert want and sorted(repr(tuple(r)) for r in catalog.QUERIES[name](spark, str(folder)).select(*cols).collect()) == want


@pytest.mark.parametrize("name", ["make_profile", "normalise", "signature", "signature_std"])
def test_bins_that_cancel_out(spark, tmp_path, name):
    """In every other frame of a stream a quarter turn comes out as the same sum on each axis, so that bin 15 is rounding noise."""
    x = np.random.default_rng(3).integers(-40, 40, (12, 16, 4))
    x[::2, 15] += (x[::2].sum(1)[:, [2, 3, 2, 3]] - x[::2].sum(1)) * [1, 1, 0, 0]
    flat = np.clip(x.reshape(12, 64), -128, 127) / 128.0
    rows = pa.table({"vec_id": pa.array(range(12), pa.int64()), "embedding": pa.array(flat.tolist(), pa.list_(pa.float32())), "label": pa.array([i // 6 for i in range(12)], pa.int32())})
    same(spark, tmp_path, name, "embeddings", rows)


def test_magnitudes_equal_sql_to_the_last_bit():
    x = np.random.default_rng(5).integers(-40, 40, (3000, 64)) / 128.0
    con = duckdb.connect()
    con.register("s", pa.table({"f": np.repeat(np.arange(3000), 64), "pos": np.tile(np.arange(64), 3000), "v": x.ravel()}))
    part = "power(sum(v * {}(2 * pi() * k * pos / 64) ORDER BY pos), 2)"
    sql = f"SELECT sqrt({part.format('cos')} + {part.format('sin')}) AS m FROM s, range(1, 32) t(k) GROUP BY f, k ORDER BY f, k"
    assert np.array_equal(spectral._summed(x).ravel(), con.execute(sql).fetchnumpy()["m"])


def test_timecodes_of_many_hours(spark, tmp_path):
    rows = pa.table({"event_id": pa.array([943316, 1004622, 1019497, 7, None], pa.int64()), "value": [451.9, 212.2, 209.45, 0.15, 1.0]})
    same(spark, tmp_path, "timecode", "events", rows)


def test_clock_rounds_as_a_double(spark):
    t = np.nextafter(6e10, 0)
    want = duckdb.execute("SELECT CAST(floor(round(?, 6)) AS BIGINT)", [float(t)]).fetchone()[0]
    h, m, s = spark.range(1).select(parse.clock(F.lit(float(t))).alias("c")).first()["c"].split(":")
    assert round((int(h) * 3600 + int(m) * 60 + float(s)) * 1000) == want


def test_comparisons_hold_few_rows_at_once(spark, monkeypatch):
    rng = np.random.default_rng(4)
    bits = rng.integers(0, 2, (700, 256))
    df = spark.createDataFrame([(1, i, "".join(map(str, r))) for i, r in enumerate(bits.tolist())], "stream_id long, seq long, signature string")

    def emit(d, ok, at):
        assert len(d) <= sig.STRIP
        return np.nonzero(ok)

    assert sig._compared(df, "stream_id", "seq", emit).count() == 700 * 699 // 2
    far = (bits[:, None, :] != bits[None, :, :]).sum(2)
    got = {r["seq"]: (r["nearest"], r["bits"]) for r in sig.nearest_before(df, "stream_id", "seq").collect()}
    assert got == {i: (int(far[i, :i].argmin()), int(far[i, :i].min())) for i in range(1, 700)}


def test_frames_are_unpacked_in_pieces():
    b = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([bytes(planes.UNPACKED // 8)] * 100)], names=["seq", "y"])
    some = list(planes.pieces(b))
    assert max(x.num_rows for x in some) <= 8 and pa.Table.from_batches(some).equals(pa.Table.from_batches([b]))
    assert list(planes.pieces(b.slice(0, 0))) == []
