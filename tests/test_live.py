"""Streams over files that grow."""

from lumenframe.sources import y4m


def frames_of(parms, lo, hi, marked=()):
    head = y4m.encode(parms, [])
    out = b""
    for i in range(lo, hi):
        raw = y4m.encode(parms, [(bytes([i] * 4),) * 3])[len(head) :]
        out += raw.replace(b"FRAME\n", b"FRAME F50:1\n", 1) if i in marked else raw
    return head, out


def batch(spark, folder, state):
    """Run the stream over what is there, as a new query on the same state; what it read."""
    got = []

    def keep(df, _):
        got.extend(df.select("stream_id", "seq", "elapsed", "y").collect())

    q = spark.readStream.format("y4m").option("framesperpartition", 4).load(str(folder)).writeStream.option("checkpointLocation", str(state)).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return sorted((r.stream_id, r.seq, round(r.elapsed, 6), r.y[0]) for r in got)


def test_appended_frames_arrive_once_across_restarts(spark, tmp_path):
    spark.dataSource.register(y4m.Y4mSource)
    folder, state, parms = tmp_path / "in", tmp_path / "state", {"W": "2", "H": "2", "C": "444", "F": "25:1"}
    folder.mkdir()
    head, raw = frames_of(parms, 0, 10)
    (folder / "a.y4m").write_bytes(head + raw + b"FRA")  # a frame not all there
    (folder / "b.y4m").write_bytes(head[:6])  # nor a header
    assert batch(spark, folder, state) == [("a", i, round(i / 25, 6), i) for i in range(10)]
    _, more = frames_of(parms, 10, 13, marked=(11,))
    with open(folder / "a.y4m", "ab") as f:
        f.write(more[3:])
    with open(folder / "b.y4m", "ab") as f:
        f.write(head[6:] + frames_of(parms, 0, 1)[1])
    assert batch(spark, folder, state) == [("a", 10, 0.4, 10), ("a", 11, 0.44, 11), ("a", 12, 0.46, 12), ("b", 0, 0.0, 0)]
    assert batch(spark, folder, state) == []
    with open(folder / "a.y4m", "ab") as f:
        f.write(frames_of(parms, 13, 20)[1])
    assert batch(spark, folder, state) == [("a", i, round(0.5 + (i - 13) / 25, 6), i) for i in range(13, 20)]


def test_offsets_do_not_depend_on_when_they_are_taken(tmp_path):
    """A reader that starts anew finds the places that one which followed the file has."""
    parms = {"W": "2", "H": "2", "C": "444", "F": "25:1"}
    head, raw = frames_of(parms, 0, 30, marked=(7, 8, 20))
    every = head + raw
    follows, at = y4m.LiveReader({"path": str(tmp_path), "framesperpartition": "4"}), 0
    for cut in (5, 60, 61, 200, 333, 400, len(every)):
        with open(tmp_path / "s.y4m", "ab") as f:
            f.write(every[at:cut])
        at = cut
        now = follows.latestOffset()
        assert now == y4m.LiveReader({"path": str(tmp_path), "framesperpartition": "4"}).latestOffset()
    assert list(now.values())[0][:2] == [30, len(every)]
