"""Streams with state and timers against the same functions over tables: several micro-batches, restarts, late rows."""

import pandas as pd
import pytest

from quillgrid.plans import live
from quillgrid.streaming import sessions, watch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FRAME = "device long, ts timestamp, event_id long, hit boolean"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


@pytest.fixture(scope="module")
def all_frames(spark, sf_dir):
    """Frames in the order of their time, of a few devices, and odd ones."""
    few = live.frames(spark.read.parquet(f"{sf_dir}/events.parquet")).where("device < 21").collect()
    rows = sorted((r["ts"], r["event_id"], r["device"], r["hit"]) for r in few)
    base = pd.Timestamp("2024-01-01")
    at = lambda ms: (base + pd.Timedelta(milliseconds=ms)).to_pydatetime()
    odd = [(at(0), 1, 900, False), (at(299), 2, 900, False), (at(300), 3, 900, False), (at(300), 4, 900, False), (at(10_300), 5, 900, False), (at(20_301), 6, 900, True), (at(20_400), 7, 900, True), (at(99_999), 8, 900, False)]
    odd += [(at(5), 9, 901, True), (at(6), 10, 901, True), (at(7), 11, 902, None)]
    return [(d, t, i, h) for t, i, d, h in rows] + [(d, t, i, h) for t, i, d, h in odd]


def told(df):
    return sorted((r["device"], r["kind"], r["at"], r["event_id"] or 0) for r in df.collect())


def plain(frames, until):
    """A loop over each device's frames."""
    out, by = [], {}
    for d, t, i, h in frames:
        if d is not None and t is not None and i is not None:
            by.setdefault(d, []).append((pd.Timestamp(t), i, bool(h)))
    for d, rows in by.items():
        taken, seen, closed = None, None, False
        for t, i, h in sorted(rows):
            if seen is not None and t - seen > pd.Timedelta(seconds=10):
                out.append((d, "silent", seen + pd.Timedelta(seconds=10), 0))
            seen = t
            if taken is None or t - taken >= pd.Timedelta(milliseconds=300):
                taken = t
                out.append((d, "match" if h else "taken", t, i))
                if h:
                    closed = True
                    break
        if not closed and until - seen >= pd.Timedelta(seconds=10):
            out.append((d, "silent", seen + pd.Timedelta(seconds=10), 0))
    return sorted((d, k, t.to_pydatetime(), i) for d, k, t, i in out)


def test_table_is_the_plain_loop(spark, all_frames):
    frames = spark.createDataFrame([*all_frames, (None, all_frames[0][1], 5, True), (3, None, 6, True)], FRAME)
    until = max(pd.Timestamp(t) for _, t, _, _ in all_frames)
    got = told(watch.watched(frames))
    assert got == plain(all_frames, until)
    assert {k for _, k, _, _ in got} == {"taken", "match", "silent"}
    assert told(watch.watched(frames.limit(0))) == []


def deal(spark, rows, folder, n):
    """Rows as one more file of the stream's folder."""
    spark.createDataFrame(rows, FRAME).coalesce(1).write.mode("append").parquet(folder)
    return n


def test_stream_is_the_table(rocks, all_frames, tmp_path):
    """Three starts, each from the checkpoint of the one before, over more and more files in disorder within the watermark."""
    spark, folder, out, kept = rocks, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "kept")
    frames = sorted(all_frames, key=lambda f: f[1])
    third = len(frames) // 3
    cuts = [frames[third - 5 : third] + frames[: third - 8], frames[third - 8 : third - 5][::-1] + frames[third : 2 * third], frames[2 * third :]]
    end = max(f[1] for f in frames)
    flush = [(999, (pd.Timestamp(end) + pd.Timedelta(hours=1)).to_pydatetime(), 10**6, False)]
    for rows in (*cuts, flush):
        deal(spark, rows, folder, 0)
        stream = watch.watch(spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(folder), late="2 hours" if rows is not flush else "0 seconds")
        watch.written(stream, out, kept).start().awaitTermination()
    got = [r for r in told(spark.read.schema(watch.TOLD).parquet(out)) if r[0] != 999]
    assert got == plain(frames, pd.Timestamp(end) + pd.Timedelta(minutes=30))


def test_timer_fires_without_a_later_frame_and_state_goes_at_the_end(rocks, tmp_path):
    spark, folder, out, kept = rocks, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "kept")
    base = pd.Timestamp("2024-01-01")
    at = lambda s: (base + pd.Timedelta(seconds=s)).to_pydatetime()
    for rows in ([(1, at(0), 1, False), (2, at(0), 2, True)], [(3, at(60), 3, False)], [(2, at(61), 4, True), (3, at(62), 5, False)]):
        deal(spark, rows, folder, 0)
        watch.written(watch.watch(spark.readStream.schema(FRAME).parquet(folder)), out, kept).start().awaitTermination()
    got = told(spark.read.schema(watch.TOLD).parquet(out))
    assert (1, "silent", at(10), 0) in got  # no later frame of device 1, only the watermark
    assert [r for r in got if r[0] == 2] == [(2, "match", at(0), 2)]
    state = lambda name: {r["key"]["device"] for r in spark.read.format("statestore").option("stateVarName", name).load(kept).select("key").collect()}
    assert 2 in state("closed") and 2 not in state("last")


def test_late_frames_are_dropped(rocks, tmp_path):
    spark, folder, out, kept = rocks, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "kept")
    base = pd.Timestamp("2024-01-01")
    at = lambda s: (base + pd.Timedelta(seconds=s)).to_pydatetime()
    for rows in ([(1, at(100), 1, False)], [(1, at(50), 2, True), (1, at(101), 3, False)], [(1, at(500), 4, False)], [(1, at(900), 5, False)]):
        deal(spark, rows, folder, 0)
        watch.written(watch.watch(spark.readStream.schema(FRAME).parquet(folder)), out, kept).start().awaitTermination()
    assert 2 not in {r[3] for r in told(spark.read.schema(watch.TOLD).parquet(out))}


def asked(df, key="device"):
    return sorted((r[key], r["begin"], r["due"], r["event_id"], r["requests"]) for r in df.collect())


def test_sessions_of_stream_and_table(spark, all_frames, tmp_path):
    """Four starts, three of them from a checkpoint; the last row only moves the watermark, and a late one changes nothing."""
    folder, out, kept = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "kept")
    rows = sorted([f for f in all_frames if f[2] is not None], key=lambda f: f[1])
    third = len(rows) // 3
    end = pd.Timestamp(rows[-1][1])
    flush = [(999, (end + pd.Timedelta(hours=1)).to_pydatetime(), 10**6, False)]
    late = [(900, rows[0][1], 77, False), (999, (end + pd.Timedelta(hours=2)).to_pydatetime(), 10**6 + 1, False)]
    for part in (rows[:third], rows[third : 2 * third], rows[2 * third :], flush, late):
        deal(spark, part, folder, 0)
        told_ = sessions.debounced(spark.readStream.schema(FRAME).option("maxFilesPerTrigger", 1).parquet(folder), "device", late="1 second")
        told_.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination()
    batch = asked(sessions.debounced(spark.createDataFrame(rows, FRAME), "device"))
    assert [r for r in asked(spark.read.parquet(out)) if r[0] != 999] == batch
    assert any(n > 1 for *_, n in batch)


def test_session_edges(spark):
    at = lambda ms: (pd.Timestamp("2024-01-01") + pd.Timedelta(milliseconds=ms)).to_pydatetime()
    rows = [(1, at(0), 1), (1, at(150), 2), (1, at(150), 9), (1, at(301), 3), (None, at(0), 4), (2, None, 5), (2, at(7), 6)]
    got = asked(sessions.debounced(spark.createDataFrame(rows, "user_id long, ts timestamp, event_id long")), "user_id")
    assert [(k, i, n) for k, _, _, i, n in got] == [(1, 9, 3), (1, 3, 1), (2, 6, 1)]
    assert (got[0][2] - got[0][1]).total_seconds() == pytest.approx(0.3)
