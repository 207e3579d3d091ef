"""Streams: order, lateness, state that ends, progress, cancelling, one scan at a time."""

import json
import time

import pytest
from pyspark.sql import functions as F

from legilens.operators import frames, incidents
from legilens.sources import events
from legilens.streaming import session
from legilens.streaming import scan as streams

KEY = "sk-proj-T3xK9mPq2LvR8wZa5NbYc7Hd"


def line(kind, rec, **more):
    return json.dumps({"type": kind, "recording_id": rec, **more})


def frame(rec, i, text=None, **more):
    return line("frame", rec, frame_index=i, timestamp_ms=1000 * i, **({"text": text} if text is not None else {"skipped": True}), **more)


def arriving(spark, path, parts):
    for part in parts:
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").text(str(path))
        yield


def test_any_order_of_arrival(spark, tmp_path):
    """Frames in disorder, ends that come first but say how many frames to wait for: as the batch has it."""
    texts = {0: "a", 1: None, 2: KEY, 3: None, 4: "", 5: None, 6: "b " + KEY, 7: None}
    lines = [frame("r", i, t) for i, t in texts.items()] + [frame("s", i, KEY) for i in (0, 1)]
    parts = [[lines[3], lines[0], line("done", "r", frames_scanned=8), lines[6]], [lines[7], lines[2], lines[9]], [lines[1], lines[5], lines[4], lines[8], line("done", "s")]]
    got = streams.scan(spark, str(tmp_path / "in"), arriving(spark, tmp_path / "in", parts), delay=10_000)
    rows = events.frames_of(events.parsed(spark.createDataFrame([(x,) for x in lines], "value string")))
    want = incidents.incidents(incidents.frame_findings(frames.carry_forward(rows)))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect())) and got.count() == 2


def test_late_frames_are_dropped_and_counted(spark, tmp_path):
    path = tmp_path / "in"
    parts = [[frame("r", i, f"t{i}") for i in (0, 1, 4, 6)], [frame("r", i, f"t{i}") for i in (2, 5, 7)], [frame("r", 3, "t3"), line("done", "r")]]
    rows = streams.appended(streams.carry_forward(events.frames_and_ends(events.stream_events(spark, str(path))), delay=2000), "c", arriving(spark, path, parts)).collect()
    # After the first part frames up to 4 are taken, as 6 is the latest and waits for 2 s.
    assert sorted(r.frame_index for r in rows if r.text is not None) == [0, 1, 4, 5, 6, 7]
    assert [r.late for r in rows if r.done] == [2]


def states(query):
    return sum(s.numRowsTotal for p in query.recentProgress[-1:] for s in p.stateOperators)


@pytest.mark.parametrize("kind", ["carry", "gate"])
def test_state_ends_with_a_timer_or_the_end(spark, tmp_path, kind):
    """A recording without an end is ended when it is silent; one with an end leaves nothing behind."""
    path, progress, out = tmp_path / "in", str(tmp_path / "progress"), []
    schema = "recording_id string, frame_index bigint, timestamp_ms bigint, text string, skipped boolean, hash array<bigint>, done boolean"
    path.mkdir()
    rows = spark.readStream.schema(schema).parquet(str(path))
    made = streams.carry_forward(rows, delay=5000, idle=1500) if kind == "carry" else streams.skip_gate(rows, delay=5000, idle=1500)
    run = lambda: streams.run_to_end(made, lambda batch, n: out.extend(batch.collect()), progress)
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    one = lambda rec, i: (rec, i, 1000 * i, f"t{i}", False, [i, 0, 0, 0], False)
    put([one("a", i) for i in range(8)] + [one("b", 0), one("c", 0), ("c", None, None, None, None, None, True)])
    first = run()
    assert states(first) > 0 and {r.recording_id for r in out if r.done} == {"c"}
    time.sleep(2)
    put([("d", None, None, None, None, None, True)])
    run()  # its timers have passed
    put([("e", None, None, None, None, None, True)])
    last = run()
    assert {r.recording_id for r in out if r.done} == {"a", "b", "c", "d", "e"} and states(last) == 0
    assert sorted(r.frame_index for r in out if r.recording_id == "a" and r.frame_index is not None) == list(range(8))


def test_progress(spark, tmp_path):
    texts = [KEY if i in (3, 4, 12, 13, 25) else f"t{i}" for i in range(30)]
    lines = [line("meta", "r", total_frames=30)] + [frame("r", i, t) for i, t in enumerate(texts)]
    path = tmp_path / "in"
    got = streams.progress(spark, str(path), arriving(spark, path, [lines[:8], lines[8:23], [*lines[23:], line("done", "r")]]))
    assert sorted(map(tuple, got.collect())) == [("r", 9, 10, 33, 1), ("r", 19, 20, 67, 2), ("r", 29, 30, 100, 3)]


def test_cancelled_scan_has_a_valid_result(spark, tmp_path):
    """What had come when it was cancelled, frames that waited included; nothing after it."""
    path = tmp_path / "in"
    arrivals = arriving(spark, path, [[line("meta", "r", duration_ms=9000, total_frames=9), *[frame("r", i, KEY if i > 1 else "x") for i in range(4)], frame("q", 0, "no")], [frame("r", 4, KEY), line("done", "r")]])
    scan = session.Scan(spark, str(path), "one recording", delay=3_600_000)
    assert not scan.cancel() and scan.incidents().count() == 0
    next(arrivals)
    scan.start().awaitTermination()
    assert scan.counts().agg(F.sum("frames")).first()[0] == 0  # all wait
    assert scan.cancel() and not scan.cancel() and not scan.running()
    (one,) = scan.incidents().collect()
    assert (one.pattern_id, one.first_seen_ms, one.last_seen_ms, one.frame_count) == ("openai_project", 2000, 3000, 2)
    result = {r.recording_id: json.loads(r.result) for r in scan.result().collect()}
    assert result["r"]["cancelled"] and result["r"]["frames_scanned"] == 4 and result["r"]["duration_ms"] == 9000 and result["r"]["frames_ocred"] == 4
    assert result["q"]["cancelled"] and "incidents" not in result["q"]
    with pytest.raises(RuntimeError, match="cancelled"):
        scan.start()


def test_one_scan_of_a_name_at_a_time(spark, tmp_path):
    path = tmp_path / "in"
    next(arriving(spark, path, [[frame("r", 0, KEY), line("done", "r")]]))
    first, second, other = (session.Scan(spark, str(path), name) for name in ("x", "x", "y"))
    first.start(processingTime="1 second")
    try:
        assert first.running()
        with pytest.raises(session.AlreadyRunning, match="scan of x is already running"):
            second.start()
        other.start().awaitTermination()
        for _ in range(60):
            if first.incidents().count():
                break
            time.sleep(1)
    finally:
        first.cancel()
    assert first.incidents().count() == 1 and other.incidents().count() == 1
    assert sum(o["frames"] for o in other.observed()) == 1
    second.start().awaitTermination()
    assert second.incidents().count() == 1 and not second.cancelled


def test_shared_folder_is_demanded_on_a_cluster(spark, monkeypatch):
    from legilens.sources import scratch

    class Elsewhere:
        master, applicationId = "spark://host:7077", "app"

    class Session:
        sparkContext = Elsewhere()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.scratch(Session(), "x")
    assert scratch.scratch(spark, "x").rpartition("/")[0] == scratch.scratch(spark, "y").rpartition("/")[0]


def test_sampled_frames(spark):
    """Ties to the earlier frame, then the smaller identifier; half an interval is near enough, more is not; gaps stay; a frame may serve two samples."""
    of = spark.createDataFrame([("a", 4.0), ("b", 0.0), ("c", 3.0)], "recording_id string, duration_s double")
    at = [("a", 100, 1), ("a", 900, 2), ("a", 1100, 3), ("a", 1100, 4), ("a", 2501, 5), ("a", 4000, 6), ("b", 400, 7), ("c", 500, 8), ("c", 2500, 9), ("x", 0, 10)]
    rows = spark.createDataFrame(at, "recording_id string, timestamp_ms bigint, frame int")
    got = sorted((r.recording_id, r.i, r.timestamp_ms, r.frame) for r in frames.sampled_frames(of, rows).collect())
    assert got == [("a", 0, 100, 1), ("a", 1, 900, 2), ("a", 3, 2501, 5), ("b", 0, 400, 7), ("c", 0, 500, 8), ("c", 1, 500, 8), ("c", 2, 2500, 9)]


def test_last_sessions_close(spark, tmp_path):
    """The sessions that are open when the last rows come are given too, those of null keys among them; one that ends later than the clock is not."""
    gap, path = 1000, str(tmp_path / "in")
    schema = "k string, at timestamp, clock boolean"
    told = [("a", 10.0), ("a", 10.5), ("a", 12.0), (None, 12.0), ("b", 12.5)]

    def arrivals():
        for part in (told[:2], told[2:], [("", 13.2)]):
            rows = spark.createDataFrame([(k or None, at, k == "") for k, at in part], "k string, at double, clock boolean")
            rows.withColumn("at", F.timestamp_millis((F.col("at") * 1000).cast("long"))).coalesce(1).write.mode("append").parquet(path)
            yield

    spark.createDataFrame([], schema).write.parquet(path)
    got = streams.sessions(spark, path, spark.createDataFrame([], schema).schema, ("k",), "at", gap, arrivals=arrivals(), clock="clock")
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 10000, 10500, 2), ("a", 12000, 12000, 1), (None, 12000, 12000, 1)]
