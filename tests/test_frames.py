import json

from pyspark.sql import functions as F

from legilens.functions import dictionaries as known
from legilens.operators import detectors, frames, incidents, parity
from legilens.sources import events

B24 = "T3xK9mPq2LvR8wZa5NbYc7Hd"


def frame(i, text=None, skipped=False, rec="a", ts=None):
    return (rec, i, i * 1000 if ts is None else ts, text, skipped)


def made(spark, rows):
    return spark.createDataFrame(rows, "recording_id string, frame_index bigint, timestamp_ms bigint, text string, skipped boolean")


def test_carry_forward(spark):
    rows = [frame(0, None, True), frame(1, "x"), frame(2, None, True), frame(3, "y"), frame(4, None), frame(5, ""), frame(6, None, True), frame(7, "z")]
    got = frames.carry_forward(made(spark, rows)).orderBy("frame_index").collect()
    assert [(r.frame_index, r.text) for r in got] == [(1, "x"), (2, "x"), (3, "y"), (4, "y"), (5, ""), (7, "z")]


def test_transcript_of_a_leak(spark, tmp_path):
    """A key read once and carried over two skipped frames is one incident."""
    key = "OPENAI_API_KEY=sk-proj-" + B24
    lines = [{"type": "meta", "recording_id": "a", "duration_ms": 12000, "total_frames": 5}]
    lines += [{"type": "frame", "recording_id": "a", "frame_index": i, "timestamp_ms": i * 1000, "text": t} for i, t in enumerate(["hello", "world", key])]
    lines += [{"type": "frame", "recording_id": "a", "frame_index": i, "timestamp_ms": i * 1000, "skipped": True} for i in (3, 4)]
    lines += [{"type": "done", "recording_id": "a", "frames_ocred": 3}]
    path = tmp_path / "x.jsonl"
    path.write_text("\n".join(["", "noise", "{"] + [json.dumps(x) for x in lines]))
    ev = events.read_events(spark, str(path))
    carried = frames.carry_forward(events.frames_of(ev))
    found = incidents.frame_findings(carried)
    one = incidents.incidents(found).collect()
    assert [(r.pattern_id, r.first_seen_ms, r.last_seen_ms, r.first_frame_index, r.frame_count) for r in one] == [("openai_project", 2000, 4000, 2, 3)]
    totals = events.totals_of(ev)
    s = incidents.scan_summary(carried, found, totals).first()
    assert (s.frames_scanned, s.frames_with_findings, s.duration_ms) == (5, 3, 12000)
    assert totals.first().frames_ocred == 3


def test_gap_of_sessions(spark):
    cols = "recording_id string, frame_index bigint, timestamp_ms bigint, pattern_id string, label string, provider string, severity string, severity_rank int, start int, preview string, token_len int, confidence double"
    row = lambda rec, ts: (rec, ts // 1000, ts, "p", "l", "v", "high", 2, 0, "x", 10, 0.9)
    rows = [row("a", 0), row("a", 4000), row("b", 0), row("b", 4001), *(row("c", t * 1000) for t in range(6)), row("d", 5), row("d", 5)]
    got = incidents.incidents(spark.createDataFrame(rows, cols)).groupBy("recording_id").agg(F.count("*").alias("n"), F.sum("frame_count").alias("f")).orderBy("recording_id").collect()
    assert [(r.n, r.f) for r in got] == [(1, 2), (2, 2), (1, 6), (1, 2)]


def test_gate(spark):
    h = lambda *bits: [sum(1 << b for b in bits), 0, 0, 0]
    rows = [("a", 0, h()), ("a", 1, h(1)), ("a", 2, h(1, 2)), ("a", 3, None), ("a", 4, h(3)), ("a", 5, h(*range(20)))] + [("a", i, h(*range(20))) for i in range(6, 12)]
    got = frames.skip_gate(spark.createDataFrame(rows, "recording_id string, frame_index bigint, hash array<bigint>")).orderBy("frame_index").collect()
    assert [r.skipped for r in got] == [False, True, True, False, True, False, True, True, True, True, False, True]


def test_difference_hash(spark):
    px = [[3, 1, 2, 2, 5, 4], [0, 1, 0, 9, 8, 8]]
    got = spark.createDataFrame([(sum(px, []),)], "px array<int>").select(F.expr(frames.difference_hash("px", 2, 6)).alias("h")).first().h
    bits = [r[i] > r[i + 1] for r in px for i in range(5)]
    assert got == [sum(1 << i for i, b in enumerate(bits) if b)]


def test_upsert_and_disagreements(spark):
    a = spark.createDataFrame([("k", "1"), ("m", "2")], "key string, value string")
    b = spark.createDataFrame([("k", "3", 1), ("k", "4", 2), ("n", None, 1)], "key string, value string, at bigint")
    assert sorted(map(tuple, events.upserted(a, b).collect())) == [("k", "4"), ("m", "2"), ("n", None)]
    x = spark.createDataFrame([("a", "l", 0.5), ("b", "l", 0.5), ("c", "l", 0.5)], "candidate string, label string, confidence double")
    y = spark.createDataFrame([("a", "l", 0.5000001), ("b", "l", 0.6), ("d", "l", 0.5)], "candidate string, label string, confidence double")
    assert sorted(r.candidate for r in parity.disagreements(x, y).collect()) == ["b", "c", "d"]
