"""Structured Streaming: the same frames as they arrive. State is kept for each recording; batch and stream give equal results.

Frames are taken in their order by the operators of ordered: what comes too late is dropped and counted, and a recording's state goes with its end or error event, or with a
timer where none comes; what comes later starts anew. State is the text carried, a hash or the incidents still open, and the frames that wait for earlier ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from legilens.operators import incidents
from legilens.operators.frames import MAX_RUN, THRESHOLD
from legilens.sources import events
from legilens.sources.scratch import scratch
from legilens.streaming import ordered
from legilens.streaming.ordered import IDLE_MS

#: What is there now, as the only arrival.
NOW = (None,)


@contextmanager
def configured(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with these settings for a while; a stream keeps those that it is started with."""
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def started(stream: DataFrame, each: Callable[[DataFrame, int], None], progress: str, name: str | None = None, closing_batch: bool = False, **trigger) -> StreamingQuery:
    """A stream that gives its micro-batches to each. State and what was read are kept under progress for the next call. With closing_batch a run to
    the end has a last micro-batch without data, which gives what the watermark has passed."""
    writer = stream.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", progress).trigger(**trigger)
    # A run to the end of what is there ends then; its timers are looked at in the next run. A stream that goes on looks at them without data too.
    settings = ordered.PROVIDER | {"spark.sql.streaming.noDataMicroBatches.enabled": str(closing_batch or not trigger.get("availableNow")).lower()}
    with configured(stream.sparkSession, settings):
        return (writer.queryName(name) if name else writer).start()


def run_to_end(stream: DataFrame, each: Callable[[DataFrame, int], None], progress: str, name: str | None = None, closing_batch: bool = False) -> StreamingQuery:
    """Process all that is there, and wait for its end."""
    query = started(stream, each, progress, name, closing_batch, availableNow=True)
    query.awaitTermination()
    return query


def appended(stream: DataFrame, name: str, arrivals: Iterable = NOW, made: Callable[[DataFrame], DataFrame] = lambda batch: batch, closing_batch: bool = False) -> DataFrame:
    """All rows that made gives for the micro-batches of a stream, a run after each arrival. A batch that is repeated after a failure overwrites what it had written."""
    spark, path, progress = stream.sparkSession, scratch(stream.sparkSession, name), scratch(stream.sparkSession, "progress")
    schema = made(spark.createDataFrame([], stream.schema)).schema
    spark.createDataFrame([], schema).write.parquet(f"{path}/batch=-1")  # so that a stream without rows has a result
    for _ in arrivals:
        run_to_end(stream, lambda batch, n: made(batch).write.mode("overwrite").parquet(f"{path}/batch={n}"), progress, closing_batch=closing_batch)
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def _keep(state: GroupState, value: tuple | None) -> None:
    """Keep a recording's state, or drop it where there is none."""
    if value is not None:
        state.update(value)
    elif state.exists:
        state.remove()


def carry_forward(frames: DataFrame, delay: int = 0, idle: int = IDLE_MS) -> DataFrame:
    """The rows of ordered.Carry for a stream of frames and ends: recording_id, frame_index, timestamp_ms, text, own, place, total, duration_ms, done, late."""
    return ordered.in_order(frames, ordered.Carry(delay, idle))


def carried(spark: SparkSession, path: str, arrivals: Iterable = NOW, delay: int = 0, idle: int = IDLE_MS) -> DataFrame:
    """(recording_id, frame_index, timestamp_ms, text) of the event lines under path."""
    rows = appended(carry_forward(events.frames_and_ends(events.stream_events(spark, path)), delay, idle), "carried", arrivals)
    return rows.filter("not done and text is not null").select("recording_id", "frame_index", "timestamp_ms", "text")


def late_frames(spark: SparkSession, path: str, arrivals: Iterable = NOW, delay: int = 0, idle: int = IDLE_MS) -> DataFrame:
    """(recording_id, late) of the recordings under path that have ended: how many frames were dropped because later ones had been taken."""
    rows = appended(carry_forward(events.frames_and_ends(events.stream_events(spark, path)), delay, idle), "carried", arrivals)
    return rows.filter("done").groupBy("recording_id").agg(F.sum("late").alias("late"))


def skip_gate(frames: DataFrame, threshold: int = THRESHOLD, max_run: int = MAX_RUN, delay: int = 0, idle: int = IDLE_MS) -> DataFrame:
    """(recording_id, frame_index, skipped, done, late) of a stream of hashed frames, with ends where it has them (see ordered.SkipGate)."""
    timed = frames if "timestamp_ms" in frames.columns else frames.withColumn("timestamp_ms", F.col("frame_index"))
    return ordered.in_order(timed, ordered.SkipGate(threshold, max_run, delay, idle))


def gated(spark: SparkSession, path: str, schema, threshold: int = THRESHOLD, arrivals: Iterable = NOW, delay: int = 0, idle: int = IDLE_MS) -> DataFrame:
    """(recording_id, frame_index, skipped) of the hashed frames that arrive under path as Parquet."""
    rows = appended(skip_gate(spark.readStream.schema(schema).parquet(path), threshold, delay=delay, idle=idle), "gate", arrivals)
    return rows.filter("not done").select("recording_id", "frame_index", "skipped")


#: Columns of an open incident, beside its key.
OPEN = ("label", "provider", "severity", "severity_rank", "first_seen_ms", "last_seen_ms", "first_frame_index", "frame_count", "confidence")


def closing(findings: DataFrame, gap: int = incidents.MERGE_GAP_MS) -> DataFrame:
    """Incidents of a stream of findings and done rows, each as it closes: when a later finding of the recording is more than gap after it, or at the end.

    The state of a recording are its open incidents: those seen in the last gap.
    """
    key, kinds = ["pattern_id", "preview", "token_len"], "string, preview string, token_len int, label string, provider string, severity string, severity_rank int"
    times = "first_seen_ms bigint, last_seen_ms bigint, first_frame_index bigint, frame_count bigint, confidence double"
    one = f"pattern_id {kinds}, {times}"

    def run(of: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {tuple(r[:3]): list(r[3:]) for r in state.get[0]} if state.exists else {}
        closed, over = [], False
        rows = pd.concat(list(parts)).sort_values(["timestamp_ms", "frame_index", "start"])
        for r in rows.itertuples(index=False):
            if r.done:
                over = True
                continue
            for k in [k for k, v in held.items() if r.timestamp_ms - v[5] > gap]:
                closed.append((of[0], *k, *held.pop(k)))
            k = (r.pattern_id, r.preview, int(r.token_len))
            if k in held:
                v = held[k]
                v[5], v[7], v[8] = max(v[5], int(r.timestamp_ms)), v[7] + 1, max(v[8], float(r.confidence))
            else:
                held[k] = [r.label, r.provider, r.severity, int(r.severity_rank), int(r.timestamp_ms), int(r.timestamp_ms), int(r.frame_index), 1, float(r.confidence)]
        if over:
            closed += [(of[0], *k, *v) for k, v in held.items()]
        _keep(state, None if over or not held else ([(*k, *v) for k, v in held.items()],))
        yield pd.DataFrame(closed, columns=["recording_id", *key, *OPEN])

    out = f"recording_id string, {one}"
    fields = one.replace(" ", ":").replace(",:", ",")
    return findings.groupBy("recording_id").applyInPandasWithState(run, out, f"open array<struct<{fields}>>", "append", GroupStateTimeout.NoTimeout)


def searched(batch: DataFrame) -> DataFrame:
    """The findings of a micro-batch of carried frames, and its ends."""
    frames = batch.filter("not done and text is not null").select("recording_id", "frame_index", "timestamp_ms", "text")
    rows = incidents.frame_findings(frames).withColumn("done", F.lit(False))
    return rows.unionByName(batch.filter("done").select("recording_id", "done"), allowMissingColumns=True)


def counted(batch: DataFrame) -> DataFrame:
    """The findings of a micro-batch of carried frames with their frame's place, its frames, and its ends: what progress goes by."""
    frame = batch.filter("not done and frame_index is not null").select("recording_id", "frame_index", "timestamp_ms", "place", "total")
    found = incidents.frame_findings(batch.filter("not done and text is not null").select("recording_id", "frame_index", "timestamp_ms", "text"))
    found = found.join(frame.select("recording_id", "frame_index", "place"), ["recording_id", "frame_index"])
    found = found.select("recording_id", "frame_index", "timestamp_ms", "place", F.lit(None).cast("long").alias("total"), "pattern_id", "preview", "token_len")
    ends = batch.filter("done").select("recording_id", F.lit(True).alias("done"))
    told = found.withColumn("frame_row", F.lit(False)).unionByName(frame.withColumn("frame_row", F.lit(True)), allowMissingColumns=True).withColumn("done", F.lit(False))
    return told.unionByName(ends, allowMissingColumns=True)


def read_once(batch: DataFrame, use: Callable[[DataFrame], None]) -> None:
    """Use a micro-batch that is read several times; its operators run once."""
    batch = batch.persist()
    try:
        use(batch)
    finally:
        batch.unpersist()


def chained(first: DataFrame, between: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], name: str, arrivals: Iterable) -> DataFrame:
    """What second gives for the stream of between's rows for the micro-batches of first, in order: after each arrival both streams run to their end."""
    spark = first.sparkSession
    made, made_progress, result, progress = (scratch(spark, f"{name}-{x}") for x in ("between", "between-progress", "result", "progress"))
    schema = between(spark.createDataFrame([], first.schema)).schema
    spark.createDataFrame([], schema).write.parquet(f"{made}/none")
    last = second(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(made))
    spark.createDataFrame([], last.schema).write.parquet(f"{result}/none")
    for _ in arrivals:
        run_to_end(first, lambda batch, n: read_once(batch, lambda rows: between(rows).write.mode("overwrite").parquet(f"{made}/batch-{n}")), made_progress)
        run_to_end(last, lambda batch, n: batch.write.mode("overwrite").parquet(f"{result}/batch-{n}"), progress)
    return spark.read.schema(last.schema).option("recursiveFileLookup", True).parquet(result)


def scan(spark: SparkSession, path: str, arrivals: Iterable = NOW, delay: int = 0, idle: int = IDLE_MS) -> DataFrame:
    """Incidents of the recordings whose event lines arrive under path, in the columns of incidents.incidents.

    After each arrival its frames are carried forward and searched, and the incidents that closed are appended. An empty folder gives none.
    """
    frames = carry_forward(events.frames_and_ends(events.stream_events(spark, path)), delay, idle)
    return incidents.shown(chained(frames, searched, closing, "incidents", arrivals))


def progress(spark: SparkSession, path: str, arrivals: Iterable = NOW, every: int = 10, delay: int = 0, idle: int = IDLE_MS, gap: int = incidents.MERGE_GAP_MS) -> DataFrame:
    """(recording_id, frame_index, done, percent, incidents_so_far) after every so many frames of each recording, while it is scanned; percent is null until the number of frames is known."""
    frames = carry_forward(events.frames_and_ends(events.stream_events(spark, path)), delay, idle)
    return chained(frames, counted, lambda rows: ordered.progress(rows, every, gap), "progress", arrivals)


def sessions(spark: SparkSession, path: str, schema, keys: tuple[str, ...], at: str, gap: int, delay: str = "0 seconds", arrivals: Iterable = NOW, clock: str | None = None) -> DataFrame:
    """(keys, first_ms, last_ms, n) of the rows that arrive under path as Parquet: a gap of more than gap milliseconds starts a new session.

    A session is given when the watermark, the latest time seen less delay, has passed its end. Rows later than the watermark are dropped. Rows with null
    keys have sessions of their own. A row where the boolean column clock is true belongs to no session, but moves the watermark: such a row at a later time ends a stream.
    """
    ticks = F.coalesce(F.col(clock), F.lit(False)) if clock else F.lit(False)
    rows = spark.readStream.schema(schema).parquet(path).select(*keys, F.col(at).cast("timestamp").alias("at"), ticks.alias("ticks")).withWatermark("at", delay)
    ms = F.expr("unix_micros(at) div 1000")
    windows = rows.groupBy(F.session_window("at", f"{gap + 1} milliseconds"), *keys, "ticks").agg(F.min(ms).alias("first_ms"), F.max(ms).alias("last_ms"), F.count("*").alias("n"))
    # Sessions that the last arrival has passed come in a micro-batch after it.
    return appended(windows.drop("session_window"), "sessions", arrivals, closing_batch=True).filter("not ticks").drop("ticks")
