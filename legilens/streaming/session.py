"""A scan that can be watched, stopped and asked for its result: one at a time for each name.

A scan is one named stream. Each micro-batch of it is searched and its masked findings, frames and counts are appended to tables; the result is an
aggregation over these tables, so it is valid at any time. A scan that is cancelled stops between micro-batches; frames that wait for earlier ones are then
taken as if their recordings had ended, so that its result is that of all frames that have arrived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from legilens.operators import incidents
from legilens.sources import events
from legilens.sources.scratch import scratch
from legilens.streaming.ordered import IDLE_MS
from legilens.streaming.scan import carry_forward, read_once, started


class AlreadyRunning(RuntimeError):
    """A scan of that name has not ended."""


class Scan:
    """A scan of the event lines that arrive under a path. Other sessions' scans and other names don't matter to it."""

    def __init__(self, spark: SparkSession, path: str, name: str, delay: int = 0, idle: int = IDLE_MS):
        self.spark, self.name, self.cancelled = spark, f"scan of {name}", False
        self.query: StreamingQuery | None = None
        self.progress, self.ends = scratch(spark, "progress"), scratch(spark, "ends")
        self.tables = {t: scratch(spark, t) for t in ("frames", "findings")}
        told = events.stream_events(spark, path).unionByName(events.stream_events(spark, self.ends))
        self.events = events.frames_and_ends(told).observe(self.name, F.count("frame_index").alias("frames"), F.count_if(F.col("done")).alias("ends"))
        self.stream = carry_forward(self.events, delay, idle)

    def start(self, **trigger) -> StreamingQuery:
        """Begin, or go on after what was processed; trigger as for a stream, by default to the end of what is there. A second scan of one name is refused while the first is running."""
        if any(q.name == self.name for q in self.spark.streams.active):
            raise AlreadyRunning(f"a {self.name} is already running")
        if self.cancelled:
            raise RuntimeError(f"the {self.name} was cancelled")
        self.query = started(self.stream, self._each, self.progress, self.name, **(trigger or {"availableNow": True}))
        return self.query

    def _each(self, batch: DataFrame, n: int) -> None:
        read_once(batch, lambda rows: self._keep(rows, n))

    def _keep(self, batch: DataFrame, n: int) -> None:
        if batch.isEmpty():  # a stream that goes on has micro-batches for its timers only
            return
        frames = batch.filter("not done and text is not null").select("recording_id", "frame_index", "timestamp_ms", "text")
        incidents.frame_findings(frames).write.mode("overwrite").parquet(f"{self.tables['findings']}/batch={n}")
        # Texts are not kept: of a frame only whether it has one.
        rows = batch.withColumn("text", F.col("text").isNotNull()).withColumnRenamed("text", "has_text")
        rows.write.mode("overwrite").parquet(f"{self.tables['frames']}/batch={n}")

    def _table(self, name: str) -> DataFrame:
        """What was kept so far; an empty table before anything was."""
        none = self.spark.createDataFrame([], self.stream.schema)
        if name == "findings":
            shape = incidents.frame_findings(none.select("recording_id", "frame_index", "timestamp_ms", "text")).schema
        else:
            shape = none.withColumn("text", F.col("text").isNotNull()).withColumnRenamed("text", "has_text").schema
        path = self.tables[name]
        self.spark.createDataFrame([], shape).write.mode("overwrite").parquet(f"{path}/batch=-1")
        return self.spark.read.schema(shape).parquet(path).select(*shape.names)

    def running(self) -> bool:
        return self.query is not None and self.query.isActive

    def cancel(self) -> bool:
        """Stop between micro-batches, and take what waits. Returns whether there was a scan to stop: one that was started and not cancelled before."""
        if self.query is None or self.cancelled:
            return False
        self.query.stop()
        self.query.awaitTermination()
        begun_less_ended = F.expr("count_if(frame_index is null and place = 0 and not done) - count_if(done)")
        still_open = self._table("frames").groupBy("recording_id").agg(begun_less_ended.alias("n")).filter("n > 0").select("recording_id")
        still_open.select(F.to_json(F.struct(F.lit("done").alias("type"), "recording_id")).alias("value")).write.mode("append").text(self.ends)
        self.start(availableNow=True).awaitTermination()
        self.cancelled = True
        return True

    def incidents(self) -> DataFrame:
        """Incidents of the frames that were taken so far."""
        return incidents.incidents(self._table("findings"))

    def counts(self) -> DataFrame:
        """(recording_id, frames, read, late): frames taken, those that had a text of their own, and those that came too late."""
        rows = self._table("frames").groupBy("recording_id")
        return rows.agg(F.count("frame_index").alias("frames"), F.count_if(F.col("own")).alias("read"), F.coalesce(F.sum("late"), F.lit(0)).alias("late"))

    def result(self) -> DataFrame:
        """(recording_id, result) of every recording with a text: the whole result as JSON, with cancelled."""
        frames, found = self._table("frames"), self._table("findings")
        meta = frames.groupBy("recording_id").agg(F.max("duration_ms").alias("duration_ms"))
        summary = incidents.scan_summary(frames.filter("has_text").select("recording_id", "frame_index", "timestamp_ms"), found, meta)
        read = frames.groupBy("recording_id").agg(F.count_if(F.col("own")).alias("frames_ocred"), F.lit(self.cancelled).alias("cancelled"))
        return incidents.results(summary, incidents.incidents(found), read)

    def observed(self) -> list[dict]:
        """The frames and ends that each micro-batch of the last run saw arriving."""
        return [p.observedMetrics[self.name].asDict() for p in self.query.recentProgress if self.name in p.observedMetrics] if self.query else []
