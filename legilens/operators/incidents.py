"""Incidents: findings of one secret in a recording, split where it was gone for longer than a gap, and summaries of recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from legilens.functions import dictionaries as known
from legilens.operators import detectors

#: Longest time without a secret that its incident survives.
MERGE_GAP_MS = 4000
KEY = ("recording_id", "pattern_id", "preview", "token_len")
ENGINE_VERSION = "1"


def frame_findings(frames: DataFrame) -> DataFrame:
    """Findings of frames (recording_id, frame_index, timestamp_ms, text). Equal texts are searched once, whatever recordings they are of."""
    keyed = frames.withColumn("id", F.sha2("text", 256))
    found = detectors.detect_in_text(keyed.select("id", "text").distinct())
    return keyed.select("id", "recording_id", "frame_index", "timestamp_ms").join(found, "id").drop("id")


def sessions(rows: DataFrame, keys: tuple[str, ...], at: str, gap: int) -> DataFrame:
    """rows with session, a number that grows where at is more than gap after the row before with the same keys."""
    order = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(order) > gap).cast("int"), F.lit(1))
    return rows.withColumn("_new", new).withColumn("session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def incidents(findings: DataFrame, gap: int = MERGE_GAP_MS) -> DataFrame:
    """One row for each incident. frame_count counts findings, so two equal secrets in one frame count twice."""
    first = F.min_by(F.struct("label", "provider", "severity", "severity_rank"), F.struct("timestamp_ms", "frame_index", "start")).alias("f")
    grouped = sessions(findings, KEY, "timestamp_ms", gap).groupBy(*KEY, "session")
    made = grouped.agg(
        first, F.min("timestamp_ms").alias("first_seen_ms"), F.max("timestamp_ms").alias("last_seen_ms"), F.min_by("frame_index", F.struct("timestamp_ms", "frame_index")).alias("first_frame_index"),
        F.count("*").alias("frame_count"), F.max("confidence").alias("confidence"),
    )
    return shown(made.select("*", "f.*"))


def shown(made: DataFrame) -> DataFrame:
    """The columns of an incident."""
    return made.select(
        "recording_id", "pattern_id", "label", "provider", "severity", "severity_rank", "preview", "token_len", "first_seen_ms", "last_seen_ms", "first_frame_index", "frame_count",
        F.round("confidence", 6).alias("confidence"), F.greatest(F.col("last_seen_ms") - F.col("first_seen_ms"), F.lit(0)).alias("duration_ms"),
    )


def ranked(found: DataFrame) -> DataFrame:
    """Incidents with their place in their recording: worst first, then by time."""
    order = Window.partitionBy("recording_id").orderBy(F.desc("severity_rank"), "first_seen_ms", "first_frame_index", "pattern_id", "preview", "token_len")
    return found.withColumn("place", F.row_number().over(order))


def scan_summary(frames: DataFrame, findings: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row for each recording: frames after carrying forward, frames with findings, and the longest of the last time and meta's duration_ms."""
    counted = frames.groupBy("recording_id").agg(F.count("*").alias("frames_scanned"), F.max("timestamp_ms").alias("last_ms"))
    hit = findings.select("recording_id", "frame_index").distinct().groupBy("recording_id").agg(F.count("*").alias("n"))
    out = counted.join(hit, "recording_id", "left")
    if meta is not None:
        out = out.join(meta.select("recording_id", "duration_ms"), "recording_id", "left")
    else:
        out = out.withColumn("duration_ms", F.lit(None).cast("long"))
    return out.select(
        "recording_id", "frames_scanned", F.coalesce("n", F.lit(0)).alias("frames_with_findings"), F.greatest(F.coalesce("duration_ms", F.lit(0)), "last_ms").alias("duration_ms")
    )


def severity_rollup(found: DataFrame) -> DataFrame:
    """For each recording with incidents: a count for each severity, the worst, and how many need action."""
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in known.SEVERITIES]
    return found.groupBy("recording_id").agg(*counts, F.max_by("severity", "severity_rank").alias("worst"), F.count_if(F.col("severity") != "info").alias("actionable"))


def dry_run(found: DataFrame, canary: str = known.PATTERNS[0].id) -> DataFrame:
    """For each recording with incidents: whether the canary's kind of key was found, and how many incidents are of another kind."""
    own = F.col("pattern_id") == canary
    return found.groupBy("recording_id").agg(F.bool_or(own).alias("canary_found"), F.count_if(~own).alias("bystanders"))


def progress(frames: DataFrame, findings: DataFrame, gap: int = MERGE_GAP_MS) -> DataFrame:
    """(recording_id, frame_index, done, percent, incidents_so_far) after each frame."""
    order = Window.partitionBy(*KEY).orderBy("timestamp_ms")
    fresh = F.coalesce(F.col("timestamp_ms") - F.lag("timestamp_ms").over(order) > gap, F.lit(True))
    begun = findings.withColumn("fresh", fresh).filter("fresh").groupBy("recording_id", "frame_index").agg(F.count("*").alias("begun"))
    to_here = Window.partitionBy("recording_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("recording_id")
    told = frames.select("recording_id", "frame_index").join(begun, ["recording_id", "frame_index"], "left")
    told = told.withColumns({"done": F.count("*").over(to_here), "total": F.count("*").over(whole), "incidents_so_far": F.coalesce(F.sum("begun").over(to_here), F.lit(0).cast("long"))})
    percent = F.least(F.lit(100).cast("long"), F.floor(F.col("done") * 100 / F.col("total") + F.lit(0.5)))
    return told.select("recording_id", "frame_index", "done", percent.alias("percent"), "incidents_so_far")


def results(summary: DataFrame, found: DataFrame, ocred: DataFrame) -> DataFrame:
    """(recording_id, result): the whole result of each recording as JSON, incidents in their order. ocred has frames_ocred and cancelled."""
    listed = ranked(found).groupBy("recording_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "pattern_id", "label", "provider", "severity", "preview", "first_seen_ms", "last_seen_ms", "first_frame_index", "frame_count", "confidence"))).alias("incidents")
    )
    whole = summary.join(listed, "recording_id", "left").join(ocred, "recording_id", "left")
    fields = ["incidents", "frames_scanned", "frames_with_findings", "duration_ms", "frames_ocred"]
    cancelled = F.coalesce("cancelled", F.lit(False)).alias("cancelled")
    return whole.select("recording_id", F.to_json(F.struct(*fields, F.lit(ENGINE_VERSION).alias("engine_version"), cancelled)).alias("result"))
