"""Frame events as JSON lines, settings, and recordings' catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from legilens.functions import dictionaries as known

EVENT = (
    "recording_id string, type string, duration_ms bigint, total_frames bigint, frame_index bigint, timestamp_ms bigint, text string, skipped boolean,"
    " frames_scanned bigint, frames_ocred bigint, error string"
)
KINDS = ("meta", "frame", "done", "error")


def parsed(lines: DataFrame) -> DataFrame:
    """Events of lines (value): lines that are no JSON object with a known type are dropped. Works on streams as well."""
    event = lines.select(F.from_json("value", EVENT).alias("e")).select("e.*")
    return event.filter(F.col("type").isin(*KINDS))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    """The same of files as they arrive, those that are there at once in one micro-batch."""
    spark.createDataFrame([], "value string").write.mode("append").text(path)  # the folder, where nothing has arrived yet
    return parsed(spark.readStream.text(path))


def frames_of(events: DataFrame) -> DataFrame:
    """(recording_id, frame_index, timestamp_ms, text, skipped) of the frame events, with the defaults of absent fields."""
    zero = F.lit(0).cast("long")
    return events.filter("type = 'frame'").select(
        "recording_id", F.coalesce("frame_index", zero).alias("frame_index"), F.coalesce("timestamp_ms", zero).alias("timestamp_ms"), "text", F.coalesce("skipped", F.lit(False)).alias("skipped")
    )


def frames_and_ends(events: DataFrame) -> DataFrame:
    """The frames, and rows of another type without frame_index: a recording's beginning (with total, its number of frames, and duration_ms), and its end or error (done, with expected, the number of its frames)."""
    zero = F.lit(0).cast("long")
    of_frame = lambda value: F.when(F.col("type") == "frame", value)
    return events.select(
        "recording_id", *[of_frame(F.coalesce(F.col(c), zero)).alias(c) for c in ("frame_index", "timestamp_ms")], of_frame(F.col("text")).alias("text"), F.coalesce("skipped", F.lit(False)).alias("skipped"),
        F.col("type").isin("done", "error").alias("done"), F.when(F.col("type") == "meta", F.col("total_frames")).alias("total"),
        F.when(F.col("type") == "meta", F.col("duration_ms")).alias("duration_ms"), F.when(F.col("type") == "done", F.col("frames_scanned")).alias("expected"),
    )


def totals_of(events: DataFrame) -> DataFrame:
    """(recording_id, duration_ms, total_frames, frames_ocred, error): what the other events of a recording say."""
    pick = lambda kind, col: F.max(F.when(F.col("type") == kind, F.col(col))).alias(col)
    return events.groupBy("recording_id").agg(pick("meta", "duration_ms"), pick("meta", "total_frames"), pick("done", "frames_ocred"), pick("error", "error"))


def spread(table: DataFrame) -> DataFrame:
    """A table as it is read, dealt over the cores where it has fewer partitions than those (a few files of one row group); larger ones stay as they are."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def blocks_of(text: DataFrame) -> DataFrame:
    """(id, label, text) of the blocks of (id, text) between lines of ---; the label is a block's first line."""
    parts = text.select("id", F.posexplode(F.split("text", "\n---\n")).alias("block", "text"))
    return parts.select(F.concat_ws("/", "id", "block").alias("id"), F.substring_index("text", "\n", 1).alias("label"), "text")


def upserted(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """(key, value): settings with changes (key, value, at) applied; the last change of a key wins, then the greatest value."""
    both = settings.select("key", "value", F.lit(None).cast("long").alias("at")).unionByName(changes.select("key", "value", "at"))
    return both.groupBy("key").agg(F.max_by("value", F.struct(F.coalesce("at", F.lit(-(1 << 62))), "value")).alias("value"))


def looked_up(settings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, value) of each wanted key: null where no setting has it. Of repeated keys in settings the greatest value counts."""
    return wanted.select("key").join(settings.groupBy("key").agg(F.max("value").alias("value")), "key", "left")


def latest_version(migrations: DataFrame) -> DataFrame:
    """(version): the latest version of the migrations, 0 where there is none."""
    return migrations.agg(F.coalesce(F.max("version"), F.lit(0)).cast("long").alias("version"))


def write_tsv(findings: DataFrame, path: str) -> None:
    """Findings as lines of label, severity, confidence and preview, separated by tabs; the confidence with two digits."""
    findings.select("label", "severity", F.format_number("confidence", 2).alias("confidence"), "preview").write.option("sep", "\t").option("quote", "").csv(path)


def detectors(spark: SparkSession) -> DataFrame:
    """(id, label, provider, severity) of every provider pattern."""
    return spark.createDataFrame([(p.id, p.label, p.provider, p.severity) for p in known.PATTERNS], "id string, label string, provider string, severity string")
