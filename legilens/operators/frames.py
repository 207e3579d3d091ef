"""Frames of a recording: hashes, the gate that skips near-identical frames, and carrying text forward."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits by which a frame may differ from the last kept one to be skipped, and the most frames skipped in a row.
THRESHOLD, MAX_RUN = 8, 4


def difference_hash(pixels: str, rows: int, width: int) -> str:
    """SQL: words of 64 bits, bit k of the whole saying whether the k-th pixel of a row of pixels is greater than its right neighbour.

    pixels is an array of rows * width numbers; each row gives width - 1 bits.
    """
    bits = rows * (width - 1)
    bit = lambda k: f"(get({pixels}, {k} div {width - 1} * {width} + {k} % {width - 1}) > get({pixels}, {k} div {width - 1} * {width} + {k} % {width - 1} + 1))"
    word = f"aggregate(sequence(0, 63), 0L, (w, i) -> w | if(64 * k + i < {bits} and {bit('(64 * k + i)')}, shiftleft(1L, i), 0L))"
    return f"transform(sequence(0, {(bits - 1) // 64}), k -> {word})"


def hamming(a: str, b: str) -> str:
    """SQL: bits in which two arrays of words differ."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, v) -> s + v)"


class Gate:
    """Decides frame by frame; its state is the last kept hash and the length of the current run of skipped frames."""

    def __init__(self, last: list[int] | None = None, run: int = 0, threshold: int = THRESHOLD, max_run: int = MAX_RUN):
        self.last, self.run, self.threshold, self.max_run = last, run, threshold, max_run

    def skips(self, words: list[int] | None) -> bool:
        if words is not None and self.last is not None and self.run < self.max_run:
            if sum(((int(x) ^ int(y)) & (1 << 64) - 1).bit_count() for x, y in zip(self.last, words, strict=True)) <= self.threshold:
                self.run += 1
                return True
        self.run = 0
        if words is not None:
            self.last = list(words)
        return False


def skip_gate(frames: DataFrame, threshold: int = THRESHOLD, max_run: int = MAX_RUN) -> DataFrame:
    """(recording_id, frame_index, skipped) for frames (recording_id, frame_index, hash), in the order of the index.

    A decision depends on the decisions before it, so a recording goes to one task, sorted by the shuffle; the task holds one batch of it and the gate.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gate, current = None, None
        for b in batches:
            skipped = []
            for recording, words in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if gate is None or recording != current:
                    gate, current = Gate(None, 0, threshold, max_run), recording
                skipped.append(gate.skips(words))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(skipped, pa.bool_())], ["recording_id", "frame_index", "skipped"])

    kind = frames.schema["recording_id"].dataType.simpleString()
    rows = frames.select("recording_id", F.col("frame_index").cast("long").alias("frame_index"), "hash")
    rows = rows.repartition("recording_id").sortWithinPartitions("recording_id", "frame_index")
    return rows.mapInArrow(run, f"recording_id {kind}, frame_index bigint, skipped boolean")


def sampling_schedule(recordings: DataFrame, fps: float = 1.0) -> DataFrame:
    """recordings (with duration_s) times its samples: i from 0 and at_s, every 1 / fps seconds, one at least."""
    interval = F.lit(1.0 / fps)
    n = F.greatest(F.lit(1), F.floor(F.col("duration_s") / interval)).cast("long")
    return recordings.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("at_s", F.col("i") * interval)


def sampled_frames(recordings: DataFrame, frames: DataFrame, fps: float = 1.0) -> DataFrame:
    """(recording_id, i, wanted_ms, timestamp_ms, frame): for each sample of a recording the frame nearest to it, at the frame's own time.

    recordings has recording_id and duration_s, frames has recording_id, timestamp_ms and frame, its identifier. A frame is at most half an interval away from its
    sample; of frames equally near the earlier counts, then the smaller identifier. A sample without a frame so near leaves a gap in i.

    Frames and samples meet by number of interval: a frame lies within half an interval of the sample before it or of the one after it, so it gives two rows at most, and each sample
    takes the least of its own, combined by map task before they meet. Nothing is ordered within a recording.
    """
    interval = 1000.0 / fps
    last = F.greatest(F.lit(1), F.floor(F.col("duration_s") * fps)).cast("long") - 1
    x = F.col("timestamp_ms") / F.lit(interval)
    near = frames.select("recording_id", "timestamp_ms", "frame", F.explode(F.array_distinct(F.array(F.floor(x), F.ceil(x)))).alias("i"))
    near = near.withColumn("wanted_ms", F.col("i") * F.lit(interval)).withColumn("away", F.abs(F.col("timestamp_ms") - F.col("wanted_ms"))).filter((F.col("away") <= interval / 2) & (F.col("i") >= 0))
    best = near.groupBy("recording_id", "i", "wanted_ms").agg(F.min(F.struct("away", "timestamp_ms", "frame")).alias("best"))
    inside = best.join(recordings.select("recording_id", last.alias("last")), "recording_id").filter("i <= last")
    return inside.select("recording_id", "i", "wanted_ms", "best.timestamp_ms", "best.frame")


def decoded_text(frames: DataFrame) -> DataFrame:
    """frames with text null where the frame was skipped."""
    return frames.withColumn("text", F.when(~F.coalesce("skipped", F.lit(False)), F.col("text")))


def carry_forward(frames: DataFrame) -> DataFrame:
    """(recording_id, frame_index, timestamp_ms, text): frames without text take the last one that was read.

    A frame whose carried text is empty, or that comes before any text, is dropped.
    """
    before = Window.partitionBy("recording_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    carried = F.last_value("text", ignoreNulls=True).over(before) if hasattr(F, "last_value") else F.last("text", ignorenulls=True).over(before)
    told = decoded_text(frames).withColumn("carried", carried).filter("text is not null or carried <> ''")
    return told.select("recording_id", "frame_index", "timestamp_ms", F.col("carried").alias("text"))
