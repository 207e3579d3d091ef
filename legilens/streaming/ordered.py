"""Stateful operators that take the rows of a recording in the order of their frames, whatever the order in which they arrive.

The clock of a recording is the latest time that it has shown. A frame waits, in a list that is state, until the clock is delay further; then it is taken, in the order of
frame_index. A frame that comes after later ones were taken is late: it is dropped and counted. The end of a recording takes all that waits, at once or,
where the end says how many frames there are, when these have arrived; its state is removed then. A recording that shows nothing for idle
milliseconds, by the clock of the machines, is ended by a timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from legilens.operators.frames import MAX_RUN, THRESHOLD, Gate

#: How long a recording may be silent before it is ended: an hour.
IDLE_MS = 3_600_000
#: State of these operators is kept in RocksDB, which they need.
PROVIDER = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

CLOCK = "newest bigint, taken bigint, arrived bigint, late bigint, expected bigint, total bigint, ended boolean"


class InOrder(StatefulProcessor):
    """Takes frames in order. Subclasses say what a frame holds beside index and time (HOLDS), what is kept between frames (KEPT), and what taken frames give (taken)."""

    HOLDS: tuple[str, ...] = ()
    KEPT: tuple[str, ...] = ()
    GIVES: tuple[str, ...] = ()

    def __init__(self, delay: int = 0, idle: int = IDLE_MS):
        self.delay, self.idle = delay, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", CLOCK)
        self.waiting = handle.getListState("waiting", ", ".join(("frame_index bigint", "timestamp_ms bigint", *self.HOLDS)))
        self.kept = handle.getValueState("kept", ", ".join(self.KEPT))

    def taken(self, kept: tuple | None, frames: list[tuple], total: int | None) -> tuple[tuple, list[tuple]]:
        """What is kept after these frames, and rows of GIVES."""
        raise NotImplementedError

    def mark(self, beginning) -> tuple | None:
        """A row of GIVES for a recording that begins (None), or for what is known of it from its beginning on; none by default."""
        return None

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.clock.exists()
        newest, taken, arrived, late, expected, total, ended = self.clock.get() if old else (None, None, 0, 0, None, None, False)
        marks = [] if old else [self.mark(None)]
        waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        holds = [h.split(" ")[0] for h in self.HOLDS]
        for part in rows:
            for r in part.itertuples(index=False):
                if pd.isna(r.frame_index):
                    ended = ended or bool(r.done)
                    expected = expected if pd.isna(r.expected) else int(r.expected)
                    if not r.done:
                        total = total if pd.isna(r.total) else int(r.total)
                        marks.append(self.mark(r))
                    continue
                arrived += 1
                index, at = int(r.frame_index), int(r.timestamp_ms)
                if taken is not None and index < taken:
                    late += 1
                    continue
                newest = at if newest is None else max(newest, at)
                waiting.append((index, at, *(_plain(getattr(r, h)) for h in holds)))
        over = ended and (expected is None or arrived >= expected)
        now = timerValues.getCurrentProcessingTimeInMs()
        yield from self._take(key, waiting, (newest, taken, arrived, late, expected, total, ended), over, now, [m for m in marks if m])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.clock.exists():
            waiting = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
            yield from self._take(key, waiting, tuple(self.clock.get()), True, 0, [])

    def _take(self, key: tuple, waiting: list[tuple], clock: tuple, over: bool, now: int, marks: list[tuple]) -> Iterator[pd.DataFrame]:
        newest, taken, arrived, late, expected, total, ended = clock
        ready = [w for w in waiting if over or w[1] <= newest - self.delay]
        ready.sort(key=lambda w: w[:2])
        kept, out = self.taken(tuple(self.kept.get()) if self.kept.exists() else None, ready, total) if ready else (None, [])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if over:
            for state in (self.clock, self.waiting, self.kept):
                state.clear()
        else:
            left = [w for w in waiting if w[1] > newest - self.delay] if waiting else []
            if ready:
                self.kept.update(kept)
                taken = max(ready[-1][0], -1 if taken is None else taken)
            if left:
                self.waiting.put(left)
            else:
                self.waiting.clear()
            self.clock.update((newest, taken, arrived, late, expected, total, ended))
            self.handle.registerTimer(now + self.idle)
        names = ["recording_id", *(g.split(" ")[0] for g in self.GIVES), "done", "late"]
        rows = [(key[0], *r, False, None) for r in (*marks, *out)]
        if over:
            rows.append((key[0], *([None] * len(self.GIVES)), True, late))
        made = pd.DataFrame(rows, columns=names)
        whole = {n.split(" ")[0]: "Int64" for n in (*self.GIVES, "late bigint") if n.endswith((" bigint", " int"))}
        yield made.astype(whole)

    def close(self) -> None:
        pass


def _plain(value):
    """A value as state takes it: lists for arrays, None for what is missing."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    return None if value is None or value != value else value


class Carry(InOrder):
    """Carries text forward: text is null for frames that come before any, or after an empty one, without their own (own). place counts the recording's frames.

    Rows without frame_index say that a recording has begun (place 0), or how many frames it has and how long it is.
    """

    HOLDS = ("text string", "skipped boolean")
    KEPT = ("carried string", "place bigint")
    GIVES = ("frame_index bigint", "timestamp_ms bigint", "text string", "own boolean", "place bigint", "total bigint", "duration_ms bigint")

    def mark(self, beginning):
        if beginning is None:
            return (None, None, None, None, 0, None, None)
        return (None, None, None, None, None, *(None if pd.isna(x) else int(x) for x in (beginning.total, beginning.duration_ms)))

    def taken(self, kept, frames, total):
        carried, place = kept or ("", 0)
        out = []
        for index, at, text, skipped in frames:
            place += 1
            own = text is not None and not skipped
            carried = text if own else carried
            out.append((index, at, carried if own else carried or None, own, place, total, None))
        return (carried, place), out


class SkipGate(InOrder):
    """Decides frame by frame which are skipped, from the last kept hash and the run of skips."""

    HOLDS = ("hash array<bigint>",)
    KEPT = ("last array<bigint>", "run int")
    GIVES = ("frame_index bigint", "skipped boolean")

    def __init__(self, threshold: int = THRESHOLD, max_run: int = MAX_RUN, delay: int = 0, idle: int = IDLE_MS):
        super().__init__(delay, idle)
        self.threshold, self.max_run = threshold, max_run

    def taken(self, kept, frames, total):
        last, run = kept or (None, 0)
        gate = Gate(None if last is None else [int(x) for x in last], run, self.threshold, self.max_run)
        out = [(index, gate.skips(words)) for index, _, words in frames]
        return (gate.last, gate.run), out


class Progress(StatefulProcessor):
    """A row after every so many frames with the incidents so far. The rows of a recording come in the order of place: a row for each frame, one for each finding.

    State are the last time of each secret, and the number of incidents that have begun; both go with the end of the recording.
    """

    def __init__(self, every: int, gap: int):
        self.every, self.gap = every, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "pattern_id string, preview string, token_len int", "at bigint")
        self.begun = handle.getValueState("begun", "n bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        begun = self.begun.get()[0] if self.begun.exists() else 0
        out, over = [], False
        every = pd.concat(list(rows))
        over = bool(every["done"].any())
        told = every[~every["done"]].sort_values(["place", "frame_row"])
        for r in told.itertuples(index=False):
            if not r.frame_row:
                secret, at = (r.pattern_id, r.preview, int(r.token_len)), int(r.timestamp_ms)
                last = self.seen.getValue(secret) if self.seen.containsKey(secret) else None
                if last is None or at - last[0] > self.gap:
                    begun += 1
                self.seen.updateValue(secret, (at if last is None else max(at, last[0]),))
            elif r.place % self.every == 0:
                percent = None if pd.isna(r.total) or not r.total else min(100, int(r.place * 100 / r.total + 0.5))
                out.append((key[0], int(r.frame_index), int(r.place), percent, begun))
        if over:
            self.seen.clear()
            self.begun.clear()
        else:
            self.begun.update((begun,))
        made = pd.DataFrame(out, columns=["recording_id", "frame_index", "done", "percent", "incidents_so_far"])
        yield made.astype({c: "Int64" for c in made.columns[1:]})

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, processor: InOrder) -> DataFrame:
    """What the processor gives for a stream of rows with recording_id, frame_index, timestamp_ms, what it holds, done, total, duration_ms and expected (these four may be missing)."""
    missing = {c: F.lit(v).cast(kind) for c, v, kind in (("done", False, "boolean"), ("total", None, "long"), ("duration_ms", None, "long"), ("expected", None, "long")) if c not in rows.columns}
    holds = [h.split(" ")[0] for h in processor.HOLDS]
    named = rows.withColumns(missing).select("recording_id", "frame_index", "timestamp_ms", *holds, "done", "total", "duration_ms", "expected")
    kind = rows.schema["recording_id"].dataType.simpleString()
    schema = StructType.fromDDL(", ".join((f"recording_id {kind}", *processor.GIVES, "done boolean", "late bigint")))
    return named.groupBy("recording_id").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


def progress(rows: DataFrame, every: int, gap: int) -> DataFrame:
    """(recording_id, frame_index, done, percent, incidents_so_far) of a stream of frames and findings in their order (see Progress)."""
    kind = rows.schema["recording_id"].dataType.simpleString()
    schema = StructType.fromDDL(f"recording_id {kind}, frame_index bigint, done bigint, percent bigint, incidents_so_far bigint")
    return rows.groupBy("recording_id").transformWithStateInPandas(Progress(every, gap), schema, "Append", "ProcessingTime")
