"""The status of documents while they are processed: a state machine over events, on tables and on streams.

A document is queued, goes through four processing steps with rising progress, and ends completed or failed. An event counts
if its transition is allowed: a step must lie ahead of the present one (messages may be lost), a document can fail while it
is open, and be queued again once it has ended. An open document without any event for a while fails by time-out.

On a table, events are sorted by document and time into ranges, so the events of one document may lie in several tasks.
A run of events is a function from the state before it to the state after it; these few functions, one or two for each
range, are chained on the driver, and then every range is replayed from its true state. On a stream, events wait until the
watermark has passed them and are replayed in order of time, so late ones within the watermark change nothing.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.operators.graph import kept

# Steps with their status, progress and message, in order.
STEPS = {
    "queued": ("queued", 0, "Queued for processing"),
    "extracting": ("processing", 10, "Extracting text"),
    "analyzing": ("processing", 40, "Text extracted, analyzing with AI"),
    "indexing": ("processing", 80, "AI analysis complete, indexing for search"),
    "finalizing": ("processing", 95, "Finalizing"),
    "completed": ("completed", 100, "Complete"),
    "failed": ("failed", None, None),
}
NAMES = [None, *STEPS]  #: of states; state 0 is a document not met yet
COMPLETED, FAILED = NAMES.index("completed"), NAMES.index("failed")


def allowed(state: int, step: int) -> bool:
    """Whether a document may go from a state to a step, both by their place in NAMES."""
    is_open = 0 < state < COMPLETED
    if step == 1:
        return not is_open
    if step == FAILED:
        return is_open
    return state < step and state < COMPLETED


#: The state after a step, by state and step. A step that is not allowed changes nothing.
NEXT = [[step if allowed(state, step) else state for step in range(len(NAMES))] for state in range(len(NAMES))]

TRANSITIONS = "at long, event_id long, step_before string, step string, status string, progress int, message string, reason string"
COLUMNS = [c.split()[0] for c in TRANSITIONS.split(", ")]
MICRO = dt.timedelta(microseconds=1)


def micros(ts: dt.datetime | pd.Timestamp) -> int:
    """Microseconds since 1970; times without a zone are read as UTC."""
    zone = ts if ts.tzinfo else ts.replace(tzinfo=dt.UTC)
    return (zone - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // MICRO


class Replay:
    """One document's state and the time of its last event, both in microseconds."""

    def __init__(self, timeout: int, state: int = 0, last: int | None = None):
        self.timeout, self.state, self.last = timeout, state, last

    def expire(self, now: int) -> tuple | None:
        """The transition by time-out, if one is due at `now`."""
        if self.last is None or not 0 < self.state < COMPLETED or now - self.last < self.timeout:
            return None
        before, self.state = self.state, FAILED
        return (self.last + self.timeout, None, before, FAILED, "timeout")

    def event(self, ts: int, event_id: int | None, step: int) -> Iterator[tuple]:
        """The transitions that an event brings: (ts, event_id, state before, state, reason)."""
        late = self.expire(ts)
        if late is not None:
            yield late
        before, self.state = self.state, NEXT[self.state][step]
        # A document queued anew after its end changes from one ended state; every allowed step changes the state.
        if self.state != before:
            yield (ts, event_id, before, self.state, "event")
        self.last = ts


def described(found: list[tuple]) -> list[list]:
    """Columns of TRANSITIONS for transitions of `Replay`."""
    rows = []
    for ts, event_id, before, state, reason in found:
        status, progress, message = STEPS[NAMES[state]]
        if reason == "timeout":
            message = "Timed out"
        elif state == FAILED:
            message = "Failed"
        rows.append((ts, event_id, NAMES[before], NAMES[state], status, progress, message, reason))
    return [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in COLUMNS]


def timed(found: DataFrame, events: DataFrame) -> DataFrame:
    """document_id, ts (of its type in `events`) and the other columns of TRANSITIONS."""
    return found.select("document_id", F.timestamp_micros("at").cast(events.schema["ts"].dataType).alias("ts"), *COLUMNS[1:])


def coded(events: DataFrame, step: str) -> DataFrame:
    """document_id, ts, event_id, code: events with a known step (an SQL expression), a time and a document; others bring no transition."""
    place = F.array_position(F.array(*map(F.lit, STEPS)), F.expr(step)).cast("int")
    return events.select("document_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), place.alias("code")).where("code > 0 and ts is not null and document_id is not null")


def transitions(events: DataFrame, step: str, *, timeout: str = "1 day", until: dt.datetime | None = None) -> DataFrame:
    """document_id, ts, event_id, step_before, step, status, progress, message, reason: every change of state that `events`
    (document_id, ts, event_id) bring, the SQL expression `step` naming their step; reason is "event" or "timeout".

    Events are taken by ts, then event_id; repeated rows bring nothing new, as a step does not lie ahead of itself. `until`
    is the time up to which open documents fail by time-out after their last event; without it they stay open.
    """
    spark = events.sparkSession
    limit = pd.Timedelta(timeout) // pd.Timedelta(microseconds=1)
    given = coded(events, step).withColumn("at", F.unix_micros("ts")).drop("ts")
    doc_type = events.schema["document_id"].dataType.simpleString()
    ordered = kept(given.repartitionByRange("document_id", "at", "event_id").sortWithinPartitions("document_id", "at", "event_id"))
    ends = _ends(ordered, limit, doc_type)
    starts, lasts = _chained(ends, limit)
    shared = spark.sparkContext.broadcast((starts, lasts))
    final = None if until is None else micros(until)

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        begin, last_doc = shared.value[0].get(part), shared.value[1].get(part)
        doc, now = None, Replay(limit)

        def out(names: list, found: list) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(described(found), types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(names, id_type), *columns], ["document_id", *COLUMNS])

        id_type = pa.int64()
        for batch in batches:
            id_type, names, found = batch.column(0).type, [], []
            for name, event_id, step_of, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != doc:
                    if doc is not None and final is not None and (late := now.expire(final)):
                        names.append(doc)
                        found.append(late)
                    # Only the first document of a range can have begun in an earlier one.
                    now = Replay(limit, *begin) if doc is None and begin else Replay(limit)
                    doc = name
                for t in now.event(at, event_id, step_of):
                    names.append(name)
                    found.append(t)
            yield out(names, found)
        # The last document of a range may go on in the next.
        if doc is not None and final is not None and last_doc and (late := now.expire(final)):
            yield out([doc], [late])

    return timed(ordered.mapInArrow(replay, f"document_id {doc_type}, {TRANSITIONS}"), events)


def _ends(ordered: DataFrame, limit: int, doc_type: str) -> list:
    """For each range the first and last document: number of the range, document, times of its first and last event there,
    and the state after them for every state before. At most two rows for each range come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, now, id_type = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            id_type = batch.column(0).type
            for name, _, step, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != name:
                    if now is not None and first is None:
                        first = now
                    now = [name, at, at, [Replay(limit, s) for s in range(len(NAMES))]]
                for r in now[3]:
                    for _ in r.event(at, None, step):
                        pass
                now[2] = at
        rows = [x for x in (first, now) if x is not None]
        if rows:
            columns = [pa.array([part] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()), pa.array([r[0] for r in rows], id_type), *(pa.array([r[i] for r in rows], pa.int64()) for i in (1, 2))]
            states = pa.array([[s.state for s in r[3]] for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*columns, states], ["part", "place", "doc", "first", "last", "after"])

    return sorted(ordered.mapInArrow(run, f"part int, place int, doc {doc_type}, first long, last long, after array<int>").collect(), key=lambda r: (r.part, r.place))


def _chained(ends: list, limit: int) -> tuple[dict[int, tuple[int, int]], dict[int, bool]]:
    """For each range, the state and last time with which its first document begins, and whether its last document ends there."""
    starts: dict[int, tuple[int, int]] = {}
    lasts: dict[int, bool] = {}
    doc, now, before = None, Replay(limit), None
    for r in ends:
        goes_on = r.place == 0 and r.doc == doc
        if r.place == 0:
            if before is not None:
                lasts[before] = not goes_on
            before = r.part
        state = 0
        if goes_on:
            starts[r.part] = (now.state, now.last)
            now.expire(r["first"])
            state = now.state
        doc, now = r.doc, Replay(limit, r.after[state], r["last"])
    if before is not None:
        lasts[before] = True
    return starts, lasts


def current(found: DataFrame) -> DataFrame:
    """document_id, status, progress, message, n_transitions, updated: where each document of `transitions` stands."""
    # At one time a time-out comes before an event, and events come by their number.
    order = F.struct("ts", F.col("event_id").isNotNull().alias("event"), "event_id")
    last = F.max_by(F.struct("status", "progress", "message"), order).alias("last")
    return found.groupBy("document_id").agg(last, F.count("*").alias("n_transitions"), F.max("ts").alias("updated")).select("document_id", "last.*", "n_transitions", "updated")


class _Machine(StatefulProcessor):
    """Events of one document, kept until the watermark has passed them, then replayed in order."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "state int, last long")
        self.waiting = handle.getListState("waiting", "at long, event_id long, code int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        due = set()
        for frame in rows:
            for at, event_id, code in zip(frame["at"], frame["event_id"], frame["code"], strict=True):
                if at >= passed:  # else it came too late
                    self.waiting.appendValue((int(at), None if pd.isna(event_id) else int(event_id), int(code)))
                    due.add(int(at) // 1000 + 1)
        for ms in due:
            self.handle.registerTimer(ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(((at, event_id, code) for at, event_id, code in self.waiting.get()), key=lambda r: (r[0], r[1] is not None, r[1] or 0))
        ready = [r for r in rows if r[0] < passed]
        if len(ready):
            self.waiting.put([r for r in rows if r[0] >= passed]) if len(ready) < len(rows) else self.waiting.clear()
        state, last = self.now.get() if self.now.exists() else (0, None)
        replay, found = Replay(self.timeout, state, last), []
        for at, event_id, code in ready:
            found += replay.event(at, event_id, code)
        late = replay.expire(passed)
        if late is not None:
            found.append(late)
        if replay.last is not None:
            self.now.update((replay.state, replay.last))
            if 0 < replay.state < COMPLETED:
                self.handle.registerTimer(-(-(replay.last + self.timeout) // 1000))
        if found:
            frame = pd.DataFrame(dict(zip(COLUMNS, described(found), strict=True)))
            frame["event_id"] = frame["event_id"].astype("Int64")
            frame["progress"] = frame["progress"].astype("Int32")
            frame.insert(0, "document_id", key[0])
            yield frame

    def close(self) -> None:
        pass


def stream_transitions(events: DataFrame, step: str, *, timeout: str = "1 day", lateness: str = "10 minutes") -> DataFrame:
    """`transitions` of a stream: each is written once the watermark, `lateness` behind the latest event, has passed its time.

    Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`). State is one row for each document and
    its events within the watermark; a document that has ended keeps its row, so that it can be queued again.
    """
    limit = pd.Timedelta(timeout) // pd.Timedelta(microseconds=1)
    doc_type = events.schema["document_id"].dataType.simpleString()
    given = coded(events, step).withColumn("at", F.unix_micros("ts")).withWatermark("ts", lateness)
    found = given.groupBy("document_id").transformWithStateInPandas(
        statefulProcessor=_Machine(limit), outputStructType=f"document_id {doc_type}, {TRANSITIONS}", outputMode="Append", timeMode="EventTime"
    )
    return timed(found, events)
