"""The state machine of import sources, over a stream of what happens to them and over a table of it.

A source is IDLE until a run claims it (RUNNING); the run ends in SUCCESS (also if nothing was modified),
FAILED, which counts a retry, or MISCONFIGURED, which does not; a retry by hand makes it IDLE again.
A claim of a running source is refused. A run that has not ended STUCK after its claim fails by
itself: in the stream by a timer on event time, and, where the next event of the source comes
later than that, before this event is looked at.
"""

from __future__ import annotations

import heapq
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Microseconds after which a run counts as stuck, and characters of an error that are kept.
STUCK, ERROR = 30 * 60 * 1_000_000, 1_000
#: Rows of a source that a task sorts at a time, and that it reads back or hands on at a time.
SORTED, CHUNK = 100_000, 5_000
#: What can happen to a source.
KINDS = ("claim", "success", "not_modified", "failed", "misconfigured", "retry")
TIMED_OUT = "Import timed out"
STATE = "status string, retry_count int, last_import long, last_success long, last_event_count long, last_error string"
COLUMNS = ("source", "at_us", "kind", "taken", "status", "retry_count", "last_import", "last_success", "last_event_count", "last_error")
SCHEMA = f"source string, at_us long, kind string, taken boolean, {STATE}"


@dataclass(frozen=True)
class State:
    """Of a source; times in microseconds since 1970."""

    status: str = "IDLE"
    retry_count: int = 0
    last_import: int | None = None
    last_success: int | None = None
    last_event_count: int | None = None
    last_error: str | None = None

    def values(self) -> tuple:
        return self.status, self.retry_count, self.last_import, self.last_success, self.last_event_count, self.last_error

    @property
    def deadline(self) -> int | None:
        """When the run fails by itself, if one is on."""
        return self.last_import + STUCK if self.status == "RUNNING" else None

    def timed_out(self) -> State:
        return replace(self, status="FAILED", retry_count=self.retry_count + 1, last_error=TIMED_OUT)

    def after(self, at: int, kind: str, count: int | None, error: str | None) -> State | None:
        """The state that follows; None for a refused claim. Unknown kinds are an error."""
        if kind == "claim":
            return None if self.status == "RUNNING" else replace(self, status="RUNNING", last_import=at, last_error=None)
        if kind in ("success", "not_modified"):
            return replace(self, status="SUCCESS", retry_count=0, last_import=at, last_success=at, last_event_count=count if kind == "success" else 0, last_error=None)
        if kind in ("failed", "misconfigured"):
            text = (error or "Unknown error during import")[:ERROR]
            return replace(self, status=kind.upper(), retry_count=self.retry_count + (kind == "failed"), last_import=at, last_error=text)
        if kind == "retry":
            return replace(self, status="IDLE", retry_count=0, last_error=None)
        raise ValueError(f"no such kind: {kind}")


def steps(state: State, events: Iterator[tuple]) -> Iterator[tuple[int, str, bool, State]]:
    """(at, kind, taken, state after it) for events (at, kind, count, error) in order, time-outs among them."""
    for at, kind, count, error in events:
        if state.deadline is not None and at > state.deadline:
            due, state = state.deadline, state.timed_out()
            yield due, "timeout", True, state
        new = state.after(at, kind, count, error)
        state = state if new is None else new
        yield at, kind, new is not None, state


def _rows(frame: pd.DataFrame) -> list[tuple]:
    counts = [None if pd.isna(x) else int(x) for x in frame["n_events"]]
    errors = [None if pd.isna(x) else x for x in frame["error"]]
    return list(zip(map(int, frame["at_us"]), frame["kind"], counts, errors, strict=True))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=list(COLUMNS)).astype({c: "Int64" for c in ("last_import", "last_success", "last_event_count")})


_FILED = pa.schema([("at_us", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("n_events", pa.int64()), ("error", pa.string())])


def in_order(frames: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    """(at, kind, count, error) of all rows by at_us and seq, equal ones as they came: SORTED rows are sorted at a
    time and wait in a file of the task's own, from which CHUNK rows at a time are merged."""
    files: list = []
    waiting, size = [], 0

    def file() -> None:
        table = pa.Table.from_pandas(pd.concat(waiting)[_FILED.names].sort_values(["at_us", "seq"], kind="stable"), _FILED, preserve_index=False)
        f = tempfile.TemporaryFile()  # noqa: SIM115
        files.append(f)
        with pa.ipc.new_stream(f, _FILED) as out:
            out.write_table(table, CHUNK)

    def read(f) -> Iterator[tuple]:
        f.seek(0)
        for batch in pa.ipc.open_stream(f):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    try:
        for frame in frames:
            waiting.append(frame)
            size += len(frame)
            if size >= SORTED:
                file()
                waiting, size = [], 0
        if not files:  # all of it is small
            for batch in waiting and [pd.concat(waiting).sort_values(["at_us", "seq"], kind="stable")]:
                yield from _rows(batch)
            return
        if waiting:
            file()
            waiting = []
        for at, _, kind, count, error in heapq.merge(*map(read, files), key=itemgetter(0, 1)):
            yield at, kind, count, error
    finally:
        for f in files:
            f.close()


class Sources(StatefulProcessor):
    """Keeps each source's state and the timer of its run."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", STATE)

    def _read(self) -> State:
        return State(*[None if x is None or x != x else x for x in self.state.get()]) if self.state.exists() else State()

    def _write(self, old: State, new: State) -> None:
        self.state.update(new.values())
        if old.deadline != new.deadline:
            # timers count in milliseconds, rounded up: none fires before its run is stuck
            if old.deadline is not None:
                self.handle.deleteTimer(-(-old.deadline // 1_000))
            if new.deadline is not None:
                self.handle.registerTimer(-(-new.deadline // 1_000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # what a batch has of a source comes in any order
        old = state = self._read()
        out = []
        for at, kind, taken, new in steps(old, in_order(rows)):
            out.append((key[0], at, kind, taken, *new.values()))
            state = new
            if len(out) >= CHUNK:
                yield _frame(out)
                out = []
        self._write(old, state)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self._read()
        if old.deadline is None or -(-old.deadline // 1_000) > expiredTimerInfo.getExpiryTimeInMs():
            yield _frame([])
            return
        new = old.timed_out()
        self.state.update(new.values())
        yield _frame([(key[0], old.deadline, "timeout", True, *new.values())])

    def close(self) -> None:
        pass


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def streamed(runs: DataFrame, time: str = "ts") -> DataFrame:
    """What happens to sources, as a stream in append mode, from a stream of runs (source, at_us in microseconds,
    seq to order equal times, kind, n_events, error, and time, a timestamp with a watermark). State
    is one row and at most one timer for a source."""
    runs.sparkSession.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return runs.groupBy("source").transformWithStateInPandas(statefulProcessor=Sources(), outputStructType=SCHEMA, outputMode="Append", timeMode="eventTime")


def replayed(runs: DataFrame, until: int | None = None) -> DataFrame:
    """The same from a table of runs: each source's events in order, in constant memory. Runs that are still on
    fail if they are stuck by `until` (microseconds; null: none does)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, state = None, State()
        for batch in batches:
            out = []
            for source, event in zip(batch["source"], _rows(batch), strict=True):
                if source != name:
                    if name is not None:
                        out += last(name, state)
                    name, state = source, State()
                for at, kind, taken, new in steps(state, iter([event])):
                    out.append((source, at, kind, taken, *new.values()))
                    state = new
            yield _frame(out)
        if name is not None:
            yield _frame(last(name, state))

    def last(name: str, state: State) -> list[tuple]:
        due = state.deadline
        return [(name, due, "timeout", True, *state.timed_out().values())] if due is not None and until is not None and due <= until else []

    ordered = runs.select("source", "at_us", "seq", "kind", "n_events", "error").repartition("source").sortWithinPartitions("source", "at_us", "seq")
    return ordered.mapInPandas(run, SCHEMA)


def runs_of(events: DataFrame) -> DataFrame:
    """Ten sources and what happens to them, made of a table or a stream of events."""
    k = F.col("event_id")
    kind = F.when(F.col("event_type").isin("view", "purchase"), "claim").when(F.col("event_type") == "click", "success").when(F.col("event_type") == "error", "failed")
    kind = kind.when(k % 3 == 0, "misconfigured").when(k % 3 == 1, "retry").otherwise("not_modified")
    return events.select(
        F.concat(F.lit("source-"), (F.col("user_id") % 10).cast("string")).alias("source"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), k.alias("seq"), kind.alias("kind"), F.floor("value").cast("long").alias("n_events"),
        F.when(k % 4 != 0, F.concat(F.lit("error "), (k % 9).cast("string"))).alias("error"), "ts",
    )
