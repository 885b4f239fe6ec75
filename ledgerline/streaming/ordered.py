"""Streams folded in the order of event time, however they come in micro-batches.

A key's rows wait until the watermark has passed them, so rows that are late,
but not later than the watermark allows, stand where they belong; then they are
folded by time and sequence number.  Timers are of event time as well: what is
due by a deadline comes out once the watermark has passed it, not when a clock
says so.  So a replay gives the same rows as the batch form.

Needs spark.sql.streaming.stateStore.providerClass set to RocksDB's provider.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ledgerline.schema import ACTIVE_STATES
from ledgerline.streaming.limits import _step

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Microseconds since the epoch, sequence number, kind.
Row = tuple[int, int, str | None]
#: (state, row) -> (new state, values to put out beside key, seq and ts; None for no row)
Fold = Callable[[tuple, Row], tuple[tuple, tuple | None]]
#: state -> (when something is due, values to put out then, state afterwards), or None
Due = Callable[[tuple], tuple[int, tuple, tuple] | None]


def fold_rows(state: tuple, rows: list[Row], until: int | None, fold: Fold, due: Due | None) -> tuple[tuple, list[tuple]]:
    """Folds rows in order and fires what is due before them, and by ``until``: (state, [(ts, seq, values)])."""
    out = []

    def fire(state: tuple, before: int | None) -> tuple:
        while due and (d := due(state)) is not None and before is not None and d[0] < before:
            out.append((d[0], None, d[1]))
            state = d[2]
        return state

    for row in sorted(rows, key=lambda r: (r[0], r[1])):
        state = fire(state, row[0])
        state, values = fold(state, row)
        if values is not None:
            out.append((row[0], row[1], values))
    return fire(state, None if until is None else until + 1), out


class _Ordered(StatefulProcessor):
    def __init__(self, start: tuple, state: T.StructType, columns: list[str], fold: Fold, due: Due | None):
        self.start, self.state_type, self.columns, self.fold, self.due = start, state, columns, fold, due

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", T.StructType([T.StructField("at", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType())]))
        self.held = handle.getValueState("held", self.state_type)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        timers = set()
        for frame in rows:
            new = [(int(a), int(s), None if k is None or k != k else k) for a, s, k in zip(frame["at"], frame["seq"], frame["kind"])]
            self.pending.appendList(new)
            timers |= {_millis(a) for a, _, _ in new}
        for t in timers:
            self.handle.registerTimer(t)
        yield self._frame(key, [])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        waiting = [tuple(r) for r in self.pending.get()] if self.pending.exists() else []
        ready, later = [r for r in waiting if r[0] <= until], [r for r in waiting if r[0] > until]
        state = tuple(self.held.get()) if self.held.exists() else self.start
        state, out = fold_rows(state, ready, until, self.fold, self.due)
        if ready:
            self.pending.clear()
            if later:
                self.pending.put(later)
        self.held.update(state)
        if self.due and (d := self.due(state)) is not None:
            self.handle.registerTimer(_millis(d[0]))
        yield self._frame(key, out)

    def _frame(self, key: Any, out: list[tuple]) -> pd.DataFrame:
        rows = [(key[0], seq, pd.Timestamp(ts, unit="us"), *values) for ts, seq, values in out]
        frame = pd.DataFrame(rows, columns=["key", "seq", "ts", *self.columns])
        return frame.astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    return -(-micros // 1000)


def ordered_stream(events: DataFrame, lateness: str, start: tuple, state: str, columns: str, fold: Fold, due: Due | None = None) -> DataFrame:
    """Folds events (key, seq, ts, kind), a stream, by key in the order of (ts, seq): rows (key, seq, ts, columns).

    Events later than ``lateness`` behind the newest one seen are left out, all
    others count whenever they come.  A key's waiting rows are those within
    lateness, and its state is one row.  Rows that fire at a deadline have a
    null seq and the deadline as ts.
    """
    spark = events.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    extra = T._parse_datatype_string(columns)
    key = events.schema["key"].dataType
    out = T.StructType([T.StructField("key", key), T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()), *extra.fields])
    rows = events.select("key", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), "kind").withWatermark("ts", lateness).withColumn("at", F.unix_micros("ts"))
    processor = _Ordered(start, T._parse_datatype_string(state), [f.name for f in extra.fields], fold, due)
    return rows.groupBy("key").transformWithStateInPandas(processor, out, "append", "EventTime")


# --- rate limits ------------------------------------------------------------------------------------------------------


def limited_events(events: DataFrame, lateness: str, window_seconds: float = 60, most: int = 5) -> DataFrame:
    """limits.limited() on a stream, in event time."""

    def fold(state: tuple, row: Row) -> tuple[tuple, tuple]:
        at = row[0] / 1e6
        opened, n = _step(state[0], state[1], at, row[2], window_seconds)
        shown = 0 if opened is None or at - opened > window_seconds else n
        return (opened, n), (shown, shown > most)

    return ordered_stream(events, lateness, (None, 0), "opened double, n int", "failures int, limited boolean", fold)


# --- stale jobs and retries -------------------------------------------------------------------------------------------

STALE_SECONDS, RETRIES, BASE_MS, MOST_MS = 1800, 3, 1000, 30_000


def wait_micros(kind: str | None, failures: int) -> int | None:
    """How long a job may rest in a state before something is due; failures counts those so far, this one included."""
    if kind in ACTIVE_STATES:
        return STALE_SECONDS * 1_000_000
    if kind == "failed" and failures <= RETRIES:
        return min(BASE_MS * 2 ** (failures - 1), MOST_MS) * 1000
    return None


def _due(state: tuple) -> tuple[int, tuple, tuple] | None:
    kind, failures, at = state
    wait = wait_micros(kind, failures)
    return None if wait is None or at is None else (at + wait, ("retry" if kind == "failed" else "requeue", failures), (None, failures, None))


def due_jobs_stream(events: DataFrame, lateness: str) -> DataFrame:
    """due_jobs() on a stream of events (key, seq, ts, kind), in event time."""

    def fold(state: tuple, row: Row) -> tuple[tuple, None]:
        return (row[2], state[1] + (row[2] == "failed"), row[0]), None

    out = ordered_stream(events, lateness, (None, 0, None), "kind string, failures int, at long", "action string, failures int", fold, _due)
    return out.select("key", "ts", "action", "failures")


def due_jobs(events: DataFrame, as_of: Column) -> DataFrame:
    """(key, ts, action, failures): when jobs are due to be queued again, up to as_of.

    An active job without an event for STALE_SECONDS is requeued, a failed one
    tried again after a wait that doubles with each failure, RETRIES times; an
    event by then, the same instant included, comes before.
    """
    own = W.partitionBy("key").orderBy("ts", "seq")
    e = events.select("key", "kind", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.unix_micros(F.lead(F.col("ts").cast("timestamp")).over(own)).alias("next"), F.sum(F.coalesce((F.col("kind") == "failed").cast("int"), F.lit(0))).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)).cast("int").alias("failures"))
    doubled = F.least(BASE_MS * F.pow(F.lit(2.0), F.col("failures") - 1), F.lit(float(MOST_MS))).cast("long") * 1000
    wait = F.when(F.col("kind").isin(*ACTIVE_STATES), F.lit(STALE_SECONDS * 1_000_000).cast("long")).when((F.col("kind") == "failed") & (F.col("failures") <= RETRIES), doubled)
    due = e.withColumn("due", F.col("at") + wait).where(F.col("due").isNotNull() & (F.col("next").isNull() | (F.col("next") > F.col("due"))) & (F.col("due") <= F.unix_micros(as_of)))
    return due.select("key", F.timestamp_micros("due").alias("ts"), F.when(F.col("kind") == "failed", "retry").otherwise("requeue").alias("action"), "failures")
