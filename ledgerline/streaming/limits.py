"""Rate limits by key: a window opens at the first failure, a success closes it."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ledgerline.storage import materialize


def _step(opened: float | None, n: int, at: float, kind: str, window: float) -> tuple[float | None, int]:
    if kind == "reset":
        return None, 0
    if kind != "failure":
        return opened, n
    if opened is None or at - opened > window:
        return at, 1
    return opened, n + 1


def limited(events: DataFrame, window_seconds: float = 60, most: int = 5) -> DataFrame:
    """(key, seq, ts, failures, limited) for each event (key, ts, seq, kind), in order of time.

    kind is failure, reset or anything else; a window opens at the first failure
    and counts for ``window_seconds``; limited says that it holds more than
    ``most``.

    Events are dealt by ranges of (key, ts, seq), so a key of any size, in one
    window or many, lies in as many blocks as it fills.  What a block makes of
    the window that was open before it is a few steps (see summary()); those of
    a key are chained to give each block the window it begins with, and the
    blocks are folded side by side.
    """
    ts, window = F.col("ts").cast("timestamp"), round(window_seconds * 1_000_000)
    rows = events.select("key", F.col("seq").cast("long").alias("seq"), ts.alias("ts"), "kind", F.unix_micros(ts).alias("at"))
    order = ("key", "at", "seq")
    dealt = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "limit-events")
    key = rows.schema["key"]
    blocks = ("key", "part")
    steps = dealt.select(*order, "part", "kind").repartition(*blocks).sortWithinPartitions(*blocks, "at", "seq").mapInArrow(_summaries(window), T.StructType([key, *_BLOCK.fields]))
    opened = steps.repartition("key").sortWithinPartitions(*blocks).mapInArrow(_chained(window), T.StructType([key, *_OPENED.fields]))
    none = F.lit(None)
    first = opened.select("key", none.cast("long").alias("seq"), none.cast("timestamp").alias("ts"), none.cast("string").alias("kind"), "at", "part", "n")
    both = dealt.withColumn("n", none.cast("long")).unionByName(first).repartition(*blocks).sortWithinPartitions(*blocks, F.col("n").asc_nulls_last(), "at", "seq")
    folded = both.mapInArrow(_fold(window), T.StructType([key, *(rows.schema[c] for c in ("seq", "ts")), T.StructField("failures", T.IntegerType())]))
    return folded.withColumn("limited", F.col("failures") > most)


_BLOCK = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("m", T.LongType()), *(T.StructField(c, T.ArrayType(T.LongType())) for c in ("upto", "exit_at", "exit_n"))])
_OPENED = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("n", T.LongType())])
_NEVER = (1 << 63) - 1


def summary(rows: list[tuple[int, str | None]], window: int) -> tuple[int, list[int], list[int | None], list[int]]:
    """(m, upto, exit_at, exit_n) of a block's rows (at, kind), in order.

    A window that was opened at o before the block ends at the first failure
    after o + window, which opens the next one, and so on; the first ``upto``
    beyond o + window names the window that is open at the block's end, since
    exit_at, with exit_n failures.  If none lies beyond, the old window goes on
    with m more.  After a reset nothing depends on what was before.
    """
    last = max((i for i, (_, kind) in enumerate(rows) if kind == "reset"), default=-1)
    if last >= 0:
        opened, n = None, 0
        for at, kind in rows[last + 1 :]:
            opened, n = _step(opened, n, at, kind, window)
        return 0, [_NEVER], [opened], [n]
    f = [at for at, kind in rows if kind == "failure"]
    m = len(f)
    end = list(range(m))  # the last window of the chain that starts here
    j = m
    for i in range(m - 1, -1, -1):
        while j > i + 1 and f[j - 1] - f[i] > window:
            j -= 1
        if j < m:
            end[i] = end[j]
    runs = [i for i in range(m) if i + 1 == m or end[i + 1] != end[i]]
    return m, [f[i] for i in runs], [f[end[i]] for i in runs], [m - end[i] for i in runs]


def after_block(opened: int | None, n: int, m: int, upto: list[int], exit_at: list[int | None], exit_n: list[int], window: int) -> tuple[int | None, int]:
    """The window that is open after a block with this summary."""
    if not upto:
        return opened, n
    k = 0 if opened is None else bisect_right(upto, opened + window) if upto[-1] != _NEVER else 0
    return (opened, n + m) if k == len(upto) else (exit_at[k], exit_n[k])


def _summaries(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, rows = None, []

        def done() -> pa.RecordBatch:
            found = (own[0], own[1], *summary(rows, window))
            types = (key_type, pa.int32(), pa.int64(), *[pa.list_(pa.int64())] * 3)
            return pa.record_batch([pa.array([v], t) for v, t in zip(found, types)], names=("key", *_BLOCK.names))

        for batch in batches:
            key_type = batch.schema.field("key").type
            for key, part, at, kind in zip(*(batch[c].to_pylist() for c in ("key", "part", "at", "kind"))):
                if (key, part) != own:
                    if own:
                        yield done()
                    own, rows = (key, part), []
                if kind in ("failure", "reset"):
                    rows.append((at, kind))
        if own:
            yield done()

    return run


def _chained(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, opened, n = (), None, 0
        for batch in batches:
            found = []
            for key, part, m, *steps in zip(*(batch[c].to_pylist() for c in ("key", *_BLOCK.names))):
                if (key,) != own:
                    own, opened, n = (key,), None, 0
                found.append((opened, n))
                opened, n = after_block(opened, n, m, *steps, window)
            yield pa.record_batch([batch["key"], batch["part"], pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], names=("key", *_OPENED.names))

    return run


def _fold(window: int):
    """A block's first row holds the window that is open before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, n = None, 0
        for batch in batches:
            shown, kept = [], []
            for i, (at, kind, before) in enumerate(zip(*(batch[c].to_pylist() for c in ("at", "kind", "n")))):
                if before is not None:
                    opened, n = at, before
                    continue
                opened, n = _step(opened, n, at, kind, window)
                shown.append(0 if opened is None or at - opened > window else n)
                kept.append(i)
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.record_batch([rows["key"], rows["seq"], rows["ts"], pa.array(shown, pa.int32())], names=("key", "seq", "ts", "failures"))

    return run


def limited_stream(events: DataFrame, window_seconds: float = 60, most: int = 5) -> DataFrame:
    """limited() on a streaming DataFrame whose events come in order; a key's state goes after two windows without events.

    Time is the clock's here; ordered.limited_events() goes by event time.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        opened = None if opened is None or opened < 0 else opened
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
        out = []
        for r in rows.itertuples():
            at = r.ts.timestamp()
            opened, n = _step(opened, n, at, r.kind, window_seconds)
            shown = 0 if opened is None or at - opened > window_seconds else n
            out.append((key[0], r.seq, r.ts, shown, shown > most))
        state.update((-1.0 if opened is None else opened, n))
        state.setTimeoutDuration(int(2000 * window_seconds))
        yield pd.DataFrame(out, columns=["key", "seq", "ts", "failures", "limited"])

    schema = f"key {events.schema['key'].dataType.simpleString()}, seq long, ts timestamp, failures int, limited boolean"
    return events.groupBy("key").applyInPandasWithState(fold, schema, "opened double, n int", "append", GroupStateTimeout.ProcessingTimeTimeout)
