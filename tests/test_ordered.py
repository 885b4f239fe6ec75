"""Event-time streams give the batch result however the events are dealt into micro-batches."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerline.streaming import ordered as O
from ledgerline.streaming.limits import limited

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "key int, seq long, ts timestamp, kind string"
FAR = T0 + dt.timedelta(days=9)


@pytest.fixture(scope="module")
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", O.ROCKSDB)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def run(spark, tmp_path, rows, build, name, seed, batches):
    """The rows of a stream fed with rows in this many files, out of order but not later than allowed."""
    r = random.Random(seed)
    # a row may come up to 600 s after ones that are newer
    late = sorted(rows, key=lambda x: x[2] + dt.timedelta(seconds=r.uniform(0, 590)))
    cuts = sorted(r.sample(range(1, len(late)), batches - 1))
    for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(late)])):
        spark.createDataFrame(late[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:03d}")
    # nothing waits for ever: a last event of a key of its own moves the watermark past all others, one more closes it
    for k in (0, 1):
        spark.createDataFrame([(-1, k, FAR + dt.timedelta(days=k), "other")], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{900 + k}")
    import glob
    import os

    for k, f in enumerate(sorted(glob.glob(f"{tmp_path}/in/*/*.parquet"))):
        os.utime(f, (1_600_000_000 + k, 1_600_000_000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return sorted((tuple(x) for x in spark.table(name).where("key >= 0").collect()), key=repr)


def made(kinds, n, seed, span=4000):
    r = random.Random(seed)
    return [(r.choice([0, 0, 0, 1, 2]), i, T0 + dt.timedelta(seconds=r.randrange(span), microseconds=r.choice([0, 1, 999])), r.choice(kinds)) for i in range(n)]


@pytest.mark.parametrize("seed, batches", [(1, 2), (2, 6)])
def test_rate_limits_in_any_split(rocks, tmp_path, seed, batches):
    rows = made(["failure"] * 5 + ["reset", "other", None], 250, 7)
    got = run(rocks, tmp_path, rows, lambda s: O.limited_events(s, "600 seconds"), f"limits{seed}", seed, batches)
    assert got == sorted(map(tuple, limited(rocks.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    assert any(x[-1] for x in got)


def test_due_jobs_in_any_split(rocks, tmp_path):
    rows = made(["parsing", "failed", "failed", "complete", "pending", "extracting", None], 60, 3, 40_000)
    want = sorted(map(tuple, O.due_jobs(rocks.createDataFrame(rows, SCHEMA), F.lit(FAR - dt.timedelta(seconds=700)).cast("timestamp")).collect()), key=repr)
    got = run(rocks, tmp_path, rows, lambda s: O.due_jobs_stream(s, "600 seconds"), "due", 5, 4)
    assert got == want and {x[2] for x in got} == {"retry", "requeue"}


def test_deadlines_by_hand(spark):
    at = lambda s: T0 + dt.timedelta(seconds=s)
    rows = [(1, 0, at(0), "parsing"), (1, 1, at(1800), "extracting"), (2, 0, at(0), "parsing"), (2, 1, at(1801), "complete"), (3, 0, at(0), "failed"), (3, 1, at(10), "failed"), (3, 2, at(20), "failed"), (3, 3, at(30), "failed"), (4, 0, at(0), "pending")]
    got = sorted((r.key, (r.ts - T0).total_seconds(), r.action, r.failures) for r in O.due_jobs(spark.createDataFrame(rows, SCHEMA), F.lit(at(9000)).cast("timestamp")).collect())
    assert got == [(1, 3600.0, "requeue", 0), (2, 1800.0, "requeue", 0), (3, 1.0, "retry", 1), (3, 12.0, "retry", 2), (3, 24.0, "retry", 3)]


def test_provider_is_asked_for(spark, monkeypatch):
    monkeypatch.setattr(O, "ROCKSDB", "another provider")
    with pytest.raises(ValueError):
        O.ordered_stream(spark.createDataFrame([(1, 1, T0, "x")], SCHEMA), "1 second", (0,), "n int", "m int", lambda s, r: (s, (1,)))
