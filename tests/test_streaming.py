"""Streams give what the batch forms give."""

import datetime as dt

from pyspark.sql import functions as F

from ledgerline.streaming import jobs as J
from ledgerline.streaming.limits import limited, limited_stream


def _write(spark, path, rows, schema, parts=3):
    spark.createDataFrame(rows, schema).repartitionByRange(parts, "seq").sortWithinPartitions("seq").write.parquet(path)


def test_rate_limit_stream(spark, tmp_path):
    t0, kinds = dt.datetime(2024, 1, 1), ["failure"] * 7 + ["reset", "failure", "other"] + ["failure"] * 3
    rows = [(k, i, t0 + dt.timedelta(seconds=i * (9 + k)), kinds[(i + k) % len(kinds)]) for k in range(5) for i in range(40)]
    schema = "key int, seq long, ts timestamp, kind string"
    _write(spark, f"{tmp_path}/in", rows, schema, 1)
    want = sorted(map(tuple, limited(spark.createDataFrame(rows, schema)).collect()))
    stream = limited_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("limits").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("limits").collect())) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_rate_limit_rule(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [("a", i, at(i), "failure") for i in range(7)] + [("a", 7, at(61), "failure"), ("a", 8, at(62), "reset")]
    got = limited(spark.createDataFrame(rows, "key string, seq long, ts timestamp, kind string")).orderBy("seq").collect()
    assert [r.failures for r in got] == [1, 2, 3, 4, 5, 6, 7, 1, 0] and [r.limited for r in got] == [False] * 5 + [True] * 2 + [False] * 2


def test_queue_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"j{i % 6}", i, t0 + dt.timedelta(minutes=i), ("pending", "parsing", "failed")[i // 6]) for i in range(18)]
    schema = "job string, seq long, ts timestamp, state string"
    _write(spark, f"{tmp_path}/in", rows, schema)
    seen = []
    q = J.run_queue(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), lambda df, n: seen.extend(r.job for r in df.collect()), f"{tmp_path}/c")
    q.awaitTermination(120)
    assert sorted(seen) == [f"j{i}" for i in range(6)]
    q = J.states_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = J.current(spark.createDataFrame(rows, schema))
    assert sorted(map(tuple, spark.table("states").collect())) == sorted(map(tuple, batch.collect()))
    assert J.illegal_moves(spark.createDataFrame(rows, schema)).count() == 0


def test_retention_keeps_enough(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"j{i}", ("complete", "failed", "duplicate")[i % 3], t0, t0 + dt.timedelta(hours=i)) for i in range(90)]
    df = spark.createDataFrame(rows, "job string, state string, created_at timestamp, updated_at timestamp")
    gone = {r.job for r in J.retention(df, F.to_timestamp(F.lit("2024-01-20")), 50).collect()}
    assert gone == {f"j{i}" for i in (0, 1, 3, 4, 6, 7, 9, 10, 12, 13)}
