import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import mixing


def brute_targets(size):
    """Shares the words again and again until no source is above its stop."""
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(size.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        left, w = total - sum(capped.values()), sum(weight[s] for s in free)
        goal = {s: left * weight[s] / w for s in free}
        over = [s for s in free if goal[s] > 3 * size[s]]
        if not over:
            return capped | goal
        capped |= {s: 3 * size[s] for s in over}


def check(df):
    rows = mixing.mix_counts(df).collect()
    size, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        size[r.source] += r["size"]
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"]
    goal = brute_targets(size) if size else {}
    for r in rows:
        assert r.source_size == size[r.source] and r.target == pytest.approx(goal[r.source], abs=1e-6)
    for s in size:
        assert abs(taken[s] - goal[s]) <= most[s]
    return rows


def test_documents(documents):
    rows = check(documents)
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in documents.collect()}
    assert {r.doc_id: r["size"] for r in rows} == sizes
    again = mixing.mix_counts(documents.repartition(13)).collect()
    assert {r.doc_id: r.taken for r in rows} == {r.doc_id: r.taken for r in again}


def test_skew_and_stops(spark):
    big = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w " * 5).alias("text"), F.when(F.col("id") % 3 > 0, "b").when(F.col("id") < 6, "c").when(F.col("id") < 9, None).otherwise("a").alias("source"))
    check(big)


def test_odd_rows(odd, none):
    assert len(check(odd)) == odd.count()
    assert mixing.mix_counts(none).count() == 0


def test_mix_repeats_rows(spark, odd):
    counts = {(r.doc_id, r.source, r["size"]): 0 for r in mixing.mix_counts(odd).collect()}
    for r in mixing.mix_counts(odd).collect():
        counts[r.doc_id, r.source, r["size"]] += r.copies
    out = mixing.mix(odd.withColumn("copy", F.lit("x")))
    got = defaultdict(int)
    for r in out.collect():
        got[r.doc_id, r.source, len((r.text or "").split())] += 1
        assert 1 <= r["copy"] <= 3
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    assert {k: v for k, v in counts.items() if v} == dict(got)


def test_expectation_is_kept(spark):
    """Over many seeds (ids) the mean of copies approaches the share."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 7 as int))").alias("text"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"))
    for r in mixing.mix_counts(df).groupBy("source", "size").agg(F.avg("copies").alias("m"), F.first("target").alias("t"), F.first("source_size").alias("s")).collect():
        assert r.m == pytest.approx(r.t / r.s, abs=0.05)
