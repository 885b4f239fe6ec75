"""Operator 13: exact sizes, every row once, and the laws of its draws."""

import zlib
from collections import Counter
from itertools import permutations
from math import comb, sqrt

import numpy as np
import pytest

from ledgerline.llm import queries, shards


def check(got, docs, n):
    assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in docs)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) <= set(range(n)) and max(sizes.values(), default=0) - min((sizes.get(j, 0) for j in range(n)), default=0) <= 1
    for j, size in sizes.items():
        assert sorted(r.slot for r in got if r.shard == j) == list(range(size))


@pytest.mark.parametrize("bits", [20, 4])
def test_rows_fall_into_place(spark, monkeypatch, bits):
    monkeypatch.setattr(shards, "PART_BITS", bits)
    docs = [(i % 900, None if i % 7 == 0 else "same" if i % 3 else f"t{i}", "s" if i % 3 else None) for i in range(1000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, shard string").repartition(7)
    got = shards.place(frame, 24).collect()
    check(got, docs, 24)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, shards.place(frame, 24).collect()), key=repr)
    by = sorted(got, key=lambda r: (r.shard, r.slot))
    assert np.corrcoef([r.doc_id for r in by], range(1000))[0, 1] < 0.12


def test_matrix_has_its_margins():
    counts = [5, 0, 17, 1, 400, 3, 3]
    matrix = shards.Matrix(counts, 9, 4)
    rows = [matrix.row(p) for p in range(len(counts))]
    assert [int(own.sum()) for _, own in rows] == counts
    assert tuple(sum(own for _, own in rows).tolist()) == shards.shard_sizes(sum(counts), 9)
    assert all((before == sum((o for _, o in rows[:p]), np.zeros(9, int))).all() for p, (before, _) in enumerate(rows))
    assert all((a == b).all() for p in range(7) for a, b in zip(rows[p], shards.Matrix(counts, 9, 4).row(p)))


def test_every_arrangement_is_as_likely():
    """Three parts of 2, 1 and 1 rows into two shards: all 4!/(2!2!) deals come equally often."""
    counts, trials, seen = [2, 1, 1], 6000, Counter()
    for seed in range(trials):
        matrix, deal = shards.Matrix(counts, 2, seed), []
        for p, n in enumerate(counts):
            before, own = matrix.row(p)
            order, _ = shards.shuffled(seed, p, n)
            shard, nth = shards.dealt(before, own, order, np.arange(n))
            assert (nth >= before[shard]).all() and (nth < (before + own)[shard]).all()
            deal += shard.tolist()
        seen[tuple(deal)] += 1
    want = set(permutations([0, 0, 1, 1]))
    assert set(seen) == want
    assert all(abs(n - trials / 6) < 5 * sqrt(trials / 6) for n in seen.values())


def test_large_draws_follow_the_law(monkeypatch):
    monkeypatch.setattr(shards, "_NUMPY_MOST", 0)
    good, bad, draws, trials = 30, 50, 22, 20_000
    random = np.random.default_rng(1)
    seen = Counter(shards.hypergeometric(random, good, bad, draws) for _ in range(trials))
    for k in range(draws + 1):
        p = comb(good, k) * comb(bad, draws - k) / comb(good + bad, draws)
        assert abs(seen[k] - trials * p) < 5 * sqrt(trials * p) + 2
    assert [shards.hypergeometric(random, *x) for x in ((0, 5, 3), (5, 0, 3), (5, 5, 10), (5, 5, 0), (1, 0, 1))] == [0, 3, 5, 0, 1]
    huge = [shards.hypergeometric(random, 4 * 10**11, 6 * 10**11, 10**9) for _ in range(40)]
    assert abs(np.mean(huge) - 4 * 10**8) < 5 * 15_500 / sqrt(40) and len(set(huge)) > 35


def test_digest(spark, odd, none):
    got = queries.op13_shards_of(odd).collect()
    texts = {(r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in odd.collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == texts and len(got) == odd.count()
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)} and all(r.slot == 0 for r in got)
    assert queries.op13_shards_of(none).count() == 0
    assert dict(queries.op13_shards_of(none).dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}


def test_written_shards(spark, documents, tmp_path):
    shards.write_shards(documents, f"{tmp_path}/out", 5)
    got = spark.read.parquet(f"{tmp_path}/out")
    check(got.collect(), [(r.doc_id, r.text) for r in documents.collect()], 5)
    assert set(documents.columns) | {"shard", "slot"} == set(got.columns)
