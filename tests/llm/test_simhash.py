"""Operator 4 against all pairs."""

import re

import numpy as np
import pytest
import xxhash

from ledgerline.llm import simhash
from ledgerline.llm.components import UnionFind


def brute(rows):
    marks = []
    for doc, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        marks.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    sets = UnionFind()
    for i, a in enumerate(marks):
        for j in range(i):
            if (a ^ marks[j]).bit_count() <= 3:
                sets.union(i, j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            low[sets.find(i)] = min(doc, low.get(sets.find(i), doc)) if i in sets.parent else doc
    return sorted(((d if d is not None else -1), m, low.get(sets.find(i)) or 0) for i, ((d, _), m) in enumerate(zip(rows, marks)))


def got(df):
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.fp & (1 << 64) - 1, r.component_id or 0) for r in simhash.near_duplicates(df).collect())


def test_documents(documents):
    assert got(documents) == brute([(r.doc_id, r.text) for r in documents.collect()])


def test_odd_rows(odd, none):
    assert got(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert got(none) == []


def test_anchors_cover(spark):
    r = np.random.default_rng(1)
    x = r.integers(0, 1 << 32, 300)
    rows, anchor, own = simhash.anchors_within_two(x)
    assert len(rows) <= 16 * len(x) and own.sum() == len(x)
    home = dict(zip(rows[own], anchor[own]))
    for bit in range(32):
        rows, anchor, _ = simhash.anchors_within_two(x ^ (1 << bit))
        near = set(zip(rows, anchor))
        assert all((i, home[i]) in near for i in range(len(x)))


@pytest.mark.parametrize("crowded", [20_000, 30])
def test_links_of_planted_fingerprints(spark, monkeypatch, crowded):
    """Chains and dense groups of fingerprints at up to 3 bits; blocks of near ones make large cells."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    r = np.random.default_rng(5)
    base = r.integers(-(1 << 63), 1 << 63, 40)
    marks = set(base.tolist())
    for b in base[:20].tolist():
        for _ in range(60):
            flips = r.choice(64, r.integers(1, 5), replace=False)
            b ^= int(np.bitwise_xor.reduce(np.int64(1) << flips.astype(np.int64)))
            marks.add(b)
    for _ in range(400):
        flips = r.choice(64, 2, replace=False).astype(np.int64)
        marks.add(int(base[30] ^ (np.int64(1) << flips[0]) ^ (np.int64(1) << flips[1])))
    marks = np.array(sorted(marks))
    sets = UnionFind()
    for i, a in enumerate(marks):
        for j in np.flatnonzero(np.bitwise_count((marks[:i] ^ a).view(np.uint64)) <= 3):
            sets.union(i, int(j))
    want = {int(marks[i]): int(marks[sets.find(i)]) for i in sets.parent}
    found = simhash.fingerprint_components(spark.createDataFrame([(int(m),) for m in marks], "fp long"))
    assert {x.fp: x.root for x in found.collect()} == want


def test_keep_one(odd):
    left = simhash.keep_one(odd).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [1, 3, 6, 7, 8, 9, 10]
    assert [r.text for r in left if r.doc_id is None] == ["Der schnelle Fuchs springt."]  # the null text goes with document 3


def test_keep_one_by_row(spark):
    same = "one two three four five six seven eight nine ten"
    rows = [(None, same, 0), (None, same, 1), (7, same, 2), (7, same, 3), (7, "something else that stands under the same number here", 4), (None, "no number and no copy of this text", 5), (9, same, 6)]
    for name in ("key", "row", "n", "fp"):
        left = simhash.keep_one(spark.createDataFrame(rows, f"doc_id long, text string, {name} long"))
        assert left.columns == ["doc_id", "text", name]
        found = sorted(r[name] for r in left.collect())
        assert found in ([2, 4, 5], [3, 4, 5])


def test_long_text_in_blocks(monkeypatch):
    text = (b"Alpha beta  gamma\n" * 500) + b"end"
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 37)
    assert simhash.fingerprint(text) == whole
