"""Operator 11 against scores of every document, and its SQL."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from ledgerline.llm import queries, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return Counter(TERM.findall((text or "").translate(UPPER)))


def brute(docs, items, k=10):
    held = [(d, terms(t)) for d, t in docs]
    held = [(d, t) for d, t in held if t]
    n, total = len(held), sum(t.total() for _, t in held)
    df = Counter(w for _, t in held for w in t)
    out = []
    for item, text in items:
        found = []
        for d, t in held:
            m = 100 - 75 + (75 * t.total() * n) // total
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * t[w]) // (1000 * t[w] + 8 * m)) for w, c in terms(text).items() if w in t)
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if no else d, -s) for r, (s, no, d) in enumerate(sorted(found)[:k])]
    return out


def rows(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


def planted():
    r = random.Random(3)
    word = lambda: r.choice("ae io Ou é ß 7 x9".split()) + r.choice("n t-k l'm R".split())
    docs = [(i, " ".join(word() for _ in range(r.randrange(1, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(None, docs[7][1])] * 2 + [(5, docs[7][1])] * 2 + [(-4, "zz"), (2000, None), (2001, ""), (2002, "-- !"), (2003, "x" * 3_000_000 + " é")]
    items = [(i, " ".join(word() for _ in range(r.randrange(1, 25)))) for i in range(40)] + [(50, docs[7][1]), (51, None), (52, ""), (53, "nowhere"), (54, "zz zz ZZ"), (54, "zz zz ZZ"), (None, "é"), (55, "É")]
    return docs, items


@pytest.mark.parametrize("shard_bytes, block_terms, broadcast_bytes", [(32 << 20, 50_000, 8 << 20), (500, 20, 0), (1 << 12, 50, 8 << 20)])
def test_planted(spark, monkeypatch, shard_bytes, block_terms, broadcast_bytes):
    monkeypatch.setattr(search, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(search, "BLOCK_TERMS", block_terms)
    monkeypatch.setattr(search, "BROADCAST_BYTES", broadcast_bytes)
    docs, items = planted()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    # tasks take their parameters from the module as they find it, so the index is built here
    index = spark.createDataFrame([tuple(x) for x in _indexed(docs, shard_bytes)], search._INDEX) if shard_bytes < 1 << 20 else search.build_index(frame)
    assert rows(search.search(index, asked)) == sorted(brute(docs, items), key=repr)
    assert rows(search.search(index, asked, k=3)) == sorted(brute(docs, items, 3), key=repr)


def _indexed(docs, shard_bytes):
    """The index's rows as a task makes them, in shards of this size."""
    shard, number = search._Shard(), 0
    for doc_id, text in docs:
        shard.add(doc_id, (text or "").encode())
        if shard.size >= shard_bytes:
            for b in shard.rows(number):
                yield from (tuple(r.values()) for r in b.to_pylist())
            shard, number = search._Shard(), number + 1
    for b in shard.rows(number):
        yield from (tuple(r.values()) for r in b.to_pylist())


def test_packed_numbers():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 1 << 35, (1 << 62) + 5])
    data, end = search.pack(values)
    assert search.unpack(data.tobytes()).tolist() == values.tolist()
    assert [len(data[a:b]) for a, b in zip([0, *end], end)] == [1, 1, 1, 2, 2, 2, 3, 6, 9]


def test_merge_keeps_ties_and_prunes_nothing_it_needs():
    r = random.Random(5)
    for _ in range(200):
        n, width = r.randrange(1, 60), r.randrange(1, 9)
        lists = [sorted(r.sample(range(n), r.randrange(1, n + 1))) for _ in range(width)]
        cursors = []
        for docs in lists:
            adds = [r.randrange(1, r.choice((3, 400))) for _ in docs]
            cursors.append(([*docs, n], adds, max(adds), r.randrange(1, 4)))
        ids = sorted(r.sample(range(-50, 500), n - 1)) + [None]
        total = Counter()
        for docs, adds, _, times in cursors:
            for d, a in zip(docs, adds):
                total[d] += a * times
        want = sorted(((-s, ids[d] is None, ids[d] or 0) for d, s in total.items()))[:5]
        best = []
        search.merge(cursors, ids, best, 5)
        assert sorted((-s, d is None, d or 0) for s, _, d in best) == want


def test_documents_by_sql(spark, sf_dir):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = queries.op11_search(spark, sf_dir)
    assert [*got.columns] == ["item_id", "rank", "doc_id", "score"] and dict(got.dtypes)["rank"] == "int"
    assert rows(got) == sorted(c.sql(queries.oracle_sql()["op11_search"]).fetchall(), key=repr)


def test_odd_rows(spark, odd, none):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    items = spark.createDataFrame([(1, "lazy DOG Fuchs", 9), (2, None, 9), (None, "word", 9), (3, "é😀 ñandú", 9)], "item_id long, text string, doc_id long")
    assert rows(search.rank_documents(odd, items)) == sorted(brute(docs, [(r.item_id, r.text) for r in items.collect()]), key=repr)
    assert rows(search.rank_documents(none, items)) == []
    assert rows(search.rank_documents(odd, items.where("false"))) == []
