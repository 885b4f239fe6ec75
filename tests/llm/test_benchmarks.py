"""Operator 3 against Smith-Waterman over whole texts."""

import random

import numpy as np
import pytest

from ledgerline.llm import benchmarks as B


def plain(a, b):
    """Cell by cell."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_against_plain():
    r = np.random.default_rng(2)
    passages = [r.integers(0, 6, r.integers(1, 60)) for _ in range(80)]
    items = [r.integers(0, 6, r.integers(1, 25)) for _ in range(80)]
    assert B.best_scores(passages, items).tolist() == [plain(p, q) for p, q in zip(passages, items)]


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(8)
    vocabulary = ["the", "of", "and", "to", "a"] + ["".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8))) for _ in range(400)]
    text = lambda n: [r.choice(vocabulary[:5]) if r.random() < 0.4 else r.choice(vocabulary) for _ in range(n)]
    items = [text(r.randint(12, 50)) for _ in range(20)]
    docs, want = [], set()
    for i in range(150):
        w = text(r.randint(5, 200))
        if i % 3 == 0:
            k = r.randrange(len(items))
            copy = [x if r.random() > 0.12 else r.choice(vocabulary) for x in items[k]]
            if r.random() < 0.5:
                del copy[r.randrange(len(copy))]
            at = r.randrange(len(w))
            w[at:at] = copy
            want.add((i, k))
        docs.append((i, " ".join(w).capitalize()))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w) + ".") for i, w in enumerate(items)], "item_id long, text string"), want


@pytest.mark.parametrize("most,together", [(1 << 20, 1 << 18), (1 << 20, 50), (0, 0)])
def test_planted(planted, monkeypatch, most, together):
    monkeypatch.setattr(B, "BROADCAST_BYTES", most)
    monkeypatch.setattr(B, "TOGETHER", together)
    docs, items, want = planted
    got = {(r.doc_id, r.item_id): r.score for r in B.leaks(docs, items).collect()}
    assert want <= set(got)
    texts = {r.item_id: B.words(r.text) for r in items.collect()}
    brute = {(d.doc_id, i): round(plain(B.words(d.text), w) / (2 * len(w)), 6) for d in docs.collect() for i, w in texts.items()}
    assert {k for k, s in brute.items() if s >= B.SCORE} == set(got)
    assert all(s == brute[k] for k, s in got.items())
    assert {r.doc_id for r in B.decontaminate(docs, items).collect()} == {d for d, _ in brute} - {d for d, _ in got}


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_a_phrase_in_all_items_and_documents(spark, monkeypatch, most):
    """Both ways give the same, and each row is judged by its own text."""
    monkeypatch.setattr(B, "BROADCAST_BYTES", most)
    items = [(i, f"what is the name of item number{i} word{i} and thing{i} in place{i}") for i in range(300)]
    docs = [(i, f"x{i} what is the name of item y{i} {'what is the name of ' * 30}") for i in range(20)]
    docs += [(None, items[7][1]), (None, "clean words"), (3, items[9][1] + " more"), (50, items[299][1].upper())]
    d = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, key long")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = {(i, k) for i, t in docs for k, w in items if plain(B.words(t), B.words(w)) >= B.SCORE * 2 * len(B.words(w))}
    assert {(r.doc_id, r.item_id) for r in B.leaks(d, b).collect()} == want and {(None, 7), (3, 9), (50, 299)} <= want
    left = B.decontaminate(d, b)
    assert left.columns == d.columns
    gone = {k for k, (i, t) in enumerate(docs) if any(plain(B.words(t), B.words(w)) >= B.SCORE * 2 * len(B.words(w)) for _, w in items)}
    assert {r.key for r in left.collect()} == set(range(len(docs))) - gone


def test_many_partial_copies(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(9))
    item = [word() for _ in range(30)]
    filler = lambda: [word() for _ in range(20)]
    edited = [w if k % 5 else word() for k, w in enumerate(item)]
    # words put in before the only seed
    spread = [x for w in item[:27] for x in (w, word())][:44] + item[22:]
    docs = [(0, filler() + item + filler())] + [(i, filler() + item[:16] + filler()) for i in range(1, 40)] + [(i, filler() + edited + filler()) for i in range(40, 80)]
    docs += [(80, filler() + spread + filler()), (81, filler() + item[:14] + filler()), (82, filler() + item[4:7] + filler())]
    brute = {i: round(plain(w, item) / 60, 6) for i, w in docs}
    rows = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {x.doc_id: x.score for x in B.leaks(rows, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {i: s for i, s in brute.items() if s >= B.SCORE} and set(range(81)) == set(got)


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river"), (1, "quick brown fox jumps over the lazy dog near the river"), (2, None), (3, "two words"), (None, "Brown fox jumps over the lazy"), (4, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id or -1) for r in B.leaks(odd, items).collect())
    assert got == [(1, -1), (1, 1), (2, -1), (2, 1)]
    left = B.decontaminate(odd, items)
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} == {3, 4, None, 5, 6, 7, 8, 9, 10}
    assert B.leaks(none, items).count() == 0 and B.leaks(odd, items.limit(0)).count() == 0
