"""Operator 9's n_repeated_words against every run of 51 words."""

import random
from collections import defaultdict

import pytest

from ledgerline.llm import passages, repeats
from ledgerline.llm.queries import op9_repeats_of


def brute(rows):
    """rows: (doc_id, text); equal rows are one document."""
    words = [(t or "").encode().split() for _, t in rows]
    holders = defaultdict(set)
    for r, w in zip(rows, words):
        for p in range(len(w) - 50):
            holders[tuple(w[p : p + 51])].add(r)
    return [len({q for p in range(len(w) - 50) if len(holders[tuple(w[p : p + 51])]) > 1 for q in range(p, p + 51)}) for w in words]


def planted():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcé") for _ in range(r.randrange(1, 5)))
    some = lambda n: [word() for _ in range(n)]
    passage, long = some(60), some(500)
    texts = [some(40) + passage + some(n) for n in range(0, 90, 3)]
    texts += [some(30) + passage[a : a + n] + some(30) for a in (0, 5, 9) for n in (50, 51)]
    texts += [long, long, long[:250] + ["x"] + long[250:], long[100:151], long[100:150], long[7:57] + long[57:58], ["to"] * 300, ["by"] * 200, ["by"] * 51 + ["to"] * 50, some(80) * 2]
    texts = [" ".join(t) for t in texts] + ["\n\t ".join(passage), "\x0b".join(passage[:51]), "\xa0".join(passage), None, "", " \n"]
    return list(enumerate(texts)) + [(1000, " ".join(some(70)))] * 2 + [(None, " ".join(passage))] * 2


@pytest.mark.parametrize("lookups,cut,piece", [(1 << 20, 1 << 17, 1 << 20), (0, 120, 50)])
def test_every_run_of_51_words(spark, monkeypatch, lookups, cut, piece):
    monkeypatch.setattr(passages, "BROADCAST_ROWS", lookups)
    monkeypatch.setattr(passages, "SLICE", cut)
    monkeypatch.setattr(passages, "PIECE", piece)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = sorted((r.doc_id or -1, r.n_repeated_words) for r in repeats.without_repeats(docs).collect())
    assert found == sorted((d or -1, n) for (d, _), n in zip(rows, brute(rows)))


def test_short_passages_are_marked_and_stay(spark):
    r = random.Random(4)
    some = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    passage = some(60)
    docs = spark.createDataFrame([(k, f"{some(90)} {passage} {some(90)}") for k in range(5)] + [(9, some(240))], "doc_id long, text string")
    found = op9_repeats_of(docs).orderBy("doc_id").collect()
    assert [r.n_repeated_words for r in found] == [60] * 5 + [0]
    assert all(r.n_removed == 0 for r in found)


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    found = sorted((r.doc_id or -1, r.n_repeated_words) for r in repeats.without_repeats(odd).collect())
    assert found == sorted((d or -1, n) for (d, _), n in zip(rows, brute(rows)))
    assert repeats.without_repeats(none).count() == 0
