"""Operator 9 against every 400-byte string."""

import random
from collections import defaultdict

import pytest

from ledgerline.llm import repeats, windows


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(list)
    for i, t in enumerate(data):
        for p in range(len(t) - 399):
            seen[t[p : p + 400]].append((i, p))
    out = [bytearray(len(t)) for t in data]
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                out[i][p : p + 400] = b"\1" * 400
    return [(bytes(b for b, c in zip(t, m) if not c), sum(m), sum(c and not (k and m[k - 1]) for k, c in enumerate(m))) for t, m in zip(data, out)]


def planted():
    r = random.Random(1)
    base = ["".join(r.choice("abcdé ") for _ in range(900)) for _ in range(4)]
    texts = [base[0], base[0], base[1][:500] + "X" + base[1][501:], base[1], "a" * 3000, "a" * 401, "ab" * 700, None, "", base[2][:399], base[2][:400], base[2][1:402]]
    texts += [base[3][100:600] + base[3][100:600], "q" + base[3][:300] + base[2][:350] + base[0][5:410]]
    for _ in range(60):
        n = 50 + r.randrange(380, 460)
        texts.append("".join(r.choice("xyz") for _ in range(r.randrange(200))) + base[3][50:n] + "".join(r.choice("uvw") for _ in range(r.randrange(200))))
    return texts


@pytest.mark.parametrize("group_rows,lookups", [(2000, 1 << 20), (10, 0)])
def test_planted(spark, monkeypatch, group_rows, lookups):
    monkeypatch.setattr(repeats, "GROUP_ROWS", group_rows)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", lookups)
    texts = planted()
    found = repeats.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()
    want = brute(texts)
    assert len(found) == len(texts)
    for r in found:
        assert (bytes(r.kept), r.n_removed, r.n_spans) == want[r.doc_id], r.doc_id


def test_slices_find_the_same_windows(monkeypatch):
    text = "".join(random.Random(2).choice("abc") for _ in range(5000)).encode()
    monkeypatch.setattr(windows, "SLICE", 1500)
    windows._powers.cache_clear()
    i, _, _, at, first, last = windows.anchors([memoryview(x) for x in (text, b"", text[:400])])
    covered = sorted(p for k, a, b in zip(i, first, last) if k == 0 for p in range(a, b + 1))
    assert covered == list(range(4601)) and (i == 2).sum() == 1
    assert ((first <= at) & (at <= first + 336)).all()
    windows._powers.cache_clear()


def test_documents(documents):
    rows = documents.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows])))
    for r in repeats.without_repeats(documents).collect():
        assert (bytes(r.kept), r.n_removed, r.n_spans) == want[r.doc_id]


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted((d or -1, len((t or "").encode()), w[1]) for (d, t), w in zip(rows, brute([t for _, t in rows])))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in repeats.without_repeats(odd).collect()) == want
    assert repeats.without_repeats(none).count() == 0
