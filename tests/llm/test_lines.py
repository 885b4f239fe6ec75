"""Operator 5 against all pairs of lines."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import lines
from ledgerline.llm.components import UnionFind


def like(a, b, similarity=lines.SIMILARITY):
    x, y = ({t[i : i + lines.SHINGLE] for i in range(len(t) - lines.SHINGLE + 1)} for t in (a, b))
    near = sorted((len(a) - lines.SHINGLE + 1, len(b) - lines.SHINGLE + 1))
    return a == b or (near[0] > 0 and near[0] >= similarity * near[1] and len(x & y) >= similarity * len(x | y))


def brute(rows, similarity=lines.SIMILARITY):
    placed = [(d if d is not None else -1, no, x) for d, t in rows for no, x in enumerate((t or "").split("\n")) if x.strip(" \t\n\v\f\r")]
    distinct = sorted({x for _, _, x in placed}, key=len)
    sets = UnionFind()
    for i in range(len(distinct)):
        for j in range(i - 1, -1, -1):
            if len(distinct[j]) < 0.7 * len(distinct[i]) - lines.SHINGLE:
                break
            if like(distinct[i], distinct[j]):
                sets.union(i, j)
    root = {x: sets.find(i) for i, x in enumerate(distinct)}
    first = {}
    for place in sorted(placed):
        first.setdefault(root[place[2]], place)
    gone = {(d, no) for d, no, x in placed if first[root[x]] != (d, no, x)}
    return {d if d is not None else -1: None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (d if d is not None else -1, no) not in gone) for d, t in rows}


def test_planted(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))
    base = [[word() for _ in range(25)] for _ in range(30)]
    docs = []
    for i in range(120):
        own = []
        for _ in range(r.randint(1, 4)):
            w = list(r.choice(base))
            if r.random() < 0.6:
                w[r.randrange(len(w))] = word()
            own.append(" ".join(w))
        docs.append((i, "\n".join([*own, "short"])))
    got = {x.doc_id: x.text for x in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    want = brute(docs)
    assert sum(got[d] != want[d] for d in got) <= 1  # the bands find 99.5 % of the pairs at the threshold, more above
    assert sum(t.count("short") for t in got.values()) == 1


def _close_pair(r, n, letters="abcdefghijklmnopqrstuvwxyz    "):
    """Two lines of about n characters, a little above the threshold."""
    while True:
        a = "".join(r.choice(letters) for _ in range(n)).strip()
        b = a
        while like(a, b):
            last, k = b, r.randrange(len(b))
            b = b[:k] + r.choice(letters) + b[k + 1 :]
        if last != a:
            return a, last


def test_recall_of_close_pairs_at_all_lengths():
    r = random.Random(2)
    for n in (50, 60, 80, 100, 104, 108, 130, 200, 1000, 5000):
        pairs = [_close_pair(r, n) for _ in range(200 if n < 1000 else 40)]
        found = 0
        for a, b in pairs:
            number, keys = lines.bands([a, b])
            found += bool(set(keys[number == 0]) & set(keys[number == 1]))
        assert found >= 0.95 * len(pairs), n


def test_one_changed_character(spark):
    """An inner letter changed: similar from 59 characters on."""
    text = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for n, same in ((20, False), (58, False), (59, True), (62, True)):
        assert like(text[:n], text[:20] + "!" + text[21:n]) == (same or n < 21)
    docs = [(i, f"Notice of the year {1990 + i}: all offices of the town stay closed today.") for i in range(9)] + [(20 + i, f"Page {i}") for i in range(3)] + [(30 + i, "Page 1") for i in range(2)]
    got = {x.doc_id: x.text for x in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sorted(d for d in got if got[d]) == [0, 20, 21, 22]


def test_long_line_in_slices(monkeypatch):
    text = "".join(chr(97 + i * i % 26) + str(i) for i in range(3000))
    want = lines.bands([text, "b" * 300, text[:2000]])
    monkeypatch.setattr(lines, "SLICE", 1000)
    got = lines.bands([text, "b" * 300, text[:2000]])
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all()


@pytest.mark.parametrize("cell_rows", [2, 7, 25])
def test_large_cells_are_compared_in_blocks(spark, monkeypatch, cell_rows):
    monkeypatch.setattr(lines, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    text = "the same long line of a passage that many documents share with a number at its end "
    docs = [(i, f"{text}{i}") for i in range(60)]
    got = lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got if r.text) == [0]


def test_crowded_cells_leave_no_pair_out(spark):
    """Lines in one cell that are alike in some parts only; links against all pairs."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(60)]
    base = [" ".join(r.sample(words, 14)) for _ in range(5)]
    texts = sorted({" ".join(r.choice(words) if r.random() < p else w for w in b.split()) for b in base for p in (0.05, 0.1, 0.2) for _ in range(12)})
    by_id = {i: t for i, t in enumerate(texts)}
    table = spark.createDataFrame(list(by_id.items()), "id long, line string")

    def compared(rows, *keys):
        group = rows.select(F.xxhash64(*keys).alias("cell"), "id").join(table, "id").select("cell", "id", "line")
        return group.repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(lines._verify(lines.SIMILARITY), "a long, b long")

    old, lines.CELL_ROWS = lines.CELL_ROWS, 20
    try:
        cells = table.select(F.lit(7).cast("long").alias("cell"), "id", F.lit(len(texts)).cast("long").alias("n"))
        links = lines._crowded(cells, compared).collect()
    finally:
        lines.CELL_ROWS = old
    sets, want = UnionFind(), UnionFind()
    for row in links:
        sets.union(row.a, row.b)
    for i in by_id:
        for j in range(i):
            if like(by_id[i], by_id[j]):
                want.union(i, j)
    assert [sets.find(i) for i in by_id] == [want.find(i) for i in by_id]
    assert 5 <= len({want.find(i) for i in by_id}) < len(texts) - 20


def test_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute(rows)
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.dedup_lines(documents).collect()}
    assert sum(got[d][0] != want[d] for d in want) <= 1
    assert all(n == len(t) for t, n in got.values())


def test_odd_rows(spark, odd, none):
    got = sorted(((r.doc_id or -1), r.text or "") for r in lines.dedup_lines(odd).collect())
    assert len(got) == odd.count()
    texts = dict(got)
    assert texts[10] == "line one is long enough to count\n\nshort" and texts[5] == " \t\n "
    assert texts[2] == "" and texts[1].startswith("The quick")
    assert lines.dedup_lines(none).count() == 0
    for name in ("id", "key", "gone", "row", "key_", "gone_", "at", "a.b"):
        clash = spark.createDataFrame([(1, "x" * 30, 5), (2, "x" * 30, 6)], "doc_id long, text string, k long").withColumnRenamed("k", name)
        out = lines.dedup_lines(clash)
        assert out.columns == ["doc_id", "text", name] and sorted((r[name], r.text) for r in out.collect()) == [(5, "x" * 30), (6, "")]


def test_shingles_are_exact():
    wide, all_ = "".join(chr(0x4E00 + i) for i in range(300)), "".join(chr(0x4E00 + i) for i in range(6000))
    for group in (["abcdefgh", "abcabcabcabcabcabcabc", "älter als zwölf Jahre"], ["price 5 € – ok 😀" * 3, "price 6 € – ok 😀" * 3], [wide, wide[1:] + wide[:9], "abcdefgh" * 4], [all_, all_[5:] + all_[:9], "abcdefgh" * 4]):
        sets = [{x[i : i + 6] for i in range(len(x) - 5)} for x in group]
        found = lines.shingles(group)
        assert [len(x) for x in found] == [len(x) for x in sets]
        for a, x in zip(found, sets):
            for b, y in zip(found, sets):
                assert lines._common(a, b) == len(x & y)
