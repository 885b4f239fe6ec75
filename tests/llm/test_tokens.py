import numpy as np

from ledgerline.llm import tokens


def brute(text):
    """Tokens one by one, by bytes shared with each line."""
    with open(tokens.VOCABULARY, "rb") as f:
        encoder, sizes = tokens._encoder(f.read())
    data = text.encode()
    lines, at = [], 0
    for part in text.split("\n"):
        n = len(part.encode()) + 1
        lines.append((at, min(at + n, len(data))))
        at += n
    count, cross, at = [0] * len(lines), [0] * len(lines), 0
    for token in encoder.encode_ordinary(text):
        a, b = at, at + int(sizes[token])
        share = [max(0, min(b, e) - max(a, s)) for s, e in lines]
        count[share.index(max(share))] += 1
        held = [i for i, x in enumerate(share) if x]
        if len(held) > 1:
            cross[held[0]] += 1
        at = b
    assert at == len(data)
    edges = [len(data[:s].decode()) for s, _ in lines] + [len(text)]
    return [(i, edges[i], edges[i + 1], count[i], cross[i]) for i in range(len(lines))]


def got(df):
    out = {}
    for r in tokens.section_tokens(df).collect():
        out.setdefault(r.doc_id, []).append((r.section, r.start, r.end, r.n_tokens, r.n_crossing))
    return {k: sorted(v) for k, v in out.items()}


def test_against_plain(spark, documents):
    texts = ["", "a", "one\ntwo\n", "x\n\n\n  y\n\n \n", "é😀\n日本語 text\r\n\tend", "word " * 3000 + "\n" + "z" * 5000]
    assert got(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")) == {i: brute(t) for i, t in enumerate(texts)}
    assert got(documents) == {r.doc_id: brute(r.text) for r in documents.collect()}


def test_long_white_space(spark):
    with open(tokens.VOCABULARY, "rb") as f:
        encoder, sizes = tokens._encoder(f.read())
    for n in (999, 1000, 1001, 30_000):
        for run in (" " * n, "\n" * n, ("\u3000\t \x85" * n)[:n], " " * (n - 1) + "\n", "\x1c" * n):
            for text in (run, "a" + run, run + "b", f"a{run}b", f"a{run}7 {run}!{run}", f".{run}'s"):
                assert tokens.encode(encoder, text) == encoder.encode_ordinary(text), (n, text[:9])
    texts = [c * 5_000_000 for c in (" ", "\n", "z", "!", "7")] + ["a" + " " * 3_000_000 + "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    totals = {r.doc_id: r for r in tokens.document_tokens(df).collect()}
    assert len(totals) == 6 and totals[1].n_sections == 5_000_001
    for i, text in enumerate(texts):
        assert totals[i].n_tokens == len(tokens.encode(encoder, text))
        assert sizes[tokens.encode(encoder, text)].sum() == len(text)


def test_odd_rows(odd, none):
    rows = got(odd)
    assert rows[3] == [(0, 0, 0, 0, 0)] and len(rows[2]) == 2 and len(rows[None]) == 2
    assert tokens.section_tokens(none).count() == 0
    totals = {r.doc_id: r.n_tokens for r in tokens.document_tokens(odd).collect()}
    assert totals[7] == sum(x[3] for x in rows[7])


def test_rule():
    n, cross = tokens.attribute(np.array([3, 5, 9]), np.array([0, 4]), 9)
    assert n.tolist() == [2, 1] and cross.tolist() == [1, 0]  # the second token has a byte of each: the first gets it
