"""Operator 12 against trees built by hand, and its SQL."""

import random
import zlib
from hashlib import sha256

import duckdb
import pytest

from ledgerline.llm import manifest, queries


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def build(digests, fan):
    """The root, and for each node its siblings (left, right) level by level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        for i, path in zip(at, paths):
            low = i - i % fan
            path.append(("".join(digests[low:i]), "".join(digests[i + 1 : low + fan])))
        digests, at = [h(*digests[i : i + fan]) for i in range(0, len(digests), fan)], [i // fan for i in at]
    return digests[0], paths


def brute(rows, fan=16):
    rows = [(*r, h(*map(field, (r[0], r[3], r[2], r[4], r[1])))) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, r[5])) for s in sources}
    trees = {s: build([r[5] for r in g], fan) for s, g in groups.items()}
    root, upper = build([trees[s][0] for s in sources], fan) if sources else (None, [])
    out = []
    for s, up in zip(sources, upper):
        for (doc_id, text, lang, source, n_chars, leaf), path in zip(groups[s], trees[s][1]):
            lowered = text if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            chosen = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
            node = h(*map(field, (doc_id, source, lang, n_chars, lowered))) if chosen else leaf
            for left, right in path + up:
                node = h(left, node, right)
            out.append((doc_id, leaf, trees[s][0], root, h(*(a + b for a, b in path + up)), node, node == root))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(n, sources, seed):
    r = random.Random(seed)
    text = lambda: r.choice([None, "", "Ab", "word " * r.randrange(20), "ÄB😀"])
    docs = [(r.randrange(-n, n), text(), r.choice(["en", None]), r.choice(sources), r.choice([0, None, 7])) for _ in range(n)]
    return docs + docs[: n // 5] + [(None, "Q", None, sources[0], 1)] * 2


@pytest.mark.parametrize("n, sources", [(700, ["a", "a", "a", "b", None, ""]), (120, [f"s{i}" for i in range(40)]), (1, ["only"]), (14, ["=", "é"])])
def test_trees(spark, n, sources):
    docs = made(n, sources, n)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert rows(queries.op12_manifest_of(frame)) == brute(docs)


def test_narrow_tree_and_its_proofs(spark):
    docs = made(90, ["a", "b"], 1)
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    found = manifest.verified(frame, fan=2).collect()
    assert {r.root for r in found} == {r.folded_root for r in found} and all(r.verified for r in found)
    want = {r[1]: r[3] for r in brute(docs, 2)}
    assert {r.leaf: r.root for r in found} == want and max(len(r.proof) for r in found) >= 7


def test_any_change_shows(spark, documents):
    from pyspark.sql import functions as F

    wrong = manifest.verified(documents.limit(50), manifest.leaf(F.concat("text", F.lit("x"))))
    assert wrong.where("verified").count() == 0 and wrong.count() == 50


def test_documents_by_sql(spark, sf_dir):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf_dir}/documents.parquet')")
    got = rows(queries.op12_manifest(spark, sf_dir))
    assert got == sorted(c.sql(queries.oracle_sql()["op12_manifest"]).fetchall(), key=repr)
    assert any(r[6] for r in got) and not all(r[6] for r in got)


def test_odd_rows(spark, odd, none):
    clash = odd.selectExpr("*", "doc_id as idx", "text as digest", "source as of", "1 as members")
    assert rows(queries.op12_manifest_of(clash)) == brute([tuple(r) for r in odd.collect()])
    assert queries.op12_manifest_of(none).count() == 0
