"""The stages against the operators' brute-force versions, each on its own input."""

import os

import corpus_pipeline as P
from ledgerline.llm import benchmarks as B
from ledgerline.llm import common
from ledgerline.llm import simhash as S
from tests.llm import test_lines, test_simhash


def test_stages(spark, documents, sf_dir):
    docs = documents
    before = {}
    for name, stage in P.STAGES:
        before[name] = docs
        docs = P.materialize(stage(spark, docs, sf_dir), name)
        if name != "mixed":
            assert docs.columns == list(P.DOCUMENT_COLUMNS)
        before[name] = (before[name], docs)
    kept = lambda name: {r.doc_id: r.text for r in before[name][1].collect()}
    given = lambda name: [(r.doc_id, r.text) for r in before[name][0].collect()]
    assert len(kept("known_language")) >= 0.97 * len(given("known_language"))
    want = test_lines.brute(given("distinct_lines"))
    assert sum(want[d] != t for d, t in kept("distinct_lines").items()) <= 1
    low = {c for _, _, c in test_simhash.brute(given("distinct_documents"))}
    assert set(kept("distinct_documents")) == low
    items = [B.words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {d: " ".join(B.words(t)) for d, t in given("without_benchmark")}
    leaked = {d for d, t in texts.items() if any(" ".join(w) in t for w in items)}
    assert not leaked & set(kept("without_benchmark"))
    sizes = {d: len((t or "").split()) for d, t in given("mixed")}
    copies = {}
    for r in before["mixed"][1].collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies) <= set(sizes) and max(copies.values()) <= 3


def test_empty(spark, documents, sf_dir):
    docs = documents.limit(0)
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0


def test_run_leaves_one_table_a_stage(spark, sf_dir):
    common.clean_up(spark)
    before = len(common.made(spark))
    out = P.run(spark, sf_dir)
    left = [p.rsplit("/", 1)[-1] for p in common.made(spark)[before:]]
    assert [x.rsplit("-", 1)[0] for x in left if x.startswith("stage-")] == [f"stage-{n}" for n, _ in P.STAGES[:-1]]
    assert all(x.startswith(("stage-", "mix-")) for x in left)
    n = out.count()
    assert n and P.run(spark, sf_dir).count() == n
    paths = [p.removeprefix("file:") for p in common.made(spark)]
    assert paths and all(map(os.path.exists, paths))
    common.clean_up(spark)
    assert not common.made(spark) and not any(map(os.path.exists, paths))


def test_odd_rows(spark, odd, sf_dir):
    """Nulls, ties and repeated rows in every stage; the counts that the stages' docstrings state."""
    docs = odd
    seen = {}
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, sf_dir), name)
        seen[name] = docs.collect()
    assert {r.doc_id for r in seen["known_language"]} & {1, 2, 7} == {1, 2, 7} and not {r.doc_id for r in seen["known_language"]} & {3, 4, 5}
    texts = [r.text for r in seen["distinct_lines"] if r.text and r.text.strip()]
    assert len(set(texts)) == len(texts)
    marks = [x.fp for x in S.near_duplicates(P.materialize(spark.createDataFrame(seen["distinct_documents"], odd.schema), "x")).collect()]
    assert len(set(marks)) == len(marks) == len(seen["distinct_documents"])
    assert {r.doc_id for r in seen["mixed"]} <= {r.doc_id for r in seen["without_benchmark"]}
