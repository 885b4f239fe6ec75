"""A training corpus from ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs.  An empty table passes all
stages empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import benchmarks, language, lines, mixing, simhash
from ledgerline.llm.common import DOCUMENT_COLUMNS, clean_up, made, materialize, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language operator 2 rejects go, so null, empty and letterless texts; repeated rows go or stay together."""
    return language.keep_known(docs).select(*DOCUMENT_COLUMNS)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first by doc_id stays, null before all (operator 5); every document stays, also one left without lines."""
    return lines.dedup_lines(docs).select(*DOCUMENT_COLUMNS)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicate documents the smallest doc_id stays, null only if it has no other; of equal rows one (operator 4)."""
    return simhash.keep_one(docs).select(*DOCUMENT_COLUMNS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with copies of test items go, each by its own text (operator 3); null and empty texts stay."""
    return benchmarks.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*DOCUMENT_COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times a row, numbered by ``copy`` (operator 1); a null source is a source."""
    return mixing.mix(docs.select(*DOCUMENT_COLUMNS))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("known_language", known_language),
    ("distinct_lines", distinct_lines),
    ("distinct_documents", distinct_documents),
    ("without_benchmark", without_benchmark),
    ("mixed", mixed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before = len(made(spark))
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        clean_up(spark, before, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Hash-driven rounding, MinHash and alignment are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None
