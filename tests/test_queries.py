"""Every query with SQL against DuckDB on the same tables."""

from __future__ import annotations

import datetime
import decimal

import duckdb
import pytest

from ledgerline.plans import inputs
from ledgerline.plans.catalogue import QUERIES, SQL
from tests import literal_rows

TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.sql("SET TimeZone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    yield c
    c.close()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


def test_plans_push_filters_down(spark, sf_dir):
    plan = QUERIES["B1_point_lookup"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(o_orderkey), EqualTo(o_orderkey,7)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan


def test_near_pairs_pass_no_table_through_the_driver(spark, sf_dir):
    plan = QUERIES["C12_near_pairs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


LITERAL = {
    "METRICS": "E18_missing_core F9_first_per_label G54_drop_empty G30_label_kinds G37_G38_label_tests G32_G35_canonicalize E23_derive_fcf C12_dedup F13_key_metrics F12_G39_preview",
    "TRENDS": "E14_merge_periods E12_chunk_trends F8_forward_fill F7_implausible F10_repeated_periods",
    "BREAKDOWN": "E11_merge_breakdown E12_chunk_breakdown G53_chartable",
    "NARRATIVES": "E13_merge_narratives G7_sections",
}


@pytest.mark.parametrize("source, name", [(s, n) for s, names in LITERAL.items() for n in names.split()])
def test_same_rows_on_literal_rows(spark, duck, sf_dir, monkeypatch, source, name):
    made, rows = getattr(inputs, source), getattr(literal_rows, {"METRICS": "METRIC_ROWS", "TRENDS": "TREND_ROWS", "BREAKDOWN": "BREAKDOWN_ROWS", "NARRATIVES": "NARRATIVE_ROWS"}[source])
    assert made.sql in SQL[name]
    monkeypatch.setattr(inputs.Made, "df", lambda self, spark, sf: rows.df(spark))
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(SQL[name].replace(made.sql, rows.sql))
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
