"""Facts of values that come again: the same whichever way they are worked out, and not once a row."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import dictionary, metrics
from ledgerline.operators.dictionary import per_value

ROWS = [("Revenue", None), ("Revenue", "x"), (None, None), ("", "y"), ("Net profit", ""), ("Z" * 400, None)]


def _facts():
    return {"low": F.lower("label"), "both": F.concat_ws("-", "label", "unit"), "none": F.col("unit").isNull()}


@pytest.mark.parametrize("values, longest", [(10_000, 500), (2, 500), (10_000, 300), (10_000, 3)])
def test_same_facts_on_every_way(spark, monkeypatch, values, longest):
    monkeypatch.setattr(dictionary, "VALUES", values)
    monkeypatch.setattr(dictionary, "LONGEST", longest)
    df = spark.createDataFrame([(i % 7, *ROWS[i % len(ROWS)]) for i in range(60)], "n int, label string, unit string")
    got = per_value(df, ["label", "unit"], _facts())
    assert got.columns == ["n", "label", "unit", *_facts()]
    key = lambda r: repr(tuple(r))
    assert sorted(got.collect(), key=key) == sorted(df.withColumns(_facts()).collect(), key=key)


def _joined_before_rules(df) -> bool:
    """Every step with a pattern stands over the listed values, none over the table."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    leaf = lambda i: next(x for x in lines[i:] if "LogicalRDD" in x or "Relation " in x)
    rules = [i for i, line in enumerate(lines) if "RLIKE" in line]
    return bool(rules) and all("LogicalRDD" in leaf(i) for i in rules)


def test_patterns_are_tried_once_a_label(spark, sf_dir):
    from ledgerline.plans.catalogue import QUERIES

    for name in ("G32_G35_canonicalize", "F12_G39_preview", "E6_modal_multiplier", "G34_filing_scale", "F13_key_metrics", "E23_derive_fcf"):
        assert _joined_before_rules(QUERIES[name](spark, sf_dir)), name


def test_free_cash_flow_keeps_other_metrics(spark):
    rows = [(1, 0, "Operating cash flow", 9.0), (1, 1, "Capex", -4.0), (1, 2, "FCF", 1.0), (1, 3, "Revenue", 7.0), (2, 0, "FCF", 3.0), (2, 1, None, 2.0)]
    m = spark.createDataFrame(rows, "doc int, ord int, label string, value double").withColumn("unit", F.lit("EUR")).withColumn("period", F.lit("2024"))
    out = metrics.derive_fcf(m)
    assert sorted((r.doc, r.ord, r.value) for r in out.collect()) == [(1, 0, 9.0), (1, 1, -4.0), (1, 3, 7.0), (1, 1_000_000, 5.0), (2, 0, 3.0), (2, 1, 2.0)]
