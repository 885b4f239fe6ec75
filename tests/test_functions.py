"""Golden values, and properties the functions must have."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import labels as L
from ledgerline.functions import money as M
from ledgerline.functions import text as X
from ledgerline.operators import metrics as O


def values(spark, items, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_osa():
    assert [X.osa(*p) for p in (("tallnik", "tallink"), ("ca", "abc"), ("", "ab"), ("abc", "abc"))] == [1, 3, 2, 0]
    r = random.Random(0)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 6))) for _ in range(2))
        assert X.osa(a, b) == X.osa(b, a) <= max(len(a), len(b))


def test_entities(spark):
    given = ["&amp;lt;b&gt;", "&#381;&#x17d;&nbsp;&NBSP;x", "&quot;&#039;", None, "plain"]
    assert values(spark, given, X.decode_entities) == ["<b>", "ŽŽ  x", "\"'", None, "plain"]


def test_canonical_ids(spark):
    names = {
        "Revenue": "revenue", "Net sales": "revenue", "Müügitulu": "revenue", "Pajamos": "revenue", "Net profit for the period": "net_profit", "Grynasis pelnas": "net_profit", "Neto peļņa": "net_profit", "Operating net profit": None,
        "EBITDA margin": "ebitda", "Earnings per share (EPS)": "eps", "Dividend": "dividends", "Capital expenditures": "capex", "FCF": "free_cash_flow", "Cash flow from operating activities": "operating_cash_flow", "Varad kokku": "total_assets",
        "Total liabilities": "liabilities", "Shareholders' equity": "equity", "Interest income revenue": None, "ņeps": None, "": None, None: None,
    }
    assert values(spark, list(names), L.canonical_id) == list(names.values())


def test_scales(spark):
    units = {"EUR m": 10**6, "€m": 10**6, "mn": 10**6, "m EUR": 1, "EUR mn": 1, "TEUR": 1, "thousand EUR": 1000, "tuhat eurot": 1000, "EUR k": 1000, "bn EUR": 10**9, "EUR": 1, "": 1, None: 1}
    assert values(spark, list(units), M.unit_multiplier) == list(units.values())


def _metrics(spark, rows):
    return spark.createDataFrame(rows, "doc int, ord int, label string, value double, unit string, period string, snippet string")


def test_normalization_cascade(spark):
    rows = [
        (1, 0, "Revenue", 0.39, "EUR m", None, None), (1, 1, "EPS", 0.5, "EUR m", None, None), (1, 2, "Equity", 7685.0, "thousand EUR", None, None),
        (2, 0, "Net profit", -479.0, "EUR", None, None), (2, 1, "Revenue", 5.0, "EUR", None, "in thousands of euros"),
        (3, 0, "Net profit", -479.0, "EUR", None, None), (3, 1, "Revenue", 5.0, "EUR", None, "in thousands of euros"), (3, 2, "Equity", 6.0, "EUR", None, "thousand"),
        (4, 0, "Revenue", 67.977, "EUR", None, None), (4, 1, "Net profit", 11.862, "EUR", None, None), (4, 2, "Total assets", 540.666, "EUR", None, None),
        (5, 0, "Revenue", 76_200_000.0, "EUR", None, None), (5, 1, "Net profit", -897_103.0, "EUR", None, None), (5, 2, "Loss", None, "EUR", None, None),
    ]
    got = {(r.doc, r.ord): r.normalized_value for r in O.canonicalize(_metrics(spark, rows)).collect()}
    want = [390_000, 0.5, 7_685_000, -479, 5000, -479_000, 5000, 6000, 67_977_000, 11_862_000, 540_666_000, 76_200_000, -897_103, None]
    assert [got[r[0], r[1]] for r in rows] == [pytest.approx(w) if w is not None else None for w in want]


def test_dedup(spark):
    labels = ["Revenue", "Revenues", "EBITDA", "EBIT", "Net profit", "Operating cash flow", "operating cash flow"]
    rows = [(1, i, x, 1.0, "EUR", p, None) for i, (x, p) in enumerate(zip(labels, ["", "2024", None, "2024", None, "2024", "2024-12"]))]
    kept = O.dedup(_metrics(spark, rows)).orderBy("ord").collect()
    assert [r.label for r in kept] == ["Revenues", "EBIT", "Net profit", "operating cash flow"]
    again = O.dedup(O.dedup(_metrics(spark, rows))).count()
    assert again == len(kept)


@pytest.mark.parametrize("ocf,capex,fcf,want", [(50.0, 12.0, None, [38.0]), (50.0, -12.0, None, [38.0]), (50.0, 12.0, 0.95, [99.0]), (50.0, 12.0, 0.5, [38.0]), (None, 12.0, None, [])])
def test_free_cash_flow(spark, ocf, capex, fcf, want):
    rows = [(1, 0, "Operating cash flow", ocf, "EUR", "2024", None, None), (1, 1, "CAPEX", capex, "EUR", "2024", None, None)]
    rows += [(1, 2, "Free cash flow", 99.0, "EUR", "2024", None, fcf)] if fcf else []
    df = spark.createDataFrame(rows, "doc int, ord int, label string, value double, unit string, period string, snippet string, confidence double")
    assert [r.value for r in O.derive_fcf(df).where("label = 'Free cash flow'").collect()] == want


def test_compact_euro(spark):
    assert values(spark, [None, 1.26e9, 2e6, -4600.0, 7.0], M.compact_euro, "double") == ["—", "€1.3B", "€2M", "€-5K", "€7"]


def test_results_do_not_depend_on_partitions(spark):
    rows = [(d, i, random.Random(d * 100 + i).choice(["Revenue", "Revenues", "Sales", "EBITDA", "EBIT", "Net profit"]), float(i), "EUR", None, None) for d in range(20) for i in range(12)]
    one = sorted(map(tuple, O.dedup(_metrics(spark, rows).coalesce(1)).collect()), key=repr)
    many = sorted(map(tuple, O.dedup(_metrics(spark, rows).repartition(8)).collect()), key=repr)
    assert one == many


def test_amounts_of_every_size(spark):
    rows = [(0, None, None), (1, 0.0, "EUR"), (2, 7.0, "eur"), (3, -7.25, " € "), (4, 999.5, None), (5, 1500.0, "EUR"), (6, -2_500_000.0, "EUR m"), (7, 1.25e9, "USD"), (8, 1234567.125, "shares"), (9, 100.0, "%"), (10, 0.005, "")]
    df = spark.createDataFrame(rows, "i int, v double, u string").orderBy("i")
    v = F.col("v")
    shown = df.select(M.compact_euro(v), M.axis_number(v), M.metric_text(v, F.col("u")), M.signed_percent(v), M.share_percent(v)).collect()
    assert [r[0] for r in shown] == ["—", "€0", "€7", "€-7.25", "€999.5", "€2K", "€-3M", "€1.3B", "€1M", "€100", "€0.005"]
    assert [r[1] for r in shown][5:8] == ["2K", "-2.5M", "1.3B"] and shown[0][1] is None
    assert [r[2] for r in shown] == ["—", "€0", "€7", "€-7.25", "999.5", "€2K", "€-2.5M", "€1.25B", "1,234,567.13 shares", "100 %", "0.01"]
    assert [r[3] for r in shown][1:5] == ["0.0%", "+7.0%", "-7.3%", "+999.5%"] and [r[4] for r in shown][8:] == ["1234567.1%", "100.0%", "0.01%"]
