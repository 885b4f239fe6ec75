"""Steps that larger tables need: short expressions for made rows, and keys that most rows share."""

from __future__ import annotations

import pytest

from ledgerline.functions.text import MARKED, PLAIN
from ledgerline.operators import completion
from ledgerline.operators import metrics as O
from ledgerline.operators import records as R
from ledgerline.operators import tables as T
from ledgerline.plans import inputs, snapshots


@pytest.mark.parametrize("module", [inputs, snapshots])
def test_dealt_values_are_the_same_when_looked_up(spark, module):
    values = ["a", "it's", None, "x|y" if module is inputs else "xy", "d"]
    sql = module.dealt(values, "id * 3 + CASE WHEN id % 2 = 0 THEN 1 ELSE 0 END")
    short = inputs.spark_sql(f"upper({sql})")
    assert "CASE (" not in short and "split_part" not in short
    rows = spark.range(40).selectExpr(f"upper({sql}) AS a", f"{short} AS b").collect()
    assert [r.a for r in rows] == [r.b for r in rows] and {r.a for r in rows} >= {"A", None}


def test_made_rows_have_no_long_branches(spark, sf_dir):
    plan = inputs.METRICS.df(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("WHEN") < 20


def test_null_safe_pairs_cut_heavy_keys(spark, monkeypatch):
    monkeypatch.setattr(T, "PART", 10)
    key = lambda i: (None if i % 4 else i % 3, 2000 + i % 2)
    old = spark.createDataFrame([(f"o{i}", *key(i)) for i in range(200)], "id string, company_id int, year int")
    new = spark.createDataFrame([(f"n{i}", *key(i)) for i in range(0, 200, 3)], "id string, company_id int, year int")
    got = T.null_safe_pairs(old, new, ["company_id", "year"])
    want = {(f"o{i}", f"n{j}") for i in range(200) for j in range(0, 200, 3) if key(i) == key(j)}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    assert "part_" in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_filings_series_are_scaled_where_its_rows_meet_once(spark):
    t = spark.createDataFrame([(1, 0, "2023", 5.0, 7.0, None, 0.0), (1, 1, None, 200_000.0, None, None, 3.0), (2, 0, "x", 1.5, None, None, None), (3, 0, "x", 9.0, 2e6, -4.0, None)], "doc int, idx int, period string, revenue double, ebitda double, net_profit double, fcf double")
    goals = spark.createDataFrame([(1, "revenue", 2e8), (1, "revenue", 0.0), (1, "revenue", None), (1, "ebitda", 7.0), (1, "ebitda", 6_900_000.0), (2, "fcf", 1.0)], "doc int, series string, target double")
    stated = spark.createDataFrame([(3, 1000), (2, None)], "doc int, multiplier int")
    got = R.scaled_series(t, goals, stated)
    values = {(r.doc, r.idx, r.series): r.value for r in got.collect()}
    # revenue in thousands holds small values, which are millions; ebitda is as it stands; the larger of both for the others
    assert [values[1, i, c] for c in R.SERIES for i in (0, 1)] == [5e6, 2e8, 7.0, None, None, None, 0.0, 3000.0]
    assert values[2, 0, "revenue"] == 1.5 and [values[3, 0, c] for c in R.SERIES] == [9000.0, 2e6, -4000.0, None] and len(values) == 16
    assert {tuple(r) for r in R.series_multiplier(t, goals).collect()} == {(1, "revenue", 1000), (1, "ebitda", 1)}
    plan = R.scaled_series(t, goals, stated)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc" in plan and plan.count("hashpartitioning(") <= 3 and "series" not in "".join(x for x in plan.split("\n") if "hashpartitioning" in x)


def test_labels_are_compared_once_for_all_filings(spark, monkeypatch):
    labels = ["Revenue", "Revenues", None, " Revenue", "EBIT", "EBITDA", "", "  ", "Net profit of the year", "Of the net profit year", "müügitulu", "Muugitulu", "Sales"]
    rows = [(d, i, labels[(d * 7 + i * i * (d % 3 + 1)) % len(labels)], "x" * (i * d % 4) if (i + d) % 5 else None, float(i)) for d in range(60) for i in range(d % 9)]
    df = spark.createDataFrame(rows, "doc int, ord int, label string, period string, value double")
    plan = O.dedup(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan.lower()
    got = sorted(map(tuple, O.dedup(df).collect()), key=repr)
    monkeypatch.setattr(O, "LABELS", 3)
    each = O.dedup(df)
    assert "levenshtein" in each._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(map(tuple, each.collect()), key=repr) == got and 0 < len(got) < len(rows)
    assert sum(r[2] is None for r in got) == sum(r[2] is None for r in rows)
    nulls = df.where("label is null")
    assert O.dedup(nulls).count() == nulls.count() > 0 and O.dedup(df.where("false")).count() == 0


def _near(a: str | None, b: str | None) -> bool:
    """The rule of near labels, by tables of edits and sets of words."""
    if a is None or b is None:
        return False
    a, b = (" ".join(x.split()).translate(str.maketrans(MARKED, PLAIN)) for x in (a, b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
    p, q = set(a.lower().split(" ")), set(b.lower().split(" "))
    return row[-1] <= 3 or len(p & q) / len(p | q) >= 0.85


def test_near_pairs_compare_a_label_once(spark, monkeypatch):
    # chains (EPS, EBIT, EBITDA), words in another order, one of seven words missing, marks, blanks
    words = "one two three fourth fifths sixth seventh"
    labels = ["Revenue", "Revenues", None, " Revenue", "EPS", "EBIT", "EBITDA", "", "  ", "Net profit of the year", "of the net profit Year", "müügitulu", "Muugitulu", "Sales", words, words[4:], words[8:]]
    rows = [(d if d % 10 else None, i if i % 11 else None, labels[(d * 7 + i * i * (d % 3 + 1)) % len(labels)]) for d in range(50) for i in range(1, d % 17)]
    rows += [(7, 3, "EBIT"), (7, 3, "EBIT"), (70, -1, "Revenue"), (70, 10**6, "Revenue")]
    df = spark.createDataFrame(rows, "doc int, ord int, label string")
    known = [r for r in rows if r[0] is not None and r[1] is not None]
    want = sorted((a[0], a[1], b[1]) for a in known for b in known if a[0] == b[0] and a[1] < b[1] and _near(a[2], b[2]))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    got = O.near_pairs(df)
    assert sorted(map(tuple, got.collect())) == want and {(70, -1, 10**6), (7, 3, 3)} & set(want) == {(70, -1, 10**6)}
    # no pair of rows compares texts, and rows of one filing meet by cluster
    assert "levenshtein" not in plan(got).lower() and "SortMergeJoin [doc" in plan(got) and "cluster" in plan(got) and "Broadcast" not in plan(got)
    assert O.near_pairs(df.where("false")).count() == O.near_pairs(df.where("label is null")).count() == 0
    for name, value in (("LABELS", 3), ("_slots", lambda places: None)):
        with monkeypatch.context() as m:
            m.setattr(O, name, value)
            each = O.near_pairs(df)
            assert "levenshtein" in plan(each).lower() and sorted(map(tuple, each.collect())) == want


def test_slots_hold_every_place():
    places = [((i + 1) * 0x9E3779B97F4A7C15 % 2**64 - 2**63, i // 2) for i in range(400)]
    slots = O._slots(places)
    assert all(slots[h % len(slots)] == at for h, at in places)
    assert O._slots([]) == [None] and O._slots([(5, 0), (5, 1)]) is None
    near = [[0, 1], [0, 1, 2], [1, 2], [3], [4, 5], [4, 5]]
    assert O._clusters(near) == [0, 0, 0, 3, 4, 4]


def test_jobs_of_one_company_compare_a_name_once(spark, monkeypatch):
    seen = []
    reach = completion.reach
    monkeypatch.setattr(completion, "reach", lambda pairs, threshold: seen.append(pairs.count()) or reach(pairs, threshold))
    companies = spark.createDataFrame([(1, "AS Tallink Grupp", "TAL1T", 1), (2, "Olainfarm", None, 2), (3, "Olainfram", None, 3)], "id long, name string, ticker string, ord long")
    jobs = [(i, 1 if i % 2 else 2, "Tallink Grupp") for i in range(40)] + [(40, 2, "Olainfram"), (41, 9, "Olainfarm"), (42, None, "Olainfarm"), (43, None, "x"), (44, 1, ""), (45, None, "")]
    got = {r.id: (r.mapping, r.found) for r in completion.with_company(spark.createDataFrame(jobs, "id long, company_id long, said string"), companies).collect()}
    assert seen == [3]
    assert [got[i] for i in (0, 1, 38, 39)] == [("conflict", None), ("verified", 1)] * 2 and len(got) == len(jobs)
    assert [got[i] for i in range(40, 46)] == [("verified", 2), ("not_found", None), ("matched", 2), ("unmatched", None), ("conflict", None), ("unmatched", None)]


def test_fields_of_snapshots_are_those_of_whole_ones(spark, sf_dir):
    some = snapshots.snapshots(spark, sf_dir, ("company_name", "trends"))
    whole = snapshots.snapshots(spark, sf_dir)
    assert some.schema["snapshot"].dataType.names == ["company_name", "trends"]
    told = lambda df: sorted((tuple(r) for r in df.selectExpr("id", "h", "snapshot is null", "snapshot.company_name", "to_json(snapshot.trends)").collect()), key=repr)
    assert told(some) == told(whole)
