"""Snapshots, names and completion on odd rows, against plain Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.text import osa
from ledgerline.operators import completion as D
from ledgerline.operators import matching as M
from ledgerline.operators import snapshots as S

COMPANIES = "id int, name string, ticker string, ord int"


def tokens(name):
    raw = re.sub(r"""[.,;:()'"„“”’/\\&]""", " ", re.sub(r"(?i)\ba\s*/\s*s\b", " ", name).lower()).split()
    return [t for t in raw if t not in M.LEGAL_FORMS], raw


def likeness(name, own, ticker):
    (x, raw), (y, _) = tokens(name), tokens(own)
    if not x or not y:
        return 0.0
    a, b = " ".join(x), " ".join(y)
    return max(1 - osa(a, b) / max(len(a), len(b)), len({*x} & {*y}) / len({*x} | {*y}), 1.0 if ticker and ticker.lower() in raw else 0.0)


@pytest.fixture(scope="module")
def names():
    r = random.Random(6)
    stems = ["tallink", "telia", "harju", "latvijas", "aa", "ab ab", "ignitis", "aaaaaaaaaaaa", "grupp", "elekter", "x", "gaze", "merko"]
    make = lambda: " ".join(r.choice(stems) for _ in range(r.randint(1, 3)))
    own = [(i, make() + r.choice(["", " AS", ", AB", " A/S"]), r.choice([None, "", f"T{i}L"]), 100 - i) for i in range(40)] + [(40, "AS", "ONLY", 1), (41, "", None, 2)]

    def edited(s):
        s = list(s)
        for _ in range(r.randint(0, 4)):
            k = r.randrange(len(s))
            kind = r.random()
            if kind < 0.3 and k + 1 < len(s):
                s[k], s[k + 1] = s[k + 1], s[k]
            elif kind < 0.6 and len(s) > 1:
                del s[k]
            elif kind < 0.8:
                s.insert(k, r.choice("abekz "))
            else:
                s[k] = r.choice("abekz")
        return "".join(s)

    said = sorted({edited(r.choice(own[:40])[1]) for _ in range(250)} | {"T3L results", "nothing like it at all", "UAB", " ", "qqq", "zzzz ONLY"})
    return own, said


def want(own, said, least):
    out = {}
    for name in said:
        scored = [(-likeness(name, n, t), o, i) for i, n, t, o in own]
        best = min(scored)
        if -best[0] >= least and best[0] < 0:
            out[name] = (best[2], round(-best[0], 9))
    return out


@pytest.mark.parametrize("blocks", [(1000, 20_000), (40, 7)])
def test_best_companies_are_the_best_of_all(spark, monkeypatch, names, blocks):
    monkeypatch.setattr(M, "NAME_BLOCK", blocks[0])
    monkeypatch.setattr(M, "COMPANY_BLOCK", blocks[1])
    own, said = names
    companies = spark.createDataFrame(own, COMPANIES)
    asked = spark.createDataFrame([(s, s) for s in said], "doc string, name string").repartition(3)
    got = {r.name: (r.company_id, round(r.confidence, 9)) for r in M.best_companies(asked, companies).collect()}
    assert got == want(own, said, 0.0)
    assert M.best_companies(asked.where("false"), companies).count() == 0 and M.best_companies(asked, companies.where("false")).count() == 0


@pytest.mark.parametrize("threshold", [0.8, 0.85, 0.95])
def test_rare_keys_miss_no_pair(spark, names, threshold):
    own, said = names
    got = {r.name: (r.company_id, round(r.confidence, 9)) for r in M.match_companies(spark.createDataFrame([(s, s) for s in said], "doc string, name string"), spark.createDataFrame(own, COMPANIES), threshold, audit=True).collect()}
    assert got == want(own, said, threshold) and len(got) > 20
    with pytest.raises(ValueError):
        M.match_companies(spark.createDataFrame([("a", "a")], "doc string, name string"), spark.createDataFrame(own, COMPANIES), 0.5)


def test_equal_names_are_compared_once(spark, monkeypatch):
    written, materialize = [], M.materialize

    def counted(df, label, *more):
        out = materialize(df, label, *more)
        written.append(out.count())
        return out

    monkeypatch.setattr(M, "materialize", counted)
    own = [(k, ("AS Tallink Grupp", "Tallink Grupp, AB")[k % 2], f"T{k}L", k) for k in range(300)]
    said = [("Tlalink Grupp", "Tallink Gruppp")[k % 2] + (" AS", " ", ", AB")[k % 3] + " " * k for k in range(200)] + ["Tlalink Grupp T7L"]
    got = M.match_companies(spark.createDataFrame([(s, s) for s in said], "doc string, name string"), spark.createDataFrame(own, COMPANIES)).collect()
    assert {r.doc: r.company_id for r in got} == {s: 7 if "T7L" in s else 0 for s in said} and max(written) <= 300


def test_many_distances_at_once():
    import numpy as np

    r = random.Random(2)
    for _ in range(30):
        a, others = "".join(r.choices("abc", k=r.randint(1, 9))), ["".join(r.choices("abc", k=r.randint(0, 9))) for _ in range(20)]
        codes = np.zeros((9, 20), np.int32)
        for k, t in enumerate(others):
            codes[: len(t), k] = [ord(x) for x in t]
        assert M.osa_many(a, codes, np.array([len(t) for t in others])).tolist() == [osa(a, t) for t in others]


# --- snapshots --------------------------------------------------------------------------------------------------------


def test_json_of_every_kind(spark):
    full = {"metadata": {"companyName": "A", "reportPeriod": "2024", "outputLanguage": "en"}, "metrics": [{"label": "Revenue", "value": "1,200", "unit": "EUR", "evidence": {"snippet": "s", "confidence": "0.5"}}, {"label": None, "value": "45%"}, {"value": 3}, 7, None], "narratives": [{"section": "outlook", "text": "t"}],
            "sentiment": {"managementTone": "good", "riskFactors": ["a", 1, None]}, "revenueBreakdown": {"bySegment": [{"name": "x", "value": "5"}]}, "profitabilityTrends": {"periods": ["2023", None], "revenue": [1, None, "2"], "netProfit": "none"}}
    rows = [(1, json.dumps(full)), (2, "{bad"), (3, None), (4, "[]"), (5, '"text"'), (6, '{"progress": 1}'), (7, '{"metrics": null}'), (8, ""), (9, "null"), (10, '{"metadata": {}}'), (11, '{"metadata": 5, "metrics": {"a": 1}, "narratives": "x"}')]
    df = spark.createDataFrame(rows, "id int, raw string")
    got = {r.id: r.s for r in df.select("id", S.parse_snapshot(F.col("raw")).alias("s")).collect()}
    assert [i for i, s in got.items() if s is not None] == [1, 10, 11]
    s = got[1]
    assert (s.company_name, s.language, s.tone, s.risks, s.guidance) == ("A", "en", "good", ["a", None, None], None)
    assert [(m.label, m.value, m.unit, m.confidence) for m in s.metrics] == [("Revenue", 1200.0, "EUR", 0.5), (None, None, None, None), (None, 3.0, None, None), (None, None, None, None), (None, None, None, None)]
    assert [tuple(p) for p in s.breakdown.segments] == [("x", 5.0)] and s.breakdown.geographies is None
    assert (s.trends.periods, s.trends.revenue, s.trends.net_profit) == (["2023", None], [1.0, None, 2.0], None)
    assert got[11].metrics is None and got[11].narratives is None and got[11].company_name is None
    assert {r.id: r.reason for r in S.rejected_snapshots(df, "raw").collect()} == {2: "not_json", 4: "not_an_object", 5: "not_an_object", 6: "no_snapshot", 7: "no_snapshot", 8: "not_json", 9: "not_an_object"}


def odd_snapshots():
    series = lambda **k: {"periods": None, "revenue": None, "ebitda": None, "net_profit": None, "fcf": None, **k}
    nothing = dict.fromkeys(("company_name", "report_period", "language", "metrics", "narratives", "tone", "outlook", "risks", "guidance", "breakdown", "trends"))
    metric = lambda label, value, unit=None: (label, value, unit, None, None, None)
    return [
        (1, None), (2, nothing),
        (3, nothing | {"metrics": [metric(" Revenue", 1.0), metric("revenue", 2.0), metric(None, None), metric("", 3.0), metric("EPS", None, "EUR"), metric("x", None, "")], "narratives": [("Highlights", " a "), ("executiveSummary", "b"), (None, "c"), ("", "d"), ("Odd one", " "), ("outlook", None)], "trends": series(periods=["2022", " ", "2022 ", "2023"], revenue=[None, 1.0, 9.0, 8.0], ebitda=[None, None], fcf=[float("nan")])}),
        (4, nothing | {"breakdown": ([("A", 1.0), (" a ", 2.0), ("B", float("inf")), (None, 1.0)], None), "trends": series(periods=["2022", "2023"], net_profit=[1.0, 7.0], revenue=[0.0, 5.0])}),
        (5, nothing | {"breakdown": ([("A", 1.0), ("b", 2.0), ("A!", 4.0)], [("x", 1.0)]), "trends": series(periods=[None, "2023"], revenue=[1.0, 2.0]), "risks": ["r", None, " "], "tone": ""}),
    ]


@pytest.fixture(scope="module")
def odd_filings(spark):
    return spark.createDataFrame(odd_snapshots(), f"id int, snapshot {S.SNAPSHOT}")


def test_repair_of_odd_parts(odd_filings):
    got = {r.id: r.r for r in odd_filings.select("id", S.repair(F.col("snapshot")).alias("r")).collect()}
    assert got[1] is None
    w = got[2].warnings
    assert (w.missing_summary, w.breakdown_dropped, w.trends_dropped, w.chart_warnings, w.dropped_metrics) == (True, False, False, [], 0) and got[2].snapshot.metrics == [] == got[2].snapshot.narratives
    s, w = got[3].snapshot, got[3].warnings
    assert [(m.label, m.value) for m in s.metrics] == [(" Revenue", 1.0), ("EPS", None)] and (w.duplicate_labels, w.dropped_metrics) == (["revenue", ""], 2)
    assert [tuple(x) for x in s.narratives] == [("executive_summary", "a\n\nb"), ("other", "c\n\nd")] and (w.renamed_sections, w.missing_summary) == (["Highlights"], False)
    # the blank period is left out before series are laid along the others
    assert (s.trends.periods, s.trends.revenue, s.trends.ebitda) == (["2022", "2023"], [1.0, 9.0], None)
    assert (w.series_refitted, w.merged_periods, w.empty_series) == (3, 1, ["ebitda"])
    assert got[4].snapshot.breakdown is None and got[4].warnings.breakdown_dropped and got[4].warnings.merged_parts == 1 and got[4].warnings.implausible_changes == 1
    assert [tuple(p) for p in got[5].snapshot.breakdown.segments] == [("A", 5.0), ("b", 2.0)] and got[5].snapshot.trends is None
    assert got[5].warnings.chart_warnings == ["part merged: A!", "series refitted", "trends dropped: periods"]


def test_repairing_twice_changes_nothing(spark, sf_dir, odd_filings):
    from ledgerline.plans.snapshots import snapshots

    both = odd_filings.select(F.col("id").cast("string").alias("id"), "snapshot").unionByName(snapshots(spark, sf_dir).select("id", "snapshot"))
    once = both.select("id", S.repair(F.col("snapshot"))["snapshot"].alias("snapshot")).where("snapshot is not null")
    twice = once.select("id", "snapshot", S.repair(F.col("snapshot")).alias("r")).collect()
    assert len(twice) > 300
    for r in twice:
        assert repr(r.r.snapshot) == repr(r.snapshot), r.id
        w = r.r.warnings
        assert not w.chart_warnings and not w.duplicate_labels and not w.renamed_sections and not w.dropped_metrics and not w.breakdown_dropped and not w.trends_dropped


def test_texts_go_back_where_they_came_from(spark, sf_dir, odd_filings):
    from ledgerline.plans.snapshots import snapshots

    for filings in (odd_filings, snapshots(spark, sf_dir).select("id", "snapshot")):
        texts = S.collect_texts(filings)
        before = {r.id: repr(r.snapshot) for r in filings.collect()}
        assert {r.id: repr(r.snapshot) for r in S.apply_texts(filings, texts).collect()} == before
        assert {r.id: repr(r.snapshot) for r in S.apply_texts(filings, texts.where("false")).collect()} == before
    one = spark.createDataFrame([(3, "narrative:1:text", "NEW"), (3, "metric:99:label", "no"), (3, "metric:0:label", None), (77, "sentiment:tone", "no")], "doc int, path string, text string")
    got = {r.id: r.snapshot for r in S.apply_texts(odd_filings, one, F.lit("lv")).collect()}
    assert [x.text for x in got[3].narratives] == [" a ", "NEW", "c", "d", " ", None] and got[3].metrics[0].label == " Revenue" and got[3].language == "lv" and got[5].language is None
    paths = {(r.doc, r.path) for r in S.collect_texts(odd_filings).collect()}
    assert paths == {(3, f"metric:{i}:label") for i in (0, 1, 4, 5)} | {(3, f"narrative:{i}:text") for i in range(4)} | {(5, "sentiment:risk:0")}


def test_cache_of_labels(spark, odd_filings):
    cache = spark.createDataFrame([("revenue", "müügitulu", None), ("EPS", "", None), ("a", "x", None)], "source_text string, et string, lv string")
    texts = S.collect_texts(odd_filings)
    hits, missing = S.cached_texts(texts, cache, "et")
    assert [(r.doc, r.path, r.text) for r in hits.collect()] == [(3, "metric:1:label", "müügitulu")] and missing.count() == texts.count() - 1


def test_briefs_keep_their_order(spark):
    told = [("executive_summary", "One.\nTwo.\n\n one. \nThree."), ("management_commentary", "Two.\nFour.\nFive.\nSix."), ("strategic_priorities", "a\nb\nc\nd"), ("executive_summary", "later")]
    metrics = [(f"Revenue {i}", float(i), "EUR", None, None, None) for i in range(10)] + [(None, 1.0, None, None, None, None)]
    row = dict.fromkeys(("company_name", "report_period", "language", "guidance", "breakdown", "trends")) | {"metrics": [("Staff", 1.0, None, None, None, None), *metrics], "narratives": told, "tone": None, "outlook": "", "risks": ["r1", "r2", "r3", "r4", "r5"]}
    b = spark.createDataFrame([(1, row)], f"id int, snapshot {S.SNAPSHOT}").select(S.brief(F.col("snapshot")).alias("b")).first().b
    assert [m.label for m in b.metrics] == [f"Revenue {i}" for i in range(8)]
    assert (b.summary, b.priorities, b.risks, b.more_risks, b.tone, b.outlook) == (["One.", "Two.", "Three.", "Four."], ["a", "b", "c"], ["r1", "r2", "r3"], 2, "Not assessed", None)


# --- completion -------------------------------------------------------------------------------------------------------


def filing(name, period, revenue=100.0, profit=10.0):
    nothing = dict.fromkeys(("language", "narratives", "tone", "outlook", "risks", "guidance", "breakdown", "trends"))
    metric = lambda label, value: (label, value, "EUR", None, None, None)
    return nothing | {"company_name": name, "report_period": period, "metrics": [metric("Revenue", revenue), metric("Net profit", profit)]}


def test_every_way_a_job_can_end(spark):
    own = spark.createDataFrame([(1, "AS Tallink Grupp", "TAL1T", 1), (2, "Harju Elekter Group AS", None, 2)], COMPANIES)
    jobs = [
        ("a", None, "en", filing("Tallnik Grupp", "2024")), ("b", 1, "en", filing("Tallink Grupp AS", "FY 2023")), ("c", 1, "en", filing("Harju Elekter Group", "2022")), ("d", 9, "en", filing("Tallink Grupp", "2022")), ("e", None, "en", filing("Nobody", "2021")),
        ("f", None, "en", filing(" ", "2024")), ("g", None, "en", filing("Tallink Grupp", None)), ("h", None, "en", None), ("i", 2, "en", filing("TAL1T", "someday")), ("j", 1, "en", filing("Tallink Grupp", "2020", 100.0, 900.0)), ("k", 1, "en", filing("Tallink Grupp", "2019", 100_000.0)),
        ("l", 1, "en", filing("Tallink Grupp", "2024")), ("m", 1, "lv", filing("Tallink Grupp", "2024")), ("n", 1, "en", filing("Tallink Grupp", "2018")), ("o", None, "en", filing("Nobody", "2021")), ("p", 2, "en", filing("Harju Elekter Group", "H1 2024", 200.0)),
    ]
    reports = [("r1", 1, 2018, "annual", "en", None, filing("x", "2018")), ("r2", 1, 2017, "annual", "en", "n", filing("x", "2017", 1.0)), ("r3", 2, 2024, "annual", "en", None, filing("x", "2024", 120.0)), ("r4", None, 2021, "annual", "en", None, None)]
    schema = f"id string, company_id int, language string, snapshot {S.SNAPSHOT}"
    j = spark.createDataFrame(jobs, schema).withColumn("ord", F.lit(0))
    r = spark.createDataFrame(reports, f"id string, company_id int, fiscal_year int, report_type string, language string, job_id string, snapshot {S.SNAPSHOT}")
    found = D.decide(j, own, r, 2025)
    got = {x.id: (x.outcome, x.company_id, x.mapping, x.warnings, x.duplicate_of) for x in found.collect()}
    assert got == {
        "a": ("created", 1, "matched", [], None), "b": ("created", 1, "verified", [], None), "c": ("created", None, "conflict", [], None), "d": ("created", None, "not_found", [], None), "e": ("created", None, "unmatched", [], None),
        "f": ("no_metadata", None, None, [], None), "g": ("no_metadata", None, None, [], None), "h": ("no_metadata", None, None, [], None), "i": ("no_period", None, "conflict", [], None), "j": ("failed", 1, "verified", ["net_profit_exceeds_revenue"], None),
        "k": ("failed", 1, "verified", ["history_extreme_change"], None), "l": ("duplicate", 1, "verified", [], "a"), "m": ("created", 1, "verified", [], None), "n": ("duplicate", 1, "verified", [], "r1"), "o": ("created", None, "unmatched", [], None), "p": ("failed", 2, "verified", ["semi_annual_exceeds_annual"], None),
    }
    after, all_reports = D.apply_decisions(j.withColumn("state", F.lit("complete")).withColumn("error", F.lit(None).cast("string")), r, found)
    states = {x.id: (x.state, x.error) for x in after.collect()}
    assert states["l"] == ("duplicate", "duplicate of a") and states["j"] == ("failed", "quality: net_profit_exceeds_revenue") and states["c"] == ("complete", "company conflict") and states["h"] == ("complete", None)
    assert all_reports.count() == 4 + sum(v[0] == "created" for v in got.values())
