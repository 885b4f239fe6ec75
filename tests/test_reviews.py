"""Reviews, history and limits on odd rows, against plain Python."""

import datetime as dt
import random
import re
import statistics
import time

from pyspark.sql import functions as F

from ledgerline.functions import text as X
from ledgerline.operators import checks as K
from ledgerline.operators import matching as M
from ledgerline.operators import reviews as R
from ledgerline.operators import tables as T
from ledgerline.streaming.limits import _step, after_block, limited, summary


def test_limits_of_random_events(spark):
    r, t0 = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(r.choice([None, 1, 2]), i, t0 + dt.timedelta(seconds=r.randrange(3000)), r.choice(["failure"] * 5 + ["reset", "other", None])) for i in range(600)]
    want = []
    for key in (None, 1, 2):
        opened, n = None, 0
        for k, i, ts, kind in sorted((x for x in rows if x[0] == key), key=lambda x: (x[2], x[1])):
            at = ts.timestamp()
            opened, n = _step(opened, n, at, kind, 60)
            shown = 0 if opened is None or at - opened > 60 else n
            want.append((k, i, shown, shown > 5))
    got = limited(spark.createDataFrame(rows, "key int, seq long, ts timestamp, kind string").repartition(5))
    assert sorted(((x.key or 0), x.seq, x.failures, x.limited) for x in got.collect()) == sorted(((k or 0), *x) for k, *x in want)


def test_limits_of_a_busy_key(spark):
    """Nearly all events are of one key and close together; ranges cut it, and the plain fold agrees."""
    r, t0 = random.Random(8), dt.datetime(2024, 1, 1)
    for kinds, gap in ((["failure"] * 30 + ["other"], 9), (["failure"] * 200 + ["reset"], 30), (["failure", "other"], 61)):
        at, rows = 0, []
        for i in range(1500):
            at += r.choice([0, 1, gap])
            rows.append((1 if i % 10 else r.randrange(2, 5), i, t0 + dt.timedelta(seconds=at), r.choice(kinds)))
        want = []
        for key in (1, 2, 3, 4):
            opened, n = None, 0
            for k, i, ts, kind in [x for x in rows if x[0] == key]:
                opened, n = _step(opened, n, ts.timestamp(), kind, 60)
                want.append((k, i, 0 if opened is None or ts.timestamp() - opened > 60 else n))
        got = limited(spark.createDataFrame(rows, "key int, seq long, ts timestamp, kind string").repartition(5)).collect()
        assert sorted((x.key, x.seq, x.failures) for x in got) == sorted(want)


def test_blocks_are_put_together():
    r = random.Random(9)
    for _ in range(3000):
        at, rows = 0, []
        for _ in range(r.randrange(12)):
            at += r.randrange(8)
            rows.append((at, r.choice(["failure"] * 6 + ["other", r.choice(["other", "reset"])])))
        opened, n = r.choice([(None, 0), (-r.randrange(1, 15), r.randrange(1, 5))])
        want = (opened, n)
        for at, kind in rows:
            want = _step(*want, at, kind, 10)
        assert after_block(opened, n, *summary([x for x in rows if x[1] != "other"], 10), 10) == want


def test_history_without_the_own_row(spark):
    r = random.Random(4)
    rows = [(f"d{i}", r.choice([1, 1, 1, 2, 3, 4]), r.choice([2020, 2021]), r.choice(["annual", "q1"]), r.choice([None, 0.0, -3.0, 5.0, 5.0, float(r.randrange(1, 90))])) for i in range(60)] + [("alone", 9, 2020, "annual", 1.0)]
    df = spark.createDataFrame(rows, "doc string, company_id int, fiscal_year int, report_type string, revenue double")
    for x in K._without_own(df, df).collect():
        _, company, year, _, _ = next(o for o in rows if o[0] == x.doc)
        others = [o for o in rows if o[1] == company and o[0] != x.doc]
        sizes = [abs(o[4]) for o in others if o[4]]
        annual = [abs(o[4]) for o in others if o[2] == year and o[3] == "annual" and o[4] is not None]
        assert x.usual == (statistics.median(sizes) if sizes else None), x
        assert x.annual == (max(annual) if annual else None), x


def test_boilerplate_of_long_lines(spark):
    """The same verdicts as with a pattern that backtracks, and linear time."""
    slow = re.compile(r"^\s*\d+[\.\)]?\s+.+?[\.\s]{3,}\s*\d+\s*$")
    r = random.Random(5)
    lines = ["".join(r.choice("1 .)a\t") for _ in range(r.randint(1, 14))).strip() for _ in range(3000)]
    fast = f"(?i){X.BOILERPLATE[1]}"
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", F.col("line").rlike(fast).alias("hit")).collect()
    assert all(x.hit == bool(slow.search(x.line)) for x in got)
    long = ["1 a" + " " * 100_000 + "x", "1" + " " * 3_000 + "x", "1 a" + "." * 100_000 + "x", "1 a" + " . 1" * 30_000 + "x", "7 a" + "." * 100_000 + "9"]
    began = time.perf_counter()
    found = [x.hit for x in spark.createDataFrame([(x,) for x in long], "line string").select(X.is_boilerplate(F.col("line")).alias("hit")).collect()]
    assert found == [False] * 4 + [True] and time.perf_counter() - began < 20


def test_mismatches(spark):
    reports = spark.createDataFrame([(1, 10, "Harju Elekter"), (2, 10, "Tallink Grupp"), (3, 10, "Nobody at all"), (4, 77, "LHV"), (5, None, "LHV"), (6, 10, " "), (7, 10, None), (8, 11, "Tallnik Grupp AS")], "id int, company_id int, extracted string")
    companies = spark.createDataFrame([(10, "Harju Elekter Group AS", "HAE1T", 1), (11, "AS Tallink Grupp", None, 2), (12, "Harju Elekter", None, 3)], "id int, name string, ticker string, ord int")
    got = sorted(map(tuple, M.mismatches(reports, companies).collect()))
    # without its last word a name is unlike the listed one, but the company of just that name is known
    assert got == [(1, "unlike_catalogue", 12), (2, "unlike_catalogue", 11), (3, "unlike_catalogue", None), (4, "not_in_catalogue", None)]


def test_audit_of_odd_snapshots(spark):
    nothing = dict.fromkeys(("company_name", "report_period", "language", "metrics", "narratives", "tone", "outlook", "risks", "guidance", "breakdown", "trends"))
    metrics = lambda *xs: [(label, value, None, None, None, None) for label, value in xs]
    series = lambda periods, revenue: (periods, revenue, None, None, None)
    named = nothing | {"company_name": "x", "report_period": "2024"}
    core = metrics(("Revenue", 1.0), ("EBITDA", 1.0), ("Net profit", 1.0), ("Free cash flow", 1.0))
    rows = [
        (1, None, None),
        (2, None, nothing),
        (3, None, named | {"metrics": core, "trends": series(["2023", "2024"], [None, 2.0]), "breakdown": ([("A", 1.0), ("B", 2.0)], None), "narratives": [("Executive Summary", "t")]}),
        (4, None, named | {"metrics": metrics(("Revenue", None), (None, 1.0)), "trends": series(["2024", " 2024"], [float("nan")]), "breakdown": ([("A", 1.0), ("a", None)], [("x  y", 1.0), ("X y ", 1.0)]), "narratives": [("", "t"), ("letter", "t"), (None, None)]}),
        (5, None, named | {"metrics": core, "trends": series([], []), "narratives": []}),
    ]
    found = {x.id: (x.codes, x.severity) for x in R.audit(spark.createDataFrame(rows, f"id int, company_id int, snapshot {R.SNAPSHOT}"), spark.createDataFrame([], "id int, name string, ticker string, ord int")).collect()}
    assert found[1] == (["missing_snapshot"], 3)
    assert found[2] == (["missing_company_metadata", "missing_report_period_metadata", "zero_metrics"], 3)
    assert found[4] == (["mostly_null_metrics", "missing_core_metrics", "duplicate_trend_periods", "trend_series_length_mismatch", "all_null_trends", "duplicate_revenue_breakdown_entries", "non_canonical_narrative_sections", "missing_executive_summary"], 2)
    assert set(found) == {1, 2, 4}


def test_running_numbers(spark):
    rows = [(g, n) for g in (None, "a", "b") for n in (None, "", "same prefix of sixteen 2", "same prefix of sixteen 1", "z", "z")]
    got = T.numbered(spark.createDataFrame(rows, "g string, n string").repartition(4), "g", "n").orderBy("place").collect()
    order = lambda x: (x.g is not None, x.g or "", x.n is not None, x.n or "")
    assert [x.place for x in got] == list(range(1, 19)) and [order(x) for x in got] == sorted(order(x) for x in got)
