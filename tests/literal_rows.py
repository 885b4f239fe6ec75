"""Small rows with the cases that matter, for the queries that are made from orders."""

from __future__ import annotations

from ledgerline.plans.inputs import Rows

METRIC_ROWS = Rows(
    "doc int, ord int, label string, value double, unit string, period string, snippet string, rationale string, confidence double",
    (
        (1, 0, "Revenue", 0.39, "EUR m", "2024", "Revenue was EUR 0.39 m", None, 0.9),
        (1, 1, "Net profit", 7685.0, "thousand EUR", "2024", "", None, 0.5),
        (1, 2, "EPS", 0.12, "EUR m", "2024", "eps", None, None),
        (1, 3, "Total  Revenue", 0.4, "EUR m", "2024-12", "again", None, 0.8),
        (1, 4, "Free cash flow", 12.0, "EUR", None, None, None, 0.5),
        (1, 5, "Operating cash flow", 50.0, "EUR", "2024", "ocf", None, 0.9),
        (1, 6, "CAPEX", -12.0, "eur ", "2024", "capex", None, 0.9),
        (1, 7, "Free Cash Flow", 20.0, "EUR", "2024", "fcf", None, 0.4),
        (2, 0, "Revenue", 67.977, "EUR", "2023", "rev", None, 0.9),
        (2, 1, "Net profit", 11.862, "EUR", "2024", "np", None, None),
        (2, 2, "Total assets", 540.666, "", "2024", "ta", None, 0.9),
        (2, 3, "Equity", 158.826, None, "2024", "eq", None, 0.9),
        (2, 4, "Liabilities", 381.84, "EUR", "2024", "li", None, 0.9),
        (3, 0, "Müügitulu", 125000.0, "tuhat EUR", "2024", "müügitulu", None, 0.9),
        (3, 1, "Puhaskasum", 6200.0, "EUR", "2024", "summad on in thousands of euros", None, 0.9),
        (3, 2, "Varad kokku", 210000.0, "EUR", "2024", "tuhat eurot", None, 0.9),
        (3, 3, "Kohustused", 88000.0, "EUR", "2024", None, None, 0.9),
        (3, 4, "Employees", 210.0, "", None, None, None, None),
        (4, 0, "Revenue target", 99.0, "EUR", "2025", None, None, None),
        (4, 1, "EBITDA margin", 12.5, "%", "2024", "margin", None, 0.9),
        (4, 2, "Ieņēmumi", None, "EUR", "2024", None, None, None),
        (4, 3, "Neto peļņa", None, None, None, None, None, None),
        (4, 4, "Operating profit", 5664.0, "EUR", "2024", "op", None, 0.7),
        (4, 5, "Dividends per share", 0.2, "EUR", "2024", None, None, None),
        (5, 0, "EPS", 1.0, "EUR", None, None, None, None),
        (5, 1, "FCF", 2.0, "EUR", None, None, None, None),
        (5, 2, "EBIT", 3.0, "EUR", None, None, None, None),
        (5, 3, "EBITDA", 4.0, "EUR", "2024", None, None, None),
        (5, 4, "Grynasis pelnas", 5.0, "mln. EUR", "2024", "pelnas", "mln", 0.9),
        (5, 5, "Pajamos", 6.0, "€m", "2024", "1 bn", None, 0.9),
        (5, 6, "Net\nprofit", 7.0, "EUR", "2024", None, None, None),
    ),
)
PERIOD_ROWS = Rows("s string", tuple((x,) for x in ("Q1 2024", "q3 2023", "Q2", "FY2024", "FY 2023", "2024 annual report", "2023 Report", "H1 2024", "H2 2024", "9M 2024", "6M 2023", "3m 2022", "12M 2024", "2024-12-31", "2024-03-31", "2024-06-30", "2024-09-30", "2024-05-01", "2024", " 2023 ", "", "no year", "2023-2024 Q1", "2023-09", "2024 Q1", "2024 9 months", "1H 2022", "half-year 2021", "second half 2020", "nine months 2024", "Q4/2024", "2024Q2")))
TREND_ROWS = Rows(
    "doc int, chunk int, idx int, period string, revenue double, ebitda double, net_profit double, fcf double",
    (
        (1, 0, 0, "2022", 919.6, None, 10.0, None), (1, 0, 1, "2023", 850.0, None, None, None), (1, 0, 2, "2023", 851.0, 5.0, 12.0, None), (1, 1, 3, " 2024 ", 900.0, 6.0, 90.0, None), (1, 1, 4, "", 1.0, 1.0, 1.0, None),
        (2, 0, 0, "Q2 2024", 174047.0, 7.2, 1.0, None), (2, 0, 1, "2024-03-31", 152.8, 7.0, 8.0, None), (2, 1, 2, "2023", None, 6.5, -9.0, None), (2, 1, 3, "H1 2024", 160000.0, 6.0, 55.0, None),
        (3, 0, 0, "2021", 43.0, None, None, None), (3, 0, 1, "2022", None, None, None, None), (3, 0, 2, "2023", 44.0, None, None, None),
    ),
)
BREAKDOWN_ROWS = Rows(
    "doc int, chunk int, kind string, ord int, name string, value string",
    (
        (1, 0, "segment", 0, "Retail", "33,432"), (1, 0, "segment", 1, "Wholesale ", "1528"), (1, 1, "segment", 2, "Rétail", "454"), (1, 0, "geography", 0, "Estonia", "35414"),
        (2, 0, "geography", 0, "Latvia", "39.5"), (2, 0, "geography", 1, "Läti", "28.477"), (2, 0, "segment", 0, "A", "0"),
        (3, 0, "segment", 0, "A", "56%"), (3, 0, "segment", 1, "B", "44%"), (4, 0, "segment", 0, "A", "60"), (4, 0, "segment", 1, "B", "40"), (5, 0, "segment", 0, "A", "7000"), (5, 0, "segment", 1, " ", "9"), (5, 0, "segment", 2, "B", "x"),
    ),
)
NARRATIVE_ROWS = Rows(
    "doc int, chunk int, ord int, section string, text string",
    ((1, 0, 0, "Financial Highlights", " Good year. "), (1, 0, 1, "executiveSummary", "Short."), (1, 1, 2, "outlook", "Up."), (1, 1, 3, "Riskfactors", "Rates rise and much more text that is longer than fifty characters."), (1, 1, 4, "strategy", "  "), (2, 0, 0, "", "Untitled."), (2, 0, 1, "Segment-Results", "By segment."), (2, 1, 2, "outlook", "Down.")),
)
