"""What a metric's label says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.text import compact_label

_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def _any(*phrases: str) -> str:
    return "|".join(f"{_B}{p}{_E}" for p in phrases)


# Words for each metric in English, Estonian, Latvian and Lithuanian; the first class that fits is it.
EPS = _any("eps", "earnings per share", "profit per share")
DIVIDENDS = _any("dividends?", "dividend per share")
CAPEX = _any("capex", "capital expenditures?", "capital investments?")
FREE_CASH_FLOW = _any("free cash flow", "fcf", "laisvasis pinigu srautas", "briva naudas plusma")
OPERATING_CASH_FLOW = _any("operating cash flow", "cash flow from operating", "net cash from operating", "aritegevuse rahavoog", "pamatdarbibas naudas plusma", "veiklos pinigu srautas")
EBITDA = _any("ebitda")
NET_PROFIT = _any("profit for the period", "net profit", "net income", "net earnings", "profit attributable", "grynasis pelnas", "neto pelna", "puhas kasum", "puhaskasum")
NOT_NET_PROFIT = _any("operating", "veiklos", "darbibas", "tegevus")
TOTAL_ASSETS = _any("total assets", "assets total", "assets", "turtas", "varad", "varad kokku", "kopejie aktivi", "aktivi")
LIABILITIES = _any("total liabilities", "liabilities", "liability", "debt", "isipareigojimai", "kohustised", "kohustused", "saistibas")
EQUITY = _any("total equity", "equity", "shareholders equity", "nuosavas kapitalas", "omakapital", "pasu kapitals")
NOT_REVENUE = _any("interest income", "fee income", "commission", "palukan") + f"|{_B}komisini"
REVENUE = "^(total )?revenue$|^net sales$|^sales$|^turnover$|^muugitulu$|^pajamos$|^kaive$|^ie[nn]emumi$|" + _any("revenue")


def canonical_id(label: Column) -> Column:
    """One of METRIC_IDS, or null; the order of the classes is part of the rule."""
    x = compact_label(label)
    return (
        F.when(x == "", F.lit(None).cast("string"))
        .when(x.rlike(EPS), "eps")
        .when(x.rlike(DIVIDENDS), "dividends")
        .when(x.rlike(CAPEX), "capex")
        .when(x.rlike(FREE_CASH_FLOW), "free_cash_flow")
        .when(x.rlike(OPERATING_CASH_FLOW), "operating_cash_flow")
        .when(x.rlike(EBITDA), "ebitda")
        .when(x.rlike(NET_PROFIT) & ~x.rlike(NOT_NET_PROFIT), "net_profit")
        .when(x.rlike(TOTAL_ASSETS), "total_assets")
        .when(x.rlike(LIABILITIES), "liabilities")
        .when(x.rlike(EQUITY), "equity")
        .when(~x.rlike(NOT_REVENUE) & x.rlike(REVENUE), "revenue")
    )


# How the metrics are shown.
METRIC_NAMES = {"revenue": "Revenue", "ebitda": "EBITDA", "net_profit": "Net profit", "free_cash_flow": "Free cash flow", "operating_cash_flow": "Operating cash flow", "capex": "Capital expenditure", "total_assets": "Total assets", "equity": "Equity", "liabilities": "Liabilities", "eps": "EPS", "dividends": "Dividends"}


def metric_name(metric_id: Column) -> Column:
    return F.coalesce(*(F.when(metric_id == k, F.lit(v)) for k, v in METRIC_NAMES.items()))


EXCLUDED = _any("target", "goal", "forecast", "projection", "guidance", "per share", "eps", "vienai akcijai") + f"|{_B}dividend"


def is_excluded(label: Column) -> Column:
    """Goals, forecasts and figures per share are no headline figures."""
    return F.lower(label).rlike(EXCLUDED)


def says_revenue(label: Column) -> Column:
    x = F.lower(F.trim(label))
    bad = x.rlike("palūkan|palukan|komisini|commission|interest income|fee income")
    return ~bad & (x.rlike(r"^(total\s+)?(revenue|sales|turnover|pajamos|käive|kaive)$|^ie[nņ]ēmumi$|^ie[nņ]mumi$") | (x.rlike(_any("revenue")) & ~x.rlike("interest|commission")) | x.rlike(_any("pajamos")))


def says_ebitda(label: Column) -> Column:
    return F.lower(label).rlike(EBITDA)


def says_net_profit(label: Column) -> Column:
    x = F.lower(F.trim(label))
    operating = x.rlike("operating|veiklos|darbības|tegevus") & x.rlike("profit|pelnas|peļņa|kasum")
    return ~operating & x.rlike(_any("net profit", "net income", "net earnings", "grynasis pelnas", "puhas kasum", "puhaskasum") + f"|{_B}neto peļņa|^grynasis pelnas")


def says_fcf(label: Column) -> Column:
    return F.lower(label).rlike(_any("free cash flow", "fcf", "laisvasis pinigų srautas"))


#: Headline figures: canonical id, label test, field of the trends.
HEADLINES = {"revenue": ("revenue", says_revenue, "revenue"), "ebitda": ("ebitda", says_ebitda, "ebitda"), "net_profit": ("net_profit", says_net_profit, "netProfit"), "fcf": ("free_cash_flow", says_fcf, "freeCashFlow")}


def label_fits(label: Column, headline: str) -> Column:
    metric_id, test, _ = HEADLINES[headline]
    return F.coalesce(canonical_id(label) == metric_id, F.lit(False)) | test(label)


def is_per_share_or_ratio(label: Column) -> Column:
    return F.lower(label).rlike(_any("eps", "employees?", "margin", "ratio", "yield") + "|per share|%")


# Words of amounts of money that a filing sums up.
AGGREGATE = "revenue|sales|turnover|müügitulu|muugitulu|pajamos|käive|kaive|ie[nņ][ēe]mumi|ebitda|profit|loss|pelnas|peļņa|pelna|kasum|cash flow|rahavoog|naudas plūsma|naudas plusma|pinigu srautas|assets|turtas|varad|aktīvi|aktivi|liabilit|isipareigojimai|kohust|saistības|saistibas|equity|kapitalas|omakapital|pašu kapitāls|pasu kapitals|debt|fcf|operating|veiklos|darbības|darbibas|tegevus"


def is_aggregate(label: Column) -> Column:
    return F.coalesce(F.lower(label).rlike(AGGREGATE), F.lit(False))


def _sells(label: Column) -> Column:
    return F.lower(F.trim(label)).rlike(_any("revenue", "sales", "turnover"))


def _frees(label: Column) -> Column:
    return F.lower(label).rlike(_any("free cash flow", "fcf"))


def is_pillar(label: Column) -> Column:
    return F.coalesce(canonical_id(label).isin("revenue", "free_cash_flow"), F.lit(False)) | _sells(label) | _frees(label)


def weight(metric_id: Column, label: Column) -> Column:
    return F.when(F.coalesce(metric_id.isin("revenue", "free_cash_flow"), F.lit(False)) | is_pillar(label), 2).otherwise(1)


def higher_is_better(metric_id: Column, label: Column) -> Column:
    known = F.coalesce(metric_id, canonical_id(label))
    key = F.lower(F.trim(F.regexp_replace(label, r"\s+", " ")))
    good = is_pillar(label) | key.rlike("profit|margin|ebitda|income|eps")
    return F.when(known.isin("liabilities", "capex"), False).when(known.isNotNull(), True).when(key.rlike(_any("cost", "expense", "debt")), False).otherwise(good)


def compare_rank(metric_id: Column, label: Column) -> Column:
    """Order of rows in a comparison."""
    is_ = lambda x: F.coalesce(metric_id == x, F.lit(False))
    low = F.lower(label)
    return (
        F.when(is_("revenue") | _sells(label), 0)
        .when(is_("free_cash_flow") | _frees(label), 1)
        .when(is_("ebitda") | low.rlike(EBITDA), 2)
        .when(is_("net_profit") | low.rlike(_any("net profit", "net income")), 3)
        .when(F.contains(low, F.lit("margin")), 4)
        .otherwise(10)
    )
