"""Whole filings as one nested row each, made from filings() by expressions in both Spark's and DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerline.operators.snapshots import SNAPSHOT
from ledgerline.plans.inputs import FILINGS_SQL, SHORT, filings, spark_sql, table
from ledgerline.storage import materialize

#: A value in a dialect, "spark" or "duck".
Value = Callable[[str], str]
_SCALAR = {"string": "VARCHAR", "double": "DOUBLE"}


def dealt(values: Sequence[str | float | None], by: str) -> str:
    """The value whose place is ``by`` modulo their number; as text."""
    listed = "|".join("~" if v is None else str(v).replace("'", "''") for v in values)
    sql = f"nullif(split_part('{listed}', '|', CAST(({by}) % {len(values)} AS INT) + 1), '~')"
    parts = ", ".join("NULL" if v == "~" else f"'{v}'" for v in listed.split("|"))
    SHORT[sql] = f"get(array({parts}), CAST(({by}) % {len(values)} AS INT))"
    return sql


def typed(kind: str, sql: str) -> Value:
    return lambda d: f"CAST({sql} AS {kind if d == 'spark' else _SCALAR[kind]})"


def record(**fields: Value) -> Value:
    def of(d: str) -> str:
        parts = [f"'{k}', {v(d)}" for k, v in fields.items()]
        return f"named_struct({', '.join(parts)})" if d == "spark" else f"{{{', '.join(p.replace(', ', ': ', 1) for p in parts)}}}"

    return of


#: Entries of an array at most.
MOST = 12


def each(n: str, item: Value) -> Value:
    """An array of n items, in which ord counts from 0."""
    return lambda d: f"transform(filter(sequence(0, {MOST}), ord -> ord < {n}), ord -> {item(d)})" if d == "spark" else f"list_transform(range(0, {n}), lambda ord: {item(d)})"


def unless(cond: str, value: Value) -> Value:
    return lambda d: f"CASE WHEN NOT ({cond}) THEN {value(d)} END"


# --- names ------------------------------------------------------------------------------------------------------------

_FIRST = ("Tal", "Teli", "Ign", "Har", "Lat", "Mer", "Olai", "Gri", "Eke", "Kau", "Apr", "Nova", "Inv", "Lin", "Rok", "Žem", "Pie", "Šia", "Snai", "Vil", "Utē", "Äri", "Õun", "Bal", "Pan", "Aug", "Kla", "Sil", "Enef", "Nord", "Arc")
_SECOND = ("link", "a", "itis", "ju", "vijas", "ko", "ne", "ndeks", "ro", "no", "anga", "tur", "l", "tek", "vest", "da", "kiš", "gė", "uls", "ta", "rus", "dal", "tico", "fa", "ipė", "ve", "it", "mark", "tas")
_THIRD = ("Grupp", "Lietuva", "grupė", "Elekter", "Gāze", "Holding", "Kapital", "Group", "Marine", "Farm", "Energia", "Invest", "Trade")
_BEFORE, _AFTER = ("AS ", "", "AB ", "", "UAB ", ""), ("", " AS", "", ", AB", "", " SIA", " A/S")
#: Letters of these names beyond ASCII, small ones.
MARKED = "žšēäõėā"


def _stem(k: str) -> str:
    return f"{dealt(_FIRST, k)} || {dealt(_SECOND, f'CAST(floor(({k}) / 31) AS BIGINT) + {k}')}"


def company_name(k: str) -> str:
    return f"{dealt(_BEFORE, k)} || {_stem(k)} || ' ' || {dealt(_THIRD, k)} || {dealt(_AFTER, k)}"


def ticker(k: str) -> str:
    return f"CASE WHEN ({k}) % 4 <> 0 THEN 'T' || CAST({k} AS STRING) || 'L' END"


#: What said_name() is made of, as columns of a filing.
_NAMED = {"n0": company_name("company_id"), "n1": company_name("company_id + 1"), "n2": company_name("company_id + 2"), "stem": _stem("company_id"), "third": dealt(_THIRD, "company_id"), "tick": ticker("company_id")}


def said_name(e: str) -> str:
    """A company's name as a filing may write it: whole, with letters swapped, lost, added, words turned, another's, none."""
    forms = (
        "n0", "substr(n0, 1, 6) || substr(n0, 8, 1) || substr(n0, 7, 1) || substr(n0, 9)", "substr(n0, 1, 5) || substr(n0, 7)", "substr(n0, 1, 7) || substr(n0, 11)", "third || ' ' || stem", "coalesce(tick, 'No') || ' results'", "n1", "'Unknown Trust ' || CAST(company_id AS STRING)", "' '",
        "upper(stem || ' ' || third) || ' A/S'", "translate(n0, 'žšēäõėāŽŠÄÕ', 'zseaoeaZSAO')", "replace(n0, 'a', 'e')", "replace(n2, 'r', '')", "n0 || ' ir dukterinės'", "'\"' || n0 || '\", AB'",
    )
    return f"CASE ({e}) % {len(forms)} " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(forms)) + " END"


# --- snapshots --------------------------------------------------------------------------------------------------------

_H = "(company_id * 131 + fiscal_year * 17 + CASE report_type WHEN 'annual' THEN 0 WHEN 'q1' THEN 1 WHEN 'q2' THEN 2 WHEN 'q3' THEN 3 ELSE 4 END)"
_LABELS = (
    "Revenue", "Net profit", "Free cash flow", "EBITDA", "Total assets", "Equity", " revenue", "Net Profit", "Müügitulu", "Operating cash flow", "CAPEX", "EPS", "Employees", "Liabilities", "Revenue target", "Net income", "FCF", "Pajamos", "Dividends per share",
    "Gross margin", "", "Operating profit", "Total revenue", "Puhaskasum", "Cost of sales", "Neto peļņa", "Debt", "EBITDA margin", "Investments",
)
_SECTIONS = ("Financial Highlights", "executive_summary", "outlook", "Riskfactors", "strategy", "", "Segment-Results", "outlook", "business_overview", "other", "letter", "managementCommentary")
_SHAPE = "({v} / (1 + ord % 5))"
_SERIES = lambda n, nil, value, gone: unless(gone, each(n, typed("double", f"CASE WHEN (h + ord) % {nil} <> 0 THEN {value} END")))
_FIELDS: dict[str, Value] = {
    "company_name": typed("string", said_name("h")),
    "report_period": typed("string", f"CASE h % 9 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'H1 ' || CAST(fiscal_year AS STRING) WHEN 3 THEN 'sometime' WHEN 4 THEN 'FY ' || CAST(fiscal_year AS STRING) WHEN 5 THEN CAST(fiscal_year AS STRING) || '-06-30' ELSE upper(CASE report_type WHEN 'annual' THEN '' ELSE report_type END) || CASE report_type WHEN 'annual' THEN '' ELSE ' ' END || CAST(fiscal_year AS STRING) END"),
    "language": typed("string", dealt(("en", "en", "lv", "et"), "company_id + fiscal_year")),
    "metrics": each(
        f"(h % 11)",
        record(
            label=typed("string", dealt(_LABELS, f"h * 7 + ord * 3")), value=typed("double", f"CASE (h + ord * 4) % 9 WHEN 0 THEN NULL WHEN 1 THEN company_id WHEN 2 THEN net_profit WHEN 3 THEN revenue / 1000 ELSE {_SHAPE.format(v='revenue')} END"),
            unit=typed("string", dealt(("EUR", "EUR", "EUR thousand", "", None, "%", "EUR m"), f"h + CASE WHEN ord % 4 = 3 THEN ord ELSE 0 END")), period=typed("string", dealt(("2024", None, "", "2023"), f"h + ord")),
            snippet=typed("string", dealt(("Revenue was EUR 0.39 m", "", None, "in thousands of euros"), f"h + ord")), confidence=typed("double", dealt((None, 0.5, 0.9), f"h + ord")),
        ),
    ),
    "narratives": each(f"(h % 7)", record(section=typed("string", dealt((*_SECTIONS, None), f"h + ord * 5")), text=typed("string", f"CASE (h + ord) % 5 WHEN 0 THEN ' Good year. ' WHEN 1 THEN '  ' WHEN 2 THEN NULL WHEN 3 THEN 'Filing ' || id ELSE 'One. ' || report_type || chr(10) || chr(10) || 'Two is much longer than fifty characters, as it should be.' || chr(10) || chr(10) || ' one.  ' || report_type || chr(10) || chr(10) || 'Three.' END"))),
    "tone": typed("string", dealt(("positive", " cautious ", "", "very positive", "Neutral", None, "negative"), "h")),
    "outlook": typed("string", dealt(("Stable", "", "Growth ahead", None), f"h + company_id")),
    "risks": each(f"(h % 6)", typed("string", dealt(("Rates", " ", "War", "FX", " Rates ", None), f"h + ord"))),
    "guidance": typed("string", dealt(("raised", "maintained", "lowered", None), "h")),
    "breakdown": unless(
        f"h % 13 = 0",
        record(
            segments=unless(f"h % 5 = 0", each(f"(h % 6)", record(name=typed("string", dealt(("Retail", "Wholesale ", "Rétail", "Estonia", " ", "A", "retail", None), f"h + ord * 3")), value=typed("double", f"CASE WHEN (h + ord) % 7 <> 0 THEN revenue * (ord + 1) * CASE WHEN ord % 3 = 2 THEN -0.25 ELSE 0.5 END END")))),
            geographies=unless(f"h % 3 = 0", each(f"(h % 4)", record(name=typed("string", dealt(("Latvia", "LATVIA", "Estonia"), f"h + ord")), value=typed("double", "net_profit")))),
        ),
    ),
    "trends": unless(
        f"h % 8 = 0",
        record(
            periods=each(f"(h % 7)", typed("string", dealt(("2022", "2023", "2023", " 2024 ", "", "Q2 2024", None, "2021"), f"h + ord"))),
            revenue=_SERIES(f"(h % 7 + CASE h % 5 WHEN 0 THEN 1 WHEN 1 THEN -h % 2 ELSE 0 END)", 6, f"revenue * CASE (h + ord) % 4 WHEN 0 THEN 9 ELSE 1 END / 1000", "false"),
            ebitda=_SERIES(f"(h % 7)", 4, "revenue / (ord + 4)", f"h % 4 = 0"), net_profit=_SERIES(f"(h % 7)", 3, "net_profit", f"h % 10 = 9"), fcf=_SERIES(f"(h % 5)", 1, "0", f"h % 2 = 0"),
        ),
    ),
}
_FILED_UNDER = "CASE WHEN company_id % 19 = 0 THEN NULL WHEN company_id % 17 = 0 THEN company_id + 1000000 ELSE company_id END"


def _snapshot(d: str, fields: Sequence[str] = tuple(_FIELDS)) -> str:
    return unless("h % 29 = 0", record(**{f: _FIELDS[f] for f in fields}))(d)


#: CTEs up to snap (id, company_id, fiscal_year, report_type, revenue, net_profit, score, h, filed_under, snapshot) and catalogue (id, name, ticker, ord).
SNAP_SQL = f"""{FILINGS_SQL}, named_filings AS MATERIALIZED (SELECT *, {_H} AS h, {_FILED_UNDER} AS filed_under, {', '.join(f'{v} AS {k}' for k, v in _NAMED.items())} FROM filings), snap AS MATERIALIZED (SELECT * EXCLUDE ({', '.join(_NAMED)}), {_snapshot("duck")} AS snapshot FROM named_filings),
catalogue AS MATERIALIZED (SELECT s_suppkey AS id, {company_name("s_suppkey")} AS name, {ticker("s_suppkey")} AS ticker, s_suppkey AS ord FROM supplier)"""


def snapshots(spark: SparkSession, sf: str, fields: Sequence[str] = tuple(_FIELDS)) -> DataFrame:
    """filings() with snapshot (operators.snapshots.SNAPSHOT, or the fields of it that a query reads), the company it is filed under, and h, from which faults are dealt; written once."""
    named = filings(spark, sf).selectExpr("*", f"{_H} AS h", f"{_FILED_UNDER} AS filed_under", *(f"{spark_sql(v)} AS {k}" for k, v in _NAMED.items()))
    made = named.selectExpr("*", f"{spark_sql(_snapshot('spark', fields))} AS snapshot").drop(*_NAMED)
    kind = T.StructType([f for f in T.DataType.fromDDL(SNAPSHOT) if f.name in fields])
    return materialize(made.withColumn("snapshot", made["snapshot"].cast(kind)), "filings")


def said_names(spark: SparkSession, sf: str) -> DataFrame:
    """(id, company_id, said): the company each filing of snapshots() is filed under and the name its snapshot has; nothing else is made, and that once."""
    named = filings(spark, sf).selectExpr("id", "company_id", f"{_H} AS h", f"{_FILED_UNDER} AS filed_under", *(f"{spark_sql(v)} AS {k}" for k, v in _NAMED.items()))
    return materialize(named.selectExpr("id", "filed_under AS company_id", f"CASE WHEN NOT (h % 29 = 0) THEN {spark_sql(_FIELDS['company_name']('spark'))} END AS said"), "said-names")


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """(id, name, ticker, ord) of the companies."""
    return table(spark, sf, "supplier").selectExpr("s_suppkey AS id", f"{spark_sql(company_name('s_suppkey'))} AS name", f"{ticker('s_suppkey')} AS ticker", "s_suppkey AS ord")
