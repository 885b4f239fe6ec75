"""Inputs of the queries: filings made from the star-schema tables, and small tables of rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Rows:
    """A few rows that are the same in Spark and in SQL."""

    #: "name type, ..." with types that both know (int, bigint, double, string, boolean, timestamp)
    columns: str
    rows: tuple[tuple, ...]

    def df(self, spark: SparkSession) -> DataFrame:
        fields = [c.split() for c in self.columns.split(", ")]
        raw = ", ".join(f"{n} {'string' if t == 'timestamp' else t}" for n, t in fields)
        df = spark.createDataFrame(list(self.rows), raw)
        return df.select(*(F.to_timestamp(n).alias(n) if t == "timestamp" else F.col(n) for n, t in fields))

    @property
    def sql(self) -> str:
        fields = [c.split() for c in self.columns.split(", ")]
        kinds = {"string": "VARCHAR", "int": "INTEGER"}

        def literal(v: object) -> str:
            if v is None:
                return "NULL"
            return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)

        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        casts = ", ".join(f"CAST({n} AS {kinds.get(t, t.upper())}) AS {n}" for n, t in fields)
        return f"(SELECT {casts} FROM (VALUES {values}) AS v({', '.join(n for n, _ in fields)}))"


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(company_id, company, exchange): suppliers, listed in their region."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select(F.col("s_suppkey").alias("company_id"), F.col("s_name").alias("company"), F.col("r_name").alias("exchange"))


COMPANIES_SQL = "companies AS (SELECT s_suppkey AS company_id, s_name AS company, r_name AS exchange FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, company_id, fiscal_year, report_type, revenue, net_profit, ebitda): quarterly reports, and annual ones unless a company that numbers divisible by 5 is late with those from 2000 on.

    One shuffle adds up quarters; years come from those.  EBITDA is not given.
    """
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_shipdate")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    dec = "decimal(18,4)"
    revenue = (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast(dec)
    cost = (F.col("l_quantity") * F.col("p_retailprice")).cast(dec)
    rows = line.join(part, line.l_partkey == part.p_partkey).select(F.col("l_suppkey").alias("company_id"), F.year("l_shipdate").alias("fiscal_year"), F.quarter("l_shipdate").alias("q"), revenue.alias("r"), cost.alias("c"))
    by_quarter = rows.groupBy("company_id", "fiscal_year", "q").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    by_year = by_quarter.groupBy("company_id", "fiscal_year").agg(F.sum("r").alias("r"), F.sum("c").alias("c")).where("company_id % 5 <> 0 or fiscal_year < 2000")
    both = by_quarter.select("company_id", "fiscal_year", F.concat(F.lit("q"), F.col("q").cast("string")).alias("report_type"), "r", "c").unionByName(by_year.withColumn("report_type", F.lit("annual")))
    ident = F.concat_ws("-", F.col("company_id").cast("string"), F.col("fiscal_year").cast("string"), "report_type")
    return both.select(ident.alias("id"), "company_id", "fiscal_year", "report_type", F.col("r").cast("double").alias("revenue"), (F.col("r") - F.col("c")).cast("double").alias("net_profit"), F.lit(None).cast("double").alias("ebitda"))


FILINGS_SQL = """line AS (SELECT l_suppkey AS company_id, year(l_shipdate) AS fiscal_year, quarter(l_shipdate) AS q,
  CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS r, CAST(l_quantity * p_retailprice AS DECIMAL(18,4)) AS c FROM lineitem JOIN part ON l_partkey = p_partkey),
filed AS (SELECT company_id, fiscal_year, 'q' || q AS report_type, sum(r) AS r, sum(c) AS c FROM line GROUP BY ALL
  UNION ALL SELECT company_id, fiscal_year, 'annual', sum(r), sum(c) FROM line WHERE company_id % 5 <> 0 OR fiscal_year < 2000 GROUP BY ALL),
filings AS (SELECT company_id || '-' || fiscal_year || '-' || report_type AS id, company_id, CAST(fiscal_year AS INTEGER) AS fiscal_year, report_type, CAST(r AS DOUBLE) AS revenue, CAST(r - c AS DOUBLE) AS net_profit,
  fiscal_year * 10 + CASE report_type WHEN 'annual' THEN 6 ELSE CAST(substr(report_type, 2) AS INTEGER) END AS score FROM filed)"""

@dataclass(frozen=True)
class Made:
    """Rows made from each order, or row of another table, by expressions that Spark and DuckDB read alike.

    With n, an order gives rows ord 0 to n - 1.
    """

    columns: tuple[str, ...]
    n: str | None = None
    source: str = "orders"
    where: str = "true"

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, self.source).where(self.where)
        if self.n:
            rows = rows.selectExpr("*", f"explode(sequence(0, CAST({self.n} AS INT) - 1)) AS ord")
        return rows.selectExpr(*map(spark_sql, self.columns))

    @property
    def sql(self) -> str:
        source = f"(SELECT *, unnest(range(0, {self.n})) AS ord FROM {self.source})" if self.n else self.source
        return f"(SELECT {', '.join(self.columns)} FROM {source} WHERE {self.where})"


#: What Spark reads for the text of a dealt(): a CASE of many branches makes methods too long for the JVM to compile.
SHORT: dict[str, str] = {}


def spark_sql(sql: str) -> str:
    """The same expression with each dealt() looked up in an array."""
    for text in sorted((t for t in SHORT if t in sql), key=len, reverse=True):
        sql = sql.replace(text, SHORT[text])
    return sql


def dealt(values: Sequence[str | float | None], by: str) -> str:
    """The value whose place is ``by`` modulo their number."""
    literal = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    sql = f"CASE ({by}) % {len(values)} " + " ".join(f"WHEN {i} THEN {literal(v)}" for i, v in enumerate(values)) + " END"
    SHORT[sql] = f"get(array({', '.join(map(literal, values))}), CAST(({by}) % {len(values)} AS INT))"
    return sql


_LABELS = (
    "Revenue", "Net profit", "Free cash flow", "Operating cash flow", "CAPEX", "Total  Revenue", "EPS", "Free Cash Flow", "Total assets", "Equity", "Liabilities", "Müügitulu", "Puhaskasum", "Varad kokku", "Kohustused", "Employees", "Revenue target",
    "EBITDA margin", "Ieņēmumi", "Neto peļņa", "Operating profit", "Dividends per share", "FCF", "EBIT", "EBITDA", "Grynasis pelnas", "Pajamos", "Net\nprofit", "revenue ", "Capex", "Interest income",
)
_UNITS = ("EUR m", "EUR", "thousand EUR", "", "EUR", None, "tuhat EUR", "mln. EUR", "eur ", "%", "€m")
_SNIPPETS = ("Revenue was EUR 0.39 m", "", "eps", "summad on in thousands of euros", None, "tuhat eurot", "again", "1 bn", "pelnas")
_PERIODS = ("2024", "2023", None, "2024-12", "", "FY 2023", "2025")
_SIZE = "o_totalprice / CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 100 END"

#: Metrics: labels, units, values and evidence of which most of an order's rows share a unit.
METRICS = Made(
    (
        "o_orderkey AS doc", "CAST(ord AS INT) AS ord", dealt(_LABELS, "o_orderkey * 7 + o_custkey + ord * 11") + " AS label",
        f"CAST(CASE (o_orderkey + ord * 4) % 9 WHEN 0 THEN NULL WHEN 1 THEN o_custkey WHEN 2 THEN - ({_SIZE}) WHEN 3 THEN 0 ELSE {_SIZE} END AS DOUBLE) AS value",
        dealt(_UNITS, "o_custkey + CASE WHEN ord % 4 = 3 THEN ord ELSE 0 END") + " AS unit", dealt(_PERIODS, "o_orderkey + ord % 3") + " AS period", dealt(_SNIPPETS, "o_custkey + ord") + " AS snippet",
        dealt((None, None, "mln", None, "in thousands"), "o_orderkey + ord") + " AS rationale", "CAST(" + dealt((None, 0.4, 0.5, 0.6, 0.7, 0.9), "o_custkey + ord * 5") + " AS DOUBLE) AS confidence",
    ),
    "2 + o_custkey % 9",
)
_TEMPLATES = (
    "Q1 2024", "q3 2024", "Q2", "FY2024", "FY 2024", "2024 annual report", "2024 Report", "H1 2024", "H2 2024", "9M 2024", "6M 2024", "3m 2024", "12M 2024", "2024-12-31", "2024-03-31", "2024-06-30", "2024-09-30", "2024-05-01", "2024", " 2024 ", "", "no year",
    "2023-2024 Q1", "2024-09", "2024 Q1", "2024 9 months", "1H 2024", "half-year 2024", "second half 2024", "nine months 2024", "Q4/2024", "2024Q2",
)
#: Texts of periods, of the order's year.
PERIODS = Made(("o_orderkey AS doc", f"replace({dealt(_TEMPLATES, 'o_orderkey')}, '2024', CAST(year(o_orderdate) AS STRING)) AS s"))
#: Trends in chunks of three rows, with repeated, empty and padded periods and values on several scales.
TRENDS = Made(
    (
        "o_orderkey AS doc", "CAST(floor(ord / 3) AS INT) AS chunk", "CAST(ord AS INT) AS idx", dealt(("2022", "2023", "2023", " 2024 ", "", "Q2 2024", "2024-03-31", "H1 2024", "2021"), "o_orderkey + ord") + " AS period",
        f"CASE WHEN (o_custkey + ord) % 6 <> 0 THEN {_SIZE} * CASE (o_orderkey + ord) % 5 WHEN 0 THEN 8 WHEN 1 THEN 1 ELSE (ord + 1) END END AS revenue", f"CASE WHEN (o_custkey + ord) % 3 <> 0 THEN {_SIZE} / (ord + 4) END AS ebitda",
        f"CASE WHEN (o_custkey + ord) % 5 <> 0 THEN {_SIZE} / CASE (o_custkey + ord) % 4 WHEN 0 THEN -9 WHEN 1 THEN 3 ELSE 40 END END AS net_profit", "CAST(CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_custkey END AS DOUBLE) AS fcf",
    ),
    "1 + o_custkey % 7",
)
_THOUSANDS = "CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING)"
#: Parts of revenue as text: with thousands commas, per cents, zeros and what is no number.
BREAKDOWN = Made(
    (
        "o_orderkey AS doc", "CAST(floor(ord / 2) AS INT) AS chunk", dealt(("segment", "geography", "segment"), "o_orderkey + ord * o_custkey") + " AS kind", "CAST(ord AS INT) AS ord",
        dealt(("Retail", "Wholesale ", "Rétail", "Estonia", "Latvia", " ", "A", "retail"), "o_custkey + ord * 3") + " AS name",
        f"CASE (o_orderkey + ord) % 11 WHEN 0 THEN '0' WHEN 1 THEN '56%' WHEN 2 THEN 'x' WHEN 3 THEN '39.5' WHEN 4 THEN NULL WHEN 5 THEN '60' WHEN 6 THEN '40' WHEN 7 THEN {_THOUSANDS} ELSE {_THOUSANDS} || ',' || CAST(100 + o_custkey % 900 AS STRING) END AS value",
    ),
    "1 + o_custkey % 6",
)
SECTIONS = ("Financial Highlights", "executiveSummary", "outlook", "Riskfactors", "strategy", "", "Segment-Results", "outlook", None)
#: Narratives in sections under several names, some blank.
NARRATIVES = Made(
    (
        "o_orderkey AS doc", "CAST(floor(ord / 2) AS INT) AS chunk", "CAST(ord AS INT) AS ord", dealt(SECTIONS, "o_orderkey + ord * 2") + " AS section",
        "CASE (o_custkey + ord) % 4 WHEN 0 THEN ' Good year. ' WHEN 1 THEN '  ' WHEN 2 THEN 'Order ' || CAST(o_orderkey AS STRING) ELSE 'Rates rise and much more text that is longer than fifty characters: ' || o_orderpriority END AS text",
    ),
    "1 + o_custkey % 5",
)
#: What filings say of themselves; some hold neither metrics nor narratives of their own.
FILED = Made(
    (
        "o_orderkey AS doc", dealt(("Acme AS", " ", "Beta", None, "Gamma"), "o_orderkey") + " AS company", dealt(("2024", None, "FY 2023", "2025", ""), "o_custkey + o_orderkey") + " AS report_period",
        "CAST(" + dealt((0.9, 0.5, 1.0, None), "o_orderkey") + " AS DOUBLE) AS company_confidence", "CAST(" + dealt((0.9, None, 0.2), "o_custkey") + " AS DOUBLE) AS period_confidence",
    ),
)
#: Company names as filings write them, some with a number that no company has.
VARIANTS = Made(("o_orderkey AS doc", dealt(("Telia Lietuva, AB", "Tallink Grupp", "Tallnik Grupp", "Grupp Tallink AS", "TAL1T results", "LHV Group", "Unknown Holding", "AS", "Ignitis", "Latvijas Gaze", "", "Harju  Elekter, A/S"), "o_orderkey") + " || CASE WHEN o_custkey % 7 = 0 THEN ' ' || CAST(o_custkey AS STRING) ELSE '' END AS name"))
STRING = "CAST({} AS STRING)".format
_LINES = (
    "Table of Contents", "1. Introduction ....... 3", "Independent Auditor's Report", "Revenue grew", "", "12", "Page 3 of 9", "Annual report 2024", "IFRS 16 leases", "Notes to the accounts", "This document is", "Summary of Significant Accounting Policies",
    "Inventory and Measurement", "short", "Going concern", "We go on", "The English version prevails", "Material uncertainty", "The Group statements are prepared", "Registered office: x", "Contents", "Content of the year", "7 apples", "Commercial Register 1",
    "In the event of discrepancy", "Critical judgements", "Net profit 12 30,5",
)
#: Lines of a filing; every eighth order's end with a number.
LINES = Made(("o_orderkey AS doc", "CAST(ord AS INT) AS no", dealt(_LINES, "o_orderkey + ord * (1 + o_custkey % 5)") + f" || CASE WHEN o_custkey % 8 = 0 THEN ' ' || {STRING('o_custkey')} ELSE '' END AS line"), "1 + o_custkey % 8")
_WORDS = "alpha bravo charlie delta echoes foxtrot golfer hotel india"
_TEXTS = (
    "too few words here", f"{_WORDS} juliet kilos In our opinion the rest", f"{_WORDS} juliet Prospectus", f"{_WORDS} pursuant to the inside information", f"{_WORDS} pursuant to nothing", f"{_WORDS} Press Release and press release",
    f"{_WORDS} Press Release and press release turnover", f"{_WORDS}: Revenue 2023 2024 by segment, Q1 2024, prior year", "",
)
#: Texts with and without the marks of each class.
CLASS_TEXTS = Made(("o_orderkey AS doc", dealt(_TEXTS, "o_orderkey") + f" || CASE WHEN o_custkey % 3 = 0 THEN ' order ' || {STRING('o_custkey % 100')} ELSE '' END AS text"))
_PAGES = (
    "<p>x</p><TABLE><tr><th>Item</th><th>2024</th></tr><tr><td>Revenue</td><td>1 200</td></tr><tr><td>Net&nbsp;profit</td><td>30 | 5</td></tr></TABLE><table><tr><td>only</td></tr></table>",
    "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table><table id=2><tr><td>Assets</td><td>9</td><td></td></tr><tr><td>x</td><td>1</td><td>2</td></tr></table>",
    "<p>no table</p>", "<table><tr><td>Cash &amp; more</td><td><b>5</b></td></tr><tr><td>Loss</td><td>6</td></tr></table>",
)
#: Pages with tables, the figures being the order's.
HTML = Made(("o_orderkey AS page", f"replace(replace({dealt(_PAGES, 'o_orderkey')}, '1 200', {STRING('o_custkey')}), '<b>5', '<b>' || {STRING('o_orderkey')}) AS html"))
_PLACED = (("Revenue", 10, 700), ("100", 90, 699), ("90", 150, 700), ("Profit", 10, 680), ("20", 90, 681), ("10", 150, 682), ("Note", 10, 600), ("a  b", 90, 560), ("c", 50, 560), ("d", 130, 560.5), ("too", 1, 5), ("few", 2, 5), ("items", 3, 5))
#: Placed words of two pages; the later ones are too few, and a third of the orders have none of those.
ITEMS = Made(
    (
        "o_orderkey AS doc", "CASE WHEN ord < 10 THEN 1 ELSE 2 END AS page", f"CASE WHEN ord = 1 THEN {STRING('o_custkey')} ELSE {dealt([t for t, _, _ in _PLACED], 'ord')} END AS text",
        f"CAST({dealt([x for _, x, _ in _PLACED], 'ord')} + o_custkey % 4 AS DOUBLE) AS x", f"CAST({dealt([y for _, _, y in _PLACED], 'ord')} - 3 * (o_orderkey % 9) AS DOUBLE) AS y",
    ),
    "CASE WHEN o_orderkey % 3 = 0 THEN 10 ELSE 13 END",
)
FILES = Made(("o_orderkey AS doc", f"{STRING('o_custkey')} || " + dealt(("a.PDF", "b.csv", "c", "d.xhtml", "e.htm", "f.txt", "g", "h.x.html", "i"), "o_orderkey") + " AS name", dealt((None, "", "text/csv", "application/pdf", "text/plain", "application/xhtml+xml", "text/html", "application/csv"), "o_custkey") + " AS mime"))
_DIGITS = "md5(CAST(o_custkey AS STRING))"
MESSAGES = Made(
    ("o_orderkey AS id", f"CASE o_orderkey % 4 WHEN 0 THEN 'Duplicate of company ' || {' || '.join(f"substr({_DIGITS}, {a}, {n})" + (" || '-'" if a < 21 else "") for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))} WHEN 1 THEN 'company=acme' || {STRING('o_custkey')} || ', year=2024, type=q' || {STRING('1 + o_custkey % 4')} WHEN 3 THEN 'nothing' END AS message"),
)
_LEAD = lambda n: ("'c' || CAST(c_custkey AS STRING) || '@x.ee' AS email", dealt((None, "A", "B"), f"c_custkey + {n}") + " AS company", dealt(("cfo", None, "ceo", "dev"), f"c_custkey * {n}") + " AS role", dealt(("hello", None), f"c_custkey + {n}") + " AS message")
LEADS_OLD = Made(_LEAD(1), source="customer", where="c_custkey % 3 <> 0")
LEADS_NEW = Made(_LEAD(3), source="customer", where="c_custkey % 4 <> 0")


def _report(prefix: str, shift: str) -> tuple[str, ...]:
    own = STRING("o_orderkey")
    return (
        f"'{prefix}' || {own} AS id", "CASE WHEN o_orderkey % 50 <> 0 THEN 'c' || CAST(o_custkey AS STRING) END AS company_id", "CAST(year(o_orderdate) AS INT) AS fiscal_year", dealt(("annual", "q1", "semi-annual"), f"o_orderkey + {shift}") + " AS report_type",
        dealt(("en", "en", "lv", "et"), "o_custkey") + " AS language", f"'j{prefix}' || {own} AS job_id", f"'s{prefix}' || {own} AS s3_key", f"CASE WHEN o_orderkey % 6 <> 0 THEN '{{' || {own} || '}}' END AS extracted_json_snapshot",
    )


REPORTS = Made(_report("r", "0"))
#: Reports of which a third has another type than the report of the same order.
REPORTS_NEW = Made(_report("n", "CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END"), where="o_orderkey % 2 = 0")
#: Two candidates for every even order's report.
CANDIDATES = Made(
    (
        f"'k' || {STRING('o_orderkey')} AS id", f"'r' || {STRING('o_orderkey - o_orderkey % 2')} AS report_id", f"'jk' || {STRING('o_orderkey')} AS job_id", f"'sk' || {STRING('o_orderkey')} AS s3_key", f"'{{' || {STRING('o_custkey')} || '}}' AS extracted_json_snapshot",
        dealt(("pending_review", "failed_quality", "pending_review", "rejected", "approved"), "o_custkey") + " AS status", "o_orderdate AS created_at", "CAST(NULL AS TIMESTAMP) AS approved_at",
    ),
)
#: Candidates that a reviewer chose, one a report.
CHOSEN = Made((f"'k' || {STRING('o_orderkey')} AS id",), where="o_orderkey % 10 = 0")
#: Reports that get another company, or none.
MAPPED = Made((f"'r' || {STRING('o_orderkey')} AS id", "CASE WHEN o_custkey % 3 <> 0 THEN 'c9' END AS company_id"), where="o_orderkey % 7 = 0")
ASKED = Made((f"'r' || {STRING('o_orderkey')} AS id",), where="o_orderkey % 4 = 1")
AUDITED = Made((f"'r' || {STRING('o_orderkey')} AS id",), where="o_orderkey % 3 = 1")
GONE = Made((f"'r' || {STRING('o_orderkey')} AS id",), where="o_orderkey % 8 = 0")
