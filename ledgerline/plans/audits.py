"""Queries on what is wrong with filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import checks as K
from ledgerline.plans.figures import canonical_sql
from ledgerline.plans.inputs import FILED, FILINGS_SQL, METRICS, NARRATIVES, TRENDS, filings, table
from ledgerline.plans.registry import query, re2
from ledgerline.storage import materialize

_M = f"(SELECT *, {canonical_sql('label')} AS id FROM {METRICS.sql})"
_LOW = "confidence < 0.6"
_YEAR = lambda x: f"nullif(regexp_extract({x}, '\\b(20\\d{{2}}|19\\d{{2}})\\b', 1), '')"
_HEAD = f"(SELECT m.*, f.report_period FROM {_M} m JOIN {FILED.sql} f USING (doc) WHERE id IN ('revenue', 'ebitda', 'net_profit', 'free_cash_flow') AND value IS NOT NULL)"
_ISSUES = f"""SELECT doc, ord, 'missing_snippet' AS code FROM {_HEAD} WHERE trim(coalesce(snippet, '')) = '' UNION ALL SELECT doc, ord, 'missing_unit' FROM {_HEAD} WHERE trim(coalesce(unit, '')) = ''
 UNION ALL SELECT doc, ord, 'missing_period' FROM {_HEAD} WHERE trim(coalesce(period, '')) = '' AND trim(coalesce(report_period, '')) = '' UNION ALL SELECT doc, ord, 'period_mismatch' FROM {_HEAD} WHERE {_YEAR('period')} <> {_YEAR('report_period')} UNION ALL SELECT doc, ord, 'low_confidence' FROM {_HEAD} WHERE {_LOW}"""


@query("J2q_headline_issues", _ISSUES)
def headline_issues(spark: SparkSession, sf: str) -> DataFrame:
    return K.headline_issues(METRICS.df(spark, sf), FILED.df(spark, sf).select("doc", "report_period"))


_CORE = f"value IS NOT NULL AND (coalesce(id IN ('revenue', 'ebitda', 'net_profit', 'free_cash_flow', 'operating_cash_flow', 'capex'), false) OR regexp_matches(label, {re2(K.CORE_WORDS)}))"
_GATE = f"""WITH s AS (SELECT doc, count(*) AS n, count(value) AS numbers, count(*) - count(value) AS nulls, count(*) FILTER ({_CORE}) AS cores, count(*) FILTER ({_CORE} AND {_LOW}) AS unsure FROM {_M} GROUP BY doc), t AS (SELECT doc, bool_or(length(trim(text)) > 50) AS told FROM {NARRATIVES.sql} GROUP BY doc),
f AS (SELECT f.*, coalesce(n, 0) AS n, coalesce(numbers, 0) AS numbers, coalesce(nulls, 0) AS nulls, coalesce(cores, 0) AS cores, coalesce(unsure, 0) AS unsure, coalesce(told, false) AS told FROM {FILED.sql} f LEFT JOIN s USING (doc) LEFT JOIN t USING (doc))
SELECT doc, unnest(list_filter([CASE WHEN trim(coalesce(company, '')) = '' THEN 'missing_company_name' END, CASE WHEN trim(coalesce(report_period, '')) = '' THEN 'missing_report_period' END, CASE WHEN n = 0 THEN 'no_metrics' END, CASE WHEN n > 0 AND numbers = 0 THEN 'no_numeric_metrics' END, CASE WHEN n > 0 AND nulls * 2 >= n THEN 'mostly_null_metrics' END,
 CASE WHEN cores = 0 THEN 'no_core_metric' END, CASE WHEN company_confidence < 0.6 THEN 'low_company_confidence' END, CASE WHEN period_confidence < 0.6 THEN 'low_period_confidence' END, CASE WHEN unsure > 0 THEN 'low_core_confidence' END, CASE WHEN NOT told AND numbers < 2 THEN 'nothing_told' END], lambda x: x IS NOT NULL)) AS code FROM f
UNION ALL SELECT DISTINCT doc, 'headline_' || code FROM ({_ISSUES})"""


@query("J1q_quality_gate", _GATE)
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return K.quality_gate(FILED.df(spark, sf), METRICS.df(spark, sf), NARRATIVES.df(spark, sf))


_SANE = f"""WITH {FILINGS_SQL}, n AS (SELECT id, company_id, fiscal_year, CASE report_type WHEN 'q4' THEN 'semi-annual' ELSE report_type END AS report_type, CASE WHEN company_id % 4 = 0 AND report_type = 'q1' THEN revenue * 50 ELSE revenue END AS revenue, CASE WHEN company_id % 6 = 0 THEN net_profit * 5 ELSE net_profit END AS net_profit FROM filings),
h AS (SELECT a.id, median(abs(b.revenue)) AS usual, max(abs(b.revenue)) FILTER (b.fiscal_year = a.fiscal_year AND b.report_type = 'annual') AS annual FROM n a JOIN n b ON a.company_id = b.company_id AND a.id <> b.id GROUP BY a.id)
SELECT n.id AS doc, 'net_profit_exceeds_revenue' AS code FROM n WHERE abs(net_profit) / abs(revenue) > 2 UNION ALL SELECT n.id, 'history_extreme_change' FROM n JOIN h USING (id) WHERE revenue > 0 AND (revenue / usual > 10 OR revenue / usual < 0.1) UNION ALL SELECT n.id, 'semi_annual_exceeds_annual' FROM n JOIN h USING (id) WHERE report_type = 'semi-annual' AND abs(revenue) > 1.5 * annual
UNION ALL SELECT id, 'balance_sheet_scale_mismatch' FROM n WHERE company_id % 7 = 0 AND revenue > 0 AND (500 * revenue + 2) / 2 / revenue > 100"""


@query("J3q_sanity", _SANE)
def sanity(spark: SparkSession, sf: str) -> DataFrame:
    f = materialize(filings(spark, sf), "filings")
    n = f.select(
        F.col("id").alias("doc"), "company_id", "fiscal_year", F.when(F.col("report_type") == "q4", "semi-annual").otherwise(F.col("report_type")).alias("report_type"),
        F.when((F.col("company_id") % 4 == 0) & (F.col("report_type") == "q1"), F.col("revenue") * 50).otherwise(F.col("revenue")).alias("revenue"), F.when(F.col("company_id") % 6 == 0, F.col("net_profit") * 5).otherwise(F.col("net_profit")).alias("net_profit"), F.lit(None).cast("double").alias("fcf"),
    )
    balance = n.where("company_id % 7 = 0").select("doc", F.explode(F.array(F.col("revenue") * 500, F.lit(2.0))).alias("value"))
    return K.sanity(n, balance, n.select("doc", "company_id", "fiscal_year", "report_type", "revenue"))


@query("E18_missing_core", f"SELECT doc, array_to_string(list_filter(['revenue', 'net_profit'], lambda x: NOT list_contains(have, x)), ',') AS missing FROM (SELECT doc, coalesce(list(DISTINCT id) FILTER (value IS NOT NULL AND id IS NOT NULL), []) AS have FROM {_M} GROUP BY doc)")
def missing_core(spark: SparkSession, sf: str) -> DataFrame:
    return K.missing_core(METRICS.df(spark, sf)).select("doc", F.array_join("missing", ",").alias("missing"))


@query("F10_repeated_periods", f"SELECT doc, trim(period) AS name, count(*) AS n FROM {TRENDS.sql} GROUP BY ALL HAVING count(*) > 1")
def repeated_periods(spark: SparkSession, sf: str) -> DataFrame:
    return K.repeated(TRENDS.df(spark, sf), ["doc"], F.trim("period"))


@query("E19_histogram", f"SELECT code, count(*) AS n FROM ({_GATE}) GROUP BY code")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return K.histogram(quality_gate(spark, sf))


@query("E20_H9_worst", f"SELECT doc, count(*) AS n, max(CASE WHEN code IN ('missing_snapshot', 'company_mismatch', 'missing_core_metrics', 'mostly_null_metrics', 'no_metrics') THEN 3 WHEN code IN ('trend_length_mismatch', 'empty_trends', 'duplicate_trend_periods', 'missing_executive_summary') THEN 2 ELSE 1 END) AS severity FROM ({_GATE}) GROUP BY doc")
def worst(spark: SparkSession, sf: str) -> DataFrame:
    return K.worst(quality_gate(spark, sf))


@query("E18_labelled_quality", "SELECT source, count(*) AS documents, count(quality) AS labelled, round(avg(quality), 9) AS good, sum(coalesce(toxic, 0)) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def labelled_quality(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "labels")
    g = d.join(lab, "doc_id", "left").groupBy("source")
    return g.agg(F.count(F.lit(1)).alias("documents"), F.count("quality").alias("labelled"), F.round(F.avg("quality"), 9).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
