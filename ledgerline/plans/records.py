"""Queries on trends, breakdowns, narratives and chunks, and on pairs of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import compare as C
from ledgerline.operators import records as R
from ledgerline.operators import sanitizer as Z
from ledgerline.plans.figures import canonical_sql, period_key_sql
from ledgerline.plans.inputs import BREAKDOWN, FILED, FILINGS_SQL, METRICS, NARRATIVES, TRENDS, Made, dealt, filings, table
from ledgerline.plans.registry import SQL, query
from ledgerline.plans.texts import MARKS, SQUEEZE
from ledgerline.storage import materialize

_T, _B, _N = TRENDS.sql, BREAKDOWN.sql, NARRATIVES.sql
_LONG = f"SELECT doc, idx, period, 'revenue' AS series, revenue AS value FROM {_T} UNION ALL SELECT doc, idx, period, 'ebitda', ebitda FROM {_T} UNION ALL SELECT doc, idx, period, 'net_profit', net_profit FROM {_T} UNION ALL SELECT doc, idx, period, 'fcf', fcf FROM {_T}"
#: Headline figures to compare series with, one to three an order, on three scales.
TARGETS = Made(("o_orderkey AS doc", dealt(("revenue", "ebitda", "net_profit"), "ord") + " AS series", "CAST(o_totalprice * CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 20000 END AS DOUBLE) AS target"), "1 + o_orderkey % 3")
#: The scale that a filing states, of every fifth.
STATED = Made(("o_orderkey AS doc", "CAST(CASE WHEN o_orderkey % 5 = 0 THEN 1000 END AS INT) AS multiplier"))
REVENUES = Made(("o_orderkey AS doc", "CAST(CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice * CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1000 ELSE 0.001 END END AS DOUBLE) AS revenue"))
#: Each order with the next.
PAIRS = Made(("o_orderkey AS pair", "o_orderkey AS a", "o_orderkey + 1 AS b"))
_MULT = f"""long AS ({_LONG}), mult AS (SELECT doc, series, arg_min(m, (d, idx, m)) AS multiplier FROM (SELECT l.doc, l.series, idx, m, abs(ln(abs(value * m) / abs(target))) AS d FROM long l JOIN {TARGETS.sql} g USING (doc, series), (VALUES (1), (1000), (1000000)) AS s(m) WHERE value <> 0) GROUP BY ALL)"""


@query("E14_merge_periods", "SELECT doc, trim(period) AS period, min(idx) AS idx, " + ", ".join(f"arg_min({c}, idx) FILTER ({c} IS NOT NULL) AS {c}" for c in R.SERIES) + f", count(*) - 1 AS merged FROM {_T} WHERE trim(period) <> '' GROUP BY ALL")
def merge_periods(spark: SparkSession, sf: str) -> DataFrame:
    return R.merge_periods(TRENDS.df(spark, sf))


@query("E12_chunk_trends", f"SELECT doc, idx FROM (SELECT doc, idx, row_number() OVER (PARTITION BY doc, period ORDER BY chunk, idx) AS n FROM {_T}) WHERE n = 1")
def chunk_trends(spark: SparkSession, sf: str) -> DataFrame:
    return R.merge_chunks_trends(TRENDS.df(spark, sf)).select("doc", "idx")


@query("G41_sorted_trends", f"SELECT doc, idx, CAST(row_number() OVER (PARTITION BY doc ORDER BY {period_key_sql('period')}, idx) AS INTEGER) AS place FROM {_T}")
def sorted_trends(spark: SparkSession, sf: str) -> DataFrame:
    return R.sorted_trends(TRENDS.df(spark, sf)).select("doc", "idx", "place")


@query("F8_forward_fill", f"SELECT doc, idx, revenue FROM (SELECT doc, idx, last_value(revenue IGNORE NULLS) OVER (PARTITION BY doc ORDER BY idx ROWS UNBOUNDED PRECEDING) AS revenue FROM {_T}) WHERE revenue IS NOT NULL")
def forward_fill(spark: SparkSession, sf: str) -> DataFrame:
    return R.forward_fill(TRENDS.df(spark, sf), "revenue").select("doc", "idx", "revenue")


@query("F7_implausible", "SELECT doc, sum(" + " + ".join(f"CASE WHEN {c}_ <> 0 AND abs(({c} - {c}_) / abs({c}_) * 100) > 500 THEN 1 ELSE 0 END" for c in R.SERIES[:3]) + ") AS n FROM (SELECT *, " + ", ".join(f"lag({c}) OVER (PARTITION BY doc ORDER BY idx) AS {c}_" for c in R.SERIES[:3]) + f" FROM {_T}) GROUP BY doc")
def implausible(spark: SparkSession, sf: str) -> DataFrame:
    return R.implausible_changes(TRENDS.df(spark, sf))


@query("F6_series_change", f"SELECT doc, CASE WHEN b <> 0 THEN (a - b) / abs(b) * 100 END AS percent FROM (SELECT doc, max(revenue) FILTER (n = 1) AS a, max(revenue) FILTER (n = 2) AS b FROM (SELECT doc, revenue, row_number() OVER (PARTITION BY doc ORDER BY idx DESC) AS n FROM {_T} WHERE revenue IS NOT NULL) GROUP BY doc)")
def series_change(spark: SparkSession, sf: str) -> DataFrame:
    return R.series_change(TRENDS.df(spark, sf), "revenue")


@query("E8_series_multiplier", f"WITH {_MULT} SELECT * FROM mult")
def series_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    return R.series_multiplier(TRENDS.df(spark, sf), TARGETS.df(spark, sf))


@query("E7_G40_scaled_series", f"""WITH {_MULT}, common AS (SELECT doc, arg_max(multiplier, (n, multiplier)) AS common FROM (SELECT doc, multiplier, count(*) AS n FROM mult GROUP BY ALL) GROUP BY doc),
x AS (SELECT l.*, coalesce(m.multiplier, common) AS s, t.multiplier AS stated, max(abs(value)) OVER w >= 100000 AND min(CASE WHEN value <> 0 THEN abs(value) END) OVER w < 1000 AS mixed FROM long l LEFT JOIN mult m USING (doc, series) LEFT JOIN common USING (doc) LEFT JOIN {STATED.sql} t USING (doc) WINDOW w AS (PARTITION BY l.doc, l.series))
SELECT doc, idx, series, CASE WHEN s = 1000 AND mixed AND abs(value) > 0 AND abs(value) < 1000 THEN value * 1000000 WHEN s IS NOT NULL THEN value * s WHEN stated > 1 AND abs(value) < 1000000 THEN value * stated ELSE value END AS value FROM x""")
def scaled_series(spark: SparkSession, sf: str) -> DataFrame:
    return R.scaled_series(TRENDS.df(spark, sf), TARGETS.df(spark, sf), STATED.df(spark, sf)).select("doc", "idx", "series", "value")


@query("G51_fit_length", f"SELECT doc, n, CAST(len(v) AS INTEGER) AS had, array_to_string(list_transform(list_resize(v, n), lambda x: coalesce(CAST(CAST(floor(x) AS BIGINT) AS VARCHAR), '-')), ',') AS fitted FROM (SELECT doc, list(revenue ORDER BY idx) AS v, CAST(doc % 5 + 1 AS INTEGER) AS n FROM {_T} GROUP BY doc)")
def fit_length(spark: SparkSession, sf: str) -> DataFrame:
    g = TRENDS.df(spark, sf).groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "revenue"))), lambda x: x["revenue"]).alias("v")).withColumn("n", (F.col("doc") % 5 + 1).cast("int"))
    shown = F.transform(R.fit_length(F.col("v"), F.col("n")), lambda x: F.coalesce(F.floor(x).cast("string"), F.lit("-")))
    return g.select("doc", "n", F.size("v").alias("had"), F.array_join(shown, ",").alias("fitted"))


_CHART = lambda x: f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"
_AMOUNT = "TRY_CAST(CASE WHEN contains(value, '%') THEN NULL ELSE replace(trim(value), ',', '') END AS DOUBLE)"


@query("E11_merge_breakdown", f"SELECT doc, kind, min(ord) AS ord, arg_min(trim(name), ord) AS name, sum({_AMOUNT}) AS value, count(*) - 1 AS merged FROM {_B} WHERE trim(name) <> '' AND {_AMOUNT} IS NOT NULL GROUP BY doc, kind, {_CHART('trim(name)')}")
def merge_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    from ledgerline.functions.money import parse_amount

    return R.merge_breakdown(BREAKDOWN.df(spark, sf).withColumn("value", parse_amount(F.col("value"))))


@query("E12_chunk_breakdown", f"SELECT doc, kind, name, value FROM (SELECT doc, kind, {MARKS(SQUEEZE('name'))} AS name, value, row_number() OVER (PARTITION BY doc, kind, {MARKS(SQUEEZE('name'))} ORDER BY chunk, ord) AS n FROM {_B}) WHERE n = 1")
def chunk_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return R.chunk_breakdown(BREAKDOWN.df(spark, sf)).select("doc", "kind", "name", "value")


@query("G53_chartable", f"SELECT doc, kind, ord FROM {_B} WHERE doc IN (SELECT doc FROM {_B} GROUP BY doc, kind HAVING count(*) >= 2)")
def chartable(spark: SparkSession, sf: str) -> DataFrame:
    return R.chartable_breakdown(BREAKDOWN.df(spark, sf)).select("doc", "kind", "ord")


@query("E9_G42_segments", f"""WITH c AS (SELECT doc, kind, ord, name, {_AMOUNT} AS value FROM {_B} WHERE trim(name) <> '' AND {_AMOUNT} <> 0), k AS (SELECT *, max(kind = 'segment') OVER (PARTITION BY doc) AS has FROM c),
t AS (SELECT *, sum(abs(value)) OVER (PARTITION BY doc, kind) AS total, max(abs(value)) OVER (PARTITION BY doc, kind) AS top FROM k WHERE kind = 'segment' OR NOT has),
s AS (SELECT t.doc, kind, ord, name, value, total, revenue, x.multiplier, arg_min(m, (abs(ln(total * m / revenue)), m)) AS scale FROM t LEFT JOIN {REVENUES.sql} r USING (doc) LEFT JOIN {STATED.sql} x USING (doc), (VALUES (1), (1000), (1000000)) AS z(m) WHERE NOT (total BETWEEN 95 AND 105 AND top <= 100) GROUP BY ALL)
SELECT doc, kind, ord, name, value * CASE WHEN revenue IS NULL THEN coalesce(multiplier, 1) ELSE scale END AS value FROM s WHERE revenue IS NULL OR total * scale / revenue BETWEEN 0.2 AND 5""")
def segments(spark: SparkSession, sf: str) -> DataFrame:
    return R.breakdown_segments(BREAKDOWN.df(spark, sf), STATED.df(spark, sf), REVENUES.df(spark, sf))


_NAMED = f"""WITH n AS (SELECT doc, ord, trim(text) AS text, coalesce(nullif(trim(section), ''), 'other') AS g FROM {_N} WHERE trim(text) <> ''),
c AS (SELECT *, CASE g WHEN 'Financial Highlights' THEN 'executive_summary' WHEN 'executiveSummary' THEN 'executive_summary' WHEN 'outlook' THEN 'outlook' WHEN 'Segment-Results' THEN 'segment_performance' WHEN 'strategy' THEN 'strategic_priorities' ELSE 'other' END AS section, g IN ('Financial Highlights', 'Riskfactors', 'Segment-Results', 'strategy') AS renamed FROM n)"""


@query("E13_merge_narratives", f"""{_NAMED}
SELECT doc, section, min(ord) AS ord, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text, sum(renamed::INT) AS renamed FROM c GROUP BY doc, section""")
def merge_narratives(spark: SparkSession, sf: str) -> DataFrame:
    return R.merge_narratives(NARRATIVES.df(spark, sf))


@query("E12_chunk_narratives", "SELECT conv_id AS doc, role AS section, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id, role")
def chunk_narratives(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("chunk"), F.col("turn").alias("ord"), F.col("role").alias("section"), "text")
    return R.chunk_narratives(c)


@query("E12_chunk_metadata", "SELECT conv_id AS doc, arg_min(CASE WHEN role = 'user' THEN text ELSE '' END, (CASE WHEN role = 'user' AND length(text) > 0 THEN 0 ELSE 1 END, turn)) AS company, arg_min(role, (CASE WHEN role = 'user' AND length(text) > 0 THEN 0 ELSE 1 END, turn)) AS period FROM conversations GROUP BY conv_id")
def chunk_metadata(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("chunk"), F.when(F.col("role") == "user", F.col("text")).otherwise("").alias("company"), F.col("role").alias("period"))
    return R.chunk_metadata(c)


@query("E12_chunk_risks", "SELECT doc, array_to_string(list(role ORDER BY t), ',') AS risks FROM (SELECT conv_id AS doc, role, min(turn) AS t FROM conversations GROUP BY ALL) GROUP BY doc")
def chunk_risks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("chunk"), F.col("turn").alias("ord"), F.col("role").alias("risk"))
    return R.chunk_risks(c).select("doc", F.array_join("risks", ",").alias("risks"))


_WILD = " + ".join(f"sum(CASE WHEN {c}_ <> 0 AND abs(({c} - {c}_) / abs({c}_) * 100) > 500 THEN 1 ELSE 0 END)" for c in R.SERIES[:3])
_EMPTY = " + ".join(f"(count({c}) = 0)::INT" for c in R.SERIES)


@query("J6q_sanitizer", f"""{_NAMED}, nar AS (SELECT doc, count(DISTINCT g) FILTER (renamed) AS renamed_sections, bool_or(section = 'executive_summary') AS told FROM c GROUP BY doc),
first AS (SELECT doc, lower(trim(label)) AS l, count(*) AS k, arg_min(value IS NULL AND coalesce(unit, '') = '', ord) AS bare FROM {METRICS.sql} GROUP BY ALL), met AS (SELECT doc, sum(k - 1) AS duplicate_labels, count(*) FILTER (bare) AS dropped_metrics FROM first GROUP BY doc),
parts AS ({SQL["E11_merge_breakdown"]}), kinds AS (SELECT doc, kind, count(*) AS n, sum(merged) AS m FROM parts GROUP BY ALL), brk AS (SELECT doc, max(n) AS n, sum(m) AS merged_parts FROM kinds GROUP BY doc),
mer AS ({SQL["E14_merge_periods"]}), lags AS (SELECT *, {", ".join(f"lag({c}) OVER (PARTITION BY doc ORDER BY idx) AS {c}_" for c in R.SERIES[:3])} FROM mer), tre AS (SELECT doc, count(*) AS n, sum(merged) AS merged_periods, {_EMPTY} AS empty, {_WILD} AS wild FROM lags GROUP BY doc)
SELECT f.doc, CAST(coalesce(duplicate_labels, 0) AS BIGINT) AS duplicate_labels, coalesce(dropped_metrics, 0) AS dropped_metrics, coalesce(renamed_sections, 0) AS renamed_sections, CAST(coalesce(merged_parts, 0) AS BIGINT) AS merged_parts, CAST(coalesce(merged_periods, 0) AS BIGINT) AS merged_periods,
 CAST(CASE WHEN tre.n >= 2 AND empty < 4 THEN empty ELSE 0 END AS BIGINT) AS empty_series, CAST(CASE WHEN tre.n >= 2 AND empty < 4 THEN wild ELSE 0 END AS BIGINT) AS implausible_changes, NOT coalesce(told, false) AS missing_summary,
 f.doc IN (SELECT doc FROM {_B}) AND coalesce(brk.n, 0) < 2 AS breakdown_dropped, f.doc IN (SELECT doc FROM {_T}) AND NOT coalesce(tre.n >= 2 AND empty < 4, false) AS trends_dropped
FROM {FILED.sql} f LEFT JOIN met USING (doc) LEFT JOIN nar USING (doc) LEFT JOIN brk USING (doc) LEFT JOIN tre USING (doc)""")
def sanitizer(spark: SparkSession, sf: str) -> DataFrame:
    return Z.sanitize(FILED.df(spark, sf), METRICS.df(spark, sf), TRENDS.df(spark, sf), BREAKDOWN.df(spark, sf), NARRATIVES.df(spark, sf))


_KEYED = f"SELECT doc, ord, label, value, coalesce('canonical:' || ({canonical_sql('label')}), 'label:' || trim(regexp_replace(lower(label), '\\s+', ' ', 'g'))) AS key FROM {METRICS.sql}"
_PAIRED = f"""WITH k AS ({_KEYED}), p AS (SELECT * FROM {PAIRS.sql}), s AS (SELECT pair, 'a' AS side, k.* FROM p JOIN k ON k.doc = p.a UNION ALL SELECT pair, 'b', k.* FROM p JOIN k ON k.doc = p.b),
g AS (SELECT pair, key, min((side, ord)) AS first_place, arg_max_null(value, ord) FILTER (side = 'a') AS a, arg_max_null(value, ord) FILTER (side = 'b') AS b FROM s GROUP BY ALL) """


def _plain_metrics(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None)
    return METRICS.df(spark, sf).withColumn("canonical_id", none.cast("string")).withColumn("original_label", none.cast("string")).withColumn("normalized_value", none.cast("double"))


@query("C9_pair_metrics", _PAIRED + "SELECT pair, key, a, b, row_number() OVER (PARTITION BY pair ORDER BY first_place) AS place FROM g")
def pair_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return C.pair_metrics(PAIRS.df(spark, sf), _plain_metrics(spark, sf)).select("pair", "key", "a", "b", F.col("place").cast("long").alias("place"))


@query("E21_tally", f"WITH {FILINGS_SQL}, p AS (SELECT a.id AS pair, a.revenue AS ra, b.revenue AS rb, a.net_profit AS na, b.net_profit AS nb FROM filings a JOIN filings b ON b.company_id = a.company_id + 1 AND b.report_type = a.report_type AND b.fiscal_year = a.fiscal_year) SELECT pair, 2 * (ra > rb)::INT + (na > nb)::INT AS score_a, 2 * (rb > ra)::INT + (nb > na)::INT AS score_b, 3 AS total FROM p")
def tally(spark: SparkSession, sf: str) -> DataFrame:
    """Each report against the next company's of the same year and kind."""
    f = materialize(filings(spark, sf), "filings")
    other = f.select(F.col("id").alias("b"), (F.col("company_id") - 1).alias("company_id"), "fiscal_year", "report_type")
    pairs = f.select(F.col("id").alias("pair"), F.col("id").alias("a"), "company_id", "fiscal_year", "report_type").join(other, ["company_id", "fiscal_year", "report_type"]).select("pair", "a", "b")
    rows = f.select(F.col("id").alias("doc"), F.expr("stack(2, 0, 'Revenue', revenue, 1, 'Net profit', net_profit) as (ord, label, value)"))
    none = F.lit(None)
    rows = rows.withColumn("canonical_id", none.cast("string")).withColumn("original_label", none.cast("string")).withColumn("normalized_value", none.cast("double"))
    return C.tally(C.pair_metrics(pairs, rows))


@query("C11_align", f"""WITH {FILINGS_SQL}, q AS (SELECT company_id AS doc, CAST(substr(report_type, 2) AS INTEGER) AS idx, CAST(fiscal_year AS VARCHAR) AS period, revenue FROM filings WHERE report_type <> 'annual'),
p AS (SELECT s_suppkey AS pair, s_suppkey AS a, s_suppkey + 1 AS b FROM supplier), r AS (SELECT pair, 'a' AS side, q.* FROM p JOIN q ON q.doc = p.a UNION ALL SELECT pair, 'b', q.* FROM p JOIN q ON q.doc = p.b)
SELECT pair, period, arg_max(revenue, idx) FILTER (side = 'a') AS a, arg_max(revenue, idx) FILTER (side = 'b') AS b FROM r GROUP BY pair, period""")
def align(spark: SparkSession, sf: str) -> DataFrame:
    f = filings(spark, sf).where("report_type <> 'annual'")
    trends = f.select(F.col("company_id").alias("doc"), F.substring("report_type", 2, 1).try_cast("int").alias("idx"), F.col("fiscal_year").cast("string").alias("period"), "revenue")
    pairs = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("pair"), F.col("s_suppkey").alias("a"), (F.col("s_suppkey") + 1).alias("b"))
    return C.align(pairs, trends, "revenue").select("pair", "period", "a", "b")
