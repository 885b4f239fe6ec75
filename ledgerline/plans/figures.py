"""Queries on metrics: what they are, in which scale, and what they come to."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import labels as L
from ledgerline.functions import money as M
from ledgerline.functions import periods as P
from ledgerline.operators import metrics as O
from ledgerline.plans.inputs import METRICS, PERIODS, table
from ledgerline.plans.registry import query, re2
from ledgerline.plans.texts import COMPACT, MARKS, SQUEEZE

_M = METRICS.sql
_fits = lambda x, p: f"regexp_matches({x}, {re2(p)})"


def canonical_sql(label: str) -> str:
    x = COMPACT(label)
    simple = (("eps", L.EPS), ("dividends", L.DIVIDENDS), ("capex", L.CAPEX), ("free_cash_flow", L.FREE_CASH_FLOW), ("operating_cash_flow", L.OPERATING_CASH_FLOW), ("ebitda", L.EBITDA))
    later = (("total_assets", L.TOTAL_ASSETS), ("liabilities", L.LIABILITIES), ("equity", L.EQUITY))
    case = " ".join(f"WHEN {_fits(x, p)} THEN '{n}'" for n, p in simple)
    case += f" WHEN {_fits(x, L.NET_PROFIT)} AND NOT {_fits(x, L.NOT_NET_PROFIT)} THEN 'net_profit' " + " ".join(f"WHEN {_fits(x, p)} THEN '{n}'" for n, p in later)
    return f"CASE WHEN {x} = '' THEN NULL {case} WHEN NOT {_fits(x, L.NOT_REVENUE)} AND {_fits(x, L.REVENUE)} THEN 'revenue' END"


_RATIO = lambda x: f"coalesce(regexp_matches(lower({x}), '\\beps\\b|per share|\\bemployees?\\b|%|\\bmargin\\b|\\bratio\\b|\\byield\\b'), false)"
_SUM = lambda x: f"coalesce(regexp_matches(lower({x}), '{L.AGGREGATE}'), false)"
_U = "lower(trim(coalesce(unit, '')))"
_T = f"regexp_replace({_U}, '\\s+', '', 'g')"
UNIT = f"CASE WHEN {_U} = '' THEN 1 WHEN regexp_matches({_U}, 'bn|billion|miljards?') THEN 1000000000 WHEN regexp_matches({_T}, '\\beurm\\b|million|mln|milj|\\bmn\\b') OR (regexp_matches({_T}, '\\bm\\b') AND regexp_matches({_T}, 'eur|€|usd|\\$') AND NOT regexp_matches({_T}, 'thousand|k\\b')) THEN 1000000 WHEN regexp_matches({_U}, {re2(M.UNIT_THOUSAND)}) THEN 1000 ELSE 1 END"
_E = "lower(concat_ws(' ', nullif(snippet, ''), nullif(rationale, '')))"
EVIDENCE = f"CASE WHEN regexp_matches({_E}, 'bn|billion|miljards?') THEN 1000000000 WHEN regexp_matches({_E}, {re2(M.TEXT_MILLION)}) THEN 1000000 WHEN regexp_matches({_E}, {re2(M.TEXT_THOUSAND)}) THEN 1000 ELSE 1 END"
def scaled_sql(rows: str) -> str:
    """CTEs up to scaled: metrics with what normalization needs, and their value in whole euro."""
    return f"""m AS (SELECT *, {UNIT} AS u, {EVIDENCE} AS e, {_RATIO('label')} AS ratio, {_SUM('label')} AND value IS NOT NULL AS summed, {canonical_sql('label')} AS id, regexp_replace({_U}, '\\s+', '', 'g') IN ('', 'eur', '€', 'euro') AS plain FROM {rows}),
agreed AS (SELECT doc, arg_max(e, (n, e)) AS w FROM (SELECT doc, e, count(*) AS n FROM m WHERE e > 1 GROUP BY ALL HAVING count(*) >= 2) GROUP BY doc),
whole AS (SELECT doc, count(*) FILTER (summed) AS sums, max(abs(value)) FILTER (summed) AS top, bool_or(abs(value) <> floor(abs(value))) FILTER (summed) AS broken, bool_or(greatest(u, e) = 1000000) AS million FROM m GROUP BY doc),
scaled AS (SELECT m.*, CASE WHEN value IS NULL OR ratio THEN value WHEN u <> 1 AND value <> 0 THEN value * u WHEN NOT plain OR NOT summed OR abs(value) >= 1000000 THEN value WHEN e > 1 THEN value * e WHEN w > 1 THEN value * w
 WHEN sums >= 3 AND top < 10000 AND (broken OR million) THEN value * 1000000 ELSE value END AS euro FROM m LEFT JOIN agreed USING (doc) LEFT JOIN whole USING (doc))"""


SCALED = scaled_sql(_M)


@query("G2_canonical_id", f"SELECT doc, ord, {canonical_sql('label')} AS metric_id FROM {_M}")
def canonical(spark: SparkSession, sf: str) -> DataFrame:
    return METRICS.df(spark, sf).select("doc", "ord", L.canonical_id(F.col("label")).alias("metric_id"))


@query("G28_G29_multipliers", f"SELECT doc, ord, {UNIT} AS by_unit, {EVIDENCE} AS by_evidence FROM {_M}")
def multipliers(spark: SparkSession, sf: str) -> DataFrame:
    return METRICS.df(spark, sf).select("doc", "ord", M.unit_multiplier(F.col("unit")).alias("by_unit"), M.evidence_multiplier(F.col("snippet"), F.col("rationale")).alias("by_evidence"))


@query("G30_label_kinds", f"SELECT doc, ord, {_RATIO('label')} AS ratio, {_SUM('label')} AS summed FROM {_M}")
def label_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return METRICS.df(spark, sf).select("doc", "ord", L.is_per_share_or_ratio(F.col("label")).alias("ratio"), L.is_aggregate(F.col("label")).alias("summed"))


@query("G31_by_unit", f"SELECT doc, ord, CASE WHEN {_RATIO('label')} THEN value ELSE value * {UNIT} END AS euro FROM {_M}")
def by_unit(spark: SparkSession, sf: str) -> DataFrame:
    return METRICS.df(spark, sf).select("doc", "ord", M.by_unit(F.col("value"), F.col("unit"), F.col("label")).alias("euro"))


@query("G32_G35_canonicalize", f"WITH {SCALED} SELECT doc, ord, id AS canonical_id, euro AS normalized_value, CASE WHEN value IS NULL THEN NULL WHEN id = 'eps' OR ratio THEN unit WHEN id IS NOT NULL AND {_SUM('label')} THEN 'EUR' ELSE unit END AS normalized_unit FROM scaled")
def canonicalize(spark: SparkSession, sf: str) -> DataFrame:
    return O.canonicalize(METRICS.df(spark, sf)).select("doc", "ord", "canonical_id", "normalized_value", "normalized_unit")


@query("E6_modal_multiplier", f"SELECT doc, arg_max(s, (n, s)) AS multiplier FROM (SELECT doc, greatest({UNIT}, {EVIDENCE}) AS s, count(*) AS n FROM {_M} GROUP BY ALL) WHERE s > 1 AND n >= 2 GROUP BY doc")
def modal_multiplier(spark: SparkSession, sf: str) -> DataFrame:
    return O.stated_scales(METRICS.df(spark, sf))


_OWN = f"CASE WHEN {_RATIO('label')} THEN value ELSE value * {UNIT} END"


@query("G34_filing_scale", f"WITH x AS (SELECT *, greatest({UNIT}, {EVIDENCE}) AS s, {_OWN} AS own FROM {_M}), w AS (SELECT doc, arg_max(s, (n, s)) AS multiplier FROM (SELECT doc, s, count(*) AS n FROM x GROUP BY ALL) WHERE s > 1 AND n >= 2 GROUP BY doc) SELECT doc, ord, CASE WHEN multiplier > 1 AND {_T} IN ('', 'eur', '€', 'euro') AND {_SUM('label')} AND abs(own) = abs(value) AND abs(value) < 1000000 THEN value * multiplier ELSE own END AS value FROM x LEFT JOIN w USING (doc)")
def filing_scale(spark: SparkSession, sf: str) -> DataFrame:
    return O.filing_scaled(METRICS.df(spark, sf))


_LOW = "lower(trim(label))"
_SAYS = {
    "revenue": f"NOT regexp_matches({_LOW}, 'palūkan|palukan|komisini|commission|interest income|fee income') AND (regexp_matches({_LOW}, '^(total\\s+)?(revenue|sales|turnover|pajamos|käive|kaive)$|^ie[nņ]ēmumi$|^ie[nņ]mumi$') OR (regexp_matches({_LOW}, '\\brevenue\\b') AND NOT regexp_matches({_LOW}, 'interest|commission')) OR regexp_matches({_LOW}, '\\bpajamos\\b'))",
    "ebitda": f"regexp_matches({_LOW}, '\\bebitda\\b')",
    "net_profit": f"NOT (regexp_matches({_LOW}, 'operating|veiklos|darbības|tegevus') AND regexp_matches({_LOW}, 'profit|pelnas|peļņa|kasum')) AND regexp_matches({_LOW}, '\\bnet profit\\b|\\bnet income\\b|\\bnet earnings\\b|\\bgrynasis pelnas\\b|\\bneto peļņa|\\bpuhas kasum\\b|\\bpuhaskasum\\b|^grynasis pelnas')",
    "fcf": f"regexp_matches({_LOW}, '\\bfree cash flow\\b|\\bfcf\\b|\\blaisvasis pinigų srautas\\b')",
}
_EXCLUDED = f"regexp_matches(lower(label), {re2(L.EXCLUDED)})"


@query("G37_G38_label_tests", f"SELECT doc, ord, {_EXCLUDED} AS excluded, {', '.join(f'({s}) AS {n}' for n, s in _SAYS.items())} FROM {_M}")
def label_tests(spark: SparkSession, sf: str) -> DataFrame:
    return METRICS.df(spark, sf).select("doc", "ord", L.is_excluded(F.col("label")).alias("excluded"), *(test(F.col("label")).alias(n) for n, (_, test, _) in L.HEADLINES.items()))


_IDS = {"revenue": "revenue", "ebitda": "ebitda", "net_profit": "net_profit", "fcf": "free_cash_flow"}
_PICK = ", ".join(f"arg_min(euro, (CASE WHEN id = '{i}' THEN 0 ELSE 1 END, ord)) FILTER (id = '{i}' OR ({_SAYS[n]})) AS {n}" for n, i in _IDS.items())


@query("F12_G39_preview", f"WITH {SCALED} SELECT doc, {_PICK} FROM scaled WHERE value IS NOT NULL AND NOT {_EXCLUDED} GROUP BY doc")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return O.preview(O.canonicalize(METRICS.df(spark, sf), O.headline_facts()))


_KEY = MARKS(SQUEEZE("label"))
_WORDS = lambda x: f"list_distinct(regexp_split_to_array(lower({x}), '\\s+'))"
_NEAR = lambda a, b: f"(levenshtein({a}, {b}) <= 3 OR len(list_intersect({_WORDS(a)}, {_WORDS(b)})) / len(list_distinct(list_concat({_WORDS(a)}, {_WORDS(b)}))) >= 0.85)"


# labels are few, so their distances are worked out once for each pair of labels, not of rows
_LABELS = f"x AS MATERIALIZED (SELECT doc, ord, {_KEY} AS key FROM {_M}), k AS MATERIALIZED (SELECT DISTINCT key FROM x), near AS MATERIALIZED (SELECT a.key AS ka, b.key AS kb FROM k a, k b WHERE {_NEAR('a.key', 'b.key')})"


@query("C12_near_pairs", f"WITH {_LABELS} SELECT a.doc, a.ord AS i, b.ord AS j FROM x a JOIN x b ON a.doc = b.doc AND a.ord < b.ord JOIN near ON ka = a.key AND kb = b.key")
def near_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return O.near_pairs(METRICS.df(spark, sf))


@query(
    "C12_dedup",
    f"""WITH RECURSIVE x AS (SELECT doc, ord, {_KEY} AS key, length(coalesce(period, '')) AS plen, count(*) OVER (PARTITION BY doc) AS n FROM {_M}),
pairs AS (SELECT a.doc, a.ord AS i, b.ord AS j FROM x a JOIN x b ON a.doc = b.doc AND a.ord < b.ord WHERE {_NEAR('a.key', 'b.key')}),
walk AS (SELECT DISTINCT doc, -1 AS ord, CAST([] AS INTEGER[]) AS heads, -1 AS head FROM x
 UNION ALL SELECT w.doc, x.ord, CASE WHEN h.head IS NULL THEN list_append(w.heads, x.ord) ELSE w.heads END, coalesce(h.head, x.ord) FROM walk w JOIN x ON x.doc = w.doc AND x.ord = w.ord + 1
 LEFT JOIN LATERAL (SELECT min(p.i) AS head FROM pairs p WHERE p.doc = w.doc AND p.j = w.ord + 1 AND list_contains(w.heads, p.i)) h ON true)
SELECT doc, ord FROM (SELECT w.doc, w.ord, row_number() OVER (PARTITION BY w.doc, w.head ORDER BY x.plen DESC, w.ord) AS k FROM walk w JOIN x USING (doc, ord)) WHERE k = 1""",
)
def dedup(spark: SparkSession, sf: str) -> DataFrame:
    return O.dedup(METRICS.df(spark, sf).select("doc", "ord", "label", "period")).select("doc", "ord")


@query("F9_first_per_label", f"SELECT doc, min(ord) AS ord FROM {_M} GROUP BY doc, lower(trim(label))")
def first_per_label(spark: SparkSession, sf: str) -> DataFrame:
    return O.first_per_label(METRICS.df(spark, sf)).select("doc", "ord")


@query("F9_first_part_per_name", "SELECT min(p_partkey) AS ord, p_brand AS doc FROM part GROUP BY p_brand, lower(trim(p_name))")
def first_part_per_name(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("label"))
    return O.first_per_label(parts).select("ord", "doc")


@query("G54_drop_empty", f"SELECT doc, ord FROM {_M} WHERE value IS NOT NULL OR length(coalesce(unit, '')) > 0")
def drop_empty(spark: SparkSession, sf: str) -> DataFrame:
    return O.drop_empty(METRICS.df(spark, sf)).select("doc", "ord")


@query(
    "E23_derive_fcf",
    f"""WITH m AS (SELECT *, {canonical_sql('label')} AS id, coalesce(nullif(trim(period), ''), '-') AS p FROM {_M}),
b AS (SELECT doc, p, min(ord) FILTER (id = 'operating_cash_flow' AND value IS NOT NULL) AS o, min(ord) FILTER (id = 'capex' AND value IS NOT NULL) AS c, min(ord) FILTER (id = 'free_cash_flow') AS f FROM m GROUP BY ALL),
n AS (SELECT b.doc, b.o, f.ord AS f, o.value - abs(c.value) AS value FROM b JOIN m o ON o.doc = b.doc AND o.ord = b.o JOIN m c ON c.doc = b.doc AND c.ord = b.c LEFT JOIN m f ON f.doc = b.doc AND f.ord = b.f WHERE lower(trim(coalesce(o.unit, ''))) = lower(trim(coalesce(c.unit, ''))) AND coalesce(f.confidence, 0) < 0.7)
SELECT doc, ord, label, value FROM m WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc = m.doc AND n.f = m.ord) UNION ALL SELECT doc, CAST(1000000 + o AS INTEGER), 'Free cash flow', value FROM n""",
)
def derive_fcf(spark: SparkSession, sf: str) -> DataFrame:
    return O.derive_fcf(METRICS.df(spark, sf)).select("doc", "ord", "label", "value")


@query("F13_key_metrics", f"""WITH m AS (SELECT *, {canonical_sql('label')} AS id, lower(label) AS low FROM {_M} WHERE value IS NOT NULL),
r AS (SELECT *, CASE WHEN id = 'revenue' THEN 0 WHEN id = 'ebitda' THEN 1 WHEN id = 'net_profit' THEN 2 WHEN id = 'free_cash_flow' THEN 3 WHEN contains(low, 'revenue') THEN 4 WHEN contains(low, 'ebitda') THEN 5 WHEN contains(low, 'net profit') THEN 6 WHEN contains(low, 'cash flow') THEN 7 ELSE 10 END AS rank FROM m),
u AS (SELECT *, row_number() OVER (PARTITION BY doc, lower(trim(label)) ORDER BY rank, ord) AS k FROM r)
SELECT doc, ord, CAST(place AS INTEGER) AS place FROM (SELECT doc, ord, row_number() OVER (PARTITION BY doc ORDER BY rank, ord) AS place FROM u WHERE k = 1) WHERE place <= 4""")
def key_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return O.key_metrics(METRICS.df(spark, sf)).select("doc", "ord", "place")


def _parse_sql() -> str:
    s = "trim(s)"
    x = lambda p, g: f"nullif(regexp_extract({s}, '{p}', {g}), '')"
    d = r"^(\d{4})-(\d{2})-(\d{2})$"
    year = [x(r"(?i)^Q([1-4])\s*(\d{4})$", 2), f"CASE WHEN {x(r'(?i)^Q([1-4])$', 1)} IS NOT NULL THEN '2025' END", x(r"(?i)^FY\s*(\d{4})$", 1), x(r"(?i)^(\d{4})\s*(annual|report)", 1), x(r"(?i)^H([12])\s*(\d{4})$", 2), x(r"(?i)^(\d{1,2})M\s*(\d{4})$", 2), x(d, 1), x(r"^(\d{4})$", 1)]
    q, m = x(r"(?i)^Q([1-4])", 1), x(r"(?i)^(\d{1,2})M\s*(\d{4})$", 1)
    kind = f"CASE WHEN {year[0]} IS NOT NULL OR {year[1]} IS NOT NULL THEN 'q' || {q} WHEN {year[2]} IS NOT NULL OR {year[3]} IS NOT NULL OR {year[7]} IS NOT NULL THEN 'annual' WHEN {year[4]} IS NOT NULL THEN 'semi-annual' WHEN {m} IS NOT NULL THEN CASE CAST({m} AS INTEGER) WHEN 3 THEN 'q1' WHEN 6 THEN 'semi-annual' WHEN 9 THEN 'q3' ELSE 'other' END WHEN {year[6]} IS NOT NULL THEN CASE substr({s}, 6) WHEN '12-31' THEN 'annual' WHEN '03-31' THEN 'q1' WHEN '06-30' THEN 'q2' WHEN '09-30' THEN 'q3' ELSE 'other' END END"
    return f"SELECT doc, s, CAST(coalesce({', '.join(year)}) AS INTEGER) AS fiscal_year, {kind} AS report_type FROM {PERIODS.sql}"


@query("G24_parse_period", _parse_sql())
def parse_period(spark: SparkSession, sf: str) -> DataFrame:
    p = PERIODS.df(spark, sf).withColumn("p", P.parse_period(F.col("s"), 2025))
    return p.select("doc", "s", "p.fiscal_year", "p.report_type")


def period_key_sql(s: str) -> str:
    year = rf"CAST(nullif(regexp_extract(trim({s}), '\b(\d{{4}})\b', 1), '') AS BIGINT)"
    quarter = rf"CAST(coalesce(nullif(regexp_extract(trim({s}), '(?i)\bQ([1-4])\s*(\d{{4}})\b', 1), ''), nullif(regexp_extract(trim({s}), '(?i)\b(\d{{4}})(?:-\d{{4}})?\s*Q([1-4])\b', 2), '')) AS BIGINT)"
    month = rf"CAST(nullif(regexp_extract(trim({s}), '\b(\d{{4}})-(\d{{2}})(?:-\d{{2}})?\b', 2), '') AS BIGINT)"
    return rf"CASE WHEN {year} IS NULL THEN {P.NO_YEAR} WHEN {quarter} IS NOT NULL THEN {year} * 100 + {quarter} * 10 WHEN {month} IS NOT NULL THEN {year} * 100 + 10 * CASE WHEN {month} <= 3 THEN 1 WHEN {month} <= 6 THEN 2 WHEN {month} <= 9 THEN 3 ELSE 4 END WHEN regexp_matches({s}, '(?i)\b(H1|1H|6M|half[-\s]?year|semi[-\s]?annual)\b') THEN {year} * 100 + 25 WHEN regexp_matches({s}, '(?i)\b(H2|2H|II\s+poolaasta|second\s+half)\b') THEN {year} * 100 + 50 WHEN regexp_matches({s}, '(?i)\b(9M|nine\s+months|9\s+months)\b') THEN {year} * 100 + 35 ELSE {year} * 100 + 99 END"


@query("G25_period_keys", f"SELECT doc, s, {period_key_sql('s')} AS key FROM {PERIODS.sql}")
def period_keys(spark: SparkSession, sf: str) -> DataFrame:
    return PERIODS.df(spark, sf).select("doc", "s", P.period_key(F.col("s")).alias("key"))


@query("G27_first_year", rf"SELECT doc, s, nullif(regexp_extract(s, '\b(20\d{{2}}|19\d{{2}})\b', 1), '') AS year FROM {PERIODS.sql}")
def first_year(spark: SparkSession, sf: str) -> DataFrame:
    return PERIODS.df(spark, sf).select("doc", "s", P.first_year(F.col("s")).alias("year"))


@query("G43_deltas", "SELECT l_orderkey, l_linenumber, l_tax - l_discount AS absolute, CASE WHEN l_discount <> 0 THEN (l_tax - l_discount) / abs(l_discount) * 100 END AS percent, CASE WHEN l_tax <> l_discount THEN l_tax < l_discount END AS favorable FROM lineitem")
def deltas(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", M.delta(F.col("l_discount"), F.col("l_tax"), F.lit(False)).alias("d")).select("l_orderkey", "l_linenumber", "d.*")


@query("G46_clamped_confidence", "SELECT event_id, least(1.0, greatest(0.0, value / 100)) AS confidence FROM events")
def clamped(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", M.clamp(F.col("value") / 100, 0.0, 1.0).alias("confidence"))
