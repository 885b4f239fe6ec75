"""Queries on whole filings (plans/snapshots.py), on their companies, reviews and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import money as M
from ledgerline.functions import text as X
from ledgerline.functions.labels import METRIC_NAMES
from ledgerline.operators import compare as C
from ledgerline.operators import reviews as R
from ledgerline.operators import snapshots as S
from ledgerline.operators import tables as T
from ledgerline.operators.completion import decide, previews
from ledgerline.operators.matching import LEGAL_FORMS, best_companies, match_companies, mismatches
from ledgerline.plans.figures import _EXCLUDED, _IDS, _SAYS, canonical_sql, scaled_sql
from ledgerline.plans.inputs import FILINGS_SQL, filings, table
from ledgerline.plans.registry import query
from ledgerline.plans.snapshots import MARKED, SNAP_SQL, catalogue, said_names, snapshots
from ledgerline.plans.texts import MARKS, NAME, TOKENS, canonical_section_sql

# --- names ------------------------------------------------------------------------------------------------------------

_RAW = lambda x: TOKENS(x).replace(f" AND t NOT IN ({', '.join(map(repr, LEGAL_FORMS))})", "")
assert _RAW("x") != TOKENS("x")


def _osa(a: str, b: str) -> str:
    """Edits and swaps of neighbours between two texts, row by row of the usual table; rows are lists, the row before the last one is kept."""
    swap = f"CASE WHEN x[1][1] > 1 AND y[1] > 1 AND {a}[x[1][1]] = {b}[y[1] - 1] AND {a}[x[1][1] - 1] = {b}[y[1]] THEN s[1][y[1] - 1] + 1 ELSE 1000000 END"
    cell = f"least(s[2][y[1] + 1] + 1, r[y[1]] + 1, s[2][y[1]] + ({a}[x[1][1]] <> {b}[y[1]])::INT, {swap})"
    row = f"list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [j]), lambda r, y: list_append(r, {cell}), [x[1][1]])"
    return f"list_reduce(list_transform(range(1, length({a}) + 1), lambda i: [[i]]), lambda s, x: [s[2], {row}], [[0], range(0, length({b}) + 1)])[2][length({b}) + 1]"


def scored_sql(pairs: str, audit: bool) -> str:
    """CTEs up to scored: pairs (doc, id, ord, name, own, ticker) with their confidence.

    DuckDB's own distances count bytes, so marked letters become digits first;
    only pairs whose bounds leave the score open get the exact distance.
    """
    of = lambda x: TOKENS(MARKS(x)) if audit else TOKENS(x)
    plain = lambda x: f"translate(array_to_string({x}, ' '), '{MARKED}', '{'0123456789'[: len(MARKED)]}')"
    return f"""tokens AS (SELECT *, {of('name')} AS x, {of('own')} AS y, {_RAW('name')} AS raw FROM {pairs}), joined AS (SELECT *, {plain('x')} AS a, {plain('y')} AS b,
 greatest(len(list_intersect(x, y)) / greatest(1, len(list_distinct(list_concat(x, y)))), CASE WHEN list_contains(raw, lower(ticker)) THEN 1.0 ELSE 0.0 END) AS words FROM tokens WHERE len(x) > 0 AND ({'len(y) > 0' if audit else 'true'})),
bounded AS (SELECT *, greatest(length(a), length(b)) AS longest, levenshtein(a, b) AS far, damerau_levenshtein(a, b) AS near FROM joined),
open AS (SELECT * FROM (SELECT *, max(greatest(words, 1 - far / longest)) OVER (PARTITION BY doc) AS sure FROM bounded) WHERE greatest(words, 1 - near / longest) >= sure),
scored AS (SELECT doc, id, ord, greatest(words, 1 - CASE WHEN far = near THEN far ELSE {_osa('a', 'b')} END / longest) AS confidence FROM open)"""


_EVERY = "(SELECT n.name AS doc, n.name, c.id, c.ord, c.name AS own, c.ticker FROM names n, catalogue c)"
_NAMES = "names AS (SELECT DISTINCT trim(snapshot.company_name) AS name FROM snap WHERE trim(snapshot.company_name) <> '')"
_BEST = "SELECT doc AS name, id AS company_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY confidence DESC, ord) AS k FROM scored) WHERE k = 1"


def _said(spark: SparkSession, sf: str) -> DataFrame:
    names = said_names(spark, sf).select(F.trim("said").alias("name")).where("name <> ''").distinct()
    return names.select(F.col("name").alias("doc"), "name")


@query("C5_match_companies", f"WITH {SNAP_SQL}, {_NAMES}, {scored_sql(_EVERY, False)} SELECT name, company_id, round(confidence, 9) AS confidence FROM ({_BEST}) WHERE confidence >= 0.85")
def match(spark: SparkSession, sf: str) -> DataFrame:
    """The company of every extracted name that fits one, out of all suppliers."""
    return match_companies(_said(spark, sf), catalogue(spark, sf)).select("name", "company_id", F.round("confidence", 9).alias("confidence"))


@query("C6_suggestions", f"WITH {SNAP_SQL}, {_NAMES}, {scored_sql(_EVERY, True)} SELECT name, company_id, round(confidence, 9) AS confidence FROM ({_BEST}) WHERE confidence > 0")
def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """The best company of every extracted name, however little it fits."""
    return best_companies(_said(spark, sf), catalogue(spark, sf)).select("name", "company_id", F.round("confidence", 9).alias("confidence"))


def _filed(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots(spark, sf).select("id", F.col("filed_under").alias("company_id"), "snapshot")


#: CTEs up to wrong (id, reason, suggested_company_id).
_WRONG = f"""{SNAP_SQL}, {_NAMES}, judged AS (SELECT id, filed_under, trim(snapshot.company_name) AS said FROM snap WHERE filed_under IS NOT NULL AND trim(snapshot.company_name) <> ''),
own AS (WITH {scored_sql("(SELECT j.id AS doc, j.said AS name, c.id, c.ord, c.name AS own, c.ticker FROM judged j JOIN catalogue c ON c.id = j.filed_under)", True)} SELECT doc, confidence FROM scored),
all_best AS (WITH {scored_sql(_EVERY, True)} {_BEST}),
wrong AS (SELECT j.id, 'not_in_catalogue' AS reason, NULL AS suggested_company_id FROM judged j WHERE filed_under NOT IN (SELECT id FROM catalogue)
 UNION ALL SELECT j.id, 'unlike_catalogue', CASE WHEN b.confidence >= 0.85 THEN b.company_id END FROM judged j JOIN catalogue c ON c.id = j.filed_under LEFT JOIN own ON own.doc = j.id LEFT JOIN all_best b ON b.name = j.said WHERE coalesce(own.confidence, 0) < 0.85 AND len({TOKENS(MARKS('said'))}) > 0)"""


@query("J4q_mismatches", f"WITH {_WRONG} SELECT id, reason, suggested_company_id FROM wrong")
def company_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    return mismatches(said_names(spark, sf).withColumnRenamed("said", "extracted"), catalogue(spark, sf))


# --- audits -----------------------------------------------------------------------------------------------------------

_SERIES = S.SERIES
_T, _B, _M, _N = "snapshot.trends", "snapshot.breakdown", "snapshot.metrics", "snapshot.narratives"
_LEN = lambda x: f"coalesce(len({x}), 0)"
_TWICE = lambda xs: f"coalesce(len(list_filter({xs}, lambda z: z <> '')) > len(list_distinct(list_filter({xs}, lambda z: z <> ''))), false)"
_SQUEEZED = lambda parts: f"list_transform({parts}, lambda x: lower(regexp_replace(trim(x.name), '\\s+', ' ', 'g')))"
_PERIODS = f"coalesce({_T}.periods, [])"
_HAVE = f"list_transform(list_filter({_M}, lambda m: m.value IS NOT NULL), lambda m: {canonical_sql('m.label')})"
_HEADED = f"list_transform({_N}, lambda x: {NAME('x.section')})"
_RULES = {
    "company_mismatch": "id IN (SELECT id FROM wrong)", "missing_snapshot": "snapshot IS NULL", "missing_company_metadata": "snapshot IS NOT NULL AND trim(coalesce(snapshot.company_name, '')) = ''",
    "missing_report_period_metadata": "snapshot IS NOT NULL AND trim(coalesce(snapshot.report_period, '')) = ''", "zero_metrics": f"snapshot IS NOT NULL AND {_LEN(_M)} = 0", "mostly_null_metrics": f"{_LEN(_M)} > 0 AND 2 * len(list_filter({_M}, lambda m: m.value IS NULL)) >= len({_M})",
    "missing_core_metrics": f"{_LEN(_M)} > 0 AND NOT list_has_all({_HAVE}, ['revenue', 'ebitda', 'net_profit', 'free_cash_flow'])", "duplicate_trend_periods": _TWICE(f"list_transform({_PERIODS}, lambda p: lower(trim(p)))"),
    "trend_series_length_mismatch": f"{_T} IS NOT NULL AND (" + " OR ".join(f"coalesce(len({_T}.{c}) <> len({_PERIODS}), false)" for c in _SERIES) + ")", "all_null_trends": f"{_LEN(_T + '.periods')} > 0 AND NOT (" + " OR ".join(f"{_LEN(f'list_filter({_T}.{c}, lambda v: v IS NOT NULL)')} > 0" for c in _SERIES) + ")",
    "duplicate_revenue_breakdown_entries": f"{_TWICE(_SQUEEZED(_B + '.segments'))} OR {_TWICE(_SQUEEZED(_B + '.geographies'))}", "non_canonical_narrative_sections": f"{_LEN(f'list_filter({_N}, lambda x: trim(x.section) <> {chr(39) * 2} AND {NAME(chr(120) + '.section')} NOT IN ({', '.join(map(repr, X.SECTIONS))}))')} > 0",
    "missing_executive_summary": f"{_LEN(_N)} > 0 AND NOT coalesce(list_contains({_HEADED}, 'executive_summary'), false)",
}
assert list(_RULES) == list(R.ISSUES)
_CODES = "list_filter([" + ", ".join(f"CASE WHEN {rule} THEN '{code}' END" for code, rule in _RULES.items()) + "], lambda x: x IS NOT NULL)"
_AUDIT = f"WITH {_WRONG}, a AS (SELECT id, fiscal_year AS y, {_CODES} AS codes FROM snap)"
_LEVEL = lambda n: "[" + ", ".join(repr(k) for k, v in R.ISSUES.items() if v == n) + "]"


@query("J5q_report_audit", f"{_AUDIT} SELECT a.id, array_to_string(codes, ',') AS codes, CASE WHEN list_has_any(codes, {_LEVEL(3)}) THEN 3 WHEN list_has_any(codes, {_LEVEL(2)}) THEN 2 ELSE 1 END AS severity, suggested_company_id FROM a LEFT JOIN wrong ON a.id = wrong.id WHERE len(codes) > 0")
def report_audit(spark: SparkSession, sf: str) -> DataFrame:
    return R.audit(_filed(spark, sf), catalogue(spark, sf)).withColumn("codes", F.array_join("codes", ","))


@query("K12_audit_report", f"{_AUDIT}, e AS (SELECT id, unnest(codes) AS code FROM a WHERE len(codes) > 0) SELECT code, count(*) AS reports, CASE WHEN code IN ({', '.join(repr(k) for k, v in R.ISSUES.items() if v == 3)}) THEN 3 WHEN code IN ({', '.join(repr(k) for k, v in R.ISSUES.items() if v == 2)}) THEN 2 ELSE 1 END AS severity FROM e GROUP BY code")
def audit_report(spark: SparkSession, sf: str) -> DataFrame:
    """How many reports have each finding."""
    return R.audit_report(R.audit(_filed(spark, sf), catalogue(spark, sf)))


@query("J9q_candidate_status", f"{_AUDIT} SELECT id, CASE WHEN y % 11 = 0 OR len(codes) > 0 THEN 'failed_quality' ELSE 'pending_review' END AS status FROM a")
def candidate_status(spark: SparkSession, sf: str) -> DataFrame:
    s = snapshots(spark, sf)
    found = R.audit(s.select("id", F.col("filed_under").alias("company_id"), "snapshot"), catalogue(spark, sf)).select("id", "codes")
    state = F.when(F.col("fiscal_year") % 11 == 0, "failed").otherwise("complete")
    return s.join(found, "id", "left").select("id", R.candidate_status(state, F.coalesce("codes", F.array().cast("array<string>"))).alias("status"))


@query("J7q_without_content", f"WITH {SNAP_SQL} SELECT id FROM snap WHERE NOT ({_LEN(_M)} > 0 OR {_LEN(f'list_filter({_N}, lambda x: length(x.text) > 50)')} > 0)")
def without_content(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots(spark, sf).where(~R.has_content(F.col("snapshot"))).select("id")


_KEPT = "list_filter([" + ", ".join(f"CASE WHEN {_LEN(f'list_filter({_T}.{c}, lambda v: v IS NOT NULL)')} > 0 THEN '{c}' END" for c in _SERIES) + "], lambda x: x IS NOT NULL)"


@query("G52_kept_series", f"WITH {SNAP_SQL} SELECT id, CASE WHEN len({_T}.periods) >= 2 THEN array_to_string({_KEPT}, ',') ELSE '' END AS series FROM snap WHERE {_T} IS NOT NULL")
def kept_series(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots(spark, sf).where("snapshot.trends is not null").select("id", F.array_join(R.kept_series(F.col("snapshot.trends")), ",").alias("series"))


_RANK = "CASE WHEN regexp_matches(lower(trim(label)), '\\b(revenue|sales|turnover)\\b') THEN 0 WHEN regexp_matches(lower(label), '\\b(free cash flow|fcf)\\b') THEN 1 WHEN regexp_matches(lower(label), '\\bebitda\\b') THEN 2 WHEN regexp_matches(lower(label), '\\b(net profit|net income)\\b') THEN 3 WHEN contains(lower(label), 'margin') THEN 4 ELSE 10 END"
#: A row for each metric of a filing, by its place from 0.
_METRIC_ROWS = f"metric_rows AS (SELECT id AS doc, CAST(ord AS INTEGER) AS ord, m.label AS label, m.value AS value, m.unit AS unit, m.period AS period, m.snippet AS snippet, CAST(NULL AS VARCHAR) AS rationale, m.confidence AS confidence FROM (SELECT id, generate_subscripts({_M}, 1) - 1 AS ord, unnest({_M}) AS m FROM snap WHERE snapshot IS NOT NULL))"


@query("H7_metric_order", f"WITH {SNAP_SQL}, {_METRIC_ROWS} SELECT id, coalesce(labels, '') AS labels FROM snap LEFT JOIN (SELECT doc, array_to_string(list(label ORDER BY {_RANK}, ord), ',') AS labels FROM metric_rows GROUP BY doc) ON doc = id WHERE snapshot IS NOT NULL")
def metric_order(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots(spark, sf).where("snapshot is not null").select("id", F.array_join(F.transform(R.ranked_metrics(F.col("snapshot.metrics")), lambda m: m["label"]), ",").alias("labels"))


_TOLD_ROWS = f"told AS (SELECT id, ord, m.section AS section, m.text AS text FROM (SELECT id, generate_subscripts({_N}, 1) - 1 AS ord, unnest({_N}) AS m FROM snap WHERE snapshot IS NOT NULL))"


@query("H11_section_order", f"""WITH {SNAP_SQL}, {_TOLD_ROWS}, ranked AS (SELECT *, list_position([{', '.join(map(repr, X.SECTIONS))}], section) AS rank, row_number() OVER (PARTITION BY id, section ORDER BY ord) AS k FROM told)
SELECT id, coalesce(sections, '') AS sections FROM snap LEFT JOIN (SELECT id, array_to_string(list(coalesce(section, '-') ORDER BY coalesce(rank, 99), ord), ',') AS sections FROM ranked WHERE rank IS NULL OR k = 1 GROUP BY id) USING (id) WHERE snapshot IS NOT NULL""")
def section_order(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots(spark, sf).where("snapshot is not null").select("id", F.array_join(F.transform(R.in_section_order(F.col("snapshot.narratives")), lambda x: F.coalesce(x["section"], F.lit("-"))), ",").alias("sections"))


@query("H10_segments_by_size", f"""WITH {SNAP_SQL}, parts AS (SELECT id, ord, m.name AS name, m.value AS value FROM (SELECT id, generate_subscripts({_B}.segments, 1) AS ord, unnest({_B}.segments) AS m FROM snap WHERE snapshot IS NOT NULL) WHERE m.value IS NOT NULL)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY abs(value) DESC, ord) AS place, name, value, round(CASE WHEN sum(abs(value)) OVER (PARTITION BY id) > 0 THEN abs(value) / sum(abs(value)) OVER (PARTITION BY id) END, 9) AS share, round(CASE WHEN max(abs(value)) OVER (PARTITION BY id) > 0 THEN abs(value) / max(abs(value)) OVER (PARTITION BY id) END, 9) AS bar FROM parts""")
def segments_by_size(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of each filing's revenue, the largest first."""
    ranked = snapshots(spark, sf).select("id", F.posexplode(S.ranked_parts(F.col("snapshot.breakdown.segments"))).alias("at", "p"))
    return ranked.select("id", (F.col("at") + 1).cast("long").alias("place"), "p.name", "p.value", F.round("p.share", 9).alias("share"), F.round("p.bar", 9).alias("bar"))


@query("F14_timeline", f"""WITH {SNAP_SQL} SELECT company_id, id, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, id DESC) AS place, coalesce(snapshot.tone, '—') AS tone, snapshot.guidance AS guidance,
 CASE WHEN coalesce(snapshot.tone, '') = '' THEN CASE WHEN snapshot.tone IS NULL THEN 'neutral' ELSE 'not_detected' END WHEN contains(lower(snapshot.tone), 'very positive') THEN 'very_positive' WHEN contains(lower(snapshot.tone), 'positive') THEN 'positive' WHEN contains(lower(snapshot.tone), 'cautious') THEN 'cautious' WHEN contains(lower(snapshot.tone), 'negative') THEN 'negative' ELSE 'neutral' END AS bucket
FROM snap WHERE snapshot.tone IS NOT NULL OR snapshot.outlook IS NOT NULL OR snapshot.guidance IS NOT NULL OR snapshot.risks IS NOT NULL""")
def timeline(spark: SparkSession, sf: str) -> DataFrame:
    """A company's reports, newest first, with the tone of each and how it is shown."""
    return S.timeline(snapshots(spark, sf)).withColumn("place", F.col("place").cast("long")).withColumn("bucket", S.tone_bucket(F.col("tone")))


# --- repair, texts, brief ---------------------------------------------------------------------------------------------

_CHART = lambda x: f"trim(regexp_replace(strip_accents(lower({x})), '[^a-z0-9]+', ' ', 'g'))"
_PARTS_OF = lambda kind: f"(SELECT id, '{kind}' AS kind, ord, trim(m.name) AS name, m.value AS value FROM (SELECT id, generate_subscripts({_B}.{kind}, 1) AS ord, unnest({_B}.{kind}) AS m FROM snap WHERE snapshot IS NOT NULL) WHERE trim(m.name) <> '' AND m.value IS NOT NULL)"
_JOINED = lambda expr, order: f"coalesce(array_to_string(list({expr} ORDER BY {order}), '|'), '')"
_SHOWN = lambda v: f"coalesce(CAST(CAST(round({v}) AS BIGINT) AS VARCHAR), '-')"
_FIT = " + ".join(f"coalesce((len({_T}.{c}) <> n)::INT, 0)" for c in _SERIES)
_PCT = lambda c: f"CASE WHEN {c}_ <> 0 AND abs(({c} - {c}_) / abs({c}_) * 100) > 500 THEN 1 ELSE 0 END"
_REPAIR = f"""WITH {SNAP_SQL}, {_METRIC_ROWS}, {_TOLD_ROWS},
first AS (SELECT *, row_number() OVER (PARTITION BY doc, trim(lower(label)) ORDER BY ord) AS k FROM metric_rows),
met AS (SELECT doc, count(*) FILTER (k > 1) AS duplicate_labels, count(*) FILTER (k = 1 AND value IS NULL AND coalesce(unit, '') = '') AS dropped_metrics, coalesce(array_to_string(list(label ORDER BY ord) FILTER (k = 1 AND (value IS NOT NULL OR coalesce(unit, '') <> '')), '|'), '') AS labels FROM first GROUP BY doc),
named AS (SELECT id, ord, trim(text) AS text, coalesce(nullif(trim(section), ''), 'other') AS given FROM told WHERE trim(text) <> ''), placed AS (SELECT *, {canonical_section_sql('given')} AS section FROM named),
sections AS (SELECT id, section, min(ord) AS ord, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text FROM placed GROUP BY ALL), nar AS (SELECT id, {_JOINED("section || ':' || text", 'ord')} AS narratives, bool_or(section = 'executive_summary') AS told FROM sections GROUP BY id), ren AS (SELECT id, count(DISTINCT given) AS renamed FROM placed WHERE {NAME('given')} <> section GROUP BY id),
parts AS (SELECT id, kind, min(ord) AS ord, arg_min(name, ord) AS name, sum(value) AS value, count(*) - 1 AS merged FROM ({_PARTS_OF('segments')} UNION ALL {_PARTS_OF('geographies')}) GROUP BY id, kind, {_CHART('name')}),
kinds AS (SELECT id, kind, count(*) AS n, sum(merged) AS merged, {_JOINED(f"name || '=' || {_SHOWN('value')}", 'ord')} AS shown FROM parts GROUP BY ALL), brk AS (SELECT id, max(n) AS n, sum(merged) AS merged, {_JOINED('shown', "kind DESC")} AS shown FROM kinds GROUP BY id),
per AS (SELECT id, list_filter(list_transform({_T}.periods, lambda p: trim(p)), lambda p: p <> '') AS ps FROM snap WHERE {_T} IS NOT NULL), fit AS (SELECT id, {_FIT} AS refitted FROM snap JOIN (SELECT id, len(ps) AS n FROM per) USING (id)),
slots AS (SELECT s.id, i, ps[i] AS period, {', '.join(f'{_T}.{c}[i] AS {c}' for c in _SERIES)} FROM snap s JOIN per USING (id), LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS i)),
mer AS (SELECT id, period, min(i) AS i, count(*) - 1 AS merged, {', '.join(f'arg_min({c}, i) FILTER ({c} IS NOT NULL) AS {c}' for c in _SERIES)} FROM slots GROUP BY ALL), lags AS (SELECT *, {', '.join(f'lag({c}) OVER (PARTITION BY id ORDER BY i) AS {c}_' for c in _SERIES[:3])} FROM mer),
tre AS (SELECT id, count(*) AS n, sum(merged) AS merged, sum({' + '.join(map(_PCT, _SERIES[:3]))}) AS wild, {', '.join(f'count({c}) AS n_{c}' for c in _SERIES)}, {_JOINED('period', 'i')} AS periods, {', '.join(f"{_JOINED(_SHOWN(c), 'i')} AS s_{c}" for c in _SERIES)} FROM lags GROUP BY id),
x AS (SELECT s.id, {_T} IS NOT NULL AS has_t, {_B} IS NOT NULL AS has_b, {', '.join(f'{_T}.{c} IS NOT NULL AS h_{c}' for c in _SERIES)}, tre.* EXCLUDE (id), brk.n AS parts, brk.merged AS merged_parts, brk.shown FROM snap s LEFT JOIN tre ON tre.id = s.id LEFT JOIN brk ON brk.id = s.id WHERE snapshot IS NOT NULL),
y AS (SELECT *, has_t AND (coalesce(n, 0) < 2 OR NOT ({' OR '.join(f'h_{c} AND n_{c} > 0' for c in _SERIES)})) AS gone, has_b AND coalesce(parts, 0) < 2 AS lost FROM x)
SELECT y.id, CAST(coalesce(duplicate_labels, 0) AS INTEGER) AS duplicate_labels, CAST(coalesce(dropped_metrics, 0) AS INTEGER) AS dropped_metrics, CAST(coalesce(renamed, 0) AS INTEGER) AS renamed_sections, NOT coalesce(told, false) AS missing_summary, CAST(coalesce(merged_parts, 0) AS INTEGER) AS merged_parts, lost AS breakdown_dropped,
 CAST(coalesce(refitted, 0) AS INTEGER) AS series_refitted, CAST(coalesce(y.merged, 0) AS INTEGER) AS merged_periods, CAST(CASE WHEN has_t THEN {' + '.join(f'(h_{c} AND coalesce(n_{c}, 0) = 0)::INT' for c in _SERIES)} ELSE 0 END AS INTEGER) AS empty_series, gone AS trends_dropped, CAST(CASE WHEN gone THEN 0 ELSE coalesce(wild, 0) END AS INTEGER) AS implausible_changes,
 coalesce(labels, '') AS labels, coalesce(narratives, '') AS narratives, CASE WHEN has_b AND NOT lost THEN shown END AS parts, CASE WHEN has_t AND NOT gone THEN periods END AS periods, {', '.join(f'CASE WHEN has_t AND NOT gone AND h_{c} AND n_{c} > 0 THEN s_{c} END AS {c}' for c in _SERIES)}
FROM y LEFT JOIN met ON met.doc = y.id LEFT JOIN nar ON nar.id = y.id LEFT JOIN ren ON ren.id = y.id LEFT JOIN fit ON fit.id = y.id"""


@query("J6q_repair", _REPAIR)
def repaired(spark: SparkSession, sf: str) -> DataFrame:
    """Every filing repaired: what is left of it as text, and the twelve counts of what was done."""
    r = snapshots(spark, sf).where("snapshot is not null").select("id", S.repair(F.col("snapshot")).alias("r")).select("id", "r.snapshot", "r.warnings")
    shown = lambda xs: F.array_join(F.transform(xs, lambda v: F.coalesce(F.round(v).cast("long").cast("string"), F.lit("-"))), "|")
    parts = lambda xs: F.array_join(F.transform(xs, lambda p: F.concat(p["name"], F.lit("="), F.round(p["value"]).cast("long").cast("string"))), "|")
    w, s = F.col("warnings"), F.col("snapshot")
    both = F.array_join(F.filter(F.array(parts(s["breakdown"]["segments"]), parts(s["breakdown"]["geographies"])), lambda x: x.isNotNull()), "|")
    lists = ("duplicate_labels", "renamed_sections", "empty_series")
    return r.select(
        "id", *((F.size(w[c]) if c in lists else w[c]).alias(c) for c in ("duplicate_labels", "dropped_metrics", "renamed_sections", "missing_summary", "merged_parts", "breakdown_dropped", "series_refitted", "merged_periods", "empty_series", "trends_dropped", "implausible_changes")),
        F.array_join(F.transform(s["metrics"], lambda m: m["label"]), "|").alias("labels"), F.array_join(F.transform(s["narratives"], lambda x: F.concat(x["section"], F.lit(":"), x["text"])), "|").alias("narratives"),
        F.when(s["breakdown"].isNotNull(), both).alias("parts"), F.array_join(s["trends"]["periods"], "|").alias("periods"), *(shown(s["trends"][c]).alias(c) for c in S.SERIES),
    )


_TEXTS = f"""texts AS (SELECT id, 'metric:' || i || ':label' AS path, m.label AS text, true AS is_label FROM (SELECT id, generate_subscripts({_M}, 1) - 1 AS i, unnest({_M}) AS m FROM snap WHERE snapshot IS NOT NULL)
 UNION ALL SELECT id, 'narrative:' || ord || ':text', text, false FROM told UNION ALL SELECT id, 'sentiment:tone', snapshot.tone, false FROM snap UNION ALL SELECT id, 'sentiment:outlook', snapshot.outlook, false FROM snap
 UNION ALL SELECT id, 'sentiment:risk:' || i, t, false FROM (SELECT id, generate_subscripts(snapshot.risks, 1) - 1 AS i, unnest(snapshot.risks) AS t FROM snap WHERE snapshot IS NOT NULL))"""


@query("G55_collect_texts", f"WITH {SNAP_SQL}, {_TOLD_ROWS}, {_TEXTS} SELECT id AS doc, path, text, is_label FROM texts WHERE trim(text, ' ' || chr(9) || chr(10)) <> ''")
def collect_texts(spark: SparkSession, sf: str) -> DataFrame:
    return S.collect_texts(snapshots(spark, sf))


_NEW = "CASE WHEN trim(text, ' ' || chr(9) || chr(10)) <> '' AND strlen(text) % 3 <> 0 THEN upper(text) || '!' ELSE text END"


@query("G55_apply_texts", f"""WITH {SNAP_SQL}, {_TOLD_ROWS}, {_TEXTS}, new AS (SELECT id, path, {_NEW} AS text FROM texts)
SELECT s.id, {', '.join(f"(SELECT array_to_string(list(coalesce(text, '-') ORDER BY CAST(split_part(path, ':', {k}) AS INTEGER)), '|') FROM new n WHERE n.id = s.id AND starts_with(path, '{head}')) AS {name}" for name, head, k in (('labels', 'metric:', 2), ('narratives', 'narrative:', 2), ('risks', 'sentiment:risk:', 3)))},
 (SELECT text FROM new n WHERE n.id = s.id AND path = 'sentiment:tone') AS tone, (SELECT text FROM new n WHERE n.id = s.id AND path = 'sentiment:outlook') AS outlook FROM snap s WHERE snapshot IS NOT NULL""")
def apply_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the texts changed, each in its own place."""
    s = snapshots(spark, sf).where("snapshot is not null")
    new = S.collect_texts(s).where("octet_length(text) % 3 <> 0").select("doc", "path", F.concat(F.upper("text"), F.lit("!")).alias("text"))
    out = S.apply_texts(s, new, F.lit("lv"))
    joined = lambda xs, f=lambda x: x: F.when(F.size(xs) > 0, F.array_join(F.transform(xs, lambda x: F.coalesce(f(x), F.lit("-"))), "|"))
    return out.select("id", joined(F.col("snapshot.metrics"), lambda m: m["label"]).alias("labels"), joined(F.col("snapshot.narratives"), lambda x: x["text"]).alias("narratives"), joined(F.col("snapshot.risks")).alias("risks"), "snapshot.tone", "snapshot.outlook")


def _paragraphs_sql(name: str, sections: tuple[str, ...], most: int) -> str:
    """The first distinct lines of the first narrative of each of these sections."""
    chosen = " UNION ALL ".join(f"SELECT id, {k} AS part, arg_min(text, ord) AS text FROM told WHERE section = '{s}' GROUP BY id" for k, s in enumerate(sections))
    return f"""{name}_l AS (SELECT id, part, generate_subscripts(string_split(text, chr(10)), 1) AS n, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS line FROM ({chosen})),
{name}_f AS (SELECT id, part, n, line, row_number() OVER (PARTITION BY id, lower(line) ORDER BY part, n) AS k FROM {name}_l WHERE line <> ''), {name} AS (SELECT id, array_to_string(list(line ORDER BY part, n)[1:{most}], '|') AS {name} FROM {name}_f WHERE k = 1 GROUP BY id)"""


@query("H12_brief", f"""WITH {SNAP_SQL}, {_METRIC_ROWS}, {_TOLD_ROWS}, {_paragraphs_sql('summary', ('executive_summary', 'management_commentary'), 4)}, {_paragraphs_sql('priorities', ('strategic_priorities',), 3)},
shown AS (SELECT doc, array_to_string(list(label ORDER BY ord)[1:8], '|') AS metrics FROM metric_rows WHERE regexp_matches(lower(label), '{'|'.join(S.KEY_WORDS)}') GROUP BY doc)
SELECT s.id, coalesce(metrics, '') AS metrics, coalesce(summary, '') AS summary, coalesce(priorities, '') AS priorities, coalesce(nullif(snapshot.tone, ''), 'Not assessed') AS tone, nullif(snapshot.outlook, '') AS outlook, array_to_string(list_transform(snapshot.risks[1:3], lambda r: coalesce(r, '-')), '|') AS risks, CAST(greatest(len(snapshot.risks) - 3, 0) AS INTEGER) AS more_risks
FROM snap s LEFT JOIN shown ON doc = s.id LEFT JOIN summary USING (id) LEFT JOIN priorities USING (id) WHERE snapshot IS NOT NULL""")
def briefs(spark: SparkSession, sf: str) -> DataFrame:
    b = snapshots(spark, sf).where("snapshot is not null").select("id", S.brief(F.col("snapshot")).alias("b"))
    risks = F.array_join(F.transform("b.risks", lambda r: F.coalesce(r, F.lit("-"))), "|")
    return b.select("id", F.array_join(F.transform("b.metrics", lambda m: m["label"]), "|").alias("metrics"), F.array_join("b.summary", "|").alias("summary"), F.array_join("b.priorities", "|").alias("priorities"), "b.tone", "b.outlook", risks.alias("risks"), "b.more_risks")


_QUOTED = "'\"' || replace(o_orderpriority, '\"', '') || '\"'"
_JSON = f"""CASE o_orderkey % 11 WHEN 0 THEN '{{bad' WHEN 1 THEN NULL WHEN 2 THEN '[]' WHEN 3 THEN '"metadata"' WHEN 4 THEN '{{"progress": {{"step": 3}}}}' WHEN 5 THEN '{{"metrics": 5, "metadata": {{"companyName": 7}}}}'
ELSE '{{"metadata": {{"companyName": ' || {_QUOTED} || '}}, "metrics": [{{"label": "Revenue", "value": ' || CASE o_orderkey % 4 WHEN 0 THEN '"1,2' || CAST(o_custkey AS STRING) || '"' WHEN 1 THEN 'null' WHEN 2 THEN '"n/a"' ELSE CAST(o_custkey AS STRING) || '.5' END || '}}, {{"label": 5, "value": true}}, {{"value": "' || CAST(o_orderkey AS STRING) || '"}}], "sentiment": {{"riskFactors": ["a", 1, null]}}}}' END"""


@query("G49_snapshots", f"""WITH r AS (SELECT o_orderkey AS id, {_JSON} AS raw FROM orders), p AS (SELECT *, json_valid(raw) AS good FROM r),
j AS (SELECT id, raw, CASE WHEN good THEN raw::JSON END AS j FROM p), k AS (SELECT *, CASE WHEN raw IS NULL THEN NULL WHEN j IS NULL THEN 'not_json' WHEN json_type(j) <> 'OBJECT' THEN 'not_an_object' WHEN NOT (json_exists(j, '$.metadata') OR json_exists(j, '$.metrics')) THEN 'no_snapshot' END AS reason FROM j),
m AS (SELECT id, reason, j, CASE WHEN json_type(j, '$.metrics') = 'ARRAY' THEN json_extract(j, '$.metrics[*]') END AS ms FROM k)
SELECT id, good AS ok, reason, CASE WHEN json_type(m.j, '$.metadata.companyName') = 'VARCHAR' THEN m.j ->> '$.metadata.companyName' END AS company, CASE WHEN good THEN CAST(CASE WHEN json_type(m.j, '$.metrics') = 'ARRAY' THEN len(ms) END AS INTEGER) END AS n,
 CASE WHEN good THEN (SELECT sum(CASE WHEN json_type(x, '$.value') = 'VARCHAR' THEN TRY_CAST(replace(x ->> '$.value', ',', '') AS DOUBLE) WHEN json_type(x, '$.value') IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN CAST(x ->> '$.value' AS DOUBLE) END) FROM (SELECT unnest(ms) AS x)) END AS total,
 CASE WHEN good THEN CAST((SELECT count(*) FROM (SELECT unnest(ms) AS x) WHERE json_type(x, '$.label') = 'VARCHAR') AS INTEGER) END AS labelled FROM (SELECT m.*, raw IS NOT NULL AND reason IS NULL AS good FROM m JOIN r USING (id)) m""")
def parsed_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """JSON texts read into snapshots; what is none has the reason."""
    rows = table(spark, sf, "orders").selectExpr("o_orderkey AS id", f"{_JSON} AS raw")
    bad = S.rejected_snapshots(rows, "raw").select("id", "reason")
    s = rows.withColumn("s", S.parse_snapshot(F.col("raw"))).join(bad, "id", "left")
    metrics = F.col("s.metrics")
    total = F.aggregate(F.filter(metrics, lambda m: m["value"].isNotNull()), F.lit(None).cast("double"), lambda a, m: F.coalesce(a, F.lit(0.0)) + m["value"])
    labelled = F.coalesce(F.size(F.filter(metrics, lambda m: m["label"].isNotNull())), F.lit(0))
    return s.select("id", F.col("s").isNotNull().alias("ok"), "reason", F.col("s.company_name").alias("company"), F.size(metrics).alias("n"), total.alias("total"), F.when(F.col("s").isNotNull(), labelled).alias("labelled"))


# --- previews, completion ---------------------------------------------------------------------------------------------

_HEAD = ", ".join(f"arg_min(euro, (CASE WHEN id = '{i}' THEN 0 ELSE 1 END, ord)) FILTER (id = '{i}' OR ({_SAYS[n]})) AS {n}" for n, i in _IDS.items())


def previews_sql(rows: str) -> str:
    """CTEs up to previews (doc, revenue, ebitda, net_profit, fcf) of rows (id, snapshot)."""
    long = " UNION ALL ".join(f"SELECT id AS doc, '{c}' AS series, len({_T}.{c}) AS n, generate_subscripts({_T}.{c}, 1) AS idx, unnest({_T}.{c}) AS value FROM {rows} WHERE snapshot IS NOT NULL" for c in _SERIES)
    return f"""metric_rows AS (SELECT id AS doc, CAST(ord AS INTEGER) AS ord, m.label AS label, m.value AS value, m.unit AS unit, m.period AS period, m.snippet AS snippet, CAST(NULL AS VARCHAR) AS rationale, m.confidence AS confidence FROM (SELECT id, generate_subscripts({_M}, 1) - 1 AS ord, unnest({_M}) AS m FROM {rows} WHERE snapshot IS NOT NULL)),
{scaled_sql('metric_rows')}, figures AS (SELECT doc, {_HEAD} FROM scaled WHERE value IS NOT NULL AND NOT {_EXCLUDED} GROUP BY doc), modal AS (SELECT doc, arg_max(s, (n, s)) AS stated FROM (SELECT doc, greatest(u, e) AS s, count(*) AS n FROM m GROUP BY ALL) WHERE s > 1 AND n >= 2 GROUP BY doc),
long AS ({long}), targets AS ({' UNION ALL '.join(f"SELECT doc, '{c}' AS series, {c} AS target FROM figures" for c in _SERIES)}),
mult AS (SELECT doc, series, arg_min(z, (d, idx, z)) AS multiplier FROM (SELECT l.doc, l.series, idx, z, abs(ln(abs(value * z) / abs(target))) AS d FROM long l JOIN targets USING (doc, series), (VALUES (1), (1000), (1000000)) AS q(z) WHERE value <> 0 AND target <> 0) GROUP BY ALL),
common AS (SELECT doc, arg_max(multiplier, (n, multiplier)) AS common FROM (SELECT doc, multiplier, count(*) AS n FROM mult GROUP BY ALL) GROUP BY doc),
ends AS (SELECT l.*, coalesce(multiplier, common) AS s, stated, max(abs(value)) OVER w >= 100000 AND min(CASE WHEN value <> 0 THEN abs(value) END) OVER w < 1000 AS mixed FROM long l LEFT JOIN mult USING (doc, series) LEFT JOIN common USING (doc) LEFT JOIN modal USING (doc) WINDOW w AS (PARTITION BY l.doc, l.series)),
euros AS (SELECT doc, series, CASE WHEN s = 1000 AND mixed AND abs(value) > 0 AND abs(value) < 1000 THEN value * 1000000 WHEN s IS NOT NULL THEN value * s WHEN stated > 1 AND abs(value) < 1000000 THEN value * stated ELSE value END AS value FROM ends WHERE idx = n),
previews AS (SELECT r.id AS doc, {', '.join(f"coalesce(any_value(f.{c}), max(e.value) FILTER (series = '{c}')) AS {c}" for c in _SERIES)} FROM {rows} r LEFT JOIN figures f ON f.doc = r.id LEFT JOIN euros e ON e.doc = r.id WHERE snapshot IS NOT NULL GROUP BY r.id)"""


@query("K2_company_reports", f"WITH {SNAP_SQL}, {previews_sql('snap')} SELECT company_id, row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC, report_type) AS place, id, revenue, ebitda, net_profit, fcf, guidance FROM (SELECT company_id, fiscal_year, report_type, id, p.revenue, p.ebitda, p.net_profit, p.fcf, snapshot.guidance AS guidance FROM snap LEFT JOIN previews p ON doc = id)")
def company_reports(spark: SparkSession, sf: str) -> DataFrame:
    """A company's reports, newest first, with the previews that their snapshots give."""
    return R.company_reports(snapshots(spark, sf)).select("company_id", F.col("place").cast("long").alias("place"), "id", *S.SERIES, "guidance")


@query("K4_unmatched", f"WITH {SNAP_SQL} SELECT id, row_number() OVER (ORDER BY fiscal_year DESC, id) AS place, trim(snapshot.company_name) AS extracted FROM snap WHERE filed_under IS NULL")
def unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """The queue of reports without a company, newest year first."""
    s = snapshots(spark, sf).where("filed_under is null").select("id", F.concat(F.lit("y"), (9999 - F.col("fiscal_year")).cast("string")).alias("late"), F.trim("snapshot.company_name").alias("extracted"))
    return T.numbered(s, "late", "id").select("id", F.col("place").cast("long").alias("place"), "extracted")


_SELLS, _FREES = "regexp_matches(lower(trim({x})), '\\b(revenue|sales|turnover)\\b')".format, "regexp_matches(lower({x}), '\\b(free cash flow|fcf)\\b')".format
_PILLAR = lambda x: f"(coalesce(({canonical_sql(x)}) IN ('revenue', 'free_cash_flow'), false) OR {_SELLS(x=x)} OR {_FREES(x=x)})"
_KNOWN = f"coalesce(metric_id, ({canonical_sql('name')}))"
_HIGHER = f"CASE WHEN {_KNOWN} IN ('liabilities', 'capex') THEN false WHEN {_KNOWN} IS NOT NULL THEN true WHEN regexp_matches(lower(name), '\\b(cost|expense|debt)\\b') THEN false ELSE {_PILLAR('name')} OR regexp_matches(lower(name), 'profit|margin|ebitda|income|eps') END"
_PLACE = f"CASE WHEN coalesce(metric_id = 'revenue', false) OR {_SELLS(x='name')} THEN 0 WHEN coalesce(metric_id = 'free_cash_flow', false) OR {_FREES(x='name')} THEN 1 WHEN coalesce(metric_id = 'ebitda', false) OR regexp_matches(lower(name), '\\bebitda\\b') THEN 2 WHEN coalesce(metric_id = 'net_profit', false) OR regexp_matches(lower(name), '\\b(net profit|net income)\\b') THEN 3 WHEN contains(lower(name), 'margin') THEN 4 ELSE 10 END"
_SHOWN_AS = "CASE metric_id " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in METRIC_NAMES.items()) + " END"
_COUNTED = lambda v: f"coalesce(CAST(CAST(round({v}) AS BIGINT) AS VARCHAR), '-')"
_GUIDED = lambda c: f"CASE {c} WHEN 'raised' THEN 3 WHEN 'maintained' THEN 2 WHEN 'lowered' THEN 1 ELSE 0 END"


@query("K7_compare", f"""WITH {SNAP_SQL}, {_METRIC_ROWS}, {scaled_sql('metric_rows')}, pairs AS (SELECT x.id AS pair, x.id AS a, y.id AS b, x.snapshot.guidance AS ga, y.snapshot.guidance AS gb FROM snap x JOIN snap y ON y.company_id = x.company_id AND y.fiscal_year = x.fiscal_year AND y.report_type = 'annual' AND x.report_type <> 'annual' WHERE x.snapshot IS NOT NULL AND y.snapshot IS NOT NULL),
keyed AS (SELECT doc, ord, label, euro, coalesce('canonical:' || id, 'label:' || trim(regexp_replace(lower(label), '\\s+', ' ', 'g'))) AS key FROM scaled), sides AS (SELECT pair, 'a' AS side, k.* FROM pairs JOIN keyed k ON doc = a UNION ALL SELECT pair, 'b', k.* FROM pairs JOIN keyed k ON doc = b),
joined AS (SELECT pair, key, coalesce(arg_max(label, ord) FILTER (side = 'a'), arg_max(label, ord) FILTER (side = 'b')) AS label, arg_max_null(euro, ord) FILTER (side = 'a') AS a, arg_max_null(euro, ord) FILTER (side = 'b') AS b FROM sides GROUP BY ALL),
named AS (SELECT *, CASE WHEN starts_with(key, 'canonical:') THEN substr(key, 11) END AS metric_id FROM joined), told AS (SELECT *, coalesce({_SHOWN_AS}, label) AS name FROM named),
judged AS (SELECT *, {_HIGHER} AS higher, CASE WHEN coalesce(metric_id IN ('revenue', 'free_cash_flow'), false) OR {_PILLAR('label')} THEN 2 ELSE 1 END AS weight, {_PLACE} AS rank FROM told),
points AS (SELECT pair, CASE WHEN (higher AND a > b) OR (NOT higher AND a < b) THEN weight ELSE 0 END AS x, CASE WHEN (higher AND a < b) OR (NOT higher AND a > b) THEN weight ELSE 0 END AS y, weight AS w FROM judged WHERE a IS NOT NULL AND b IS NOT NULL
 UNION ALL SELECT pair, CASE WHEN {_GUIDED('ga')} >= {_GUIDED('gb')} THEN 2 ELSE 0 END, CASE WHEN {_GUIDED('gb')} >= {_GUIDED('ga')} THEN 2 ELSE 0 END, 2 FROM pairs WHERE {_GUIDED('ga')} > 0 OR {_GUIDED('gb')} > 0),
scores AS (SELECT pair, sum(x)::BIGINT AS x, sum(y)::BIGINT AS y, sum(w)::BIGINT AS w FROM points GROUP BY pair),
rows_ AS (SELECT pair, array_to_string(list(name || '=' || {_COUNTED('a')} || '/' || {_COUNTED('b')} || '/' || coalesce(CASE WHEN a = b THEN NULL WHEN (a > b) = higher THEN 'a' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'b' END, '-') ORDER BY rank, lower(name), key), '|') AS metrics FROM judged GROUP BY pair)
SELECT pair, coalesce(x, 0) AS score_a, coalesce(y, 0) AS score_b, coalesce(w, 0) AS total, CASE WHEN x > y THEN 'a' WHEN y > x THEN 'b' ELSE 'tie' END AS leader, coalesce(metrics, '') AS metrics FROM pairs LEFT JOIN scores USING (pair) LEFT JOIN rows_ USING (pair)""")
def compared(spark: SparkSession, sf: str) -> DataFrame:
    """Every other report beside the annual one of its company and year."""
    s = snapshots(spark, sf)
    annual = s.where("report_type = 'annual'").select("company_id", "fiscal_year", F.col("id").alias("b"))
    pairs = s.where("report_type <> 'annual'").select(F.col("id").alias("pair"), F.col("id").alias("a"), "company_id", "fiscal_year").join(annual, ["company_id", "fiscal_year"])
    count = lambda v: F.coalesce(F.round(v).cast("long").cast("string"), F.lit("-"))
    shown = F.transform("metrics", lambda m: F.concat(m["name"], F.lit("="), count(m["a"]), F.lit("/"), count(m["b"]), F.lit("/"), F.coalesce(m["better"], F.lit("-"))))
    return C.comparison(pairs, s).select("pair", *(F.col(c).cast("long").alias(c) for c in ("score_a", "score_b", "total")), "leader", F.array_join(shown, "|").alias("metrics"))


@query("K3_for_compare", f"""WITH {SNAP_SQL} SELECT s.id, c.name, s.fiscal_year, s.report_type FROM snap s LEFT JOIN catalogue c ON c.id = s.filed_under WHERE c.name ILIKE '%ta%' OR c.ticker ILIKE '%ta%' OR starts_with(CAST(s.fiscal_year AS VARCHAR), 'ta') ORDER BY c.name NULLS LAST, s.fiscal_year DESC, s.report_type, s.id LIMIT 200""")
def for_compare(spark: SparkSession, sf: str) -> DataFrame:
    """What a search for two reports to compare lists, 200 at most."""
    s = snapshots(spark, sf).select("id", F.col("filed_under").alias("company_id"), "fiscal_year", "report_type")
    return T.search_reports(s, catalogue(spark, sf), "ta").select("id", "name", "fiscal_year", "report_type")


_CONTEXT = "CASE h % 3 WHEN 0 THEN NULL WHEN 1 THEN company_id ELSE CASE WHEN h % 7 = 0 THEN company_id + 1000000 ELSE company_id END END"
_PERIOD = lambda p, g: f"nullif(regexp_extract(period, '{p}', {g}), '')"
_YEAR_OF = f"CAST(coalesce({_PERIOD('(?i)^(?:Q[1-4]|FY|H[12])\\s*(\\d{4})$', 1)}, {_PERIOD('^(\\d{4})-\\d{2}-\\d{2}$', 1)}, {_PERIOD('^(\\d{4})$', 1)}) AS INTEGER)"
_TYPE_OF = "CASE WHEN period ILIKE 'q%' THEN lower(substr(period, 1, 2)) WHEN period ILIKE 'h%' THEN 'semi-annual' WHEN contains(period, '-06-30') THEN 'q2' ELSE 'annual' END"
_JOBS = f"""{SNAP_SQL}, jobs AS (SELECT id, {_CONTEXT} AS context, snapshot.language AS language, snapshot, coalesce(trim(snapshot.company_name), '') AS said, coalesce(trim(snapshot.report_period), '') AS period, h AS ord FROM snap WHERE h % 4 <> 0),
reports AS (SELECT 'r' || id AS id, filed_under AS company_id, fiscal_year, report_type, coalesce(snapshot.language, 'en') AS language, snapshot FROM snap WHERE h % 4 = 0)"""
_COMPLETION = f"""WITH {_JOBS}, read AS (SELECT *, said <> '' AND period <> '' AS told, {_YEAR_OF} AS year, {_TYPE_OF} AS kind FROM jobs),
names AS (SELECT DISTINCT said AS name FROM read WHERE said <> ''), best AS (WITH {scored_sql(_EVERY, False)} SELECT * FROM ({_BEST}) WHERE confidence >= 0.85),
fits AS (WITH {scored_sql("(SELECT j.id AS doc, j.said AS name, c.id, c.ord, c.name AS own, c.ticker FROM read j JOIN catalogue c ON c.id = j.context)", False)} SELECT doc FROM scored WHERE confidence >= 0.85),
mapped AS (SELECT r.*, CASE WHEN context IS NOT NULL AND context NOT IN (SELECT id FROM catalogue) THEN 'not_found' WHEN context IS NOT NULL AND r.id IN (SELECT doc FROM fits) THEN 'verified' WHEN context IS NOT NULL THEN 'conflict' WHEN b.company_id IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS mapping, b.company_id AS best FROM read r LEFT JOIN best b ON b.name = r.said),
placed AS (SELECT *, CASE mapping WHEN 'verified' THEN context WHEN 'matched' THEN best END AS company FROM mapped), both_kinds AS (SELECT id, snapshot FROM placed WHERE told AND year IS NOT NULL UNION ALL SELECT id, snapshot FROM reports WHERE company_id IS NOT NULL), {previews_sql('both_kinds')},
balance AS (SELECT doc, median(euro) AS balance, count(*) AS balances FROM scaled WHERE id IN ('total_assets', 'equity', 'liabilities') AND euro > 0 GROUP BY doc),
past AS (SELECT r.company_id, r.fiscal_year, r.report_type, abs(p.revenue) AS revenue FROM reports r LEFT JOIN previews p ON p.doc = r.id WHERE r.company_id IS NOT NULL),
usual AS (SELECT company_id, median(revenue) AS usual FROM past WHERE revenue > 0 GROUP BY company_id), annual AS (SELECT company_id, fiscal_year, max(revenue) AS annual FROM past WHERE report_type = 'annual' GROUP BY ALL),
facts AS (SELECT j.id, j.kind, p.revenue AS r, abs(p.revenue) AS size, abs(p.net_profit) AS net, abs(p.fcf) AS free, balance, balances, usual, annual FROM placed j JOIN previews p ON p.doc = j.id LEFT JOIN balance b ON b.doc = j.id LEFT JOIN usual u ON u.company_id = j.company LEFT JOIN annual a ON a.company_id = j.company AND a.fiscal_year = j.year WHERE j.told AND j.year IS NOT NULL),
wrong AS (SELECT id, list_filter([CASE WHEN size > 0 AND balances >= 2 AND r > 0 AND (balance / size > 100 OR balance / size < 0.01) THEN 'balance_sheet_scale_mismatch' END, CASE WHEN size > 0 AND free / size > 3 THEN 'cash_flow_exceeds_revenue' END, CASE WHEN r > 0 AND (r / usual > 10 OR r / usual < 0.1) THEN 'history_extreme_change' END,
 CASE WHEN size > 0 AND net / size > 2 THEN 'net_profit_exceeds_revenue' END, CASE WHEN kind = 'semi-annual' AND size > 1.5 * annual THEN 'semi_annual_exceeds_annual' END], lambda x: x IS NOT NULL) AS codes FROM facts),
asked AS (SELECT j.id, j.ord, j.company, j.year, j.kind, j.language FROM placed j LEFT JOIN wrong w ON w.id = j.id WHERE told AND year IS NOT NULL AND coalesce(len(codes), 0) = 0),
turns AS (SELECT a.*, CASE WHEN company IS NOT NULL AND language IS NOT NULL THEN row_number() OVER w ELSE 1 END AS turn, first_value(a.id) OVER w AS first, (SELECT min(r.id) FROM reports r WHERE r.company_id = a.company AND r.fiscal_year = a.year AND r.report_type = a.kind AND r.language = a.language) AS held FROM asked a WINDOW w AS (PARTITION BY company, year, kind, language ORDER BY ord, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT j.id, CASE WHEN NOT told THEN 'no_metadata' WHEN j.year IS NULL THEN 'no_period' WHEN len(codes) > 0 THEN 'failed' WHEN held IS NOT NULL OR turn > 1 THEN 'duplicate' ELSE 'created' END AS outcome, CASE WHEN told THEN j.company END AS company_id, CASE WHEN told THEN mapping END AS mapping, CASE WHEN told THEN j.year END AS fiscal_year,
 CASE WHEN told AND j.year IS NOT NULL THEN j.kind END AS report_type, coalesce(array_to_string(codes, ','), '') AS warnings, CASE WHEN held IS NOT NULL THEN held WHEN turn > 1 THEN first END AS duplicate_of FROM placed j LEFT JOIN wrong w ON w.id = j.id LEFT JOIN turns t ON t.id = j.id"""


@query("J8q_completion", _COMPLETION)
def completion(spark: SparkSession, sf: str) -> DataFrame:
    """Three quarters of the filings as jobs, the rest as the reports there are."""
    s = snapshots(spark, sf, ("company_name", "report_period", "language", "metrics", "trends"))
    jobs = s.where("h % 4 <> 0").selectExpr("id", f"{_CONTEXT} AS company_id", "snapshot.language AS language", "h AS ord", "snapshot")
    reports = s.where("h % 4 = 0").selectExpr("concat('r', id) AS id", "filed_under AS company_id", "fiscal_year", "report_type", "coalesce(snapshot.language, 'en') AS language", "CAST(NULL AS STRING) AS job_id", "snapshot")
    found = decide(jobs, catalogue(spark, sf), reports, 2025)
    return found.select("id", "outcome", "company_id", "mapping", "fiscal_year", "report_type", F.array_join("warnings", ",").alias("warnings"), "duplicate_of")


@query("C10_rerun_metrics", f"""WITH {FILINGS_SQL} SELECT id AS pair, 'canonical:revenue' AS key, revenue AS a, CASE WHEN company_id % 3 = 0 THEN revenue * 2 ELSE revenue END AS b FROM filings UNION ALL SELECT id, 'canonical:net_profit', net_profit, CASE WHEN company_id % 4 <> 0 THEN net_profit END FROM filings
UNION ALL SELECT id, 'label:head count', NULL, 5.0 FROM filings""")
def rerun_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """What a report says beside what its rerun says."""
    f = filings(spark, sf)
    rerun = F.concat("id", F.lit("-rerun"))
    now = f.select(F.col("id").alias("doc"), F.expr("stack(2, 0, 'Revenue', revenue, 1, 'Net profit', net_profit) as (ord, label, value)"))
    again = f.select(rerun.alias("doc"), F.expr("stack(3, 0, 'Revenue', if(company_id % 3 = 0, revenue * 2, revenue), 1, 'Net profit', if(company_id % 4 = 0, null, net_profit), 2, 'Head  Count', 5.0D) as (ord, label, value)"))
    none = F.lit(None)
    rows = now.union(again).withColumn("canonical_id", none.cast("string")).withColumn("original_label", none.cast("string")).withColumn("normalized_value", none.cast("double"))
    return C.pair_metrics(f.select(F.col("id").alias("pair"), F.col("id").alias("a"), rerun.alias("b")), rows).select("pair", "key", "a", "b")


_ORDER = "['revenue', 'ebitda', 'net_profit', 'free_cash_flow', 'operating_cash_flow', 'total_assets', 'equity', 'liabilities']"


@query("H8_rerun_order", f"""WITH {SNAP_SQL}, {_METRIC_ROWS}, k AS (SELECT doc, label, ord, coalesce({canonical_sql('label')}, lower(trim(label))) AS key FROM metric_rows), g AS (SELECT doc, key, arg_min(label, ord) AS label FROM k GROUP BY ALL)
SELECT doc, key, label, row_number() OVER (PARTITION BY doc ORDER BY coalesce(list_position({_ORDER}, key), 99), lower(label), label, key) AS place FROM g""")
def rerun_order(spark: SparkSession, sf: str) -> DataFrame:
    """A filing's metrics in the order of a review: the known ones first, then by label."""
    return C.in_review_order(S.flat_metrics(snapshots(spark, sf))).select("doc", "key", "label", F.col("place").cast("long").alias("place"))


@query("C13_history", f"WITH {FILINGS_SQL}, f AS (SELECT id, CASE WHEN company_id % 19 <> 0 THEN CASE WHEN company_id % 17 = 0 THEN company_id + 1000000 ELSE company_id END END AS company, fiscal_year AS y FROM filings) SELECT a.id, count(b.id) AS others, coalesce(bool_or(a.y = b.y), false) AS same_year FROM f a LEFT JOIN f b ON a.company = b.company AND a.id <> b.id GROUP BY a.id")
def history(spark: SparkSession, sf: str) -> DataFrame:
    return R.with_history(snapshots(spark, sf).select("id", F.col("filed_under").alias("company_id"), "fiscal_year")).select("id", F.col("others").cast("long").alias("others"), "same_year")


_WARNED = "CASE event_id % 5 WHEN 0 THEN '[\"' || event_type || '\", ' || event_id || ', null, {\"a\": \"b\"}, \"x\"]' WHEN 1 THEN '[\"' || event_type WHEN 2 THEN '{\"a\": [\"b\"]}' WHEN 3 THEN '[]' END"


@query("G50_warning_texts", f"SELECT event_id, CASE WHEN event_id % 5 = 0 THEN event_type || '|x' ELSE '' END AS warnings FROM (SELECT event_id, event_type, {_WARNED} AS raw FROM events)")
def warning_texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.array_join(R.warning_texts(F.expr(_WARNED)), "|").alias("warnings"))


@query("G48_evidence", "SELECT l_orderkey, l_linenumber, nullif(concat_ws(' · ', CASE WHEN l_partkey % 3 <> 0 THEN CAST(floor(l_discount * 100 + 0.5) AS BIGINT) || '% confidence' END, CASE WHEN l_suppkey % 4 <> 0 THEN 'page ' || (l_suppkey % 4) END, CASE WHEN l_orderkey % 2 = 0 THEN 'chunk ' || l_linenumber END), '') AS caption FROM lineitem")
def evidence(spark: SparkSession, sf: str) -> DataFrame:
    sure = F.when(F.col("l_partkey") % 3 != 0, F.col("l_discount"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R.evidence_caption(sure, F.col("l_suppkey") % 4, F.when(F.col("l_orderkey") % 2 == 0, F.col("l_linenumber") - 1)).alias("caption"))


_FIXED = lambda v, d: f"printf('%.{d}f', sign({v}) * floor(abs({v}) * {10.0**d} + 0.5) / {10.0**d})"
_GROUPED = lambda v, d: f"regexp_replace(format('{{:,.{d}f}}', sign({v}) * floor(abs({v}) * {10.0**d} + 0.5) / {10.0**d}), '\\.?0+$', '')"
_SHORT = lambda v, b, m, small: f"CASE WHEN abs({v}) >= 1e9 THEN {_FIXED(f'({v} / 1e9)', b)} || 'B' WHEN abs({v}) >= 1e6 THEN {_FIXED(f'({v} / 1e6)', m)} || 'M' WHEN abs({v}) >= 1e3 THEN {_FIXED(f'({v} / 1e3)', 0)} || 'K' ELSE {small} END"
_PLAIN = "regexp_replace(CAST(v AS VARCHAR), '\\.0$', '')"
#: Net profits on several scales, small and null ones too.
_AMOUNTS = "CASE company_id % 5 WHEN 0 THEN net_profit WHEN 1 THEN net_profit / 1000 WHEN 2 THEN floor(net_profit) * 1000 WHEN 3 THEN NULL ELSE floor(net_profit) / 128 END"
_UNITS = "CASE fiscal_year % 5 WHEN 0 THEN 'EUR' WHEN 1 THEN ' % ' WHEN 2 THEN NULL WHEN 3 THEN 'usd m' ELSE 'shares' END"


@query("G45_compact_euro", f"""WITH {FILINGS_SQL}, x AS (SELECT id, {_AMOUNTS} AS v, trim(coalesce({_UNITS}, '')) AS u FROM filings)
SELECT id, coalesce('€' || {_SHORT('v', 1, 0, _PLAIN)}, '—') AS shown, coalesce('€' || {_SHORT('v', 2, 1, _PLAIN)}, '—') AS finer, {_SHORT('v', 1, 1, _PLAIN)} AS axis, coalesce(CASE WHEN regexp_matches(lower(u), '€|eur|usd') THEN '€' || {_SHORT('v', 2, 1, _GROUPED('v', 3))} WHEN u = '' THEN {_GROUPED('v', 2)} ELSE {_GROUPED('v', 2)} || ' ' || u END, '—') AS metric,
 CASE WHEN v > 0 THEN '+' ELSE '' END || {_FIXED('v', 1)} || '%' AS change, CASE WHEN v >= 10 THEN {_FIXED('v', 1)} ELSE {_FIXED('v', 2)} END || '%' AS share FROM x""")
def compact(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts of every size as they are shown in tables, charts and lists."""
    x = filings(spark, sf).selectExpr("id", f"{_AMOUNTS} AS v", f"{_UNITS} AS u")
    v = F.col("v")
    return x.select("id", M.compact_euro(v).alias("shown"), M.compact_euro(v, 2, 1).alias("finer"), M.axis_number(v).alias("axis"), M.metric_text(v, F.col("u")).alias("metric"), M.signed_percent(v).alias("change"), M.share_percent(v).alias("share"))


_WAIT = "least(1000 * pow(2, event_id % 8), 30000)"
_BACK = f"floor({_WAIT} + {_WAIT} * 0.25 * (2 * ((event_id % 1000) / 1000) - 1) + 0.5)"


@query("L9_retry_delays", f"SELECT event_id, CAST(CASE WHEN event_id % 3 = 0 AND value > 0 THEN least(greatest({_BACK}, ceil(value * 1000)), 600000) ELSE {_BACK} END AS BIGINT) AS delay_ms FROM events")
def retry_delays(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, 429).otherwise(500)
    return table(spark, sf, "events").select("event_id", R.retry_delay(F.col("event_id") % 8, (F.col("event_id") % 1000) / 1000, status, F.col("value")).alias("delay_ms"))


@query("L13_open_chunks", "SELECT doc_id AS doc, chunk FROM (SELECT doc_id, unnest(range(greatest(1, CAST(ceil(n_chars / 1000) AS BIGINT)))) AS chunk FROM documents) WHERE (doc_id * 7 + chunk) % 3 <> 0")
def open_chunks(spark: SparkSession, sf: str) -> DataFrame:
    n = F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 1000)).cast("long")
    wanted = table(spark, sf, "documents").select(F.col("doc_id").alias("doc"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("chunk"))
    return R.open_chunks(wanted, wanted.where("(doc * 7 + chunk) % 3 = 0"))


@query("D7_upsert_candidates", f"WITH {FILINGS_SQL} SELECT id AS report_id, 'j' || company_id AS job_id, CASE WHEN company_id % 3 = 0 THEN 'failed_quality' ELSE 'pending_review' END AS status FROM filings WHERE company_id % 2 = 0 OR company_id % 3 = 0")
def upsert_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """One candidate for each report and job, with the newest status."""
    f = filings(spark, sf).select(F.col("id").alias("report_id"), F.concat(F.lit("j"), F.col("company_id").cast("string")).alias("job_id"), "company_id")
    old = f.where("company_id % 2 = 0").select("report_id", "job_id", F.lit("pending_review").alias("status"))
    new = f.where("company_id % 3 = 0").select("report_id", "job_id", F.lit("failed_quality").alias("status"))
    return T.upsert(old, new, ["report_id", "job_id"], overwrite=["status"])
