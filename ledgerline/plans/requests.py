"""Queries on batches of requests: reviews, jobs, shared links, companies, leads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import requests as Q
from ledgerline.plans.inputs import CANDIDATES, REPORTS, STRING, Made, dealt, table
from ledgerline.plans.registry import query

NOW = "2024-02-01"
_ORDER = STRING("o_orderkey")

# --- reviews ----------------------------------------------------------------------------------------------------------

#: Some candidates' reports are gone.
_HELD = Made(REPORTS.columns, where="o_orderkey % 9 <> 0")
_REVIEWS = Made(("l_orderkey * 8 + l_linenumber AS seq", f"CASE WHEN l_suppkey % 13 = 0 THEN 'none' ELSE 'k' || {STRING('l_orderkey')} END AS candidate_id", dealt(("promote", "reject", "promote", "wave", None), "l_partkey") + " AS action"), source="lineitem")
_LISTED = Made(("'c' || CAST(c_custkey AS STRING) AS id", "c_name AS name", "CAST(NULL AS STRING) AS ticker"), source="customer", where="c_custkey % 10 <> 0")
_ANSWERS = f"""a AS (SELECT q.seq, q.candidate_id, q.action, k.status, k.report_id, r.id AS there FROM {_REVIEWS.sql} q LEFT JOIN {CANDIDATES.sql} k ON k.id = q.candidate_id LEFT JOIN {_HELD.sql} r ON r.id = k.report_id),
f AS (SELECT *, min((seq, action)) FILTER ((action = 'promote' AND status = 'pending_review' AND there IS NOT NULL) OR (action = 'reject' AND status IN ('pending_review', 'failed_quality'))) OVER (PARTITION BY candidate_id) AS first FROM a),
answers AS (SELECT *, CASE WHEN status IS NULL THEN 'not_found' WHEN action IS NULL OR action = 'wave' THEN 'unknown_action' WHEN (seq, action) = first THEN replace(action, 'promote', 'approve') || 'd' WHEN action = 'reject' THEN 'not_rejectable'
 WHEN status = 'pending_review' AND there IS NULL AND (first IS NULL OR (seq, action) < first) THEN 'no_report' ELSE 'not_pending' END AS raw FROM f)"""


@query("K8_review_queue", f"SELECT k.id, k.status, r.fiscal_year, r.report_type, c.name AS company FROM {CANDIDATES.sql} k JOIN {_HELD.sql} r ON r.id = k.report_id LEFT JOIN {_LISTED.sql} c ON c.id = r.company_id WHERE k.status = 'pending_review' OR k.status = 'failed_quality'")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates that await a decision, beside their report and company."""
    return Q.review_queue(CANDIDATES.df(spark, sf), _HELD.df(spark, sf), _LISTED.df(spark, sf)).select("id", "status", "fiscal_year", "report_type", "company")


@query("K8_review_answers", f"WITH {_ANSWERS} SELECT seq, candidate_id, replace(raw, 'rejectd', 'rejected') AS answer FROM answers")
def review_answers(spark: SparkSession, sf: str) -> DataFrame:
    """What comes of each promotion and rejection asked for."""
    return Q.answer_reviews(CANDIDATES.df(spark, sf), _HELD.df(spark, sf), _REVIEWS.df(spark, sf)).select("seq", "candidate_id", "answer")


@query("K8_reviewed_reports", f"""WITH {_ANSWERS}, last AS (SELECT report_id, arg_max(candidate_id, seq) AS k FROM answers WHERE raw = 'approved' GROUP BY report_id)
SELECT r.id, CASE WHEN k.id IS NULL THEN r.job_id ELSE k.job_id END AS job_id, CASE WHEN k.id IS NULL THEN r.extracted_json_snapshot ELSE k.extracted_json_snapshot END AS snapshot FROM {_HELD.sql} r LEFT JOIN last l ON l.report_id = r.id LEFT JOIN {CANDIDATES.sql} k ON k.id = l.k""")
def reviewed_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The reports after all reviews."""
    candidates, reports = CANDIDATES.df(spark, sf), _HELD.df(spark, sf)
    answers = Q.answer_reviews(candidates, reports, _REVIEWS.df(spark, sf))
    return Q.apply_reviews(candidates, reports, answers, F.to_timestamp(F.lit(NOW)))[1].select("id", "job_id", F.col("extracted_json_snapshot").alias("snapshot"))


# --- jobs -------------------------------------------------------------------------------------------------------------

_YEAR = "CAST(year(o_orderdate) AS STRING)"
_KIND, _LANG = dealt(("annual", "q1", "semi-annual"), "o_orderkey"), dealt(("en", "en", "lv", "et"), "o_custkey")
_PERIOD = f"CASE WHEN o_orderkey % 19 = 0 THEN 'someday' ELSE {dealt(('FY', 'Q1 ', ' H1 '), 'o_orderkey')} || {_YEAR} END"
_WARNS = "CASE o_custkey % 3 WHEN 0 THEN ', \"qualityWarnings\": [1, \"w\"]' WHEN 1 THEN ', \"qualityWarnings\": [1]' ELSE '' END"
_RAW = f"""CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '{{bad' WHEN 2 THEN '{{"metadata": {{"companyName": "", "reportPeriod": "2024"}}}}' WHEN 3 THEN '{{"duplicateOfReportId": "r' || CASE WHEN o_custkey % 2 = 0 THEN {_ORDER} ELSE 'none' END || '"}}' WHEN 4 THEN '{{"_extractionProgress": 1}}'
 ELSE '{{"metadata": {{"companyName": "A", "reportPeriod": "' || {_PERIOD} || '"}}' || {_WARNS} || '}}' END"""
_ERROR = f"CASE o_orderkey % 4 WHEN 2 THEN 'failed' WHEN 3 THEN NULL ELSE 'Duplicate report: company=' || CASE WHEN o_orderkey % 4 = 0 THEN 'c' || {STRING('o_custkey')} ELSE 'unmatched' END || ', year=' || {_YEAR} || ', type=' || {_KIND} || ', lang=' || {_LANG} END"
_ID = f"CASE WHEN o_orderkey % 3 = 0 THEN 'jr' ELSE 'x' END || {_ORDER}"
#: Jobs whose JSON is null, broken, without names, a pointer, progress, or a filing's; some name their duplicate in the error.
JOBS = Made(
    (
        f"{_ID} AS id", dealt(("complete", "duplicate", "failed", "extracting", "duplicate"), "o_custkey") + " AS state", f"'f' || {_ORDER} || '.pdf' AS original_filename", f"CASE WHEN o_orderkey % 17 = 0 THEN 'xx' ELSE {_LANG} END AS output_language", "'text' AS extracted_text",
        f"{_RAW} AS extracted_json", f"{_ERROR} AS error", f"CASE WHEN o_orderkey % 5 <> 0 THEN 'c' || {STRING('o_custkey')} END AS company_id", "o_orderdate AS created_at", "o_orderdate AS updated_at",
    ),
)
_UPLOADS = Made(
    (
        "o_orderkey AS seq", f"CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' || {_ORDER} ELSE 'new' || {STRING('o_custkey')} END AS id", f"'f' || {STRING('o_custkey')} || " + dealt((".PDF", ".csv", "", ".pdf.exe", ".htm"), "o_orderkey + o_custkey") + " AS original_filename",
        dealt((None, "image/png", "", "text/html", "image/png", "image/png", "application/csv"), "o_custkey") + " AS mime", dealt(("lv", None, "xx", "en"), "o_orderkey + o_custkey") + " AS output_language", dealt(("c1", "", None), "o_custkey") + " AS company_id",
    ),
)


@query("D2_new_jobs", f"""WITH q AS (SELECT * REPLACE (coalesce(id, sha256('job/' || seq || '/' || original_filename)) AS id), coalesce(mime, '') IN ('', 'text/html', 'application/csv') OR regexp_matches(lower(original_filename), '\\.(pdf|csv|htm)$') AS fits FROM {_UPLOADS.sql}),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS turn FROM q WHERE fits)
SELECT id, state, output_language, company_id FROM {JOBS.sql} UNION ALL SELECT id, 'pending', CASE WHEN output_language IN ('lv', 'en') THEN output_language ELSE 'en' END, nullif(company_id, '') FROM n WHERE turn = 1 AND id NOT IN (SELECT id FROM {JOBS.sql})""")
def new_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The jobs after uploads, of which some aren't accepted and some ask for an id that is taken."""
    return Q.create_jobs(JOBS.df(spark, sf), _UPLOADS.df(spark, sf), F.to_timestamp(F.lit(NOW)))[0].select("id", "state", "output_language", "company_id")


@query("K10_job_details", f"SELECT id, state, CASE WHEN state IN ('complete', 'failed') OR (state = 'extracting' AND contains(extracted_json, '_extractionProgress')) THEN extracted_json END AS extracted_json FROM {JOBS.sql}")
def job_details(spark: SparkSession, sf: str) -> DataFrame:
    return Q.job_details(JOBS.df(spark, sf)).select("id", "state", "extracted_json")


_RETRIES = Made(("l_orderkey * 8 + l_linenumber AS seq", f"CASE WHEN l_suppkey % 3 = 0 THEN 'jr' ELSE 'x' END || {STRING('l_orderkey')} AS id"), source="lineitem")


@query("K10_retried_jobs", f"WITH j AS (SELECT *, state = 'failed' AND id IN (SELECT id FROM {_RETRIES.sql}) AS go FROM {JOBS.sql}) SELECT id, CASE WHEN go THEN 'pending' ELSE state END AS state, CASE WHEN NOT go THEN error END AS error, CASE WHEN NOT go THEN extracted_json END AS extracted_json FROM j")
def retried_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return Q.retry_jobs(JOBS.df(spark, sf), _RETRIES.df(spark, sf), F.to_timestamp(F.lit(NOW)))[0].select("id", "state", "error", "extracted_json")


_ASKED = Made((f"CASE WHEN o_custkey % 23 = 0 THEN 'none' ELSE '' END || {_ID} AS job_id",))
_FIRST = f"(SELECT company_id, fiscal_year, report_type, language, min(id) AS id FROM {REPORTS.sql} GROUP BY ALL)"


@query("K10_replacements", f"""WITH j AS (SELECT a.job_id, j.*, CASE WHEN json_valid(extracted_json) THEN extracted_json END AS js FROM {_ASKED.sql} a LEFT JOIN {JOBS.sql} j ON j.id = a.job_id),
m AS (SELECT *, coalesce(js ->> '$.metadata.companyName', '') AS name, trim(coalesce(js ->> '$.metadata.reportPeriod', '')) AS period, len(list_filter(json_extract(js, '$.qualityWarnings[*]'), lambda x: json_type(x) = 'VARCHAR')) AS warns FROM j),
p AS (SELECT *, TRY_CAST(right(period, 4) AS INTEGER) AS year, CASE left(period, 2) WHEN 'FY' THEN 'annual' WHEN 'Q1' THEN 'q1' WHEN 'H1' THEN 'semi-annual' END AS kind FROM m),
r AS (SELECT p.*, f.id AS report FROM p LEFT JOIN {_FIRST} f ON f.company_id IS NOT DISTINCT FROM p.company_id AND f.fiscal_year = p.year AND f.report_type = p.kind AND f.language = p.output_language),
a AS (SELECT *, CASE WHEN id IS NULL THEN 'not_found' WHEN state = 'extracting' THEN 'not_replaceable' WHEN js IS NULL AND extracted_json IS NOT NULL THEN 'no_data' WHEN name = '' OR period = '' THEN 'no_metadata' WHEN kind IS NULL THEN 'no_period' WHEN output_language = 'xx' THEN 'bad_language' WHEN report IS NULL THEN 'no_report' ELSE 'queued' END AS answer FROM r)
SELECT job_id, answer, CASE WHEN answer = 'queued' THEN report END AS report_id, CASE WHEN answer = 'queued' THEN CASE WHEN state = 'failed' OR warns > 0 THEN 'failed_quality' ELSE 'pending_review' END END AS status FROM a""")
def replacements(spark: SparkSession, sf: str) -> DataFrame:
    """Which jobs are queued to replace which report, or why not."""
    return Q.replacements(JOBS.df(spark, sf), _ASKED.df(spark, sf), REPORTS.df(spark, sf), 2024).select("job_id", "answer", "report_id", "status")


_LINKS = Made((f"CASE o_custkey % 4 WHEN 0 THEN 'r' || {_ORDER} WHEN 1 THEN 'jr' || {_ORDER} ELSE {_ID} END AS key",))


@query("K15_found_reports", f"""WITH held AS (SELECT * FROM {_HELD.sql}), l AS (SELECT j.id, p.id AS pointer, min(c.id) AS criteria FROM {JOBS.sql} j LEFT JOIN held p ON p.id = regexp_extract(j.extracted_json, '"duplicateOfReportId": "(\\w+)"', 1)
 LEFT JOIN held c ON c.company_id IS NOT DISTINCT FROM nullif(nullif(regexp_extract(j.error, 'company=(\\w+)', 1), 'unmatched'), '') AND CAST(c.fiscal_year AS VARCHAR) = regexp_extract(j.error, 'year=(\\d+)', 1) AND c.report_type = regexp_extract(j.error, 'type=([\\w-]+)', 1) AND c.language = regexp_extract(j.error, 'lang=(\\w+)', 1) WHERE j.state = 'duplicate' GROUP BY ALL)
SELECT k.key, coalesce(a.id, b.id, l.pointer, l.criteria) AS report_id, CASE WHEN a.id IS NOT NULL THEN 'id' WHEN b.id IS NOT NULL THEN 'job' WHEN l.pointer IS NOT NULL THEN 'pointer' WHEN l.criteria IS NOT NULL THEN 'criteria' END AS by FROM {_LINKS.sql} k LEFT JOIN held a ON a.id = k.key LEFT JOIN held b ON b.job_id = k.key LEFT JOIN l ON l.id = k.key""")
def found_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The report that each shared link or job leads to, and how."""
    return Q.find_reports(_LINKS.df(spark, sf), _HELD.df(spark, sf), JOBS.df(spark, sf))


# --- companies, leads -------------------------------------------------------------------------------------------------

_COMPANIES = Made(("'c' || CAST(c_custkey AS STRING) AS id", "'s' || CAST(c_custkey AS STRING) AS slug", "c_name AS name", "CAST(NULL AS STRING) AS ticker", "'TLN' AS exchange", "'EE' AS country", "c_mktsegment AS sector"), source="customer", where="c_custkey % 3 <> 0")
_CREATED = Made(
    (
        "o_orderkey AS seq", f"CASE WHEN o_orderkey % 20 <> 0 THEN 's' || {STRING('o_custkey')} END AS slug", dealt(("A", "B", "", None, "C"), "o_orderkey") + " AS name", dealt((None, "T", ""), "o_orderkey") + " AS ticker", dealt(("RIG", "TLN", "VLN", ""), "o_orderkey + o_custkey") + " AS exchange",
        dealt(("LV", None), "o_custkey + o_orderkey") + " AS country", "o_orderpriority AS sector",
    ),
)
_GOOD = "slug IS NOT NULL AND coalesce(name, '') <> '' AND exchange <> ''"


@query("K13_companies", f"""WITH q AS (SELECT slug, arg_max({{'name': name, 'ticker': nullif(ticker, ''), 'exchange': exchange, 'country': country, 'sector': sector}}, seq) AS x FROM {_CREATED.sql} WHERE {_GOOD} GROUP BY slug)
SELECT coalesce(c.id, sha256('company/' || q.slug)) AS id, coalesce(c.slug, q.slug) AS slug, {', '.join(f'CASE WHEN q.slug IS NULL THEN c.{f} ELSE q.x.{f} END AS {f}' for f in Q.COMPANY_FIELDS)} FROM {_COMPANIES.sql} c FULL JOIN q ON q.slug = c.slug""")
def companies_after(spark: SparkSession, sf: str) -> DataFrame:
    return Q.create_companies(_COMPANIES.df(spark, sf), _CREATED.df(spark, sf))[0]


@query("K13_company_answers", f"WITH q AS (SELECT *, {_GOOD} AS good FROM {_CREATED.sql}), n AS (SELECT *, row_number() OVER (PARTITION BY slug, good ORDER BY seq) AS turn FROM q) SELECT seq, CASE WHEN NOT coalesce(good, false) THEN 'refused' WHEN turn > 1 OR slug IN (SELECT slug FROM {_COMPANIES.sql}) THEN 'updated' ELSE 'created' END AS answer FROM n")
def company_answers(spark: SparkSession, sf: str) -> DataFrame:
    return Q.create_companies(_COMPANIES.df(spark, sf), _CREATED.df(spark, sf))[1].select("seq", "answer")


_MAPS = Made(("l_orderkey * 8 + l_linenumber AS seq", f"CASE WHEN l_suppkey % 11 = 0 THEN 'x' ELSE 'r' || {STRING('l_orderkey')} END AS report_id", f"CASE l_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'none' ELSE 'c' || {STRING('l_suppkey')} END AS company_id"), source="lineitem")


@query("K13_mapped_reports", f"WITH m AS (SELECT report_id, arg_max(company_id, (seq, company_id)) AS company FROM {_MAPS.sql} WHERE company_id IN (SELECT id FROM {_COMPANIES.sql}) GROUP BY report_id) SELECT r.id, coalesce(m.company, r.company_id) AS company_id FROM {_HELD.sql} r LEFT JOIN m ON m.report_id = r.id")
def mapped_reports(spark: SparkSession, sf: str) -> DataFrame:
    """The reports after reviewers have given some of them a company, several times too."""
    return Q.map_reports(_HELD.df(spark, sf), _COMPANIES.df(spark, sf), _MAPS.df(spark, sf))[0].select("id", "company_id")


_LEADS = Made(("'c' || CAST(c_custkey AS STRING) || '@x.ee' AS email", "'Old' AS company", "c_mktsegment AS use_case", dealt(("hello", None), "c_custkey") + " AS message", dealt((None, "web", "mail"), "c_custkey") + " AS source"), source="customer", where="c_custkey % 3 <> 0")
_POSTS = Made(
    (
        "o_orderkey AS seq", f"CASE o_orderkey % 13 WHEN 0 THEN 'c' || {STRING('o_custkey')} WHEN 1 THEN NULL ELSE ' C' || {STRING('o_custkey')} || '@X.ee ' END AS email", dealt((" Co ", "", None, "B"), "o_orderkey") + " AS company", f"repeat('use ', 31) || {_ORDER} AS use_case",
        dealt((None, " ", "note "), "o_orderkey + o_custkey") + f" || {dealt(('', None), 'o_custkey')} || {_ORDER} AS message", dealt((None, "ad ", ""), "o_orderkey") + " AS source",
    ),
)


@query("K11_captured_leads", f"""WITH q AS (SELECT seq, lower(trim(email)) AS email, nullif(trim(company), '') AS company, left(trim(use_case), 120) AS use_case, nullif(trim(message), '') AS message, nullif(trim(source), '') AS source FROM {_POSTS.sql}),
n AS (SELECT email, arg_max({{'company': company, 'use_case': use_case}}, seq) AS x, arg_max(message, seq) FILTER (message IS NOT NULL) AS message, arg_max(source, seq) FILTER (source IS NOT NULL) AS source FROM q WHERE contains(email, '@') GROUP BY email)
SELECT coalesce(o.email, n.email) AS email, CASE WHEN n.email IS NULL THEN o.company ELSE n.x.company END AS company, CASE WHEN n.email IS NULL THEN o.use_case ELSE n.x.use_case END AS use_case, coalesce(n.message, o.message) AS message, coalesce(n.source, o.source) AS source FROM {_LEADS.sql} o FULL JOIN n ON n.email = o.email""")
def captured_leads(spark: SparkSession, sf: str) -> DataFrame:
    """The leads after forms were sent in, of which some have no email."""
    return Q.capture_leads(_LEADS.df(spark, sf), _POSTS.df(spark, sf))[0]


@query("D14_truncated", "SELECT 'companies' AS name, count(*) AS before, count(*) AS after FROM customer UNION ALL SELECT 'jobs', count(*), 0 FROM orders UNION ALL SELECT 'leads', count(*), count(*) FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT 'report_rerun_candidates', count(*), 0 FROM orders UNION ALL SELECT 'reports', count(*), 0 FROM orders")
def truncated(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each table before and after the jobs are cleared with all that refers to them."""
    tables = {"companies": table(spark, sf, "customer"), "jobs": JOBS.df(spark, sf), "leads": _LEADS.df(spark, sf), "report_rerun_candidates": CANDIDATES.df(spark, sf), "reports": REPORTS.df(spark, sf)}
    after = Q.truncate(tables, ["jobs"], confirm=True)
    counts = [df.agg(F.count(F.lit(1)).alias("before")).crossJoin(after[n].agg(F.count(F.lit(1)).alias("after"))).select(F.lit(n).alias("name"), "before", "after") for n, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
