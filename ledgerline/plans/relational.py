"""Lists, lookups, joins, counts, upserts, and the company dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.periods import period_label
from ledgerline.operators import headline as H
from ledgerline.operators import tables as T
from ledgerline.plans.inputs import ASKED, AUDITED, CANDIDATES, CHOSEN, COMPANIES_SQL, FILINGS_SQL, GONE, LEADS_NEW, LEADS_OLD, MAPPED, MESSAGES, REPORTS, REPORTS_NEW, companies, filings, table
from ledgerline.plans.registry import query

_WITH = f"WITH {COMPANIES_SQL}, {FILINGS_SQL} "


@query("B1_point_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def point_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_totalprice")


@query("B2_null_safe_match", f"SELECT r.id AS report_id, n.id AS new_id FROM {REPORTS.sql} r JOIN {REPORTS_NEW.sql} n ON r.company_id IS NOT DISTINCT FROM n.company_id AND r.fiscal_year = n.fiscal_year AND r.report_type = n.report_type AND r.language = n.language")
def null_safe_match(spark: SparkSession, sf: str) -> DataFrame:
    r, n = REPORTS.df(spark, sf), REPORTS_NEW.df(spark, sf)
    # of the rest of the key a null matches nothing
    rest = ["fiscal_year", "report_type", "language"]
    pairs = T.null_safe_pairs(r.dropna(subset=rest), n.dropna(subset=rest), ["company_id", *rest])
    return pairs.select(F.col("old_id").alias("report_id"), "new_id")


@query("B3_unmatched", f"SELECT id, fiscal_year FROM {REPORTS.sql} r WHERE company_id IS NULL")
def unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return REPORTS.df(spark, sf).where("company_id is null").select("id", "fiscal_year")


@query("B4_optional_filter", "SELECT event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'error') GROUP BY event_type")
def optional_filter(spark: SparkSession, sf: str) -> DataFrame:
    allowed = ("view", "signup", "purchase", "click", "error")
    return T.with_any(table(spark, sf, "events"), "event_type", ["error", "click", "bogus"], allowed).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("B4_no_valid_filter", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def no_valid_filter(spark: SparkSession, sf: str) -> DataFrame:
    return T.with_any(table(spark, sf, "events"), "event_type", ["bogus"], ("view", "click")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("B5_search", _WITH + "SELECT id, company, fiscal_year, report_type FROM filings JOIN companies USING (company_id) WHERE company ILIKE '%00_1%' OR exchange ILIKE '%00_1%' OR CAST(fiscal_year AS VARCHAR) LIKE '00_1%'")
def search(spark: SparkSession, sf: str) -> DataFrame:
    joined = filings(spark, sf).join(companies(spark, sf), "company_id")
    return T.search(joined, " 00_1 ", ["company", "exchange"], ["fiscal_year"]).select("id", "company", "fiscal_year", "report_type")


@query("B5_search_by_year", _WITH + "SELECT id, company FROM filings JOIN companies USING (company_id) WHERE company ILIKE '%1998%' OR CAST(fiscal_year AS VARCHAR) LIKE '1998%'")
def search_by_year(spark: SparkSession, sf: str) -> DataFrame:
    return T.search(filings(spark, sf).join(companies(spark, sf), "company_id"), "1998", ["company"], ["fiscal_year"]).select("id", "company")


@query("B6_relative_time", "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 20 DAY")
def relative_time(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_id", "ts")
    return events.join(F.broadcast(events.agg(F.max("ts").alias("as_of"))), F.col("ts") < F.expr("as_of - INTERVAL 20 DAYS")).select("event_id")


@query("B7_catalogue_filter", f"WITH {COMPANIES_SQL} SELECT company_id, company FROM companies WHERE exchange = 'ASIA' AND (contains(lower(company), '00') OR contains(lower(CAST(company_id AS VARCHAR)), '00'))")
def catalogue_filter(spark: SparkSession, sf: str) -> DataFrame:
    c = companies(spark, sf).where("exchange = 'ASIA'")
    return c.where(F.contains(F.lower("company"), F.lit("00")) | F.contains(F.col("company_id").cast("string"), F.lit("00"))).select("company_id", "company")


@query("B8_option_filter", _WITH + "SELECT id, company || ' · ' || upper(report_type) || ' ' || fiscal_year AS option_label FROM filings JOIN companies USING (company_id) WHERE contains(lower(company || ' · ' || upper(report_type) || ' ' || fiscal_year), 'q3 1999')")
def option_filter(spark: SparkSession, sf: str) -> DataFrame:
    label = F.concat_ws(" · ", "company", F.concat_ws(" ", F.upper("report_type"), F.col("fiscal_year").cast("string")))
    return filings(spark, sf).join(companies(spark, sf), "company_id").select("id", label.alias("option_label")).where(F.contains(F.lower("option_label"), F.lit("q3 1999")))


@query("B9_row_mapping", "SELECT c_custkey AS companyId, c_name AS companyName, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'other') AS sector, coalesce(c_acctbal, 0.0) AS balance FROM customer")
def row_mapping(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("companyId"), F.col("c_name").alias("companyName"), F.coalesce(F.nullif("c_mktsegment", F.lit("MACHINERY")), F.lit("other")).alias("sector"), F.coalesce("c_acctbal", F.lit(0.0)).alias("balance"))


@query("B10_pruned_list", "SELECT event_id, event_type, CASE WHEN event_type IN ('purchase', 'error') THEN props END AS payload FROM events")
def pruned_list(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", "event_type", F.when(F.col("event_type").isin("purchase", "error"), F.col("props")).alias("payload"))


@query("B11_clamped_limit", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500")
def clamped_limit(spark: SparkSession, sf: str) -> DataFrame:
    return T.newest(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 9999)


@query("C1_reports_with_companies", _WITH + "SELECT f.id, c.company, c.exchange FROM filings f LEFT JOIN companies c ON f.company_id = c.company_id AND c.exchange <> 'ASIA'")
def reports_with_companies(spark: SparkSession, sf: str) -> DataFrame:
    return filings(spark, sf).select("id", "company_id").join(companies(spark, sf).where("exchange <> 'ASIA'"), "company_id", "left").select("id", "company", "exchange")


@query("C2_candidates_with_reports", f"SELECT k.id AS candidate_id, k.status, r.id AS report_id, r.fiscal_year, c.c_name AS company FROM {CANDIDATES.sql} k JOIN {REPORTS.sql} r ON k.report_id = r.id LEFT JOIN customer c ON 'c' || c.c_custkey = r.company_id")
def candidates_with_reports(spark: SparkSession, sf: str) -> DataFrame:
    k, r = CANDIDATES.df(spark, sf).select(F.col("id").alias("candidate_id"), "status", "report_id"), REPORTS.df(spark, sf).select(F.col("id").alias("report_id"), "fiscal_year", "company_id")
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("company_id"), F.col("c_name").alias("company"))
    return k.join(r, "report_id").join(c, "company_id", "left").select("candidate_id", "status", "report_id", "fiscal_year", "company")


@query("C3_jobs_with_reports", "SELECT o_orderkey, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R'")
def jobs_with_reports(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return table(spark, sf, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")


@query("C4_reports_per_company", _WITH + "SELECT c.company_id, c.company, (SELECT count(*) FROM filings f WHERE f.company_id = c.company_id AND f.report_type = 'annual') AS reports FROM companies c")
def reports_per_company(spark: SparkSession, sf: str) -> DataFrame:
    n = filings(spark, sf).where("report_type = 'annual'").groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    return companies(spark, sf).join(n, "company_id", "left").select("company_id", "company", F.coalesce("n", F.lit(0)).alias("reports"))


@query("C7_key_list", "SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50)")
def key_list(spark: SparkSession, sf: str) -> DataFrame:
    keys = table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", "p_name").join(keys, "p_partkey", "left_semi")


@query("C8_unknown_slugs", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def unknown_slugs(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(used, "c_custkey", "left_anti")


@query(
    "C14_lookup_chain",
    f"SELECT m.id, coalesce(r.id, regexp_extract(m.message, 'company=(\\w+)', 1)) AS found, CAST(nullif(regexp_extract(m.message, 'year=(\\d+)', 1), '') AS INTEGER) AS fiscal_year, nullif(regexp_extract(m.message, '[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}', 0), '') AS uuid FROM {MESSAGES.sql} m LEFT JOIN {REPORTS.sql} r ON r.id = 'r' || (m.id * 2)",
)
def lookup_chain(spark: SparkSession, sf: str) -> DataFrame:
    m, r = MESSAGES.df(spark, sf), REPORTS.df(spark, sf).select(F.col("id").alias("rid"))
    part = lambda p, g: F.nullif(F.regexp_extract("message", p, g), F.lit(""))
    joined = m.join(r, F.col("rid") == F.concat(F.lit("r"), (F.col("id") * 2).cast("string")), "left")
    return joined.select("id", F.coalesce("rid", F.regexp_extract("message", r"company=(\w+)", 1)).alias("found"), part(r"year=(\d+)", 1).cast("int").alias("fiscal_year"), part("[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", 0).alias("uuid"))


@query("C15_report_or_job", f"SELECT id FROM {REPORTS.sql} r WHERE id = 'r2' OR (job_id = 'r2' AND NOT EXISTS (SELECT 1 FROM {REPORTS.sql} x WHERE x.id = 'r2'))")
def report_or_job(spark: SparkSession, sf: str) -> DataFrame:
    r = REPORTS.df(spark, sf)
    either = r.where("id = 'r2'").select("id", F.lit(0).alias("p")).union(r.where("job_id = 'r2'").select("id", F.lit(1)))
    return either.withColumn("best", F.min("p").over(W.partitionBy(F.lit(1)))).where("p = best").select("id")


@query(
    "C16_previous_report",
    _WITH + "SELECT a.id, arg_max(b.id, b.score) AS previous FROM filings a JOIN filings b ON a.company_id = b.company_id AND b.report_type <> 'annual' AND b.score < a.score WHERE a.report_type <> 'annual' GROUP BY a.id",
)
def previous_report(spark: SparkSession, sf: str) -> DataFrame:
    f = H.with_recency(filings(spark, sf)).where("report_type <> 'annual'")
    before = F.lag("id").over(W.partitionBy("company_id").orderBy("score"))
    return f.withColumn("previous", before).where("previous is not null").select("id", "previous")


@query("D3_partial_update", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def partial_update(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    changes = c.where("c_custkey % 10 < 3").select("c_custkey", F.when(F.col("c_custkey") % 10 == 1, "NEW").alias("c_mktsegment"), (F.col("c_custkey") % 10 < 2).alias("set_c_mktsegment"))
    return T.patch(c, changes, "c_custkey", ["c_mktsegment"])


_LEADS = f"SELECT coalesce(n.email, o.email) AS email, {{}} FROM {LEADS_OLD.sql} o FULL JOIN {LEADS_NEW.sql} n ON o.email = n.email"


@query("D4_upsert_overwrite", _LEADS.format("CASE WHEN n.email IS NOT NULL THEN n.company ELSE o.company END AS company, CASE WHEN n.email IS NOT NULL THEN n.role ELSE o.role END AS role, CASE WHEN n.email IS NOT NULL THEN n.message ELSE o.message END AS message"))
def upsert_overwrite(spark: SparkSession, sf: str) -> DataFrame:
    return T.upsert(LEADS_OLD.df(spark, sf), LEADS_NEW.df(spark, sf), ["email"], overwrite=["company", "role", "message"])


@query("D5_upsert_fill", _LEADS.format("coalesce(n.company, o.company) AS company, coalesce(n.role, o.role) AS role, coalesce(n.message, o.message) AS message"))
def upsert_fill(spark: SparkSession, sf: str) -> DataFrame:
    return T.upsert(LEADS_OLD.df(spark, sf), LEADS_NEW.df(spark, sf), ["email"], fill=["company", "role", "message"])


@query("D6_upsert_mixed", _LEADS.format("coalesce(n.company, o.company) AS company, CASE WHEN n.email IS NOT NULL THEN n.role ELSE o.role END AS role, CASE WHEN o.email IS NULL THEN n.message ELSE o.message END AS message"))
def upsert_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return T.upsert(LEADS_OLD.df(spark, sf), LEADS_NEW.df(spark, sf), ["email"], overwrite=["role"], fill=["company"])


@query("D4_upsert_customers", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer UNION ALL SELECT c_custkey + 1000000, 1.0 FROM customer WHERE c_custkey % 7 = 0")
def upsert_customers(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(0.0).alias("c_acctbal")).union(c.where("c_custkey % 7 = 0").select(F.col("c_custkey") + 1_000_000, F.lit(1.0)))
    return T.upsert(c, new, ["c_custkey"], overwrite=["c_acctbal"])


_UNIQUE = f"""SELECT n.id, n.company_id IS NULL OR (NOT EXISTS (SELECT 1 FROM {REPORTS.sql} r WHERE r.company_id = n.company_id AND r.fiscal_year = n.fiscal_year AND r.report_type = n.report_type AND r.language = n.language)
 AND row_number() OVER (PARTITION BY company_id, fiscal_year, report_type, language ORDER BY n.id) = 1) AS inserted FROM {REPORTS_NEW.sql} n"""


@query("D8_insert_unique", _UNIQUE)
def insert_unique(spark: SparkSession, sf: str) -> DataFrame:
    yes, no = T.insert_unique(REPORTS.df(spark, sf), REPORTS_NEW.df(spark, sf), ["company_id", "fiscal_year", "report_type", "language"], [F.col("id")])
    return yes.select("id", F.lit(True).alias("inserted")).union(no.select("id", F.lit(False)))


@query(
    "D9_promote",
    f"SELECT r.id, coalesce(k.job_id, r.job_id) AS job_id, coalesce(k.s3_key, r.s3_key) AS s3_key, coalesce(k.extracted_json_snapshot, r.extracted_json_snapshot) AS extracted_json_snapshot FROM {REPORTS.sql} r LEFT JOIN (SELECT * FROM {CANDIDATES.sql} WHERE status = 'pending_review' AND id IN (SELECT id FROM {CHOSEN.sql})) k ON k.report_id = r.id",
)
def promote(spark: SparkSession, sf: str) -> DataFrame:
    _, reports = T.promote(CANDIDATES.df(spark, sf), REPORTS.df(spark, sf), CHOSEN.df(spark, sf), F.to_timestamp(F.lit("2024-02-01")))
    return reports.select("id", "job_id", "s3_key", "extracted_json_snapshot")


@query("D10_reject", f"SELECT id, CASE WHEN id IN (SELECT id FROM {CHOSEN.sql}) AND status IN ('pending_review', 'failed_quality') THEN 'rejected' ELSE status END AS status FROM {CANDIDATES.sql}")
def reject(spark: SparkSession, sf: str) -> DataFrame:
    return T.reject(CANDIDATES.df(spark, sf), CHOSEN.df(spark, sf)).select("id", "status")


@query("D11_set_company", f"SELECT r.id, CASE WHEN m.id IS NOT NULL THEN m.company_id ELSE r.company_id END AS company_id FROM {REPORTS.sql} r LEFT JOIN {MAPPED.sql} m ON m.id = r.id")
def set_company(spark: SparkSession, sf: str) -> DataFrame:
    return T.set_company(REPORTS.df(spark, sf), MAPPED.df(spark, sf)).select("id", "company_id")


@query("D12_move_to_unmatched", f"SELECT id, CASE WHEN id NOT IN (SELECT id FROM {ASKED.sql}) OR id NOT IN (SELECT id FROM {AUDITED.sql}) THEN company_id END AS company_id FROM {REPORTS.sql}")
def move_to_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return T.move_to_unmatched(REPORTS.df(spark, sf), AUDITED.df(spark, sf), ASKED.df(spark, sf), confirm=True)[0].select("id", "company_id")


@query("D13_cascade", f"SELECT id FROM {CANDIDATES.sql} WHERE report_id NOT IN (SELECT id FROM {GONE.sql})")
def cascade(spark: SparkSession, sf: str) -> DataFrame:
    return T.delete_reports(REPORTS.df(spark, sf), CANDIDATES.df(spark, sf), GONE.df(spark, sf))[1].select("id")


@query("E1_counts", _WITH + "SELECT (SELECT count(*) FROM companies) AS companies, (SELECT count(*) FROM filings) AS reports")
def counts(spark: SparkSession, sf: str) -> DataFrame:
    return companies(spark, sf).agg(F.count(F.lit(1)).alias("companies")).join(F.broadcast(filings(spark, sf).agg(F.count(F.lit(1)).alias("reports"))))


@query("E4_table_counts", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'supplier', count(*) FROM supplier")
def table_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = None
    for name in ("customer", "events", "orders", "part", "supplier"):
        one = table(spark, sf, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")).select("name", "n")
        out = one if out is None else out.union(one)
    return out


@query("E5_by_exchange", _WITH + "SELECT exchange, count(DISTINCT company_id) AS companies, count(f.id) AS reports FROM companies LEFT JOIN filings f USING (company_id) GROUP BY exchange")
def by_exchange(spark: SparkSession, sf: str) -> DataFrame:
    n = filings(spark, sf).groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    return companies(spark, sf).join(n, "company_id", "left").groupBy("exchange").agg(F.count(F.lit(1)).alias("companies"), F.coalesce(F.sum("n"), F.lit(0)).alias("reports"))


@query("E22_shares", _WITH + """, parts AS (SELECT exchange, company, sum(r) AS r FROM filed JOIN companies USING (company_id) WHERE report_type = 'annual' GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY exchange ORDER BY r DESC, company) AS rank, sum(r) OVER (PARTITION BY exchange) AS t FROM parts)
SELECT exchange, company, CAST(rank AS INTEGER) AS rank, round(CAST(r AS DOUBLE) / CAST(t AS DOUBLE), 9) AS share, round(CAST(sum(CASE WHEN rank <= 3 THEN r END) OVER (PARTITION BY exchange) AS DOUBLE) / CAST(t AS DOUBLE), 9) AS top3 FROM ranked""")
def shares(spark: SparkSession, sf: str) -> DataFrame:
    annual = filings(spark, sf).where("report_type = 'annual'").join(companies(spark, sf), "company_id")
    parts = annual.groupBy("exchange", "company").agg(F.sum(F.col("revenue").cast("decimal(20,4)")).cast("double").alias("r"))
    return H.shares(parts, "exchange", "company", "r").select("exchange", "company", "rank", F.round("share", 9).alias("share"), F.round("top3", 9).alias("top3"))


@query("F1_recency", _WITH + "SELECT id, CAST(score AS INTEGER) AS score FROM filings")
def recency_scores(spark: SparkSession, sf: str) -> DataFrame:
    return H.with_recency(filings(spark, sf)).select("id", "score")


_HEAD = _WITH + """, newest AS (SELECT company_id, arg_max(id, (score, id)) AS nid, arg_max(fiscal_year, (score, id)) AS ny, arg_max(id, (score, id)) FILTER (report_type = 'annual') AS aid, arg_max(fiscal_year, (score, id)) FILTER (report_type = 'annual') AS ay FROM filings GROUP BY company_id),
latest AS (SELECT f.* FROM newest n JOIN filings f ON f.company_id = n.company_id AND f.id = CASE WHEN n.aid IS NOT NULL AND n.ny - n.ay < 2 THEN n.aid ELSE n.nid END),
head AS (SELECT l.company_id, l.id AS latest, l.revenue AS now, arg_max(f.id, (f.score, f.id)) AS previous, arg_max(f.revenue, (f.score, f.id)) AS before FROM latest l LEFT JOIN filings f ON f.company_id = l.company_id AND f.score < l.score AND (l.report_type <> 'annual' OR f.report_type = 'annual') GROUP BY ALL) """


@query("F2_F3_headline", _HEAD + "SELECT company_id, latest, previous FROM head")
def headline_reports(spark: SparkSession, sf: str) -> DataFrame:
    return H.headline(filings(spark, sf)).select("company_id", F.col("latest.id").alias("latest"), F.col("previous.id").alias("previous"))


@query("K6_dashboard_headline", _HEAD + "SELECT company_id, company, exchange, latest, now AS revenue, before AS previous_revenue, round((now - before) / abs(before) * 100, 6) AS percent FROM head JOIN companies USING (company_id)")
def dashboard_headline(spark: SparkSession, sf: str) -> DataFrame:
    heads = H.headline(filings(spark, sf))
    yoy = H.year_on_year(heads, "revenue").join(heads.select("company_id", F.col("latest.id").alias("latest")), "company_id")
    return yoy.join(companies(spark, sf), "company_id").select("company_id", "company", "exchange", "latest", F.col("now").alias("revenue"), F.col("before").alias("previous_revenue"), F.round("percent", 6).alias("percent"))


@query("F4_trend_reports", _WITH + """, t AS (SELECT *, max(CASE WHEN report_type = 'annual' AND company_id % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY company_id) AS has, row_number() OVER (PARTITION BY company_id, fiscal_year ORDER BY score DESC, id) AS n FROM filings WHERE company_id % 2 = 0 OR report_type <> 'annual')
SELECT id, revenue FROM t WHERE CASE WHEN has = 1 THEN report_type = 'annual' ELSE n = 1 END""")
def trend_reports(spark: SparkSession, sf: str) -> DataFrame:
    # companies with odd numbers have no annual reports here
    return H.trend_reports(filings(spark, sf).where("company_id % 2 = 0 or report_type <> 'annual'")).select("id", "revenue")


@query("G26_period_labels", _WITH + "SELECT id, CASE WHEN fiscal_year % 2 = 0 THEN (CASE WHEN report_type = 'annual' THEN 'FY ' || fiscal_year ELSE upper(report_type) || ' ' || fiscal_year END) ELSE 'as filed' END AS period_label FROM filings")
def period_labels(spark: SparkSession, sf: str) -> DataFrame:
    given = F.when(F.col("fiscal_year") % 2 == 1, "as filed").when(F.col("fiscal_year") % 4 == 0, F.concat(F.col("fiscal_year").cast("string"), F.lit("-06-30")))
    return filings(spark, sf).select("id", period_label(given, F.col("fiscal_year"), F.col("report_type")).alias("period_label"))


@query("H1_by_exchange_and_name", f"WITH {COMPANIES_SQL} SELECT row_number() OVER (ORDER BY exchange, company) AS place, company_id FROM companies")
def by_exchange_and_name(spark: SparkSession, sf: str) -> DataFrame:
    return T.numbered(companies(spark, sf), "exchange", "company").select(F.col("place").cast("long").alias("place"), "company_id")


@query("H2_company_reports", _WITH + "SELECT id, row_number() OVER (PARTITION BY company_id ORDER BY fiscal_year DESC, report_type) AS place FROM filings")
def company_reports(spark: SparkSession, sf: str) -> DataFrame:
    return filings(spark, sf).select("id", F.row_number().over(W.partitionBy("company_id").orderBy(F.col("fiscal_year").desc(), "report_type")).cast("long").alias("place"))


@query("H3_recent_orders", "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 8")
def recent_orders(spark: SparkSession, sf: str) -> DataFrame:
    return T.newest(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 8).select("o_orderkey")


@query("H4_nulls_last", _WITH + "SELECT id, company FROM (SELECT f.id, c.company, f.fiscal_year, f.report_type FROM filings f LEFT JOIN companies c ON f.company_id = c.company_id AND c.exchange = 'EUROPE') ORDER BY company NULLS LAST, fiscal_year DESC, report_type, id LIMIT 200")
def nulls_last(spark: SparkSession, sf: str) -> DataFrame:
    c = companies(spark, sf).where("exchange = 'EUROPE'").select("company_id", "company")
    return filings(spark, sf).join(c, "company_id", "left").orderBy(F.col("company").asc_nulls_last(), F.col("fiscal_year").desc(), "report_type", "id").limit(T.clamp_limit(None)).select("id", "company")


@query("K5_stats", _WITH + "SELECT (SELECT count(*) FROM companies) AS companies, CASE WHEN count(*) > 70 THEN '70+' ELSE CAST(count(*) AS VARCHAR) END AS reports FROM filings")
def stats(spark: SparkSession, sf: str) -> DataFrame:
    n = filings(spark, sf).agg(F.count(F.lit(1)).alias("n"))
    return companies(spark, sf).agg(F.count(F.lit(1)).alias("companies")).join(F.broadcast(n)).select("companies", F.when(F.col("n") > 70, "70+").otherwise(F.col("n").cast("string")).alias("reports"))


@query("K1_company_list", _WITH + "SELECT c.company_id, c.company, c.exchange, count(f.id) AS reports FROM companies c LEFT JOIN filings f USING (company_id) GROUP BY ALL")
def company_list(spark: SparkSession, sf: str) -> DataFrame:
    n = filings(spark, sf).groupBy("company_id").agg(F.count(F.lit(1)).alias("n"))
    return companies(spark, sf).join(n, "company_id", "left").select("company_id", "company", "exchange", F.coalesce("n", F.lit(0)).alias("reports"))
