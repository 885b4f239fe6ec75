"""Audits and reviews of whole filings: a row holds a filing's snapshot as nested columns, so all rules are row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.labels import canonical_id, compare_rank
from ledgerline.functions.text import SECTIONS, section_name
from ledgerline.operators.matching import mismatches
from ledgerline.operators.snapshots import SNAPSHOT  # noqa: F401  what these rules read

SERIES = ("revenue", "ebitda", "net_profit", "fcf")
# Figures that a filing should have, and how bad an audit's finding is.
CORE = ("revenue", "ebitda", "net_profit", "free_cash_flow")
ISSUES = {
    "company_mismatch": 3, "missing_snapshot": 3, "missing_company_metadata": 3, "missing_report_period_metadata": 3, "zero_metrics": 3, "mostly_null_metrics": 2, "missing_core_metrics": 2,
    "duplicate_trend_periods": 1, "trend_series_length_mismatch": 2, "all_null_trends": 2, "duplicate_revenue_breakdown_entries": 1, "non_canonical_narrative_sections": 1, "missing_executive_summary": 1,
}
MEANINGFUL = 50


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def _twice(names: Column, squeeze: bool) -> Column:
    """Whether a name that isn't blank comes twice, whatever its case and outer spaces."""
    plain = lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " ")) if squeeze else F.lower(F.trim(x))
    own = F.filter(F.transform(names, plain), lambda x: x != "")
    return F.size(own) > F.size(F.array_distinct(own))


def _part_names(parts: Column) -> Column:
    return F.transform(parts, lambda x: x["name"])


def _finite(series: Column) -> Column:
    return F.exists(series, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def issue_codes(snapshot: Column, mismatch: Column) -> Column:
    """The codes that hold, in the order of ISSUES."""
    s = lambda name: snapshot[name]
    trends, metrics, told = s("trends"), s("metrics"), s("narratives")
    n = F.coalesce(F.size(metrics), F.lit(0))
    nulls = F.size(F.filter(metrics, lambda m: m["value"].isNull()))
    have = F.transform(F.filter(metrics, lambda m: m["value"].isNotNull()), lambda m: canonical_id(m["label"]))
    periods = F.coalesce(trends["periods"], F.array().cast("array<string>"))
    lengths = [trends[c].isNotNull() & (F.size(trends[c]) != F.size(periods)) for c in SERIES]
    some = [F.coalesce(_finite(trends[c]), F.lit(False)) for c in SERIES]
    any_of = lambda xs: F.array_contains(F.array(*xs), True)
    names = F.filter(F.transform(told, lambda x: x["section"]), lambda x: F.trim(x) != "")
    rules = {
        "company_mismatch": mismatch,
        "missing_snapshot": snapshot.isNull(),
        "missing_company_metadata": snapshot.isNotNull() & _blank(s("company_name")),
        "missing_report_period_metadata": snapshot.isNotNull() & _blank(s("report_period")),
        "zero_metrics": snapshot.isNotNull() & (n == 0),
        "mostly_null_metrics": (n > 0) & (nulls * 2 >= n),
        "missing_core_metrics": (n > 0) & (F.size(F.array_except(F.array(*map(F.lit, CORE)), have)) > 0),
        "duplicate_trend_periods": _twice(periods, False),
        "trend_series_length_mismatch": trends.isNotNull() & any_of(lengths),
        "all_null_trends": (F.size(periods) > 0) & ~any_of(some),
        "duplicate_revenue_breakdown_entries": F.coalesce(_twice(_part_names(s("breakdown")["segments"]), True), F.lit(False)) | F.coalesce(_twice(_part_names(s("breakdown")["geographies"]), True), F.lit(False)),
        "non_canonical_narrative_sections": F.exists(names, lambda x: ~section_name(x).isin(*SECTIONS)),
        "missing_executive_summary": (F.size(told) > 0) & ~F.exists(told, lambda x: F.coalesce(section_name(x["section"]) == "executive_summary", F.lit(False))),
    }
    assert list(rules) == list(ISSUES)
    return F.array_compact(F.array(*(F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items())))


def audit(reports: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, codes, severity, suggested_company_id) of the reports with any issue; severity is 3 for high, 2, or 1.

    reports (id, company_id, snapshot), companies (id, name, ticker, ord).
    Only the comparison of names is a join; the rest is by row.
    """
    wrong = mismatches(reports.select("id", "company_id", F.col("snapshot.company_name").alias("extracted")), companies)
    joined = reports.join(wrong, "id", "left")
    coded = joined.select("id", issue_codes(F.col("snapshot"), F.col("reason").isNotNull()).alias("codes"), "suggested_company_id")
    level = F.array_max(F.transform("codes", lambda c: F.element_at(F.create_map(*(F.lit(x) for pair in ISSUES.items() for x in pair)), c)))
    return coded.where(F.size("codes") > 0).select("id", "codes", level.alias("severity"), "suggested_company_id")


def audit_report(found: DataFrame) -> DataFrame:
    """(code, reports, severity): how many reports of audit() have each finding."""
    each = found.select("id", F.explode("codes").alias("code"))
    level = F.coalesce(*(F.when(F.col("code") == k, F.lit(v)) for k, v in ISSUES.items()))
    return each.groupBy("code").agg(F.count(F.lit(1)).alias("reports")).withColumn("severity", level)


def has_content(snapshot: Column) -> Column:
    """Whether a filing has a metric or a narrative of more than MEANINGFUL characters."""
    told = F.exists(snapshot["narratives"], lambda x: F.coalesce(F.length(x["text"]) > MEANINGFUL, F.lit(False)))
    return F.coalesce(F.size(snapshot["metrics"]) > 0, F.lit(False)) | F.coalesce(told, F.lit(False))


def kept_series(trends: Column) -> Column:
    """Names of the series that have a value; empty if the section goes, for fewer than two periods or no series."""
    names = F.array_compact(F.array(*(F.when(F.exists(trends[c], lambda x: x.isNotNull()), F.lit(c)) for c in SERIES)))
    return F.when(F.size(trends["periods"]) >= 2, names).otherwise(F.array().cast("array<string>"))


def candidate_status(job_state: Column, warnings: Column) -> Column:
    return F.when((job_state == "failed") | (F.size(warnings) > 0), "failed_quality").otherwise("pending_review")


def warning_texts(raw: Column) -> Column:
    """The strings of a JSON array, without its other values; empty for anything else."""
    elements = F.call_function("try_variant_get", F.try_parse_json(raw), F.lit("$"), F.lit("array<variant>"))
    texts = F.transform(F.filter(elements, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.call_function("try_variant_get", x, F.lit("$"), F.lit("string")))
    return F.coalesce(texts, F.array().cast("array<string>"))


def in_section_order(narratives: Column) -> Column:
    """Narratives by the fixed order of their sections, of each the first, then all others as they come."""
    placed = F.transform(narratives, lambda x, k: F.struct(F.coalesce(F.array_position(F.array(*map(F.lit, SECTIONS)), x["section"]), F.lit(0)).alias("rank"), k.alias("k"), x.alias("item")))
    known = F.array_sort(F.filter(placed, lambda x: x["rank"] > 0))
    first = F.filter(known, lambda x, k: (k == 0) | (F.get(known, k - 1)["rank"] != x["rank"]))
    return F.transform(F.concat(first, F.filter(placed, lambda x: x["rank"] == 0)), lambda x: x["item"])


def ranked_metrics(metrics: Column) -> Column:
    """Metrics by their rank in a comparison, equal ranks as they come."""
    none = F.lit(None).cast("string")
    placed = F.transform(metrics, lambda m, k: F.struct(compare_rank(none, m["label"]).alias("rank"), k.alias("k"), m.alias("item")))
    return F.transform(F.array_sort(placed), lambda x: x["item"])


def evidence_caption(confidence: Column, page: Column, chunk: Column) -> Column:
    """"90% confidence · page 3 · chunk 2"; null if nothing is known."""
    sure = confidence.isNotNull() & ~F.isnan(confidence) & (F.abs(confidence) < float("inf"))
    parts = F.array_compact(
        F.array(
            F.when(sure, F.concat(F.floor(confidence * 100 + 0.5).cast("string"), F.lit("% confidence"))),
            F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(F.lit("page "), page.cast("string"))),
            F.when(chunk.isNotNull(), F.concat(F.lit("chunk "), (chunk + 1).cast("string"))),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, " · "))


def with_history(reports: DataFrame) -> DataFrame:
    """Adds others, how many other reports the company has, and same_year, whether one is of the same year; reports without a company have none."""
    company, year = W.partitionBy("company_id"), W.partitionBy("company_id", "fiscal_year")
    known = F.col("company_id").isNotNull()
    return reports.withColumn("others", F.when(known, F.count(F.lit(1)).over(company) - 1).otherwise(0)).withColumn("same_year", known & (F.count(F.lit(1)).over(year) > 1))


def retry_delay(attempt: Column, chance: Column, status: Column, retry_after: Column, base_ms: int = 1000, max_ms: int = 30_000) -> Column:
    """Milliseconds to wait: doubled each time up to max_ms, a quarter more or less by chance (0 to 1); after 429 what the server asks for, ten minutes at most."""
    wait = F.least(base_ms * F.pow(F.lit(2.0), attempt), F.lit(float(max_ms)))
    backoff = F.floor(wait + wait * 0.25 * (2 * chance - 1) + 0.5)
    asked = F.least(F.greatest(backoff, F.ceil(retry_after * 1000)), F.lit(600_000))
    return F.when((status == 429) & (retry_after > 0), asked).otherwise(backoff).cast("long")


def open_chunks(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks (doc, chunk) still to be read when a run is taken up again."""
    return wanted.join(done.select("doc", "chunk"), ["doc", "chunk"], "left_anti")


def company_reports(reports: DataFrame) -> DataFrame:
    """(company_id, place, id, revenue, ebitda, net_profit, fcf, guidance): each company's reports, newest year first, then by type, with their previews."""
    from ledgerline.operators.completion import previews

    own = W.partitionBy("company_id").orderBy(F.col("fiscal_year").desc(), "report_type", "id")
    placed = reports.select("company_id", "id", F.row_number().over(own).alias("place"), F.col("snapshot.guidance").alias("guidance"))
    return placed.join(previews(reports).withColumnRenamed("doc", "id"), "id", "left").select("company_id", "place", "id", *SERIES, "guidance")
