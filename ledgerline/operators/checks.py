"""Gates and audits: each gives rows (doc, code) of what is wrong."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.labels import canonical_id
from ledgerline.functions.money import is_finite
from ledgerline.functions.periods import first_year
from ledgerline.operators.dictionary import per_value
from ledgerline.operators.metrics import metric_id, with_metric_id

CONFIDENT = 0.6
HEADLINE = ("revenue", "ebitda", "net_profit", "free_cash_flow")
CORE = (*HEADLINE, "operating_cash_flow", "capex")
CORE_WORDS = r"(?i)revenue|sales|turnover|ebitda|net\s+(profit|income)|profit\s+for\s+the\s+period|(?<![A-Za-z0-9_])fcf(?![A-Za-z0-9_])|free\s+cash\s+flow|operating\s+cash\s+flow|cash\s+flow\s+from\s+operating|(?<![A-Za-z0-9_])capex(?![A-Za-z0-9_])|capital\s+expenditure"
# How bad an audit's finding is.
SEVERITY = {
    "high": ("missing_snapshot", "company_mismatch", "missing_core_metrics", "mostly_null_metrics", "no_metrics"),
    "medium": ("trend_length_mismatch", "empty_trends", "duplicate_trend_periods", "missing_executive_summary"),
    "low": ("non_canonical_sections", "duplicate_breakdown_names", "missing_company", "sanity"),
}


def _blank(c: str | Column) -> Column:
    return F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))) == ""


def codes(df: DataFrame, keys: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """A row for each rule that holds: (keys, code)."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules.items())))
    return df.select(*keys, F.explode(found).alias("code"))


def low_confidence() -> Column:
    return is_finite(F.col("confidence")) & (F.col("confidence") < CONFIDENT)


def headline_issues(metrics: DataFrame, filings: DataFrame) -> DataFrame:
    """(doc, ord, code) of headline metrics with a value: what their evidence lacks.  filings (doc, report_period)."""
    year = lambda df, c, name: per_value(df, [c], {name: first_year(F.col(c))})
    m = with_metric_id(year(metrics, "period", "year_")).where(F.col("id_").isin(*HEADLINE) & is_finite(F.col("value"))).join(year(filings, "report_period", "own_year_"), "doc")
    rules = {
        "missing_snippet": _blank("snippet"),
        "missing_unit": _blank("unit") & _blank("normalized_unit"),
        "missing_period": _blank("period") & _blank("report_period"),
        "period_mismatch": F.col("year_") != F.col("own_year_"),
        "low_confidence": low_confidence(),
    }
    return codes(m, ["doc", "ord"], rules)


def quality_gate(filings: DataFrame, metrics: DataFrame, narratives: DataFrame) -> DataFrame:
    """(doc, code) of filings (doc, company, report_period, company_confidence, period_confidence) that don't pass.

    Every finding keeps a filing out: the gate's own, and those of headline_issues().
    """
    m = with_metric_id(metrics, says_core=F.coalesce("original_label", "label").rlike(CORE_WORDS))
    number = is_finite(F.col("value"))
    core = number & (F.coalesce(F.col("id_").isin(*CORE), F.lit(False)) | F.col("says_core"))
    stats = m.groupBy("doc").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(number).alias("numbers"), F.count_if(F.col("value").isNull()).alias("nulls"), F.count_if(core).alias("cores"), F.count_if(core & low_confidence()).alias("unsure")
    )
    told = narratives.groupBy("doc").agg(F.max((F.length(F.trim("text")) > 50).cast("int")).alias("told"))
    f = filings.join(stats, "doc", "left").join(told, "doc", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rules = {
        "missing_company_name": _blank("company"),
        "missing_report_period": _blank("report_period"),
        "no_metrics": n("n") == 0,
        "no_numeric_metrics": (n("n") > 0) & (n("numbers") == 0),
        "mostly_null_metrics": (n("n") > 0) & (n("nulls") * 2 >= n("n")),
        "no_core_metric": n("cores") == 0,
        "low_company_confidence": is_finite(F.col("company_confidence")) & (F.col("company_confidence") < CONFIDENT),
        "low_period_confidence": is_finite(F.col("period_confidence")) & (F.col("period_confidence") < CONFIDENT),
        "low_core_confidence": n("unsure") > 0,
        "nothing_told": (n("told") == 0) & (n("numbers") < 2),
    }
    issues = headline_issues(metrics, filings.select("doc", "report_period")).select("doc", F.concat(F.lit("headline_"), F.col("code")).alias("code")).distinct()
    return codes(f, ["doc"], rules).union(issues)


def _without_own(filings: DataFrame, history: DataFrame) -> DataFrame:
    """(doc, usual, annual): median revenue of the company's other documents, and the most of its annual ones of the same year.

    A median without one row lies among the three middle ones of all rows, so a
    ranking per company and its middle are enough and no pairs are made.
    """
    size = F.abs("revenue")
    ranked = history.where(size > 0).select("doc", "company_id", size.alias("size"), F.row_number().over(W.partitionBy("company_id").orderBy(size, "doc")).alias("rank"))
    counts = ranked.groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).withColumn("low", F.floor((F.col("n") - 1) / 2))
    near = ranked.join(counts, "company_id").where(F.col("rank").between(F.col("low"), F.col("low") + 2))
    middle = near.groupBy("company_id").agg(F.first("n").alias("n"), *(F.max(F.when(F.col("rank") == F.col("low") + k, F.col("size"))).alias(f"v{k}") for k in range(3)), F.first("low").alias("low"))
    own = ranked.select("doc", "company_id", F.col("rank").alias("own"))
    f = filings.select("doc", "company_id", "fiscal_year").join(middle, "company_id", "left").join(own, ["doc", "company_id"], "left")
    others = F.col("n") - F.col("own").isNotNull().cast("int")

    def at(k: Column) -> Column:
        """The k-th of the others."""
        place = k + F.coalesce((k >= F.col("own")).cast("int"), F.lit(0)) - F.col("low")
        return F.when(place == 0, F.col("v0")).when(place == 1, F.col("v1")).when(place == 2, F.col("v2"))

    half = F.floor(others / 2)
    usual = F.when(others % 2 == 1, at(half + 1)).when(others > 0, (at(half) + at(half + 1)) / 2)
    annual = history.where("report_type = 'annual'").select("company_id", "fiscal_year", F.col("doc").alias("other"), size.alias("size"))
    two = annual.withColumn("k", F.row_number().over(W.partitionBy("company_id", "fiscal_year").orderBy(F.col("size").desc_nulls_last(), "other"))).where("k <= 2")
    best = two.groupBy("company_id", "fiscal_year").agg(*(F.max(F.when(F.col("k") == k, F.struct("other", "size"))).alias(f"a{k}") for k in (1, 2)))
    joined = f.withColumn("usual", usual).join(best, ["company_id", "fiscal_year"], "left")
    return joined.select("doc", "usual", F.when(F.col("a1.other") != F.col("doc"), F.col("a1.size")).otherwise(F.col("a2.size")).alias("annual"))


def sanity(filings: DataFrame, balance: DataFrame, history: DataFrame) -> DataFrame:
    """(doc, code): figures that can't be on one scale.

    filings (doc, company_id, fiscal_year, report_type, revenue, net_profit,
    fcf), balance (doc, value) of assets, equity and liabilities, history
    (doc, company_id, fiscal_year, report_type, revenue) of any documents; a
    filing is not its own history.
    """
    known = balance.where(F.col("value") > 0).groupBy("doc").agg(F.median("value").alias("balance"), F.count(F.lit(1)).alias("balances"))
    past = _without_own(filings, history)
    f = filings.join(known, "doc", "left").join(past, "doc", "left")
    size = F.abs("revenue")
    ratio = lambda x, y: F.try_divide(F.abs(x), y)
    scale, jump = ratio(F.col("balance"), size), ratio(F.col("revenue"), F.col("usual"))
    rules = {
        "net_profit_exceeds_revenue": ratio(F.col("net_profit"), size) > 2,
        "cash_flow_exceeds_revenue": ratio(F.col("fcf"), size) > 3,
        "balance_sheet_scale_mismatch": (F.col("revenue") > 0) & (F.col("balances") >= 2) & ((scale > 100) | (scale < 0.01)),
        "history_extreme_change": (F.col("revenue") > 0) & ((jump > 10) | (jump < 0.1)),
        "semi_annual_exceeds_annual": (F.col("report_type") == "semi-annual") & (size > 1.5 * F.col("annual")),
    }
    return codes(f, ["doc"], rules)


def missing_core(metrics: DataFrame, core: Sequence[str] = ("revenue", "net_profit")) -> DataFrame:
    """(doc, missing): core ids that no metric with a value has."""
    have = F.array_distinct(F.collect_list(F.when(F.col("value").isNotNull(), metric_id() if "canonical_id" in metrics.columns else canonical_id(F.col("label")))))
    return metrics.groupBy("doc").agg(F.array_except(F.array(*map(F.lit, core)), have).alias("missing"))


def repeated(df: DataFrame, keys: Sequence[str], name: Column) -> DataFrame:
    """(keys, name, n) of names that come more than once."""
    return df.withColumn("name_", name).groupBy(*keys, F.col("name_").alias("name")).count().withColumnRenamed("count", "n").where("n > 1")


def severity(code: Column) -> Column:
    return F.when(code.isin(*SEVERITY["high"]), 3).when(code.isin(*SEVERITY["medium"]), 2).otherwise(1)


def worst(found: DataFrame) -> DataFrame:
    """(doc, n, severity) of rows (doc, code), most severe first, then most findings."""
    return found.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.max(severity(F.col("code"))).alias("severity")).orderBy(F.col("severity").desc(), F.col("n").desc(), "doc")


def histogram(found: DataFrame) -> DataFrame:
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def period_years(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("year", first_year(F.col(column)))
