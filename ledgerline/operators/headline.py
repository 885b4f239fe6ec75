"""Headline reports, what came before them, and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.money import change, is_finite
from ledgerline.functions.periods import recency

CORE = ("revenue", "ebitda", "net_profit")


def with_recency(reports: DataFrame) -> DataFrame:
    return reports.withColumn("score", recency(F.col("fiscal_year"), F.col("report_type")))


def usable(reports: DataFrame) -> DataFrame:
    """Reports with one of the core figures."""
    present = [is_finite(F.col(c)) for c in CORE if c in reports.columns]
    some = present[0] if present else F.lit(True)
    for p in present[1:]:
        some = some | p
    return reports.where(some)


def headline(reports: DataFrame) -> DataFrame:
    """(company_id, latest, previous): structs of the columns of reports.

    latest is the last annual report, or the newest report if that is two years
    newer; previous is the annual report before it, or the newest older report.
    Of equally recent ones the larger id counts as newer.  One shuffle by
    company serves all steps.
    """
    columns = [c for c in reports.columns if c != "company_id"]
    own = W.partitionBy("company_id")
    row = F.struct("score", "id", *(c for c in columns if c != "id"))
    ranked = with_recency(usable(reports)).withColumn("row_", row)
    annual = F.when(F.col("report_type") == "annual", F.col("row_"))
    marked = ranked.withColumn("newest_", F.max("row_").over(own)).withColumn("annual_", F.max(annual).over(own))
    fresh = F.col("annual_").isNotNull() & (F.col("newest_.fiscal_year") - F.col("annual_.fiscal_year") < 2)
    chosen = marked.withColumn("latest_", F.when(fresh, F.col("annual_")).otherwise(F.col("newest_")))
    is_annual = F.col("latest_.report_type") == "annual"
    before = F.when(is_annual, (F.col("report_type") == "annual") & (F.col("row_") < F.col("latest_"))).otherwise(F.col("score") < F.col("latest_.score"))
    return chosen.groupBy("company_id").agg(F.max("latest_").alias("latest"), F.max(F.when(before, F.col("row_"))).alias("previous"))


def trend_reports(reports: DataFrame) -> DataFrame:
    """All annual reports of a company that has one, else the best of each year; of equal ones the first id."""
    own, year = W.partitionBy("company_id"), W.partitionBy("company_id", "fiscal_year")
    ranked = with_recency(reports).withColumn("annual_", F.max((F.col("report_type") == "annual").cast("int")).over(own))
    first = ranked.withColumn("n_", F.row_number().over(year.orderBy(F.col("score").desc(), "id")))
    return first.where(F.when(F.col("annual_") == 1, F.col("report_type") == "annual").otherwise(F.col("n_") == 1)).drop("annual_", "n_", "score")


def year_on_year(headlines: DataFrame, measure: str) -> DataFrame:
    """(company_id, latest, previous, percent) of one measure."""
    now, before = F.col(f"latest.{measure}"), F.col(f"previous.{measure}")
    return headlines.select("company_id", now.alias("now"), before.alias("before"), change(now, before).alias("percent"))


def shares(parts: DataFrame, group: str, name: str, value: str) -> DataFrame:
    """parts with share, rank by size, and what the three largest of the group have together, in per cent."""
    own = W.partitionBy(group)
    size = F.abs(F.col(value))
    ranked = parts.withColumn("rank", F.row_number().over(own.orderBy(size.desc(), name)))
    total = F.sum(value).over(own)
    top = F.sum(F.when(F.col("rank") <= 3, F.col(value))).over(own)
    return ranked.withColumn("share", F.try_divide(F.col(value), total)).withColumn("top3", F.try_divide(top, total))
