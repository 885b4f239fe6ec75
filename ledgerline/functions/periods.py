"""Report periods: parse, order, name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _period(year: Column, kind: Column) -> Column:
    return F.when(year.isNotNull(), F.struct(year.cast("int").alias("fiscal_year"), kind.alias("report_type")))


def parse_period(text: Column, as_of_year: int) -> Column:
    """struct(fiscal_year, report_type) of "Q1 2024", "FY2024", "9M 2024", "2024-12-31" and so on, or null.

    A quarter without a year is of ``as_of_year``.
    """
    s = F.trim(text)
    quarter = r"(?i)^Q([1-4])\s*(\d{4})$"
    months = r"(?i)^(\d{1,2})M\s*(\d{4})$"
    date = r"^(\d{4})-(\d{2})-(\d{2})$"
    n = _part(s, months, 1).cast("int")
    day = F.concat_ws("-", _part(s, date, 2), _part(s, date, 3))
    alone = _part(s, r"(?i)^Q([1-4])$", 1)
    return F.coalesce(
        _period(_part(s, quarter, 2), F.concat(F.lit("q"), _part(s, quarter, 1))),
        _period(F.when(alone.isNotNull(), F.lit(as_of_year)), F.concat(F.lit("q"), alone)),
        _period(_part(s, r"(?i)^FY\s*(\d{4})$", 1), F.lit("annual")),
        _period(_part(s, r"(?i)^(\d{4})\s*(annual|report)", 1), F.lit("annual")),
        _period(_part(s, r"(?i)^H([12])\s*(\d{4})$", 2), F.lit("semi-annual")),
        _period(_part(s, months, 2), F.when(n == 3, "q1").when(n == 6, "semi-annual").when(n == 9, "q3").otherwise("other")),
        _period(_part(s, date, 1), F.when(day == "12-31", "annual").when(day == "03-31", "q1").when(day == "06-30", "q2").when(day == "09-30", "q3").otherwise("other")),
        _period(_part(s, r"^(\d{4})$", 1), F.lit("annual")),
    )


#: Sorts after every year.
NO_YEAR = 9_007_199_254_740_991
# ASCII word edges, as \b of other engines.
_B, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def period_key(text: Column) -> Column:
    """A long by which period names sort in time."""
    s = F.trim(text)
    year = _part(s, rf"{_B}(\d{{4}}){_E}", 1).cast("long")
    before, after = rf"(?i){_B}Q([1-4])\s*(\d{{4}}){_E}", rf"(?i){_B}(\d{{4}})(?:-\d{{4}})?\s*Q([1-4]){_E}"
    quarter = F.coalesce(_part(s, before, 1), _part(s, after, 2)).cast("long")
    date = rf"{_B}(\d{{4}})-(\d{{2}})(?:-\d{{2}})?{_E}"
    dated, month = _part(s, date, 1).cast("long"), _part(s, date, 2).cast("long")
    of_month = F.when(month <= 3, 1).when(month <= 6, 2).when(month <= 9, 3).otherwise(4)
    return (
        F.when(year.isNull(), F.lit(NO_YEAR))
        .when(quarter.isNotNull(), year * 100 + quarter * 10)
        .when(dated.isNotNull(), dated * 100 + of_month * 10)
        .when(s.rlike(rf"(?i){_B}(H1|1H|6M|half[-\s]?year|semi[-\s]?annual){_E}"), year * 100 + 25)
        .when(s.rlike(rf"(?i){_B}(H2|2H|II\s+poolaasta|second\s+half){_E}"), year * 100 + 50)
        .when(s.rlike(rf"(?i){_B}(9M|nine\s+months|9\s+months){_E}"), year * 100 + 35)
        .otherwise(year * 100 + 99)
    )


def period_label(period: Column, fiscal_year: Column, report_type: Column) -> Column:
    """How a report's period is shown: what the filing says, dates and nothing by year and type."""
    meta = F.nullif(F.trim(F.coalesce(period, F.lit(""))), F.lit(""))
    date = r"^(\d{4})-(\d{2})-\d{2}$"
    is_date = F.coalesce(meta.rlike(date), F.lit(False))
    quarter = _part(report_type, "^q([1-4])$", 1)
    of_month = F.least(F.lit(4), F.greatest(F.lit(1), F.ceil(_part(meta, date, 2).cast("int") / 3)))
    dated = (
        F.when(report_type == "annual", F.concat(F.lit("FY "), fiscal_year.cast("string")))
        .when(quarter.isNotNull(), F.concat(F.lit("Q"), quarter, F.lit(" "), fiscal_year.cast("string")))
        .otherwise(F.concat(F.lit("Q"), of_month.cast("string"), F.lit(" "), _part(meta, date, 1)))
    )
    name = F.when(quarter.isNotNull(), F.concat(F.lit("Q"), quarter)).when(report_type == "semi-annual", F.lit("H1")).when(report_type == "annual", F.lit("FY")).otherwise(report_type)
    return F.when(is_date, dated).when(meta.isNotNull(), meta).otherwise(F.concat_ws(" ", name, fiscal_year.cast("string")))


def first_year(text: Column) -> Column:
    return _part(text, rf"{_B}(20\d{{2}}|19\d{{2}}){_E}", 1)


def years_differ(metric_period: Column, report_period: Column) -> Column:
    a, b = first_year(metric_period), first_year(report_period)
    return F.coalesce(a != b, F.lit(False))


#: Which report of a year says most.
TYPE_RANK = {"annual": 6, "semi-annual": 5, "q4": 4, "q3": 3, "q2": 2, "q1": 1}


def recency(fiscal_year: Column, report_type: Column) -> Column:
    rank = F.lit(0)
    for name, value in TYPE_RANK.items():
        rank = F.when(report_type == name, value).otherwise(rank)
    return fiscal_year * 10 + rank
