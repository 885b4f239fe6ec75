"""Repair and merge of the other parts of a filing: trends, breakdowns, narratives, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions.money import is_finite, parse_amount
from ledgerline.functions.periods import period_key
from ledgerline.functions.text import canonical_section, chart_label, normalize_label, section_name
from ledgerline.operators.dictionary import per_value

SERIES = ("revenue", "ebitda", "net_profit", "fcf")
SCALES = (1, 1_000, 1_000_000)


def fit_length(series: Column, n: Column) -> Column:
    """A series cut or filled with nulls to n values."""
    return F.slice(F.concat(series, F.array_repeat(F.lit(None).cast("double"), n)), F.lit(1), n)


def merge_periods(trends: DataFrame) -> DataFrame:
    """(doc, idx, period, series...) with each period once: the first place, and of each series the first value there is."""
    clean = trends.withColumn("period", F.trim("period")).where("period <> ''")
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("idx", c)))[c].alias(c)
    return clean.groupBy("doc", "period").agg(F.min("idx").alias("idx"), *(first(c) for c in SERIES), (F.count(F.lit(1)) - 1).alias("merged"))


def merge_chunks_trends(trends: DataFrame) -> DataFrame:
    """Of each period all values of the first chunk that has it: rows (doc, chunk, idx, period, series...)."""
    own = W.partitionBy("doc", "period").orderBy("chunk", "idx")
    return trends.withColumn("n_", F.row_number().over(own)).where("n_ = 1").drop("n_")


def sorted_trends(trends: DataFrame) -> DataFrame:
    """Adds place: 1 for the earliest period of a filing."""
    own = W.partitionBy("doc").orderBy("key_", "idx")
    return trends.withColumn("key_", period_key(F.col("period"))).withColumn("place", F.row_number().over(own)).drop("key_")


def forward_fill(trends: DataFrame, series: str) -> DataFrame:
    """The last known value at each place; nothing before the first one."""
    until = W.partitionBy("doc").orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    return trends.withColumn(series, F.last(series, ignorenulls=True).over(until)).where(F.col(series).isNotNull())


def implausible_changes(trends: DataFrame, most: float = 500.0) -> DataFrame:
    """(doc, n): neighbouring values of revenue, EBITDA and net profit that differ by more than ``most`` per cent."""
    own = W.partitionBy("doc").orderBy("idx")
    wild = F.lit(0)
    marked = trends
    for c in SERIES[:3]:
        marked = marked.withColumn(f"{c}_", F.lag(c).over(own))
        before = F.col(f"{c}_")
        wild = wild + F.when((before != 0) & (F.abs(F.try_divide(F.col(c) - before, F.abs(before)) * 100) > most), 1).otherwise(0)
    return marked.groupBy("doc").agg(F.sum(wild).alias("n"))


def series_change(trends: DataFrame, series: str) -> DataFrame:
    """(doc, percent): change between the last two known values."""
    known = trends.where(F.col(series).isNotNull()).withColumn("n_", F.row_number().over(W.partitionBy("doc").orderBy(F.col("idx").desc()))).where("n_ <= 2")
    at = lambda n: F.max(F.when(F.col("n_") == n, F.col(series)))
    return known.groupBy("doc").agg(at(1).alias("now"), at(2).alias("before")).select("doc", F.when(F.col("before") != 0, (F.col("now") - F.col("before")) / F.abs("before") * 100).alias("percent"))


def goals_of(targets: DataFrame) -> DataFrame:
    """(doc, and of each of SERIES the array of its targets): targets (doc, series, target) by filing; zeros and nulls are none."""
    of = lambda c: F.collect_list(F.when(F.col("series") == c, F.col("target"))).alias(c)
    return targets.where("target <> 0").groupBy("doc").agg(*map(of, SERIES))


def _with_goals(trends: DataFrame, goals: DataFrame, how: str) -> DataFrame:
    """Adds of each of SERIES best_, the scale that brings its value nearest to one of its goals, behind how near that is and idx.

    The rows stay as wide as they come, so a filing's rows are dealt once for all series.
    """
    joined = trends.join(goals.select("doc", *(F.col(c).alias(f"goals_{c}") for c in SERIES)), "doc", how)

    def best(c: str) -> Column:
        value = F.col(c)
        tries = lambda goal: F.array(*(F.struct(F.abs(F.log(F.abs(value * s) / F.abs(goal))).alias("d"), F.col("idx"), F.lit(s).alias("multiplier")) for s in SCALES))
        return F.when(value != 0, F.array_min(F.flatten(F.transform(f"goals_{c}", tries))))

    return joined.withColumns({f"best_{c}": best(c) for c in SERIES}).drop(*(f"goals_{c}" for c in SERIES))


def series_multiplier(trends: DataFrame, targets: DataFrame) -> DataFrame:
    """(doc, series, multiplier): the scale that brings a value of the series nearest to the headline figure.

    targets (doc, series, target).  Nearest is by ratio; of equal ones the first
    value, then the smaller scale.
    """
    found = _with_goals(trends.select("doc", "idx", *SERIES), goals_of(targets), "inner").groupBy("doc").agg(*(F.min(f"best_{c}")["multiplier"].alias(c) for c in SERIES))
    return found.select("doc", _long("multiplier")).where("multiplier is not null")


def _long(value: str) -> Column:
    return F.expr(f"stack({len(SERIES)}, {', '.join(f"'{c}', {c}" for c in SERIES)}) as (series, {value})")


def scaled_trends(trends: DataFrame, goals: DataFrame, filing: DataFrame) -> DataFrame:
    """trends with SERIES in whole euro; goals as of goals_of(), a row a filing, filing (doc, multiplier).

    The scale of a series is that of series_multiplier().  A series without one
    takes the one most series of the filing have, the larger on ties; without
    any, small values take the filing's stated scale.  In a series of thousands
    that also holds values of 100,000 and more, values below 1,000 are millions.
    """
    joined = _with_goals(trends, goals, "left").join(filing.select("doc", F.col("multiplier").alias("stated_")), "doc", "left")
    own = W.partitionBy("doc")
    facts = {}
    for c in SERIES:
        size = F.abs(c)
        facts[f"scale_{c}"] = F.min(f"best_{c}").over(own)["multiplier"]
        facts[f"mixed_{c}"] = (F.max(size).over(own) >= 100_000) & (F.min(F.when(size > 0, size)).over(own) < 1_000)
    marked = joined.withColumns(facts)
    known = F.filter(F.array(*(F.col(f"scale_{c}") for c in SERIES)), lambda x: x.isNotNull())
    marked = marked.withColumn("known_", known).withColumn("common_", F.array_max(F.transform("known_", lambda x: F.struct(F.size(F.filter("known_", lambda y: y == x)).alias("n"), x.alias("x"))))["x"])

    def euro(c: str) -> Column:
        value, size, scale = F.col(c), F.abs(c), F.coalesce(f"scale_{c}", "common_")
        return (
            F.when((scale == 1_000) & F.col(f"mixed_{c}") & (size > 0) & (size < 1_000), value * 1_000_000)
            .when(scale.isNotNull(), value * scale)
            .when((F.coalesce("stated_", F.lit(1)) > 1) & (size < 1_000_000), value * F.col("stated_"))
            .otherwise(value)
        )

    return marked.select(*((euro(c).alias(c) if c in SERIES else F.col(c)) for c in trends.columns))


def scaled_series(trends: DataFrame, targets: DataFrame, filing: DataFrame) -> DataFrame:
    """(doc, idx, period, series, value): scaled_trends() by targets (doc, series, target), a row a value."""
    scaled = scaled_trends(trends.select("doc", "idx", "period", *SERIES), goals_of(targets), filing)
    return scaled.select("doc", "idx", "period", _long("value"))


def merge_breakdown(parts: DataFrame) -> DataFrame:
    """(doc, kind, ord, name, value, merged): entries whose names read the same are summed under the first name.

    Rows need a name and a finite value.
    """
    named = per_value(parts.withColumn("name", F.trim("name")), ["name"], {"key_": chart_label(F.col("name"))})
    clean = named.where((F.col("name") != "") & is_finite(F.col("value")))
    return clean.groupBy("doc", "kind", "key_").agg(F.min("ord").alias("ord"), F.min_by("name", "ord").alias("name"), F.sum("value").alias("value"), (F.count(F.lit(1)) - 1).alias("merged")).drop("key_")


def chunk_breakdown(parts: DataFrame) -> DataFrame:
    """Over chunks the first value of each normalized name, which also is the new name."""
    own = W.partitionBy("doc", "kind", "name").orderBy("chunk", "ord")
    named = parts.withColumn("name", normalize_label(F.col("name")))
    return named.withColumn("n_", F.row_number().over(own)).where("n_ = 1").drop("n_")


def chartable_breakdown(parts: DataFrame) -> DataFrame:
    """Rows of filings in which some kind has two entries or more."""
    own = W.partitionBy("doc")
    counted = parts.withColumn("n_", F.count(F.lit(1)).over(W.partitionBy("doc", "kind"))).withColumn("most_", F.max("n_").over(own))
    return counted.where("most_ >= 2").drop("n_", "most_")


def breakdown_segments(parts: DataFrame, scales: DataFrame, revenue: DataFrame) -> DataFrame:
    """(doc, kind, ord, name, value) in whole euro, of the segments, or else of the regions.

    Values come as text; per cents, zeros and nameless parts don't count, and
    neither do parts that add up to about 100.  The scale is the one of 1,
    1,000, 1,000,000 and the filing's stated one (scales: doc, multiplier) that
    brings the total nearest to revenue (doc, revenue); a total off by more
    than five times is none.
    """
    clean = parts.withColumn("value", parse_amount(F.col("value"))).where((F.col("value") != 0) & (F.trim("name") != ""))
    own, all_kinds = W.partitionBy("doc", "kind"), W.partitionBy("doc")
    chosen = clean.withColumn("k_", F.max((F.col("kind") == "segment").cast("int")).over(all_kinds)).where((F.col("kind") == "segment") | (F.col("k_") == 0))
    size = F.abs("value")
    summed = chosen.withColumn("total_", F.sum(size).over(own)).withColumn("top_", F.max(size).over(own)).where(~(F.col("total_").between(95, 105) & (F.col("top_") <= 100)))
    joined = summed.join(scales, "doc", "left").join(revenue, "doc", "left")
    stated = F.coalesce("multiplier", F.lit(1)).cast("long")
    goal = F.abs("revenue")
    tries = F.array_sort(F.array_distinct(F.array(*(F.lit(s).cast("long") for s in SCALES), stated)))
    best = F.array_min(F.transform(tries, lambda s: F.struct(F.abs(F.log(F.col("total_") * s / goal)).alias("d"), s.alias("s"))))["s"]
    scale = F.when(goal > 0, best).otherwise(stated)
    ratio = F.when(goal > 0, F.col("total_") * scale / goal)
    return joined.where(ratio.isNull() | ratio.between(0.2, 5)).select("doc", "kind", "ord", "name", (F.col("value") * scale).alias("value"))


def merge_narratives(narratives: DataFrame) -> DataFrame:
    """(doc, section, ord, text, renamed): texts of a canonical section joined by an empty line, in order."""
    clean = narratives.withColumn("text", F.trim("text")).where("text <> ''").withColumn("given_", F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.lit("other")))
    named = clean.withColumn("section", canonical_section(F.col("given_"))).withColumn("new_", (section_name(F.col("given_")) != F.col("section")).cast("int"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n\n")
    return named.groupBy("doc", "section").agg(F.min("ord").alias("ord"), texts.alias("text"), F.sum("new_").alias("renamed"))


def chunk_narratives(narratives: DataFrame) -> DataFrame:
    """(doc, section, text): texts of a section over chunks, one a line."""
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "ord", "text"))), lambda x: x["text"]), "\n")
    return narratives.groupBy("doc", "section").agg(texts.alias("text"))


def chunk_metadata(chunks: DataFrame) -> DataFrame:
    """(doc, company, period): of the first chunk with a company name, else of the first."""
    named = F.when(F.length(F.coalesce("company", F.lit(""))) > 0, 0).otherwise(1)
    return chunks.groupBy("doc").agg(F.min(F.struct(named.alias("n"), "chunk", "company", "period")).alias("x")).select("doc", "x.company", "x.period")


def chunk_risks(risks: DataFrame) -> DataFrame:
    """(doc, risks): the distinct risks of all chunks in the order they come."""
    first = risks.groupBy("doc", "risk").agg(F.min(F.struct("chunk", "ord")).alias("at"))
    return first.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "risk"))), lambda x: x["risk"]).alias("risks"))
