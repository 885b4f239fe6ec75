"""Repair of whole filings: what it merges and drops, counted for each filing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import parse_amount
from ledgerline.functions.text import canonical_section, section_name
from ledgerline.operators.dictionary import per_value
from ledgerline.operators.metrics import drop_empty, first_per_label
from ledgerline.operators.records import SERIES, implausible_changes, merge_breakdown, merge_periods


def _metrics(metrics: DataFrame) -> DataFrame:
    first = first_per_label(metrics)
    kept = drop_empty(first).groupBy("doc").agg(F.count(F.lit(1)).alias("metrics"))
    counts = metrics.groupBy("doc").agg(F.count(F.lit(1)).alias("all_")).join(first.groupBy("doc").agg(F.count(F.lit(1)).alias("first_")), "doc").join(kept, "doc", "left")
    n = F.coalesce("metrics", F.lit(0))
    return counts.select("doc", (F.col("all_") - F.col("first_")).alias("duplicate_labels"), (F.col("first_") - n).alias("dropped_metrics"))


def _narratives(narratives: DataFrame) -> DataFrame:
    given = F.coalesce(F.nullif(F.trim("section"), F.lit("")), F.lit("other"))
    told = narratives.where(F.trim("text") != "").select("doc", given.alias("given"))
    renamed = section_name(F.col("given")) != canonical_section(F.col("given"))
    named = per_value(told, ["given"], {"renamed": renamed, "section": canonical_section(F.col("given"))})
    return named.groupBy("doc").agg(F.count_distinct(F.when(F.col("renamed"), F.col("given"))).alias("renamed_sections"), F.max(F.col("section") == "executive_summary").alias("summary_"))


def _breakdown(parts: DataFrame) -> DataFrame:
    merged = merge_breakdown(parts.withColumn("value", parse_amount(F.col("value"))))
    kinds = merged.groupBy("doc", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("merged").alias("merged"))
    counts = kinds.groupBy("doc").agg(F.max("n").alias("n"), F.sum("merged").alias("merged_parts"))
    return parts.select("doc").distinct().join(counts, "doc", "left").select("doc", "merged_parts", (F.coalesce("n", F.lit(0)) < 2).alias("breakdown_dropped"))


def _trends(trends: DataFrame) -> DataFrame:
    merged = merge_periods(trends)
    empty = sum(((F.count(c) == 0).cast("int") for c in SERIES), F.lit(0))
    counts = merged.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum("merged").alias("merged_periods"), empty.alias("empty_"))
    kept = F.coalesce((F.col("n") >= 2) & (F.col("empty_") < len(SERIES)), F.lit(False))
    joined = trends.select("doc").distinct().join(counts, "doc", "left").join(implausible_changes(merged).withColumnRenamed("n", "wild_"), "doc", "left")
    return joined.select("doc", "merged_periods", (~kept).alias("trends_dropped"), F.when(kept, F.col("empty_")).alias("empty_series"), F.when(kept, F.col("wild_")).alias("implausible_changes"))


def sanitize(filings: DataFrame, metrics: DataFrame, trends: DataFrame, breakdown: DataFrame, narratives: DataFrame) -> DataFrame:
    """(doc, counts...) of every filing (doc): what its repair merges, renames and drops.

    Labels that differ by case and outer space only count once, and metrics
    with neither value nor unit go.  A breakdown goes unless a kind has two
    parts after equal names are summed; trends go with fewer than two periods
    or without any value.  Series without a value and wild changes are counted
    in the trends that stay.  A filing without a part has zero of it, and
    nothing of it is dropped; without narratives its summary is missing.  All
    is grouped by filing, so the joins share one partitioning.
    """
    f = filings.select("doc")
    for part in (_metrics(metrics), _narratives(narratives), _breakdown(breakdown), _trends(trends)):
        f = f.join(part, "doc", "left")
    counts = ("duplicate_labels", "dropped_metrics", "renamed_sections", "merged_parts", "merged_periods", "empty_series", "implausible_changes")
    flags = {"missing_summary": ~F.coalesce("summary_", F.lit(False)), "breakdown_dropped": F.coalesce("breakdown_dropped", F.lit(False)), "trends_dropped": F.coalesce("trends_dropped", F.lit(False))}
    return f.select("doc", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), *(v.alias(k) for k, v in flags.items()))
