"""Two reports side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import labels as L
from ledgerline.operators.dictionary import per_value

GUIDANCE_RANK = {"raised": 3, "maintained": 2, "lowered": 1}
PILLAR = 2


def with_metric_key(metrics: DataFrame) -> DataFrame:
    """Adds key: a metric's id, else its label; worked out once for each label."""
    plain = F.trim(F.regexp_replace(F.lower("label"), r"\s+", " "))
    known = per_value(metrics, ["label", "original_label"], {"id_": L.canonical_id(F.coalesce("original_label", "label")), "plain_": plain}).withColumn("id_", F.coalesce("canonical_id", "id_"))
    return known.withColumn("key", F.when(F.col("id_").isNotNull(), F.concat(F.lit("canonical:"), "id_")).otherwise(F.concat(F.lit("label:"), "plain_"))).drop("id_", "plain_")


def pair_metrics(pairs: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row per key of either side: (pair, key, place, label, a, b).

    pairs (pair, a, b) name two docs; metrics has a row each with the value in
    euro.  Of a key that a side has twice, the last counts; keys stand in the
    order they first come, side a before b.
    """
    side = pairs.select("pair", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("doc")), F.struct(F.lit("b").alias("side"), F.col("b").alias("doc")))).alias("s")).select("pair", "s.side", "s.doc")
    rows = side.join(with_metric_key(metrics).withColumn("amount", F.coalesce("normalized_value", "value")), "doc")
    last = lambda s, c: F.max(F.when(F.col("side") == s, F.struct("ord", c)))[c]
    first = F.min(F.struct("side", "ord"))
    label = F.coalesce(last("a", "label"), last("b", "label"))
    grouped = rows.groupBy("pair", "key").agg(first.alias("at"), label.alias("label"), last("a", "amount").alias("a"), last("b", "amount").alias("b"))
    return grouped.withColumn("place", F.row_number().over(W.partitionBy("pair").orderBy("at"))).drop("at")


def _with_name(paired: DataFrame) -> DataFrame:
    known = F.when(F.startswith(F.col("key"), F.lit("canonical:")), F.substring("key", 11, 100))
    return paired.withColumn("metric_id", known).withColumn("name", F.coalesce(L.metric_name(F.col("metric_id")), "label"))


def _direction() -> dict[str, Column]:
    return {"weight": L.weight(F.col("metric_id"), F.col("label")), "higher_better": L.higher_is_better(F.col("metric_id"), F.col("name")), "rank": L.compare_rank(F.col("metric_id"), F.col("name"))}


def with_direction(paired: DataFrame) -> DataFrame:
    """Adds metric_id, name, weight, higher_better and rank."""
    return _with_name(paired).withColumns(_direction())


def _directed(paired: DataFrame) -> DataFrame:
    """with_direction() of a table that is written, worked out once for each key and label."""
    return per_value(_with_name(paired), ["metric_id", "label", "name"], _direction())


def tally(paired: DataFrame, guidance: DataFrame | None = None) -> DataFrame:
    """(pair, score_a, score_b, total): weights of the figures each side is better in.

    Equal figures count for neither side.  guidance (pair, a, b) weighs like a
    pillar; equal guidance counts for both.
    """
    both = (paired if "higher_better" in paired.columns else with_direction(paired)).where(F.col("a").isNotNull() & F.col("b").isNotNull())
    ahead = F.when(F.col("higher_better"), F.col("a") > F.col("b")).otherwise(F.col("a") < F.col("b"))
    behind = F.when(F.col("higher_better"), F.col("a") < F.col("b")).otherwise(F.col("a") > F.col("b"))
    points = both.select("pair", F.when(ahead, F.col("weight")).otherwise(0).alias("x"), F.when(behind, F.col("weight")).otherwise(0).alias("y"), F.col("weight").alias("w"))
    if guidance is not None:
        rank = lambda c: F.coalesce(*(F.when(F.col(c) == k, F.lit(v)) for k, v in GUIDANCE_RANK.items()), F.lit(0))
        g = guidance.select("pair", rank("a").alias("ra"), rank("b").alias("rb")).where((F.col("ra") > 0) | (F.col("rb") > 0))
        points = points.union(g.select("pair", F.when(F.col("ra") >= F.col("rb"), PILLAR).otherwise(0), F.when(F.col("rb") >= F.col("ra"), PILLAR).otherwise(0), F.lit(PILLAR)))
    return points.groupBy("pair").agg(F.sum("x").alias("score_a"), F.sum("y").alias("score_b"), F.sum("w").alias("total"))


def align(pairs: DataFrame, trends: DataFrame, value: str) -> DataFrame:
    """(pair, place, period, a, b): both sides' series on one axis, side a's periods first; gaps are null.

    Of a period that a side has twice, the last value counts.
    """
    side = pairs.select("pair", F.explode(F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("doc")), F.struct(F.lit("b").alias("side"), F.col("b").alias("doc")))).alias("s")).select("pair", "s.side", "s.doc")
    rows = side.join(trends.select("doc", "idx", "period", F.col(value).alias("v")), "doc")
    last = lambda s: F.max(F.when(F.col("side") == s, F.struct("idx", "v")))["v"]
    grouped = rows.groupBy("pair", "period").agg(F.min(F.struct("side", "idx")).alias("at"), last("a").alias("a"), last("b").alias("b"))
    return grouped.withColumn("place", F.row_number().over(W.partitionBy("pair").orderBy("at"))).drop("at")


# Metrics that a review shows first, in this order.
REVIEW_ORDER = ("revenue", "ebitda", "net_profit", "free_cash_flow", "operating_cash_flow", "total_assets", "equity", "liabilities")


def in_review_order(metrics: DataFrame) -> DataFrame:
    """(doc, key, label, place): each metric of a filing once, by its id or its label, those of REVIEW_ORDER first, then by label.

    The first label of a key is shown; labels sort by their lower-case letters'
    code points, then as they are.
    """
    keyed = metrics.withColumn("key", F.coalesce(L.canonical_id(F.col("label")), F.trim(F.lower("label"))))
    one = keyed.groupBy("doc", "key").agg(F.min_by("label", "ord").alias("label"))
    rank = F.coalesce(*(F.when(F.col("key") == k, F.lit(i)) for i, k in enumerate(REVIEW_ORDER)), F.lit(98))
    return one.withColumn("place", F.row_number().over(W.partitionBy("doc").orderBy(rank, F.lower("label"), "label", "key")))


def comparison(pairs: DataFrame, filings: DataFrame) -> DataFrame:
    """(pair, score_a, score_b, total, leader, metrics) of pairs (pair, a, b) of filings (id, snapshot), both of which are there.

    Scores are those of tally(), guidance included; leader is a, b or tie.
    metrics holds each figure of either side once, in the order of a comparison
    and then by name: (name, a, b, percent, better), with the change from a to b
    in per cent of a and the side that is better, null where one has no figure
    or both the same.
    """
    from ledgerline.operators.metrics import canonicalize
    from ledgerline.operators.snapshots import flat_metrics
    from ledgerline.storage import materialize

    known = filings.where("snapshot is not null").select("id", "snapshot")
    side = lambda c: known.select(F.col("id").alias(c), F.col("snapshot.guidance").alias(f"said_{c}"))
    both = pairs.select("pair", "a", "b").join(side("a"), "a").join(side("b"), "b")
    metrics = canonicalize(flat_metrics(known))
    paired = _directed(materialize(pair_metrics(both, metrics), "compared-metrics"))
    scores = tally(paired, both.select("pair", F.col("said_a").alias("a"), F.col("said_b").alias("b")))
    d = paired
    change = F.when(F.col("a") != 0, (F.col("b") - F.col("a")) / F.abs("a") * 100)
    better = F.when(F.col("a") == F.col("b"), None).when((F.col("a") > F.col("b")) == F.col("higher_better"), "a").when(F.col("a").isNotNull() & F.col("b").isNotNull(), "b")
    row = F.struct("rank", F.lower("name").alias("low"), "key", "name", "a", "b", change.alias("percent"), better.alias("better"))
    listed = d.groupBy("pair").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    shown = F.transform("rows", lambda r: F.struct(*(r[c].alias(c) for c in ("name", "a", "b", "percent", "better"))))
    joined = both.select("pair").join(scores, "pair", "left").join(listed, "pair", "left")
    points = {c: F.coalesce(c, F.lit(0)) for c in ("score_a", "score_b", "total")}
    leader = F.when(points["score_a"] > points["score_b"], "a").when(points["score_b"] > points["score_a"], "b").otherwise("tie")
    empty = F.array().cast("array<struct<name: string, a: double, b: double, percent: double, better: string>>")
    return joined.select("pair", *(v.alias(k) for k, v in points.items()), leader.alias("leader"), F.coalesce(shown, empty).alias("metrics"))
