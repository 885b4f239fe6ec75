"""Metrics of filings, one row each: (doc, ord, label, value, unit, period, snippet, rationale, confidence, ...).

ord is a metric's place in its filing; every rule that says "first" means it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.functions import labels as L
from ledgerline.functions import money as M
from ledgerline.functions.text import normalize_label, word_jaccard, words
from ledgerline.operators.dictionary import listed, per_value

DISTANCE, JACCARD = 3, 0.85


def explode_metrics(reports: DataFrame, doc: str = "id", snapshot: str = "snapshot") -> DataFrame:
    """Rows of the metrics in a snapshot column (schema.SNAPSHOT)."""
    m = F.col("m")
    out = reports.select(F.col(doc).alias("doc"), F.posexplode(f"{snapshot}.metrics").alias("ord", "m"))
    fields = {"label": m["label"], "value": m["value"], "unit": m["unit"], "period": m["period"], "canonical_id": m["canonicalId"], "original_label": m["originalLabel"], "original_unit": m["originalUnit"], "normalized_value": m["normalizedValue"], "normalized_unit": m["normalizedUnit"], "snippet": m["evidence"]["snippet"], "rationale": m["evidence"]["rationale"], "confidence": m["evidence"]["confidence"]}
    return out.select("doc", "ord", *(v.alias(k) for k, v in fields.items()))


def near_labels(a: Column, b: Column) -> Column:
    """Of normalized labels: at most three edits, or nearly the same words."""
    return (F.levenshtein(a, b, DISTANCE) >= 0) | (word_jaccard(a, b) >= JACCARD)


#: Distinct labels up to which each is compared with each other once, for all filings.
LABELS = 500


def _label_places(metrics: DataFrame) -> tuple[DataFrame, list[list[int]]] | None:
    """((label, at), of each place the places of near labels): the places of normalized labels in their order; None if labels are more than LABELS."""
    labels = listed(metrics, ["label"], LABELS)
    if labels is None:
        return None
    a, b = (labels.select(F.col("label").alias(c), normalize_label(F.col("label")).alias(f"key_{c}")) for c in ("a", "b"))
    # every label but null is near itself
    pairs = a.crossJoin(F.broadcast(b)).where(near_labels(F.col("key_a"), F.col("key_b"))).collect()
    at = {k: i for i, k in enumerate(sorted({r.key_a for r in pairs}, key=str.encode))}
    near: list[set[int]] = [set() for _ in at]
    for r in pairs:
        near[at[r.key_b]].add(at[r.key_a])
    return metrics.sparkSession.createDataFrame(list({r.a: at[r.key_a] for r in pairs}.items()), "label string, at int"), [sorted(x) for x in near]


def _clusters(near: list[list[int]]) -> list[int]:
    """Of each place the first place that a chain of near ones leads to: near labels share it."""
    first = list(range(len(near)))

    def top(i: int) -> int:
        while first[i] != i:
            first[i] = i = first[first[i]]
        return i

    for i, others in enumerate(near):
        for j in others:
            a, b = top(i), top(j)
            first[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(near))]


def _slots(places: Sequence[tuple[int, int]]) -> list[int | None] | None:
    """places, (hash, place) each, as a list that is read at the hash modulo its length; None if no such list is found."""
    if len({h for h, _ in places}) < len(places):
        return None
    size = max(1, len(places) ** 2 // 8)
    for n in range(size, size + 10_000):
        slots: list[int | None] = [None] * n
        for h, at in places:
            if slots[h % n] not in (None, at):
                break
            slots[h % n] = at
        else:
            return slots
    return None


def _near_by_rows(x: DataFrame) -> DataFrame:
    """near_pairs() of rows (doc, ord, label) whose labels are too many to compare each with each; words are split once a row."""
    key = normalize_label(F.col("label"))
    x = x.select("doc", "ord", key.alias("key"), words(key).alias("words"))
    a, b = x.alias("a"), x.alias("b").hint("merge")
    p, q = F.size("a.words"), F.size("b.words")
    both = F.size(F.array_intersect("a.words", "b.words"))
    # words can only be as alike as their numbers are
    alike = (F.least(p, q) / F.greatest(p, q) >= JACCARD) & (both / (p + q - both) >= JACCARD)
    near = (F.levenshtein(F.col("a.key"), F.col("b.key"), DISTANCE) >= 0) | alike
    return a.join(b, (F.col("a.doc") == F.col("b.doc")) & (F.col("a.ord") < F.col("b.ord")) & near).select("a.doc", F.col("a.ord").alias("i"), F.col("b.ord").alias("j"))


def near_pairs(metrics: DataFrame) -> DataFrame:
    """(doc, i, j): places i before j of metrics with near labels in a filing.

    Labels are few however many metrics have them, so up to LABELS each is
    compared with each other once, and metrics of a filing meet only within a
    cluster of near labels.  A label's place is read from a list at its hash.
    Metrics may be many more than the size of their source tells, so no side is
    sent through the driver: both are dealt by filing and cluster and merged.
    metrics is read once more for the labels.
    """
    x = metrics.select("doc", "ord", "label").where(F.col("label").isNotNull())
    places = None if x.isStreaming else _label_places(x)
    if places is None:
        return _near_by_rows(x)
    labels, near = places
    hashes = labels.select(F.xxhash64("label"), "at").collect()
    slots = _slots(hashes)
    if slots is None:
        return _near_by_rows(x)
    # no label is unknown here, and what can't be null is not worked out again to look for nulls
    read = lambda values, i: F.coalesce(F.get(F.from_json(F.lit(json.dumps(values)), "array<int>"), i), F.lit(-1))
    at = read(slots, F.pmod(F.xxhash64("label"), F.lit(len(slots))).cast("int"))
    x = x.select("doc", "ord", at.alias("at")).select("*", read(_clusters(near), F.col("at")).alias("cluster"))
    a, b = x.alias("a"), x.alias("b").hint("merge")
    same = (F.col("a.doc") == F.col("b.doc")) & (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.ord") < F.col("b.ord"))
    close = F.array_contains(F.get(F.from_json(F.lit(json.dumps(near)), "array<array<int>>"), F.col("b.at")), F.col("a.at"))
    return a.join(b, same & close).select("a.doc", F.col("a.ord").alias("i"), F.col("b.ord").alias("j"))


def dedup(metrics: DataFrame) -> DataFrame:
    """Merges near labels of a filing, first come first.

    In order, each metric joins the first group whose first label is near its
    own, or starts a group.  The group is shown by its first metric, unless a
    later one has a period where the shown one has none, or a longer one.
    Nearness isn't transitive and is judged against the group's first label
    only, so this is a fold over the filing's metrics, not a component search.
    """
    columns = [c for c in metrics.columns if c != "doc"]
    places = _label_places(metrics)
    if places is None:
        keyed = metrics.withColumn("key_", normalize_label(F.col("label")))
    else:
        labels, near = places
        keyed = metrics.join(F.broadcast(labels.select(F.col("label").alias("label_"), F.col("at").alias("key_"))), F.col("label") == F.col("label_"), "left").drop("label_")
        table = F.from_json(F.lit(json.dumps(near)), "array<array<int>>")

    def firsts(state: Column, x: Column) -> Column:
        """Whether each group's first label is near that of x."""
        if places is None:
            return F.transform(state, lambda g: near_labels(g["key"], x["key_"]))
        # a null label is near none
        heads = F.coalesce(F.get(table, x["key_"]), F.array().cast("array<int>"))
        return F.transform(state, lambda g: F.array_contains(heads, g["key"]))

    row = F.struct("ord", "key_", *(c for c in columns if c != "ord"))
    groups = keyed.groupBy("doc").agg(F.array_sort(F.collect_list(row)).alias("rows_"))
    length = F.transform("rows_", lambda m: F.struct(m["key_"].alias("key_"), F.length(F.coalesce(m["period"], F.lit(""))).alias("long")))
    # the fold carries places of rows, not the rows
    item = f"struct<key: {groups.schema['rows_'].dataType.elementType['key_'].dataType.simpleString()}, best: int, long: int>"

    def fold(state: Column, x: Column) -> Column:
        groups_, n = state["groups"], state["n"] + 1
        at = F.array_position(firsts(groups_, x), F.lit(True))
        one = F.struct(x["key_"].alias("key"), n.alias("best"), x["long"].alias("long"))
        longer = lambda g: F.when(x["long"] > g["long"], F.struct(g["key"].alias("key"), n.alias("best"), x["long"].alias("long"))).otherwise(g)
        merged = F.transform(groups_, lambda g, i: F.when(i + 1 == at, longer(g)).otherwise(g))
        return F.struct(F.when(at > 0, merged).otherwise(F.concat(groups_, F.array(one))).alias("groups"), n.alias("n"))

    start = F.struct(F.array().cast(f"array<{item}>").alias("groups"), F.lit(0).alias("n"))
    kept = groups.select("doc", "rows_", F.aggregate(length, start, fold)["groups"].alias("groups_"))
    kept = kept.select("doc", F.explode(F.transform("groups_", lambda g: F.get("rows_", g["best"] - 1))).alias("best"))
    return kept.select("doc", *(F.col(f"best.{c}") for c in columns))


def first_per_label(metrics: DataFrame) -> DataFrame:
    """Keeps the first of metrics whose labels differ by case and outer space only."""
    own = W.partitionBy("doc", F.lower(F.trim("label"))).orderBy("ord")
    return metrics.withColumn("n_", F.row_number().over(own)).where("n_ = 1").drop("n_")


def drop_empty(metrics: DataFrame) -> DataFrame:
    """Without those that have neither value nor unit."""
    return metrics.where(F.col("value").isNotNull() | (F.length(F.coalesce("unit", F.lit(""))) > 0))


def _label() -> Column:
    return F.coalesce("original_label", "label")


def metric_id() -> Column:
    return F.coalesce("canonical_id", L.canonical_id(_label()))


def with_metric_id(metrics: DataFrame, **more: Column) -> DataFrame:
    """Adds id_, metric_id(), and more facts of the label; the label's words are looked at once for each label."""
    m = with_optional(metrics)
    return per_value(m, ["label", "original_label"], {"id_": L.canonical_id(_label()), **more}).withColumn("id_", F.coalesce("canonical_id", "id_"))


def with_optional(metrics: DataFrame) -> DataFrame:
    """Adds the columns that a filing may lack."""
    for c, t in (("canonical_id", "string"), ("original_label", "string"), ("original_unit", "string"), ("normalized_value", "double"), ("normalized_unit", "string"), ("snippet", "string"), ("rationale", "string"), ("confidence", "double"), ("period", "string"), ("unit", "string")):
        if c not in metrics.columns:
            metrics = metrics.withColumn(c, F.lit(None).cast(t))
    return metrics


def modal_multiplier(metrics: DataFrame, multiplier: Column, least: int = 2) -> DataFrame:
    """(doc, multiplier): the scale most metrics of a filing state, the larger on ties, if ``least`` do."""
    counted = metrics.select("doc", multiplier.alias("multiplier")).where("multiplier > 1").groupBy("doc", "multiplier").count().where(F.col("count") >= least)
    return counted.groupBy("doc").agg(F.max(F.struct("count", "multiplier"))["multiplier"].alias("multiplier"))


def stated_multiplier() -> Column:
    return F.greatest(M.unit_multiplier(F.col("unit")), M.evidence_multiplier(F.col("snippet"), F.col("rationale")))


def with_scales(metrics: DataFrame) -> DataFrame:
    """Adds u_ and e_, the scales that unit and evidence state, s_, the larger one, and euro_, whether the unit is plain euro; worked out once for each text."""
    m = per_value(metrics, ["unit"], {"u_": M.unit_multiplier(F.col("unit")), "euro_": M.is_plain_euro(F.col("unit"))})
    return per_value(m, ["snippet", "rationale"], {"e_": M.evidence_multiplier(F.col("snippet"), F.col("rationale"))}).withColumn("s_", F.greatest("u_", "e_"))


def stated_scales(metrics: DataFrame) -> DataFrame:
    """modal_multiplier() of what units and evidence state."""
    return modal_multiplier(with_scales(with_optional(metrics)), F.col("s_"))


def _by_unit(value: Column, ratio: Column, scale: Column) -> Column:
    """money.by_unit() of what is known of label and unit."""
    return F.when(ratio | ~M.is_finite(value), value).otherwise(value * scale)


def filing_scaled(metrics: DataFrame) -> DataFrame:
    """(doc, ord, value) by the unit, or by the scale that most of the filing's metrics state where a plain euro sum below a million states none."""
    m = with_scales(with_optional(metrics))
    m = per_value(m, ["label"], {"ratio_": F.coalesce(L.is_per_share_or_ratio(F.col("label")), F.lit(False)), "sums_": L.is_aggregate(F.col("label"))})
    m = m.join(modal_multiplier(m, F.col("s_")), "doc", "left")
    v = F.col("value")
    own = _by_unit(v, F.col("ratio_"), F.col("u_"))
    plain = (F.coalesce("multiplier", F.lit(1)) > 1) & F.col("euro_") & F.col("sums_") & (F.abs(own) == F.abs(v)) & (F.abs(v) < 1_000_000)
    return m.select("doc", "ord", F.when(plain, v * F.col("multiplier")).otherwise(own).alias("value"))


def headline_facts() -> dict[str, Column]:
    """What preview() asks of a label: whether it is excluded, and how far it fits each headline figure."""
    fits = lambda of, name: F.coalesce(L.canonical_id(of) == L.HEADLINES[name][0], F.lit(False)) | L.HEADLINES[name][1](of)
    return {"excluded": L.is_excluded(F.col("label")), **{f"rank_{n}": F.when(fits(_label(), n), 1).when(fits(F.col("label"), n), 2) for n in L.HEADLINES}}


def canonicalize(metrics: DataFrame, more: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds canonical_id, original label and unit, and the value in whole euro.

    The value's scale is the unit's; else, of a plain euro amount below a
    million, that of its own evidence, of the evidence two or more metrics of
    the filing agree on, or millions if all sums of the filing look like it.
    What the whole filing says comes from windows over it, one shuffle in all.
    ``more`` are further facts of the label to add, as headline_facts().
    """
    ratio = F.coalesce(L.is_per_share_or_ratio(_label()), F.lit(False))
    m = with_metric_id(with_scales(with_optional(metrics)), label_=_label(), ratio_=ratio, total_=L.is_aggregate(_label()), own_total_=L.is_aggregate(F.col("label")), **(more or {}))
    own = W.partitionBy("doc")
    m = m.withColumn("sum_", M.is_finite(F.col("value")) & F.col("own_total_"))
    scales = (1_000_000_000, 1_000_000, 1_000)
    for s in scales:
        m = m.withColumn(f"n{s}_", F.sum((F.col("e_") == s).cast("int")).over(own))
    best = F.array_max(F.array(*(F.when(F.col(f"n{s}_") >= 2, F.struct(F.col(f"n{s}_").alias("n"), F.lit(s).alias("s"))) for s in scales)))
    m = m.withColumn("filing_", F.coalesce(best["s"], F.lit(1)))
    size = F.when(F.col("sum_"), F.abs("value"))
    m = m.withColumn("sums_", F.count(size).over(own)).withColumn("top_", F.max(size).over(own)).withColumn("broken_", F.max((size != F.floor(size)).cast("int")).over(own)).withColumn("million_", F.max((F.col("s_") == 1_000_000).cast("int")).over(own))
    v, total, ratio = F.col("value"), F.col("total_"), F.col("ratio_")
    compact = F.when(total & (F.col("sums_") >= 3) & (F.col("top_") < 10_000) & ((F.col("broken_") == 1) | (F.col("million_") == 1)), 1_000_000).otherwise(1)
    stated = _by_unit(v, ratio, F.col("u_"))
    guess = F.when(F.col("e_") > 1, v * F.col("e_")).when(F.col("filing_") > 1, v * F.col("filing_")).when(compact > 1, v * compact).otherwise(stated)
    plain = F.col("euro_") & total & (F.abs(v) < 1_000_000)
    value = F.when(~M.is_finite(v) | ratio, v).when(F.abs(stated) != F.abs(v), stated).when(plain, guess).otherwise(stated)
    known = F.col("id_")
    unit = F.when(v.isNull(), None).when((known == "eps") | ratio, F.col("unit")).when(known.isNotNull() & total, "EUR").otherwise(F.col("unit"))
    out = m.withColumn("value_", value).withColumn("unit_", unit)
    out = out.withColumn("original_unit", F.coalesce("original_unit", "unit")).withColumn("original_label", F.col("label_")).withColumn("canonical_id", F.col("id_")).withColumn("normalized_value", F.col("value_")).withColumn("normalized_unit", F.col("unit_"))
    return out.drop(*(c for c in out.columns if c.endswith("_")))


def preview(metrics: DataFrame) -> DataFrame:
    """(doc, revenue, ebitda, net_profit, fcf): the headline figures of canonicalized metrics.

    The first metric with the id, else the first whose original label fits,
    else the first whose label does; goals and figures per share don't count.
    """
    usable = metrics.where("value is not null")
    facts = headline_facts()
    if not set(facts) <= set(metrics.columns):
        usable = per_value(usable, ["label", "original_label"], facts)
    usable = usable.where(~F.col("excluded"))
    value = F.coalesce("normalized_value", "value")
    out = []
    for name, (wanted, _, _) in L.HEADLINES.items():
        rank = F.when(F.col("canonical_id") == wanted, 0).otherwise(F.col(f"rank_{name}"))
        out.append(F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), F.col("ord"), value.alias("value"))))["value"].alias(name))
    return usable.groupBy("doc").agg(*out)


def derive_fcf(metrics: DataFrame) -> DataFrame:
    """Adds free cash flow = operating cash flow - |capital expenditure| per period.

    Both must be in the same unit; the first of each counts.  A free cash flow
    that is stated with confidence 0.7 or more stays, else the derived one,
    which comes last, replaces it.
    """
    known = with_metric_id(metrics)
    ok = M.is_finite(F.col("value"))
    # only rows of the three go by filing, the others stay where they are
    free = F.coalesce(F.col("id_") == "free_cash_flow", F.lit(False))
    m = known.where(free | (F.col("id_").isin("operating_cash_flow", "capex") & ok)).withColumn("p_", F.coalesce(F.nullif(F.trim("period"), F.lit("")), F.lit("__report_period__")))
    row = F.struct("ord", "value", "unit", "period", "snippet", "confidence")
    first = lambda name: F.min(F.when(F.col("id_") == name, row)).alias(name)
    by_period = m.groupBy("doc", "p_").agg(first("operating_cash_flow"), first("capex"), first("free_cash_flow"))
    unit = lambda c: F.lower(F.trim(F.coalesce(f"{c}.unit", F.lit(""))))
    weak = F.coalesce("free_cash_flow.confidence", F.lit(0.0)) < 0.7
    new = by_period.where(F.col("operating_cash_flow").isNotNull() & F.col("capex").isNotNull() & (unit("operating_cash_flow") == unit("capex")) & weak)
    # derived rows stand after all others, in the order of their first part
    place = F.lit(1_000_000) + F.col("operating_cash_flow.ord")
    columns = {"doc": F.col("doc"), "ord": place.cast(metrics.schema["ord"].dataType), "label": F.lit("Free cash flow"), "value": F.col("operating_cash_flow.value") - F.abs("capex.value"), "unit": F.col("operating_cash_flow.unit"), "period": F.coalesce("operating_cash_flow.period", "capex.period"), "canonical_id": F.lit("free_cash_flow"), "confidence": F.lit(0.95)}
    derived = new.select(*(columns.get(c, F.lit(None)).cast(with_optional(metrics).schema[c].dataType).alias(c) for c in with_optional(metrics).columns))
    replaced = new.where("free_cash_flow is not null").select("doc", F.col("free_cash_flow.ord").alias("ord"))
    stay = known.where(~free).unionByName(known.where(free).join(replaced, ["doc", "ord"], "left_anti").select(*known.columns))
    return stay.select(*derived.columns).unionByName(derived)


def key_metrics(metrics: DataFrame, most: int = 4) -> DataFrame:
    """Up to ``most`` metrics to show: headline ids in their order, then labels that name them, then the first with values."""
    v = metrics.where("value is not null")
    low = F.lower("label")
    words = F.lit(10)
    for n, word in reversed(list(enumerate(("revenue", "ebitda", "net profit", "cash flow")))):
        words = F.when(F.contains(low, F.lit(word)), 4 + n).otherwise(words)
    facts = {"words_": words, "low_": F.lower(F.trim("label"))}
    if "canonical_id" in metrics.columns:
        v = per_value(v, ["label", "original_label"], {"id_": L.canonical_id(_label()), **facts}).withColumn("id_", F.coalesce("canonical_id", "id_"))
    else:
        v = per_value(v, ["label"], {"id_": L.canonical_id(F.col("label")), **facts})
    rank = F.col("words_")
    for n, name in enumerate(("revenue", "ebitda", "net_profit", "free_cash_flow")):
        rank = F.when(F.col("id_") == name, n).otherwise(rank)
    one = v.withColumn("rank", rank).withColumn("n_", F.row_number().over(W.partitionBy("doc", "low_").orderBy("rank", "ord"))).where("n_ = 1")
    return one.withColumn("place", F.row_number().over(W.partitionBy("doc").orderBy("rank", "ord"))).where(F.col("place") <= most).drop("n_", "id_", "words_", "low_")
