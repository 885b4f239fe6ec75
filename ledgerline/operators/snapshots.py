"""Filings as nested rows: read from JSON, repaired, summed up, taken apart into texts and put together again.

Everything but the joins with other tables is an expression over one row's
arrays, so nothing is exploded or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.money import is_finite, parse_amount
from ledgerline.functions.text import canonical_section, chart_label, first_distinct, section_name, strip

_PART = "array<struct<name: string, value: double>>"
SERIES = ("revenue", "ebitda", "net_profit", "fcf")
_METRIC = "struct<label: string, value: double, unit: string, period: string, snippet: string, confidence: double>"
_NARRATIVE = "struct<section: string, text: string>"
_TRENDS = "struct<periods: array<string>, revenue: array<double>, ebitda: array<double>, net_profit: array<double>, fcf: array<double>>"
#: A filing; any part of it may be null.
SNAPSHOT = (
    f"struct<company_name: string, report_period: string, language: string, metrics: array<{_METRIC}>, narratives: array<{_NARRATIVE}>, tone: string, outlook: string, risks: array<string>, guidance: string, "
    f"breakdown: struct<segments: {_PART}, geographies: {_PART}>, trends: {_TRENDS}>"
)
WARNINGS = (
    "struct<duplicate_labels: array<string>, dropped_metrics: int, renamed_sections: array<string>, missing_summary: boolean, merged_parts: int, breakdown_dropped: boolean, "
    "series_refitted: int, merged_periods: int, empty_series: array<string>, trends_dropped: boolean, implausible_changes: int, chart_warnings: array<string>>"
)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _or_empty(value: Column, kind: str) -> Column:
    return F.coalesce(value, _empty(kind))


# --- JSON -------------------------------------------------------------------------------------------------------------


def _get(value: Column, path: str, kind: str) -> Column:
    return F.call_function("try_variant_get", value, F.lit(path), F.lit(kind))


def _text(value: Column, path: str) -> Column:
    """A string; null for anything else."""
    found = _get(value, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", _get(found, "$", "string"))


def _number(value: Column, path: str) -> Column:
    """A number, or what a string like "1,200" says; null for anything else."""
    found = _get(value, path, "variant")
    kind = F.schema_of_variant(found)
    number = F.when(kind == "STRING", parse_amount(_get(found, "$", "string"))).when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), _get(found, "$", "double"))
    return F.when(is_finite(number), number)


def _list(value: Column, path: str, item) -> Column:
    """item of each entry; null if there is no array."""
    return F.transform(_get(value, path, "array<variant>"), item)


def _texts(value: Column, path: str) -> Column:
    return _list(value, path, lambda x: _text(x, "$"))


def _has(value: Column, path: str) -> Column:
    """Whether there is such a member, other than null."""
    return F.coalesce(F.schema_of_variant(_get(value, path, "variant")) != "VOID", F.lit(False))


def _kind(raw: Column) -> Column:
    parsed = F.try_parse_json(raw)
    shape = F.schema_of_variant(parsed)
    member = _has(parsed, "$.metadata") | _has(parsed, "$.metrics")
    return F.when(parsed.isNull(), "not_json").when(~F.startswith(shape, F.lit("OBJECT")), "not_an_object").when(~F.coalesce(member, F.lit(False)), "no_snapshot")


def parse_snapshot(raw: Column) -> Column:
    """SNAPSHOT of a JSON text, or null if the text is no snapshot.

    A snapshot is an object with ``metadata`` or ``metrics``; what a job writes
    of its progress, other values and broken texts are none.  Members of
    another type than theirs are null, numbers may come as text.
    """
    v = F.try_parse_json(raw)
    metric = lambda m: F.struct(_text(m, "$.label").alias("label"), _number(m, "$.value").alias("value"), _text(m, "$.unit").alias("unit"), _text(m, "$.period").alias("period"), _text(m, "$.evidence.snippet").alias("snippet"), _number(m, "$.evidence.confidence").alias("confidence"))
    part = lambda x: F.struct(_text(x, "$.name").alias("name"), _number(x, "$.value").alias("value"))
    series = lambda path: _list(v, path, lambda x: _number(x, "$"))
    breakdown = F.struct(_list(v, "$.revenueBreakdown.bySegment", part).alias("segments"), _list(v, "$.revenueBreakdown.byGeography", part).alias("geographies"))
    trends = F.struct(_texts(v, "$.profitabilityTrends.periods").alias("periods"), *(series(f"$.profitabilityTrends.{path}").alias(c) for c, path in zip(SERIES, ("revenue", "ebitda", "netProfit", "freeCashFlow"))))
    whole = F.struct(
        _text(v, "$.metadata.companyName").alias("company_name"), _text(v, "$.metadata.reportPeriod").alias("report_period"), _text(v, "$.metadata.outputLanguage").alias("language"), _list(v, "$.metrics", metric).alias("metrics"),
        _list(v, "$.narratives", lambda x: F.struct(_text(x, "$.section").alias("section"), _text(x, "$.text").alias("text"))).alias("narratives"), _text(v, "$.sentiment.managementTone").alias("tone"), _text(v, "$.sentiment.outlook").alias("outlook"), _texts(v, "$.sentiment.riskFactors").alias("risks"),
        _text(v, "$.sentiment.guidanceDirection").alias("guidance"), F.when(_has(v, "$.revenueBreakdown"), breakdown).alias("breakdown"), F.when(_has(v, "$.profitabilityTrends"), trends).alias("trends"),
    )
    return F.when(raw.isNotNull() & _kind(raw).isNull(), whole.cast(SNAPSHOT))


def rejected_snapshots(rows: DataFrame, raw: str) -> DataFrame:
    """Rows whose JSON text is there but no snapshot, with the reason."""
    return rows.where(F.col(raw).isNotNull()).withColumn("reason", _kind(F.col(raw))).where(F.col("reason").isNotNull())


# --- repair -----------------------------------------------------------------------------------------------------------


def _narratives(told: Column) -> Column:
    """struct(items, renamed, summary): texts of a canonical section joined by an empty line, sections as they first come."""
    items = F.filter(_or_empty(told, f"array<{_NARRATIVE}>"), lambda x: F.coalesce(strip(x["text"]) != "", F.lit(False)))
    given = F.transform(items, lambda x: F.struct(F.coalesce(F.nullif(strip(x["section"]), F.lit("")), F.lit("other")).alias("given"), strip(x["text"]).alias("text")))
    named = F.transform(given, lambda x: F.struct(x["given"].alias("given"), canonical_section(x["given"]).alias("section"), x["text"].alias("text")))

    def merged(named: Column) -> Column:
        sections = F.array_distinct(F.transform(named, lambda x: x["section"]))
        text = lambda s: F.array_join(F.transform(F.filter(named, lambda x: x["section"] == s), lambda x: x["text"]), "\n\n")
        renamed = F.array_distinct(F.transform(F.filter(named, lambda x: section_name(x["given"]) != x["section"]), lambda x: x["given"]))
        return F.struct(F.transform(sections, lambda s: F.struct(s.alias("section"), text(s).alias("text"))).alias("items"), renamed.alias("renamed"), F.array_contains(sections, "executive_summary").alias("summary"))

    return _let(named, merged)


def _metrics(metrics: Column) -> Column:
    """struct(items, repeated, dropped): each label once, whatever its case, and none with neither value nor unit."""

    def kept(metrics: Column) -> Column:
        def by_label(labels: Column) -> Column:
            is_first = lambda i: F.array_position(labels, F.element_at(labels, i + 1)) == i + 1
            first = F.filter(metrics, lambda m, i: is_first(i))
            full = F.filter(first, lambda m: m["value"].isNotNull() | (F.coalesce(m["unit"], F.lit("")) != ""))
            repeated = F.transform(F.filter(metrics, lambda m, i: ~is_first(i)), lambda m: F.coalesce(m["label"], F.lit("")))
            return F.struct(full.alias("items"), repeated.alias("repeated"), (F.size(first) - F.size(full)).alias("dropped"))

        return _let(F.transform(metrics, lambda m: strip(F.lower(F.coalesce(m["label"], F.lit(""))))), by_label)

    return _let(_or_empty(metrics, f"array<{_METRIC}>"), kept)


def _parts(parts: Column) -> Column:
    """struct(items, merged): parts whose names read the same are summed under the first name; those without name or number go."""
    clean = F.filter(_or_empty(parts, _PART), lambda x: F.coalesce(strip(x["name"]) != "", F.lit(False)) & is_finite(x["value"]))
    keyed = F.transform(clean, lambda x: F.struct(strip(x["name"]).alias("name"), x["value"].alias("value"), chart_label(strip(x["name"])).alias("key")))

    def summed(keyed: Column) -> Column:
        keys = F.transform(keyed, lambda x: x["key"])
        of = lambda k: F.filter(keyed, lambda x: x["key"] == k)
        total = lambda k: F.aggregate(of(k), F.lit(0.0), lambda a, x: a + x["value"])
        items = F.transform(F.array_distinct(keys), lambda k: F.struct(of(k)[0]["name"].alias("name"), total(k).alias("value")))
        again = F.transform(F.filter(keyed, lambda x, i: F.array_position(keys, x["key"]) <= i), lambda x: x["name"])
        return F.struct(F.when(F.size(items) > 0, items).alias("items"), again.alias("merged"))

    return _let(keyed, summed)


def _fitted(series: Column, n: Column) -> Column:
    return F.slice(F.concat(series, F.array_repeat(F.lit(None).cast("double"), n)), F.lit(1), n)


def _trends(trends: Column) -> Column:
    """struct(kept, refitted, merged, empty, reason, wild).

    Blank periods go, series are cut or filled to the periods that are left;
    a period that comes again is merged into its first place, where each series
    takes its first value; series without a value go, and all of it goes with
    fewer than two periods or no series.
    """

    def repaired(periods: Column) -> Column:
        n, distinct = F.size(periods), F.array_distinct(periods)
        refitted = sum((F.coalesce((F.size(trends[c]) != n).cast("int"), F.lit(0)) * trends[c].isNotNull().cast("int") for c in SERIES), F.lit(0))
        first = lambda values, p: F.get(F.filter(F.transform(values, lambda v, i: F.when(F.element_at(periods, i + 1) == p, v)), lambda v: v.isNotNull()), F.lit(0))
        by_period = lambda values: F.transform(distinct, lambda p: first(values, p))
        merged = {c: by_period(_fitted(trends[c], n)) for c in SERIES}
        some = {c: F.exists(merged[c], lambda v: v.isNotNull()) for c in SERIES}
        again = F.filter(periods, lambda p, i: F.array_position(periods, p) <= i)
        series = [F.when(trends[c].isNotNull() & some[c], merged[c]).alias(c) for c in SERIES]
        empty = F.array_compact(F.array(*(F.when(trends[c].isNotNull() & ~some[c], F.lit(c)) for c in SERIES)))
        return F.struct(F.struct(distinct.alias("periods"), *series).alias("kept"), refitted.alias("refitted"), again.alias("merged"), empty.alias("empty"))

    def judged(found: Column) -> Column:
        kept = found["kept"]
        none = F.lit(True)
        for c in SERIES:
            none = none & kept[c].isNull()
        reason = F.when(F.size(kept["periods"]) < 2, "periods").when(none, "series")
        jump = lambda s: F.aggregate(F.sequence(F.lit(2), F.greatest(F.size(s), F.lit(2))), F.lit(0), lambda n, i: n + F.when(_wild(F.get(s, i - 2), F.get(s, i - 1)), 1).otherwise(0))
        wild = sum((F.when(kept[c].isNotNull(), jump(kept[c])).otherwise(0) for c in SERIES[:3]), F.lit(0))
        return F.struct(F.when(reason.isNull(), kept).alias("kept"), found["refitted"].alias("refitted"), found["merged"].alias("merged"), found["empty"].alias("empty"), reason.alias("reason"), F.when(reason.isNull(), wild).otherwise(0).alias("wild"))

    clean = F.filter(F.transform(_or_empty(trends["periods"], "array<string>"), strip), lambda p: F.coalesce(p != "", F.lit(False)))
    return _let(_let(clean, repaired), judged)


def _wild(before: Column, now: Column, most: float = 500.0) -> Column:
    return F.coalesce((before != 0) & (F.abs(F.try_divide(now - before, F.abs(before)) * 100) > most), F.lit(False))


def repair(snapshot: Column) -> Column:
    """struct(snapshot, warnings): the filing as it can be shown, and what was done (WARNINGS); null of null.

    Repairing once more changes nothing.
    """
    s = snapshot

    def both(found: Column) -> Column:
        m, n, a, b, t = (found[k] for k in ("metrics", "narratives", "segments", "geographies", "trends"))
        given = s["breakdown"].isNotNull()
        few = lambda x: F.coalesce(F.size(x["items"]), F.lit(0)) < 2
        gone, lost = given & few(a) & few(b), s["trends"].isNotNull() & t["reason"].isNotNull()
        tagged = lambda tag, xs: F.transform(xs, lambda x: F.concat(F.lit(tag), x))
        fit = F.when(s["trends"].isNotNull(), t["refitted"]).otherwise(0)
        charts = F.concat(
            tagged("part merged: ", F.concat(a["merged"], b["merged"])), F.when(gone, F.array(F.lit("breakdown dropped"))).otherwise(_empty("array<string>")), F.array_repeat(F.lit("series refitted"), fit),
            F.when(s["trends"].isNotNull(), F.concat(tagged("period merged: ", t["merged"]), tagged("series empty: ", t["empty"]))).otherwise(_empty("array<string>")), F.when(lost, F.array(F.concat(F.lit("trends dropped: "), t["reason"]))).otherwise(_empty("array<string>")),
        )
        whole = F.struct(
            *(s[c].alias(c) for c in ("company_name", "report_period", "language")), m["items"].alias("metrics"), n["items"].alias("narratives"), *(s[c].alias(c) for c in ("tone", "outlook", "risks", "guidance")),
            F.when(given & ~gone, F.struct(a["items"].alias("segments"), b["items"].alias("geographies"))).alias("breakdown"), F.when(s["trends"].isNotNull(), t["kept"]).alias("trends"),
        )
        none = _empty("array<string>")
        warnings = F.struct(
            m["repeated"].alias("duplicate_labels"), m["dropped"].alias("dropped_metrics"), n["renamed"].alias("renamed_sections"), (~n["summary"]).alias("missing_summary"), (F.size(a["merged"]) + F.size(b["merged"])).alias("merged_parts"), gone.alias("breakdown_dropped"),
            fit.alias("series_refitted"), F.when(s["trends"].isNotNull(), F.size(t["merged"])).otherwise(0).alias("merged_periods"), F.when(s["trends"].isNotNull(), t["empty"]).otherwise(none).alias("empty_series"), lost.alias("trends_dropped"),
            F.when(s["trends"].isNotNull(), t["wild"]).otherwise(0).alias("implausible_changes"), charts.alias("chart_warnings"),
        )
        return F.struct(whole.cast(SNAPSHOT).alias("snapshot"), warnings.cast(WARNINGS).alias("warnings"))

    steps = F.struct(_metrics(s["metrics"]).alias("metrics"), _narratives(s["narratives"]).alias("narratives"), _parts(s["breakdown"]["segments"]).alias("segments"), _parts(s["breakdown"]["geographies"]).alias("geographies"), _trends(s["trends"]).alias("trends"))
    return F.when(s.isNotNull(), _let(steps, both))


# --- texts to translate -----------------------------------------------------------------------------------------------


def collect_texts(filings: DataFrame, doc: str = "id", snapshot: str = "snapshot") -> DataFrame:
    """(doc, path, text, is_label): every text of a filing that is translated, under the path where it stands.

    Paths are metric:0:label, narrative:0:text, sentiment:tone,
    sentiment:outlook and sentiment:risk:0, numbered from 0; blank texts have
    none.  Only labels (is_label) may come from a cache.
    """
    s = F.col(snapshot)
    row = lambda path, text, label: F.struct(path.alias("path"), text.alias("text"), F.lit(label).alias("is_label"))
    at = lambda head, i, tail="": F.concat(F.lit(head), i.cast("string"), F.lit(tail))
    kind = "array<struct<path: string, text: string, is_label: boolean>>"
    rows = F.concat(
        _or_empty(F.transform(s["metrics"], lambda m, i: row(at("metric:", i, ":label"), m["label"], True)), kind), _or_empty(F.transform(s["narratives"], lambda x, i: row(at("narrative:", i, ":text"), x["text"], False)), kind),
        F.array(row(F.lit("sentiment:tone"), s["tone"], False), row(F.lit("sentiment:outlook"), s["outlook"], False)), _or_empty(F.transform(s["risks"], lambda x, i: row(at("sentiment:risk:", i), x, False)), kind),
    )
    each = filings.where(s.isNotNull()).select(F.col(doc).alias("doc"), F.explode(F.filter(rows, lambda x: F.coalesce(strip(x["text"]) != "", F.lit(False)))).alias("x"))
    return each.select("doc", "x.path", "x.text", "x.is_label")


def apply_texts(filings: DataFrame, texts: DataFrame, language: Column | None = None, doc: str = "id", snapshot: str = "snapshot") -> DataFrame:
    """filings with each text (doc, path, text) in the place that its path names; all else stays as it is.

    Null texts, and paths that a filing has not, change nothing.  A path comes
    once for a filing; of several the greatest text counts.  language, an
    expression over filings, becomes the language of filings that have any text
    of their own here.  A filing's texts meet in one row.
    """
    by_doc = texts.where(F.col("text").isNotNull()).groupBy("doc", "path").agg(F.max("text").alias("text")).groupBy(F.col("doc").alias("of_")).agg(F.map_from_entries(F.collect_list(F.struct("path", "text"))).alias("new_"))
    joined = filings.join(by_doc, F.col(doc).eqNullSafe(F.col("of_")), "left")
    s, new = F.col(snapshot), F.col("new_")
    put = lambda path, old: F.coalesce(F.element_at(new, path), old)
    at = lambda head, i, tail="": F.concat(F.lit(head), i.cast("string"), F.lit(tail))
    changed = (
        s.withField("metrics", F.transform(s["metrics"], lambda m, i: m.withField("label", put(at("metric:", i, ":label"), m["label"]))))
        .withField("narratives", F.transform(s["narratives"], lambda x, i: x.withField("text", put(at("narrative:", i, ":text"), x["text"]))))
        .withField("tone", put(F.lit("sentiment:tone"), s["tone"]))
        .withField("outlook", put(F.lit("sentiment:outlook"), s["outlook"]))
        .withField("risks", F.transform(s["risks"], lambda x, i: put(at("sentiment:risk:", i), x)))
    )
    if language is not None:
        changed = changed.withField("language", language)
    return joined.withColumn(snapshot, F.when(s.isNotNull() & new.isNotNull(), changed).otherwise(s)).select(*(F.col(f"`{c}`") for c in filings.columns))


def cached_texts(texts: DataFrame, cache: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """(hits, missing) of rows of collect_texts(): labels that the cache (source_text, et, lv, lt) knows, translated, and all other texts."""
    known = cache.where(F.coalesce(language, F.lit("")) != "").select(F.col("source_text").alias("text"), F.col(language).alias("new_"))
    joined = texts.join(known.withColumn("is_label", F.lit(True)), ["text", "is_label"], "left")
    return joined.where("new_ is not null").select("doc", "path", F.col("new_").alias("text")), joined.where("new_ is null").select(*texts.columns)


# --- what is shown ----------------------------------------------------------------------------------------------------

# Words of the labels that a brief shows.
KEY_WORDS = ("revenue", "ebitda", "net profit", "net income", "operating profit", "total assets", "equity", "eps", "cash flow", "investment", "capex", "dividends")


def _section(snapshot: Column, name: str) -> Column:
    return F.get(F.filter(snapshot["narratives"], lambda x: x["section"] == name), F.lit(0))["text"]


def _paragraphs(*texts: Column) -> Column:
    return F.flatten(F.array(*(F.split(F.coalesce(t, F.lit("")), "\n") for t in texts)))


def brief(snapshot: Column, metrics: int = 8, summary: int = 4, other: int = 3, risks: int = 3) -> Column:
    """struct(metrics, summary, priorities, tone, outlook, risks, more_risks): a filing on a page; null of null.

    The first metrics that a label's words choose, paragraphs of the summary and
    the management's commentary, of the strategic priorities, and risks, each
    list up to its number and without repeated paragraphs; more_risks counts
    the risks left out.
    """
    s = snapshot
    named = F.filter(_or_empty(s["metrics"], f"array<{_METRIC}>"), lambda m: F.lower(m["label"]).rlike("|".join(KEY_WORDS)))
    told = _or_empty(s["risks"], "array<string>")
    tone = F.coalesce(F.nullif(s["tone"], F.lit("")), F.lit("Not assessed"))
    out = F.struct(
        F.slice(F.transform(named, lambda m: F.struct(m["label"].alias("label"), m["value"].alias("value"), m["unit"].alias("unit"))), 1, metrics).alias("metrics"), first_distinct(_paragraphs(_section(s, "executive_summary"), _section(s, "management_commentary")), summary).alias("summary"),
        first_distinct(_paragraphs(_section(s, "strategic_priorities")), other).alias("priorities"), tone.alias("tone"), F.nullif(s["outlook"], F.lit("")).alias("outlook"), F.slice(told, 1, risks).alias("risks"), F.greatest(F.size(told) - risks, F.lit(0)).alias("more_risks"),
    )
    return F.when(s.isNotNull(), out)


def ranked_parts(parts: Column) -> Column:
    """array of (name, value, share, bar): parts with a number, the largest by size first, equal ones as they come.

    share is of the sum of sizes, bar of the largest size, both null if that is 0.
    """
    known = F.filter(parts, lambda x: is_finite(x["value"]))
    placed = F.array_sort(F.transform(known, lambda x, i: F.struct((-F.abs(x["value"])).alias("size"), i.alias("i"), x.alias("x"))))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + F.abs(x["value"]))
    return F.transform(placed, lambda p: F.struct(p["x"]["name"].alias("name"), p["x"]["value"].alias("value"), F.try_divide(-p["size"], total).alias("share"), F.try_divide(-p["size"], -placed[0]["size"]).alias("bar")))


def timeline(reports: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """(company_id, id, place, tone, guidance): a company's reports that tell a tone or outlook, the newest first.

    tone is what the filing says, a dash if it says none.  Of equally recent
    reports the larger id is the newer.
    """
    from pyspark.sql import Window as W

    from ledgerline.functions.periods import recency

    s = F.col(snapshot)
    told = s["tone"].isNotNull() | s["outlook"].isNotNull() | s["guidance"].isNotNull() | s["risks"].isNotNull()
    own = W.partitionBy("company_id").orderBy(recency(F.col("fiscal_year"), F.col("report_type")).desc(), F.col("id").desc())
    return reports.where(told).select("company_id", "id", F.row_number().over(own).alias("place"), F.coalesce(s["tone"], F.lit("—")).alias("tone"), s["guidance"].alias("guidance"))


def tone_bucket(tone: Column) -> Column:
    """How a tone is shown: the first of these that its words name, else neutral; not_detected of null and empty."""
    low = F.lower(F.coalesce(tone, F.lit("")))
    says = lambda word: F.contains(low, F.lit(word))
    return F.when(low == "", "not_detected").when(says("very positive"), "very_positive").when(says("positive"), "positive").when(says("cautious") | says("mixed"), "cautious").when(says("negative"), "negative").otherwise("neutral")


def flat_metrics(filings: DataFrame, doc: str = "id", snapshot: str = "snapshot") -> DataFrame:
    """Rows (doc, ord, label, value, unit, period, snippet, rationale, confidence) of the filings' metrics."""
    return filings.select(F.col(doc).alias("doc"), F.posexplode(f"{snapshot}.metrics").alias("ord", "m")).select("doc", "ord", "m.label", "m.value", "m.unit", "m.period", "m.snippet", F.lit(None).cast("string").alias("rationale"), "m.confidence")
