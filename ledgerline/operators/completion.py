"""What becomes of jobs whose filings have been read: their company, their report, or why there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.periods import parse_period
from ledgerline.functions.text import strip
from ledgerline.operators.checks import sanity
from ledgerline.operators.dictionary import per_value
from ledgerline.operators.matching import THRESHOLD, match_companies, name_tokens, raw_tokens, reach
from ledgerline.operators.metrics import canonicalize, headline_facts, preview, stated_scales
from ledgerline.operators.records import scaled_trends
from ledgerline.operators.snapshots import SERIES, flat_metrics
from ledgerline.operators.tables import insert_unique
from ledgerline.storage import materialize

BALANCE = ("total_assets", "equity", "liabilities")
OUTCOMES = ("no_metadata", "no_period", "failed", "duplicate", "created")


def _last_of_series(filings: DataFrame, doc: str, figures: DataFrame, stated: DataFrame) -> DataFrame:
    """(doc, and of each of SERIES its last value in whole euro): null where that is null or the series is missing."""
    t = F.col("snapshot.trends")
    wide = F.greatest(*(F.coalesce(F.size(t[c]), F.lit(0)) for c in SERIES))
    rows = filings.where(t.isNotNull() & (wide > 0)).select(F.col(doc).alias("doc"), F.explode(F.sequence(F.lit(0), wide - 1)).alias("idx"), t.alias("t"))
    trends = rows.select("doc", "idx", *(F.get(F.col("t")[c], F.col("idx")).alias(c) for c in SERIES), *((F.col("idx") == F.size(F.col("t")[c]) - 1).alias(f"last_{c}") for c in SERIES))
    goals = figures.select("doc", *(F.filter(F.array(c), lambda x: x != 0).alias(c) for c in SERIES))
    last = lambda c: F.max(F.when(F.col(f"last_{c}"), F.col(c))).alias(c)
    return scaled_trends(trends, goals, stated).groupBy("doc").agg(*(last(c) for c in SERIES))


def _previews(known: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """(previews, canonicalized metrics) of filings with a snapshot."""
    flat = flat_metrics(known, doc)
    metrics = materialize(canonicalize(flat, headline_facts()), "canonical-metrics")
    figures = preview(metrics)
    ends = _last_of_series(known, doc, figures, stated_scales(metrics))
    joined = known.select(F.col(doc).alias("doc")).join(figures, "doc", "left").join(ends.select(F.col("doc"), *(F.col(c).alias(f"end_{c}") for c in SERIES)), "doc", "left")
    return joined.select("doc", *(F.coalesce(c, f"end_{c}").alias(c) for c in SERIES)), metrics


def previews(filings: DataFrame, doc: str = "id") -> DataFrame:
    """(doc, revenue, ebitda, net_profit, fcf) of filings with a snapshot: the headline metric in whole euro, else the last value of its trend.

    A trend's scale is found from the headline metrics that there are.
    """
    return _previews(filings.where("snapshot is not null"), doc)[0]


def with_company(jobs: DataFrame, companies: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """jobs (id, company_id, said, ...) with ``found``, the company that holds, and ``mapping``, how it was come by.

    Without a company of their own, jobs get the one that the name fits best
    (matched, else unmatched).  A job's own company holds if the name fits it
    (verified); it does not if the catalogue has no such company (not_found) or
    the name does not fit (conflict).
    """
    names = jobs.where("company_id is null and said <> ''").select("said").distinct()
    best = match_companies(names.select(F.col("said").alias("doc"), F.col("said").alias("name")), companies, threshold).select(F.col("doc").alias("said"), F.col("company_id").alias("best_"))
    listed = companies.select(F.col("id").alias("company_id"), F.lit(True).alias("listed_"))
    # a name is compared with its company's once, however many jobs have both
    own = jobs.where("company_id is not null").select("said", "company_id").distinct().join(companies.select(F.col("id").alias("company_id"), F.col("name").alias("own_"), "ticker"), "company_id")
    pairs = own.select("said", "company_id", name_tokens(F.col("said")).alias("x"), name_tokens(F.col("own_")).alias("y"), raw_tokens(F.col("said")).alias("raw"), "ticker")
    fits = reach(materialize(pairs.where(F.size("x") > 0), "own-names"), threshold).select("said", "company_id", F.col("fits").alias("fits_"))
    joined = jobs.join(best, "said", "left").join(listed, "company_id", "left").join(fits, ["said", "company_id"], "left")
    given = F.col("company_id").isNotNull()
    mapping = F.when(given & F.col("listed_").isNull(), "not_found").when(given & F.coalesce("fits_", F.lit(False)), "verified").when(given, "conflict").when(F.col("best_").isNotNull(), "matched").otherwise("unmatched")
    found = F.when(mapping == "verified", F.col("company_id")).when(mapping == "matched", F.col("best_"))
    return joined.withColumn("mapping", mapping).withColumn("found", found).drop("best_", "listed_", "fits_")


def decide(jobs: DataFrame, companies: DataFrame, reports: DataFrame, as_of_year: int) -> DataFrame:
    """(id, outcome, company_id, mapping, fiscal_year, report_type, language, warnings, duplicate_of) of every job.

    jobs (id, company_id, language, ord, snapshot), companies (id, name, ticker,
    ord), reports (id, company_id, fiscal_year, report_type, language, job_id,
    snapshot).  The first of OUTCOMES that holds:

    - no_metadata, no_period: the filing names no company or no period, or none
      that can be read;
    - failed: its figures can't be right beside each other or beside those of
      the company's other reports (warnings has the codes);
    - duplicate: the company has a report of this year, kind and language, or a
      job before it by ord and id gets it (duplicate_of names the report or
      the job);
    - created: a report is to be made; without a company it awaits review and
      collides with none.

    All jobs see the same reports, those given.  The decisions are written once,
    so the tables that follow from them agree.
    """
    s = F.col("snapshot")
    said = F.coalesce(strip(s["company_name"]), F.lit(""))
    period = F.coalesce(strip(s["report_period"]), F.lit(""))
    told = jobs.withColumn("said", said).withColumn("period_", period).withColumn("told_", (said != "") & (period != ""))
    read = per_value(told, ["period_"], {"p_": parse_period(F.col("period_"), as_of_year)})
    # snapshots are read where they are needed and pass no join
    placed = with_company(read.select("id", "company_id", "said", "language", "ord", "told_", F.col("p_.fiscal_year").alias("fiscal_year"), F.col("p_.report_type").alias("report_type")), companies)
    placed = materialize(placed, "completion-jobs")
    live = placed.where("told_ and fiscal_year is not null")

    past = reports.where("company_id is not null").withColumn("key_", F.coalesce("job_id", F.col("id").cast("string")))
    mine = read.where("told_ and p_.fiscal_year is not null").select(F.concat(F.lit("job "), "id").alias("id"), "snapshot")
    theirs = past.select(F.concat(F.lit("report "), "key_").alias("id"), "snapshot")
    known, metrics = _previews(mine.unionByName(theirs).where("snapshot is not null"), "id")
    known = materialize(known, "completion-previews")
    of = lambda df, head: df.where(F.startswith("doc", F.lit(head))).withColumn("doc", F.substring("doc", len(head) + 1, 1 << 30))
    figures = live.select(F.col("id").cast("string").alias("doc"), F.col("found").alias("company_id"), "fiscal_year", "report_type").join(of(known, "job "), "doc", "left")
    balance = of(metrics, "job ").where(F.col("canonical_id").isin(*BALANCE)).select("doc", F.coalesce("normalized_value", "value").alias("value"))
    history = past.select(F.col("key_").alias("doc"), "company_id", "fiscal_year", "report_type").join(of(known, "report ").select("doc", "revenue"), "doc", "left")
    found = sanity(materialize(figures, "completion-figures"), balance, materialize(history, "completion-history"))
    wrong = materialize(found.groupBy(F.col("doc").cast(jobs.schema["id"].dataType).alias("id")).agg(F.array_sort(F.collect_set("code")).alias("warnings")), "completion-warnings")
    judged = live.join(wrong, "id", "left")

    keys = ["company_id", "fiscal_year", "report_type", "language"]
    asked = judged.where("warnings is null").select("id", "ord", F.col("found").alias("company_id"), *keys[1:])
    new, twice = insert_unique(reports.select(*keys), asked, keys, [F.col("ord"), F.col("id")])
    taken = reports.where("company_id is not null").groupBy(*keys).agg(F.min(F.col("id").cast("string")).alias("held_"))
    first = new.where("company_id is not null").select(*keys, F.col("id").cast("string").alias("first_"))
    held = twice.select("id", *keys).join(taken, keys, "left").join(first, keys, "left").select("id", F.coalesce("held_", "first_").alias("duplicate_of"), F.lit(True).alias("twice_"))
    everything = placed.join(wrong, "id", "left").join(held, "id", "left")
    outcome = F.when(~F.col("told_"), "no_metadata").when(F.col("fiscal_year").isNull(), "no_period").when(F.col("warnings").isNotNull(), "failed").when(F.coalesce("twice_", F.lit(False)), "duplicate").otherwise("created")
    told = F.col("told_")
    out = everything.select("id", outcome.alias("outcome"), F.when(told, F.col("found")).alias("company_id"), F.when(told, F.col("mapping")).alias("mapping"), F.when(told, F.col("fiscal_year")).alias("fiscal_year"), F.when(told, F.col("report_type")).alias("report_type"), "language", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"), "duplicate_of")
    return materialize(out, "completion")


def apply_decisions(jobs: DataFrame, reports: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs, reports) after decide(): failed and duplicate jobs are so marked with the reason, created ones have a report under their id.

    jobs needs state and error beside the columns of decide(); a created job
    whose own company did not hold keeps its state and says so in error.
    """
    d = decisions.select("id", "outcome", F.col("mapping").alias("mapping_"), "warnings", "duplicate_of", *(F.col(c).alias(f"{c}_") for c in ("company_id", "fiscal_year", "report_type")))
    joined = jobs.join(d, "id", "left")
    state = F.when(F.col("outcome") == "failed", "failed").when(F.col("outcome") == "duplicate", "duplicate").otherwise(F.col("state"))
    error = (
        F.when(F.col("outcome") == "failed", F.concat(F.lit("quality: "), F.array_join("warnings", ", ")))
        .when(F.col("outcome") == "duplicate", F.concat(F.lit("duplicate of "), F.col("duplicate_of")))
        .when((F.col("outcome") == "created") & F.col("mapping_").isin("not_found", "conflict"), F.concat(F.lit("company "), F.col("mapping_")))
        .otherwise(F.col("error"))
    )
    made = joined.where("outcome = 'created'").select(
        F.col("id").cast(reports.schema["id"].dataType).alias("id"), F.col("company_id_").alias("company_id"), F.col("fiscal_year_").alias("fiscal_year"), F.col("report_type_").alias("report_type"), "language", F.col("id").cast("string").alias("job_id"), "snapshot"
    )
    return joined.withColumn("state", state).withColumn("error", error).select(*jobs.columns), reports.unionByName(made, allowMissingColumns=True)
