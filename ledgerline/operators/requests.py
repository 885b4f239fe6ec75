"""Batches of requests, answered as if they came one after another.

Requests have ``seq``, a number that gives their order; of equal ones the greater
values count as later, and equal requests for a key are answered alike.  Each of
these functions finds with aggregates which request of a key counts, so a busy
key is added up in the tasks that hold its requests and no key is walked
through in order.  Answers are written once, and the tables after them follow
from what was written.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.periods import parse_period
from ledgerline.functions.text import strip
from ledgerline.operators.reviews import candidate_status, warning_texts
from ledgerline.operators.tables import set_company, upsert
from ledgerline.schema import CANDIDATE_STATUS, LANGUAGES
from ledgerline.sources.files import EXTENSIONS, MIME_TYPES
from ledgerline.storage import materialize

#: Candidates in these states await a decision.
OPEN = ("pending_review", "failed_quality")
REPLACED = ("s3_key", "extracted_json_snapshot")
REPORT_KEY = ("company_id", "fiscal_year", "report_type", "language")
#: Table by table the tables whose rows it refers to.
REFERENCES = {"jobs": ("companies",), "reports": ("companies", "jobs"), "report_rerun_candidates": ("reports", "jobs")}
_UUID = "[0-9a-f-]{36}"


def _given(c: Column) -> Column:
    """c unless it is empty."""
    return F.nullif(c, F.lit(""))


def _part(text: Column, pattern: str, group: int = 1) -> Column:
    return _given(F.regexp_extract(text, pattern, group))


def _last(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Of each key the columns of its last request."""
    return df.groupBy(*keys).agg(F.max(F.struct("seq", *columns)).alias("last_")).select(*keys, *(f"last_.{c}" for c in columns))


def _shaped(new: DataFrame, like: DataFrame) -> DataFrame:
    """new with the columns of another table, null where it has none."""
    return new.select(*(F.col(c) if c in new.columns else F.lit(None).cast(like.schema[c].dataType).alias(c) for c in like.columns))


# --- reviews ----------------------------------------------------------------------------------------------------------


def review_queue(candidates: DataFrame, reports: DataFrame, companies: DataFrame, statuses: Sequence[str] | None = OPEN) -> DataFrame:
    """Candidates beside their report and its company (null if it has none).

    statuses that are none are left out; with none left, candidates of all are
    listed.  A candidate whose report is gone isn't.
    """
    known = [s for s in statuses or () if s in CANDIDATE_STATUS]
    chosen = candidates.where(F.col("status").isin(*known)) if known else candidates
    r = reports.select(F.col("id").alias("report_id"), "company_id", "fiscal_year", "report_type", "language", F.col("job_id").alias("report_job_id"))
    c = companies.select(F.col("id").alias("company_id"), F.col("name").alias("company"), "ticker")
    return chosen.join(r, "report_id").join(c, "company_id", "left")


def answer_reviews(candidates: DataFrame, reports: DataFrame, requests: DataFrame) -> DataFrame:
    """(seq, candidate_id, action, report_id, answer) of requests (seq, candidate_id, action).

    promote makes a candidate that is pending_review ``approved``; reject makes
    one of OPEN ``rejected``.  The first request that can be done decides.  All
    others change nothing: not_found, unknown_action, not_pending (a promotion of a
    candidate in another state by then), no_report (its report is gone, so it
    stays as it was), not_rejectable.
    """
    there = reports.select(F.col("id").alias("report_id"), F.lit(True).alias("there_"))
    held = candidates.select(F.col("id").alias("candidate_id"), "status", "report_id").join(there, "report_id", "left")
    asked = requests.select("seq", "candidate_id", "action").join(held, "candidate_id", "left")
    promote, pending = F.col("action") == "promote", F.col("status") == "pending_review"
    can = (promote & pending & F.col("there_").isNotNull()) | ((F.col("action") == "reject") & F.col("status").isin(*OPEN))
    turn = F.struct("seq", "action")
    first = asked.where(can).groupBy("candidate_id").agg(F.min(turn).alias("first_"))
    judged = asked.join(first, "candidate_id", "left")
    before = F.col("first_").isNull() | (turn < F.col("first_"))
    answer = (
        F.when(F.col("status").isNull(), "not_found")
        .when(~F.coalesce(F.col("action").isin("promote", "reject"), F.lit(False)), "unknown_action")
        .when(turn == F.col("first_"), F.when(promote, "approved").otherwise("rejected"))
        .when(promote & pending & before, "no_report")
        .when(promote, "not_pending")
        .otherwise("not_rejectable")
    )
    return materialize(judged.select("seq", "candidate_id", "action", "report_id", answer.alias("answer")), "review-answers")


def apply_reviews(candidates: DataFrame, reports: DataFrame, answers: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates, reports) after answer_reviews(): of several candidates approved for a report, the last replaces its job, file and snapshot."""
    done = answers.where("answer in ('approved', 'rejected')").select(F.col("candidate_id").alias("id"), F.col("answer").alias("answer_")).distinct()
    marked = candidates.join(done, "id", "left")
    approved_at = F.when(F.col("answer_") == "approved", as_of).otherwise(F.col("approved_at"))
    after = marked.withColumn("approved_at", approved_at).withColumn("status", F.coalesce("answer_", "status")).select(*candidates.columns)
    winner = _last(answers.where("answer = 'approved'"), ["report_id"], ["candidate_id"])
    new = candidates.select(F.col("id").alias("candidate_id"), *(F.col(c).alias(f"new_{c}") for c in ("job_id", *REPLACED))).join(winner, "candidate_id")
    joined = reports.join(new.withColumnRenamed("report_id", "id"), "id", "left")
    pick = lambda c: F.when(F.col("candidate_id").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return after, joined.select(*(pick(c) if c in ("job_id", *REPLACED) else F.col(c) for c in reports.columns))


# --- jobs -------------------------------------------------------------------------------------------------------------


def accepted(name: Column, mime: Column) -> Column:
    """Whether a file may be sent in: by its extension, or its MIME type, of which an unknown one will do."""
    extension = F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"\.([^.]*)$", 1)
    kinds = [m for ms in MIME_TYPES.values() for m in ms]
    return extension.isin(*(e for es in EXTENSIONS.values() for e in es)) | F.coalesce(mime, F.lit("")).isin("", *kinds)


def create_jobs(jobs: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, answers) after requests (seq, id, original_filename, mime, output_language, company_id) for new jobs.

    Answers are (seq, id, answer): created, not_accepted (see accepted()) or
    taken, where the id asked for is an earlier job's.  Without an id a job gets
    one made from its file's name and seq, so that reruns agree.  Another language
    than LANGUAGES is en, an empty company none.
    """
    own = F.sha2(F.concat_ws("/", F.lit("job"), F.col("seq").cast("string"), F.coalesce("original_filename", F.lit(""))), 256)
    asked = requests.withColumn("id", F.coalesce(_given(F.col("id")), own)).withColumn("fits_", accepted(F.col("original_filename"), F.col("mime")))
    turn = F.struct("seq", "original_filename", "mime", "output_language", "company_id")
    first = asked.where("fits_").groupBy("id").agg(F.min(turn).alias("first_"))
    held = jobs.select("id", F.lit(True).alias("held_")).distinct()
    judged = asked.join(first, "id", "left").join(held, "id", "left")
    answer = F.when(~F.col("fits_"), "not_accepted").when(F.col("held_").isNotNull() | (turn > F.col("first_")), "taken").otherwise("created")
    answers = materialize(judged.withColumn("answer", answer), "job-answers")
    language = F.when(F.col("output_language").isin(*LANGUAGES), F.col("output_language")).otherwise("en")
    new = answers.where("answer = 'created'").dropDuplicates(["id"]).select(
        "id", F.lit("pending").alias("state"), "original_filename", language.alias("output_language"), _given(F.col("company_id")).alias("company_id"), as_of.alias("created_at"), as_of.alias("updated_at")
    )
    return jobs.unionByName(new.select(*(c for c in new.columns if c in jobs.columns)), allowMissingColumns=True), answers.select("seq", "id", "answer")


def job_details(jobs: DataFrame) -> DataFrame:
    """jobs whose text and JSON are null but for those that are complete or failed, or extracting with progress to show."""
    progress = (F.col("state") == "extracting") & F.coalesce(F.contains("extracted_json", F.lit("_extractionProgress")), F.lit(False))
    shown = F.col("state").isin("complete", "failed") | progress
    return jobs.select(*(F.when(shown, F.col(c)).alias(c) if c in ("extracted_text", "extracted_json") else F.col(c) for c in jobs.columns))


def retry_jobs(jobs: DataFrame, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs, answers): failed jobs asked for by requests (seq, id) begin again, without what they had found.

    Answers are (seq, id, answer): retried for the first request of a failed
    job, not_failed or not_found.
    """
    first = requests.groupBy("id").agg(F.min("seq").alias("first_"))
    asked = requests.select("seq", "id").join(first, "id", "left").join(jobs.select("id", "state"), "id", "left")
    answer = F.when(F.col("state").isNull(), "not_found").when((F.col("state") == "failed") & (F.col("seq") == F.col("first_")), "retried").otherwise("not_failed")
    answers = materialize(asked.select("seq", "id", answer.alias("answer")), "retry-answers")
    marked = jobs.join(answers.where("answer = 'retried'").select("id", F.lit(True).alias("go_")).distinct(), "id", "left")
    new = {"state": F.lit("pending"), "error": F.lit(None), "extracted_text": F.lit(None), "extracted_json": F.lit(None), "updated_at": as_of}
    return marked.select(*(F.when(F.col("go_"), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns)), answers


def _first_report(reports: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Of equal keys the report with the smallest id; null keys are one key."""
    return reports.groupBy(*keys).agg(F.min("id").alias(name))


def replacements(jobs: DataFrame, asked: DataFrame, reports: DataFrame, as_of_year: int) -> DataFrame:
    """(job_id, answer, report_id, s3_key, extracted_json_snapshot, status, quality_warnings) of the jobs asked for by asked (job_id).

    A job that is complete, duplicate or failed is queued to replace the report
    of its company, period and language.  The company is the job's own, else
    the one its error names as duplicate, else none, which finds the reports
    that have none.  Other answers, the first that holds: not_found,
    not_replaceable, no_data (JSON that can't be read), no_metadata, no_period,
    bad_language, no_report.  status is for a candidate: see candidate_status().
    """
    raw = F.col("extracted_json")
    member = lambda path: F.coalesce(F.get_json_object(raw, path), F.lit(""))
    period = parse_period(strip(member("$.metadata.reportPeriod")), as_of_year)
    read = asked.select("job_id").distinct().join(jobs.withColumnRenamed("id", "job_id"), "job_id", "left").select(
        "job_id", "state", raw, F.col("output_language").alias("language"), period.alias("p_"), ((member("$.metadata.companyName") != "") & (member("$.metadata.reportPeriod") != "")).alias("told_"),
        (F.coalesce(raw, F.lit("")) == "").alias("none_"), F.try_parse_json(raw).isNotNull().alias("json_"), F.coalesce("company_id", _part(F.coalesce("error", F.lit("")), f"(?i)Duplicate report: company=({_UUID})")).alias("company_id"),
    )
    read = read.withColumn("fiscal_year", F.col("p_.fiscal_year")).withColumn("report_type", F.col("p_.report_type"))
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if k == "company_id" else F.col(f"a.{k}") == F.col(f"b.{k}") for k in REPORT_KEY]
    joined = read.alias("a").join(_first_report(reports, REPORT_KEY, "report_id").alias("b"), same, "left").select("a.*", "b.report_id")
    answer = (
        F.when(F.col("state").isNull(), "not_found")
        .when(~F.col("state").isin("complete", "duplicate", "failed"), "not_replaceable")
        .when(~F.col("none_") & ~F.col("json_"), "no_data")
        .when(~F.col("told_"), "no_metadata")
        .when(F.col("fiscal_year").isNull(), "no_period")
        .when(~F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False)), "bad_language")
        .when(F.col("report_id").isNull(), "no_report")
        .otherwise("queued")
    )
    found = joined.withColumn("answer", answer).withColumn("warnings_", warning_texts(F.get_json_object(raw, "$.qualityWarnings")))
    go = lambda c: F.when(F.col("answer") == "queued", c)
    return found.select("job_id", "answer", go(F.col("report_id")).alias("report_id"), go(F.concat(F.lit("reports/"), "job_id", F.lit(".pdf"))).alias("s3_key"), go(raw).alias("extracted_json_snapshot"), go(candidate_status(F.col("state"), F.col("warnings_"))).alias("status"), go(F.to_json("warnings_")).alias("quality_warnings"))


def queue_replacements(candidates: DataFrame, answers: DataFrame, as_of: Column) -> DataFrame:
    """candidates with those of replacements() that are queued: one a report and job, which keeps its id and time if it is there; new ids are made from the two."""
    ident = F.sha2(F.concat_ws("/", F.lit("candidate"), "report_id", "job_id"), 256).alias("id")
    new = answers.where("answer = 'queued'").select(ident, "report_id", "job_id", *REPLACED, "status", "quality_warnings", as_of.alias("created_at"))
    return upsert(candidates, _shaped(new, candidates), ["report_id", "job_id"], overwrite=[*REPLACED, "status", "quality_warnings"])


def find_reports(asked: DataFrame, reports: DataFrame, jobs: DataFrame, by_id: bool = True) -> DataFrame:
    """(key, report_id, by) of asked (key): the report a shared link or a job leads to; both are null if there is none.

    The first that leads to a report: its own id (unless not ``by_id``), its
    job's id, and of a job that is a duplicate the report its JSON points to, or
    the one with the company, year, kind and language that its error names.
    Of several reports the one with the smallest id is taken.
    """
    keys = asked.select("key").distinct()
    own = reports.select(F.col("id").alias("key"), F.col("id").alias("own_")) if by_id else keys.limit(0).select("key", F.col("key").alias("own_"))
    of_job = _first_report(reports.where("job_id is not null"), ["job_id"], "of_job_").withColumnRenamed("job_id", "key")
    says = lambda name, kind: _part(F.coalesce("error", F.lit("")), "company=([^,]+), year=([0-9]+), type=([^,]+), lang=([A-Za-z0-9_]+)", name).cast(kind)
    twice = jobs.where("state = 'duplicate'").select(
        F.col("id").alias("key"), F.get_json_object("extracted_json", "$.duplicateOfReportId").alias("to_"), F.nullif(says(1, "string"), F.lit("unmatched")).alias("company_id"), says(2, "int").alias("fiscal_year"), says(3, "string").alias("report_type"), says(4, "string").alias("language")
    )
    led = twice.join(reports.select(F.col("id").alias("to_"), F.col("id").alias("pointer_")), "to_", "left")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) if k == "company_id" else F.col(f"a.{k}") == F.col(f"b.{k}") for k in REPORT_KEY]
    led = led.alias("a").join(_first_report(reports, REPORT_KEY, "criteria_").alias("b"), same, "left").select("a.key", "a.pointer_", "b.criteria_")
    ways = ("own_", "of_job_", "pointer_", "criteria_")
    joined = keys.join(own, "key", "left").join(of_job, "key", "left").join(led, "key", "left")
    names = dict(zip(ways, ("id", "job", "pointer", "criteria")))
    return joined.select("key", F.coalesce(*ways).alias("report_id"), F.coalesce(*(F.when(F.col(w).isNotNull(), names[w]) for w in ways)).alias("by"))


# --- companies --------------------------------------------------------------------------------------------------------

COMPANY_FIELDS = ("name", "ticker", "exchange", "country", "sector")


def create_companies(companies: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(companies, answers) after requests (seq, slug and COMPANY_FIELDS).

    Answers are (seq, slug, answer): refused without a name, exchange or slug,
    else created or updated.  A request overwrites all fields, also with nulls,
    and the last of a slug stands.  A new company's id is made from its slug.
    """
    clean = requests.select("seq", *(_given(F.col(c)).alias(c) for c in ("slug", *COMPANY_FIELDS)))
    good = F.col("slug").isNotNull() & F.col("name").isNotNull() & F.col("exchange").isNotNull()
    each = clean.where(good).groupBy("slug").agg(F.min("seq").alias("first_"), F.max(F.struct("seq", *COMPANY_FIELDS)).alias("last_"))
    held = companies.select("slug", F.lit(True).alias("held_"))
    answer = F.when(~good, "refused").when(F.col("held_").isNull() & (F.col("seq") == F.col("first_")), "created").otherwise("updated")
    answers = clean.join(each.select("slug", "first_"), "slug", "left").join(held, "slug", "left").select("seq", "slug", answer.alias("answer"))
    new = each.select("slug", *(f"last_.{c}" for c in COMPANY_FIELDS)).withColumn("id", F.sha2(F.concat(F.lit("company/"), "slug"), 256))
    return upsert(companies, _shaped(new, companies), ["slug"], overwrite=[c for c in COMPANY_FIELDS if c in companies.columns]), answers


def map_reports(reports: DataFrame, companies: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, answers) after requests (seq, report_id, company_id): the last that can be done gives a report its company.

    Answers are (seq, report_id, answer): mapped, no_company (none is named),
    not_found (no such report) or unknown_company.
    """
    r = reports.select(F.col("id").alias("report_id"), F.lit(True).alias("there_"))
    c = companies.select(F.col("id").alias("company_id"), F.lit(True).alias("listed_"))
    asked = requests.select("seq", "report_id", _given(F.col("company_id")).alias("company_id")).join(r, "report_id", "left").join(c, "company_id", "left")
    answer = F.when(F.col("company_id").isNull(), "no_company").when(F.col("there_").isNull(), "not_found").when(F.col("listed_").isNull(), "unknown_company").otherwise("mapped")
    answers = materialize(asked.select("seq", "report_id", "company_id", answer.alias("answer")), "map-answers")
    last = _last(answers.where("answer = 'mapped'"), ["report_id"], ["company_id"])
    return set_company(reports, last.withColumnRenamed("report_id", "id")), answers.select("seq", "report_id", "answer")


# --- leads ------------------------------------------------------------------------------------------------------------

# How many characters of a lead's fields are kept, and those that a later post without them leaves.
LEAD_LENGTHS = {"company": 200, "role": 200, "use_case": 120, "message": 2000, "source": 120, "utm_source": 120, "utm_medium": 120, "utm_campaign": 120, "user_agent": 500, "referrer": 500, "ip_address": 120}
LEAD_KEPT = ("message", "source", "utm_source", "utm_medium", "utm_campaign")


def clean_leads(posts: DataFrame) -> DataFrame:
    """posts (seq, email, and of LEAD_LENGTHS those there are) with trimmed, cut fields; empty ones are null, an email that is none too."""
    email = F.lower(strip(F.coalesce("email", F.lit(""))))
    fits = email.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")
    fields = [(F.left(F.col(c), F.lit(n)) if c == "user_agent" else _given(F.left(strip(F.col(c)), F.lit(n)))).alias(c) for c, n in LEAD_LENGTHS.items() if c in posts.columns]
    return posts.select("seq", F.when(fits, email).alias("email"), *fields)


def capture_leads(leads: DataFrame, posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leads, refused): leads by email after posts, and the seq of posts without a valid email.

    A post overwrites a lead's fields, also with nothing; of LEAD_KEPT it leaves
    those that it doesn't have.
    """
    clean = clean_leads(posts)
    fields = [c for c in clean.columns if c in LEAD_LENGTHS]
    over, kept = [c for c in fields if c not in LEAD_KEPT], [c for c in fields if c in LEAD_KEPT]
    fill = [F.max(F.when(F.col(c).isNotNull(), F.struct("seq", c)))[c].alias(c) for c in kept]
    new = clean.where("email is not null").groupBy("email").agg(F.max(F.struct("seq", *over)).alias("last_"), *fill).select("email", *(f"last_.{c}" for c in over), *kept)
    return upsert(leads, _shaped(new, leads), ["email"], overwrite=over, fill=kept), clean.where("email is null").select("seq")


# --- clearing ---------------------------------------------------------------------------------------------------------


def truncate(tables: Mapping[str, DataFrame], names: Sequence[str], confirm: bool = False, references: Mapping[str, Sequence[str]] = REFERENCES) -> dict[str, DataFrame]:
    """tables without the rows of those named and of all that refer to them, directly or not; without ``confirm`` nothing changes."""
    if unknown := [n for n in names if n not in tables]:
        raise ValueError(f"no such tables: {unknown}")
    gone = set(names)
    while more := {t for t, of in references.items() if t not in gone and gone & set(of)}:
        gone |= more
    return {n: df.where("false") if confirm and n in gone else df for n, df in tables.items()}
