"""Queries on the job queue: users' events stand for events of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.plans.inputs import table
from ledgerline.plans.registry import query
from ledgerline.streaming import jobs as J
from ledgerline.streaming.limits import limited

STATES = {"signup": "pending", "view": "parsing", "click": "extracting", "purchase": "complete", "error": "failed"}
_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"
_EVENTS = f"ev AS (SELECT user_id AS job, event_id AS seq, ts, {_CASE} AS state FROM events)"
_JOBS = f"{_EVENTS}, jobs AS (SELECT job, arg_max(state, (ts, seq)) AS state, min(ts) AS created_at, max(ts) AS updated_at FROM ev GROUP BY job), now AS (SELECT max(ts) AS as_of FROM events)"


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    state = F.coalesce(*(F.when(F.col("event_type") == k, F.lit(v)) for k, v in STATES.items()))
    return table(spark, sf, "events").select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), "ts", state.alias("state"))


def jobs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Jobs with the time of the last event, and this time alone."""
    events = job_events(spark, sf)
    now = events.agg(F.max("ts").alias("as_of"))
    return J.current(events).join(F.broadcast(now)), now


@query("L6_current_states", f"WITH {_JOBS} SELECT job, state FROM jobs")
def current_states(spark: SparkSession, sf: str) -> DataFrame:
    return J.current(job_events(spark, sf)).select("job", "state")


_OK = " OR ".join(f"(before = '{a}' AND state IN ({', '.join(map(repr, b))}))" for a, b in J.NEXT.items() if b)


@query("L6_illegal_moves", f"WITH {_EVENTS} SELECT job, seq, before, state FROM (SELECT *, lag(state) OVER (PARTITION BY job ORDER BY ts, seq) AS before FROM ev) WHERE before IS NOT NULL AND before <> state AND NOT ({_OK})")
def illegal_moves(spark: SparkSession, sf: str) -> DataFrame:
    return J.illegal_moves(job_events(spark, sf))


@query("L1_H5_claim", f"WITH {_JOBS} SELECT job FROM jobs WHERE state = 'pending' ORDER BY created_at, job LIMIT 5")
def claim(spark: SparkSession, sf: str) -> DataFrame:
    return J.claim(J.current(job_events(spark, sf)), 5).select("job")


@query("L3_stale", f"WITH {_JOBS} SELECT job, CASE WHEN state IN ('parsing', 'extracting', 'translating', 'assembling') AND updated_at < as_of - INTERVAL 1 DAY THEN 'pending' ELSE state END AS state FROM jobs, now")
def stale(spark: SparkSession, sf: str) -> DataFrame:
    return J.requeue_stale(jobs(spark, sf)[0], F.col("as_of"), "INTERVAL 1 DAY").select("job", "state")


@query("L4_H6_retention", f"WITH {_JOBS}, e AS (SELECT *, row_number() OVER (ORDER BY updated_at, job) AS rank, count(*) OVER () AS total FROM jobs WHERE state IN ('complete', 'failed')) SELECT job FROM e, now WHERE updated_at < as_of - INTERVAL 2 DAY AND rank <= total - 20")
def retention(spark: SparkSession, sf: str) -> DataFrame:
    return J.retention(jobs(spark, sf)[0], F.col("as_of"), 20, "INTERVAL 2 DAYS").select("job")


@query("E3_L5_K9_health", f"WITH {_JOBS}, h AS (SELECT count(*) FILTER (state = 'pending' AND created_at < as_of - INTERVAL 90 SECOND) AS stale_pending, count(*) FILTER (state IN ('parsing', 'extracting', 'translating', 'assembling') OR (state IN ('complete', 'failed', 'duplicate') AND updated_at > as_of - INTERVAL 10 MINUTE)) AS recent FROM jobs, now) SELECT *, stale_pending = 0 OR recent > 0 AS ok FROM h")
def health(spark: SparkSession, sf: str) -> DataFrame:
    return J.health(jobs(spark, sf)[0], F.col("as_of"))


_KIND = "CASE event_type WHEN 'error' THEN 'failure' WHEN 'purchase' THEN 'reset' ELSE 'other' END"
_WINDOW = 7 * 86_400


@query(
    "L8_rate_limit",
    f"""WITH RECURSIVE r AS (SELECT user_id AS key, event_id AS seq, epoch(ts) AS sec, {_KIND} AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT key, seq, sec, k, CASE WHEN kind = 'failure' THEN sec END AS opened, CASE WHEN kind = 'failure' THEN 1 ELSE 0 END AS n FROM r WHERE k = 1
 UNION ALL SELECT r.key, r.seq, r.sec, r.k, CASE WHEN kind = 'reset' THEN NULL WHEN kind = 'failure' AND (w.opened IS NULL OR r.sec - w.opened > {_WINDOW}) THEN r.sec ELSE w.opened END,
 CASE WHEN kind = 'reset' THEN 0 WHEN kind = 'failure' AND (w.opened IS NULL OR r.sec - w.opened > {_WINDOW}) THEN 1 WHEN kind = 'failure' THEN w.n + 1 ELSE w.n END FROM w JOIN r ON r.key = w.key AND r.k = w.k + 1)
SELECT key, seq, CAST(CASE WHEN opened IS NULL OR sec - opened > {_WINDOW} THEN 0 ELSE n END AS INTEGER) AS failures, CASE WHEN opened IS NULL OR sec - opened > {_WINDOW} THEN false ELSE n > 2 END AS limited FROM w""",
)
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "failure").when(F.col("event_type") == "purchase", "reset").otherwise("other")
    events = table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"))
    return limited(events, _WINDOW, 2).select("key", "seq", "failures", "limited")


@query("L10_C7_cache_misses", "SELECT DISTINCT p_name AS source_text FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 3 = 0)")
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.col("p_name").alias("source_text")).distinct().join(p.where("p_partkey % 3 = 0").select(F.col("p_name").alias("source_text")), "source_text", "left_anti")
