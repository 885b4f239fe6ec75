"""The job queue: events of jobs in, states of jobs out, as batch and as stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.schema import ACTIVE_STATES, JOB_STATES, TERMINAL_STATES

#: Where a state may lead.
NEXT = {
    "pending": ("parsing", "failed"), "parsing": ("extracting", "failed", "pending"), "extracting": ("translating", "failed", "pending"),
    "translating": ("assembling", "failed", "pending"), "assembling": ("complete", "failed", "pending"), "complete": ("duplicate", "failed"), "failed": ("pending",), "duplicate": (),
}


def current(events: DataFrame) -> DataFrame:
    """(job, state, created_at, updated_at) from events (job, state, ts, seq): the last event by time, then seq."""
    return events.groupBy("job").agg(F.max(F.struct("ts", "seq", "state"))["state"].alias("state"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))


def illegal_moves(events: DataFrame) -> DataFrame:
    """Events whose state doesn't follow from the one before, as (job, seq, before, state)."""
    before = F.lag("state").over(W.partitionBy("job").orderBy("ts", "seq"))
    ok = F.lit(False)
    for name, after in NEXT.items():
        ok = ok | ((F.col("before") == name) & F.col("state").isin(*after)) if after else ok
    return events.withColumn("before", before).where(F.col("before").isNotNull() & (F.col("before") != F.col("state")) & ~ok).select("job", "seq", "before", "state")


def claim(jobs: DataFrame, n: int = 1) -> DataFrame:
    """The n oldest pending jobs."""
    return jobs.where("state = 'pending'").orderBy("created_at", "job").limit(n)


def requeue_stale(jobs: DataFrame, as_of: Column, after: str = "INTERVAL 30 MINUTES") -> DataFrame:
    """Active jobs without an update for so long become pending."""
    stale = F.col("state").isin(*ACTIVE_STATES) & (F.col("updated_at") < as_of - F.expr(after))
    return jobs.withColumn("state", F.when(stale, "pending").otherwise(F.col("state"))).withColumn("updated_at", F.when(stale, as_of).otherwise(F.col("updated_at")))


def retention(jobs: DataFrame, as_of: Column, keep: int = 50, after: str = "INTERVAL 7 DAYS") -> DataFrame:
    """The jobs to delete: ended ones older than that, the oldest first, as long as ``keep`` ended ones remain.

    Duplicates count as neither.  The rank is one over all ended jobs; they are
    sorted by range, and their running numbers come from counts per range.
    """
    ended = jobs.where(F.col("state").isin(*TERMINAL_STATES))
    total = ended.agg(F.count(F.lit(1)).alias("total"))
    day = F.date_trunc("hour", "updated_at")
    before = ended.groupBy(day.alias("hour")).count().withColumn("before", F.coalesce(F.sum("count").over(W.orderBy("hour").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = ended.withColumn("hour", day).join(before, "hour").withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("hour").orderBy("updated_at", "job")))
    return ranked.join(F.broadcast(total)).where((F.col("updated_at") < as_of - F.expr(after)) & (F.col("rank") <= F.col("total") - keep)).select(*jobs.columns)


def health(jobs: DataFrame, as_of: Column) -> DataFrame:
    """One row: stale pending jobs, recent activity, and whether the pipeline works."""
    waiting = (F.col("state") == "pending") & (F.col("created_at") < as_of - F.expr("INTERVAL 90 SECONDS"))
    recent = F.col("state").isin(*ACTIVE_STATES) | (F.col("state").isin(*TERMINAL_STATES, "duplicate") & (F.col("updated_at") > as_of - F.expr("INTERVAL 10 MINUTES")))
    counts = jobs.agg(F.count_if(waiting).alias("stale_pending"), F.count_if(recent).alias("recent"))
    return counts.withColumn("ok", (F.col("stale_pending") == 0) | (F.col("recent") > 0))


def states_stream(events: DataFrame) -> DataFrame:
    """current() on a streaming DataFrame of events; run it in update or complete mode."""
    return current(events)


def run_queue(events: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Starts a query that hands each micro-batch of pending jobs, oldest first, to ``work``.

    The checkpoint is the claim: a batch is handed over again until it is done,
    so ``work`` must be idempotent per batch number.
    """
    pending = events.where("state = 'pending'")
    writer = pending.writeStream.foreachBatch(lambda df, n: work(df.orderBy("ts", "job"), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


assert set(NEXT) == set(JOB_STATES)
