"""Background jobs, failure streaks, retry schedules and idempotency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.text import hash_text
from feedloom.functions.values import RETRY_HOURS, step_delay, unzoned_micros
from feedloom.operators.ordered import running
from feedloom.operators.paging import page

INTERRUPTED = "refresh interrupted by process restart"


def later_of(own: Column, hint: Column) -> Column:
    """The provider's time wins only when it is later."""
    return F.greatest(own, hint)


def retry_schedule(failures: DataFrame) -> DataFrame:
    """Next retry of a failed item from its failures so far and the provider's own hint."""
    own = F.col("failed_at") + step_delay(RETRY_HOURS, F.col("failure_count") + 1, 3600)
    return failures.withColumn("retry_after", later_of(own, F.col("provider_retry_at")))


def failure_streak(log: DataFrame, key: str, order: list[str], failed: Column, reset: Column) -> DataFrame:
    """Consecutive failures up to each row, counted anew from every reset."""
    return running(log, [key], order, {"failure_count": ("sum", failed.cast("bigint"))}, reset=reset)


def job_lifecycle(log: DataFrame, restarted: bool = False) -> DataFrame:
    """Current job per key from its status log. A restart puts running jobs back into the queue."""
    at = F.struct("ts", "event_id")
    jobs = log.groupBy("idempotency_key").agg(
        F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"), F.max_by("status", at).alias("status"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.min(F.when(F.col("status").isin("done", "failed"), F.col("ts"))).alias("completed_at"),
    )
    if not restarted:
        return jobs
    running_now = F.col("status") == "running"
    return jobs.withColumns({
        "started_at": F.when(~running_now, F.col("started_at")),
        "completed_at": F.when(~running_now, F.col("completed_at")),
        "status": F.when(running_now, F.lit("queued")).otherwise(F.col("status")),
    })


def job_queue_head(jobs: DataFrame, n: int) -> DataFrame:
    return jobs.filter(F.col("status") == "queued").orderBy("created_at", "id").limit(n)


def job_listing(jobs: DataFrame, limit: int = 50, offset: int = 0, **bounds: int) -> DataFrame:
    return page(jobs, [unzoned_micros(F.col("created_at")), F.col("id")], max(limit, 1), offset, **bounds)


def retry_failed_jobs(jobs: DataFrame) -> DataFrame:
    """Failed jobs with an automatic key return to the queue without their old result."""
    again = (F.col("status") == "failed") & F.startswith(F.col("idempotency_key"), F.lit("auto:"))
    cleared = {c: F.when(~again, F.col(c)) for c in ("result_json", "error", "started_at", "completed_at")}
    return jobs.withColumns({**cleared, "status": F.when(again, F.lit("queued")).otherwise(F.col("status"))})


def automatic_key(request: Column, ts: Column, minutes: int = 5) -> Column:
    bucket = F.floor(unzoned_micros(ts) / (minutes * 60_000_000)).cast("bigint")
    return F.concat(F.lit("auto:"), hash_text(F.concat_ws(":", request, bucket.cast("string"))))


def idempotency_bucket(requests: DataFrame, minutes: int = 5) -> DataFrame:
    """One job per automatic key: the first request of a payload in a time bucket; later ones count as repeats."""
    keyed = requests.withColumn("auto_key", automatic_key(F.col("request_json"), F.col("ts"), minutes))
    first = F.struct("ts", "event_id")
    return keyed.groupBy("auto_key").agg(
        F.min_by("event_id", first).alias("event_id"), F.min("ts").alias("created_at"),
        (F.count(F.lit(1)) - 1).alias("repeats"),
    )


def idempotency_conflicts(requests: DataFrame, key: str) -> DataFrame:
    """Requests that reuse the key of a different earlier request: they differ from the first request of their key."""
    first = requests.groupBy(key).agg(F.min_by("request_json", F.struct("ts", "event_id")).alias("first_request"))
    return requests.join(first, key).filter(F.col("request_json") != F.col("first_request"))


def recover_feeds(feeds: DataFrame) -> DataFrame:
    cut_off = F.col("last_refresh_status") == "refreshing"
    return feeds.withColumns({
        "last_refresh_error": F.when(cut_off, F.lit(INTERRUPTED)).otherwise(F.col("last_refresh_error")),
        "last_refresh_status": F.when(cut_off, F.lit("error")).otherwise(F.col("last_refresh_status")),
    })


def recover_circuits(circuits: DataFrame, now: str) -> DataFrame:
    half = F.col("state") == "half-open"
    return circuits.withColumns({
        "next_probe_at": F.when(half, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("next_probe_at")),
        "state": F.when(half, F.lit("open")).otherwise(F.col("state")),
        "probe_in_progress": F.lit(False),
    })
