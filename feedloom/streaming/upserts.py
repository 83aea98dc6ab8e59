"""Streams without own state: entry files, upserts, repeats, running totals, job status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.operators.reconcile import KEY, upsert_entries
from feedloom.operators.rollups import TOKENS, zero_sum
from feedloom.session import fresh_folder
from feedloom.streaming.runs import last_update, run_batches, write_batches
from feedloom.streaming.snapshots import BUCKETS, Snapshots


def stream_entries(stream: DataFrame, **options) -> DataFrame:
    return write_batches(stream, **options).drop("batch")


def newest_per_key(batch: DataFrame) -> DataFrame:
    """One row per entry key of a batch, the last by refresh time."""
    newest = F.max_by(F.struct(*batch.columns), F.struct("refreshed_at", "id"))
    return batch.groupBy(*KEY).agg(newest.alias("_r")).select("_r.*")


def stream_upsert(stream: DataFrame, stored: DataFrame, out: str | None = None, buckets: int = BUCKETS, **options) -> DataFrame:
    """Upsert each batch into the snapshot before it; a batch writes the hash buckets of its own keys only."""
    spark = stream.sparkSession
    table = Snapshots(spark, out or fresh_folder(spark, "snapshots"), stored.schema, KEY, buckets)
    table.create(stored)
    run_batches(stream, lambda batch, number: table.merge(newest_per_key(batch), number, upsert_entries), "append", **options)
    return table.read()


def stream_dedupe(stream: DataFrame, keys: list[str], ts: str = "ts", delay: str | None = None, **options) -> DataFrame:
    """Rows without repeats of a key, whatever the order in which they arrive.

    Without a `delay` the state holds every key. With one it forgets keys that are older than the delay, and rows that
    come later than it are lost: an explicit choice for sources that promise the delay."""
    zoned = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    once = zoned.dropDuplicates(keys) if delay is None else zoned.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    out = write_batches(once, **options).drop("batch")
    return out.withColumn(ts, F.col(ts).cast("timestamp_ntz"))


def stream_usage_totals(usage: DataFrame, **options) -> DataFrame:
    totals = usage.groupBy("provider").agg(
        F.count(F.lit(1)).alias("request_count"), *[zero_sum(t) for t in TOKENS], F.max("created_at").alias("updated_at")
    )
    return last_update(write_batches(totals, "update", **options), ["provider"])


def stream_usage_windows(usage: DataFrame, width: str = "1 day", delay: str | None = None, **options) -> DataFrame:
    """Totals per provider and clock window. All that arrives counts, however late: a window is one small row of state.

    With a `delay` windows are forgotten once the watermark has passed them, and later rows are lost."""
    timed = usage.withColumn("created_at", F.col("created_at").cast("timestamp"))
    timed = timed if delay is None else timed.withWatermark("created_at", delay)
    totals = timed.groupBy("provider", F.window("created_at", width)).agg(
        F.count(F.lit(1)).alias("request_count"), zero_sum("total_tokens")
    ).select("provider", F.col("window.start").alias("window_start"), "request_count", "total_tokens")
    final = last_update(write_batches(totals, "update", **options), ["provider", "window_start"])
    return final.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_job_status(log: DataFrame, **options) -> DataFrame:
    status = log.groupBy("idempotency_key").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("updated_at")
    )
    return last_update(write_batches(status, "update", **options), ["idempotency_key"])
