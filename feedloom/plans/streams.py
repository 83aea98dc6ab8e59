"""Queries of the streaming jobs, each run over all available input."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.plans.activity import RATE, TOTALS
from feedloom.plans.registry import query
from feedloom.sources.tables import view
from feedloom.streaming import stateful, upserts
from feedloom.streaming.runs import stream_table



def usage_stream(spark, folder):
    k = F.get_json_object("props", "$.k").cast("bigint")
    kind = F.col("event_type")
    return stream_table(spark, folder, "events").select(
        F.concat(F.lit("p"), F.col("user_id") % 3).alias("provider"), F.when(kind != "error", k * 2).alias("input_tokens"),
        F.when(kind == "view", k + 1).alias("output_tokens"), F.when(kind != "error", k).alias("total_tokens"),
        F.col("ts").alias("created_at"),
    )


@query("stream_entries", "SELECT doc_id, source, sha256(text) AS text_hash FROM documents")
def stream_entries(spark, folder):
    rows = stream_table(spark, folder, "documents").select("doc_id", "source", F.sha2("text", 256).alias("text_hash"))
    return upserts.stream_entries(rows)


@query("stream_upsert", """
    SELECT id, feed_name, source_guid, CASE WHEN id % 2 = 0 OR id % 3 = 1 THEN concat('New ', source_title) ELSE source_title END AS source_title,
      CASE WHEN id % 2 = 0 OR id % 3 = 1 THEN TIMESTAMP '2024-01-05 00:00:00' ELSE refreshed_at END AS refreshed_at,
      CASE WHEN id % 3 = 1 THEN TIMESTAMP '2024-01-05 00:00:00' ELSE created_at END AS created_at
    FROM v_entries""")
def stream_upsert(spark, folder):
    """Two thirds of the entries are stored; half of these and the missing third come in."""
    columns = ["id", "feed_name", "source_guid", "source_title", "refreshed_at", "created_at"]
    stored = view(spark, folder, "v_entries").select(*columns).filter("id % 3 <> 1")
    now = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    incoming = stream_table(spark, folder, "documents").filter("doc_id % 2 = 0 OR doc_id % 3 = 1").select(
        F.col("doc_id").alias("id"), F.col("source").alias("feed_name"),
        F.sha2(F.col("doc_id").cast("string"), 256).alias("source_guid"),
        F.concat(F.lit("New "), F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 120)).alias("source_title"),
        now.alias("refreshed_at"), now.alias("created_at"),
    )
    return upserts.stream_upsert(incoming, stored, buckets=32)


@query("stream_dedupe", "SELECT event_id, ts, user_id FROM events")
def stream_dedupe(spark, folder):
    twice = [stream_table(spark, folder, "events").select("event_id", "ts", "user_id") for _ in range(2)]
    return upserts.stream_dedupe(twice[0].union(twice[1]), ["event_id"])


@query("stream_usage_totals", f"{TOTALS} GROUP BY provider")
def stream_usage_totals(spark, folder):
    return upserts.stream_usage_totals(usage_stream(spark, folder))


@query("stream_usage_windows", """
    SELECT provider, date_trunc('day', created_at)::TIMESTAMP AS window_start, count(*) AS request_count,
      CAST(COALESCE(sum(total_tokens), 0) AS BIGINT) AS total_tokens FROM v_usage GROUP BY 1, 2""")
def stream_usage_windows(spark, folder):
    return upserts.stream_usage_windows(usage_stream(spark, folder).select("provider", "created_at", "total_tokens"))


@query("stream_rate_limit", f"""
    WITH RECURSIVE {RATE} SELECT CAST(user_id AS VARCHAR) AS client, event_id AS id, epoch_us(anchor) AS anchor, number, number > 3 AS rejected FROM walk""")
def stream_rate_limit(spark, folder):
    return stateful.stream_rate_limit(
        stream_table(spark, folder, "events"), "user_id", "ts", "event_id", limit=3, window_seconds=86400
    ).drop("late")


@query("stream_recheck_gate", """
    WITH RECURSIVE ranked AS (SELECT event_id, user_id, ts, event_id % 2 AS content,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    walk AS (
      SELECT event_id, user_id, rn, content AS known, ts AS fetched, true AS passed FROM ranked WHERE rn = 1
      UNION ALL
      SELECT r.event_id, r.user_id, r.rn,
        CASE WHEN r.content <> w.known OR r.ts >= w.fetched + INTERVAL '24' HOUR THEN r.content ELSE w.known END,
        CASE WHEN r.content <> w.known OR r.ts >= w.fetched + INTERVAL '24' HOUR THEN r.ts ELSE w.fetched END,
        r.content <> w.known OR r.ts >= w.fetched + INTERVAL '24' HOUR
      FROM walk w JOIN ranked r ON r.user_id = w.user_id AND r.rn = w.rn + 1)
    SELECT CAST(user_id AS VARCHAR) AS item, event_id AS id FROM walk WHERE passed""")
def stream_recheck_gate(spark, folder):
    items = stream_table(spark, folder, "events").withColumn("content", (F.col("event_id") % 2).cast("string"))
    return stateful.stream_recheck_gate(items, "user_id", "ts", "event_id", "content").drop("late")


CIRCUIT = """
    WITH RECURSIVE ev AS (SELECT concat('p', CAST(user_id % 50 AS VARCHAR)) AS provider, epoch_us(ts) AS us, event_id AS id,
        CASE event_type WHEN 'error' THEN 'limit' WHEN 'signup' THEN 'claim' WHEN 'click' THEN 'ok' WHEN 'view' THEN 'claim' ELSE 'fail' END AS kind,
        CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) + CAST(json_extract_string(props, '$.k') AS BIGINT) * 60000000 END AS hint,
        CASE WHEN event_id % 5 = 0 THEN 0 END AS claim,
        row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts, event_id) AS rn FROM events),
    walk AS (
      SELECT DISTINCT provider, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS kind, false AS accepted, 'closed' AS st,
        CAST(0 AS BIGINT) AS fails, CAST(NULL AS BIGINT) AS np, CAST(NULL AS BIGINT) AS lp, false AS pr FROM ev
      UNION ALL
      SELECT provider, rn, id, kind, opened OR extended OR closes OR claimed,
        CASE WHEN opened THEN 'open' WHEN closes THEN 'closed' WHEN claimed THEN 'half-open' ELSE st END,
        CASE WHEN opened THEN fails + 1 WHEN closes THEN 0 ELSE fails END,
        CASE WHEN opened THEN greatest(us + CASE least(fails, 3) WHEN 0 THEN 15 WHEN 1 THEN 30 WHEN 2 THEN 60 ELSE 120 END * CAST(60000000 AS BIGINT), COALESCE(hint, 0))
          WHEN extended THEN hint WHEN closes THEN NULL ELSE np END,
        CASE WHEN claimed THEN us ELSE lp END,
        CASE WHEN claimed THEN true WHEN kind IN ('ok', 'fail') AND cur THEN false ELSE pr END
      FROM (
        SELECT *, opens AND st <> 'open' AS opened, opens AND st = 'open' AND hint IS NOT NULL AND (np IS NULL OR hint > np) AS extended,
          kind IN ('ok', 'fail') AND (kind = 'ok' OR st = 'closed') AND cur AND st IN ('closed', 'half-open') AS closes,
          kind = 'claim' AND NOT pr AND st = 'open' AND COALESCE(np <= us, false) AS claimed
        FROM (
          SELECT *, kind = 'limit' OR (kind = 'fail' AND st <> 'closed' AND cur) AS opens FROM (
            SELECT w.provider, e.rn, e.id, e.kind, e.us, e.hint, w.fails, w.lp, w.pr AND (e.claim IS NULL OR e.claim = w.lp) AS cur,
              CASE WHEN e.kind = 'claim' AND w.pr AND w.lp <= e.us - 245000000 AND w.st = 'half-open' THEN 'open' ELSE w.st END AS st,
              CASE WHEN e.kind = 'claim' AND w.pr AND w.lp <= e.us - 245000000 AND w.st = 'half-open' THEN e.us ELSE w.np END AS np,
              w.pr AND NOT (e.kind = 'claim' AND w.lp <= e.us - 245000000) AS pr
            FROM walk w JOIN ev e ON e.provider = w.provider AND e.rn = w.rn + 1) x) y) z)
    SELECT provider, id, kind, accepted, st AS state, fails AS failures, np AS next_probe FROM walk WHERE rn > 0"""


@query("stream_circuit", CIRCUIT)
def stream_circuit(spark, folder):
    kinds = F.create_map(*[F.lit(x) for x in ("error", "limit", "signup", "claim", "click", "ok", "view", "claim", "purchase", "fail")])
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    hint = us + F.get_json_object("props", "$.k").cast("bigint") * 60_000_000
    events = stream_table(spark, folder, "events").select(
        F.concat(F.lit("p"), F.col("user_id") % 50).alias("provider"), us.alias("us"), F.col("event_id").alias("id"),
        F.try_element_at(kinds, F.col("event_type")).alias("kind"), F.when(F.col("event_id") % 3 == 0, hint).alias("hint"),
        F.when(F.col("event_id") % 5 == 0, F.lit(0).cast("bigint")).alias("claim"),
    )
    return stateful.stream_circuit(events).drop("late")


@query("stream_job_status", """
    SELECT idempotency_key, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at FROM v_job_events GROUP BY 1""")
def stream_job_status(spark, folder):
    kind = F.col("event_type")
    log = stream_table(spark, folder, "events").select(
        "event_id", "ts", F.sha2(F.col("user_id").cast("string"), 256).alias("idempotency_key"),
        F.when(kind == "signup", "queued").when(kind == "view", "running").when(kind == "error", "failed").otherwise("done").alias("status"),
    )
    return upserts.stream_job_status(log)
