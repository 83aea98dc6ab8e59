"""Queries of usage roll-ups, jobs, streaks, limits and rule matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import circuits, jobs, limits, matching, rollups
from feedloom.plans.dialect import host
from feedloom.plans.registry import query
from feedloom.sources.tables import view

TOTALS = """SELECT provider, count(*) AS request_count, CAST(COALESCE(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
    CAST(COALESCE(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
    CAST(COALESCE(sum(total_tokens), 0) AS BIGINT) AS total_tokens, max(created_at) AS updated_at FROM v_usage"""


def usage(spark, folder):
    return view(spark, folder, "v_usage")


@query("usage_totals", f"{TOTALS} GROUP BY provider")
def usage_totals(spark, folder):
    return rollups.usage_totals(usage(spark, folder))


@query("usage_totals_merge", f"{TOTALS} GROUP BY provider")
def usage_totals_merge(spark, folder):
    rows = usage(spark, folder)
    stored = rollups.usage_totals(rows.filter("id % 3 <> 0"))
    return rollups.usage_totals_merge(stored, rows.filter("id % 3 = 0"))


@query("usage_summary", f"""
    SELECT r.provider, id, created_at, status, r.total_tokens, rank, request_count, t.input_tokens AS sum_input_tokens,
      t.output_tokens AS sum_output_tokens, t.total_tokens AS sum_total_tokens
    FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY created_at DESC, id DESC) AS rank FROM v_usage) r
    JOIN ({TOTALS} GROUP BY provider) t ON t.provider = r.provider WHERE rank <= 20""")
def usage_summary(spark, folder):
    return rollups.usage_summary(usage(spark, folder))


@query("usage_by_kind_status", """
    SELECT request_kind, status, count(*) AS requests, CAST(COALESCE(sum(total_tokens), 0) AS BIGINT) AS total_tokens,
      CAST(grouping_id(request_kind, status) AS BIGINT) AS level FROM v_usage GROUP BY ROLLUP (request_kind, status)""")
def usage_by_kind_status(spark, folder):
    return rollups.usage_by_kind_status(usage(spark, folder))


@query("latency_percentiles", """
    SELECT scenario, quantile_disc(latency_ms, 0.5) AS p50, quantile_disc(latency_ms, 0.95) AS p95,
      CAST(sum(latency_ms) AS DOUBLE) / count(*) AS mean_ms, CAST(sum(calls) AS DOUBLE) / count(*) AS mean_calls,
      CAST(sum(aborted) AS BIGINT) AS aborted FROM v_latency GROUP BY scenario""")
def latency_percentiles(spark, folder):
    return rollups.latency_percentiles(view(spark, folder, "v_latency"))


@query("distinct_first_seen", """
    SELECT event_type, user_id, first_pos, row_number() OVER (PARTITION BY event_type ORDER BY first_pos) AS seen_no FROM (
      SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, min(event_id) AS first_pos FROM events GROUP BY 1, 2) t""")
def distinct_first_seen(spark, folder):
    rows = view(spark, folder, "events").select("event_type", F.col("user_id").cast("string"), "event_id")
    return rollups.distinct_first_seen(rows, ["event_type"], "user_id", "event_id")


@query("browser_cookie_group", """
    WITH last AS (SELECT concat('u', CAST(user_id % 50 AS VARCHAR), '.example.org') AS domain, event_type AS name,
        min(event_id) AS place, arg_max(CASE WHEN event_id % 4 = 0 THEN '' ELSE json_extract_string(props, '$.k') END, event_id) AS value
      FROM events GROUP BY 1, 2)
    SELECT domain, piece, string_agg(concat(name, '=', value), '; ' ORDER BY place) AS header, count(*) AS cookies, max(pieces) AS pieces
    FROM (SELECT *, (row_number() OVER (PARTITION BY domain ORDER BY place, name) - 1) // 3 AS piece, (count(*) OVER (PARTITION BY domain) + 2) // 3 AS pieces
      FROM last WHERE value <> '') t GROUP BY domain, piece""")
def browser_cookie_group(spark, folder):
    value = F.when(F.col("event_id") % 4 != 0, F.get_json_object("props", "$.k"))
    cookies = view(spark, folder, "events").select(
        F.concat(F.lit(" .U"), F.col("user_id") % 50, F.lit(".Example.org")).alias("domain"),
        F.concat(F.col("event_type"), F.lit(" ")).alias("name"), value.alias("value"), F.col("event_id").alias("pos"),
    )
    return rollups.cookie_headers(cookies, most=3)


@query("retry_schedule", """
    SELECT id, greatest(translation_last_failed_at
        + CASE least(translation_failure_count + 1, 4) WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 12 ELSE 24 END * INTERVAL '1' HOUR,
        CASE WHEN id % 2 = 0 THEN refreshed_at + INTERVAL '9' HOUR END) AS retry_after
    FROM v_entries WHERE translation_last_failed_at IS NOT NULL""")
def retry_schedule(spark, folder):
    failures = view(spark, folder, "v_entries").filter("translation_last_failed_at IS NOT NULL").select(
        "id", F.col("translation_failure_count").alias("failure_count"),
        F.col("translation_last_failed_at").alias("failed_at"),
        F.when(F.col("id") % 2 == 0, F.col("refreshed_at") + F.make_dt_interval(hours=F.lit(9))).alias("provider_retry_at"),
    )
    return jobs.retry_schedule(failures).select("id", "retry_after")


STREAK = """
    runs AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS run
      FROM events),
    streaks AS (SELECT *, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)
        OVER (PARTITION BY {key}, run ORDER BY ts, event_id) AS BIGINT) AS failure_count FROM runs)"""


@query("failure_streak", f"WITH {STREAK.format(key='user_id')} SELECT event_id, user_id, failure_count FROM streaks")
def failure_streak(spark, folder):
    log = view(spark, folder, "events").select("event_id", "user_id", "ts", "event_type")
    kind = F.col("event_type")
    streaks = jobs.failure_streak(log, "user_id", ["ts", "event_id"], kind == "error", kind == "purchase")
    return streaks.select("event_id", "user_id", "failure_count")


@query("circuit_backoff", """
    WITH RECURSIVE ev AS (SELECT event_id, user_id % 3 AS provider, epoch_us(ts) AS us, event_type = 'error' AS failed,
        CASE WHEN event_id % 3 = 0 THEN epoch_us(ts) + CAST(json_extract_string(props, '$.k') AS BIGINT) * 60000000 END AS hint,
        row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS rn FROM events WHERE event_type IN ('error', 'purchase')),
    walk AS (
      SELECT DISTINCT provider, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, false AS failed, false AS opened, CAST(0 AS BIGINT) AS fails, CAST(NULL AS BIGINT) AS probe FROM ev
      UNION ALL
      SELECT provider, rn, event_id, failed, opens, CASE WHEN NOT failed THEN 0 WHEN opens THEN fails + 1 ELSE fails END,
        CASE WHEN NOT failed THEN NULL WHEN opens THEN greatest(us + CASE least(fails, 3) WHEN 0 THEN 15 WHEN 1 THEN 30 WHEN 2 THEN 60 ELSE 120 END * CAST(60000000 AS BIGINT), coalesce(hint, 0))
          ELSE greatest(probe, coalesce(hint, 0)) END
      FROM (SELECT w.provider, e.rn, e.event_id, e.failed, e.us, e.hint, w.fails, w.probe, e.failed AND (w.fails = 0 OR e.us >= w.probe) AS opens
        FROM walk w JOIN ev e ON e.provider = w.provider AND e.rn = w.rn + 1) x)
    SELECT event_id, provider, fails AS failure_count, make_timestamp(probe) AS next_probe_at, opened FROM walk WHERE failed""")
def circuit_backoff(spark, folder):
    minutes = F.get_json_object("props", "$.k").cast("int")
    log = view(spark, folder, "events").select(
        "event_id", (F.col("user_id") % 3).alias("provider"), "ts", "event_type",
        F.when(F.col("event_id") % 3 == 0, F.col("ts") + F.make_dt_interval(mins=minutes)).alias("provider_retry_at"),
    )
    kind = F.col("event_type")
    out = circuits.circuit_backoff(log, "provider", ["ts", "event_id"], kind == "error", kind == "purchase")
    return out.select("event_id", "provider", "failure_count", "next_probe_at", "opened")


RATE = """
    ranked AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    walk AS (
      SELECT event_id, user_id, ts, rn, ts AS anchor, CAST(1 AS BIGINT) AS number FROM ranked WHERE rn = 1
      UNION ALL
      SELECT r.event_id, r.user_id, r.ts, r.rn, CASE WHEN r.ts >= w.anchor + INTERVAL '1' DAY THEN r.ts ELSE w.anchor END,
        CASE WHEN r.ts >= w.anchor + INTERVAL '1' DAY THEN 1 ELSE w.number + 1 END
      FROM walk w JOIN ranked r ON r.user_id = w.user_id AND r.rn = w.rn + 1)"""


@query("rate_limit_fixed", f"""
    WITH RECURSIVE {RATE}
    SELECT event_id, user_id, anchor AS window_start, number, number > 3 AS rejected,
      CASE WHEN number > 3 THEN greatest(1, CAST(ceil((epoch_us(anchor) + 86400000000 - epoch_us(ts)) / 1000000.0) AS BIGINT)) END AS retry_after
    FROM walk""")
def rate_limit_fixed(spark, folder):
    events = view(spark, folder, "events").select("event_id", "user_id", "ts")
    return limits.rate_limit_fixed(events, "user_id", "ts", "event_id", limit=3, window_seconds=86400)


KEYED = """keyed AS (SELECT *, concat('auto:', sha256(concat(request_json, ':', CAST(epoch_us(ts) // 86400000000 AS VARCHAR))))
    AS auto_key FROM v_job_events)"""


@query("idempotency_bucket", f"""
    WITH {KEYED} SELECT auto_key, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS created_at, count(*) - 1 AS repeats
    FROM keyed GROUP BY auto_key""")
def idempotency_bucket(spark, folder):
    return jobs.idempotency_bucket(view(spark, folder, "v_job_events"), minutes=24 * 60)


@query("idempotency_conflicts", """
    WITH requests AS (SELECT event_id, ts, concat('k', CAST(event_id % 2000 AS VARCHAR)) AS request_key, request_json FROM v_job_events),
    firsts AS (SELECT request_key, arg_min(request_json, (ts, event_id)) AS first_request FROM requests GROUP BY 1)
    SELECT event_id, r.request_key, request_json, first_request FROM requests r JOIN firsts f ON f.request_key = r.request_key
    WHERE request_json <> first_request""")
def idempotency_conflicts(spark, folder):
    requests = view(spark, folder, "v_job_events").select(
        "event_id", "ts", F.concat(F.lit("k"), F.col("event_id") % 2000).alias("request_key"), "request_json"
    )
    return jobs.idempotency_conflicts(requests, "request_key").select(
        "event_id", "request_key", "request_json", "first_request"
    )


@query("job_queue_head", """
    SELECT event_id AS id, ts AS created_at FROM v_job_events WHERE status = 'queued' ORDER BY ts, event_id LIMIT 25""")
def job_queue_head(spark, folder):
    rows = view(spark, folder, "v_job_events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "status")
    return jobs.job_queue_head(rows, 25).select("id", "created_at")


@query("job_listing", """
    SELECT event_id AS id, ts AS created_at, status FROM v_job_events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50""")
def job_listing(spark, folder):
    rows = view(spark, folder, "v_job_events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "status")
    return jobs.job_listing(rows, 50, 50)


@query("job_listing_deep", """
    SELECT event_id AS id, ts AS created_at, status FROM v_job_events ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 9000""")
def job_listing_deep(spark, folder):
    rows = view(spark, folder, "v_job_events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "status")
    return jobs.job_listing(rows, 50, 9000, direct=1000, left=1000)


LIFE = """life AS (SELECT idempotency_key, min(ts) AS created_at, max(ts) AS updated_at, arg_max(status, (ts, event_id)) AS status,
    min(ts) FILTER (WHERE status = 'running') AS started_at, min(ts) FILTER (WHERE status IN ('done', 'failed')) AS completed_at
    FROM v_job_events GROUP BY idempotency_key)"""


@query("job_lifecycle", f"""
    WITH {LIFE} SELECT idempotency_key, created_at, updated_at, CASE WHEN status = 'running' THEN 'queued' ELSE status END AS status,
      CASE WHEN status <> 'running' THEN started_at END AS started_at,
      CASE WHEN status <> 'running' THEN completed_at END AS completed_at FROM life""")
def job_lifecycle(spark, folder):
    return jobs.job_lifecycle(view(spark, folder, "v_job_events"), restarted=True)


@query("retry_failed_jobs", f"""
    WITH {LIFE}, named AS (SELECT *, CASE WHEN idempotency_key < '8' THEN concat('auto:', idempotency_key) ELSE idempotency_key END AS job_key,
      status = 'failed' AND idempotency_key < '8' AS again FROM life)
    SELECT job_key AS idempotency_key, CASE WHEN again THEN 'queued' ELSE status END AS status,
      CASE WHEN NOT again AND status = 'failed' THEN 'broken' END AS error, CASE WHEN NOT again AND status = 'done' THEN '1' END AS result_json,
      CASE WHEN NOT again THEN started_at END AS started_at, CASE WHEN NOT again THEN completed_at END AS completed_at FROM named""")
def retry_failed_jobs(spark, folder):
    life = jobs.job_lifecycle(view(spark, folder, "v_job_events"))
    key = F.col("idempotency_key")
    stored = life.select(
        F.when(key < "8", F.concat(F.lit("auto:"), key)).otherwise(key).alias("idempotency_key"), "status",
        F.when(F.col("status") == "failed", F.lit("broken")).alias("error"),
        F.when(F.col("status") == "done", F.lit("1")).alias("result_json"), "started_at", "completed_at",
    )
    return jobs.retry_failed_jobs(stored)


@query("interrupted_recovery", """
    SELECT 'feed' AS kind, feed_name AS name, CASE WHEN last_refresh_status = 'refreshing' THEN 'error' ELSE last_refresh_status END AS state,
      CASE WHEN last_refresh_status = 'refreshing' THEN 'refresh interrupted by process restart' ELSE last_refresh_error END AS error,
      CAST(NULL AS TIMESTAMP) AS next_probe_at FROM v_feeds
    UNION ALL
    SELECT 'circuit', provider, CASE WHEN provider = 'p0' THEN 'closed' ELSE 'open' END, CAST(NULL AS VARCHAR),
      CASE WHEN provider = 'p1' THEN TIMESTAMP '2024-02-01 00:00:00' WHEN provider = 'p2' THEN max(created_at) + INTERVAL '1' HOUR END
    FROM v_usage GROUP BY provider""")
def interrupted_recovery(spark, folder):
    feeds = jobs.recover_feeds(view(spark, folder, "v_feeds")).select(
        F.lit("feed").alias("kind"), F.col("feed_name").alias("name"), F.col("last_refresh_status").alias("state"),
        F.col("last_refresh_error").alias("error"), F.lit(None).cast("timestamp_ntz").alias("next_probe_at"),
    )
    provider = F.col("provider")
    circuits = usage(spark, folder).groupBy("provider").agg(F.max("created_at").alias("at")).select(
        "provider",
        F.when(provider == "p0", "closed").when(provider == "p1", "half-open").otherwise("open").alias("state"),
        F.when(provider != "p0", F.col("at") + F.make_dt_interval(hours=F.lit(1))).alias("next_probe_at"),
        (provider == "p1").alias("probe_in_progress"),
    )
    recovered = jobs.recover_circuits(circuits, "2024-02-01 00:00:00").select(
        F.lit("circuit").alias("kind"), F.col("provider").alias("name"), "state",
        F.lit(None).cast("string").alias("error"), "next_probe_at",
    )
    return feeds.unionByName(recovered)


RULE_ROWS = ("example.com", "example.org", "spam-farm.example.org", "therou.example.com")


@query("domain_rule_match", f"""
    WITH rules AS (SELECT * FROM (VALUES (1, 'example.com', 'r1'), (2, 'example.org', 'r2'), (3, 'spam-farm.example.org', 'r3'),
        (4, 'therou.example.com', 'r4'), (5, 'example.org', 'r5')) t(pos, domain, value)),
    latest AS (SELECT domain, arg_max(value, pos) AS value FROM rules GROUP BY domain),
    hosts AS (SELECT page_id, {host('url')} AS host FROM pages)
    SELECT h.page_id, arg_max(r.domain, length(r.domain)) AS rule_domain, arg_max(r.value, length(r.domain)) AS rule_value
    FROM hosts h LEFT JOIN latest r ON h.host = r.domain OR ends_with(h.host, '.' || r.domain) GROUP BY h.page_id""")
def domain_rule_match(spark, folder):
    rules = [(i + 1, ("." if i % 2 else "") + d, f"r{i + 1}") for i, d in enumerate(RULE_ROWS)] + [(5, "Example.org", "r5")]
    table = spark.createDataFrame(rules, "pos bigint, domain string, value string")
    pages = view(spark, folder, "pages").select("page_id", "url")
    return matching.domain_rule_match(pages, "url", table).drop("url")


V4_TABLE = ", ".join(
    f"('{n}', {int(n.network_address)}, {int(n.broadcast_address)})"
    for n in (matching.ipaddress.IPv4Network(b) for b in matching.IPV4_BLOCKS)
)


@query("cidr_block_match", f"""
    SELECT event_id, ip, block FROM v_host_ips LEFT JOIN (VALUES {V4_TABLE}) t(block, lo, hi) ON ip BETWEEN lo AND hi""")
def cidr_block_match(spark, folder):
    return matching.cidr_block_match(view(spark, folder, "v_host_ips"), "ip")


@query("address_block_match", f"""
    SELECT event_id, CASE
        WHEN event_id % 5 IN (0, 3) THEN EXISTS (SELECT 1 FROM (VALUES {V4_TABLE}) t(block, lo, hi) WHERE ip BETWEEN lo AND hi)
        WHEN event_id % 5 = 1 THEN false
        ELSE true END AS blocked FROM v_host_ips""")
def address_block_match(spark, folder):
    """Address texts of five kinds: IPv4, global IPv6, documentation IPv6, IPv4 mapped into IPv6, and no address."""
    ip = F.col("ip")
    octets = [F.floor(ip / d) % 256 for d in (2**24, 2**16, 2**8, 1)]
    dotted = F.concat_ws(".", *[o.cast("bigint").cast("string") for o in octets])
    tail = F.lower(F.hex(F.col("event_id") % 65536))
    kind = F.col("event_id") % 5
    address = (
        F.when(kind == 0, dotted).when(kind == 1, F.concat(F.lit("2A00:1450::"), tail))
        .when(kind == 2, F.concat(F.lit("2001:db8::"), tail)).when(kind == 3, F.concat(F.lit("::ffff:"), dotted))
        .otherwise(F.concat(dotted, F.lit(".9")))
    )
    rows = view(spark, folder, "v_host_ips").select("event_id", address.alias("address"))
    return matching.address_block_match(rows, "address").drop("address")
