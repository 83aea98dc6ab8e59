"""Explicit schemas: jobs never infer them."""

TABLES = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
}

# Stored tables of the content collection (keys first).
FEEDS = (
    "feed_name STRING, source_url STRING, folder STRING, title STRING, translate_enabled BOOLEAN, "
    "content_updated_at TIMESTAMP, content_revision BIGINT, last_refreshed_at TIMESTAMP, "
    "last_refresh_status STRING, last_refresh_error STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
ENTRIES = (
    "id BIGINT, feed_name STRING, source_guid STRING, source_url STRING, search_text STRING, "
    "source_title STRING, source_author STRING, source_published_at TIMESTAMP, source_content_html STRING, "
    "extracted_content_html STRING, source_fetched_at TIMESTAMP, content_updated_at TIMESTAMP, "
    "translated_title STRING, translated_content_html STRING, article_excerpt STRING, "
    "translation_provider STRING, refresh_status STRING, refresh_error STRING, refreshed_at TIMESTAMP, "
    "created_at TIMESTAMP, updated_at TIMESTAMP, translation_failure_count BIGINT, "
    "translation_last_error STRING, translation_last_failed_at TIMESTAMP, translation_retry_after TIMESTAMP"
)
USAGE = (
    "id BIGINT, provider STRING, model STRING, request_kind STRING, status STRING, input_tokens BIGINT, "
    "output_tokens BIGINT, total_tokens BIGINT, error STRING, created_at TIMESTAMP"
)
CIRCUITS = (
    "provider STRING, state STRING, failure_count BIGINT, opened_at TIMESTAMP, next_probe_at TIMESTAMP, "
    "last_probe_at TIMESTAMP, last_error STRING, probe_in_progress BOOLEAN, updated_at TIMESTAMP"
)
JOBS = (
    "id STRING, idempotency_key STRING, request_json STRING, status STRING, result_json STRING, error STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP, started_at TIMESTAMP, completed_at TIMESTAMP"
)
STORED = {
    "feeds": FEEDS,
    "entries": ENTRIES,
    "translation_usage": USAGE,
    "translation_circuits": CIRCUITS,
    "read_later_jobs": JOBS,
}
