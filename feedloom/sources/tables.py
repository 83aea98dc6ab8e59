"""Parquet tables and the collection views over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from feedloom.schemas import STORED, TABLES


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """Input of heavy per-row work: when it comes in fewer splits than there are cores (one large file, few row groups),
    its rows are spread by a unique key; input with enough splits stays as it is, without a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def load_snapshot(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Stored collection tables of one snapshot folder, read with their fixed schemas."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in STORED.items()}


# One text per view, read by Spark and (through `duckdb_text`) by the checking engine.
VIEWS = {
    "v_feeds": """
        SELECT source AS feed_name, concat('https://', source, '.example.org/feed.xml') AS source_url,
          CASE WHEN k % 3 = 0 THEN '' ELSE concat('Folder ', CAST(k % 3 AS STRING)) END AS folder,
          concat('Title ', source) AS title, k % 2 = 1 AS translate_enabled,
          CASE WHEN k % 5 <> 0 THEN CASE k % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'partial' WHEN 2 THEN 'error'
            ELSE 'refreshing' END END AS last_refresh_status,
          CASE WHEN k % 5 <> 0 THEN TIMESTAMP_NTZ '2024-01-02 00:00:00' + k * INTERVAL '1' HOUR END AS last_refreshed_at,
          CASE WHEN k % 4 = 2 THEN concat('fetch failed ', source) END AS last_refresh_error,
          TIMESTAMP_NTZ '2024-01-01 00:00:00' + k * INTERVAL '1' DAY AS created_at
        FROM (SELECT DISTINCT source, CAST(substring(source, 4) AS INT) AS k FROM {documents}) s""",
    "v_entries": """
        SELECT d.doc_id AS id, d.source AS feed_name, sha2(CAST(d.doc_id AS STRING), 256) AS source_guid,
          concat('https://', d.source, '.example.org/', d.lang, '/', CAST(d.doc_id AS STRING)) AS source_url,
          substring(split_part(d.text, chr(10), 1), 1, 120) AS source_title,
          CASE WHEN d.doc_id % 3 = 0 THEN concat('Author ', CAST(d.doc_id % 10 AS STRING)) END AS source_author,
          d.text AS source_content_html,
          CASE d.doc_id % 4 WHEN 0 THEN concat('<article>', d.text, '</article>') WHEN 1 THEN '' END
            AS extracted_content_html,
          CASE WHEN l.quality = 1 THEN concat('zh:', substring(split_part(d.text, chr(10), 1), 1, 40)) END
            AS translated_title,
          CASE WHEN l.quality = 1 AND d.doc_id % 2 = 0 THEN concat('<p>zh ', substring(d.text, 1, 300), '</p>')
               WHEN l.quality = 1 THEN '' END AS translated_content_html,
          CASE WHEN l.quality = 1 THEN 'readability+zh' WHEN d.doc_id % 2 = 0 THEN 'rss' ELSE 'readability' END
            AS translation_provider,
          CASE WHEN d.doc_id % 7 = 0 THEN NULL
               ELSE TIMESTAMP_NTZ '2024-01-01 00:00:00' + (d.doc_id % 5) * INTERVAL '1' DAY END AS source_published_at,
          TIMESTAMP_NTZ '2024-01-01 00:00:00' + d.doc_id * INTERVAL '1' MINUTE AS refreshed_at,
          CASE WHEN d.doc_id % 6 <> 0 THEN
               TIMESTAMP_NTZ '2024-01-01 00:00:00' + (d.doc_id - (d.doc_id % 48) * 60) * INTERVAL '1' MINUTE END
            AS source_fetched_at,
          TIMESTAMP_NTZ '2023-12-01 00:00:00' + d.doc_id * INTERVAL '1' MINUTE AS created_at,
          CASE WHEN l.toxic = 1 THEN 'error' ELSE 'ok' END AS refresh_status,
          CASE WHEN l.toxic = 1 THEN concat('failed ', d.lang) END AS refresh_error,
          CASE WHEN l.quality = 0 THEN d.doc_id % 6 ELSE 0 END AS translation_failure_count,
          CASE WHEN l.quality = 0 AND d.doc_id % 3 = 0 THEN concat('usage limit ', d.lang) END AS translation_last_error,
          CASE WHEN l.quality = 0 AND d.doc_id % 3 = 0 THEN
               TIMESTAMP_NTZ '2024-01-01 01:00:00' + d.doc_id * INTERVAL '1' MINUTE END AS translation_last_failed_at,
          CASE WHEN l.quality = 0 THEN TIMESTAMP_NTZ '2024-01-01 02:00:00' + d.doc_id * INTERVAL '1' MINUTE END
            AS translation_retry_after
        FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
    "v_incoming": """
        SELECT id, feed_name, source_guid, source_url,
          CASE WHEN id % 10 = 0 THEN concat('New ', source_title) ELSE source_title END AS source_title,
          source_author, source_content_html,
          CASE WHEN id % 14 = 0 THEN concat(source_content_html, '<p>more</p>') ELSE source_content_html END
            AS page_html,
          source_published_at, TIMESTAMP_NTZ '2024-01-01 12:00:00' AS refreshed_at
        FROM {v_entries} WHERE id % 2 = 0
        UNION ALL
        SELECT id + 1000000, feed_name, sha2(CAST(id + 1000000 AS STRING), 256), concat(source_url, '/new'),
          source_title, source_author, source_content_html, source_content_html,
          source_published_at, TIMESTAMP_NTZ '2024-01-01 12:00:00'
        FROM {v_entries} WHERE id % 50 = 0""",
    "v_usage": """
        SELECT event_id AS id, concat('p', CAST(user_id % 3 AS STRING)) AS provider,
          concat('m', CAST(user_id % 2 AS STRING)) AS model,
          CASE WHEN event_type = 'signup' THEN 'probe' ELSE 'translation' END AS request_kind,
          CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'click' AND user_id % 7 = 0 THEN 'cancelled'
            ELSE 'ok' END AS status,
          CASE WHEN event_type = 'error' THEN NULL ELSE CAST(get_json_object(props, '$.k') AS BIGINT) END AS total_tokens,
          CASE WHEN event_type = 'error' THEN NULL ELSE CAST(get_json_object(props, '$.k') AS BIGINT) * 2 END
            AS input_tokens,
          CASE WHEN event_type = 'view' THEN CAST(get_json_object(props, '$.k') AS BIGINT) + 1 END AS output_tokens,
          CASE WHEN event_type = 'error' THEN concat('usage limit ', CAST(user_id % 4 AS STRING)) END AS error,
          ts AS created_at
        FROM {events}""",
    "v_job_events": """
        SELECT event_id, ts, sha2(CAST(user_id AS STRING), 256) AS idempotency_key, user_id,
          CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'error' THEN 'failed'
            ELSE 'done' END AS status,
          concat('[', CAST(user_id AS STRING), ']') AS request_json
        FROM {events}""",
    "v_thread_posts": """
        SELECT conv_id AS conversation_id, conv_id * 1000 + turn AS post_id, turn, role AS author, text,
          min(turn) OVER (PARTITION BY conv_id) AS root_turn
        FROM {conversations}""",
    "v_posts": """
        SELECT conv_id AS conversation_id, conv_id * 1000 + turn AS post_id, role AS author, text,
          TIMESTAMP_NTZ '2024-01-01 00:00:00' + turn * INTERVAL '1' MINUTE AS created_at,
          CASE WHEN turn % 4 IN (1, 3) THEN 'assistant' WHEN turn % 4 = 2 THEN 'user' END AS reply_to_author,
          CASE WHEN turn % 3 = 1 THEN conv_id * 1000 END AS reply_to_post
        FROM {conversations}""",
    "v_blocks": """
        SELECT conv_id AS doc_id, turn AS pos, text,
          CASE length(text) % 7 WHEN 0 THEN 'header-two' WHEN 1 THEN 'unstyled' WHEN 2 THEN 'blockquote'
            WHEN 3 THEN 'code-block' WHEN 4 THEN 'code-block' ELSE 'ordered-list-item' END AS block_type
        FROM {conversations}""",
    "v_outline": """
        SELECT concat('r', CAST(r_regionkey AS STRING)) AS node_id, CAST(NULL AS STRING) AS parent_id, r_name AS text,
          CAST(NULL AS STRING) AS xml_url FROM {region}
        UNION ALL
        SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)), n_name, NULL
        FROM {nation}
        UNION ALL
        SELECT concat('s', CAST(s_suppkey AS STRING)), concat('n', CAST(s_nationkey AS STRING)), s_name,
          concat('https://s', CAST(s_suppkey AS STRING), '.example.org/feed.xml') FROM {supplier}""",
    "v_host_ips": """
        SELECT event_id, (event_id * 2654435761) % 4294967296 AS ip FROM {events}""",
    "v_pages": """
        SELECT page_id, url, concat(html,
          CASE page_id % 6
            WHEN 0 THEN concat('<article><img src="/img/', CAST(page_id AS STRING), '.jpg" alt="Lead" onclick="x()"></article>')
            WHEN 1 THEN '<meta property="og:image" content="https://cdn.example.org/og.png"><meta property="og:title" content="Og title">'
            WHEN 2 THEN '<a href="java&#x73;cript:alert(1)" style="color:red">x</a><a href="mailto:a@example.org" rel="ugc opener">m</a>'
            WHEN 3 THEN '<main><img data-src="lazy.png" srcset="/s.jpg 1x, https://cdn.example.org/l.jpg 2x, javascript:alert(1) 3x"></main>'
            WHEN 4 THEN '<iframe srcdoc="x"></iframe><x-card>c</x-card><p>Something went wrong, but don’t fret.</p>'
            ELSE '<a HREF="https://other.example.org/a" target="_top" rel="nofollow NoOpener evil" title="a > b">o</a><td colspan=2 onclick=x nowrap class=c> ... continue reading' END) AS html
        FROM {pages}""",
    "v_markdown": """
        SELECT doc_id, source, concat('# Doc ', CAST(doc_id AS STRING), chr(10),
          replace(replace(text, concat(chr(10), 'E'), concat(chr(10), '## E part', chr(10), 'E')),
                  concat(chr(10), 'I'), concat(chr(10), '### I part', chr(10), 'I'))) AS markdown
        FROM {documents}""",
    "v_latency": """
        SELECT event_type AS scenario, CAST(round(value * 100) AS BIGINT) AS latency_ms, user_id % 3 AS calls,
          CASE WHEN user_id % 9 = 0 THEN 1 ELSE 0 END AS aborted
        FROM {events}""",
    "v_responses": """
        SELECT conv_id * 1000 + turn AS response_id, concat('p', CAST(conv_id % 3 AS STRING)) AS provider,
          concat('m', CAST(turn % 2 AS STRING)) AS model,
          CASE (conv_id + turn) % 6
            WHEN 0 THEN concat('{OPEN}"translatedTitle":"T', CAST(turn AS STRING), '","translatedContentHtml":"<p>x</p>"{CLOSE}')
            WHEN 1 THEN concat('```json', chr(10), '{OPEN}"translatedTitle":"T"{CLOSE}', chr(10), '```')
            WHEN 2 THEN concat('```', chr(10), '{OPEN}"translatedTitle":"T","translatedContentHtml":"b"{CLOSE}', chr(10), '```')
            WHEN 3 THEN '  '
            WHEN 4 THEN '{OPEN}"translatedTitle":"  ","translatedContentHtml":"b"{CLOSE}'
            ELSE text END AS raw
        FROM {conversations}""",
}

SPARK_TOKENS = {"OPEN": "{{", "CLOSE": "}}"}
DUCK_TOKENS = {"OPEN": "{", "CLOSE": "}"}


def needs(text: str) -> list[str]:
    """Names of the tables and views that a view text reads."""
    return sorted(set(re.findall(r"\{([a-z_]+)\}", text)))


def _tokens(text: str, tokens: dict[str, str]) -> str:
    for name, value in tokens.items():
        text = text.replace("{" + name + "}", value)
    return text


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if name in TABLES:
        return table(spark, folder, name)
    text = VIEWS[name]
    sources = {n: view(spark, folder, n) for n in needs(text)}
    return spark.sql(_tokens(text, SPARK_TOKENS), **sources)


def duckdb_text(name: str) -> str:
    text = VIEWS[name]
    for source in needs(text):
        text = text.replace("{" + source + "}", source)
    text = _tokens(text, DUCK_TOKENS)
    text = re.sub(r"sha2\((CAST\([^)]*\)), 256\)", r"sha256(\1)", text)
    text = text.replace("TIMESTAMP_NTZ", "TIMESTAMP").replace("get_json_object", "json_extract_string")
    return text
