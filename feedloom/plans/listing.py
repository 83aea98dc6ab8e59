"""Queries of the listing operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.functions import urls as ul
from feedloom.operators import lists
from feedloom.plans.dialect import HOST, PATH, http_url, norm, strip, truncate
from feedloom.plans.registry import query
from feedloom.plans.samples import disguised
from feedloom.sources.tables import view

NOW = "2024-01-01 08:00:00"
SORT_TS = "COALESCE(source_published_at, refreshed_at)"
NEWEST = f"{SORT_TS} DESC NULLS LAST, id DESC"
DISPLAY_HTML = "COALESCE(NULLIF(translated_content_html, ''), NULLIF(extracted_content_html, ''), NULLIF(source_content_html, ''), '')"
DISPLAY_TITLE = "COALESCE(NULLIF(translated_title, ''), NULLIF(source_title, ''), 'Untitled')"
ERROR = "(refresh_status = 'error' OR translation_retry_after IS NOT NULL)"
SEARCH_TEXT = f"lower({norm('concat_ws(chr(32), translated_title, source_title, source_url)')})"
FEED_LIST = f"""
    SELECT f.feed_name, source_url, folder, title, translate_enabled,
      COALESCE(NULLIF(last_refresh_status, ''), 'idle') AS last_refresh_status,
      COALESCE(last_refresh_error, '') AS last_refresh_error, last_refreshed_at, created_at, false AS is_managed,
      (SELECT count(*) FROM v_entries e WHERE e.feed_name = f.feed_name) AS entry_count,
      (SELECT count(*) FROM v_entries e WHERE e.feed_name = f.feed_name AND {ERROR}) AS error_count
    FROM v_feeds f"""
FAILING = "(error_count > 0 OR COALESCE(last_refresh_status IN ('error', 'partial'), false))"


def entries(spark, folder):
    return view(spark, folder, "v_entries")


def feeds(spark, folder):
    return view(spark, folder, "v_feeds")


@query("load_tables", """
    SELECT 'feeds' AS table_name, count(*) AS n FROM v_feeds UNION ALL SELECT 'entries', count(*) FROM v_entries
    UNION ALL SELECT 'usage', count(*) FROM v_usage UNION ALL SELECT 'jobs', count(*) FROM v_job_events
    UNION ALL SELECT 'pages', count(*) FROM pages""")
def load_tables(spark, folder):
    names = {"feeds": "v_feeds", "entries": "v_entries", "usage": "v_usage", "jobs": "v_job_events", "pages": "pages"}
    counts = [view(spark, folder, v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
              for t, v in names.items()]
    out = counts[0]
    for other in counts[1:]:
        out = out.unionByName(other)
    return out


@query("latest_per_feed", f"""
    SELECT feed_name, rank, id, {SORT_TS} AS sort_ts, {DISPLAY_TITLE} AS display_title FROM (
      SELECT *, row_number() OVER (PARTITION BY feed_name ORDER BY {NEWEST}) AS rank FROM v_entries) t
    WHERE rank <= 5""")
def latest_per_feed(spark, folder):
    top = lists.latest_per_feed(entries(spark, folder), 5)
    return top.select("feed_name", "rank", "id", lists.sort_ts().alias("sort_ts"),
                      lists.display_title().alias("display_title"))


@query("entry_light_projection", """
    SELECT id, feed_name, source_guid, source_url, source_title, translated_title, source_published_at, refreshed_at,
      created_at, CASE WHEN translated_content_html IS NOT NULL AND translated_content_html <> '' THEN 1 ELSE 0 END
      AS is_translated FROM v_entries""")
def entry_light_projection(spark, folder):
    return lists.light_projection(entries(spark, folder))


@query("entry_render_projection", f"""
    SELECT id, source_guid, source_url, source_title, source_author, source_published_at, source_content_html,
      extracted_content_html, translated_title, translated_content_html,
      {truncate(strip(DISPLAY_HTML), 240)} AS article_excerpt, translation_provider, refresh_status, refreshed_at
    FROM v_entries""")
def entry_render_projection(spark, folder):
    return lists.render_projection(entries(spark, folder))


@query("search_entries", f"""
    SELECT id, feed_name, source_title FROM v_entries WHERE contains({SEARCH_TEXT}, 'tion')""")
def search_entries(spark, folder):
    """Titles are disguised in the table that is searched; the checking SQL searches them as they were."""
    texts = lists.with_search_text(entries(spark, folder).withColumn("plain", F.col("source_title")).withColumn("source_title", disguised(F.col("source_title"))))
    return lists.search_entries(texts, "Ｔion").select("id", "feed_name", F.col("plain").alias("source_title"))


@query("build_search_text", f"SELECT id, {SEARCH_TEXT} AS search_text FROM v_entries")
def build_search_text(spark, folder):
    titles = {c: disguised(F.col(c)) for c in ("source_title", "translated_title")}
    return lists.with_search_text(entries(spark, folder).withColumns(titles)).select("id", "search_text")


@query("search_count", f"SELECT count(*) AS entry_count FROM v_entries WHERE contains({SEARCH_TEXT}, 'src1')")
def search_count(spark, folder):
    hidden = entries(spark, folder).withColumn("source_url", disguised(F.col("source_url")))
    return lists.search_count(lists.with_search_text(hidden), "ＳＲＣ①")


@query("display_fields", f"""
    SELECT e.id, e.feed_name, {DISPLAY_TITLE} AS display_title, {DISPLAY_HTML} AS display_html,
      COALESCE(translated_content_html, '') <> '' AS is_translated,
      COALESCE(NULLIF(f.title, ''), e.feed_name) AS feed_title
    FROM v_entries e LEFT JOIN v_feeds f ON f.feed_name = e.feed_name""")
def display_fields(spark, folder):
    return lists.display_fields(entries(spark, folder), feeds(spark, folder))


@query("entry_error_filter", f"SELECT id, feed_name, refresh_status, refresh_error FROM v_entries WHERE {ERROR}")
def entry_error_filter(spark, folder):
    return entries(spark, folder).filter(lists.has_error()).select("id", "feed_name", "refresh_status", "refresh_error")


@query("feed_list", FEED_LIST)
def feed_list(spark, folder):
    return lists.in_list_order(lists.feed_list(feeds(spark, folder), entries(spark, folder)))


@query("feed_list_filter", f"""
    SELECT feed_name, folder, error_count, last_refresh_status FROM ({FEED_LIST}) t
    WHERE contains(lower(concat_ws(chr(10), title, feed_name, source_url, folder)), 'folder 1') AND {FAILING}""")
def feed_list_filter(spark, folder):
    listed = lists.feed_list(feeds(spark, folder), entries(spark, folder))
    kept = lists.feed_list_filter(listed, "Folder  1", "error")
    return kept.select("feed_name", "folder", "error_count", "last_refresh_status")


@query("folder_rollup", f"""
    SELECT COALESCE(NULLIF(folder, ''), 'uncategorised') AS folder, count(*) AS feeds,
      count(*) FILTER (WHERE {FAILING}) AS failing_feeds FROM ({FEED_LIST}) t GROUP BY 1""")
def folder_rollup(spark, folder):
    return lists.folder_rollup(lists.feed_list(feeds(spark, folder), entries(spark, folder)))


@query("drop_live_pages", f"""
    SELECT page_id, url FROM pages WHERE NOT COALESCE(({HOST} = 'example.com' OR ends_with({HOST}, '.example.com'))
      AND starts_with({PATH}, '/en/'), false)""")
def drop_live_pages(spark, folder):
    return lists.drop_live_pages(view(spark, folder, "pages").select("page_id", "url"), "url", "example.com", "/en/")


@query("sitemap_dimension_filter", f"""
    WITH parts AS (
      SELECT page_id, url, {HOST} AS host, list_filter(string_split(lower({PATH}), '/'), lambda p: p <> '') AS parts
      FROM pages),
    dims AS (
      SELECT *, CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN
          CASE parts[1] WHEN 'de' THEN 'de' WHEN 'es' THEN 'es' WHEN 'fr' THEN 'fr' WHEN 'jp' THEN 'ja' WHEN 'it' THEN 'it'
            WHEN 'ar' THEN 'ar' WHEN 'pt' THEN 'pt' WHEN 'latam' THEN 'es' END END AS local FROM parts WHERE host IS NOT NULL),
    full_dims AS (
      SELECT page_id, COALESCE(local, CASE WHEN host = 'example.com' OR ends_with(host, '.example.com') THEN 'en'
          ELSE 'xx' END) AS language,
        COALESCE(CASE WHEN local IS NULL THEN parts[1] ELSE parts[2] END, '') AS section FROM dims)
    SELECT * FROM full_dims WHERE language IN ('en', 'fr', 'xx')""")
def sitemap_dimension_filter(spark, folder):
    pages = view(spark, folder, "pages").select("page_id", "url", F.lit(" XX ").alias("meta"))
    dims = lists.with_dimensions(pages, "url", "meta", domain="example.com")
    return lists.dimension_filter(dims, ["EN", "fr", "xx"]).select("page_id", "language", "section")


@query("valid_http_url", f"SELECT page_id, {http_url('url')} AS url FROM pages WHERE {http_url('url')} IS NOT NULL")
def valid_http_url(spark, folder):
    return lists.valid_http_url(view(spark, folder, "pages").select("page_id", "url"), "url")


@query("managed_feed_filter", "SELECT feed_name, source_url FROM v_feeds WHERE feed_name NOT LIKE '%1'")
def managed_feed_filter(spark, folder):
    kept = F.when(F.endswith(F.col("feed_name"), F.lit("1")), ul.managed_url(F.col("feed_name")))
    rows = feeds(spark, folder).withColumn("source_url", F.coalesce(kept, F.col("source_url")))
    return lists.without_managed(rows).select("feed_name", "source_url")


@query("due_filter", f"SELECT id, translation_retry_after FROM v_entries WHERE translation_retry_after <= TIMESTAMP '{NOW}'")
def due_filter(spark, folder):
    return lists.due_filter(entries(spark, folder), NOW).select("id", "translation_retry_after")


@query("due_retries", f"""
    SELECT e.id, e.feed_name, e.translation_retry_after FROM v_entries e JOIN v_feeds f ON f.feed_name = e.feed_name
    WHERE f.translate_enabled AND e.translation_retry_after <= TIMESTAMP '{NOW}'
    ORDER BY e.translation_retry_after, e.id LIMIT 50""")
def due_retries(spark, folder):
    ready = lists.due_retries(entries(spark, folder), feeds(spark, folder), NOW, 50)
    return ready.select("id", "feed_name", "translation_retry_after")


@query("due_retries_one_feed", f"""
    SELECT id, translation_retry_after FROM v_entries
    WHERE feed_name = 'src3' AND translation_retry_after <= TIMESTAMP '2024-01-01 12:00:00'
    ORDER BY translation_retry_after, id LIMIT 50""")
def due_retries_one_feed(spark, folder):
    ready = lists.due_retries_one_feed(entries(spark, folder), "src3", "2024-01-01 12:00:00", 50)
    return ready.select("id", "translation_retry_after")


@query("recent_errors_per_feed", f"""
    SELECT * FROM (
      SELECT id, feed_name, source_title, source_url, COALESCE(translation_last_error, refresh_error) AS error,
        COALESCE(translation_last_failed_at, refreshed_at) AS failed_at,
        row_number() OVER (PARTITION BY feed_name
          ORDER BY COALESCE(translation_last_failed_at, refreshed_at) DESC NULLS LAST, id DESC) AS rank
      FROM v_entries WHERE {ERROR}) t WHERE rank <= 3""")
def recent_errors_per_feed(spark, folder):
    return lists.recent_errors_per_feed(entries(spark, folder), 3)


@query("page_entries", f"""
    SELECT id, {SORT_TS} AS sort_ts FROM v_entries ORDER BY {NEWEST} LIMIT 50 OFFSET 100""")
def page_entries(spark, folder):
    page = lists.page_entries(lists.with_search_text(entries(spark, folder)), limit=50, offset=100)
    return page.select("id", lists.sort_ts().alias("sort_ts"))


@query("page_entries_deep", f"""
    SELECT id, sort_ts FROM (SELECT id, {SORT_TS} AS sort_ts, row_number() OVER (ORDER BY {NEWEST}) AS place FROM v_entries) t
    WHERE place > 700 AND place <= 750""")
def page_entries_deep(spark, folder):
    """A page past what a task's heap may hold: the range with the offset is found by counts."""
    page = lists.page_entries(lists.with_search_text(entries(spark, folder)), limit=50, offset=700, direct=500, left=100)
    return page.select("id", lists.sort_ts().alias("sort_ts"))


@query("page_entries_after", f"""
    SELECT id, {SORT_TS} AS sort_ts FROM v_entries
    WHERE {SORT_TS} < TIMESTAMP '2024-01-03 00:00:00' OR ({SORT_TS} = TIMESTAMP '2024-01-03 00:00:00' AND id < 500)
    ORDER BY {NEWEST} LIMIT 50""")
def page_entries_after(spark, folder):
    page = lists.page_after(entries(spark, folder), "2024-01-03 00:00:00", 500, 50)
    return page.select("id", lists.sort_ts().alias("sort_ts"))


@query("lookup_by_key", """
    SELECT id, feed_name, source_guid FROM v_entries
    WHERE (feed_name, source_guid) IN (SELECT concat('src', CAST(doc_id % 20 AS VARCHAR)), sha256(CAST(doc_id AS VARCHAR))
      FROM labels WHERE quality = 1)""")
def lookup_by_key(spark, folder):
    wanted = view(spark, folder, "labels").filter("quality = 1").select(
        F.concat(F.lit("src"), F.col("doc_id") % 20).alias("feed_name"),
        tx.hash_text(F.col("doc_id").cast("string")).alias("source_guid"),
    )
    found = lists.lookup(entries(spark, folder), wanted, ["feed_name", "source_guid"])
    return found.select("id", "feed_name", "source_guid")


@query("refresh_slice", """
    SELECT feed_name, id, pos, rank FROM (
      SELECT feed_name, id, id AS pos, row_number() OVER (PARTITION BY feed_name
        ORDER BY source_published_at DESC NULLS LAST, id) AS rank FROM v_entries) t WHERE rank <= 10""")
def refresh_slice(spark, folder):
    items = entries(spark, folder).select(
        "feed_name", "id", F.col("id").alias("pos"), F.col("source_published_at").alias("published_at")
    )
    return lists.refresh_slice(items, 10, dated=True).select("feed_name", "id", "pos", "rank")


@query("sort_by_optional_date", """
    SELECT pos, CASE WHEN pos % 4 = 0 THEN NULL ELSE ts END AS published_at FROM (
      SELECT event_id AS pos, date_trunc('second', ts) AS ts FROM events) t""")
def sort_by_optional_date(spark, folder):
    pos, ts = F.col("event_id"), F.col("ts")
    text = (
        F.when(pos % 8 == 0, F.lit("not a date"))
        .when(pos % 4 == 0, F.lit(None))
        .when(pos % 4 == 1, F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss 'GMT'"))
        .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    items = view(spark, folder, "events").select(pos.alias("pos"), text.alias("date_text"))
    ordered = lists.sort_by_optional_date(items, "date_text")
    return ordered.select("pos", F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@query("union_sources", """
    SELECT feed_name, id, 'sitemap' AS kind FROM v_entries WHERE feed_name IN ('src1', 'src2', 'src3')
    UNION ALL SELECT feed_name, id, 'rss' FROM v_entries WHERE feed_name NOT IN ('src1', 'src2', 'src3')""")
def union_sources(spark, folder):
    items = entries(spark, folder).select("feed_name", "id")
    sitemap = items.filter(F.col("feed_name").isin("src1", "src2", "src3")).withColumn("kind", F.lit("sitemap"))
    return lists.union_sources(sitemap, items.withColumn("kind", F.lit("rss")))


@query("except_managed", """
    SELECT feed_name FROM v_feeds WHERE feed_name NOT LIKE '%1' EXCEPT SELECT feed_name FROM v_feeds WHERE folder = ''""")
def except_managed(spark, folder):
    kept = F.when(F.endswith(F.col("feed_name"), F.lit("1")), ul.managed_url(F.col("feed_name")))
    rows = feeds(spark, folder).withColumn("source_url", F.coalesce(kept, F.col("source_url")))
    return lists.except_managed(rows, feeds(spark, folder).filter("folder = ''")).select("feed_name")


@query("common_feeds", """
    SELECT xml_url AS source_url FROM v_outline WHERE xml_url IS NOT NULL
      AND replace(xml_url, 'https://s', 'https://src') IN (SELECT source_url FROM v_feeds)""")
def common_feeds(spark, folder):
    leaves = view(spark, folder, "v_outline").filter("xml_url IS NOT NULL").select("xml_url")
    incoming = leaves.withColumn("source_url", F.replace(F.col("xml_url"), F.lit("https://s"), F.lit("https://src")))
    return lists.common_feeds(incoming, feeds(spark, folder)).select(F.col("xml_url").alias("source_url"))


@query("snapshot_retention", """
    WITH names AS (SELECT DISTINCT event_type AS table_name, concat(event_type, '-', strftime(ts, '%Y%m%d%H')) AS snapshot
      FROM events)
    SELECT table_name, snapshot, newest FROM (
      SELECT *, row_number() OVER (PARTITION BY table_name ORDER BY snapshot DESC) AS rn,
        max(snapshot) OVER (PARTITION BY table_name) AS newest FROM names) t WHERE rn > 7""")
def snapshot_retention(spark, folder):
    name = F.concat_ws("-", "event_type", F.date_format("ts", "yyyyMMddHH"))
    manifest = view(spark, folder, "events").select(F.col("event_type").alias("table_name"), name.alias("snapshot"))
    return lists.snapshot_retention(manifest, 7)
