"""Listing operators: projections, predicates, top-k per group, pages, set operations."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.functions import urls as ul
from feedloom.functions.values import parse_date, unzoned_micros
from feedloom.operators.paging import page

RENDER_COLUMNS = (
    "id", "source_guid", "source_url", "source_title", "source_author", "source_published_at",
    "source_content_html", "extracted_content_html", "translated_title", "translated_content_html",
    "article_excerpt", "translation_provider", "refresh_status", "refreshed_at",
)
LIGHT_COLUMNS = (
    "id", "feed_name", "source_guid", "source_url", "source_title", "translated_title", "source_published_at",
    "refreshed_at", "created_at",
)


def sort_ts() -> Column:
    return F.coalesce("source_published_at", "refreshed_at")


def newest_first() -> list[Column]:
    return [sort_ts().desc_nulls_last(), F.col("id").desc()]


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per group. The bound on row_number lets Spark prune each task's input before the shuffle,
    so a large group sends at most n rows per task."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= n)
    return ranked.withColumn(rank, F.col(rank).cast("bigint"))


def with_excerpt(entries: DataFrame) -> DataFrame:
    return entries.withColumn("article_excerpt", tx.truncate_text(tx.strip_html(display_html()), 240))


def display_html() -> Column:
    return F.coalesce(
        tx.first_filled(F.col("translated_content_html"), F.col("extracted_content_html"), F.col("source_content_html")),
        F.lit(""),
    )


def display_title() -> Column:
    return F.coalesce(tx.first_filled(F.col("translated_title"), F.col("source_title")), F.lit("Untitled"))


def latest_per_feed(entries: DataFrame, n: int) -> DataFrame:
    return top_per_group(entries, ["feed_name"], newest_first(), n)


def display_fields(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """What a reader sees of an entry. The shown title and body are resolved before the join."""
    shown = entries.select(
        "id", "feed_name", display_title().alias("display_title"), display_html().alias("display_html"),
        tx.blank_to_null(F.col("translated_content_html")).isNotNull().alias("is_translated"),
    )
    titles = feeds.select(
        "feed_name", F.coalesce(tx.blank_to_null(F.col("title")), F.col("feed_name")).alias("feed_title")
    )
    joined = shown.join(titles, "feed_name", "left")
    return joined.withColumn("feed_title", F.coalesce("feed_title", "feed_name"))


def light_projection(entries: DataFrame) -> DataFrame:
    translated = F.coalesce(F.col("translated_content_html") != "", F.lit(False)).cast("int")
    return entries.select(*LIGHT_COLUMNS, translated.alias("is_translated"))


def render_projection(entries: DataFrame) -> DataFrame:
    return with_excerpt(entries).select(*RENDER_COLUMNS)


def matches(search: str) -> Column:
    """Literal, case-blind substring match on search_text; a blank search keeps all."""
    query = F.lit(unicodedata.normalize("NFKC", search))
    wanted = F.lower(query)
    return (query == "") | F.contains(F.coalesce(F.col("search_text"), F.lit("")), wanted)


def with_search_text(entries: DataFrame) -> DataFrame:
    text = tx.search_text(F.col("translated_title"), F.col("source_title"), F.col("source_url"))
    return entries.withColumn("search_text", text)


def search_entries(entries: DataFrame, search: str) -> DataFrame:
    return entries.filter(matches(search))


def search_count(entries: DataFrame, search: str) -> DataFrame:
    return search_entries(entries, search).agg(F.count(F.lit(1)).alias("entry_count"))


def page_entries(entries: DataFrame, limit: int = 50, offset: int = 0, search: str = "", **bounds: int) -> DataFrame:
    """One page, newest first, at any depth. `page_after` goes on from the last row seen instead."""
    order = [unzoned_micros(sort_ts()), F.col("id")]
    return page(search_entries(entries, search), order, max(limit, 1), offset, **bounds)


def page_after(entries: DataFrame, seen_ts: str, seen_id: int, limit: int = 50) -> DataFrame:
    seen = F.lit(seen_ts).cast("timestamp_ntz")
    later = (sort_ts() < seen) | ((sort_ts() == seen) & (F.col("id") < seen_id))
    return entries.filter(later).orderBy(*newest_first()).limit(max(limit, 1))


def has_error() -> Column:
    return (F.col("refresh_status") == "error") | F.col("translation_retry_after").isNotNull()


def recent_errors_per_feed(entries: DataFrame, k: int = 3) -> DataFrame:
    failed = entries.filter(has_error()).select(
        "id", "feed_name", "source_title", "source_url",
        F.coalesce("translation_last_error", "refresh_error").alias("error"),
        F.coalesce("translation_last_failed_at", "refreshed_at").alias("failed_at"),
    )
    return top_per_group(failed, ["feed_name"], [F.col("failed_at").desc_nulls_last(), F.col("id").desc()], k)


def due(now: str) -> Column:
    return F.col("translation_retry_after") <= F.lit(now).cast("timestamp_ntz")


def due_filter(entries: DataFrame, now: str) -> DataFrame:
    return entries.filter(due(now))


def due_retries(entries: DataFrame, feeds: DataFrame, now: str, limit: int) -> DataFrame:
    enabled = feeds.filter("translate_enabled").select("feed_name")
    ready = due_filter(entries, now).join(enabled, "feed_name", "left_semi")
    return ready.orderBy(F.col("translation_retry_after"), F.col("id")).limit(limit)


def due_retries_one_feed(entries: DataFrame, feed_name: str, now: str, limit: int) -> DataFrame:
    ready = due_filter(entries.filter(F.col("feed_name") == feed_name), now)
    return ready.orderBy(F.col("translation_retry_after"), F.col("id")).limit(limit)


def feed_list(feeds: DataFrame, entries: DataFrame) -> DataFrame:
    counts = entries.groupBy("feed_name").agg(
        F.count(F.lit(1)).alias("entry_count"), F.count_if(has_error()).alias("error_count")
    )
    listed = feeds.join(counts, "feed_name", "left").fillna(0, ["entry_count", "error_count"])
    return listed.select(
        "feed_name", "source_url", ul.normalize_folder(F.col("folder")).alias("folder"),
        F.coalesce(tx.blank_to_null(F.col("title")), F.col("feed_name")).alias("title"), "translate_enabled",
        F.coalesce(tx.blank_to_null(F.col("last_refresh_status")), F.lit("idle")).alias("last_refresh_status"),
        F.coalesce("last_refresh_error", F.lit("")).alias("last_refresh_error"), "last_refreshed_at", "created_at",
        ul.is_managed(F.col("source_url")).alias("is_managed"), "entry_count", "error_count",
    )


def in_list_order(listed: DataFrame) -> DataFrame:
    return listed.orderBy(F.coalesce(F.col("folder"), F.lit("")), "created_at", "feed_name")


def feed_failing() -> Column:
    return (F.col("error_count") > 0) | F.coalesce(F.col("last_refresh_status").isin("error", "partial"), F.lit(False))


def feed_list_filter(listed: DataFrame, search: str = "", status: str = "all", base_url: str = "") -> DataFrame:
    feed_url = F.concat(F.lit(base_url), F.lit("/feeds/"), F.col("feed_name"), F.lit(".xml"))
    haystack = F.concat_ws(
        "\n",
        *[F.lower(tx.normalize_ws(c)) for c in
          (F.col("title"), F.col("feed_name"), F.col("source_url"), feed_url, F.col("folder"))],
    )
    wanted = F.lower(tx.normalize_ws(F.lit(search)))
    kept = listed.filter((wanted == "") | F.contains(haystack, wanted))
    if status == "error":
        return kept.filter(feed_failing())
    if status == "idle":
        return kept.filter(F.col("last_refreshed_at").isNull() | (F.col("last_refresh_status") == "idle"))
    return kept


def folder_rollup(listed: DataFrame) -> DataFrame:
    folder = F.coalesce(tx.blank_to_null(F.col("folder")), F.lit("uncategorised"))
    return listed.groupBy(folder.alias("folder")).agg(
        F.count(F.lit(1)).alias("feeds"), F.count_if(feed_failing()).alias("failing_feeds")
    )


def drop_live_pages(items: DataFrame, url: str, domain: str, prefix: str = "/live/") -> DataFrame:
    """Without the rolling live pages of one publisher; items with an unusable URL stay."""
    host, path = ul.url_host(F.col(url)), ul.url_path(F.col(url))
    live = ul.host_under(host, domain) & F.startswith(path, F.lit(prefix))
    return items.filter(~F.coalesce(live, F.lit(False)))


# First path part -> language, on the one publisher whose paths carry a locale.
LOCALE_PATHS = {
    "ar": "ar", "de": "de", "es": "es", "fr": "fr", "it": "it", "jp": "ja", "latam": "es", "pt": "pt",
}
LOCALE_DOMAIN = "reuters.com"


def with_dimensions(
    items: DataFrame, url: str, metadata_language: str | None = None,
    domain: str = LOCALE_DOMAIN, locales: dict[str, str] | None = None,
) -> DataFrame:
    """Add language and section of each URL; rows with an unusable URL are dropped."""
    host = ul.url_host(F.col(url))
    parts = F.filter(F.split(F.lower(ul.url_path(F.col(url))), "/"), lambda p: p != "")
    known = F.create_map(*[F.lit(x) for pair in (locales or LOCALE_PATHS).items() for x in pair])
    first = F.get(parts, F.lit(0))
    local = F.when(ul.host_under(host, domain), F.try_element_at(known, first))
    rest = F.when(local.isNotNull(), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
    head = F.coalesce(F.get(rest, F.lit(0)), F.lit(""))
    meta = F.lower(tx.trim_space(F.coalesce(F.col(metadata_language), F.lit("")))) if metadata_language else F.lit("")
    section = F.when((head == "commentary") & (F.get(rest, F.lit(1)) == "breakingviews"), F.lit("breakingviews"))
    return items.filter(host.isNotNull()).withColumns({
        "language": F.coalesce(local, F.when(ul.host_under(host, domain), F.lit("en")).otherwise(meta)),
        "section": section.otherwise(head),
    })


def dimension_filter(items: DataFrame, languages: list[str] = (), sections: list[str] = ()) -> DataFrame:
    for column, wanted in (("language", languages), ("section", sections)):
        values = [v.strip().lower() for v in wanted if v.strip()]
        if values:
            items = items.filter(F.col(column).isin(values))
    return items


def valid_http_url(rows: DataFrame, url: str) -> DataFrame:
    return rows.withColumn(url, ul.http_url(F.col(url))).filter(F.col(url).isNotNull())


def without_managed(feeds: DataFrame) -> DataFrame:
    return feeds.filter(~ul.is_managed(F.col("source_url")))


def lookup(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Point lookups in bulk: the rows whose key occurs in `keys`."""
    return rows.join(keys.select(*on).distinct(), on, "left_semi")


def refresh_slice(items: DataFrame, n: int = 10, dated: bool = False) -> DataFrame:
    """First n items per feed in document order, or newest first with undated items last."""
    order = [F.col("pos").asc()]
    if dated:
        order = [F.col("published_at").desc_nulls_last()] + order
    return top_per_group(items, ["feed_name"], order, n)


def sort_by_optional_date(items: DataFrame, date_text: str) -> DataFrame:
    """Newest first; rows without a readable date follow in their own order."""
    dated = items.withColumn("published_at", parse_date(F.col(date_text)))
    return dated.orderBy(F.col("published_at").desc_nulls_last(), F.col("pos"))


def union_sources(sitemap_items: DataFrame, rss_items: DataFrame) -> DataFrame:
    """Items of news sitemaps, and of ordinary feeds for the sources that are no news sitemap."""
    other = rss_items.join(sitemap_items.select("feed_name").distinct(), "feed_name", "left_anti")
    return sitemap_items.unionByName(other, allowMissingColumns=True)


def except_managed(feeds: DataFrame, removed: DataFrame) -> DataFrame:
    return without_managed(feeds).join(removed.select("feed_name"), "feed_name", "left_anti")


def common_feeds(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    return incoming.join(stored.select("source_url"), "source_url", "left_semi")


def snapshot_retention(manifest: DataFrame, keep: int = 7) -> DataFrame:
    """Snapshots to drop per table: all but the newest `keep` by name. Only the keep-th name of each table is
    ranked; the rest is compared with it, so no table's whole manifest goes to one task."""
    names = manifest.select("table_name", "snapshot").distinct()
    oldest_kept = top_per_group(names, ["table_name"], [F.col("snapshot").desc()], keep).groupBy("table_name").agg(
        F.min("snapshot").alias("oldest_kept"), F.max("snapshot").alias("newest")
    )
    return names.join(oldest_kept, "table_name").filter(F.col("snapshot") < F.col("oldest_kept")).select(
        "table_name", "snapshot", "newest"
    )


def stale_snapshots(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Tables whose current snapshot is not newer than all others in the manifest (a clock that went back)."""
    newest = manifest.groupBy("table_name").agg(F.max("snapshot").alias("newest"))
    return current.join(newest, "table_name").filter(F.col("snapshot") <= F.col("newest"))
