"""Queries of the reconcile family, the upsert sinks and the refresh roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.operators import reconcile as rc
from feedloom.plans.registry import query
from feedloom.sources.tables import view

NOW = "TIMESTAMP '2024-01-01 12:00:00'"
BODY = "COALESCE(NULLIF(e.extracted_content_html, ''), NULLIF(e.source_content_html, ''), '')"
NEW_BODY = "COALESCE(NULLIF(i.page_html, ''), i.source_content_html)"
TRANSLATED = "COALESCE(e.translated_content_html, '') <> ''"

RECONCILED = f"""
    pairs AS (
      SELECT i.*, e.id IS NOT NULL AS stored, e.source_title AS old_title, e.translated_title AS old_translated_title,
        {TRANSLATED} AS old_translated, e.translation_retry_after, {BODY} AS old_body, {NEW_BODY} AS page_body,
        NULLIF(e.extracted_content_html, '') AS old_extracted, COALESCE(e.translation_provider, '') AS old_provider,
        COALESCE(e.refresh_status <> 'error' AND i.refreshed_at < COALESCE(e.source_fetched_at, e.refreshed_at) + INTERVAL '24' HOUR
          AND (COALESCE(i.source_title, '') = '' OR COALESCE(i.source_title, '') = COALESCE(e.source_title, ''))
          AND i.source_content_html = e.source_content_html AND {BODY} <> '', false) AS reuse_body,
        COALESCE(i.source_url = e.source_url AND COALESCE(i.source_author, '') = COALESCE(e.source_author, '')
          AND i.source_published_at IS NOT DISTINCT FROM e.source_published_at
          AND i.source_content_html = e.source_content_html, false) AS fields_same, COALESCE(f.translate_enabled, false) AS on_flag
      FROM v_incoming i LEFT JOIN v_entries e ON e.feed_name = i.feed_name AND e.source_guid = i.source_guid
      LEFT JOIN v_feeds f ON f.feed_name = i.feed_name),
    bodies AS (SELECT *, CASE WHEN reuse_body THEN old_body ELSE page_body END AS new_body FROM pairs),
    changes AS (SELECT *, stored AND (COALESCE(old_title, '') <> COALESCE(source_title, '') OR old_body <> new_body)
        AS content_changed FROM bodies),
    plans AS (SELECT *, CASE
        WHEN on_flag AND old_translated AND NOT content_changed AND NOT COALESCE(translation_retry_after <= refreshed_at, false)
          THEN 'reuse'
        WHEN on_flag AND NOT content_changed AND COALESCE(translation_retry_after > refreshed_at, false) THEN 'backoff'
        WHEN on_flag THEN 'translate' ELSE 'skip' END AS plan FROM changes),
    displays AS (SELECT *, NOT stored
        OR COALESCE(NULLIF(old_translated_title, ''), old_title, '')
          <> CASE WHEN plan = 'reuse' THEN COALESCE(NULLIF(old_translated_title, ''), source_title, '') ELSE COALESCE(source_title, '') END
        OR NOT (plan = 'reuse' OR (NOT old_translated AND old_body = new_body)) AS display_changed,
        CASE WHEN plan = 'reuse' THEN old_provider WHEN reuse_body THEN split_part(old_provider, '+', 1) ELSE 'rss' END AS provider
      FROM plans),
    reconciled AS (SELECT *, stored AND fields_same AND provider = old_provider
        AND old_extracted IS NOT DISTINCT FROM CASE WHEN new_body <> source_content_html THEN new_body END AS metadata_unchanged
      FROM displays),
    decided AS (SELECT *, CASE WHEN NOT stored THEN 'insert' WHEN NOT display_changed AND metadata_unchanged THEN 'touch'
        ELSE 'update' END AS action FROM reconciled)"""


def entries(spark, folder):
    return view(spark, folder, "v_entries")


def feeds(spark, folder):
    return view(spark, folder, "v_feeds")


def incoming(spark, folder):
    return view(spark, folder, "v_incoming")


def reconciled(spark, folder):
    return rc.reconcile_items(incoming(spark, folder), entries(spark, folder), feeds(spark, folder))


@query("reconcile_items", f"""
    WITH {RECONCILED} SELECT id, feed_name, reuse_body, content_changed, display_changed, metadata_unchanged, action
    FROM decided""")
def reconcile_items(spark, folder):
    return reconciled(spark, folder).select(
        "id", "feed_name", "reuse_body", "content_changed", "display_changed", "metadata_unchanged", "action"
    )


@query("reuse_or_refetch", f"WITH {RECONCILED} SELECT id, reuse_body FROM reconciled")
def reuse_or_refetch(spark, folder):
    pairs = rc.matched(incoming(spark, folder), entries(spark, folder))
    return rc.with_reuse(pairs).select("id", "reuse_body")


@query("translation_plan", f"WITH {RECONCILED} SELECT id, feed_name, plan FROM plans")
def translation_plan(spark, folder):
    pairs = rc.with_reuse(rc.matched(incoming(spark, folder), entries(spark, folder)))
    return rc.with_plan(pairs, feeds(spark, folder)).select("id", "feed_name", "plan")


@query("content_revision", f"""
    WITH {RECONCILED} SELECT feed_name, count(*) AS content_revision, max(refreshed_at) AS content_updated_at
    FROM reconciled WHERE display_changed GROUP BY feed_name""")
def content_revision(spark, folder):
    return rc.content_revision(reconciled(spark, folder))


@query("saved_item_reconcile", f"""
    WITH pairs AS (
      SELECT i.id, e.id IS NOT NULL AND COALESCE(e.source_title, '') = COALESCE(i.source_title, '') AND {BODY} = {NEW_BODY}
          AS unchanged, {TRANSLATED} AS old_translated, e.translated_title AS old_title,
        COALESCE(e.translation_provider, 'readability') AS old_provider,
        CASE WHEN i.id % 6 = 0 THEN 'provider down' END AS translation_error,
        COALESCE(i.source_published_at, e.source_published_at, {NOW}) AS source_published_at,
        COALESCE(e.created_at, {NOW}) AS created_at
      FROM v_incoming i LEFT JOIN v_entries e ON e.feed_name = i.feed_name AND e.source_guid = i.source_guid)
    SELECT id, COALESCE(unchanged, false) AND old_translated AS translation_kept,
      CASE WHEN COALESCE(unchanged, false) AND old_translated THEN old_title END AS translated_title,
      CASE WHEN COALESCE(unchanged, false) AND old_translated THEN old_provider
        WHEN translation_error IS NULL THEN 'readability+new' ELSE 'readability' END AS translation_provider,
      CASE WHEN NOT (COALESCE(unchanged, false) AND old_translated) AND translation_error IS NOT NULL THEN 'partial'
        ELSE 'ok' END AS refresh_status,
      source_published_at, created_at FROM pairs""")
def saved_item_reconcile(spark, folder):
    imported = incoming(spark, folder).withColumns({
        "provider": F.lit("readability"),
        "translation_error": F.when(F.col("id") % 6 == 0, F.lit("provider down")),
    })
    rows = rc.saved_item_reconcile(imported, entries(spark, folder), "2024-01-01 12:00:00")
    return rows.select("id", "translation_kept", "translated_title", "translation_provider", "refresh_status",
                       "source_published_at", "created_at")


UPSERT_COLUMNS = ["id", "feed_name", "source_guid", "source_url", "source_title", "source_author", "source_content_html",
                  "source_published_at", "refreshed_at", "created_at", "refresh_status"]


@query("sink_entries_upsert", """
    SELECT COALESCE(e.id, i.id) AS id, COALESCE(e.feed_name, i.feed_name) AS feed_name,
      COALESCE(e.source_guid, i.source_guid) AS source_guid,
      CASE WHEN i.id IS NULL THEN e.source_url ELSE i.source_url END AS source_url,
      CASE WHEN i.id IS NULL THEN e.source_title ELSE i.source_title END AS source_title,
      CASE WHEN i.id IS NULL THEN e.source_author ELSE i.source_author END AS source_author,
      CASE WHEN i.id IS NULL THEN e.source_content_html ELSE i.source_content_html END AS source_content_html,
      CASE WHEN i.id IS NULL THEN e.source_published_at ELSE i.source_published_at END AS source_published_at,
      CASE WHEN i.id IS NULL THEN e.refreshed_at ELSE i.refreshed_at END AS refreshed_at,
      COALESCE(e.created_at, i.refreshed_at) AS created_at,
      CASE WHEN i.id IS NULL THEN e.refresh_status ELSE 'ok' END AS refresh_status
    FROM v_entries e FULL OUTER JOIN v_incoming i ON e.feed_name = i.feed_name AND e.source_guid = i.source_guid""")
def sink_entries_upsert(spark, folder):
    new = incoming(spark, folder).drop("page_html").withColumns({
        "created_at": F.col("refreshed_at"), "refresh_status": F.lit("ok"),
    })
    return rc.upsert_entries(entries(spark, folder).select(*UPSERT_COLUMNS), new)


FEED_CHANGES = """
    changes AS (SELECT feed_name, concat(source_url, '?v=2') AS source_url, 'Moved' AS folder,
        CASE WHEN folder = '' THEN concat('New ', title) END AS title, NOT translate_enabled AS translate_enabled,
        CASE WHEN translate_enabled THEN 'ok' END AS last_refresh_status
      FROM v_feeds WHERE feed_name LIKE 'src1%'
      UNION ALL SELECT concat('new-', feed_name), source_url, folder, title, translate_enabled, NULL FROM v_feeds
      WHERE feed_name LIKE '%2')"""


def feed_changes(spark, folder):
    rows = feeds(spark, folder)
    moved = rows.filter(F.startswith(F.col("feed_name"), F.lit("src1"))).select(
        "feed_name", F.concat("source_url", F.lit("?v=2")).alias("source_url"), F.lit("Moved").alias("folder"),
        F.when(F.col("folder") == "", F.concat(F.lit("New "), "title")).alias("title"),
        (~F.col("translate_enabled")).alias("translate_enabled"),
        F.when(F.col("translate_enabled"), F.lit("ok")).alias("last_refresh_status"),
    )
    added = rows.filter(F.endswith(F.col("feed_name"), F.lit("2"))).select(
        F.concat(F.lit("new-"), "feed_name").alias("feed_name"), "source_url", "folder", "title", "translate_enabled",
        F.lit(None).cast("string").alias("last_refresh_status"),
    )
    return moved.unionByName(added)


@query("sink_feeds_upsert", f"""
    WITH {FEED_CHANGES}
    SELECT COALESCE(f.feed_name, c.feed_name) AS feed_name, COALESCE(c.source_url, f.source_url) AS source_url,
      COALESCE(c.folder, f.folder) AS folder, COALESCE(c.title, f.title) AS title,
      COALESCE(c.translate_enabled, f.translate_enabled) AS translate_enabled,
      COALESCE(c.last_refresh_status, f.last_refresh_status) AS last_refresh_status, f.last_refreshed_at, f.created_at
    FROM v_feeds f FULL OUTER JOIN changes c ON c.feed_name = f.feed_name""")
def sink_feeds_upsert(spark, folder):
    stored = feeds(spark, folder).select("feed_name", "source_url", "folder", "title", "translate_enabled",
                                         "last_refresh_status", "last_refreshed_at", "created_at")
    return rc.upsert_feeds(stored, feed_changes(spark, folder))


@query("touch_entries", f"""
    SELECT id, CASE WHEN id % 4 = 0 THEN 'ok' ELSE refresh_status END AS refresh_status,
      CASE WHEN id % 4 = 0 THEN '' ELSE refresh_error END AS refresh_error,
      CASE WHEN id % 4 = 0 THEN {NOW} ELSE refreshed_at END AS refreshed_at,
      CASE WHEN id % 8 = 0 THEN {NOW} ELSE source_fetched_at END AS source_fetched_at FROM v_entries""")
def touch_entries(spark, folder):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp_ntz")
    stored = entries(spark, folder).select("id", *rc.KEY, "refresh_status", "refresh_error", "refreshed_at",
                                           "source_fetched_at")
    touched = stored.filter("id % 4 = 0").select(
        *rc.KEY, F.lit("ok").alias("refresh_status"), F.lit("").alias("refresh_error"), now.alias("refreshed_at"),
        F.when(F.col("id") % 8 == 0, now).alias("source_fetched_at"),
    )
    return rc.touch_entries(stored, touched).drop(*rc.KEY)


@query("version_check", """
    SELECT id, CASE WHEN id % 11 = 5 OR id % 13 = 0 OR (id % 6 = 0 AND translated_title IS NOT NULL) THEN 'superseded'
      ELSE 'same' END AS verdict FROM v_entries""")
def version_check(spark, folder):
    expected = entries(spark, folder)
    current = expected.filter("id % 13 <> 0").withColumns({
        "source_title": F.when(F.col("id") % 11 == 5, F.concat(F.col("source_title"), F.lit("!"))).otherwise(
            F.col("source_title")),
        "translated_title": F.when(F.col("id") % 6 != 0, F.col("translated_title")),
    })
    return rc.version_check(expected, current)


OUTLINE_ROWS = """
    outline AS (
      SELECT CAST(substring(feed_name, 4) AS BIGINT) AS pos, concat(' ', source_url, '#x ') AS source_url,
        CASE WHEN translate_enabled THEN 'Renamed' ELSE ' ' END AS title, ' A / B ' AS folder FROM v_feeds
      UNION ALL SELECT 1000 + CAST(substring(node_id, 2) AS BIGINT), xml_url, text, parent_id FROM v_outline
      WHERE xml_url IS NOT NULL
      UNION ALL SELECT 900000 + CAST(substring(node_id, 2) AS BIGINT), xml_url, concat(text, ' again'), 'Later' FROM v_outline
      WHERE xml_url IS NOT NULL AND node_id LIKE '%7'
      UNION ALL SELECT 1900000 + CAST(substring(node_id, 2) AS BIGINT), 'ftp://x.example.org/feed', text, 'F' FROM v_outline
      WHERE xml_url IS NOT NULL AND node_id LIKE '%3')"""
IMPORTED = f"""
    {OUTLINE_ROWS},
    valid AS (SELECT pos, regexp_replace(trim(source_url), '#.*$', '') AS source_url, NULLIF(trim(title), '') AS title,
        CASE WHEN folder = ' A / B ' THEN 'A/B' ELSE folder END AS folder FROM outline WHERE trim(source_url) LIKE 'http%'),
    per_url AS (SELECT source_url, count(*) AS rows, arg_max(folder, pos) AS folder,
        arg_min(title, pos) FILTER (WHERE title IS NOT NULL) AS new_title FROM valid GROUP BY source_url),
    imported AS (SELECT p.source_url, COALESCE(f.feed_name,
          substring(trim(regexp_replace(lower(regexp_extract(p.source_url, '^https?://(.*)$', 1)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 64))
          AS feed_name, p.folder, COALESCE(f.title, p.new_title) AS title,
        CASE WHEN f.feed_name IS NULL THEN 'created' ELSE 'updated' END AS action, p.rows
      FROM per_url p LEFT JOIN v_feeds f ON f.source_url = p.source_url)"""


def outline_rows(spark, folder):
    tree = view(spark, folder, "v_outline").filter("xml_url IS NOT NULL").withColumn(
        "n", F.substring("node_id", 2, 20).cast("bigint")
    )
    known = feeds(spark, folder).select(
        F.substring("feed_name", 4, 20).cast("bigint").alias("pos"),
        F.concat(F.lit(" "), "source_url", F.lit("#x ")).alias("source_url"),
        F.when(F.col("translate_enabled"), F.lit("Renamed")).otherwise(F.lit(" ")).alias("title"),
        F.lit(" A / B ").alias("folder"),
    )
    leaves = tree.select((F.col("n") + 1000).alias("pos"), F.col("xml_url").alias("source_url"),
                         F.col("text").alias("title"), F.col("parent_id").alias("folder"))
    again = tree.filter(F.endswith(F.col("node_id"), F.lit("7"))).select(
        (F.col("n") + 900000).alias("pos"), F.col("xml_url").alias("source_url"),
        F.concat("text", F.lit(" again")).alias("title"), F.lit("Later").alias("folder"))
    unusable = tree.filter(F.endswith(F.col("node_id"), F.lit("3"))).select(
        (F.col("n") + 1900000).alias("pos"), F.lit("ftp://x.example.org/feed").alias("source_url"),
        F.col("text").alias("title"), F.lit("F").alias("folder"))
    return known.unionByName(leaves).unionByName(again).unionByName(unusable)


@query("import_feeds", f"WITH {IMPORTED} SELECT * FROM imported")
def import_feeds(spark, folder):
    return rc.import_feeds(outline_rows(spark, folder), feeds(spark, folder))


@query("import_summary", f"""
    WITH {IMPORTED} SELECT CAST(sum(rows) AS BIGINT) AS total, count(*) FILTER (WHERE action = 'created') AS created,
      CAST(sum(rows) - count(*) FILTER (WHERE action = 'created') AS BIGINT) AS updated FROM imported""")
def import_summary(spark, folder):
    return rc.import_summary(rc.import_feeds(outline_rows(spark, folder), feeds(spark, folder)))


def resolved_names() -> str:
    """Names offered size after size; the first URL that finds a candidate free gets it."""
    ctes, won = [], []
    for n, size in enumerate((0, 8, 12, 16)):
        candidate = "feed_name" if not size else f"concat(substring(feed_name, 1, {63 - size}), '-', substring(sha256(source_url), 1, {size}))"
        rest = "wanted" if not n else f"l{n - 1} ANTI JOIN w{n - 1} USING (feed_name, source_url)"
        used = "taken" if not n else f"(SELECT feed_name, source_url FROM taken {' '.join(won)})"
        ctes.append(f"""l{n} AS (SELECT feed_name, source_url, {candidate} AS candidate FROM {rest}),
    w{n} AS (SELECT l.feed_name, l.source_url, l.candidate FROM l{n} l LEFT JOIN {used} t ON t.feed_name = l.candidate
      WHERE t.source_url IS NULL OR t.source_url = l.source_url
      QUALIFY row_number() OVER (PARTITION BY l.candidate ORDER BY t.source_url IS NULL, l.source_url, l.feed_name) = 1)""")
        won.append(f"UNION ALL SELECT candidate, source_url FROM w{n}")
    every = " UNION ALL ".join(f"SELECT feed_name, source_url, candidate AS resolved_name FROM w{n}" for n in range(4))
    return ",\n    ".join(ctes) + f"\n    {every} UNION ALL SELECT feed_name, source_url, NULL FROM l3 ANTI JOIN w3 USING (feed_name, source_url)"


@query("resolve_feed_name", f"""
    WITH wanted AS (SELECT DISTINCT concat('src', CAST(doc_id % 40 AS VARCHAR)) AS feed_name,
        concat('https://src', CAST(doc_id % 30 AS VARCHAR), '.example.org/feed.xml') AS source_url FROM documents),
    taken AS (SELECT feed_name, source_url FROM v_feeds UNION ALL
        SELECT concat(feed_name, '-', substring(sha256(concat('https://src', CAST(k AS VARCHAR), '.example.org/feed.xml')), 1, 8)),
          'https://other.example.org/' FROM (SELECT feed_name, (CAST(substring(feed_name, 4) AS INT) + 20) % 30 AS k FROM v_feeds) t
          WHERE k % 2 = 0),
    {resolved_names()}""")
def resolve_feed_name(spark, folder):
    def feed_url(k):
        return F.concat(F.lit("https://src"), k.cast("string"), F.lit(".example.org/feed.xml"))

    wanted = view(spark, folder, "documents").select(
        F.concat(F.lit("src"), F.col("doc_id") % 40).alias("feed_name"), feed_url(F.col("doc_id") % 30).alias("source_url")
    ).distinct()
    stored = feeds(spark, folder).select("feed_name", "source_url")
    k = (F.substring("feed_name", 4, 9).cast("int") + 20) % 30
    clashes = stored.filter(k % 2 == 0).select(
        F.concat("feed_name", F.lit("-"), F.substring(F.sha2(feed_url(k), 256), 1, 8)).alias("feed_name"),
        F.lit("https://other.example.org/").alias("source_url"),
    )
    return rc.resolve_feed_name(wanted, stored.unionByName(clashes))


@query("feed_metadata_changed", f"""
    WITH {FEED_CHANGES}
    SELECT f.feed_name, (f.source_url <> c.source_url OR f.title IS DISTINCT FROM c.title
        OR f.translate_enabled <> c.translate_enabled) AS changed,
      CAST((f.source_url <> c.source_url OR f.title IS DISTINCT FROM c.title
        OR f.translate_enabled <> c.translate_enabled) AS BIGINT) AS revision_step
    FROM v_feeds f JOIN (SELECT feed_name, source_url, title, translate_enabled FROM changes
      UNION ALL SELECT feed_name, source_url, title, translate_enabled FROM v_feeds WHERE feed_name NOT LIKE 'src1%') c
      ON c.feed_name = f.feed_name""")
def feed_metadata_changed(spark, folder):
    columns = ["feed_name", "source_url", "title", "translate_enabled"]
    kept = feeds(spark, folder).filter(~F.startswith(F.col("feed_name"), F.lit("src1"))).select(*columns)
    changed = feed_changes(spark, folder).select(*columns).unionByName(kept)
    return rc.feed_metadata_changed(feeds(spark, folder), changed)


@query("referential_audit", """
    SELECT id, feed_name, 'orphan' AS kind FROM v_entries WHERE feed_name NOT IN (SELECT feed_name FROM v_feeds WHERE folder <> '')
    UNION ALL SELECT id, feed_name, 'cascade' FROM v_entries WHERE feed_name IN (SELECT feed_name FROM v_feeds WHERE folder = 'Folder 2')""")
def referential_audit(spark, folder):
    rows = entries(spark, folder).select("id", "feed_name")
    missing = rc.orphans(rows, feeds(spark, folder).filter("folder <> ''"), "feed_name")
    going = rc.cascade(rows, feeds(spark, folder).filter("folder = 'Folder 2'"), "feed_name")
    return missing.withColumn("kind", F.lit("orphan")).unionByName(going.withColumn("kind", F.lit("cascade")))


def deletions(spark, folder):
    """Delete requests; some name an entry of another feed and so delete nothing."""
    return view(spark, folder, "labels").filter("toxic = 1").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("doc_id") % 5 == 0, F.lit("src0")).otherwise(F.concat(F.lit("src"), F.col("doc_id") % 20)).alias("feed_name"),
    )


DELETIONS = """deletions AS (SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'src0'
    ELSE concat('src', CAST(doc_id % 20 AS VARCHAR)) END AS feed_name FROM labels WHERE toxic = 1)"""


@query("delete_entry", f"""
    WITH {DELETIONS} SELECT id, feed_name FROM v_entries WHERE (feed_name, id) NOT IN (SELECT feed_name, id FROM deletions)""")
def delete_entry(spark, folder):
    return rc.delete_entries(entries(spark, folder), deletions(spark, folder)).select("id", "feed_name")


@query("delete_entry_revisions", f"""
    WITH {DELETIONS} SELECT e.feed_name, count(*) AS revision_step FROM v_entries e
    WHERE (feed_name, id) IN (SELECT feed_name, id FROM deletions) GROUP BY 1""")
def delete_entry_revisions(spark, folder):
    return rc.deleted_revisions(entries(spark, folder), deletions(spark, folder))


def results(spark, folder):
    """Item results of one refresh run."""
    return entries(spark, folder).select(
        "feed_name", F.col("id").alias("pos"), F.col("source_title").alias("title"),
        F.col("refresh_status").alias("status"), F.col("refresh_error").alias("error"),
    )


ROLLUP = """
    rollup_rows AS (SELECT feed_name, CASE WHEN count(*) FILTER (WHERE refresh_status = 'error') > 0 THEN 'partial' ELSE 'ok' END
        AS status, count(*) AS item_count FROM v_entries GROUP BY feed_name),
    messages AS (SELECT feed_name, string_agg(concat(source_title, ': ', refresh_error), ' | ' ORDER BY id) AS error FROM (
        SELECT *, row_number() OVER (PARTITION BY feed_name ORDER BY id) AS rn FROM v_entries WHERE refresh_status = 'error') t
      WHERE rn <= 3 GROUP BY feed_name),
    run AS (SELECT r.feed_name, r.status, COALESCE(m.error, '') AS error, r.item_count
      FROM rollup_rows r LEFT JOIN messages m ON m.feed_name = r.feed_name)"""


@query("refresh_rollup", f"WITH {ROLLUP} SELECT * FROM run")
def refresh_rollup(spark, folder):
    return rc.refresh_rollup(results(spark, folder))


@query("refresh_all_summary", f"""
    WITH {ROLLUP} SELECT f.feed_name, NOT COALESCE(f.last_refresh_status = 'error', false) AS ok,
      CASE WHEN COALESCE(f.last_refresh_status = 'error', false) THEN NULL ELSE COALESCE(r.status, 'ok') END AS status,
      CASE WHEN f.last_refresh_status = 'error' THEN f.last_refresh_error ELSE COALESCE(r.error, '') END AS error,
      CASE WHEN COALESCE(f.last_refresh_status = 'error', false) THEN NULL ELSE COALESCE(r.item_count, 0) END AS item_count
    FROM v_feeds f LEFT JOIN run r ON r.feed_name = f.feed_name""")
def refresh_all_summary(spark, folder):
    failures = feeds(spark, folder).filter("last_refresh_status = 'error'").select(
        "feed_name", F.col("last_refresh_error").alias("error")
    )
    return rc.refresh_all_summary(rc.refresh_rollup(results(spark, folder)), feeds(spark, folder), failures)


@query("retry_batch_status", """
    WITH batch AS (SELECT feed_name, id, CASE WHEN translation_failure_count % 3 = 0 THEN 'error'
        WHEN translation_failure_count % 3 = 1 THEN 'ok' ELSE 'deferred' END AS status, concat('e', CAST(id AS VARCHAR)) AS error
      FROM v_entries WHERE translation_retry_after IS NOT NULL)
    SELECT feed_name, CASE WHEN bool_or(status = 'error') THEN 'partial' ELSE 'ok' END AS status,
      COALESCE(arg_min(error, id) FILTER (WHERE status = 'error'), '') AS error
    FROM batch GROUP BY feed_name HAVING bool_or(status IN ('error', 'ok'))""")
def retry_batch_status(spark, folder):
    kind = F.col("translation_failure_count") % 3
    batch = entries(spark, folder).filter("translation_retry_after IS NOT NULL").select(
        "feed_name", F.col("id").alias("pos"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("error"),
        F.when(kind == 0, F.lit("error")).when(kind == 1, F.lit("ok")).otherwise(F.lit("deferred")).alias("status"),
    )
    return rc.retry_batch_status(batch)
