"""Queries of ingest, publishing, outlines, threads and articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.operators import articles as ar
from feedloom.operators import publish as pb
from feedloom.operators import threads as th
from feedloom.plans.dialect import host, strip, truncate, xml_escape
from feedloom.plans.registry import query
from feedloom.session import cut
from feedloom.sources import timeline, usage_log, xml
from feedloom.sources.tables import view

BASE = "https://reader.example.org"
ITEMS = f"""
    top AS (SELECT *, COALESCE(NULLIF(translated_content_html, ''), NULLIF(extracted_content_html, ''), NULLIF(source_content_html, ''), '') AS content
      FROM (SELECT *, row_number() OVER (PARTITION BY feed_name ORDER BY COALESCE(source_published_at, refreshed_at) DESC NULLS LAST, id DESC)
        AS rank FROM v_entries) t WHERE rank <= 50),
    items AS (SELECT feed_name, rank, COALESCE(NULLIF(translated_title, ''), NULLIF(source_title, ''), 'Untitled') AS title,
      concat(feed_name, ':', source_guid) AS guid, concat('{BASE}/articles/', CAST(id AS VARCHAR)) AS url,
      COALESCE(source_published_at, refreshed_at) AS date, COALESCE(source_author, '') AS author,
      {truncate(strip('content'), 240)} AS description, content, source_url, translation_provider, refresh_status FROM top)"""


def published_items(spark, folder):
    return pb.publish_items(view(spark, folder, "v_entries"), BASE)


def published(spark, folder):
    return pb.publish_feeds(published_items(spark, folder), view(spark, folder, "v_feeds"), BASE)


@query("publish_feed", f"WITH {ITEMS} SELECT * FROM items")
def publish_feed(spark, folder):
    return published_items(spark, folder)


XML_ITEM = f"""concat('<item><title>', {xml_escape('title')}, '</title><guid>', {xml_escape('guid')}, '</guid><link>', {xml_escape('url')},
    '</link><pubDate>', strftime(date, '%Y-%m-%dT%H:%M:%S'), '</pubDate><author>', {xml_escape('author')}, '</author><description>',
    {xml_escape('description')}, '</description><content:encoded><![CDATA[', replace(content, ']]>', ']]]]><![CDATA[>'),
    ']]></content:encoded><source>', {xml_escape('source_url')}, '</source></item>')"""


BODIES = f"""bodies AS (SELECT feed_name, count(*) AS item_count, string_agg({XML_ITEM}, chr(10) ORDER BY rank) AS body FROM items GROUP BY 1),
    documents_now AS (SELECT f.feed_name, COALESCE(item_count, 0) AS item_count, sha256(concat(
      '<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>',
      {xml_escape('title')}, ' | Reader View</title><link>', source_url, '</link><language>', CASE WHEN translate_enabled THEN 'zh-CN' ELSE 'en' END,
      '</language>', COALESCE(body, ''), '</channel></rss>')) AS xml_hash
    FROM v_feeds f LEFT JOIN bodies b ON b.feed_name = f.feed_name)"""


@query("publish_feed_documents", f"WITH {ITEMS}, {BODIES} SELECT * FROM documents_now")
def publish_feed_documents(spark, folder):
    return published(spark, folder).select("feed_name", "item_count", tx.hash_text(F.col("xml")).alias("xml_hash"))


@query("publish_outline", f"""
    WITH leaves AS (SELECT folder, 1 AS part, created_at, feed_name, concat('<outline text="', {xml_escape('title')}, '" title="', {xml_escape('title')},
        '" type="rss" xmlUrl="{BASE}/feeds/', feed_name, '.xml" htmlUrl="', {xml_escape('source_url')}, '" />') AS line FROM v_feeds),
    folders AS (SELECT DISTINCT folder FROM v_feeds WHERE folder <> '')
    SELECT * FROM leaves UNION ALL
    SELECT folder, 0, NULL, NULL, concat('<outline text="', folder, '" title="', folder, '">') FROM folders
    UNION ALL SELECT folder, 2, NULL, NULL, '</outline>' FROM folders""")
def publish_outline(spark, folder):
    return pb.publish_outline(view(spark, folder, "v_feeds"), BASE)


@query("publish_diff", f"""
    WITH {ITEMS}, {BODIES}, state AS (
      SELECT feed_name, CASE WHEN k % 4 = 0 THEN 'new' ELSE 'changed' END AS state FROM (
        SELECT feed_name, CAST(substring(feed_name, 4) AS INT) AS k FROM v_feeds) t WHERE k % 4 = 0 OR k % 4 = 1
      UNION ALL SELECT concat('old-', feed_name), 'gone' FROM v_feeds WHERE feed_name LIKE '%3')
    SELECT s.feed_name, state, item_count, xml_hash FROM state s LEFT JOIN documents_now d ON d.feed_name = s.feed_name""")
def publish_diff(spark, folder):
    """The publication before lacked a quarter of the feeds, showed an older title in another, and had some that are gone."""
    feeds = view(spark, folder, "v_feeds")
    items = cut(published_items(spark, folder))
    k = F.substring("feed_name", 4, 9).cast("int")
    older = items.withColumn("title", F.when((k % 4 == 1) & (F.col("rank") == 1), F.lit("Older")).otherwise(F.col("title")))
    manifest = pb.feed_digests(older, feeds).filter(k % 4 != 0)
    gone = feeds.filter(F.endswith("feed_name", F.lit("3"))).select(F.concat(F.lit("old-"), "feed_name").alias("feed_name"), F.lit("x").alias("digest"))
    changed = pb.publish_changed(items, feeds, manifest.unionByName(gone), BASE)
    return changed.select("feed_name", "state", "item_count", tx.hash_text(F.col("xml")).alias("xml_hash"))


@query("outline_paths", """
    WITH RECURSIVE walk AS (
      SELECT node_id, text AS folder FROM v_outline WHERE parent_id IS NULL
      UNION ALL SELECT o.node_id, concat(w.folder, '/', o.text) FROM walk w JOIN v_outline o ON o.parent_id = w.node_id
      WHERE o.xml_url IS NULL)
    SELECT o.xml_url AS source_url, o.text AS title, w.folder FROM v_outline o JOIN walk w ON w.node_id = o.parent_id
    WHERE o.xml_url IS NOT NULL""")
def outline_paths(spark, folder):
    return pb.outline_paths(view(spark, folder, "v_outline"))


@query("ingest_outline", """
    SELECT r_name AS document, row_number() OVER (PARTITION BY r_name ORDER BY n_name, s_suppkey) - 1 AS pos,
      concat('https://s', CAST(s_suppkey AS VARCHAR), '.example.org/feed.xml?a=1&b=2') AS source_url, concat(s_name, ' <"&''>') AS title,
      CASE WHEN s_suppkey % 3 = 0 THEN concat(r_name, '/', n_name) ELSE concat(r_name, '/', n_name, '/', 'Part ', CAST(s_suppkey % 3 AS VARCHAR)) END AS folder
    FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def ingest_outline(spark, folder):
    """A document per region: nations are folders, some suppliers lie one folder deeper, one in ten is nested below another feed."""
    t = {n: view(spark, folder, n) for n in ("supplier", "nation", "region")}
    s = t["supplier"].join(t["nation"], F.col("n_nationkey") == F.col("s_nationkey")).join(t["region"], F.col("r_regionkey") == F.col("n_regionkey"))
    key = F.col("s_suppkey")
    url = tx.xml_escape(F.concat(F.lit("https://s"), key.cast("string"), F.lit(".example.org/feed.xml?a=1&b=2")))
    leaf = F.concat(F.lit("<outline type='rss' title=\""), tx.xml_escape(F.concat("s_name", F.lit(" <\"&'>"))), F.lit("\" xmlUrl='"), url, F.lit("'"))
    leaf = F.concat(leaf, F.when(key % 10 == 0, F.lit("><!-- <outline xmlUrl='x'/> --></outline>")).otherwise(F.lit("/>")))
    placed = F.when(key % 3 == 0, leaf).otherwise(F.concat(F.lit('<outline\ntext=" Part  '), (key % 3).cast("string"), F.lit('">'), leaf, F.lit("</outline>")))
    nations = s.select("r_name", "n_name", "s_suppkey", placed.alias("x")).groupBy("r_name", "n_name").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "x"))).alias("l"))
    body = F.concat(F.lit("<outline text='"), "n_name", F.lit("' title='shown'>"), F.array_join(F.transform("l", lambda i: i["x"]), "\n"), F.lit("</outline>"))
    regions = nations.select("r_name", "n_name", body.alias("x")).groupBy("r_name").agg(F.array_sort(F.collect_list(F.struct("n_name", "x"))).alias("l"))
    document = F.concat(F.lit("<opml version='2.0'><head><title>t</title></head><body><outline text='"), "r_name", F.lit("'>"), F.array_join(F.transform("l", lambda i: i["x"]), ""), F.lit("</outline></body></opml>"))
    return xml.ingest_outline(regions.select(F.col("r_name").alias("document"), document.alias("xml")))


@query("ingest_rss", f"""
    WITH {ITEMS} SELECT i.feed_name, concat(f.title, ' | Reader View') AS feed_title, rank - 1 AS pos, sha256(guid) AS source_guid, url AS link,
      NULLIF(trim(i.title), '') AS title, NULLIF(author, '') AS author, date AS published_at, sha256(content) AS content_hash
    FROM items i JOIN v_feeds f ON f.feed_name = i.feed_name""")
def ingest_rss(spark, folder):
    documents = published(spark, folder).select("feed_name", F.lit(f"{BASE}/feeds/x.xml").alias("source_url"), "xml")
    items = xml.ingest_rss(documents)
    return items.select("feed_name", "feed_title", "pos", "source_guid", "link", "title", "author",
                        F.col("published_at").cast("timestamp_ntz").alias("published_at"),
                        tx.hash_text(F.col("content")).alias("content_hash"))


def sitemaps(spark, folder):
    """One sitemap per page: its URL as news, one URL without news part, one without address. Some are broken or plain."""
    url = tx.xml_escape(F.col("url"))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("page_id") % 28 + 1).cast("string"), 2, "0"))
    name = F.when(F.col("page_id") % 3 == 0, F.lit("")).otherwise(F.lit("<news:name> Daily </news:name>"))
    news = F.concat(
        F.lit('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="'),
        F.lit(xml.NEWS_NAMESPACE), F.lit('"><url><loc> '), url, F.lit(" </loc><news:news><news:publication>"), name,
        F.lit("<news:language>en</news:language></news:publication><news:publication_date>"), day,
        F.lit("T00:00:00Z</news:publication_date><news:title><![CDATA[Rise & fall "), F.col("page_id").cast("string"),
        F.lit("]]></news:title></news:news></url><url><loc>https://plain.example.org/</loc></url><url><news:news><news:title>x"
              "</news:title></news:news></url></urlset>"),
    )
    kind = F.col("page_id") % 10
    broken = F.replace(news, F.lit("</urlset>"), F.lit("<oops"))
    plain = F.concat(F.lit("<urlset><url><loc>"), url, F.lit("</loc></url></urlset>"))
    text = F.when(kind == 0, broken).when(kind == 5, plain).otherwise(news)
    return view(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("feed_name"), F.col("url").alias("source_url"), text.alias("xml")
    )


@query("ingest_news_sitemap", f"""
    SELECT CAST(page_id AS VARCHAR) AS feed_name, CASE WHEN page_id % 3 = 0 THEN {host('url')} ELSE 'Daily' END AS feed_title,
      url AS link, sha256(url) AS source_guid, concat('Rise & fall ', CAST(page_id AS VARCHAR)) AS title, 'en' AS metadata_language,
      TIMESTAMP '2024-01-01 00:00:00' + (page_id % 28) * INTERVAL '1' DAY AS published_at
    FROM pages WHERE page_id % 10 NOT IN (0, 5)""")
def ingest_news_sitemap(spark, folder):
    items = xml.ingest_news_sitemap(sitemaps(spark, folder))
    return items.select("feed_name", "feed_title", "link", "source_guid", "title", "metadata_language",
                        F.col("published_at").cast("timestamp_ntz").alias("published_at"))


def timelines(spark, folder):
    """Timeline pages of up to 20 posts, made of conversation turns; every page has cursors and a sidebar entry."""
    turns = view(spark, folder, "conversations")
    post = F.struct(
        F.col("post_id").alias("rest_id"),
        F.struct(F.col("post_id").alias("id_str"), F.col("conv_id").cast("string").alias("conversation_id_str"),
                 F.col("role").alias("user_id_str"), F.col("text").alias("full_text")).alias("legacy"),
        F.struct(F.struct(F.struct(F.struct(F.col("role").alias("screen_name")).alias("legacy")).alias("result")).alias("user_results")).alias("core"),
    )
    wrapped = F.struct(F.lit("TweetWithVisibilityResults").alias("__typename"), F.col("post").alias("tweet"))
    as_json = F.when(F.col("turn") % 3 == 0, F.to_json(F.struct(wrapped.alias("result")))).otherwise(
        F.to_json(F.struct(F.col("post").alias("result"))))
    rows = turns.withColumn("post_id", (F.col("conv_id") * 1000 + F.col("turn")).cast("string")).withColumn("post", post).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 20).cast("string")).alias("page"), "turn",
        F.concat(F.lit('{"content":{"itemContent":{"itemType":"TimelineTweet","tweet_results":'), as_json, F.lit("}}}")).alias("entry"),
    )
    # Pages hold 20 turns at most, so the collected list is bounded.
    pages = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("turn", "entry"))).alias("e"))
    entries = F.array_join(F.transform("e", lambda x: x["entry"]), ",")
    cursor = '{"content":{"entryType":"TimelineTimelineCursor","cursorType":"%s","value":"%s"}}'
    raw = F.concat(
        F.lit('{"data":{"threaded_conversation_with_injections_v2":{"instructions":[{"type":"TimelineClearCache"},'
              '{"type":"TimelineAddEntries","entries":['), entries, F.lit("," + cursor % ("Top", "t") + "," + cursor % ("Top", "t")),
        F.lit(',{"content":{"clientEventInfo":{"component":"you_might_also_like"},"itemContent":{"tweet_results":{"result":{"rest_id":"0"}}}}}]},'
              '{"type":"TimelineAddToModule","moduleItems":[{"item":{"itemContent":{"itemType":"TimelineTimelineCursor","cursorType":"ShowMore",'
              '"value":"m'), F.col("page"), F.lit('"}}}]}]}}}'),
    )
    return pages.select("page", raw.alias("raw"))


@query("ingest_timeline", """
    SELECT concat(CAST(conv_id AS VARCHAR), '-', CAST(turn // 20 AS VARCHAR)) AS page, CAST(conv_id * 1000 + turn AS VARCHAR) AS post_id,
      CAST(conv_id AS VARCHAR) AS conversation_id, role AS author, role AS username, text FROM conversations""")
def ingest_timeline(spark, folder):
    items = timeline.timeline_items(timelines(spark, folder), "page", "raw")
    return timeline.ingest_posts(items, "page").select("page", "post_id", "conversation_id", "author", "username", "text")


@query("ingest_timeline_cursors", """
    WITH pages_ AS (SELECT DISTINCT concat(CAST(conv_id AS VARCHAR), '-', CAST(turn // 20 AS VARCHAR)) AS page FROM conversations)
    SELECT page, 'top' AS kind, 't' AS cursor FROM pages_ UNION ALL SELECT page, 'more', concat('m', page) FROM pages_""")
def ingest_timeline_cursors(spark, folder):
    items = timeline.timeline_items(timelines(spark, folder), "page", "raw")
    return timeline.ingest_cursors(items, "page").select("page", "kind", "cursor")


@query("ingest_usage_log", """
    SELECT event_id, event_id % 4 <> 3 AS has_usage, CASE event_id % 4 WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN NULL END AS input_tokens,
      CASE event_id % 4 WHEN 0 THEN k + 1 WHEN 1 THEN 7 END AS output_tokens, CASE event_id % 4 WHEN 0 THEN 2 * k + 1 WHEN 2 THEN k END AS total_tokens
    FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) t""")
def ingest_usage_log(spark, folder):
    k = F.get_json_object("props", "$.k").cast("bigint")

    def usage(**fields):
        return F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))

    first = usage(input_tokens=F.lit(1), total_tokens=F.lit(1))
    last = usage(input_tokens=k, output_tokens=k + 1, total_tokens=2 * k + 1)
    stream = F.concat(
        F.lit('event: a\ndata: {"response":{"usage":'), first, F.lit('}}\n\ndata: {"response":\ndata: {"usage":'), last,
        F.lit('}}\n\n\ndata: [DONE]\n\n'),
    )
    plain = F.concat(F.lit('{"usage":'), usage(prompt_tokens=k, completion_tokens=F.lit(7)), F.lit("}"))
    odd = F.concat(F.lit('{"usage":'), usage(input_tokens=F.lit("many"), output_tokens=F.lit(-2), total_tokens=k), F.lit("}"))
    kind = F.col("event_id") % 4
    raw = F.when(kind == 0, stream).when(kind == 1, plain).when(kind == 2, odd).otherwise(F.lit("data: nothing\n\n"))
    logs = view(spark, folder, "events").select("event_id", raw.alias("raw"))
    return usage_log.ingest_usage_log(logs, "event_id", "raw")


def posts(spark, folder):
    return view(spark, folder, "v_posts").withColumn("seen_no", F.col("post_id") % 1000)


def roots(spark, folder):
    return view(spark, folder, "v_thread_posts").filter("turn = root_turn").select("conversation_id", "post_id")


ASSEMBLED = """
    roots AS (SELECT conversation_id, post_id AS root_id, author AS root_author FROM v_thread_posts WHERE turn = root_turn),
    thread AS (SELECT root_id, p.conversation_id, author, post_id, turn, row_number() OVER (PARTITION BY root_id ORDER BY turn) AS position
      FROM v_thread_posts p JOIN roots r ON r.conversation_id = p.conversation_id AND r.root_author = p.author)"""


@query("thread_assembly", f"WITH {ASSEMBLED} SELECT root_id, conversation_id, author, post_id, position FROM thread WHERE position <= 250")
def thread_assembly(spark, folder):
    twice = posts(spark, folder).unionByName(posts(spark, folder).withColumn("seen_no", F.col("seen_no") + 5000))
    thread = th.thread_assembly(twice, roots(spark, folder))
    return thread.select("root_id", "conversation_id", "author", "post_id", "position")


@query("thread_latest", f"""
    WITH {ASSEMBLED}
    SELECT r.root_id, arg_max(p.post_id, p.created_at) AS latest_id, max(p.created_at) AS latest_at
    FROM v_posts p JOIN roots r ON r.conversation_id = p.conversation_id AND r.root_author = p.author
    WHERE p.post_id = r.root_id OR reply_to_author IS NULL OR reply_to_author = root_author OR COALESCE(reply_to_post = p.conversation_id * 1000, false)
    GROUP BY r.root_id""")
def thread_latest(spark, folder):
    rows = posts(spark, folder).withColumn("conversation_root", F.col("conversation_id") * 1000)
    return th.thread_latest(rows, roots(spark, folder))


@query("thread_markdown", f"""
    WITH {ASSEMBLED},
    parts AS (SELECT t.root_id, t.author, t.position, count(*) OVER (PARTITION BY t.root_id) AS n, concat(
        'https://x.com/', t.author, '/status/', CAST(t.post_id AS VARCHAR), chr(10), chr(10),
        CASE WHEN t.post_id % 7 = 3 THEN '_No text or media._' ELSE trim(p.text) END) AS body
      FROM thread t JOIN v_thread_posts p ON p.post_id = t.post_id WHERE t.position <= 250)
    SELECT root_id, count(*) AS posts, concat('# Thread by @', author, chr(10), 'Source: https://x.com/', author, '/status/', CAST(root_id AS VARCHAR), chr(10),
      'Tweets: ', CAST(count(*) AS VARCHAR), chr(10), chr(10),
      string_agg(CASE WHEN n > 1 THEN concat('## ', CAST(position AS VARCHAR), chr(10), body) ELSE body END, chr(10) || chr(10) ORDER BY position)) AS markdown
    FROM parts GROUP BY root_id, author""")
def thread_markdown(spark, folder):
    thread = th.thread_assembly(posts(spark, folder), roots(spark, folder))
    texts = posts(spark, folder).select("post_id", F.when(F.col("post_id") % 7 != 3, F.col("text")).alias("text"))
    rows = thread.join(texts, "post_id")
    return th.thread_markdown(rows, F.concat(F.lit("Thread by @"), "author"), F.col("author"))


@query("list_numbering", """
    WITH runs AS (SELECT doc_id, pos, block_type, sum(CASE WHEN block_type <> 'ordered-list-item' THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM v_blocks)
    SELECT doc_id, pos, block_type, CASE WHEN block_type = 'ordered-list-item' THEN
      CAST(sum(CASE WHEN block_type = 'ordered-list-item' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, run ORDER BY pos) AS BIGINT) END AS item_no
    FROM runs""")
def list_numbering(spark, folder):
    blocks = view(spark, folder, "v_blocks").select("doc_id", "pos", "block_type")
    return ar.list_numbering(blocks, "doc_id", ["pos"], "block_type")


@query("code_run_grouping", """
    WITH seen AS (SELECT doc_id, pos, block_type, lag(block_type) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM v_blocks),
    flags AS (SELECT *, block_type = 'code-block' AND COALESCE(before, '') <> 'code-block' AS opens_fence,
        block_type <> 'code-block' AND COALESCE(before, '') = 'code-block' AS closes_fence,
        before IS NOT NULL AND NOT (block_type = before AND block_type IN ('code-block', 'ordered-list-item', 'blockquote')) AS blank_before FROM seen)
    SELECT doc_id, pos, block_type, opens_fence, closes_fence, blank_before, CASE WHEN block_type = 'code-block' THEN
      CAST(sum(CASE WHEN opens_fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) END AS fence_no FROM flags""")
def code_run_grouping(spark, folder):
    blocks = view(spark, folder, "v_blocks").select("doc_id", "pos", "block_type")
    return ar.code_run_grouping(blocks, "doc_id", ["pos"], "block_type")


def rich_articles(spark, folder):
    """Rich articles in JSON, one per document: two text blocks, a list, a quoted post, and media with a paired link."""
    lines = F.split("text", "\n")
    number = F.col("doc_id").cast("string")

    def block(kind, text, key=None, length=1):
        span = F.struct(F.lit(key).alias("key"), F.lit(0).alias("offset"), F.lit(length).alias("length"))
        ranges = F.array(span) if key is not None else F.array().cast("array<struct<key:int,offset:int,length:int>>")
        return F.to_json(F.struct(F.lit(kind).alias("type"), text.alias("text"), ranges.alias("entityRanges")))

    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    blocks = F.concat_ws(
        ",", block("header-two", F.substring(first, 1, 30)), block("unstyled", F.concat(F.lit("Read it "), first), 0, 4),
        block("ordered-list-item", F.lit("one")), block("ordered-list-item", F.lit("two")), block("code-block", F.lit("a = 1")),
        block("code-block", F.lit("b = 2")), block("atomic", F.lit(" "), 1), block("atomic", F.lit(" "), 2),
        block("blockquote", F.lit("x\ny")),
    )
    entity_map = F.concat(
        F.lit('{"0":{"key":"0","value":{"type":"LINK","data":{"url":"https://example.org/'), number,
        F.lit('"}}},"1":{"key":"1","value":{"type":"TWEET","data":{"tweetId":"'), (F.col("doc_id") % 50).cast("string"),
        F.lit('"}}},"2":{"key":"2","value":{"type":"MEDIA","data":{"caption":"A [b]","mediaItems":[{"mediaId":"m1"}]}}}}'),
    )
    media = ('[{"media_id":"m1","media_info":{"preview_image":{"original_img_url":"https://img.example.org/p.jpg"},"variants":['
             '{"content_type":"video/mp4","bit_rate":64,"url":"https://v.example.org/low.mp4"},'
             '{"content_type":"video/mp4","bit_rate":256,"url":"https://v.example.org/high.mp4"}]}},'
             '{"media_id":"m2","media_info":{"original_img_url":"https://img.example.org/end.jpg"}}]')
    raw = F.concat(
        F.lit('{"title":" Doc '), number, F.lit(' ","media_entities":' + media + ',"content_state":{"blocks":['), blocks,
        F.lit('],"entityMap":'), entity_map, F.lit("}}"),
    )
    return ar.read_articles(view(spark, folder, "documents").select("doc_id", raw.alias("raw")), "doc_id", "raw")


def known_posts(spark, folder):
    return view(spark, folder, "conversations").filter("turn = 0 AND conv_id % 2 = 0").select(
        F.col("conv_id").cast("string").alias("post_id"), F.lit("Quoted").alias("name"), F.col("role").alias("username"), "text"
    )


SUMMARY = """(CASE WHEN length({0}) <= 280 THEN {0} ELSE concat(substring({0}, 1, 277), '...') END)""".format(
    "array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(l)), lambda l: l <> ''), ' ')")


@query("referenced_enrichment", f"""
    WITH known AS (SELECT CAST(conv_id AS VARCHAR) AS post_id, role, {SUMMARY} AS summary FROM conversations WHERE turn = 0 AND conv_id % 2 = 0)
    SELECT doc_id, CAST(1 AS BIGINT) AS rank, CAST(doc_id % 50 AS VARCHAR) AS post_id,
      CASE WHEN role IS NULL THEN concat('https://x.com/i/web/status/', CAST(doc_id % 50 AS VARCHAR))
        ELSE concat('https://x.com/', role, '/status/', CAST(doc_id % 50 AS VARCHAR)) END AS url,
      concat('Quoted (@' || role || ')') AS author, COALESCE(summary, '') AS summary
    FROM documents LEFT JOIN known ON known.post_id = CAST(doc_id % 50 AS VARCHAR)""")
def referenced_enrichment(spark, folder):
    found = ar.entities(rich_articles(spark, folder), "doc_id")
    out = ar.referenced_enrichment(found, "doc_id", known_posts(spark, folder))
    return out.withColumn("author", F.coalesce("author", F.lit("")))


@query("media_lookup", """
    SELECT doc_id, 'm1' AS media_id, 'video' AS kind, 'https://v.example.org/high.mp4' AS url, 'https://img.example.org/p.jpg' AS poster FROM documents
    UNION ALL SELECT doc_id, 'm2', 'image', 'https://img.example.org/end.jpg', NULL FROM documents""")
def media_lookup(spark, folder):
    return ar.media_lookup(rich_articles(spark, folder), "doc_id").select("doc_id", "media_id", "kind", "url", "poster")


@query("media_link_pairing", """
    SELECT doc_id, 2 AS map_index, 2 AS logical_key, concat('https://example.org/', CAST(doc_id AS VARCHAR)) AS url FROM documents""")
def media_link_pairing(spark, folder):
    return ar.media_link_pairing(rich_articles(spark, folder), "doc_id")


@query("article_markdown", f"""
    WITH known AS (SELECT CAST(conv_id AS VARCHAR) AS post_id, role, {SUMMARY} AS summary FROM conversations WHERE turn = 0 AND conv_id % 2 = 0),
    parts AS (SELECT doc_id, string_split(text, chr(10))[1] AS line, CAST(doc_id % 50 AS VARCHAR) AS pid FROM documents)
    SELECT doc_id, sha256(concat('# Doc ', CAST(doc_id AS VARCHAR), chr(10), chr(10), '## ', substring(line, 1, 30), chr(10), chr(10),
      '[Read](https://example.org/', CAST(doc_id AS VARCHAR), ') it ', line, chr(10), chr(10), '1. one', chr(10), '2. two', chr(10), chr(10),
      '```', chr(10), 'a = 1', chr(10), 'b = 2', chr(10), '```', chr(10), chr(10),
      '> 引用推文', CASE WHEN role IS NULL THEN '' ELSE concat('：Quoted (@', role, ')', chr(10), '> ', summary) END, chr(10),
      '> https://x.com/', COALESCE(role || '/status/', 'i/web/status/'), pid, chr(10), chr(10),
      '![A \\[b\\]](https://img.example.org/p.jpg)', chr(10), '[video](https://v.example.org/high.mp4)', chr(10), chr(10), '> x', chr(10), '> y',
      chr(10), chr(10), '## Media', chr(10), chr(10), '![](https://img.example.org/end.jpg)')) AS markdown_hash
    FROM parts LEFT JOIN known ON known.post_id = pid""")
def article_markdown(spark, folder):
    texts = ar.article_markdown(rich_articles(spark, folder), "doc_id", known_posts(spark, folder))
    return texts.select("doc_id", tx.hash_text(F.col("markdown")).alias("markdown_hash"))
