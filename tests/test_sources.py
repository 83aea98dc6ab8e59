import json
from xml.etree import ElementTree

from conftest import rows
from pyspark.sql import functions as F

from feedloom.operators import articles, publish
from feedloom.sources import timeline, usage_log, xml

DOC = "feed_name string, source_url string, xml string"


def test_rss_and_atom(spark):
    rss = """<?xml version="1.0"?><rss xmlns:content="c" xmlns:dc="d"><channel><title> F </title>
      <item><guid isPermaLink="false">g1</guid><title>One &amp; two</title><link>/a</link><dc:creator>Ann</dc:creator>
        <pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><description>short</description><content:encoded><![CDATA[<p>b</p>]]></content:encoded></item>
      <item><title>Bare</title><link>https://o.example/b</link></item></channel></rss>"""
    atom = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><entry><id>e1</id><title>E</title><link rel="self" href="/s"/>
      <link href="/e"/><author><name>Bob</name></author><updated>2024-01-02T00:00:00Z</updated><summary>s</summary></entry></feed>"""
    df = spark.createDataFrame([("r", "https://f.example/feed.xml", rss), ("a", "https://f.example/atom", atom), ("x", "https://f.example/", "<rss><oops")], DOC)
    out = sorted(rows(xml.ingest_rss(df), "feed_name", "feed_title", "pos", "link", "title", "author", "content", "published_at"), key=str)
    assert [r[:7] for r in out] == [
        ("a", "A", 0, "https://f.example/e", "E", "Bob", "s"), ("r", "F", 0, "https://f.example/a", "One & two", "Ann", "<p>b</p>"),
        ("r", "F", 1, "https://o.example/b", "Bare", None, "")]
    assert str(out[1][7]) == "2024-01-01 10:00:00"
    guid = rows(xml.ingest_rss(df).filter("feed_name = 'r' AND pos = 0").select(F.col("source_guid") == F.sha2(F.lit("g1"), 256)))
    assert guid == [(True,)]


def test_news_sitemap(spark):
    head = '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:news="http://www.google.com/schemas/sitemap-news/0.9">'
    news = head + """<url><loc>https://r.example/a</loc><news:news><news:publication><news:name>Reuters</news:name><news:language>en</news:language>
      </news:publication><news:publication_date>2026-08-01T00:00:00Z</news:publication_date><news:title><![CDATA[Rivers freeze & skaters cheer]]></news:title></news:news></url></urlset>"""
    empty = head + "<url><loc>https://r.example/b</loc></url><url><news:news><news:title>x</news:title></news:news></url></urlset>"
    df = spark.createDataFrame([("n", "https://r.example/s", news), ("e", "https://r.example/s", empty), ("b", "u", news[:-9]),
                                ("r", "u", "<rss/>"), ("p", "u", "<urlset><url><loc>x</loc></url></urlset>")], DOC)
    out = xml.ingest_news_sitemap(df)
    assert rows(out, "feed_name", "feed_title", "title", "link") == [("n", "Reuters", "Rivers freeze & skaters cheer", "https://r.example/a")]


def post(n):
    return {"tweet_results": {"result": {"rest_id": n, "legacy": {"id_str": n, "user_id_str": "u"}}}}


def test_timeline(spark):
    cursor = lambda kind, value: {"content": {"entryType": "TimelineTimelineCursor", "cursorType": kind, "value": value}}
    wrapped = {"tweet_results": {"result": {"__typename": "TweetWithVisibilityResults", "tweet": {"rest_id": "101", "legacy": {"id_str": "101"}}}}}
    page = {"data": {
        "threaded_conversation_with_injections_v2": {"instructions": [
            {"type": "TimelineAddEntries", "entries": [{"content": {"itemContent": post("100")}}, cursor("Top", "top-A")]},
            {"type": "TimelineAddEntries", "entries": [{"content": {"itemContent": wrapped}}, cursor("Bottom", "bottom-A"), cursor("Bottom", "bottom-A"),
                {"content": {"clientEventInfo": {"component": "you_might_also_like"}, "itemContent": post("0")}}]},
            {"type": "TimelineAddToModule", "moduleItems": [{"item": {"itemContent": post("102")}}]}, {"type": "Other", "entries": [{"content": {"itemContent": post("9")}}]}]},
        "threaded_conversation_with_injections": {"instructions": [{"type": "TimelineAddEntries", "entries": [{"content": {"itemContent": post("7")}}]}]}}}
    legacy = {"data": {"threaded_conversation_with_injections": page["data"]["threaded_conversation_with_injections"]}}
    df = spark.createDataFrame([("n", json.dumps(page)), ("l", json.dumps(legacy)), ("b", "{")], "page string, raw string")
    items = timeline.timeline_items(df, "page", "raw")
    assert rows(timeline.ingest_posts(items, "page").orderBy("page", "pos"), "page", "post_id") == [("l", "7"), ("n", "100"), ("n", "101"), ("n", "102")]
    assert sorted(rows(timeline.ingest_cursors(items, "page"), "kind", "cursor")) == [("bottom", "bottom-A"), ("top", "top-A")]


def test_usage_log(spark):
    sse = 'event: x\r\ndata: {"response":{"usage":{"input_tokens":1}}}\n\ndata: {"usage":\ndata: {"prompt_tokens":5,"output_tokens":2.5,"total_tokens":-1}}\n\ndata: [DONE]\n\n'
    df = spark.createDataFrame([(1, sse), (2, '{"usage":{"total_tokens":7}}'), (3, "oops"), (4, None)], "id int, raw string")
    out = sorted(rows(usage_log.ingest_usage_log(df, "id", "raw"), "id", "input_tokens", "output_tokens", "total_tokens", "has_usage"))
    assert out == [(1, 5, None, None, True), (2, None, None, 7, True), (3, None, None, None, False), (4, None, None, None, False)]


def article_rows(spark, *found):
    df = spark.createDataFrame([(i, json.dumps(a)) for i, a in enumerate(found)], "id int, raw string")
    return articles.read_articles(df, "id", "raw")


RICH = {
    "title": "Rich article", "cover_media": {"media_info": {"original_img_url": "https://i.example/cover.jpg"}},
    "media_entities": [
        {"media_id": "m1", "media_info": {"preview_image": {"original_img_url": "https://i.example/poster.jpg"}, "variants": [
            {"content_type": "application/x-mpegURL", "url": "https://v.example/list"}, {"content_type": "video/mp4", "bit_rate": 64, "url": "https://v.example/low.mp4"},
            {"content_type": "video/mp4", "bit_rate": 256, "url": "https://v.example/high.mp4"}]}},
        {"media_id": "m2", "media_info": {"original_img_url": "https://i.example/trailing.jpg"}},
        {"media_id": "m3", "media_info": {"original_img_url": "https://i.example/cover.jpg"}},
        {"media_id": "m4", "media_info": {"original_img_url": "https://i.example/trailing.jpg"}}],
    "content_state": {"entityMap": {
        "0": {"key": "10", "value": {"type": "LINK", "data": {"url": "https://e.example/story"}}},
        "1": {"key": "5", "value": {"type": "MEDIA", "data": {"caption": " Video   clip ", "mediaItems": [{"mediaId": "m1"}], "url": "https://i.example/fallback.jpg"}}},
        "2": {"key": "20", "value": {"type": "TWEET", "data": {"tweetId": "42"}}},
        "3": {"key": "21", "value": {"type": "MARKDOWN", "data": {"markdown": "**embedded**\r\nline\r\n"}}},
        "4": {"key": "22", "value": {"type": "TWEET", "data": {"tweetId": "42"}}}, "5": {"key": "23", "value": {"type": "TWEET", "data": {}}}},
        "blocks": [
            {"type": "unstyled", "text": "Read story and photo", "entityRanges": [{"key": 10, "offset": 5, "length": 5}, {"key": 5, "offset": 15, "length": 5}]},
            {"type": "header-three", "text": "H"}, {"type": "unordered-list-item", "text": "First item"}, {"type": "ordered-list-item", "text": "Ordered one"},
            {"type": "ordered-list-item", "text": "Ordered two"}, {"type": "blockquote", "text": "Line one\nLine two"}, {"type": "code-block", "text": "const one = 1;"},
            {"type": "code-block", "text": "const two = 2;"}, {"type": "atomic", "text": " ", "entityRanges": [{"key": 20, "offset": 0, "length": 1}]},
            {"type": "atomic", "text": " ", "entityRanges": [{"key": 21, "offset": 0, "length": 1}, {"key": 10, "offset": 0, "length": 1}]},
            {"type": "unstyled", "text": "XIMGPH_1", "entityRanges": [{"key": 5, "offset": 0, "length": 8}]}, {"type": "code-block", "text": "end"}]},
}


def test_rich_article(spark):
    found = article_rows(spark, RICH, {"plain_text": " Plain body "}, {"preview_text": " Preview body "})
    posts = spark.createDataFrame([("42", "Quoted Author", "quoted", "A quoted tweet\nwith space")], "post_id string, name string, username string, text string")
    out = {r[0]: r[1:] for r in rows(articles.article_markdown(found, "id", posts))}
    assert out[1] == ("Plain body", None) and out[2] == ("Preview body", None)
    assert out[0][1] == "https://i.example/cover.jpg"
    assert out[0][0] == "\n".join([
        "# Rich article", "", "Read [story](https://e.example/story) and [photo](https://e.example/story)", "",
        "![Video clip](https://i.example/poster.jpg)", "[video](https://v.example/high.mp4)", "![Video clip](https://i.example/fallback.jpg)", "",
        "### H", "", "- First item", "1. Ordered one", "2. Ordered two", "", "> Line one", "> Line two", "", "```", "const one = 1;", "const two = 2;", "```", "",
        "> 引用推文：Quoted Author (@quoted)", "> A quoted tweet with space", "> https://x.com/quoted/status/42", "",
        "**embedded**", "line", "", "https://e.example/story", "", "[XIMGPH_1](https://e.example/story)", "", "```", "end", "```", "", "## Media", "", "![](https://i.example/trailing.jpg)"])


def test_article_parts(spark):
    found = article_rows(spark, RICH)
    assets = articles.media_lookup(found, "id").filter("NOT repeated").orderBy("pos")
    assert rows(assets, "kind", "url", "poster") == [
        ("video", "https://v.example/high.mp4", "https://i.example/poster.jpg"), ("image", "https://i.example/trailing.jpg", None),
        ("image", "https://i.example/cover.jpg", None)]
    entities = articles.entities(found, "id")
    none = spark.createDataFrame([], "post_id string, name string, username string, text string")
    assert rows(articles.referenced_enrichment(entities, "id", none), "post_id", "url") == [("42", "https://x.com/i/web/status/42")]
    keys = [(1, "MEDIA", None), (9, "IMAGE", None), (3, "LINK", "a"), (5, "LINK", "b"), (7, "MEDIA", None), (8, "MEDIA", None)]
    one = spark.createDataFrame([(1, [(p, p, k, t, (u,)) for p, (k, t, u) in enumerate(keys)])], (
        "id int, found array<struct<pos: int, map_index: int, logical_key: int, type: string, data: struct<url: string>>>"))
    pairs = articles.media_link_pairing(one, "id", F.col("found"))
    assert sorted(rows(pairs, "logical_key", "url")) == [(1, "a"), (7, "b")]


def test_outlines_written_and_read_back(spark, tmp_path):
    feeds = spark.createDataFrame(
        [(f"f{k:03}", f"https://x{k}.org/?a=1&b", ["", "News", "News/Local & <far>"][k % 3], f'T "{k}"' if k % 4 else "") for k in range(60)],
        "feed_name string, source_url string, folder string, title string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    publish.write_outline(publish.publish_outline(feeds, "https://me"), str(tmp_path / "o"), "Mine & yours")
    text = "\n".join(f.read_text().rstrip("\n") for f in sorted((tmp_path / "o").glob("part-*")) if f.stat().st_size)
    tree = ElementTree.fromstring(text.encode())  # a whole document
    assert tree.find("head/title").text == "Mine & yours" and len(tree.findall(".//outline[@xmlUrl]")) == 60
    back = xml.ingest_outline(spark.createDataFrame([("d", text)], "document string, xml string"))
    want = sorted((f"https://me/feeds/{r.feed_name}.xml", r.title or r.feed_name, r.folder) for r in feeds.collect())
    assert sorted(rows(back, "source_url", "title", "folder")) == want


def test_outlines_of_any_shape(spark):
    docs = [("deep", "<outline text='a'>" * 30 + "<outline xmlUrl='u' text='x'/>" + "</outline>" * 30), ("loose", "</outline><outline text='a'><outline xmlUrl='1'>"
            "<outline xmlUrl=\"2>\" title='&#65;&amp;lt;'/></outline><outline text='e'/><outline xmlUrl=' '/><outline xmlUrl='3'/>"), ("none", "<opml/>"), ("null", None), ("other", "<outlines xmlUrl='x'/>")]
    out = rows(xml.ingest_outline(spark.createDataFrame(docs, "document string, xml string")), "document", "pos", "source_url", "title", "folder")
    assert sorted(out) == [("deep", 0, "u", "x", "/".join("a" * 30)), ("loose", 0, "1", None, "a"), ("loose", 1, "2>", "A&lt;", "a"), ("loose", 2, "3", None, "a")]


def test_outlines_are_folded_in_one_pass(spark):
    """Tags become rows that batches fold: many feeds cost as many steps, and a document may end or begin inside a batch."""
    n = 40000
    leaf = "".join(f"<outline text='t{k}' xmlUrl='u{k}'/>" for k in range(n))
    docs = [("a", f"<outline text='x'>{leaf}"), ("b", "<outline title='y'><outline xmlUrl='v'/></outline>"), ("a", "<outline xmlUrl='w' text='again'/>")]
    out = xml.ingest_outline(spark.createDataFrame(docs, "document string, xml string").coalesce(1))
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()  # no list of feeds grows with each step
    got = rows(out, "document", "pos", "source_url", "title", "folder")
    assert got == [*[("a", k, f"u{k}", f"t{k}", "x") for k in range(n)], ("b", 0, "v", None, "y"), ("a", 0, "w", "again", "")]
    keyed = xml.ingest_outline(spark.createDataFrame([(7, "<outline xmlUrl='u'/>"), (8, None)], "document bigint, xml string"))
    assert rows(keyed, "document", "pos", "source_url", "title", "folder") == [(7, 0, "u", None, "")]
