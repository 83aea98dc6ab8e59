"""Publish feeds and outlines, compare published documents, and read outline trees."""

from __future__ import annotations

from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.functions import urls as ul
from feedloom.operators.lists import display_html, latest_per_feed, sort_ts
from feedloom.session import cut, exists, remove

ITEMS_PER_FEED = 50


def element(name: str, value: Column, escape: bool = True) -> Column:
    return F.concat(F.lit(f"<{name}>"), tx.xml_escape(value) if escape else value, F.lit(f"</{name}>"))


def cdata(value: Column) -> Column:
    """A CDATA section; its own end mark inside the value is split over two sections."""
    return F.concat(F.lit("<![CDATA["), F.replace(value, F.lit("]]>"), F.lit("]]]]><![CDATA[>")), F.lit("]]>"))


# What a document shows of an item and of its feed
DOCUMENT_ITEM = ("title", "guid", "url", "date", "author", "description", "content", "source_url")
DOCUMENT_HEAD = ("feed_name", "title", "source_url", "translate_enabled")


def publish_items(entries: DataFrame, base_url: str, n: int = ITEMS_PER_FEED) -> DataFrame:
    """Newest n entries per feed as item rows. Bodies are resolved after the cut to n rows."""
    top = latest_per_feed(entries, n).withColumn("content", display_html())
    described = tx.truncate_text(tx.strip_html(F.col("content")), 240)
    return top.select(
        "feed_name", "rank",
        F.coalesce(tx.first_filled(F.col("translated_title"), F.col("source_title")), F.lit("Untitled")).alias("title"),
        F.concat_ws(":", "feed_name", "source_guid").alias("guid"),
        F.concat(F.lit(f"{base_url}/articles/"), F.col("id").cast("string")).alias("url"),
        sort_ts().alias("date"), F.coalesce("source_author", F.lit("")).alias("author"),
        described.alias("description"), "content", "source_url", "translation_provider", "refresh_status",
    )


def publish_feeds(items: DataFrame, feeds: DataFrame, base_url: str) -> DataFrame:
    """One document per feed. Its items are at most the published number, so the collected list is bounded."""
    parts = F.concat(
        F.lit("<item>"), element("title", F.col("title")), element("guid", F.col("guid")), element("link", F.col("url")),
        element("pubDate", F.date_format("date", "yyyy-MM-dd'T'HH:mm:ss")), element("author", F.col("author")),
        element("description", F.col("description")), element("content:encoded", cdata(F.col("content")), escape=False),
        element("source", F.col("source_url")), F.lit("</item>"),
    )
    listed = items.select("feed_name", "rank", parts.alias("xml")).groupBy("feed_name").agg(
        F.count(F.lit(1)).alias("item_count"), F.array_sort(F.collect_list(F.struct("rank", "xml"))).alias("_items")
    )
    body = F.array_join(F.transform("_items", lambda i: i["xml"]), "\n")
    joined = feeds.select("feed_name", "title", "source_url", "translate_enabled").join(listed, "feed_name", "left")
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" '
              'xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel>'),
        element("title", F.concat(F.coalesce(tx.blank_to_null(F.col("title")), F.col("feed_name")), F.lit(" | Reader View"))),
        element("link", F.col("source_url")),
        element("language", F.when(F.col("translate_enabled"), "zh-CN").otherwise("en")),
    )
    xml = F.concat(head, F.coalesce(body, F.lit("")), F.lit("</channel></rss>"))
    return joined.select("feed_name", F.coalesce("item_count", F.lit(0)).alias("item_count"), tx.xml_clean(xml).alias("xml"))


def write_feeds(published: DataFrame, path: str) -> None:
    """One text file tree per feed; the trees of other feeds stay as they are."""
    rows = published.select("feed_name", F.col("xml").alias("value"))
    rows.write.partitionBy("feed_name").mode("overwrite").option("partitionOverwriteMode", "dynamic").text(path)


def publish_outline(feeds: DataFrame, base_url: str, folder: str = "") -> DataFrame:
    """Outline rows in document order: a folder row opens its group, feeds follow, folderless feeds stand at the root.

    Rows are not collected per folder: a folder may hold very many feeds. `write_outline` writes them in order."""
    wanted = ul.normalize_folder(F.lit(folder))
    rows = feeds.withColumn("folder", ul.normalize_folder(F.col("folder"))).filter(
        (wanted == "") | (F.col("folder") == wanted)
    )
    title = F.coalesce(tx.blank_to_null(F.col("title")), F.col("feed_name"))
    feed_url = F.concat(F.lit(f"{base_url}/feeds/"), F.col("feed_name"), F.lit(".xml"))

    def attribute(name: str, value: Column) -> Column:
        return F.concat(F.lit(f' {name}="'), tx.xml_escape(value), F.lit('"'))

    leaf = F.concat(
        F.lit("<outline"), attribute("text", title), attribute("title", title), F.lit(' type="rss"'),
        attribute("xmlUrl", feed_url), attribute("htmlUrl", F.col("source_url")), F.lit(" />"),
    )
    leaves = rows.select("folder", F.lit(1).alias("part"), "created_at", "feed_name", leaf.alias("line"))
    folders = rows.filter("folder <> ''").select("folder").distinct()
    none = [F.lit(None).cast(t).alias(c) for c, t in rows.select("created_at", "feed_name").dtypes]
    opened = F.concat(F.lit("<outline"), attribute("text", F.col("folder")), attribute("title", F.col("folder")), F.lit(">"))
    opens = folders.select("folder", F.lit(0).alias("part"), *none, opened.alias("line"))
    closes = folders.select("folder", F.lit(2).alias("part"), *none, F.lit("</outline>").alias("line"))
    return opens.unionByName(leaves).unionByName(closes)


def outline_document(outline: DataFrame, title: str) -> DataFrame:
    """(place, folder, part, created_at, feed_name, line): the rows of `publish_outline` between the head and the end of a document; they
    sort by these columns."""
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<opml version="2.0">', f"<head><title>{escape(title)}</title></head>", "<body>"]
    place = lambda k: F.lit(k).alias("place")
    frame = outline.sparkSession.createDataFrame([(0, k, x) for k, x in enumerate(head)] + [(2, k, x) for k, x in enumerate(["</body>", "</opml>"])], "place int, part int, line string")
    none = [F.lit(None).cast(t).alias(c) for c, t in outline.dtypes if c in ("folder", "created_at", "feed_name")]
    return outline.select(place(1), "*").unionByName(frame.select("*", *none))


def write_outline(outline: DataFrame, path: str, title: str = "Feeds") -> None:
    """A document in the order of its part files; any number of feeds, sorted over all tasks."""
    order = ["place", "folder", "part", "created_at", "feed_name"]
    outline_document(outline, title).orderBy(*order).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def feed_digests(items: DataFrame, feeds: DataFrame) -> DataFrame:
    """(feed_name, digest) of what the document of each feed shows: a fold over its items in any order, by partial aggregates, and its head."""
    shown = ["rank", *DOCUMENT_ITEM]
    folded = items.groupBy("feed_name").agg(
        F.count(F.lit(1)).alias("n"), *[F.bit_xor(F.xxhash64(F.lit(salt), F.to_json(F.struct(*shown)))).alias(salt) for salt in ("a", "b")]
    )
    head = F.to_json(F.struct(*DOCUMENT_HEAD))
    joined = feeds.select(*DOCUMENT_HEAD).join(folded, "feed_name", "left")
    return joined.select("feed_name", tx.hash_text(F.concat_ws("|", head, "n", "a", "b")).alias("digest"))


def publish_diff(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """(feed_name, state, digest) of feeds whose document differs from the one the manifest names: new, changed or gone."""
    was = manifest.select("feed_name", F.col("digest").alias("_was"))
    state = F.when(F.col("_was").isNull(), F.lit("new")).when(F.col("digest").isNull(), F.lit("gone")).otherwise(F.lit("changed"))
    both = digests.join(was, "feed_name", "full_outer").filter(~F.col("digest").eqNullSafe(F.col("_was")))
    return both.select("feed_name", state.alias("state"), "digest")


def publish_changed(items: DataFrame, feeds: DataFrame, manifest: DataFrame, base_url: str) -> DataFrame:
    """(feed_name, state, digest, item_count, xml): only documents that are new or changed are rendered; gone ones have none.

    `items` should be stored: they are read for the digests and, for the feeds that changed, once more."""
    differs = cut(publish_diff(feed_digests(items, feeds), manifest))
    names = differs.filter("state <> 'gone'").select("feed_name")
    rendered = publish_feeds(items.join(names, "feed_name", "left_semi"), feeds.join(names, "feed_name", "left_semi"), base_url)
    return differs.join(rendered, "feed_name", "left")


def publish_run(spark: SparkSession, entries: DataFrame, feeds: DataFrame, folder: str, number: int, base_url: str) -> DataFrame:
    """Publication `number` into `folder`: documents that differ from the one before are written, those of gone feeds removed, then the
    manifest. A run that is repeated reads the manifest before it again, and the entries are read once. Gives (feed_name, state)."""
    items = cut(publish_items(entries, base_url))
    schema = "feed_name STRING, digest STRING"
    before = f"{folder}/manifest/run={number - 1}"
    manifest = spark.read.schema(schema).parquet(before) if exists(spark, before) else spark.createDataFrame([], schema)
    changed = cut(publish_changed(items, feeds, manifest, base_url))
    write_feeds(changed.filter("state <> 'gone'"), f"{folder}/documents")
    for row in changed.filter("state = 'gone'").select("feed_name").toLocalIterator():
        remove(spark, f"{folder}/documents/feed_name={row.feed_name}")
    kept = manifest.join(changed.select("feed_name"), "feed_name", "left_anti")
    now = kept.unionByName(changed.filter("state <> 'gone'").select("feed_name", "digest"))
    now.write.mode("overwrite").parquet(f"{folder}/manifest/run={number}")
    return changed.select("feed_name", "state")


def outline_paths(nodes: DataFrame) -> DataFrame:
    """Leaves of an outline tree with their folder path.

    Only nodes that can have children are walked, one level per round: folders, and leaves that are somebody's parent,
    which pass their own folder on. The other leaves, which are most of the tree, join once. Each round is written, so a
    lost executor costs one level. A node that no root leads to, of a missing parent or a cycle, stays without a folder."""
    is_leaf = tx.blank_to_null(tx.trim_space(F.coalesce("xml_url", F.lit("")))).isNotNull()
    parents = nodes.select(F.col("parent_id").alias("node_id")).filter("node_id IS NOT NULL").distinct()
    inner = nodes.withColumn("_leaf", is_leaf).join(parents.withColumn("_parent", F.lit(True)), "node_id", "left").filter("_parent OR NOT _leaf")
    walked = inner.select("node_id", "parent_id", F.when(~F.col("_leaf"), tx.normalize_ws(F.col("text"))).alias("text"))
    level = walked.filter("parent_id IS NULL").select("node_id", ul.normalize_folder(F.coalesce("text", F.lit(""))).alias("folder"))
    paths = level = cut(level)
    while not level.isEmpty():
        step = walked.join(level.select(F.col("node_id").alias("parent_id"), F.col("folder").alias("above")), "parent_id")
        level = cut(step.select("node_id", ul.normalize_folder(F.concat_ws("/", "above", "text")).alias("folder")))
        paths = paths.unionByName(level)
    leaves = nodes.filter(is_leaf).select(
        tx.trim_space(F.col("xml_url")).alias("source_url"), tx.normalize_ws(F.col("text")).alias("title"), "parent_id"
    )
    placed = paths.select(F.col("node_id").alias("parent_id"), "folder")
    return leaves.join(placed, "parent_id", "left").select("source_url", "title", F.coalesce("folder", F.lit("")).alias("folder"))
