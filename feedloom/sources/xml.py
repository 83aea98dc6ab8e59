"""Feed documents and news sitemaps: XML text in a table, item rows out. Malformed documents give no rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from feedloom.functions import text as tx
from feedloom.functions import urls as ul
from feedloom.functions.values import parse_date

NEWS_NAMESPACE = "http://www.google.com/schemas/sitemap-news/0.9"

RSS_ITEM = (
    "STRUCT<guid: STRING, id: STRING, title: STRING, link: STRING, `dc:creator`: STRING, creator: STRING, "
    "author: STRING, pubDate: STRING, `dc:date`: STRING, `content:encoded`: STRING, description: STRING>"
)
ATOM_ENTRY = (
    "STRUCT<id: STRING, title: STRING, link: ARRAY<STRUCT<_href: STRING, _rel: STRING>>, author: STRUCT<name: STRING>, "
    "published: STRING, updated: STRING, content: STRING, summary: STRING>"
)
FEED = (
    f"channel STRUCT<title: STRING, link: STRING, item: ARRAY<{RSS_ITEM}>>, item ARRAY<{RSS_ITEM}>, "
    f"title STRING, entry ARRAY<{ATOM_ENTRY}>"
)
NEWS = (
    "url ARRAY<STRUCT<loc: STRING, `news:news`: STRUCT<`news:publication`: STRUCT<`news:name`: STRING, "
    "`news:language`: STRING>, `news:publication_date`: STRING, `news:title`: STRING>>>"
)


def _text(c: Column) -> Column:
    return tx.blank_to_null(tx.trim_space(c))


def ingest_rss(documents: DataFrame) -> DataFrame:
    """One row per item of RSS 2, RSS 1 and Atom documents; `documents` has feed_name, source_url, xml."""
    read = documents.select("feed_name", "source_url", F.from_xml("xml", FEED).alias("d"))
    entries = F.transform("d.entry", lambda e: F.struct(
        F.lit(None).cast("string").alias("guid"), e["id"].alias("id"), e["title"].alias("title"),
        F.coalesce(
            F.get(F.filter(e["link"], lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"],
            F.get(e["link"], F.lit(0))["_href"],
        ).alias("link"),
        F.lit(None).cast("string").alias("dc:creator"), F.lit(None).cast("string").alias("creator"),
        e["author"]["name"].alias("author"), F.coalesce(e["published"], e["updated"]).alias("pubDate"),
        F.lit(None).cast("string").alias("dc:date"), F.lit(None).cast("string").alias("content:encoded"),
        F.coalesce(e["content"], e["summary"]).alias("description"),
    ))
    items = read.select(
        "feed_name", "source_url", _text(F.coalesce("d.channel.title", "d.title")).alias("feed_title"),
        F.posexplode(F.coalesce("d.channel.item", "d.item", entries)).alias("pos", "i"),
    )
    items = items.withColumn("_link", ul.resolve_url(_text(F.col("i.link")), F.col("source_url")))
    date = F.coalesce(_text(F.col("i.pubDate")), _text(F.col("i.dc:date")))
    return items.select(
        "feed_name", "source_url", "feed_title", F.col("pos").cast("bigint").alias("pos"),
        tx.stable_guid(_text(F.col("i.guid")), _text(F.col("i.id")), F.col("_link"),
                       F.col("i.title"), F.col("i.pubDate")).alias("source_guid"),
        F.col("_link").alias("link"), _text(F.col("i.title")).alias("title"),
        F.coalesce(_text(F.col("i.dc:creator")), _text(F.col("i.creator")), _text(F.col("i.author"))).alias("author"),
        parse_date(date).alias("published_at"), date.alias("date_text"),
        F.coalesce(_text(F.col("i.content:encoded")), _text(F.col("i.description")), F.lit("")).alias("content"),
    )


def ingest_news_sitemap(documents: DataFrame) -> DataFrame:
    """One row per news URL; other documents, and URLs without address or news part, give none.

    The title is the first publication name of the document, else the host it came from."""
    news = documents.filter(
        F.contains("xml", F.lit(NEWS_NAMESPACE)) & F.rlike("xml", F.lit(r"<(?:[\w-]+:)?urlset[\s>]"))
    ).select("feed_name", "source_url", F.from_xml("xml", NEWS).alias("d"))
    urls = F.filter("d.url", lambda u: u["news:news"].isNotNull() & (F.trim(F.coalesce(u["loc"], F.lit(""))) != ""))
    kept = news.withColumn("_urls", urls)
    names = F.filter(
        F.transform("_urls", lambda u: tx.trim_space(u["news:news"]["news:publication"]["news:name"])),
        lambda n: n.isNotNull() & (n != ""),
    )
    rows = kept.select(
        "feed_name", "source_url", F.coalesce(F.get(names, F.lit(0)), ul.url_host(F.col("source_url"))).alias("feed_title"),
        F.posexplode("_urls").alias("pos", "u"),
    )
    part = F.col("u.news:news")
    date = _text(part["news:publication_date"])
    return rows.select(
        "feed_name", "source_url", "feed_title", F.col("pos").cast("bigint").alias("pos"),
        tx.hash_text(F.trim("u.loc")).alias("source_guid"), F.trim("u.loc").alias("link"),
        F.coalesce(tx.trim_space(part["news:title"]), F.lit("")).alias("title"),
        tx.trim_space(part["news:publication"]["news:language"]).alias("metadata_language"),
        parse_date(date).alias("published_at"), date.alias("date_text"),
    )


# An opening or closing outline element; a `>` inside quotes does not end it
OUTLINE = r"(<outline(?:[\s/][^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*){0,200})?>|</outline\s*>)"
# The named entities of XML, the ampersand last
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, without entities; null if it is not there or blank."""
    found = F.regexp_extract(tag, rf"\s{name}\s*=\s*(\"[^\"]*\"|'[^']*')", 1)
    value = tx.decode_numeric_entities(F.substring(found, F.lit(2), F.length(found) - 2))
    for entity, character in ENTITIES:
        value = F.replace(value, F.lit(entity), F.lit(character))
    return _text(value)


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Feeds of the outline tags of documents, whose tags come in order, number 0 first. Only the names of the open elements go from tag to tag."""
    above: list[str] = []
    at = 0
    for batch in batches:
        rows, feeds = [], []
        for row, (n, closes, empty, url, title, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
            if n == 0:
                above, at = [], 0
            if closes:
                del above[-1:]
                continue
            if url is not None:
                rows.append(row)
                feeds.append((at, url, text if title is None else title, "/".join(name for name in above if name)))
                at += 1
            if not empty:
                above.append((text or title or "") if url is None else "")
        if feeds:
            pos, *texts = zip(*feeds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int32())), pa.array(pos, pa.int64()), *[pa.array(t, pa.string()) for t in texts]],
                names=["document", "pos", "source_url", "title", "folder"])


def ingest_outline(documents: DataFrame) -> DataFrame:
    """(document, pos, source_url, title, folder): the feeds of outline documents (document, xml) of any depth, in order.

    The folder is the path of the elements around a feed that are no feeds themselves. Comments are left out; elements that are not closed stay
    open to the end, and closing ones too many count for nothing. A document's tags become rows in the task that holds it and are folded
    there in one pass, in batches, so the time grows with the number of tags."""
    tags = F.regexp_extract_all(F.regexp_replace("xml", r"(?s)<!--.*?-->", ""), F.lit(OUTLINE), F.lit(1))
    rows = documents.select("document", F.posexplode(tags).alias("n", "t"))
    tag = F.col("t")
    read = rows.select(
        "document", "n", F.startswith(tag, F.lit("</")).alias("closes"), F.endswith(tag, F.lit("/>")).alias("empty"),
        _attribute(tag, "xmlUrl").alias("url"), _attribute(tag, "title").alias("title"), _attribute(tag, "text").alias("text"),
    )
    schema = StructType([*documents.select("document").schema, *StructType.fromDDL("pos bigint, source_url string, title string, folder string")])
    return read.mapInArrow(_outlined, schema).withColumn("folder", ul.normalize_folder(F.col("folder")))
