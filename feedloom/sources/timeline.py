"""Timeline pages (JSON) to post rows and cursor rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POST = (
    "rest_id: STRING, legacy: STRUCT<id_str: STRING, conversation_id_str: STRING, user_id_str: STRING, "
    "in_reply_to_user_id_str: STRING, in_reply_to_status_id_str: STRING, created_at: STRING, full_text: STRING>, "
    "core: STRUCT<user_results: STRUCT<result: STRUCT<legacy: STRUCT<name: STRING, screen_name: STRING>>>>"
)
ITEM = (
    "STRUCT<itemType: STRING, cursorType: STRING, value: STRING, tweet_results: STRUCT<result: "
    f"STRUCT<__typename: STRING, {POST}, tweet: STRUCT<{POST}>>>>"
)
MODULE = f"ARRAY<STRUCT<item: STRUCT<itemContent: {ITEM}>, itemContent: {ITEM}>>"
INSTRUCTIONS = (
    f"STRUCT<instructions: ARRAY<STRUCT<type: STRING, moduleItems: {MODULE}, entries: ARRAY<STRUCT<content: STRUCT<"
    f"clientEventInfo: STRUCT<component: STRING>, itemContent: {ITEM}, items: {MODULE}, cursorType: STRING, "
    "entryType: STRING, value: STRING>>>>>>"
)
PAGE = (
    f"data STRUCT<threaded_conversation_with_injections_v2: {INSTRUCTIONS}, "
    f"threaded_conversation_with_injections: {INSTRUCTIONS}>"
)
# Instruction types that carry items, and the sidebar component that is skipped.
ITEM_TYPES = ("TimelineAddEntries", "TimelineAddToModule")
SIDEBAR = "you_might_also_like"
CURSOR_KINDS = {"Top": "top", "Bottom": "bottom", "ShowMore": "more", "ShowMoreThreads": "more"}


def _module_items(items: Column) -> Column:
    nested = F.transform(items, lambda i: F.coalesce(i["item"]["itemContent"], i["itemContent"]))
    return F.coalesce(F.filter(nested, lambda i: i.isNotNull()), F.array().cast(f"ARRAY<{ITEM}>"))


def _entry_items(entry: Column) -> Column:
    """An entry's own cursor, its content, then the items of its module."""
    content = entry["content"]
    cursor = F.struct(
        content["entryType"].alias("itemType"), content["cursorType"].alias("cursorType"), content["value"].alias("value"),
        F.lit(None).cast(ITEM)["tweet_results"].alias("tweet_results"),
    )
    own = F.filter(F.array(cursor, content["itemContent"]), lambda i: i.isNotNull())
    return F.concat(own, _module_items(content["items"]))


def timeline_items(pages: DataFrame, key: str, raw: str) -> DataFrame:
    """All items of each page in page order. The newer instruction list wins when it has any usable instruction."""
    read = pages.select(key, F.from_json(F.col(raw), PAGE).alias("p"))

    def usable(name: str) -> Column:
        return F.filter(F.col(f"p.data.{name}.instructions"), lambda i: i["type"].isin(*ITEM_TYPES))

    newer, older = usable("threaded_conversation_with_injections_v2"), usable("threaded_conversation_with_injections")
    chosen = read.select(key, F.when(F.size(newer) > 0, newer).otherwise(older).alias("_i"))
    no_items = F.array().cast(f"ARRAY<{ITEM}>")
    items = F.flatten(F.transform("_i", lambda i: F.concat(
        _module_items(i["moduleItems"]),
        F.coalesce(F.flatten(F.transform(
            F.filter(i["entries"], lambda e: ~F.coalesce(e["content"]["clientEventInfo"]["component"] == SIDEBAR, F.lit(False))),
            lambda e: _entry_items(e),
        )), no_items),
    )))
    return chosen.select(key, F.posexplode(items).alias("pos", "item"))


def ingest_posts(items: DataFrame, key: str) -> DataFrame:
    result = F.col("item.tweet_results.result")
    kind = F.col("item.itemType")
    found = items.filter(result.isNotNull() & ~F.coalesce(kind == "TimelineTimelineCursor", F.lit(False)))
    plain = F.struct(*[result[f].alias(f) for f in ("rest_id", "legacy", "core")])
    posts = found.select(key, "pos", F.coalesce(result["tweet"], plain).alias("t"))
    legacy, user = F.col("t.legacy"), F.col("t.core.user_results.result.legacy")
    return posts.select(
        key, F.col("pos").cast("bigint").alias("pos"), F.coalesce(legacy["id_str"], F.col("t.rest_id")).alias("post_id"),
        legacy["conversation_id_str"].alias("conversation_id"), legacy["user_id_str"].alias("author"),
        legacy["in_reply_to_user_id_str"].alias("reply_to_author"), legacy["in_reply_to_status_id_str"].alias("reply_to_post"),
        legacy["created_at"].alias("created_text"), legacy["full_text"].alias("text"), user["name"].alias("name"),
        user["screen_name"].alias("username"),
    )


def ingest_cursors(items: DataFrame, key: str) -> DataFrame:
    """Distinct cursors per page and kind, with their first place."""
    kinds = F.create_map(*[F.lit(x) for pair in CURSOR_KINDS.items() for x in pair])
    found = items.filter((F.col("item.itemType") == "TimelineTimelineCursor") & (F.col("item.value") != "")).select(
        key, "pos", F.try_element_at(kinds, F.col("item.cursorType")).alias("kind"), F.col("item.value").alias("cursor")
    )
    return found.filter("kind IS NOT NULL").groupBy(key, "kind", "cursor").agg(F.min("pos").cast("bigint").alias("pos"))
