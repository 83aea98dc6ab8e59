"""Assemble threads of posts and write them as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.operators.lists import top_per_group

MAX_POSTS = 250  # a thread keeps this many posts, by rule


def thread_assembly(posts: DataFrame, roots: DataFrame, cap: int = MAX_POSTS) -> DataFrame:
    """Posts of each root's thread: same conversation and author, first seen once, at most `cap`, by time.

    Posts are cut to the cap per (conversation, author) before they meet the roots, so a conversation of any size
    sends at most `cap` rows per author into the join. The root counts first in the cap, whatever its place."""
    seen = posts.groupBy("conversation_id", "author", "post_id").agg(
        F.min("seen_no").alias("seen_no"), F.min_by("created_at", "seen_no").alias("created_at")
    )
    root = roots.select("conversation_id", "post_id").join(seen, ["conversation_id", "post_id"]).select(
        "conversation_id", "author", F.col("post_id").alias("root_id"), F.col("seen_no").alias("root_no"),
        F.col("created_at").alias("root_at"),
    )
    capped = top_per_group(seen, ["conversation_id", "author"], [F.col("seen_no").asc()], cap, "_n").drop("_n")
    others = capped.join(root, ["conversation_id", "author"]).filter(F.col("post_id") != F.col("root_id"))
    columns = ["root_id", "conversation_id", "author", "post_id", "created_at", "seen_no"]
    firsts = root.select("root_id", "conversation_id", "author", F.col("root_id").alias("post_id"),
                         F.col("root_at").alias("created_at"), F.col("root_no").alias("seen_no"))
    thread = firsts.withColumn("is_root", F.lit(True)).unionByName(
        others.select(*columns).withColumn("is_root", F.lit(False))
    )
    kept = top_per_group(thread, ["root_id"], [F.col("is_root").desc(), F.col("seen_no").asc()], cap, "_kept")
    order = [F.col("created_at").asc_nulls_first(), F.col("is_root").desc(), F.col("seen_no").asc()]
    # At most `cap` rows per root are left.
    placed = top_per_group(kept.drop("_kept"), ["root_id"], order, cap, "position")
    return placed.select("root_id", "conversation_id", "author", "post_id", "created_at", "position")


def thread_latest(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """Newest post that continues a thread: by the root's author, in the conversation, and answering that author, the
    conversation's first post, or nobody. The first of equally new posts wins."""
    root = posts.join(roots.select("conversation_id", F.col("post_id").alias("root_id")), "conversation_id").filter(
        F.col("post_id") == F.col("root_id")
    ).select("conversation_id", "root_id", F.col("author").alias("root_author"))
    same = (F.col("author") == F.col("root_author")) & (
        (F.col("post_id") == F.col("root_id")) | F.col("reply_to_author").isNull()
        | (F.col("reply_to_author") == F.col("root_author"))
        | F.coalesce(F.col("reply_to_post") == F.col("conversation_root"), F.lit(False))
    )
    thread = posts.join(root, "conversation_id").filter(same)
    newest = F.struct(F.col("created_at"), (-F.col("post_id")).alias("first"))
    return thread.groupBy("root_id").agg(
        F.max_by("post_id", newest).alias("latest_id"), F.max("created_at").alias("latest_at")
    )


def author_text(name: Column, username: Column) -> Column:
    name, username = tx.blank_to_null(name), tx.blank_to_null(username)
    both = F.concat(name, F.lit(" (@"), username, F.lit(")"))
    return F.coalesce(both, F.concat(F.lit("@"), username), name)


def post_url(username: Column, post_id: Column) -> Column:
    owner = F.coalesce(F.concat(tx.blank_to_null(username), F.lit("/status/")), F.lit("i/web/status/"))
    return F.concat(F.lit("https://x.com/"), owner, post_id.cast("string"))


def quote_lines(author: Column, url: Column, text: Column) -> Column:
    """Quoted post as block quote."""
    body = F.coalesce(tx.blank_to_null(tx.trim_space(text)), F.lit("(no content)"))
    lines = F.concat(
        F.array(F.concat(F.lit("Author: "), F.coalesce(author, F.lit("Unknown"))),
                F.concat(F.lit("URL: "), F.coalesce(url, F.lit("unavailable"))), F.lit("")),
        F.split(body, r"\r?\n"),
    )
    return F.array_join(F.transform(lines, lambda line: F.rtrim(F.concat(F.lit("> "), line))), "\n")


def thread_markdown(posts: DataFrame, heading: Column, username: Column, source_url: Column | None = None) -> DataFrame:
    """One text per thread of assembled posts (at most the cap of rows each).

    `posts`: root_id, position, post_id, text, and optionally quote (see `quote_lines`) and media (lines)."""
    extra = [F.col(c) for c in ("quote", "media") if c in posts.columns]
    parts = [tx.blank_to_null(tx.trim_space(c)) for c in [F.col("text"), *extra]]
    body = F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull()), "\n\n")
    shown = posts.select(
        "root_id", "position", heading.alias("_heading"), post_url(username, F.col("post_id")).alias("_url"),
        F.coalesce(tx.blank_to_null(body), F.lit("_No text or media._")).alias("_body"),
        (source_url if source_url is not None else post_url(username, F.col("root_id"))).alias("_source"),
    )
    threads = shown.groupBy("root_id").agg(
        F.min("_heading").alias("_heading"), F.min("_source").alias("_source"), F.count(F.lit(1)).alias("posts"),
        F.array_sort(F.collect_list(F.struct("position", "_url", "_body"))).alias("_posts"),
    )
    several = F.size("_posts") > 1
    blocks = F.transform(
        "_posts",
        lambda p, i: F.concat(
            F.when(several, F.concat(F.lit("## "), (i + 1).cast("string"), F.lit("\n"))).otherwise(F.lit("")),
            p["_url"], F.lit("\n\n"), p["_body"],
        ),
    )
    head = F.concat(
        F.lit("# "), F.col("_heading"), F.lit("\nSource: "), F.col("_source"), F.lit("\nTweets: "),
        F.col("posts").cast("string"),
    )
    return threads.select("root_id", "posts", F.concat_ws("\n\n", head, F.array_join(blocks, "\n\n")).alias("markdown"))
