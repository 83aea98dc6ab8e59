"""Reconcile incoming items with stored entries, and write keyed upserts as new snapshots.

Plain Parquet has no MERGE, so an upsert is one full outer join on the key, written as a new snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.functions import urls as ul
from feedloom.functions.values import base_provider
from feedloom.operators.lists import top_per_group
from feedloom.session import cut

KEY = ["feed_name", "source_guid"]
VERSION_COLUMNS = (
    "source_url", "source_title", "source_author", "source_published_at", "source_content_html",
    "extracted_content_html", "translated_title", "translated_content_html", "content_updated_at", "updated_at",
)


def same_text(a: str, b: str) -> Column:
    """Equal, with NULL and empty alike."""
    return F.coalesce(F.col(a), F.lit("")) == F.coalesce(F.col(b), F.lit(""))


def last_per_key(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ("refreshed_at", "last_refreshed_at", "id")) -> DataFrame:
    """One row per key, the last by those of the `order` columns that exist; ties go by the row itself.

    A NULL key equals no other key, so its rows stay as they are."""
    values = [c for c in rows.columns if c not in keys]
    by = F.struct(*[F.col(c) for c in order if c in rows.columns], F.xxhash64(*rows.columns).alias("_tie"))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    folded = rows.filter(whole).groupBy(*keys).agg(F.max_by(F.struct(*values), by).alias("_r"))
    last = folded.select(*[F.col(c) if c in keys else F.col(f"_r.{c}") for c in rows.columns])
    return last.unionByName(rows.filter(~whole))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], keep: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """Stored rows with incoming rows laid over them. `keep` columns stay as stored, `fill` columns take the incoming
    value only where it is not NULL, all others are replaced. Columns the incoming side lacks stay as stored. Of several
    incoming rows of one key the last one counts."""
    incoming = last_per_key(incoming, keys)
    new = incoming.select(*[F.col(c).alias(f"_new_{c}") for c in incoming.columns], F.lit(True).alias("_hit"))
    old = stored.withColumn("_had", F.lit(True))
    on = [F.col(k) == F.col(f"_new_{k}") for k in keys]
    joined = old.join(new, on, "full_outer")

    def merged(column: str) -> Column:
        if column not in incoming.columns:
            return F.col(column)
        was, now = F.col(column), F.col(f"_new_{column}")
        if column in keep or column in fill:
            first, second = (was, now) if column in keep else (now, was)
            return F.coalesce(first, second)
        return F.when(F.col("_hit"), now).otherwise(was)

    return joined.select(*[merged(c).alias(c) for c in stored.columns])


def upsert_entries(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(stored, incoming, KEY, keep=["id", "created_at"])


def upsert_feeds(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(
        stored, incoming, ["feed_name"], keep=["created_at"],
        fill=["title", "last_refreshed_at", "last_refresh_status", "last_refresh_error"],
    )


def touch_entries(stored: DataFrame, touched: DataFrame) -> DataFrame:
    """Refresh metadata of unchanged rows: status, error and time replaced, fetch time only when given. Of several
    rows of one key the last one counts."""
    new = last_per_key(touched, KEY).select(
        *KEY, F.col("refresh_status").alias("_status"), F.col("refresh_error").alias("_error"),
        F.col("refreshed_at").alias("_at"), F.col("source_fetched_at").alias("_fetched"), F.lit(True).alias("_hit"),
    )
    joined = stored.join(new, KEY, "left")
    return joined.withColumns({
        "refresh_status": F.when(F.col("_hit"), F.col("_status")).otherwise(F.col("refresh_status")),
        "refresh_error": F.when(F.col("_hit"), F.col("_error")).otherwise(F.col("refresh_error")),
        "refreshed_at": F.when(F.col("_hit"), F.col("_at")).otherwise(F.col("refreshed_at")),
        "source_fetched_at": F.coalesce(F.col("_fetched"), F.col("source_fetched_at")),
    }).select(*stored.columns)


def body_of(prefix: str = "") -> Column:
    return F.coalesce(
        tx.first_filled(F.col(f"{prefix}extracted_content_html"), F.col(f"{prefix}source_content_html")), F.lit("")
    )


def matched(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming items with the stored entry of the same key beside them.

    Bodies are hashed on each side, so 64 characters instead of whole bodies go through the join."""
    old = stored.select(
        *KEY, F.lit(True).alias("stored"), F.col("source_title").alias("old_title"),
        F.col("source_author").alias("old_author"), F.col("source_url").alias("old_url"),
        F.col("source_published_at").alias("old_published_at"),
        tx.hash_text(F.coalesce("source_content_html", F.lit(""))).alias("old_source_hash"),
        tx.hash_text(body_of()).alias("old_body_hash"), (body_of() != "").alias("old_has_body"),
        tx.hash_text(tx.blank_to_null(F.col("extracted_content_html"))).alias("old_extracted_hash"),
        F.col("translated_title").alias("old_translated_title"),
        (F.coalesce("translated_content_html", F.lit("")) != "").alias("old_translated"),
        F.col("translation_provider").alias("old_provider"), F.col("refresh_status").alias("old_status"),
        F.coalesce("source_fetched_at", "refreshed_at").alias("old_fetched_at"), F.col("translation_retry_after"),
        F.col("created_at").alias("old_created_at"),
    )
    new = incoming.withColumns({
        "source_hash": tx.hash_text(F.coalesce("source_content_html", F.lit(""))),
        "body_hash": tx.hash_text(tx.first_filled(F.col("page_html"), F.col("source_content_html"))),
    }).drop("page_html", "source_content_html")
    if "provider" not in new.columns:
        new = new.withColumn("provider", F.lit("rss"))
    return new.join(old, KEY, "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def with_reuse(pairs: DataFrame, recheck_hours: int = 24) -> DataFrame:
    """Keep the stored body when it was fetched without error, recently, for the same title and source body."""
    recent = F.col("refreshed_at") < F.col("old_fetched_at") + F.make_dt_interval(hours=F.lit(recheck_hours))
    title_kept = (F.coalesce("source_title", F.lit("")) == "") | same_text("source_title", "old_title")
    reuse = (
        F.col("stored") & (F.coalesce("old_status", F.lit("")) != "error") & recent & title_kept
        & (F.col("source_hash") == F.col("old_source_hash")) & F.col("old_has_body")
    )
    return pairs.withColumn("reuse_body", F.coalesce(reuse, F.lit(False)))


def with_plan(pairs: DataFrame, feeds: DataFrame) -> DataFrame:
    """content_changed, and per item what becomes of its translation: reuse | backoff | translate | skip."""
    body = F.when(F.col("reuse_body"), F.col("old_body_hash")).otherwise(F.col("body_hash"))
    changed = F.col("stored") & (~same_text("source_title", "old_title") | ~F.col("old_body_hash").eqNullSafe(body))
    enabled = feeds.select("feed_name", F.col("translate_enabled").alias("_on"))
    rows = pairs.join(enabled, "feed_name", "left").withColumns({"new_body_hash": body, "content_changed": changed})
    on, retry = F.coalesce("_on", F.lit(False)), F.col("translation_retry_after")
    expired = F.coalesce(retry <= F.col("refreshed_at"), F.lit(False))
    waiting = on & ~F.col("content_changed") & F.coalesce(retry > F.col("refreshed_at"), F.lit(False))
    reuse = on & F.coalesce("old_translated", F.lit(False)) & ~expired & ~F.col("content_changed")
    plan = (
        F.when(reuse, F.lit("reuse")).when(waiting, F.lit("backoff")).when(on, F.lit("translate")).otherwise(F.lit("skip"))
    )
    return rows.withColumn("plan", plan).drop("_on")


def with_changes(planned: DataFrame) -> DataFrame:
    """display_changed, metadata_unchanged and the action they lead to.

    What is shown before any new translation arrives: the stored translation when it is reused, else the plain item.
    """
    reuse, title = F.col("plan") == "reuse", F.coalesce("source_title", F.lit(""))
    shown_before = F.coalesce(tx.blank_to_null(F.col("old_translated_title")), F.col("old_title"), F.lit(""))
    shown_now = F.when(reuse, F.coalesce(tx.blank_to_null(F.col("old_translated_title")), title)).otherwise(title)
    body_same = reuse | (~F.col("old_translated") & F.col("old_body_hash").eqNullSafe(F.col("new_body_hash")))
    display_changed = ~F.col("stored") | (shown_before != shown_now) | ~F.coalesce(body_same, F.lit(False))

    plain_provider = F.when(F.col("reuse_body"), base_provider(F.col("old_provider"))).otherwise(F.col("provider"))
    provider = F.when(reuse, F.coalesce(tx.blank_to_null(F.col("old_provider")), plain_provider)).otherwise(plain_provider)
    extracted = F.when(F.col("new_body_hash") != F.col("source_hash"), F.col("new_body_hash"))
    metadata_unchanged = (
        F.col("stored") & (F.col("source_url") == F.col("old_url")) & same_text("source_author", "old_author")
        & F.col("source_published_at").eqNullSafe(F.col("old_published_at"))
        & (F.col("source_hash") == F.col("old_source_hash"))
        & F.col("old_extracted_hash").eqNullSafe(extracted)
        & (F.coalesce("old_provider", F.lit("")) == provider)
    )
    action = (
        F.when(~F.col("stored"), F.lit("insert"))
        .when(~F.col("display_changed") & F.col("metadata_unchanged"), F.lit("touch"))
        .otherwise(F.lit("update"))
    )
    return planned.withColumns({
        "display_changed": display_changed, "metadata_unchanged": F.coalesce(metadata_unchanged, F.lit(False)),
        "translation_provider": provider,
    }).withColumn("action", action)


def reconcile_items(incoming: DataFrame, stored: DataFrame, feeds: DataFrame, recheck_hours: int = 24) -> DataFrame:
    return with_changes(with_plan(with_reuse(matched(incoming, stored), recheck_hours), feeds))


def saved_item_reconcile(imported: DataFrame, stored: DataFrame, now: str) -> DataFrame:
    """Saved pages against stored ones: the translation survives only unchanged title and body."""
    pairs = matched(imported, stored)
    unchanged = F.col("stored") & same_text("source_title", "old_title") & (F.col("body_hash") == F.col("old_body_hash"))
    kept = F.col("unchanged") & F.coalesce("old_translated", F.lit(False))
    return pairs.withColumn("unchanged", unchanged).withColumns({
        "translation_kept": kept,
        "translated_title": F.when(kept, F.col("old_translated_title")),
        "translation_provider": F.when(kept, F.coalesce(F.col("old_provider"), F.col("provider")))
        .when(F.col("translation_error").isNull(), F.concat(F.col("provider"), F.lit("+new")))
        .otherwise(F.col("provider")),
        "refresh_status": F.when(~kept & F.col("translation_error").isNotNull(), F.lit("partial")).otherwise(F.lit("ok")),
        "source_published_at": F.coalesce("source_published_at", "old_published_at", F.lit(now).cast("timestamp_ntz")),
        "created_at": F.coalesce("old_created_at", F.lit(now).cast("timestamp_ntz")),
    })


def version_check(expected: DataFrame, current: DataFrame, columns: tuple[str, ...] = VERSION_COLUMNS) -> DataFrame:
    """same | superseded per expected row, comparing id and every version column, NULL equal to NULL.

    A column that only one side has is an error: its rows could not be told apart."""
    use = [c for c in columns if c in expected.columns or c in current.columns]
    absent = [c for c in use if c not in expected.columns or c not in current.columns]
    if absent:
        raise ValueError(f"version columns on one side only: {absent}")
    probe = lambda df, name: df.select("id", tx.hash_text(F.to_json(F.struct(*use), {"ignoreNullFields": "false"})).alias(name))
    both = probe(expected, "_want").join(probe(current, "_have"), "id", "left")
    verdict = F.when(F.col("_want").eqNullSafe(F.col("_have")), F.lit("same")).otherwise(F.lit("superseded"))
    return both.select("id", verdict.alias("verdict"))


def import_feeds(outline: DataFrame, stored: DataFrame, folder_override: str = "") -> DataFrame:
    """One row per distinct usable URL of an outline: created or updated, its folder and title, and the rows it had."""
    override = ul.normalize_folder(F.lit(folder_override))
    named = F.col("name") if "name" in outline.columns else F.lit(None).cast("string")
    rows = outline.withColumns({
        "wanted_name": tx.blank_to_null(tx.trim_space(named)),
        "source_url": ul.http_url(F.col("source_url")),
        "title": tx.blank_to_null(tx.trim_space(F.col("title"))),
        "folder": F.coalesce(tx.blank_to_null(override), ul.normalize_folder(F.col("folder"))),
    }).filter(F.col("source_url").isNotNull())
    per_url = rows.groupBy("source_url").agg(
        F.count(F.lit(1)).alias("rows"),
        F.max_by("folder", "pos").alias("folder"),
        F.min_by("title", F.when(F.col("title").isNotNull(), F.col("pos"))).alias("new_title"),
        F.min_by("wanted_name", F.when(F.col("wanted_name").isNotNull(), F.col("pos"))).alias("wanted_name"),
    )
    stored = stored.withColumn("source_url", F.coalesce(ul.http_url(F.col("source_url")), F.col("source_url")))
    old = stored.groupBy("source_url").agg(F.min("feed_name").alias("feed_name"), F.min_by("title", "feed_name").alias("old_title"))
    joined = per_url.join(old, "source_url", "left")
    fillable = tx.blank_to_null(F.col("old_title")).isNull() | (F.col("old_title") == F.col("feed_name"))
    known = joined.filter(F.col("feed_name").isNotNull()).withColumn("action", F.lit("updated"))
    fresh = joined.filter(F.col("feed_name").isNull())
    explicit = F.nullif(F.regexp_replace(F.regexp_replace(F.lower("wanted_name"), "[^a-z0-9]+", "-"), "^-+|-+$", ""), F.lit(""))
    wanted = fresh.select(F.coalesce(F.substring(explicit, 1, 64), ul.feed_name_from_url(F.col("source_url"))).alias("feed_name"), "source_url")
    names = resolve_feed_name(wanted, stored.select("feed_name", "source_url")).select("source_url", F.col("resolved_name").alias("feed_name"))
    created = fresh.drop("feed_name").join(names, "source_url").withColumn("action", F.lit("created"))
    return known.unionByName(created).select(
        "source_url", "feed_name", "folder",
        F.when(fillable, F.coalesce("new_title", "old_title")).otherwise(F.col("old_title")).alias("title"),
        "action", "rows",
    )


def import_summary(imported: DataFrame) -> DataFrame:
    """Every usable outline row counts; the first row of a new URL creates it, later ones update it."""
    created = F.count_if(F.col("action") == "created")
    total = F.coalesce(F.sum("rows"), F.lit(0))
    return imported.agg(
        total.cast("bigint").alias("total"), created.alias("created"), (total - created).cast("bigint").alias("updated")
    )


def resolve_feed_name(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """A free feed name per (feed_name, source_url): the name itself, else the name with 8, 12 or 16 hex digits of the
    URL's hash. A name that is taken by the same URL counts as free. Of several wanted rows that are offered the same
    name the first URL gets it, and the others are offered the next one. Who finds all names taken keeps a row with a
    NULL name."""
    used = taken.select(F.col("feed_name").alias("candidate"), F.col("source_url").alias("taken_by"))
    left = wanted.select("feed_name", "source_url").distinct()
    done = None
    for size in (0, 8, 12, 16):
        digits = F.substring(tx.hash_text(F.col("source_url")), 1, size)
        candidate = F.concat(F.substring("feed_name", 1, 63 - size), F.lit("-"), digits) if size else F.col("feed_name")
        offered = left.withColumn("candidate", candidate).join(used, "candidate", "left")
        free = offered.filter(F.col("taken_by").isNull() | (F.col("taken_by") == F.col("source_url")))
        owner = F.min(F.struct(F.col("taken_by").isNull().alias("new"), "source_url", "feed_name")).alias("w")
        won = cut(free.groupBy("candidate").agg(owner).select(
            F.col("w.feed_name").alias("feed_name"), F.col("w.source_url").alias("source_url"), F.col("candidate").alias("resolved_name")))
        done = won if done is None else done.unionByName(won)
        left = cut(left.join(won, ["feed_name", "source_url"], "left_anti"))
        if left.isEmpty():
            break
        used = used.unionByName(won.select(F.col("resolved_name").alias("candidate"), F.col("source_url").alias("taken_by")))
    return done.unionByName(left.withColumn("resolved_name", F.lit(None).cast("string")))


def feed_metadata_changed(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    new = incoming.select(
        "feed_name", F.col("source_url").alias("_url"), F.col("title").alias("_title"),
        F.col("translate_enabled").alias("_flag"),
    )
    blank = tx.blank_to_null
    changed = (
        (F.col("source_url") != F.col("_url"))
        | ~blank(F.col("title")).eqNullSafe(blank(F.col("_title")))
        | (F.coalesce("translate_enabled", F.lit(False)) != F.coalesce("_flag", F.lit(False)))
    )
    return stored.join(new, "feed_name").select(
        "feed_name", changed.alias("changed"), changed.cast("bigint").alias("revision_step")
    )


def orphans(children: DataFrame, parents: DataFrame, on: str) -> DataFrame:
    return children.join(parents.select(on), on, "left_anti")


def cascade(children: DataFrame, deleted_parents: DataFrame, on: str) -> DataFrame:
    """Rows that go when their parents are deleted."""
    return children.join(deleted_parents.select(on), on, "left_semi")


def delete_entries(entries: DataFrame, deleted: DataFrame) -> DataFrame:
    return entries.join(deleted.select("feed_name", "id"), ["feed_name", "id"], "left_anti")


def deleted_revisions(entries: DataFrame, deleted: DataFrame) -> DataFrame:
    """How far each feed's revision moves: one step per entry that really existed."""
    gone = entries.join(deleted.select("feed_name", "id").distinct(), ["feed_name", "id"], "left_semi")
    return gone.groupBy("feed_name").agg(F.count(F.lit(1)).alias("revision_step"))


def content_revision(reconciled: DataFrame) -> DataFrame:
    """Per feed: number of display changes and the time of the last one."""
    return reconciled.filter("display_changed").groupBy("feed_name").agg(
        F.count(F.lit(1)).alias("content_revision"), F.max("refreshed_at").alias("content_updated_at")
    )


def refresh_rollup(results: DataFrame) -> DataFrame:
    """Per feed run: partial when any item failed, with its first three errors."""
    failed = results.filter(F.col("status") == "error").withColumn("message", F.concat_ws(": ", "title", "error"))
    first = top_per_group(failed.select("feed_name", "pos", "message"), ["feed_name"], [F.col("pos")], 3)
    messages = first.groupBy("feed_name").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "message"))), lambda m: m["message"]), " | "
        ).alias("error")
    )
    counts = results.groupBy("feed_name").agg(
        F.count(F.lit(1)).alias("item_count"), F.count_if(F.col("status") == "error").alias("error_count")
    )
    return counts.join(messages, "feed_name", "left").select(
        "feed_name", F.when(F.col("error_count") > 0, F.lit("partial")).otherwise(F.lit("ok")).alias("status"),
        F.coalesce("error", F.lit("")).alias("error"), "item_count",
    )


def refresh_all_summary(rollup: DataFrame, feeds: DataFrame, failures: DataFrame) -> DataFrame:
    """One row per refreshed feed: its roll-up, or the error that stopped it."""
    stopped = failures.select("feed_name", F.col("error").alias("fatal"))
    rows = without_managed_names(feeds).join(rollup, "feed_name", "left").join(stopped, "feed_name", "left")
    ok = F.col("fatal").isNull()
    return rows.select(
        "feed_name", ok.alias("ok"), F.when(ok, F.coalesce("status", F.lit("ok"))).alias("status"),
        F.when(ok, F.coalesce("error", F.lit(""))).otherwise(F.col("fatal")).alias("error"),
        F.when(ok, F.coalesce("item_count", F.lit(0))).alias("item_count"),
    )


def without_managed_names(feeds: DataFrame) -> DataFrame:
    return feeds.filter(~ul.is_managed(F.col("source_url"))).select("feed_name")


def retry_batch_status(results: DataFrame) -> DataFrame:
    """Feed status after a batch of retries: the first failure, else ok when any succeeded, else no row."""
    failed = F.col("status") == "error"
    summed = results.groupBy("feed_name").agg(
        F.min_by("error", F.when(failed, F.col("pos"))).alias("first_error"),
        F.bool_or(failed).alias("any_failed"), F.bool_or(F.col("status") == "ok").alias("any_ok"),
    )
    return summed.filter("any_failed OR any_ok").select(
        "feed_name", F.when(F.col("any_failed"), F.lit("partial")).otherwise(F.lit("ok")).alias("status"),
        F.when(F.col("any_failed"), F.col("first_error")).otherwise(F.lit("")).alias("error"),
    )
