"""Rich articles made of blocks, entities and media, written as text.

An article arrives as JSON rows. Its parts become tables (blocks, entities, media); lines are made by joins, and only
the last step gathers the lines of one article.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.operators.lists import top_per_group
from feedloom.operators.ordered import previous, running
from feedloom.operators.threads import author_text

MEDIA_INFO = (
    "STRUCT<original_img_url: STRING, preview_image: STRUCT<original_img_url: STRING>, "
    "variants: ARRAY<STRUCT<content_type: STRING, bit_rate: BIGINT, url: STRING>>>"
)
ENTITY = (
    "STRUCT<key: STRING, value: STRUCT<type: STRING, data: STRUCT<url: STRING, caption: STRING, tweetId: STRING, "
    "markdown: STRING, mediaItems: ARRAY<STRUCT<mediaId: STRING, media_id: STRING>>>>>"
)
ARTICLE = (
    f"title STRING, plain_text STRING, preview_text STRING, cover_media STRUCT<media_info: {MEDIA_INFO}>, "
    f"media_entities ARRAY<STRUCT<media_id: STRING, media_info: {MEDIA_INFO}>>, "
    "content_state STRUCT<blocks: ARRAY<STRUCT<type: STRING, text: STRING, entityRanges: ARRAY<STRUCT<key: INT, "
    f"`offset`: INT, length: INT>>>>, entityMap: MAP<STRING, {ENTITY}>>"
)


def read_articles(rows: DataFrame, key: str, raw: str) -> DataFrame:
    return rows.select(key, F.from_json(F.col(raw), ARTICLE).alias("article"))


def entity_array(article: str = "article") -> Column:
    """Entities of an article: place in the map, logical key, type and data."""
    return F.transform(
        F.map_entries(f"{article}.content_state.entityMap"),
        lambda e, i: F.struct(
            i.alias("pos"), e["key"].try_cast("int").alias("map_index"), e["value"]["key"].try_cast("int").alias("logical_key"),
            e["value"]["value"]["type"].alias("type"), e["value"]["value"]["data"].alias("data"),
        ),
    )


def entities(articles: DataFrame, key: str) -> DataFrame:
    """One row per entity."""
    return articles.select(key, F.inline(entity_array()))


def referenced_enrichment(found: DataFrame, key: str, posts: DataFrame, cap: int | None = None) -> DataFrame:
    """First-seen distinct posts an article refers to, at most `cap` if given, with what is known of them.

    `posts`: post_id, name, username, text. A missing post keeps its plain address."""
    ids = found.filter(F.col("type") == "TWEET").select(key, F.col("data.tweetId").alias("post_id"), "pos")
    firsts = ids.filter(tx.blank_to_null(F.col("post_id")).isNotNull()).groupBy(key, "post_id").agg(F.min("pos").alias("pos"))
    # Without a cap the references of an article, which is one row, are numbered.
    rank = F.row_number().over(Window.partitionBy(key).orderBy("pos")).alias("rank")
    kept = firsts.select("*", rank) if cap is None else top_per_group(firsts, [key], [F.col("pos")], cap)
    known = kept.join(posts, "post_id", "left")
    owner = F.coalesce(F.concat(tx.blank_to_null(F.col("username")), F.lit("/status/")), F.lit("i/web/status/"))
    return known.select(
        key, "rank", "post_id", F.concat(F.lit("https://x.com/"), owner, "post_id").alias("url"),
        author_text(F.col("name"), F.col("username")).alias("author"), tx.summary_text(F.col("text")).alias("summary"),
    )


def best_variant(variants: Column) -> Column:
    """Address of the video variant with the highest bit rate, else of the first variant that has one."""
    videos = F.filter(variants, lambda v: F.coalesce(F.contains(v["content_type"], F.lit("video")), F.lit(False)))
    # Sorting (rate, -place) descending keeps the first of equal rates.
    ranked = F.transform(videos, lambda v, i: F.struct(F.coalesce(v["bit_rate"], F.lit(0)).alias("r"), (-i).alias("p"), v["url"].alias("u")))
    any_url = F.filter(variants, lambda v: v["url"].isNotNull())
    return F.coalesce(F.get(F.sort_array(ranked, asc=False), F.lit(0))["u"], F.get(any_url, F.lit(0))["url"])


def asset_array(article: str = "article") -> Column:
    """Media of an article in order: kind, address, poster; `repeated` marks an asset that stood before."""

    def asset(m: Column, i: Column) -> Column:
        info = m["media_info"]
        still, preview = info["original_img_url"], info["preview_image"]["original_img_url"]
        return F.struct(
            i.alias("pos"), m["media_id"].alias("media_id"), best_variant(info["variants"]).alias("video"),
            F.coalesce(preview, still).alias("poster"), F.coalesce(still, preview).alias("image"),
        )

    def shape(m: Column) -> Column:
        video = m["video"].isNotNull()
        return F.struct(
            m["pos"].alias("pos"), m["media_id"].alias("media_id"), F.when(video, "video").otherwise("image").alias("kind"),
            F.coalesce(m["video"], m["image"]).alias("url"), F.when(video, m["poster"]).alias("poster"),
        )

    shaped = F.filter(F.transform(F.transform(f"{article}.media_entities", asset), shape), lambda m: m["url"].isNotNull())
    # Bound once: each asset is compared with the ones before it.
    marked = F.transform(F.array(shaped), lambda all_of: F.transform(all_of, lambda m: m.withField(
        "repeated", F.exists(all_of, lambda o: (o["pos"] < m["pos"]) & (o["kind"] == m["kind"]) & (o["url"] == m["url"])
                             & o["poster"].eqNullSafe(m["poster"])))))
    return F.get(marked, F.lit(0))


def media_lookup(articles: DataFrame, key: str) -> DataFrame:
    return articles.select(key, F.inline(asset_array()))


def pair_links(media: Column, links: Column) -> Column:
    """Pair media with links by key: the first unused link with a greater key, else the first one left. `media` is a
    sorted array of (k, pos, map_index), `links` one of (k, pos, url). A choice depends on the ones before it."""

    def step(acc: Column, m: Column) -> Column:
        later = F.get(F.filter(acc["pool"], lambda link: link["k"] > m["k"]), F.lit(0))
        pick = F.coalesce(later, F.get(acc["pool"], F.lit(0)))
        pair = F.struct(m["map_index"].alias("map_index"), m["k"].alias("logical_key"), pick["url"].alias("url"))
        return F.struct(
            F.filter(acc["pool"], lambda link: ~pick["pos"].eqNullSafe(link["pos"])).alias("pool"),
            F.when(pick.isNull(), acc["pairs"]).otherwise(F.concat(acc["pairs"], F.array(pair))).alias("pairs"),
        )

    none = F.array().cast("array<struct<map_index:int,logical_key:int,url:string>>")
    return F.aggregate(media, F.struct(links.alias("pool"), none.alias("pairs")), step, lambda acc: acc["pairs"])


def is_media(kind: Column) -> Column:
    return F.coalesce(kind.isin("MEDIA", "IMAGE"), F.lit(False))


def paired(found: Column) -> Column:
    """Pairs of media and links among the entities of one article."""
    keyed = F.filter(found, lambda e: e["logical_key"].isNotNull())
    media = F.transform(F.filter(keyed, lambda e: is_media(e["type"])), lambda e: F.struct(
        e["logical_key"].alias("k"), e["pos"].alias("pos"), e["map_index"].alias("map_index")))
    links = F.transform(
        F.filter(keyed, lambda e: (e["type"] == "LINK") & e["data"]["url"].isNotNull()),
        lambda e: F.struct(e["logical_key"].alias("k"), e["pos"].alias("pos"), e["data"]["url"].alias("url")))
    return pair_links(F.array_sort(media), F.array_sort(links))


def media_link_pairing(articles: DataFrame, key: str, found: Column | None = None) -> DataFrame:
    return articles.select(key, F.inline(paired(entity_array() if found is None else found)))


def list_numbering(blocks: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """Number of each ordered-list item within its run; other blocks have none and end the run."""
    ordered = F.col(kind) == "ordered-list-item"
    out = running(blocks, [key], order, {"_n": ("sum", ordered.cast("bigint"))}, reset=~ordered)
    return out.withColumn("item_no", F.when(ordered, F.col("_n"))).drop("_n")


def code_run_grouping(blocks: DataFrame, key: str, order: list[str], kind: str) -> DataFrame:
    """Fences and blank lines: consecutive code blocks share a fence; a blank line parts blocks unless both belong to
    the same list, quote or media run."""
    code = F.col(kind) == "code-block"
    seen = previous(blocks, [key], order, {"_before": kind})
    before_code = F.coalesce(F.col("_before") == "code-block", F.lit(False))
    seen = seen.withColumns({
        "opens_fence": code & ~before_code,
        "closes_fence": ~code & before_code,
        "blank_before": F.col("_before").isNotNull() & ~(code & before_code) & ~(
            (F.col(kind) == F.col("_before")) & F.col(kind).isin("ordered-list-item", "unordered-list-item", "blockquote", "media")
        ),
    })
    runs = running(seen, [key], order, {"_fence": ("sum", F.col("opens_fence").cast("bigint"))})
    return runs.withColumn("fence_no", F.when(code, F.col("_fence"))).drop("_fence", "_before")


def inline_links(text: Column, links: Column) -> Column:
    """Put link marks into a block's text; `links` is an array of (offset, length, url), applied from the right."""
    ordered = F.sort_array(F.filter(links, lambda r: r["url"].isNotNull() & (r["length"] > 0)), asc=False)

    def mark(acc: Column, r: Column) -> Column:
        inside = F.substring(acc, r["offset"] + 1, r["length"])
        after = F.substring(acc, r["offset"] + r["length"] + 1, F.length(acc))
        return F.concat(F.substring(acc, F.lit(1), r["offset"]), F.lit("["), inside, F.lit("]("), r["url"], F.lit(")"), after)

    return F.aggregate(ordered, text, mark)


def _shown(url: Column, line: Column) -> Column:
    return F.struct(url.alias("url"), line.alias("line"))


def _plain(line: Column) -> Column:
    return _shown(F.lit(None).cast("string"), line)


def _media_parts(kind: Column, url: Column, poster: Column, alt: Column) -> Column:
    """Lines of one asset as (url, line): a video has its poster before it."""
    image = _shown(url, F.concat(F.lit("!["), alt, F.lit("]("), url, F.lit(")")))
    cover_alt = F.coalesce(tx.blank_to_null(alt), F.lit("video"))
    cover = _shown(poster, F.concat(F.lit("!["), cover_alt, F.lit("]("), poster, F.lit(")")))
    clip = _shown(url, F.concat(F.lit("[video]("), url, F.lit(")")))
    return F.when(kind == "video", F.filter(F.array(cover, clip), lambda p: p["url"].isNotNull())).otherwise(F.array(image))


def fallback_kind(url: Column) -> Column:
    video = F.rlike(url, F.lit(r"(?i)^https://video\.twimg\.com/|\.(?:mp4|m4v|mov|webm)(?:$|[?#])"))
    return F.when(video, F.lit("video")).otherwise(F.lit("image"))


HEADINGS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6}
LINES = "array<struct<url:string,line:string>>"
RUNS = ("list", "quote", "media", "code", "tail")  # kinds whose neighbours stay together


def _resolved_blocks() -> Column:
    """Blocks with the entity of each range: by logical key first, else by place in the map."""

    def entity(k: Column) -> Column:
        def first(field: str) -> Column:
            return F.get(F.filter("_entities", lambda e: e[field].eqNullSafe(k)), F.lit(0))

        return F.coalesce(first("logical_key"), first("map_index"))

    def block(b: Column) -> Column:
        ranges = F.coalesce(b["entityRanges"], F.array().cast("array<struct<key:int,offset:int,length:int>>"))
        return F.struct(
            F.coalesce(b["type"], F.lit("unstyled")).alias("type"), F.coalesce(b["text"], F.lit("")).alias("text"),
            F.transform(F.filter(ranges, lambda r: r["key"].isNotNull()), lambda r: F.struct(
                r["key"].alias("key"), r["offset"].alias("offset"), r["length"].alias("length"), entity(r["key"]).alias("e"),
            )).alias("ranges"),
        )

    return F.transform("article.content_state.blocks", lambda b: block(b))


def _linked_blocks() -> Column:
    """Blocks with links put into their text; media take the link they are paired with, the last pair of a key."""

    def url(r: Column) -> Column:
        pair = F.try_element_at(
            F.filter("_pairs", lambda p: p["map_index"].eqNullSafe(r["key"]) | p["logical_key"].eqNullSafe(r["key"])), F.lit(-1))
        return F.when(r["e"]["type"] == "LINK", r["e"]["data"]["url"]).when(is_media(r["e"]["type"]), pair["url"])

    def block(b: Column) -> Column:
        links = F.transform(b["ranges"], lambda r, i: F.struct(
            r["offset"].alias("offset"), i.alias("rpos"), r["length"].alias("length"), url(r).alias("url")))
        return b.withField("text", F.when(b["type"].isin("atomic", "code-block"), b["text"]).otherwise(inline_links(b["text"], links)))

    return F.transform("_blocks", lambda b: block(b))


def _item_numbers() -> Column:
    """Number of each block within its run of ordered-list items."""

    def step(acc: Column, b: Column) -> Column:
        n = F.when(b["type"] == "ordered-list-item", acc["n"] + 1).otherwise(0)
        return F.struct(F.concat(acc["all"], F.array(n)).alias("all"), n.alias("n"))

    zero = F.struct(F.array().cast("array<int>").alias("all"), F.lit(0).alias("n"))
    return F.aggregate("_blocks", zero, step, lambda acc: acc["all"])


def _block_pushes(b: Column, i: Column) -> Column:
    """What a block adds, as pushes (kind, lines)."""
    no_lines = F.array().cast(LINES)

    def push(kind: Column | str, lines: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), lines.cast(LINES).alias("lines"))

    def per_range(make) -> Column:
        return F.coalesce(F.flatten(F.transform(b["ranges"], make)), no_lines)

    def quote(r: Column) -> Column:
        post = F.coalesce(r["e"]["data"]["tweetId"], F.lit(""))
        known = F.try_element_at(F.col("_posts"), post)
        address = F.coalesce(known["url"], F.concat(F.lit("https://x.com/i/web/status/"), post))
        text = F.concat_ws(
            "\n", F.concat(F.lit("> 引用推文"), F.coalesce(F.concat(F.lit("："), known["author"]), F.lit(""))),
            F.concat(F.lit("> "), tx.blank_to_null(known["summary"])), F.concat(F.lit("> "), address))
        return F.when((r["e"]["type"] == "TWEET") & (post != ""), F.array(_plain(text))).otherwise(no_lines)

    def note(r: Column) -> Column:
        text = F.regexp_replace(F.replace(r["e"]["data"]["markdown"], F.lit("\r\n"), F.lit("\n")), r"\s+$", "")
        return F.when((r["e"]["type"] == "MARKDOWN") & (text != ""), F.array(_plain(text))).otherwise(no_lines)

    def link(r: Column) -> Column:
        url = r["e"]["data"]["url"]
        return F.when((r["e"]["type"] == "LINK") & (url != ""), F.array(_plain(url))).otherwise(no_lines)

    def media(r: Column) -> Column:
        data = r["e"]["data"]
        alt = F.regexp_replace(tx.collapse_space(F.coalesce(data["caption"], F.lit(""))), r"([\[\]])", r"\\$1")

        def lines(alt: Column) -> Column:
            def of_item(item: Column) -> Column:
                wanted = F.coalesce(item["mediaId"], item["media_id"])
                asset = F.try_element_at(F.filter("_assets", lambda m: m["media_id"] == wanted), F.lit(-1))
                return F.transform(F.filter(F.array(asset), lambda m: m.isNotNull()),
                                   lambda m: _media_parts(m["kind"], m["url"], m["poster"], alt))

            items = F.coalesce(F.flatten(F.flatten(F.transform(data["mediaItems"], of_item))), no_lines)
            own = F.when(tx.blank_to_null(data["url"]).isNotNull(), _media_parts(
                fallback_kind(data["url"]), data["url"], F.lit(None).cast("string"), alt)).otherwise(no_lines)
            return F.concat(items, own)

        return F.when(is_media(r["e"]["type"]), F.flatten(F.transform(F.array(alt), lines))).otherwise(no_lines)

    kind_of, text = b["type"], b["text"]
    level = F.try_element_at(F.create_map(*[F.lit(x) for k, v in HEADINGS.items() for x in (f"header-{k}", "#" * v)]), kind_of)
    kind = (
        F.when(kind_of == "code-block", "code").when(F.endswith(kind_of, F.lit("list-item")), "list")
        .when(level.isNotNull(), "heading").when(kind_of == "blockquote", "quote").otherwise("text")
    )
    line = (
        F.when(kind_of == "unordered-list-item", F.concat(F.lit("- "), text))
        .when(kind_of == "ordered-list-item", F.concat(F.get(F.col("_numbers"), i).cast("string"), F.lit(". "), text))
        .when(level.isNotNull(), F.concat(level, F.lit(" "), text))
        .when(kind_of == "blockquote", F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> "))))
        .otherwise(text)
    )
    mark_only = (kind == "text") & F.rlike(F.trim(text), F.lit(r"^XIMGPH_\d+$"))
    own = F.when(mark_only, no_lines).otherwise(F.array(_plain(line)))
    atomic = F.array(push("quote", per_range(quote)), push("text", per_range(note)), push("media", per_range(media)),
                     push("text", F.array_distinct(per_range(link))))
    shown_media = F.when(kind_of == "code-block", no_lines).otherwise(per_range(media))
    return F.when(kind_of == "atomic", atomic).otherwise(F.array(push(kind, own), push("media", shown_media)))


def article_markdown(articles: DataFrame, key: str, posts: DataFrame) -> DataFrame:
    """One text per article: title, blocks with their links, quotes and media, then the media not shown yet.

    An article is one row, so its text is made inside the row; only the posts it quotes are looked up by a join."""
    quoted = referenced_enrichment(entities(articles, key), key, posts).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("post_id", F.struct("url", "author", "summary")))).alias("_posts")
    )
    cover = F.col("article.cover_media.media_info")
    # One column per step: an expression that is used many times must be a column first.
    rows = articles.join(quoted, key, "left").withColumns({
        "_entities": entity_array(), "_assets": asset_array(),
        "_cover": F.coalesce(cover["original_img_url"], cover["preview_image"]["original_img_url"]),
    })
    rows = rows.withColumn("_pairs", paired(F.col("_entities"))).withColumn("_blocks", _resolved_blocks())
    rows = rows.withColumns({"_blocks": _linked_blocks(), "_numbers": _item_numbers()})
    rows = rows.withColumn("_pushes", F.flatten(F.transform("_blocks", _block_pushes)))
    tail = F.flatten(F.transform(
        F.filter("_assets", lambda m: ~m["repeated"]), lambda m: _media_parts(m["kind"], m["url"], m["poster"], F.lit(""))))
    tail_push = F.array(F.struct(F.lit("tail").alias("kind"), tail.cast(LINES).alias("lines")))
    empty = F.array().cast("array<struct<kind:string,lines:array<struct<url:string,line:string>>>>")
    rows = rows.withColumn("_pushes", F.concat(F.coalesce("_pushes", empty), F.when(F.col("_assets").isNull(), empty).otherwise(tail_push)))
    rows = rows.withColumn("_lines", F.flatten(F.transform("_pushes", lambda p, n: F.transform(p["lines"], lambda x: F.struct(
        n.alias("push"), p["kind"].alias("kind"), x["url"].alias("url"), x["line"].alias("line"))))))
    # An address is shown once per article, at its first use; the cover counts as shown.
    rows = rows.withColumn("_urls", F.transform("_lines", lambda x: x["url"])).withColumn("_lines", F.filter(
        "_lines", lambda x, i: x["url"].isNull() | (
            (F.array_position("_urls", x["url"]) == i + 1) & ~F.coalesce(x["url"] == F.col("_cover"), F.lit(False)))))

    def written(x: Column, i: Column) -> Column:
        before = F.get(F.col("_lines"), i - 1)
        was, code = before["kind"], x["kind"] == "code"
        together = (before["push"] == x["push"]) | ((was == x["kind"]) & x["kind"].isin(*RUNS))
        closing = F.when((was == "code") & ~code, F.lit("\n```")).otherwise(F.lit(""))
        gap = F.when(was.isNull(), F.lit("")).when(together, F.lit("\n")).otherwise(F.lit("\n\n"))
        opening = F.when(code & ~F.coalesce(was == "code", F.lit(False)), F.lit("```\n")).when(
            (x["kind"] == "tail") & ~F.coalesce(was == "tail", F.lit(False)), F.lit("## Media\n\n")).otherwise(F.lit(""))
        return F.concat(closing, gap, opening, x["line"])

    ends_in_code = F.try_element_at(F.col("_lines"), F.lit(-1))["kind"] == "code"
    body = F.concat(F.array_join(F.transform("_lines", written), ""), F.when(ends_in_code, F.lit("\n```")).otherwise(F.lit("")))
    has_blocks = F.coalesce(F.size("article.content_state.blocks") > 0, F.lit(False))
    fallback = F.when(~has_blocks, tx.trim_space(F.coalesce("article.plain_text", "article.preview_text")))
    head = F.concat(F.lit("# "), tx.blank_to_null(tx.trim_space(F.col("article.title"))))
    text = F.concat_ws("\n\n", head, tx.blank_to_null(fallback), tx.blank_to_null(body))
    return rows.select(key, F.regexp_replace(text, r"\s+$", "").alias("markdown"), F.col("_cover").alias("cover_url"))
