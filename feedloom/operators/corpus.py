"""Corpus jobs over texts and pages: cleaning, routing, choice of content, titles, identities, audits of responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.functions import urls as ul
from feedloom.operators.matching import match_rules, rule_value
from feedloom.operators.quantiles import nearest_rank_of
from feedloom.session import cut

MIN_EMBEDDED_CHARS = 280

# Tails that mark an excerpt, and texts of error shells.
CUT_TAILS = (r"read the full story at", r"continue reading", r"read more", r"full article")
SHELL_TEXTS = (r"something went wrong, but don[’']t fret", r"privacy related extensions may cause issues on x\.com")
# Publishers whose own page is better than the embedded text, and one whose marked tail is accepted.
PREFER_PAGE = (
    ("economist.com", "page"), ("newyorker.com", "page"), ("foreignpolicy.com", "page"), ("nytimes.com", "page"),
    ("hypebeast.com", "embedded"),
)
ACCEPTED_TAIL = r"read more at hypebeast\s*$"
# Hosts whose addresses name a post or article by number.
STATUS_HOSTS = ("x.com", "www.x.com", "twitter.com", "www.twitter.com")


def clean_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    cleaned = pages.withColumn("text", tx.strip_html(F.col(html))).drop(html)
    return cleaned.withColumns({
        "excerpt": tx.truncate_text(F.col("text"), 240), "words": tx.clean_words(F.col("text")),
        "chars": F.length("text").cast("bigint"),
    })


def clean_totals(cleaned: DataFrame, source: Column) -> DataFrame:
    return cleaned.groupBy(source.alias("source")).agg(
        F.count(F.lit(1)).alias("pages"), F.sum("words").alias("words"), F.sum("chars").alias("chars")
    )


def language_routing(items: DataFrame, title: Column, html: Column, sample_chars: int | None = None) -> DataFrame:
    """Which items are in a Latin-script language worth translating, by the whole text or its first `sample_chars`."""
    # Normalising collapses all white space, so the text needs no pass of its own for it.
    text = tx.normalize_ws(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), tx.strip_markup(html)))
    word = rf"(?<![A-Za-z0-9_])[A-Za-z][A-Za-z'-]{{1,}}{tx.WORD_EDGE}"
    sampled = items.withColumn("_sample", text if sample_chars is None else F.substring(text, 1, sample_chars))
    counted = sampled.withColumns({
        "letters": tx.count_chars(F.col("_sample"), "A-Za-z"),
        "words": F.regexp_count("_sample", F.lit(word)).cast("bigint"),
        "cjk": tx.count_chars(F.col("_sample"), tx.CJK),
    }).drop("_sample")
    return counted.withColumn(
        "translate", (F.col("words") >= 8) & (F.col("letters") >= 40) & (F.col("cjk") * 4 < F.col("letters"))
    )


def routing_totals(routed: DataFrame) -> DataFrame:
    return routed.rollup("lang", "source").agg(
        F.count(F.lit(1)).alias("items"), F.count_if("translate").alias("to_translate"),
        F.grouping_id().cast("bigint").alias("level"),
    )


def ends_cut(html: Column, text: Column) -> Column:
    """Whether a body looks like an excerpt, by the tails of its text and of its markup."""
    open_tail = rf"(?i){tx.WORD_EDGE}(?:{'|'.join(CUT_TAILS)}){tx.WORD_EDGE}"
    flat = tx.collapse_space(html)
    return (
        F.rlike(F.right(text, F.lit(240)), F.lit(open_tail)) | F.rlike(F.right(flat, F.lit(400)), F.lit(open_tail))
        | F.rlike(text, F.lit(r"(?:…|\.{3})\s*$"))
    )


def content_choice(pages: DataFrame, url: str, html: str, rules: Sequence[tuple[str, str]] = PREFER_PAGE) -> DataFrame:
    """embedded | page per item: the embedded body when it is long enough and whole, unless its publisher's page is
    preferred."""
    texts = pages.withColumns({"_text": tx.strip_html(F.col(html)), "rule_domain": match_rules(F.col(url), rules)})
    judged = texts.withColumns({
        "chars": F.length("_text").cast("bigint"), "cut": ends_cut(F.col(html), F.col("_text")),
        "_wish": rule_value(F.col("rule_domain"), rules),
        "_accepted": F.rlike("_text", F.lit(rf"(?i){tx.WORD_EDGE}{ACCEPTED_TAIL}")),
    })
    whole = ~F.col("cut") | (F.col("_accepted") & F.coalesce(F.col("_wish") == "embedded", F.lit(False)))
    embedded = (F.col("chars") >= MIN_EMBEDDED_CHARS) & whole & ~F.coalesce(F.col("_wish") == "page", F.lit(False))
    choice = F.when(embedded, F.lit("embedded")).otherwise(F.lit("page"))
    return judged.withColumn("choice", choice).drop("_text", "_wish", "_accepted", html)


def choice_totals(chosen: DataFrame, url: str) -> DataFrame:
    return chosen.groupBy(ul.url_host(F.col(url)).alias("host"), "choice").agg(F.count(F.lit(1)).alias("items"))


def failure_shell_rate(pages: DataFrame, url: str, html: str) -> DataFrame:
    shell = F.rlike(tx.strip_html(F.col(html)), F.lit(f"(?i){'|'.join(SHELL_TEXTS)}"))
    flagged = pages.select(ul.url_host(F.col(url)).alias("host"), shell.cast("int").alias("_shell"))
    return flagged.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("_shell").alias("shells"),
        (F.sum("_shell") / F.count(F.lit(1))).alias("rate"),
    )


def title_derivation(items: DataFrame, text: str, limit: int = 72, default: str = "Untitled", override: str | None = None) -> DataFrame:
    """Given title, else the first top heading, else the first line that is no bare URL, else any line, else default."""
    lines = F.filter(
        F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r?\n+"), lambda line: tx.normalize_ws(line)),
        lambda line: line != "",
    )
    read = items.withColumns({"_heading": tx.heading_title(F.col(text), limit), "_lines": lines})
    speaking = F.filter("_lines", lambda line: ~F.rlike(line, F.lit(r"^https?://\S+$")))
    lead = tx.truncate_text(F.coalesce(F.get(speaking, F.lit(0)), F.get("_lines", F.lit(0))), limit)
    given = [tx.blank_to_null(tx.derived_title(F.col(override), limit))] if override else []
    title = F.coalesce(*given, tx.blank_to_null(F.col("_heading")), tx.blank_to_null(lead), F.lit(default))
    return read.withColumn("title", title).drop("_heading", "_lines")


def identity_key(url: Column) -> Column:
    """Key of a saved address: the post or article number on the known hosts, else the URL without its fragment."""
    bare = tx.trim_space(url)
    known = ul.url_host(bare).isin(*STATUS_HOSTS)
    number = F.regexp_extract(ul.url_path(bare), r"/status(?:es)?/(\d+)", 1)
    article = F.regexp_extract(ul.url_path(bare), r"/(?:i/)?article/(\d+)", 1)
    return (
        F.when(F.rlike(bare, F.lit(r"^\d+$")), F.concat(F.lit("x-tweet:"), bare))
        .when(known & (number != ""), F.concat(F.lit("x-tweet:"), number))
        .when(known & (article != ""), F.concat(F.lit("x-article:"), article))
        .otherwise(ul.without_fragment(bare))
    )


def identity_dedupe(saved: DataFrame, url: str, newest_by: str) -> DataFrame:
    """Newest row per identity. Rows fold before the shuffle, so many copies of one page cost one row per task."""
    keyed = saved.withColumn("identity", identity_key(F.col(url)))
    kept = F.max_by(F.struct(*saved.columns), F.col(newest_by)).alias("_row")
    return keyed.groupBy("identity").agg(kept, F.count(F.lit(1)).alias("copies")).select("identity", "copies", "_row.*")


def response_flags(responses: DataFrame, raw: str = "raw") -> DataFrame:
    """Per model response: empty, fenced, valid JSON after unfencing, both required fields filled."""
    trimmed = responses.withColumn("_t", tx.trim_space(F.coalesce(F.col(raw), F.lit(""))))
    inner = F.regexp_extract("_t", r"^(?:```+|~~~+)[^\n]*\n([\s\S]*?)\n(?:```+|~~~+)$", 1)
    bodies = trimmed.withColumns({"empty": F.col("_t") == "", "fenced": inner != ""}).withColumn(
        "_body", F.when(F.col("fenced"), tx.trim_space(inner)).otherwise(F.col("_t"))
    )
    parsed = bodies.withColumns({
        "valid_json": (F.col("_body") != "") & F.try_parse_json("_body").isNotNull(),
        "_fields": F.from_json("_body", "translatedTitle STRING, translatedContentHtml STRING"),
    })
    filled = [F.coalesce(tx.normalize_ws(F.col(f"_fields.{f}")) != "", F.lit(False)) for f in ("translatedTitle", "translatedContentHtml")]
    complete = F.col("valid_json") & F.coalesce(filled[0] & filled[1], F.lit(False))
    return parsed.withColumn("complete", complete).drop("_t", "_body", "_fields", raw)


def response_audit(responses: DataFrame) -> DataFrame:
    flags = ("empty", "fenced", "valid_json", "complete")
    return response_flags(responses).groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("responses"), *[F.count_if(f).alias(f) for f in flags],
        (F.count_if("complete") / F.count(F.lit(1))).alias("complete_rate"),
    )


def reading_rows(items: DataFrame, text: str) -> DataFrame:
    """Readable characters (white space aside), minutes at 200 of them, and weighted words."""
    counted = items.withColumns({
        "chars": F.length(tx.without_space(F.col(text))).cast("bigint"), "words": tx.mixed_words(F.col(text)),
    }).drop(text)
    return counted.withColumn("minutes", F.greatest(F.lit(1), F.floor(F.col("chars") / 200 + 0.5)).cast("bigint"))


def reading_stats(items: DataFrame, text: str, source: str) -> DataFrame:
    """Items, characters, minutes and words per source, with the median and 95th percentile of words: texts are read once, into counts per source and
    number of words."""
    folded = cut(reading_rows(items.select(source, text), text).groupBy(source, "words").agg(
        F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum("minutes").alias("minutes")
    ))
    ranks = nearest_rank_of(folded.filter("words IS NOT NULL"), [source], "words", "n", {"words_p50": 0.5, "words_p95": 0.95})
    sums = folded.groupBy(source).agg(
        F.sum("n").alias("items"), F.sum("chars").alias("chars"), F.sum("minutes").alias("minutes"), F.sum(F.col("words") * F.col("n")).alias("words"),
    )
    same = F.col(source).eqNullSafe(F.col("_source"))
    return sums.join(ranks.withColumnRenamed(source, "_source"), same, "left").drop("_source")
