import random
import re
from datetime import datetime

from conftest import rows
from pyspark.sql import functions as F

from feedloom.operators import chunks, corpus, lists, markup, matching, paging, publish, reconcile, rollups, threads


def entries(spark, data):
    """(id, feed, title, published, translated html, status, retry after) rows as entries."""
    schema = "id bigint, feed_name string, source_title string, p string, translated_content_html string, refresh_status string, r string"
    ts = lambda c: F.col(c).cast("timestamp_ntz")
    none = F.lit(None).cast("string")
    return spark.createDataFrame(data, schema).select(
        "id", "feed_name", "source_title", ts("p").alias("source_published_at"), ts("p").alias("refreshed_at"),
        ts("p").alias("created_at"), "translated_content_html", "refresh_status", none.alias("refresh_error"),
        none.alias("translation_last_error"), none.cast("timestamp_ntz").alias("translation_last_failed_at"),
        ts("r").alias("translation_retry_after"), none.alias("translated_title"), F.lit("u").alias("source_url"),
        F.concat(F.lit("g"), "id").alias("source_guid"),
    )


def test_search_and_pages(spark):
    data = entries(spark, [
        (1, "f", "Old item", "2024-07-21", None, "ok", None), (2, "f", "100% coverage", "2024-07-22", "<p>t</p>", "ok", None),
        (3, "f", "Ｎｅｗｅｓｔ item", "2024-07-23", None, "ok", None),
    ])
    found = lists.with_search_text(data)
    assert rows(lists.search_count(found, "")) == [(3,)]
    assert rows(lists.page_entries(found, limit=2, offset=1), "id") == [(2,), (1,)]
    assert rows(lists.search_entries(found, "%"), "id") == [(2,)]
    assert rows(lists.search_entries(found, "Newest"), "id") == [(3,)]
    assert rows(lists.search_count(found, "missing")) == [(0,)]
    light = lists.light_projection(data)
    assert rows(light.orderBy("id"), "is_translated") == [(0,), (1,), (0,)]
    assert not [c for c in light.columns if c.endswith("html")]
    assert rows(lists.page_after(data, "2024-07-23 00:00:00", 3, 5), "id") == [(2,), (1,)]


def test_retries_and_errors(spark):
    data = entries(spark, [
        (1, "on", "due", "2024-01-01", None, "ok", "2024-01-01 02:00:00"), (2, "on", "future", "2024-01-02", None, "ok", "2024-01-02 00:00:00"),
        (3, "off", "disabled-due", "2024-01-01", None, "ok", "2024-01-01 03:30:00"), (4, "on", "fine", "2024-01-03", None, "ok", None),
    ])
    feeds = spark.createDataFrame([("on", True), ("off", False)], "feed_name string, translate_enabled boolean")
    assert rows(lists.due_retries(data, feeds, "2024-01-01 12:00:00", 10), "source_title") == [("due",)]
    top = lists.recent_errors_per_feed(data, 1)
    assert sorted(rows(top, "feed_name", "source_title")) == [("off", "disabled-due"), ("on", "future")]


def test_top_per_group_is_pruned_before_the_shuffle(spark, small):
    from feedloom.plans.catalogue import QUERIES

    for name in ("latest_per_feed", "recent_errors_per_feed", "refresh_slice", "usage_summary"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "WindowGroupLimit" in plan, name


def test_lists_do_not_read_bodies(spark, small):
    from feedloom.plans.catalogue import QUERIES

    plan = QUERIES["usage_totals"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[1].split("\n")[0]
    counts = QUERIES["feed_list"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "text:string" not in counts


def test_live_pages_and_dimensions(spark):
    urls = [("https://www.nytimes.com/live/a",), ("https://nytimes.com/2024/live/a",), ("https://xnytimes.com/live/a",), ("bad",)]
    kept = lists.drop_live_pages(spark.createDataFrame(urls, "url string"), "url", "nytimes.com")
    assert len(rows(kept)) == 3
    data = spark.createDataFrame([
        ("World", "https://www.reuters.com/world/e/", "pt"), ("Portuguese", "https://www.reuters.com/pt/desportivo/x/", "en"),
        ("Views", "https://www.reuters.com/commentary/breakingviews/e/", "en"), ("Other", "https://example.com/it/x", " EN "),
        ("Relative", "/world/x/", "en"),
    ], "title string, url string, lang string")
    dims = lists.with_dimensions(data, "url", "lang")
    pick = lambda **k: sorted(r[0] for r in rows(lists.dimension_filter(dims, **k), "title"))
    assert pick(languages=["en"]) == ["Other", "Views", "World"]
    assert pick(languages=["pt"]) == ["Portuguese"]
    assert pick(languages=["en"], sections=["Breakingviews"]) == ["Views"]
    assert pick() == ["Other", "Portuguese", "Views", "World"]


def test_domain_rules(spark):
    rules = [("example.com", "a"), (".News.example.com", "b"), ("example.com", "c"), ("", "x")]
    urls = ["https://example.com/", "https://a.news.example.com/x", "https://notexample.com/", "bad"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    table = spark.createDataFrame([(i, d, v) for i, (d, v) in enumerate(rules)], "pos int, domain string, value string")
    joined = matching.domain_rule_match(df, "url", table).select("i", "rule_domain", "rule_value")
    literal = df.withColumn("d", matching.match_rules(F.col("url"), rules)).select("i", "d", matching.rule_value(F.col("d"), rules))
    want = [(0, "example.com", "c"), (1, "news.example.com", "b"), (2, None, None), (3, None, None)]
    assert sorted(rows(joined)) == want and sorted(rows(literal)) == want


def test_addresses(spark):
    cases = {
        "8.8.8.8": False, "10.1.2.3": True, "172.32.0.1": False, "198.18.0.1": True, "256.1.1.1": True, "1.2.3": True, "host": True,
        "::1": True, "::": True, "2606:4700::1111": False, "fe80::1%eth0": True, "::ffff:10.0.0.1": True, "::ffff:8.8.8.8": False,
        "64:ff9b::a00:1": True, "64:ff9b::808:808": False, "64:ff9b:1::1": True, "2002:a00:1::": True, "2002:808:808::": False,
        "2001:db8::1": True, "3fff::1": True, "fc00::1": True, "1:2:3": True, "1::2::3": True, "4000::1": True,
    }
    df = spark.createDataFrame([(a,) for a in cases], "a string")
    assert dict(rows(matching.address_block_match(df, "a"), "a", "blocked")) == cases
    fake = matching.address_block_match(df.filter("a = '198.18.0.1'"), "a", allow_fake=True)
    assert rows(fake, "blocked") == [(False,)]


def test_reconcile_actions(spark):
    ntz = lambda s: datetime.fromisoformat(s)
    base = "feed_name string, source_guid string, source_url string, source_title string, source_author string, source_content_html string, source_published_at timestamp_ntz"
    at = ntz("2024-01-01 12:00:00")
    stored = spark.createDataFrame([
        (1, "f", "same", "u", "T", "", "<p>b</p>", None, None, None, None, "rss", "ok", ntz("2024-01-01 06:00:00"), None),
        (2, "f", "title", "u", "T", "", "<p>b</p>", None, None, None, None, "rss", "ok", ntz("2024-01-01 06:00:00"), at),
        (3, "f", "zh", "u", "T", "", "<p>b</p>", None, None, "ZT", "<p>z</p>", "rss+zh", "ok", ntz("2024-01-01 06:00:00"), None),
        (4, "f", "wait", "u", "T", "", "<p>b</p>", None, None, None, None, "rss", "ok", ntz("2024-01-01 06:00:00"), ntz("2024-01-02 00:00:00")),
        (5, "f", "old", "u", "T", "", "<p>b</p>", None, None, None, None, "rss", "ok", ntz("2023-12-01 06:00:00"), None),
    ], "id bigint, " + base + ", extracted_content_html string, translated_title string, translated_content_html string, translation_provider string, "
       "refresh_status string, source_fetched_at timestamp_ntz, translation_retry_after timestamp_ntz").withColumns(
        {"refreshed_at": F.col("source_fetched_at"), "created_at": F.col("source_fetched_at")})
    new = spark.createDataFrame(
        [("f", g, "u", "T2" if g == "title" else "T", "", "<p>b</p>", None, "<p>b</p>", at) for g in ("same", "title", "zh", "wait", "old", "new")],
        base + ", page_html string, refreshed_at timestamp_ntz")
    feeds = spark.createDataFrame([("f", True)], "feed_name string, translate_enabled boolean")
    out = reconcile.reconcile_items(new, stored, feeds)
    got = {r[0]: r[1:] for r in rows(out, "source_guid", "action", "plan", "reuse_body", "content_changed")}
    assert got == {
        "same": ("touch", "translate", True, False), "title": ("update", "translate", False, True),
        "zh": ("touch", "reuse", True, False), "wait": ("touch", "backoff", True, False),
        "old": ("touch", "translate", False, False), "new": ("insert", "translate", False, False),
    }


def test_upsert_twice_is_upsert_once(spark):
    stored = spark.createDataFrame([(1, "f", "a", "old", "c1"), (2, "f", "b", "old", "c2")], "id bigint, feed_name string, source_guid string, t string, created_at string")
    new = spark.createDataFrame([(9, "f", "a", None, "c9"), (3, "f", "c", "new", "c3")], stored.schema)
    once = reconcile.upsert_entries(stored, new)
    assert sorted(rows(once)) == [(1, "f", "a", None, "c1"), (2, "f", "b", "old", "c2"), (3, "f", "c", "new", "c3")]
    assert sorted(rows(reconcile.upsert_entries(once, new))) == sorted(rows(once))


def test_feed_upsert_fills(spark):
    schema = "feed_name string, source_url string, title string, last_refresh_status string, created_at string"
    stored = spark.createDataFrame([("f", "u", "T", "ok", "c")], schema)
    new = spark.createDataFrame([("f", "u2", None, None, "x"), ("g", "v", None, "ok", "y")], schema)
    assert sorted(rows(reconcile.upsert_feeds(stored, new))) == [("f", "u2", "T", "ok", "c"), ("g", "v", None, "ok", "y")]


def test_version_check(spark):
    schema = "id bigint, source_title string, translated_title string"
    want = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "a", None)], schema)
    have = spark.createDataFrame([(1, "a", None), (2, "a", "")], schema)
    assert sorted(rows(reconcile.version_check(want, have))) == [(1, "same"), (2, "superseded"), (3, "superseded")]


def test_cookies(spark):
    data = [(".E.org", "a", "1", 1), ("e.org", "b", "2", 2), ("e.org", "a", " 3 ", 3), ("e.org", "c", "", 4), ("e.org", "b", None, 5), ("", "x", "1", 6)]
    out = rollups.cookie_headers(spark.createDataFrame(data, "domain string, name string, value string, pos int"))
    assert rows(out, "domain", "header", "cookies", "piece", "pieces") == [("e.org", "a=3", 1, 0, 1)]


def markdown(spark, text, budget):
    df = spark.createDataFrame([(1, text)], "id int, m string")
    return [(r[1], r[2]) for r in sorted(rows(chunks.markdown_chunks(df, "id", "m", budget), "chunk_no", "words", "text"))]


def test_markdown_chunks(spark):
    assert markdown(spark, "", 5) == [] and markdown(spark, "   ", 5) == []
    assert markdown(spark, "﻿# Pond\r\n\r\nducks swim there\r\n\r\n## Hill\r\n\r\ngoats climb up", 5) == [
        (5, "# Pond\n\nducks swim there"), (5, "## Hill\n\ngoats climb up")]
    assert markdown(spark, "red oak leaf\nold elm bark\nwet ash twig", 4) == [(3, "red oak leaf"), (3, "old elm bark"), (3, "wet ash twig")]
    assert markdown(spark, "rain falls. snow melts. wind turns.", 4) == [(4, "rain falls. snow melts."), (2, "wind turns.")]
    seven = "lime plum pear fig date kiwi sloe"
    assert markdown(spark, seven, 3) == [(3, "lime plum pear"), (3, "fig date kiwi"), (1, "sloe")]
    assert markdown(spark, "甲乙丙丁戊己庚辛壬癸", 5) == [(5, "甲乙丙丁戊己庚辛壬癸")]


def test_markdown_chunks_lose_no_word(spark, small):
    from feedloom.sources.tables import view

    docs = view(spark, small, "v_markdown").select("doc_id", "markdown")
    words = {d: m.split() for d, m in rows(docs)}
    packed = {}
    for d, n, w, text in sorted(rows(chunks.markdown_chunks(docs, "doc_id", "markdown", 40), "doc_id", "chunk_no", "words", "text")):
        assert w <= 40 or "\n" not in text
        packed.setdefault(d, []).extend(text.split())
    assert packed == words


def test_assemble(spark):
    data = [(1, 0, 2, "a "), (1, 1, 2, "b"), (1, 1, 2, "b"), (2, 1, 2, "x")]
    out = chunks.assemble_chunks(spark.createDataFrame(data, "id int, chunk_no int, chunk_count int, text string"), "id")
    assert sorted(rows(out, "id", "text", "error"), key=str) == [(1, "a\n\nb", None), (2, None, "incomplete chunks")]


def test_markup_audit(spark):
    html = ('<!-- c --><script>x</script><style></style><iframe srcdoc="x"></iframe><object></object><svg></svg><newsletter-card>'
            '<p class="k" id="i" style="s" onclick="x" title="t"><a href="../stories/1" rel="ugc opener" onfocus="y">A</a>'
            '<a href="mailto:r@e.org">m</a><a href="tel:+1">t</a><a href="java&#x73;cript:alert(1)">s</a><a href="data:text/html,x">d</a>'
            '<img src="./c.jpg" srcset="/s.jpg 1x, https://cdn.example/l.jpg 2x, javascript:alert(1) 3x"><img src="data:image/x,y">')
    page = spark.createDataFrame([(1, "https://news.example/section/index.html", html)], "page_id int, url string, html string")
    tags = markup.html_tag_audit(page.select("page_id", "html")).first()
    assert (tags.dangerous, tags.unknown, tags.comments, tags.handlers, tags.styles) == (5, 1, 1, 2, 2)
    links = markup.html_link_audit(page).first()
    assert (links.links, links.unsafe_links, links.same_host_links, links.mail_or_phone) == (5, 2, 1, 2)
    assert (links.resources, links.unsafe_resources, links.image_candidates, links.bad_image_candidates) == (2, 1, 3, 1)
    assert links.rel_tokens_missing == 10


def test_identity(spark):
    cases = {
        "https://x.com/a/status/123456": "x-tweet:123456", "https://www.twitter.com/a/statuses/123456?s=1#f": "x-tweet:123456", " 123456 ": "x-tweet:123456",
        "https://x.com/i/article/987654": "x-article:987654", "https://e.org/a/status/5#f": "https://e.org/a/status/5",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert dict(rows(df.select("u", corpus.identity_key(F.col("u"))))) == cases


def test_content_choice(spark):
    long = "word " * 80
    data = [("https://a.example/1", long), ("https://a.example/2", long + "Continue Reading"), ("https://www.economist.com/3", long),
            ("https://hypebeast.com/4", long + "Read more at HYPEBEAST"), ("https://a.example/5", "short"), ("https://a.example/6", long + "…")]
    out = corpus.content_choice(spark.createDataFrame(data, "url string, html string"), "url", "html")
    assert [r[1] for r in sorted(rows(out, "url", "choice"), key=lambda r: r[0][-1])] == ["embedded", "page", "page", "embedded", "page", "page"]


def test_outline(spark):
    data = [("1", None, "  Tech  ", None), ("2", "1", " Daily   News ", None), ("3", "2", "Feed A", " https://a.example/f "),
            ("4", None, "Root", "https://b.example/f"), ("5", "9", "Lost", "https://c.example/f")]
    out = publish.outline_paths(spark.createDataFrame(data, "node_id string, parent_id string, text string, xml_url string"))
    assert sorted(rows(out)) == [
        ("https://a.example/f", "Feed A", "Tech/Daily News"), ("https://b.example/f", "Root", ""), ("https://c.example/f", "Lost", "")]
    deep = [(str(k), str(k - 1) if k else None, f"n{k}", "https://leaf.example/f" if k in (5, 7) else None) for k in range(8)] + [("x", "y", "x", None), ("y", "x", "y", None), ("z", "x", "Ring", "https://ring.example/f")]
    out = publish.outline_paths(spark.createDataFrame(deep, "node_id string, parent_id string, text string, xml_url string"))
    assert sorted(rows(out, "title", "folder")) == [("Ring", ""), ("n5", "n0/n1/n2/n3/n4"), ("n7", "n0/n1/n2/n3/n4/n6")]


def test_upserts_give_one_row_per_key(spark):
    stored = spark.createDataFrame([(1, "f", "a", "old", "2024-01-01")], "id int, feed_name string, source_guid string, title string, refreshed_at string")
    new = spark.createDataFrame([(7, "f", "a", "second", "2024-01-03"), (8, "f", "a", "first", "2024-01-02"), (9, "f", "b", "x", "2024-01-02"), (9, "f", "b", "x", "2024-01-02")], stored.schema)
    out = reconcile.upsert(stored, new, ["feed_name", "source_guid"], keep=["id"])
    assert sorted(rows(out, "id", "source_guid", "title")) == [(1, "a", "second"), (9, "b", "x")]


def test_names_that_clash_inside_a_batch(spark):
    schema = "feed_name string, source_url string"
    out = reconcile.resolve_feed_name(spark.createDataFrame([("n", "https://b"), ("n", "https://a"), ("m", "https://c")], schema), spark.createDataFrame([("m", "https://c")], schema))
    got = {r.source_url: r.resolved_name for r in out.collect()}
    assert got["https://a"] == "n" and got["https://b"].startswith("n-") and len(got["https://b"]) == 10 and got["https://c"] == "m"
    import hashlib

    digits = hashlib.sha256(b"https://z").hexdigest()
    full = spark.createDataFrame([("n", "https://q")] + [(f"n-{digits[:k]}", "https://q") for k in (8, 12, 16)], schema)
    assert rows(reconcile.resolve_feed_name(spark.createDataFrame([("n", "https://z")], schema), full)) == [("n", "https://z", None)]


def test_imports_use_canonical_addresses_and_free_names(spark):
    outline = spark.createDataFrame(
        [(0, "HTTPS://A.org", "A", "", None), (1, "https://b.org/x?y=1", "B", "", None), (2, "https://b.org/x?y=2", "C", "", None), (3, "https://c.org/", "D", "", "My Own Name")],
        "pos int, source_url string, title string, folder string, name string")
    stored = spark.createDataFrame([("a-feed", "https://a.org/", "a-feed")], "feed_name string, source_url string, title string")
    got = {r.source_url: (r.feed_name, r.action) for r in reconcile.import_feeds(outline, stored).collect()}
    assert got["https://a.org/"] == ("a-feed", "updated") and got["https://c.org/"] == ("my-own-name", "created")
    names = {got["https://b.org/x?y=1"][0], got["https://b.org/x?y=2"][0]}
    assert "b-org-x" in names and len(names) == 2


def test_null_groups_stay(spark):
    samples = spark.createDataFrame([(None, 5, 1, False), (None, 7, 1, True), ("s", None, 2, False)], "scenario string, latency_ms int, calls int, aborted boolean")
    out = rollups.latency_percentiles(samples.withColumn("aborted", F.col("aborted").cast("int")))
    assert sorted(map(str, rows(out, "scenario", "p50", "mean_ms"))) == sorted(map(str, [(None, 5, 6.0), ("s", None, None)]))


def test_markup_in_any_quotes(spark):
    page = spark.createDataFrame([(1, "https://n.example/", "<a href=javascript:x><a href='java&Tab;script:y'><a href=\"javascript&colon;z\"><a href='it\"s'>"
                                   "<META content='https://i.example/o.png' property=og:image>")], "page_id int, url string, html string")
    links = markup.html_link_audit(page).first()
    assert (links.links, links.unsafe_links) == (4, 3)
    assert rows(markup.lead_image_per_page(page), "src", "origin") == [("https://i.example/o.png", "meta")]


def test_thread_cap_and_text(spark):
    ts = lambda n: datetime(2024, 1, 1, 0, n // 60, n % 60)
    posts = [("c", "u", 100 + i, i, ts(i)) for i in range(300)] + [("c", "other", 999, 500, ts(1))]
    df = spark.createDataFrame(posts, "conversation_id string, author string, post_id bigint, seen_no int, created_at timestamp_ntz")
    for root in (100, 390):
        roots = spark.createDataFrame([("c", root)], "conversation_id string, post_id bigint")
        out = threads.thread_assembly(df, roots).orderBy("position")
        got = rows(out, "post_id")
        assert len(got) == 250 and got[0] == (100,) and (root,) in got
    text = spark.createDataFrame([
        (100, 1, 100, "First line\nSecond line", "> Author: Bob (@bob)", "![Photo \\[alt\\]](p.jpg)\n[video](v.mp4)"), (100, 2, 101, "", None, None),
    ], "root_id bigint, position int, post_id bigint, text string, quote string, media string")
    out = threads.thread_markdown(text, F.lit("Saved thread"), F.lit("alice")).first().markdown
    assert out == (
        "# Saved thread\nSource: https://x.com/alice/status/100\nTweets: 2\n\n## 1\nhttps://x.com/alice/status/100\n\nFirst line\nSecond line\n\n"
        "> Author: Bob (@bob)\n\n![Photo \\[alt\\]](p.jpg)\n[video](v.mp4)\n\n## 2\nhttps://x.com/alice/status/101\n\n_No text or media._")
    quote = spark.range(1).select(threads.quote_lines(threads.author_text(F.lit("Bob"), F.lit("bob")), threads.post_url(F.lit("bob"), F.lit("200")), F.lit("Quoted text")))
    assert quote.first()[0] == "> Author: Bob (@bob)\n> URL: https://x.com/bob/status/200\n>\n> Quoted text"


def test_pages_at_any_depth(spark):
    rnd = random.Random(9)
    plain = [(rnd.choice([None, 5, 5, 5, rnd.randrange(-10**15, 10**15), rnd.randrange(50)]), i) for i in range(800)]
    df = spark.createDataFrame(plain, "ts long, id long")
    ordered = sorted(plain, key=lambda r: (r[0] is None, -(r[0] or 0), -r[1]))
    for left in (1, 30, 500):
        for offset in (0, 1, 150, 399, 700, 790, 799, 800, 5000):
            got = paging.page(df, [F.col("ts"), F.col("id")], 20, offset, direct=0, left=left)
            assert rows(got) == ordered[offset:offset + 20], (left, offset)
    assert rows(paging.page(df.limit(0), [F.col("ts"), F.col("id")], 20, 5, direct=0)) == []
    alike = spark.createDataFrame([(1, 1)] * 50 + [(None, None)] * 50, "ts long, id long")
    assert rows(paging.page(alike, [F.col("ts"), F.col("id")], 10, 45, direct=0, left=5)) == [(1, 1)] * 5 + [(None, None)] * 5
    assert rows(paging.page(df, [F.col("ts"), F.col("id")], 20, 399)) == ordered[399:419]


def test_a_deep_page_sorts_its_range_only(spark):
    df = spark.range(5000).select((F.col("id") % 100).alias("ts"), "id")
    deep = paging.page(df, [F.col("ts"), F.col("id")], 20, 4000, direct=100, left=200)
    plan = deep._jdf.queryExecution().analyzed().toString()
    assert int(re.search(r"GlobalLimit (\d+)", plan).group(1)) == 20 and int(re.search(r"Offset (\d+)", plan).group(1)) < 200


def test_attributes_of_kept_elements(spark):
    html = ("""<A onClick='x' HREF="a>b" rel="opener NOOPENER opener" target='_TOP' data-x>t</A><a target=_blank rel>u</a><img/src=x alt='a "b"' OnLoad=1 onload=2>"""
            """<script onload=1></script><x-card foo=1></x-card><td colspan = 2 align="left"><time datetime='1' style=''>< a b=c><p class title=x lang dir id=1>""")
    page = spark.createDataFrame([(1, html), (2, ""), (3, None), (4, "<a" + " b='c'" * 150 + "><i j>")], "page_id int, html string")
    out = {r.page_id: r for r in markup.html_tag_audit(page).collect()}
    assert out[1].disallowed == "a@data-x,a@onclick,img@onload,p@id,td@align,time@style" and out[1].disallowed_count == 6
    assert (out[1].bad_rel, out[1].bad_targets) == (1, 1)
    assert (out[2].disallowed, out[2].disallowed_count, out[2].bad_rel) == ("", 0, 0)
    assert out[4].disallowed == "a@b,i@j" and out[4].disallowed_count == 2


def test_links_of_the_page_and_others_are_judged_as_resolved(spark):
    """The short way for usual references gives what resolving gives."""
    values = ["/a", "//X.org/b", "a/b", "a:b", "?q", "#f", "", "https://o.org", "https://O.ORG/x", "http://1.2.3.4/", "https://u@o.org/", "mailto:a@b", "java&#x73;cript:x", " /lead", "../up", "/\\x", "HTTP://h.org",
              "tel:1", "data:x", "a b", "x.html", "é", "https://o.org:443/", "ftp://o.org/", "&#104;ttps://o.org/"]
    bases = ["https://p.org/d/e", "HTTPS://P.org:443/", "no base", "https://u@p.org/", "https://p.org"]
    df = spark.createDataFrame([(b, v) for b in bases for v in values], "b string, v string")
    base = F.col("b")
    home = F.struct(markup.ul.url_scheme(base).alias("scheme"), markup.ul.url_host(base).alias("host"))
    page = F.when(F.rlike(base, F.lit(markup.USUAL)), home)
    fast = F.get(markup.safe_links(F.array("v"), base, page, markup.LINK_SCHEMES), F.lit(0))
    whole = markup.ul.resolve_url(markup.decoded_value(F.col("v")), base)
    for r in df.select("b", "v", fast.alias("f"), markup.ul.url_scheme(whole).alias("scheme"), markup.ul.url_host(whole).alias("host")).collect():
        assert (r.f.scheme, r.f.host, r.f.safe) == (r.scheme, r.host, r.scheme in markup.LINK_SCHEMES), (r.b, r.v)


def test_import_finds_stored_feeds_by_their_usual_address(spark):
    outline = spark.createDataFrame([(0, "https://a.org/", "A", "f"), (1, "https://b.org/x", "B", "")], "pos int, source_url string, title string, folder string")
    stored = spark.createDataFrame([("a", "HTTPS://A.org", "Old"), ("a2", "https://a.org:443/", "Old 2"), ("c", "managed://c", "C")], "feed_name string, source_url string, title string")
    out = {r.source_url: (r.feed_name, r.action) for r in reconcile.import_feeds(outline, stored).collect()}
    assert out["https://a.org/"] == ("a", "updated") and out["https://b.org/x"][1] == "created" and len(out) == 2


def feed_entries(spark, data):
    ts = lambda c: F.col(c).cast("timestamp_ntz")
    none = F.lit(None).cast("string")
    return spark.createDataFrame(data, "id bigint, feed_name string, source_title string, source_content_html string, p string").select(
        "id", "feed_name", "source_title", "source_content_html", ts("p").alias("source_published_at"), ts("p").alias("refreshed_at"), none.alias("translated_title"),
        none.alias("translated_content_html"), none.alias("extracted_content_html"), none.alias("source_author"), F.concat(F.lit("g"), "id").alias("source_guid"),
        F.lit("https://x.org/").alias("source_url"), none.alias("translation_provider"), F.lit("ok").alias("refresh_status"))


def test_publishing_renders_and_writes_changed_feeds_only(spark, tmp_path):
    feeds = lambda *names: spark.createDataFrame([(n, n.upper(), "https://x.org/", False) for n in names], "feed_name string, title string, source_url string, translate_enabled boolean")
    data = [(1, "a", "t1", "<p>1</p>", "2024-01-01 00:00:00"), (2, "a", "t2", "]]>", "2024-01-02 00:00:00"), (3, "b", "t3", "x", "2024-01-01 00:00:00")]
    folder = str(tmp_path / "out")
    run = lambda n, rows_, *names: sorted(rows(publish.publish_run(spark, feed_entries(spark, rows_), feeds(*names), folder, n, "https://me")))
    text = lambda n: "\n".join(r[0] for r in spark.read.text(f"{folder}/documents/feed_name={n}").collect())
    assert run(0, data, "a", "b", "c") == [("a", "new"), ("b", "new"), ("c", "new")]
    first = text("b")
    assert "t2" in text("a") and text("a").index("t2") < text("a").index("t1") and "]]]]><![CDATA[>" in text("a")
    assert run(1, data[::-1], "a", "b", "c") == []
    changed = [data[0], (2, "a", "t2 new", "]]>", "2024-01-02 00:00:00"), data[2]]
    for _ in range(2):  # and once more, as after a lost driver
        assert run(2, changed, "a", "b") == [("a", "changed"), ("c", "gone")]
        assert "t2 new" in text("a") and text("b") == first and not (tmp_path / "out/documents/feed_name=c").exists()
    assert run(3, [], "a", "b") == [("a", "changed"), ("b", "changed")] and "<item>" not in text("a")
    assert sorted(rows(spark.read.parquet(f"{folder}/manifest/run=2"), "feed_name")) == [("a",), ("b",)]


def test_a_domain_with_many_cookies_is_written_in_pieces(spark):
    many = spark.range(5000).select(F.lit("Big.org").alias("domain"), F.concat(F.lit("n"), F.col("id") % 2500).alias("name"), F.col("id").cast("string").alias("value"), F.col("id").alias("pos"))
    out = rows(rollups.cookie_headers(many, most=100), "piece", "header", "cookies", "pieces")
    assert len(out) == 25 and all(r[2:] == (100, 25) for r in out)
    assert "; ".join(r[1] for r in sorted(out)) == "; ".join(f"n{k}={k + 2500}" for k in range(2500))
