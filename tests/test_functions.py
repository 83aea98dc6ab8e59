import unicodedata

from conftest import values
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.functions import urls as ul
from feedloom.functions import values as vl
from feedloom.operators import lists

L = F.lit


def one(spark, column):
    return values(spark, column)[0]


def test_strip_and_truncate(spark):
    html = "<p>A&nbsp;b</p><SCRIPT>x<y</script><style>p{}</style> c &AMP; d \n e"
    assert one(spark, tx.strip_html(L(html))) == "A b c & d e"
    assert one(spark, tx.strip_html(L(None).cast("string"))) == ""
    assert one(spark, tx.truncate_text(L("abcdef"), 5)) == "abcd…"
    assert one(spark, tx.truncate_text(L("abc   def"), 6)) == "abc…"
    assert one(spark, tx.truncate_text(L("abc"), 3)) == "abc"


def test_titles(spark):
    assert one(spark, tx.heading_title(L("x\n#  A   title  \ny"))) == "A title"
    assert one(spark, tx.heading_title(L("# abcdef"), 5)) == "abcd…"
    assert one(spark, tx.heading_title(L("## no"))) == ""


def test_normalize(spark):
    assert one(spark, tx.normalize_ws(L(" Ｎｅｗ​　x ﻿"))) == "New x"
    assert one(spark, tx.normalize_ws(L("①　x"))) == "1 x"
    assert one(spark, tx.trim_space(L("　\t a  "))) == "a"


def test_words(spark):
    got = values(spark, tx.mixed_words(L("甲乙丙丁戊己庚辛壬癸")), tx.mixed_words(L("a 甲b")), tx.mixed_words(L("")),
                 tx.plain_words(L(" one two  é ")), tx.clean_words(L("")), tx.clean_words(L("a b c")))
    assert got == (5, 3, 0, 3, 0, 3)


def test_guid_fallback(spark):
    none = L(None).cast("string")
    want = [one(spark, tx.hash_text(L(v))) for v in ("g", "i", "l", "t:d", ":")]
    got = values(
        spark, tx.stable_guid(L("g"), L("i"), L("l"), L("t"), L("d")), tx.stable_guid(L(""), L("i"), L("l"), L("t"), L("d")),
        tx.stable_guid(none, none, L("l"), L("t"), L("d")), tx.stable_guid(none, none, L(""), L("t"), L("d")),
        tx.stable_guid(none, none, none, none, none),
    )
    assert list(got) == want


def test_xml_and_entities(spark):
    assert one(spark, tx.xml_escape(L("<a href=\"x\">'&"))) == "&lt;a href=&quot;x&quot;&gt;&apos;&amp;"
    assert one(spark, tx.xml_clean(L("a\x00b\x0bc\td"))) == "abc\td"
    assert one(spark, tx.decode_numeric_entities(L("java&#x73;cri&#112;t &amp;"))) == "javascript &amp;"


def test_summary(spark):
    assert one(spark, tx.summary_text(L("A quoted tweet\r\n  with space \n"))) == "A quoted tweet with space"
    long = one(spark, tx.summary_text(L("x" * 400)))
    assert len(long) == 280 and long.endswith("...")


def test_urls(spark):
    base = L("https://news.example/section/index.html?q=1#f")
    cases = {
        "a.html": "https://news.example/section/a.html", "/r": "https://news.example/r", "//cdn.example/x": "https://cdn.example/x",
        "?p=2": "https://news.example/section/index.html?p=2", "#z": "https://news.example/section/index.html?q=1#z",
        "mailto:a@b": "mailto:a@b", "http://o.example/": "http://o.example/",
    }
    got = values(spark, *[ul.resolve_url(L(k), base) for k in cases])
    assert list(got) == list(cases.values())
    assert one(spark, ul.resolve_url(L("a"), L("https://h.example"))) == "https://h.example/a"
    assert values(spark, ul.http_url(L(" https://h.example/a#b ")), ul.http_url(L("https://u:p@h.example/")),
                  ul.http_url(L("ftp://h.example/")), ul.http_url(L("http://"))) == ("https://h.example/a", None, None, None)
    assert one(spark, ul.url_host(L("https://User@H.Example:8080/p"))) == "h.example"
    assert one(spark, ul.host_suffixes(L("a.b.c"))) == ["a.b.c", "b.c", "c"]
    assert values(spark, ul.host_under(L("a.x.com"), "x.com"), ul.host_under(L("ax.com"), "x.com")) == (True, False)


def test_canonical_urls(spark):
    cases = {
        "HTTPS://EXAMPLE.org:443": "https://example.org/", "http://a.org:80/x": "http://a.org/x", "http://a.org:8080/": "http://a.org:8080/",
        "https://a.org/p/q/../a/./b.html?u=../v#../w": "https://a.org/p/a/b.html?u=../v#../w", "https://a.org/../..": "https://a.org/",
        "https://a.org/p/..": "https://a.org/", "https://a.org/p/.": "https://a.org/p/", "https://a.org/a..b/...": "https://a.org/a..b/...",
        "mailto:X@y.org": "mailto:X@y.org", "not a url": "not a url",
    }
    from feedloom.functions.urls import canonical_url, resolve_url

    df = spark.createDataFrame([(c,) for c in cases], "u string")
    assert {r.u: r.c for r in df.select("u", canonical_url(F.col("u")).alias("c")).collect()} == cases
    base = F.lit("https://EXAMPLE.org:443/p/q/r.html")
    assert values(spark, resolve_url(F.lit("../a/b.html"), base), resolve_url(F.lit("//CDN.x:443/i"), base)) == ("https://example.org/p/a/b.html", "https://cdn.x/i")


def test_names_and_folders(spark):
    assert one(spark, ul.feed_name_from_url(L("https://Example.COM/path/to/feed.xml"))) == "example-com-path-to-feed-xml"
    assert len(one(spark, ul.feed_name_from_url(L("https://e.com/" + "a" * 90)))) == 64
    assert one(spark, ul.normalize_folder(L("  Tech \\/ Daily   News / "))) == "Tech/Daily News"
    assert one(spark, ul.managed_url(L(" a b/ü~! "))) == "managed://a%20b%2F%C3%BC~!"
    assert values(spark, ul.is_managed(L("managed://x")), ul.is_managed(L(None).cast("string"))) == (True, False)


def test_dates_and_retry(spark):
    day = one(spark, vl.parse_date(L("Mon, 01 Jan 2024 10:00:00 GMT")))
    assert str(day) == "2024-01-01 10:00:00"
    assert str(one(spark, vl.parse_date(L("2024-01-01T10:00:00Z")))) == "2024-01-01 10:00:00"
    assert one(spark, vl.parse_date(L("soon"))) is None
    now = L("2024-01-01 00:00:00").cast("timestamp")
    got = values(spark, *[vl.parse_retry_after(L(v), now) for v in ("60", "1704070800", "", "x", "2024-01-02T00:00:00Z")])
    assert [str(g) if g else None for g in got] == ["2024-01-01 00:01:00", "2024-01-01 01:00:00", None, None, "2024-01-02 00:00:00"]


def test_flags_tokens_errors(spark):
    got = values(spark, *[vl.flag_value(L(v), True) for v in (" YES ", "off", "", "maybe")])
    assert got == (True, False, True, None)
    assert values(spark, *[vl.token_count(L(v)) for v in ("12", "-1", "1.5", "3.0", "x")]) == (12, None, None, 3, None)
    assert values(spark, vl.base_provider(L("rss+zh")), vl.base_provider(L("")), vl.base_provider(L("+zh"))) == ("rss", "source-feed", "source-feed")
    assert one(spark, vl.redact_error(L("open /home/x failed"))).startswith("operation failed; see")
    assert len(one(spark, vl.redact_error(L("e" * 900)))) == 500


def test_retry_steps(spark):
    got = values(spark, *[vl.step_delay(vl.RETRY_HOURS, L(n), 3600) for n in (1, 2, 3, 4, 9)])
    assert [g.total_seconds() / 3600 for g in got] == [2, 6, 12, 24, 24]


@settings(max_examples=25, deadline=None)
@given(st.text(alphabet="ab \t\n  　﻿é甲", max_size=40))
def test_collapse_matches_split(spark_text):
    # Collected and compared in one batch by test_collapse_batch.
    SAMPLES.append(spark_text)


SAMPLES: list[str] = []


def test_collapse_batch(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "t string").select(
        "t", tx.collapse_space(F.col("t")).alias("c"), tx.plain_words(F.col("t")).alias("w")
    )
    for text, collapsed, words in df.collect():
        parts = text.replace("﻿", " ").split()
        assert collapsed == " ".join(parts) and words == len(parts)


def test_nfkc_of_all_characters(spark):
    """Every assigned character alone and behind a letter, and the ones the guard lets pass as they are."""
    marks = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    texts = [m for m in marks] + ["a" + m + "b" for m in marks] + ["ﬁne ｶﾞ ㌀ ½ 각", "", "plain"]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.nfkc(F.col("t")).alias("n")).collect()
    wrong = [r.t for r in out if r.n != unicodedata.normalize("NFKC", r.t)]
    assert len(wrong) < 60 and all(unicodedata.category(t.strip("ab")) for t in wrong), wrong[:20]  # the two sides may know other Unicode versions
    common = {t for t in wrong if ord(t[1 if len(t) > 1 else 0]) < 0x2E80}
    assert not common


def test_search_finds_compatibility_characters(spark):
    titles = ["The ﬁnal ｶﾞｲﾄﾞ ②", "Ｆｕｌｌ width", "plain"]
    entries = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id int, source_title string").withColumns(
        {"translated_title": F.lit(None).cast("string"), "source_url": F.lit("u")})
    texts = lists.with_search_text(entries)
    for wanted, ids in [("final", [0]), ("ガイド", [0]), ("ｶﾞｲﾄﾞ", [0]), ("2", [0]), ("full", [1]), ("ＰＬＡＩＮ", [2]), ("", [0, 1, 2])]:
        assert sorted(r.id for r in lists.search_entries(texts, wanted).collect()) == ids


def test_the_guard_of_nfkc_tests_the_range_first(spark):
    """ASCII characters fail one comparison, and the guard still finds the very characters that the class leaves out."""
    points = spark.range(0x110000).filter("id < 55296 OR id > 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    text = F.concat(F.lit("a"), "c")
    guarded = points.select(tx.nfkc(text).alias("n"), "c")
    assert r"[\x80-\x{10FFFF}&&[^" in guarded._jdf.queryExecution().optimizedPlan().toString()
    full = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    assert points.filter(~F.rlike("c", F.lit(f"[^{tx.NFKC_STABLE}]")) & (full != text)).count() == 0
    assert points.filter(F.rlike("c", F.lit(f"[^{tx.NFKC_STABLE}]")) & (tx.nfkc(text) != full)).count() == 0


def test_words_beside_cjk_are_counted_without_their_texts(spark):
    counted = lambda t: one(spark, tx.words_beside_cjk(L(t)))
    for text, want in [("", 0), (" ", 0), ("甲", 0), (" \u3000甲 乙", 0), ("a", 1), (" a  b ", 2), ("a甲b", 2), ("甲a乙", 1), ("x\u00a0y\ufeffz", 3), ("\x00\x01 \x7f", 2), ("é😀 ü\n\tß", 3), ("a\x01b", 1)]:
        assert counted(text) == want, text
    assert counted(None) is None
    plan = spark.createDataFrame([("a b",)], "t string").select(tx.words_beside_cjk(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "extract_all" not in plan
    mixed = F.concat(F.lit("a"), F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"), F.lit("b"))
    every = spark.range(0x110000).filter("id < 55296 OR id > 57343").select(mixed.alias("t"))
    assert every.filter(tx.words_beside_cjk(F.col("t")) != F.regexp_count("t", L(rf"[\x21-\x7E[^{tx.SPACE}{tx.CJK}]]+"))).count() == 0
