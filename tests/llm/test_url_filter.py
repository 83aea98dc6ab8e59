import random
import re

import pytest
from pyspark.sql import functions as F

from feedloom.llm import bloom, storage, url_filter
from feedloom.llm.bloom import blocked_filter, possible
from feedloom.llm.url_filter import canonical_url, judge_urls, op12, rule_table

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return host.translate(str.maketrans(ALPHABET, ALPHABET.lower())), re.match(r"[^?#]*", rest[len(host):]).group()


def form(url):
    if url is None or "://" not in url:
        return None
    host, path = parts(url)
    host = host.rsplit("@", 1)[-1]
    host = re.sub(r":(80|443)?\Z", "", host)
    host = host[:-1] if host.endswith(".") else host
    host = host.removeprefix("www.")
    asked = re.search(r"\A[^?#]*\?([^#]*)", url.split("://", 1)[1])
    kept = sorted(p for p in (asked.group(1).split("&") if asked else []) if p and not re.match(r"(utm_[^=]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid)(=|\Z)", p))
    return host + (path.rstrip("/") or "/") + ("?" + "&".join(kept) if kept else "")


def judge(url, listed, rules):
    host, path = parts(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        return max(fits)[2:]
    return None, "block" if form(url) is not None and form(url) in listed else "allow"


def urls():
    r = random.Random(5)
    hosts = ["com", "example.com", "www.example.com", "a.www.example.com", "EXAMPLE.com", "notexample.com", "b.net", "net", "x.org", "www.x.org", "u:p@x.org", "x.org:80", "x.org:8080", "x.org.", "..com", "", "ÄÖ.org"]
    tails = ["", "/", "/en/", "/en", "/en/1", "/en/1/", "//", "/es/9?b=2&a=1", "/es/9?a=1&b=2&utm_source=q", "/fr/?ref=x#y", "?q=://", "#/en/", "/a b\n/c", "/é?x&&y", "/en/../es/"]
    made = [r.choice(["http", "https", "HTTP", ""]) + "://" + r.choice(hosts) + r.choice(tails) for _ in range(400)]
    return made + [None, "", "no scheme", "mailto:a@b.c", "http:/x.org/", "://", "a://b://c/en/", "http://" + "s." * 3000 + "net/es/" + "x" * 50000] + ["https://b.net/es/1"] * 300


@pytest.mark.parametrize("most", [20_000, 0])
def test_verdicts_are_those_of_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(storage, "BROADCAST_ROWS", most)
    given = urls()
    listed = [u for k, u in enumerate(given) if k % 3 == 0] + [None, None]
    known = {form(u) for u in listed} - {None}
    rules = [*url_filter.RULES, ("org", "/a", "block"), ("x.org", "", "allow"), ("b.net", "/es/1", "allow")]
    pages = spark.createDataFrame([(k, u, "h", 1, "b") for k, u in enumerate(given)], "page_id long, url string, host string, same int, block string")
    out = judge_urls(pages, spark.createDataFrame([(u,) for u in listed], "address string"), rule_table(spark, tuple(rules)), spread="page_id").collect()
    assert sorted(r.page_id for r in out) == list(range(len(given)))
    for r in out:
        assert (r.host, r.path) == parts(given[r.page_id]) and r.canonical == form(given[r.page_id])
        assert (r.rule, r.verdict) == judge(given[r.page_id], known, rules), given[r.page_id]
        assert (r.same, r.block) == (1, "b")
    assert {(r.rule is None, r.verdict) for r in out} == {(True, "allow"), (True, "block"), (False, "allow"), (False, "block")}


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    """The largest size reached: nearly every key passes, and the exact join still decides."""
    pages = spark.createDataFrame([(k, f"http://h{k % 50}.org/{k}") for k in range(3000)], "page_id long, url string")
    listed = pages.filter("page_id % 2 = 0").select("url")
    monkeypatch.setattr(bloom, "MOST_BLOCKS", 2)
    out = judge_urls(pages, listed, rule_table(spark)).collect()
    assert len(out) == 3000 and all(r.verdict == ("block" if r.page_id % 2 == 0 else "allow") for r in out)


def test_filter_passes_all_listed_and_few_others(spark):
    keys = spark.range(20000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    blocks = 20000 // bloom.KEYS_PER_BLOCK
    made = blocked_filter(keys.filter("key < 'k2'"), blocks)
    kept = {r.key for r in possible(keys, made, blocks).collect()}
    inside = {r.key for r in keys.filter("key < 'k2'").collect()}
    assert inside <= kept
    assert len(kept - inside) < 0.02 * (20000 - len(inside))


def test_canonical_forms_meet(spark):
    same = ["http://www.X.org/a/?b=1&a=2", "https://x.org:443/a?a=2&b=1&utm_medium=m#f", "//u@x.org./a//?&a=2&b=1".replace("//u", "s://u", 1)]
    assert {r[0] for r in spark.createDataFrame([(u,) for u in same], "u string").select(canonical_url(F.col("u"))).collect()} == {"x.org/a?a=2&b=1"}


def test_nothing_listed_no_rules_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (1, "http://a.com/"), (None, None)], "page_id long, url string")
    none, no_rules = spark.createDataFrame([], "url string"), spark.createDataFrame([(None, "/", "block"), ("", "/", "block"), ("com", None, "block"), ("com", "/", None)], url_filter.RULE_TYPE)
    assert [r.verdict for r in judge_urls(pages, none, no_rules).collect()] == ["allow"] * 3
    assert judge_urls(pages.limit(0), none, no_rules).count() == 0


def test_query_against_brute_force(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    listed = {form(r.url) for r in pages if re.search(url_filter.UNWANTED, parts(r.url)[0])}
    out = {r.page_id: r for r in op12(spark, small).collect()}
    assert len(out) == len(pages)
    for r in pages:
        assert (out[r.page_id].rule, out[r.page_id].verdict) == judge(r.url, listed, url_filter.RULES)
