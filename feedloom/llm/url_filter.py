"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

Keys are listed URLs in canonical form, and rules of a host and the start of a path. The filter is a table of blocks of 512 bits,
built by aggregation; a key sets one bit in each of the eight words of one block. A URL has one key for itself and one for each pair of
a host (its own or one above it) and a start of its path that rules can have. Keys whose bits are not all set are dropped where
they arise; the others, listed keys and a few false positives, meet the list in an exact join. The filter never decides.

The filter has a largest size and is broadcast; a longer list fills it more, so that more keys reach the join, and nothing is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm.bloom import block_count, blocked_filter, possible
from feedloom.llm.storage import free_name, quoted, saved, spread_join

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Parameters that name a campaign or a click, not a page
TRACKING = "utm_[^=]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid"
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
RULE_TYPE = "host string, path string, verdict string"
UNWANTED = "(cheap-pills|free-bets|spam-farm)"


def after_scheme(url: Column) -> Column:
    """What follows the first `://`; null for a null URL or without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"\A([^/?#]*)", 1), CAPITALS, CAPITALS.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_url(url: Column) -> Column:
    """One form for the addresses of a page; null for null or without `://`.

    No scheme, user, default port, leading `www.`, final dot of the host, final slashes of the path, fragment or tracking parameters; other
    parameters are sorted. An empty path is `/`.
    """
    host = F.regexp_replace(host_of(url), r"(?s)\A.*@", "")
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?\z", ""), r"\.\z", "")
    host = F.regexp_replace(host, r"\Awww\.", "")
    path = F.regexp_replace(path_of(url), r"/+\z", "")
    asked = F.regexp_extract(after_scheme(url), r"\A[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&", -1), lambda p: (p != "") & ~p.rlike(rf"\A({TRACKING})(=|\z)")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(F.instr(url, "://") > 0, F.concat(host, F.when(path == "", "/").otherwise(path), query))


def _rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("rule "), host, F.lit(" "), path)


def _keys(urls: DataFrame, labels: int, lengths: list[int]) -> DataFrame:
    """(url, key): a URL's canonical form, and each pair of one of its hosts and one start of its path that a rule may name."""
    labelled = F.split("host", r"\.", -1)
    most = F.least(F.size(labelled), F.lit(labels))
    hosts = F.transform(F.sequence(F.lit(1), most), lambda k: F.array_join(F.slice(labelled, -k, k), "."))
    starts = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    paths = F.transform(starts, lambda n: F.substring("path", F.lit(1), n))
    rules = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: _rule_key(h, p))))
    own = F.array_compact(F.array(F.concat(F.lit("url "), canonical_url(F.col("url")))))
    return urls.select("url", F.explode(F.array_distinct(F.concat(own, rules))).alias("key"))


def judge_urls(pages: DataFrame, listed: DataFrame, rules: DataFrame, url: str = "url", spread: str | None = None) -> DataFrame:
    """`pages` with host, path, canonical, rule and verdict.

    `listed` has URLs in its first column, `rules` (host, path, verdict `allow` or `block`) in its first three. A rule fits its host and all
    subdomains if the URL's path starts with the rule's; the longest decides, of equally long ones the
    one with the longer host, of the same host and path `allow` before `block`. Without a rule a URL is
    blocked if its canonical form is that of a listed one, and else allowed. Nulls in `listed`, and rules with a null or with an empty host, count for
    nothing. A null URL, or one without `://`, has an empty host and path, and a null canonical form; it is allowed. Repeated rows stay, an empty table
    gives an empty result. Columns of `pages` called like a new one give way to it. `spread` names a column that differs between rows of one URL, so that many
    rows of it are dealt over several tasks (the URL itself if none is given).
    """
    listed_url = canonical_url(quoted(listed.columns[0]))
    h, p, v = (quoted(c) for c in rules.columns[:3])
    given = rules.select(F.translate(h, CAPITALS, CAPITALS.lower()).alias("host"), p.alias("path"), v.alias("verdict")).filter("host <> '' AND path IS NOT NULL AND verdict IN ('allow', 'block')")
    list_keys = listed.select(F.concat(F.lit("url "), listed_url).alias("key")).filter("key IS NOT NULL").distinct()
    rule_keys = given.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    keys = saved(
        list_keys.select("key", F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule"), F.lit(0).alias("size"), F.lit(0).alias("host_size")).unionByName(
            rule_keys.select(
                _rule_key(F.col("host"), F.col("path")).alias("key"), "verdict", F.concat("host", "path").alias("rule"),
                (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"),
            )
        ), "url_keys",
    )
    shape = rule_keys.agg(F.max(F.size(F.split("host", r"\.", -1))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()
    blocks = block_count(keys.count())

    urls = saved(pages.select(quoted(url).alias("url")).filter("url IS NOT NULL").distinct(), "urls")
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    hits = saved(possible(_keys(parts, shape.labels or 0, shape.lengths or []), blocked_filter(keys, blocks), blocks), "url_hits")
    met = saved(hits.select("key").distinct().join(keys, "key"), "url_met")
    found = spread_join(hits, met, "key", F.col("url"), "inner")
    best = found.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), F.struct("size", "host_size")).alias("best"))
    rule, verdict = free_name(pages, "rule_found"), free_name(pages, "verdict_found")
    told = saved(best.select(F.col("url").alias(url), F.col("best.rule").alias(rule), F.col("best.verdict").alias(verdict)), "url_verdicts")

    joined = spread_join(pages, told, url, quoted(spread or url))
    new = {
        "host": host_of(quoted(url)), "path": path_of(quoted(url)), "canonical": canonical_url(quoted(url)),
        "rule": F.col(rule), "verdict": F.coalesce(verdict, F.lit("allow")),
    }
    return joined.select(*[quoted(c) for c in pages.columns if c.lower() not in new], *[c.alias(n) for n, c in new.items()])


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), RULE_TYPE)


def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts on all `pages`. Listed are the addresses of pages whose host is named for unwanted goods; the rules are those of the contract."""
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    listed = pages.select("url").filter(host_of(F.col("url")).rlike(UNWANTED))
    return judge_urls(pages, listed, rule_table(spark), spread="page_id").select("page_id", "host", "path", "canonical", "rule", "verdict")


OP12_SQL = r"""
WITH rules(rule_host, rule_path, decision) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), cut AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, url, rest, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|msclkid|mc_cid|mc_eid)(=|$)'))) AS asked
  FROM cut
), forms AS (
  SELECT *, CASE WHEN rest IS NOT NULL THEN
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '\.$', ''), '^www\.', '')
    || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END
    || CASE WHEN len(asked) > 0 THEN '?' || array_to_string(asked, '&') ELSE '' END END AS canonical FROM parts
), listed AS (
  SELECT DISTINCT canonical AS known FROM forms WHERE regexp_matches(host, '(cheap-pills|free-bets|spam-farm)') AND canonical IS NOT NULL
), fits AS (
  SELECT url, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(decision, length(rule_host || rule_path)) AS decision
  FROM (SELECT DISTINCT url, host, path FROM forms) JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY url
)
SELECT f.page_id, f.host, f.path, f.canonical, r.rule, coalesce(r.decision, CASE WHEN l.known IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM forms f LEFT JOIN fits r ON r.url = f.url LEFT JOIN listed l ON l.known = f.canonical
"""
