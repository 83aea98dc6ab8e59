"""Match hosts against domain rules and addresses against blocked ranges."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions.urls import host_suffixes, url_host


def rules_by_domain(rules: Sequence[tuple[str, str]]) -> dict[str, str]:
    """Domain -> value; a later rule of the same domain overrides an earlier one."""
    found: dict[str, str] = {}
    for domain, value in rules:
        domain = domain.strip().lower().removeprefix(".")
        if domain and value.strip():
            found[domain] = value.strip()
    return found


def match_rules(url: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Domain of the most specific rule for a URL, NULL when none matches. For short rule lists: no join, no shuffle."""
    known = rules_by_domain(rules)
    if not known:
        return F.lit(None).cast("string")
    table = F.array(*[F.lit(d) for d in known])
    hits = F.filter(host_suffixes(url_host(url)), lambda suffix: F.array_contains(table, suffix))
    return F.get(hits, F.lit(0))


def rule_value(domain: Column, rules: Sequence[tuple[str, str]]) -> Column:
    known = rules_by_domain(rules)
    if not known:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), domain)


def domain_rule_match(rows: DataFrame, url: str, rules: DataFrame) -> DataFrame:
    """Rows with domain and value of their most specific rule; `rules` has (pos, domain, value) and any size.

    Rules are matched once per distinct host, by equality on the host's suffixes, so a host with very many pages is
    expanded once and no nested-loop join arises."""
    domain = F.regexp_replace(F.lower(F.trim("domain")), r"^\.", "")
    latest = rules.withColumn("domain", domain).filter("domain <> ''").groupBy("domain").agg(
        F.max_by("value", "pos").alias("value")
    )
    hosted = rows.withColumn("_host", url_host(F.col(url)))
    hosts = hosted.select("_host").filter("_host IS NOT NULL").distinct()
    best = (
        hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("domain"))
        .join(latest, "domain")
        .groupBy("_host")
        .agg(F.max_by(F.struct("domain", "value"), F.length("domain")).alias("_rule"))
    )
    joined = hosted.join(best, "_host", "left")
    return joined.select(
        *rows.columns, F.col("_rule.domain").alias("rule_domain"), F.col("_rule.value").alias("rule_value")
    )


# Address ranges that must not be reached from a feed or page URL.
IPV4_BLOCKS = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24",
    "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4",
)
IPV6_BLOCKS = ("100::/64", "2001::/32", "2001:db8::/32", "3fff::/20", "fc00::/7", "fe80::/10", "ff00::/8")
FAKE_IP_RANGE = "198.18.0.0/15"
# Ranges that carry an IPv4 address, and the hex digits (from 1) where it stands.
MAPPED, NAT64, SIX_TO_FOUR = "::ffff:0:0/96", "64:ff9b::/96", "2002::/16"
ALWAYS_BLOCKED_V6 = ("::/96", "64:ff9b:1::/48")
GLOBAL_UNICAST = "2000::/3"


def cidr_block_match(addresses: DataFrame, ip: str, allow_fake: bool = False) -> DataFrame:
    """Addresses (as numbers) with the blocked range they fall into, NULL when reachable.

    The blocks are a fixed list of 15 disjoint ranges: a chain of comparisons, no join."""
    block = F.lit(None).cast("string")
    for net in (ipaddress.IPv4Network(b) for b in IPV4_BLOCKS if not (allow_fake and b == FAKE_IP_RANGE)):
        inside = F.col(ip).between(int(net.network_address), int(net.broadcast_address))
        block = F.when(inside, F.lit(str(net))).otherwise(block)
    return addresses.withColumn("block", block)


DOTTED_TAIL = r"\d{1,3}(?:\.\d{1,3}){3}$"


def ipv4_number(dotted: Column) -> Column:
    """Dotted IPv4 text to a number, NULL when malformed."""
    octets = F.transform(F.split(dotted, r"\."), lambda o: o.try_cast("bigint"))
    return F.aggregate(
        octets, F.lit(0).cast("bigint"), lambda acc, o: F.when(o <= 255, acc * 256 + o),
        lambda acc: F.when(F.size(octets) == 4, acc),
    )


def with_address(rows: DataFrame, address: str) -> DataFrame:
    """Add `ipv4` (number) and `ipv6` (32 hex digits) of an address text, both NULL when it is malformed.

    Zones are cut and a dotted tail is converted. One column per step keeps the plan small: an expression that is used
    many times must be a column before it is used."""
    steps = rows.withColumn("_bare", F.lower(F.substring_index(F.col(address), "%", 1)))
    steps = steps.withColumn("_dotted", F.regexp_extract("_bare", f"({DOTTED_TAIL})", 1))
    steps = steps.withColumn("_number", ipv4_number(F.nullif("_dotted", F.lit(""))))
    steps = steps.withColumn("_tail", F.lower(F.lpad(F.hex("_number"), 8, "0")))
    converted = F.concat(
        F.regexp_replace("_bare", DOTTED_TAIL, ""), F.substring("_tail", 1, 4), F.lit(":"), F.substring("_tail", 5, 4)
    )
    steps = steps.withColumn("_plain", F.when(F.col("_dotted") == "", F.col("_bare")).otherwise(converted))
    steps = steps.withColumns({
        "_short": F.contains("_plain", F.lit("::")),
        "_left": F.filter(F.split(F.substring_index("_plain", "::", 1), ":", -1), lambda g: g != ""),
        "_right": F.filter(F.split(F.regexp_extract("_plain", "::(.*)$", 1), ":", -1), lambda g: g != ""),
    })
    steps = steps.withColumn("_missing", F.lit(8) - F.size("_left") - F.size("_right"))
    zeros = F.array_repeat(F.lit("0"), F.greatest("_missing", F.lit(0)))
    steps = steps.withColumn("_groups", F.concat("_left", F.when(F.col("_short"), zeros).otherwise(F.array().cast("array<string>")), "_right"))
    ok = (
        (F.size("_groups") == 8) & F.forall("_groups", lambda g: F.rlike(g, F.lit("^[0-9a-f]{1,4}$")))
        & (~F.col("_short") | (F.col("_missing") >= 1)) & ~F.rlike("_plain", F.lit(":::|::.*::|^:[^:]|[^:]:$"))
    )
    digits = F.array_join(F.transform("_groups", lambda g: F.lpad(g, 4, "0")), "")
    steps = steps.withColumns({
        "ipv4": F.when(F.col("_dotted") == F.col("_bare"), F.col("_number")), "ipv6": F.when(ok, digits),
    })
    return steps.select(*rows.columns, "ipv4", "ipv6")


def _within(hex32: Column, block: str) -> Column:
    net = ipaddress.IPv6Network(block)
    lo, hi = (f"{int(a):032x}" for a in (net.network_address, net.broadcast_address))
    return hex32.between(lo, hi)


def ipv4_blocked(number: Column, allow_fake: bool = False) -> Column:
    blocks = [ipaddress.IPv4Network(b) for b in IPV4_BLOCKS if not (allow_fake and b == FAKE_IP_RANGE)]
    hit = F.lit(False)
    for net in blocks:
        hit = hit | number.between(int(net.network_address), int(net.broadcast_address))
    return hit


def ipv6_blocked(hex32: Column) -> Column:
    """Not global unicast, in a blocked range, or carrying a blocked IPv4 address."""

    def embedded(start: int) -> Column:
        return F.conv(F.substring(hex32, start, 8), 16, 10).cast("bigint")

    listed = F.lit(False)
    for block in IPV6_BLOCKS:
        listed = listed | _within(hex32, block)
    carried = F.when(_within(hex32, MAPPED) | _within(hex32, NAT64), embedded(25)).when(
        _within(hex32, SIX_TO_FOUR), embedded(5)
    )
    always = _within(hex32, ALWAYS_BLOCKED_V6[0]) | _within(hex32, ALWAYS_BLOCKED_V6[1])
    plain = always | listed | ~_within(hex32, GLOBAL_UNICAST)
    # The carried address takes part in 15 comparisons, so it is bound once.
    found = F.transform(F.array(carried), lambda n: F.when(n.isNull(), plain).otherwise(ipv4_blocked(n)))
    return F.get(found, F.lit(0))


def address_block_match(rows: DataFrame, address: str, allow_fake: bool = False) -> DataFrame:
    """Rows with whether their address text must not be reached; unreadable addresses are blocked."""
    read = with_address(rows, address)
    blocked = (
        F.when(F.col("ipv4").isNotNull(), ipv4_blocked(F.col("ipv4"), allow_fake))
        .when(F.col("ipv6").isNotNull(), ipv6_blocked(F.col("ipv6")))
        .otherwise(True)
    )
    return read.withColumn("blocked", blocked).drop("ipv4", "ipv6")
