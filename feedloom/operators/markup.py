"""Markup audits of pages by patterns, inside the row of each page: tags, attributes, links, image sets, lead images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.functions import urls as ul

# Elements that are kept, and elements that are removed with their content.
ALLOWED_TAGS = """
a abbr address article aside b bdi bdo blockquote br caption cite code col colgroup dd del details dfn div dl dt em
figcaption figure h1 h2 h3 h4 h5 h6 hr i img ins kbd li main mark ol p picture pre q rp rt ruby s samp section small
source span strong sub summary sup table tbody td tfoot th thead time tr u ul var wbr
""".split()
DANGEROUS_TAGS = """
applet audio base button canvas embed fieldset form frame frameset iframe input link math meta noscript object optgroup
option script select style svg template textarea track video
""".split()
# Protocols of links and of resources, and the relation tokens every link needs.
LINK_SCHEMES = ("http", "https", "mailto", "tel")
RESOURCE_SCHEMES = ("http", "https")
REQUIRED_REL = ("noopener", "noreferrer")
SAFE_REL = ("nofollow", "noopener", "noreferrer", "sponsored", "ugc")
# Attributes that any kept element may have, and those of single elements.
ANY_ATTRIBUTES = ("class", "dir", "lang", "title")
ELEMENT_ATTRIBUTES = {
    "a": "href hreflang rel target", "col": "span", "colgroup": "span", "del": "datetime", "details": "open",
    "img": "alt height loading src srcset width", "ins": "datetime", "li": "value", "ol": "reversed start type",
    "source": "media sizes src srcset type", "td": "colspan headers rowspan", "th": "abbr colspan headers rowspan scope",
    "time": "datetime",
}
DESCRIPTOR = r"^\S+(?:\s+(?:\d+w|(?:\d+(?:\.\d+)?|\.\d+)x))?$"


def found(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


# An attribute's value with its quotes, or without any.
VALUE = r"(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"
# Named entities that can hide a protocol.
HIDING_ENTITIES = (("&colon;", ":"), ("&Tab;", ""), ("&NewLine;", ""), ("&sol;", "/"))


def unquoted(value: Column) -> Column:
    return F.when(F.rlike(value, F.lit("^[\"']")), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


# A start tag; a `>` inside quotes does not end it. The bound keeps the matcher's stack small: a tag of more quoted values is read as text.
TAG = r"(<[a-zA-Z][^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*){0,200}>)"
ATTRIBUTE = r"([^\s\"'<>/=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]*))?)"


def start_tags(html: Column) -> Column:
    """Start tags in order: (tag, attributes: list of (name, value)), names in lower case; no value is an empty one."""
    def read(text: Column) -> Column:
        rest = F.substring(text, F.length(F.regexp_extract(text, "^<[a-zA-Z][a-zA-Z0-9-]*", 0)) + 1, F.length(text))
        attributes = F.transform(found(rest, ATTRIBUTE), lambda a: F.struct(
            F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)).alias("name"), unquoted(F.regexp_extract(a, r"^[^\s=]+\s*=\s*([\s\S]*)$", 1)).alias("value")))
        return F.struct(F.lower(F.regexp_extract(text, "^<([a-zA-Z][a-zA-Z0-9-]*)", 1)).alias("tag"), attributes.alias("attributes"))

    return F.transform(found(html, TAG), read)


def values_of(tag: Column, name: str) -> Column:
    """Value of the first attribute of this name; null if there is none."""
    return F.get(F.filter(tag["attributes"], lambda a: a["name"] == name), F.lit(0))["value"]


def disallowed_attributes(tags: Column) -> Column:
    """`element@attribute` of each attribute, once per tag, that a kept element may not have."""
    allowed = [f"{tag}@{name}" for tag, names in ELEMENT_ATTRIBUTES.items() for name in names.split()]

    def bad(tag: Column) -> Column:
        names = F.array_distinct(F.transform(tag["attributes"], lambda a: a["name"]))
        wrong = F.filter(names, lambda n: ~n.isin(*ANY_ATTRIBUTES) & ~F.concat(tag["tag"], F.lit("@"), n).isin(*allowed))
        return F.transform(wrong, lambda n: F.concat(tag["tag"], F.lit("@"), n))

    return F.flatten(F.transform(F.filter(tags, lambda t: t["tag"].isin(*ALLOWED_TAGS)), bad))


def attribute_values(html: Column, name: str) -> Column:
    return F.transform(found(html, rf"(?i)\s{name}\s*=\s*{VALUE}"), unquoted)


def decoded_value(value: Column) -> Column:
    text = tx.decode_numeric_entities(value)
    for entity, character in HIDING_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return F.regexp_replace(text, r"[\t\r\n]|^ +| +$", "")


def count_in(names: Column, wanted: list[str]) -> Column:
    listed = F.array(*[F.lit(w) for w in wanted])
    return F.size(F.filter(names, lambda n: F.array_contains(listed, n))).cast("bigint")


def count_of(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(pattern)).cast("bigint")


def html_tag_audit(pages: DataFrame, html: str = "html") -> DataFrame:
    """Counts of elements and attributes per page: kept, removed and unknown elements, event handlers, styles and comments; attributes that
    kept elements may not have, as a number and as a list of `element@attribute`; relation tokens and targets of links that are not kept."""
    h = F.col(html)
    tagged = pages.withColumns({
        "_tags": F.transform(found(h, r"<([a-zA-Z][a-zA-Z0-9-]*)"), lambda t: F.lower(t)), "_read": start_tags(h),
    })
    tagged = tagged.withColumns({"_bad": disallowed_attributes(F.col("_read")), "_anchors": F.filter("_read", lambda t: t["tag"] == "a")})
    tokens = F.flatten(F.transform("_anchors", lambda t: F.array_distinct(F.split(F.lower(F.coalesce(values_of(t, "rel"), F.lit(""))), r"\s+"))))
    targets = F.filter("_anchors", lambda t: F.coalesce(F.lower(values_of(t, "target")) != "_blank", F.lit(False)))
    return tagged.withColumns({
        "disallowed_count": F.size("_bad").cast("bigint"), "disallowed": F.array_join(F.array_sort(F.array_distinct("_bad")), ","),
        "bad_rel": F.size(F.filter(tokens, lambda t: (t != "") & ~t.isin(*SAFE_REL))).cast("bigint"), "bad_targets": F.size(targets).cast("bigint"),
        "allowed": count_in(F.col("_tags"), ALLOWED_TAGS), "dangerous": count_in(F.col("_tags"), DANGEROUS_TAGS),
        "handlers": count_of(h, r"(?i)\son[a-z]+\s*="), "styles": count_of(h, r"(?i)\s(?:style|srcdoc)\s*="),
        "comments": count_of(h, r"<!--"),
        "unknown": (F.size("_tags") - F.size(F.filter("_tags", lambda t: F.array_contains(
            F.array(*[F.lit(w) for w in ALLOWED_TAGS + DANGEROUS_TAGS]), t)))).cast("bigint"),
    }).drop("_tags", "_read", "_bad", "_anchors", html)


# References whose scheme and host are those of the page, and addresses whose scheme and host stand in usual form
OF_PAGE = r"^(?:/(?![/\\])|[?#]|[A-Za-z0-9_.%~-]+(?:[/?#]|$))"
USUAL = r"^https?://(?:[a-z0-9-]+\.){1,20}[a-z][a-z0-9-]*(?:[/?#]|$)"


def safe_links(values: Column, base: Column, page: Column, schemes: tuple[str, ...]) -> Column:
    """Struct (scheme, host, safe) per attribute value, resolved against the page; `page` has the scheme and host of its address.

    Most values are of the page or in usual form; only the others are resolved."""
    # Each step binds its result to a lambda variable, which keeps the expressions small.
    hidden = F.transform(values, lambda v: F.when(F.rlike(v, F.lit(r"[&\t\r\n ]")), decoded_value(v)).otherwise(v))

    def parts(url: Column) -> Column:
        return F.struct(ul.url_scheme(url).alias("scheme"), ul.url_host(url).alias("host"))

    def resolved(v: Column) -> Column:
        usual = F.struct(F.substring_index(v, ":", 1).alias("scheme"), F.regexp_extract(v, "^https?://([^/?#]+)", 1).alias("host"))
        slow = F.get(F.transform(F.array(ul.resolve_url(v, base)), parts), F.lit(0))
        return F.when(page.isNotNull() & F.rlike(v, F.lit(OF_PAGE)), page).when(F.rlike(v, F.lit(USUAL)), usual).otherwise(slow)

    return F.transform(
        F.transform(hidden, resolved),
        lambda p: F.struct(p["scheme"].alias("scheme"), p["host"].alias("host"), p["scheme"].isin(*schemes).alias("safe")),
    )


def count_where(links: str, test) -> Column:
    return F.size(F.filter(links, lambda link: F.coalesce(test(link), F.lit(False)))).cast("bigint")


def html_link_audit(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    h, base, page = F.col(html), F.col(url), F.col("_page")
    home = F.struct(ul.url_scheme(base).alias("scheme"), ul.url_host(base).alias("host"))
    pages = pages.withColumn("_page", F.when(F.rlike(base, F.lit(USUAL)), home))
    srcset = F.flatten(F.transform(attribute_values(h, "srcset"), lambda v: F.transform(
        F.split(v, ","), lambda c: tx.trim_space(c))))
    read = pages.withColumns({
        "_href": safe_links(attribute_values(h, "href"), base, page, LINK_SCHEMES),
        "_src": safe_links(attribute_values(h, "src"), base, page, RESOURCE_SCHEMES),
        "_set": srcset, "_host": ul.url_host(base),
        "_anchor": F.transform(found(h, r"(?i)(<a\s[^>]*>)"), lambda a: F.lower(F.coalesce(_attr(a, "rel"), F.lit("")))),
    })
    read = read.withColumn("_set_links", safe_links(
        F.transform("_set", lambda c: F.regexp_extract(c, r"^(\S+)", 1)), base, page, RESOURCE_SCHEMES))
    bad_set = F.size(F.filter(
        F.arrays_zip("_set", "_set_links"),
        lambda c: ~F.rlike(c["_set"], F.lit(DESCRIPTOR)) | ~F.coalesce(c["_set_links"]["safe"], F.lit(False)),
    )).cast("bigint")
    required = F.array(*[F.lit(t) for t in REQUIRED_REL])
    rel_missing = F.aggregate(
        "_anchor", F.lit(0).cast("bigint"),
        lambda acc, rel: acc + F.size(F.array_except(required, F.split(rel, r"\s+"))).cast("bigint"),
    )
    return read.withColumns({
        "links": F.size("_href").cast("bigint"), "resources": F.size("_src").cast("bigint"),
        "unsafe_links": count_where("_href", lambda link: ~link["safe"]),
        "unsafe_resources": count_where("_src", lambda link: ~link["safe"]),
        "same_host_links": count_where("_href", lambda link: link["host"] == F.col("_host")),
        "mail_or_phone": count_where("_href", lambda link: link["scheme"].isin("mailto", "tel")),
        "rel_tokens_missing": rel_missing, "image_candidates": F.size("_set").cast("bigint"),
        "bad_image_candidates": bad_set,
    }).drop("_href", "_src", "_set", "_set_links", "_host", "_page", "_anchor", html, url)


def _attr(tag: Column, name: str) -> Column:
    return tx.blank_to_null(unquoted(F.regexp_extract(tag, rf"(?i)\s{name}\s*=\s*{VALUE}", 1)))


def _meta(html: Column, attribute: str, name: str) -> Column:
    """Content of the first meta tag of this name that has one, whatever the order and quotes of its attributes."""
    named = F.filter(found(html, r"(?i)(<meta\s[^>]*>)"), lambda t: F.coalesce(F.lower(_attr(t, attribute)) == name, F.lit(False)))
    contents = F.transform(named, lambda t: _attr(t, "content"))
    return F.get(F.filter(contents, lambda c: c.isNotNull()), F.lit(0))


def lead_image_per_page(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Best image per page: social meta tags first, then the first image inside the article or main element."""
    h = F.col(html)
    areas = found(h, r"(?is)(<article[\s>].*?</article>|<main[\s>].*?</main>)")
    with_image = F.get(F.filter(areas, lambda a: F.rlike(a, F.lit("(?i)<img[^>]*>"))), F.lit(0))
    read = pages.withColumns({
        "_social": F.coalesce(_meta(h, "property", "og:image"), _meta(h, "name", "twitter:image"), _meta(h, "property", "twitter:image")),
        "_social_alt": F.coalesce(
            _meta(h, "property", "og:image:alt"), _meta(h, "name", "twitter:image:alt"),
            _meta(h, "property", "twitter:image:alt"), _meta(h, "property", "og:title"), F.lit("")),
        "_tag": F.regexp_extract(F.coalesce(with_image, F.lit("")), "(?i)(<img[^>]*>)", 1),
    })
    tag = F.col("_tag")
    set_head = tx.blank_to_null(F.regexp_extract(F.coalesce(_attr(tag, "srcset"), _attr(tag, "data-srcset"), F.lit("")), r"^\s*([^\s,]+)", 1))
    inner = F.coalesce(_attr(tag, "src"), _attr(tag, "data-src"), _attr(tag, "data-original"), set_head)
    picked = read.withColumns({
        "_src": F.coalesce("_social", inner),
        "origin": F.when(F.col("_social").isNotNull(), F.lit("meta")).when(inner.isNotNull(), F.lit("body")),
        "alt": F.when(F.col("_social").isNotNull(), F.col("_social_alt")).otherwise(F.coalesce(_attr(tag, "alt"), F.lit(""))),
    })
    return picked.filter("_src IS NOT NULL").withColumn("src", ul.resolve_url(F.col("_src"), F.col(url))).drop(
        "_social", "_social_alt", "_tag", "_src", html, url
    )
