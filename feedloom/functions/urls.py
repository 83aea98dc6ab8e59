"""URL, folder and domain helpers on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedloom.functions.text import normalize_ws, trim_space

MANAGED_PREFIX = "managed://"
SCHEME = "^([A-Za-z][A-Za-z0-9+.-]*):"
AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)"


def url_scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, SCHEME, 1))


def url_host(c: Column) -> Column:
    """Lower-case host, NULL when the value is not an absolute URL with a host."""
    host = F.regexp_replace(F.regexp_extract(c, AUTHORITY, 1), "^.*@|:[0-9]*$", "")
    return F.nullif(F.lower(host), F.lit(""))


def url_path(c: Column) -> Column:
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)", 1)
    return F.when(path == "", F.lit("/")).otherwise(path)


def without_fragment(c: Column) -> Column:
    return F.regexp_replace(c, "#.*$", "")


def without_dots(path: Column) -> Column:
    """A path without `.` and `..` segments; one that ends in such a segment ends in a slash."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, part: F.when(part == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1))))
        .when(part == ".", done).otherwise(F.array_append(done, part)),
    )
    slash = F.element_at(parts, -1).isin(".", "..")
    joined = F.array_join(F.when(slash, F.array_append(kept, F.lit(""))).otherwise(kept), "/")
    return F.when(F.rlike(path, F.lit(r"(^|/)\.\.?(/|$)")), joined).otherwise(path)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value evaluated once: as an expression it stands in the plan once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def canonical_url(c: Column) -> Column:
    """An absolute http(s) URL in its usual form: scheme and host in lower case, no default port, a path, no dot
    segments. Anything else stays as it is."""

    def cut(url: Column) -> Column:
        start = F.regexp_extract(url, AUTHORITY, 0)
        return F.struct(url.alias("url"), url_scheme(url).alias("scheme"), F.regexp_extract(url, AUTHORITY, 1).alias("authority"),
                        F.substring(url, F.length(start) + 1, F.length(url)).alias("rest"))

    def whole(p: Column) -> Column:
        user = F.regexp_extract(p["authority"], "^(.*@)", 1)
        host = F.lower(F.substring(p["authority"], F.length(user) + 1, F.length(p["authority"])))
        host = F.regexp_replace(host, F.when(p["scheme"] == "https", ":(443)?$").otherwise(":(80)?$"), F.lit(""))
        path = F.regexp_extract(p["rest"], "^([^?#]*)", 1)
        tail = F.substring(p["rest"], F.length(path) + 1, F.length(p["rest"]))
        plain = F.when(path == "", F.lit("/")).otherwise(F.replace(path, F.lit("\\"), F.lit("/")))
        usual = F.concat(p["scheme"], F.lit("://"), user, host, bound(plain, without_dots), tail)
        return F.when(p["scheme"].isin("http", "https") & (p["authority"] != ""), usual).otherwise(p["url"])

    return bound(bound(c, cut), whole)


def http_url(c: Column) -> Column:
    """The canonical URL without its fragment when it is http(s) with a host and without user info, else NULL."""

    def checked(url: Column) -> Column:
        authority = F.regexp_extract(url, AUTHORITY, 1)
        ok = url_scheme(url).isin("http", "https") & url_host(url).isNotNull() & ~F.rlike(authority, F.lit(r"[@\s]"))
        return F.when(ok, without_fragment(canonical_url(url)))

    return bound(trim_space(c), checked)


def resolve_url(value: Column, base: Column) -> Column:
    """Canonical absolute form of `value` against `base`; an unusable base keeps the value."""

    def joined(pair: Column) -> Column:
        v, b = pair["v"], pair["b"]
        origin = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
        folder = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(?:/[^?#]*/|/)?)", 1)
        folder = F.regexp_replace(folder, "([^/])$", "$1/")
        document = F.regexp_extract(b, "^([^?#]*)", 1)
        return (
            F.when(F.rlike(v, F.lit(SCHEME)) | (origin == "") | (v == ""), v)
            .when(F.startswith(v, F.lit("//")), F.concat(url_scheme(b), F.lit(":"), v))
            .when(F.startswith(v, F.lit("/")), F.concat(origin, v))
            .when(F.startswith(v, F.lit("#")), F.concat(without_fragment(b), v))
            .when(F.startswith(v, F.lit("?")), F.concat(document, v))
            .otherwise(F.concat(folder, v))
        )

    return canonical_url(bound(F.struct(value.alias("v"), base.alias("b")), joined))


def host_under(host: Column, domain: str | Column) -> Column:
    domain = F.lit(domain) if isinstance(domain, str) else domain
    return (host == domain) | F.endswith(host, F.concat(F.lit("."), domain))


def host_suffixes(host: Column) -> Column:
    """a.b.c -> [a.b.c, b.c, c]: longest first, so a domain rule lookup becomes an equality."""
    labels = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def normalize_folder(c: Column) -> Column:
    parts = F.split(normalize_ws(c), r"[\\/]+")
    return F.array_join(F.filter(F.transform(parts, lambda part: normalize_ws(part)), lambda part: part != ""), "/")


def feed_name_from_url(c: Column) -> Column:
    seed = F.regexp_replace(F.lower(F.concat(url_host(c), url_path(c))), "[^a-z0-9]+", "-")
    name = F.substring(F.regexp_replace(seed, "^-+|-+$", ""), 1, 64)
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("feed"))


def managed_url(name: Column, prefix: str = MANAGED_PREFIX) -> Column:
    filled = F.coalesce(F.nullif(trim_space(name), F.lit("")), F.lit("feed"))
    encoded = F.url_encode(filled)
    # Form encoding and component encoding differ in these signs only.
    for form, component in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(component))
    return F.concat(F.lit(prefix), encoded)


def is_managed(url: Column, prefix: str = MANAGED_PREFIX) -> Column:
    return F.startswith(F.coalesce(url, F.lit("")), F.lit(prefix))
