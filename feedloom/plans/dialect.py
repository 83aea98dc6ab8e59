"""Pieces of checking SQL (DuckDB) for the column helpers."""

# Written out here, so that a wrong list in the library shows as a difference. White space, ideographs, full-width ASCII
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WIDE_SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
CJK = r"\x{3400}-\x{9FFF}"
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_SQL = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
HOST_OF = r"""NULLIF(lower(regexp_replace(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@|:[0-9]*$', '', 'g')), '')"""
PATH_OF = r"""(CASE WHEN regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)', 1) = '' THEN '/'
  ELSE regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*([^?#]*)', 1) END)"""
HOST = HOST_OF.format("url")
PATH = PATH_OF.format("url")


def host(x: str) -> str:
    return HOST_OF.format(x)


def path(x: str) -> str:
    return PATH_OF.format(x)


def fold(x: str) -> str:
    return f"translate({x}, '{FULL_WIDTH}', '{HALF_SQL}')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{SPACE}]+', ' ', 'g'))"


def norm(x: str) -> str:
    return f"trim(regexp_replace({fold(f'COALESCE({x}, chr(32))')}, '[{WIDE_SPACE}]+', ' ', 'g'))"


def trim_space(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def strip(x: str) -> str:
    text = f"COALESCE({x}, '')"
    for block in ("script", "style"):
        text = rf"regexp_replace({text}, '<{block}[\s\S]*?</{block}>', ' ', 'gi')"
    text = f"regexp_replace({text}, '<[^>]+>', ' ', 'g')"
    text = f"regexp_replace({text}, '&nbsp;', ' ', 'gi')"
    text = f"regexp_replace({text}, '&amp;', '&', 'gi')"
    return collapse(text)


def truncate(x: str, limit: int) -> str:
    return (f"(CASE WHEN length({x}) > {limit} THEN concat({trim_space(f'substring({x}, 1, {limit - 1})')}, '…') "
            f"ELSE COALESCE({x}, '') END)")


def http_url(x: str) -> str:
    authority = rf"regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1)"
    return (f"(CASE WHEN regexp_matches({x}, '^https?:', 'i') AND {host(x)} IS NOT NULL AND NOT contains({authority}, '@') "
            f"THEN regexp_replace({x}, '#.*$', '') END)")


def plain_words(x: str) -> str:
    return f"len(regexp_extract_all(COALESCE({x}, ''), '[^{SPACE}]+'))"


def mixed_words(x: str) -> str:
    return (f"(len(regexp_extract_all(COALESCE({x}, ''), '[^{SPACE}{CJK}]+')) "
            f"+ CAST(ceil(len(regexp_extract_all(COALESCE({x}, ''), '[{CJK}]')) / 2.0) AS BIGINT))")


def xml_escape(x: str) -> str:
    text = f"COALESCE({x}, '')"
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        text = f"replace({text}, '{raw}', '{entity}')"
    return text
