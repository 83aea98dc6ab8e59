"""Text helpers on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space classes of the reproduced rules (regular-expression syntax of Java and RE2).
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WIDE_SPACE = SPACE + r"\x{200B}"
SPACE_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
CJK = r"\x{3400}-\x{9FFF}"
# Common characters that NFKC leaves alone and that join with none before them
NFKC_STABLE = r"\x00-\x7F\x{C0}-\x{FF}\x{400}-\x{45F}\x{2012}-\x{2016}\x{2018}-\x{2023}\x{3001}-\x{3029}\x{3041}-\x{3096}\x{30A1}-\x{30FA}\x{4E00}-\x{9FFF}"

# ASCII word boundary, the same on every JVM.
WORD_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_filled(*cols: Column) -> Column:
    """First value that is neither NULL nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def trim_space(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def _collapse(c: Column, space: str) -> Column:
    # Rare spaces first, behind a cheap range test, then runs of blanks: much faster than one pass with the whole class.
    rare = _space_class(space.replace(" ", "")) + "+"
    return F.trim(F.regexp_replace(F.regexp_replace(c, rare, " "), " {2,}", " "))


def collapse_space(c: Column) -> Column:
    return _collapse(c, SPACE)


def nfkc(c: Column) -> Column:
    """Unicode normal form NFKC: ligatures, half and full width, circled digits, composed marks. Texts without a character that it may change skip it.

    It is a call of the Unicode library that Spark ships, in the JVM. Spark counts such a call as non-deterministic, so group and
    join by it only after a projection that holds it was stored or aggregated."""
    normal = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    # The range test comes first, as in `_space_class`: ASCII, most of most texts, never reaches the long class.
    return F.when(F.rlike(c, F.lit(rf"[\x80-\x{{10FFFF}}&&[^{NFKC_STABLE}]]")), normal).otherwise(c)


def normalize_ws(c: Column) -> Column:
    return _collapse(nfkc(F.coalesce(c, F.lit(""))), WIDE_SPACE)


def strip_markup(c: Column) -> Column:
    """Text without script and style blocks and tags, two entities decoded; white space stays as it is. Texts without
    tags or entities skip the passes for them."""
    text = F.coalesce(c, F.lit(""))
    bare = text
    for block in ("script", "style"):
        bare = F.regexp_replace(bare, rf"(?i)<{block}[\s\S]*?</{block}>", " ")
    bare = F.when(F.contains(text, F.lit("<")), F.regexp_replace(bare, "<[^>]+>", " ")).otherwise(text)
    decoded = F.regexp_replace(F.regexp_replace(bare, "(?i)&nbsp;", " "), "(?i)&amp;", "&")
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(bare)


def strip_html(c: Column) -> Column:
    return collapse_space(strip_markup(c))


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, _space_class(SPACE) + "+", "")


def truncate_text(c: Column, limit: int) -> Column:
    text = F.coalesce(c, F.lit(""))
    cut = F.concat(trim_space(F.substring(text, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def derived_title(c: Column, limit: int = 120) -> Column:
    return truncate_text(normalize_ws(c), limit)


def heading_title(c: Column, limit: int = 120) -> Column:
    """Text of the first level-one heading, empty when there is none."""
    return derived_title(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?m)^\s*#\s+(.+?)\s*$", 1), limit)


def summary_text(c: Column) -> Column:
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r?\n+"), lambda line: trim_space(line))
    joined = F.array_join(F.filter(lines, lambda line: line != ""), " ")
    return F.when(F.length(joined) <= 280, joined).otherwise(F.concat(F.substring(joined, 1, 277), F.lit("...")))


def hash_text(c: Column) -> Column:
    return F.sha2(c, 256)


def stable_guid(guid: Column, item_id: Column, link: Column, title: Column, pub_date: Column) -> Column:
    none = F.lit("")
    fallback = F.concat(F.coalesce(title, none), F.lit(":"), F.coalesce(pub_date, none))
    return hash_text(F.coalesce(blank_to_null(guid), blank_to_null(item_id), blank_to_null(link), fallback))


def _space_class(space: str) -> str:
    # The range test comes first: most characters never reach the long class.
    return rf"[\x00-\x20\x7F-\x{{10FFFF}}&&[{space}]]"


def split_words(c: Column) -> Column:
    return F.filter(F.split(c, _space_class(SPACE) + "++"), lambda w: w != "")


def plain_words(c: Column) -> Column:
    """Number of space-separated words. A match count keeps its compiled pattern; a split compiles it for every text."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(rf"[\x21-\x7E[^{SPACE}]]+")).cast("bigint")


def clean_words(c: Column) -> Column:
    """`plain_words` of a text whose white space is collapsed already."""
    return F.when(c == "", F.lit(0)).otherwise(F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1).cast("bigint")


def count_chars(c: Column, chars: str) -> Column:
    """Number of characters of a class, by what is left without them."""
    return (F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]+", ""))).cast("bigint")


def cjk_chars(c: Column) -> Column:
    return count_chars(c, CJK)


def words_beside_cjk(c: Column) -> Column:
    """Number of runs without spaces and CJK characters. What lies between them becomes a blank, then each run one character: no text of
    a run is made, as a count of matches would."""
    runs = F.trim(F.regexp_replace(c, _space_class(SPACE + CJK) + "++", " "))
    return F.length(F.regexp_replace(runs, "[^ ]++ ?+", "x")).cast("bigint")


def weighted(words: Column, cjk: Column) -> Column:
    """One word per two CJK characters, rounded up."""
    return words + F.floor((cjk + 1) / 2).cast("bigint")


def mixed_words(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    return weighted(words_beside_cjk(text), cjk_chars(text))


def search_text(translated_title: Column, source_title: Column, source_url: Column) -> Column:
    return F.lower(normalize_ws(F.concat_ws(" ", translated_title, source_title, source_url)))


def xml_escape(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    # The five predefined entities, ampersand first.
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def xml_clean(c: Column) -> Column:
    """Drop characters that XML 1.0 does not allow."""
    legal = r"\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}"
    return F.regexp_replace(c, f"[^{legal}]", "")


def decode_numeric_entities(c: Column) -> Column:
    """Replace &#NN; and &#xNN; by their characters."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit("(&#[xX]?[0-9a-fA-F]{1,6};?)"), F.lit(1)))

    def code_of(entity: Column) -> Column:
        digits = F.regexp_replace(entity, "^&#|;$", "")
        is_hex = F.lower(F.substring(digits, 1, 1)) == "x"
        return F.when(is_hex, F.conv(F.substring(digits, 2, 8), 16, 10)).otherwise(digits).try_cast("int")

    def decode(text: Column, entity: Column) -> Column:
        code = code_of(entity)
        return F.when(code.between(1, 127), F.replace(text, entity, F.char(code))).otherwise(text)

    return F.when(F.size(found) > 0, F.aggregate(found, c, decode)).otherwise(c)
