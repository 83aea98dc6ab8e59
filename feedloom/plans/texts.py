"""Queries of chunking, corpus and markup jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from feedloom.functions import text as tx
from feedloom.functions import urls as ul
from feedloom.operators import chunks, corpus, markup
from feedloom.plans.dialect import HOST, collapse, mixed_words, norm, plain_words, strip, trim_space, truncate
from feedloom.plans.registry import query
from feedloom.plans.samples import disguised
from feedloom.sources.tables import spread_rows, view

PACK = """
    walk AS (
      SELECT doc_id, fno, w, w AS used, 0 AS chunk_no FROM frags WHERE fno = 1
      UNION ALL
      SELECT f.doc_id, f.fno, f.w, CASE WHEN k.used + f.w > {budget} THEN f.w ELSE k.used + f.w END,
        CASE WHEN k.used + f.w > {budget} THEN k.chunk_no + 1 ELSE k.chunk_no END
      FROM walk k JOIN frags f ON f.doc_id = k.doc_id AND f.fno = k.fno + 1)"""
FRAGS = f"""
    frags AS (SELECT doc_id, CAST(fno AS INT) AS fno, f, CAST({plain_words('f')} AS BIGINT) AS w FROM (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS f, generate_subscripts(string_split(text, chr(10)), 1) AS fno FROM documents) t)"""


def fragments(spark, folder):
    return spread_rows(view(spark, folder, "documents"), "doc_id").select("doc_id", F.split("text", "\n").alias("fragments"))


@query("chunk_pack", f"""
    WITH RECURSIVE {FRAGS}, {PACK.format(budget=200)}
    SELECT doc_id, chunk_no, CAST(max(used) AS BIGINT) AS words, CAST(count(*) AS INT) AS fragments FROM walk GROUP BY 1, 2""")
def chunk_pack(spark, folder):
    return chunks.chunk_pack(fragments(spark, folder), "doc_id", "fragments", 200).select(
        "doc_id", "chunk_no", "words", "fragments"
    )


@query("section_split", f"""
    WITH lines AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line,
        generate_subscripts(string_split(markdown, chr(10)), 1) AS n FROM v_markdown),
    numbered AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}[ \\t]') THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY n) - 1 AS section_no FROM lines),
    sections AS (SELECT doc_id, CAST(section_no AS INT) AS section_no, string_agg(line, chr(10) ORDER BY n) AS text
      FROM numbered GROUP BY 1, 2)
    SELECT doc_id, section_no, text, {mixed_words('text')} AS words, {mixed_words('text')} <= 60 AS fits FROM sections""")
def section_split(spark, folder):
    return chunks.section_split(spread_rows(view(spark, folder, "v_markdown"), "doc_id").select("doc_id", "markdown"), "doc_id", "markdown", 60)


@query("oversize_split", rf"""
    WITH RECURSIVE blocks AS (
      SELECT doc_id, unnest(string_split(text, chr(10))) AS block, generate_subscripts(string_split(text, chr(10)), 1) AS block_no
      FROM documents),
    counted AS (SELECT *, {mixed_words('block')} AS bw, list_filter(string_split(
        regexp_replace(block, '([.!?。！？]) +', '\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') AS sentences FROM blocks),
    parts AS (SELECT doc_id, block_no, CAST(n AS INT) AS n, t, {mixed_words('t')} AS w FROM (
      SELECT doc_id, block_no, unnest(sentences) AS t, generate_subscripts(sentences, 1) AS n FROM counted
      WHERE bw > 12 AND len(sentences) > 1) x),
    walk AS (SELECT doc_id, block_no, n, t, w AS used, 0 AS piece_no FROM parts WHERE n = 1
      UNION ALL SELECT p.doc_id, p.block_no, p.n, p.t, CASE WHEN k.used + p.w > 12 THEN p.w ELSE k.used + p.w END,
        CASE WHEN k.used + p.w > 12 THEN k.piece_no + 1 ELSE k.piece_no END
      FROM walk k JOIN parts p ON p.doc_id = k.doc_id AND p.block_no = k.block_no AND p.n = k.n + 1),
    runs AS (SELECT doc_id, block_no, list_filter(string_split_regex(block, '\s+'), lambda x: x <> '') AS ws FROM counted
      WHERE bw > 12 AND len(sentences) <= 1),
    pieces AS (
      SELECT doc_id, block_no, 0 AS piece_no, block AS text FROM counted WHERE bw <= 12
      UNION ALL SELECT doc_id, block_no, piece_no, string_agg(t, ' ' ORDER BY n) FROM walk GROUP BY 1, 2, 3
      UNION ALL SELECT doc_id, block_no, CAST(i AS INT), array_to_string(list_slice(ws, i * 12 + 1, i * 12 + 12), ' ') FROM (
        SELECT *, unnest(range(0, CAST(ceil(len(ws) / 12.0) AS BIGINT))) AS i FROM runs) r)
    SELECT doc_id, CAST(block_no AS INT) AS block_no, piece_no, text, {mixed_words('text')} AS words FROM pieces""")
def oversize_split(spark, folder):
    blocks = spread_rows(view(spark, folder, "documents"), "doc_id").select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "block"))
    blocks = blocks.select("doc_id", (F.col("p") + 1).alias("block_no"), "block")
    return chunks.oversize_split(blocks, "doc_id", "block", 12)


@query("markdown_chunks", rf"""
    WITH RECURSIVE lines AS (SELECT doc_id, n, line, {mixed_words('line')} AS w FROM (
        SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS n
        FROM v_markdown) t WHERE trim(line) <> ''),
    numbered AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}[ \t]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM lines),
    sized AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, s) AS sw FROM numbered),
    large AS (SELECT *, list_filter(string_split(regexp_replace(line, '([.!?。！？]) +', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS sentences
      FROM sized WHERE sw > 30 AND w > 30),
    parts AS (SELECT doc_id, n, CAST(k AS INT) AS k, t, {mixed_words('t')} AS w FROM (
      SELECT doc_id, n, unnest(sentences) AS t, generate_subscripts(sentences, 1) AS k FROM large WHERE len(sentences) > 1) x),
    split AS (SELECT doc_id, n, k, t, w AS used, 0 AS p FROM parts WHERE k = 1
      UNION ALL SELECT b.doc_id, b.n, b.k, b.t, CASE WHEN a.used + b.w > 30 THEN b.w ELSE a.used + b.w END,
        CASE WHEN a.used + b.w > 30 THEN a.p + 1 ELSE a.p END
      FROM split a JOIN parts b ON b.doc_id = a.doc_id AND b.n = a.n AND b.k = a.k + 1),
    runs AS (SELECT doc_id, n, list_filter(string_split_regex(line, '\s+'), lambda x: x <> '') AS ws FROM large WHERE len(sentences) <= 1),
    pieces AS (
      SELECT doc_id, min(n) AS n, 0 AS p, string_agg(line, chr(10) || chr(10) ORDER BY n) AS text FROM sized WHERE sw <= 30 GROUP BY doc_id, s
      UNION ALL SELECT doc_id, n, 0, line FROM sized WHERE sw > 30 AND w <= 30
      UNION ALL SELECT doc_id, n, p, string_agg(t, ' ' ORDER BY k) FROM split GROUP BY doc_id, n, p
      UNION ALL SELECT doc_id, n, CAST(i AS INT), array_to_string(list_slice(ws, i * 30 + 1, i * 30 + 30), ' ') FROM (
        SELECT *, unnest(range(0, CAST(ceil(len(ws) / 30.0) AS BIGINT))) AS i FROM runs) r),
    frags AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, p) AS INT) AS fno, text, CAST({mixed_words('text')} AS BIGINT) AS w FROM pieces),
    {PACK.format(budget=30)}
    SELECT k.doc_id, CAST(k.chunk_no AS INT) AS chunk_no, CAST(max(used) AS BIGINT) AS words, CAST(count(*) AS INT) AS fragments,
      sha256(string_agg(f.text, chr(10) || chr(10) ORDER BY f.fno)) AS text_hash
    FROM walk k JOIN frags f ON f.doc_id = k.doc_id AND f.fno = k.fno GROUP BY 1, 2""")
def markdown_chunks(spark, folder):
    parted = F.replace("markdown", F.lit("\n"), F.lit("\n\n"))
    rows = spread_rows(view(spark, folder, "v_markdown"), "doc_id").select("doc_id", parted.alias("markdown"))
    packed = chunks.markdown_chunks(rows, "doc_id", "markdown", 30)
    return packed.select("doc_id", "chunk_no", "words", "fragments", tx.hash_text(F.col("text")).alias("text_hash"))


@query("assemble_chunks", """
    WITH RECURSIVE """ + FRAGS + "," + PACK.format(budget=200) + """,
    counted AS (SELECT doc_id, count(DISTINCT chunk_no) AS expected FROM walk GROUP BY doc_id),
    texts AS (SELECT w.doc_id, w.chunk_no, string_agg(f.f, chr(10) || chr(10) ORDER BY w.fno) AS text
      FROM walk w JOIN frags f ON f.doc_id = w.doc_id AND f.fno = w.fno GROUP BY 1, 2),
    kept AS (SELECT * FROM texts WHERE NOT (doc_id % 5 = 0 AND chunk_no = 1))
    SELECT k.doc_id, CAST(c.expected AS INT) AS expected, count(DISTINCT chunk_no) AS present,
      CASE WHEN count(DISTINCT chunk_no) = c.expected THEN sha256(string_agg(
        """ + trim_space("k.text") + """, chr(10) || chr(10) ORDER BY chunk_no)) END AS text_hash,
      CASE WHEN count(DISTINCT chunk_no) <> c.expected THEN 'incomplete chunks' END AS error
    FROM kept k JOIN counted c ON c.doc_id = k.doc_id GROUP BY k.doc_id, c.expected""")
def assemble_chunks(spark, folder):
    packed = chunks.chunk_pack(fragments(spark, folder), "doc_id", "fragments", 200)
    arrived = packed.filter("NOT (doc_id % 5 = 0 AND chunk_no = 1)")
    whole = chunks.assemble_chunks(arrived, "doc_id")
    return whole.withColumn("text_hash", tx.hash_text(F.col("text"))).drop("text")


CLEAN = f"(SELECT page_id, url, {strip('html')} AS text FROM v_pages)"


@query("text_clean_corpus", f"""
    SELECT page_id, text, {truncate('text', 240)} AS excerpt, CAST({plain_words('text')} AS BIGINT) AS words, length(text) AS chars
    FROM {CLEAN} c""")
def text_clean_corpus(spark, folder):
    return corpus.clean_pages(spread_rows(view(spark, folder, "v_pages"), "page_id").select("page_id", "html"))


@query("text_clean_totals", f"""
    SELECT {HOST} AS source, count(*) AS pages, CAST(sum({plain_words('text')}) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS chars
    FROM {CLEAN} c GROUP BY 1""")
def text_clean_totals(spark, folder):
    cleaned = corpus.clean_pages(spread_rows(view(spark, folder, "v_pages"), "page_id").select("url", "html"))
    return corpus.clean_totals(cleaned, ul.url_host(F.col("url")))


SAMPLE = norm('concat(doc_id::VARCHAR, chr(10), ' + strip('text') + ')')
ROUTED = rf"""
    counted AS (SELECT doc_id, lang, source, CAST(len(regexp_extract_all(s, '[A-Za-z]')) AS BIGINT) AS letters,
        CAST(len(regexp_extract_all(s, '\b[A-Za-z][A-Za-z''-]{{1,}}\b')) AS BIGINT) AS words,
        CAST(len(regexp_extract_all(s, '[\x{{3400}}-\x{{9FFF}}]')) AS BIGINT) AS cjk
      FROM (SELECT doc_id, lang, source, {SAMPLE} AS s FROM documents) t),
    routed AS (SELECT *, words >= 8 AND letters >= 40 AND cjk * 4 < letters AS translate FROM counted)"""


def routed(spark, folder):
    rows = spread_rows(view(spark, folder, "documents"), "doc_id").select("doc_id", "lang", "source", "text")
    return corpus.language_routing(rows, F.col("doc_id").cast("string"), F.col("text")).drop("text")


@query("language_routing", f"WITH {ROUTED} SELECT * FROM routed")
def language_routing(spark, folder):
    return routed(spark, folder)


@query("language_routing_totals", f"""
    WITH {ROUTED} SELECT lang, source, count(*) AS items, count(*) FILTER (WHERE translate) AS to_translate,
      CAST(grouping_id(lang, source) AS BIGINT) AS level FROM routed GROUP BY ROLLUP (lang, source)""")
def language_routing_totals(spark, folder):
    return corpus.routing_totals(routed(spark, folder))


CHOICE_RULES = (("example.net", "page"), ("hypebeast.com", "embedded"), ("therou.example.com", "page"))
TAIL = r"\b(?:read the full story at|continue reading|read more|full article)\b"
CHOSEN = rf"""
    judged AS (SELECT page_id, url, length(text) AS chars, regexp_matches(right(text, 240), '{TAIL}', 'i')
        OR regexp_matches(right({collapse('html')}, 400), '{TAIL}', 'i') OR regexp_matches(text, '(?:…|\.{{3}})\s*$') AS cut,
        CASE WHEN {HOST} = 'therou.example.com' OR ends_with({HOST}, '.therou.example.com') THEN 'therou.example.com'
          WHEN {HOST} = 'example.net' OR ends_with({HOST}, '.example.net') THEN 'example.net' END AS rule_domain
      FROM (SELECT page_id, url, html, {strip('html')} AS text FROM v_pages) t),
    chosen AS (SELECT *, CASE WHEN chars >= 280 AND NOT cut AND rule_domain IS NULL THEN 'embedded' ELSE 'page' END AS choice FROM judged)"""


@query("content_choice", f"WITH {CHOSEN} SELECT page_id, chars, cut, rule_domain, choice FROM chosen")
def content_choice(spark, folder):
    return corpus.content_choice(spread_rows(view(spark, folder, "v_pages"), "page_id"), "url", "html", CHOICE_RULES).drop("url")


@query("content_choice_totals", f"WITH {CHOSEN} SELECT {HOST} AS host, choice, count(*) AS items FROM chosen GROUP BY 1, 2")
def content_choice_totals(spark, folder):
    chosen = corpus.content_choice(spread_rows(view(spark, folder, "v_pages"), "page_id"), "url", "html", CHOICE_RULES)
    return corpus.choice_totals(chosen, "url")


@query("failure_shell_rate", f"""
    SELECT host, count(*) AS pages, CAST(sum(shell) AS BIGINT) AS shells, CAST(sum(shell) AS DOUBLE) / count(*) AS rate FROM (
      SELECT {HOST} AS host, CASE WHEN regexp_matches({strip('html')},
        'something went wrong, but don[’'']t fret|privacy related extensions may cause issues on x\\.com', 'i') THEN 1 ELSE 0 END AS shell
      FROM v_pages) t GROUP BY host""")
def failure_shell_rate(spark, folder):
    return corpus.failure_shell_rate(spread_rows(view(spark, folder, "v_pages"), "page_id"), "url", "html")


def quoted(words):
    return ", ".join(f"'{w}'" for w in words.split())


# Fixed values, written out here, so that a wrong list in the library shows as a difference
KEPT = quoted("""a abbr address article aside b bdi bdo blockquote br caption cite code col colgroup dd del details dfn div dl dt em
  figcaption figure h1 h2 h3 h4 h5 h6 hr i img ins kbd li main mark ol p picture pre q rp rt ruby s samp section small
  source span strong sub summary sup table tbody td tfoot th thead time tr u ul var wbr""")
REMOVED = quoted("""applet audio base button canvas embed fieldset form frame frameset iframe input link math meta noscript object optgroup
  option script select style svg template textarea track video""")
MAY_HAVE = quoted("""a@href a@hreflang a@rel a@target col@span colgroup@span del@datetime details@open img@alt img@height img@loading img@src img@srcset
  img@width ins@datetime li@value ol@reversed ol@start ol@type source@media source@sizes source@src source@srcset source@type td@colspan td@headers
  td@rowspan th@abbr th@colspan th@headers th@rowspan th@scope time@datetime""")


@query("html_tag_audit", rf"""
    WITH tags AS (SELECT page_id, html, list_transform(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9-]*)', 1), lambda t: lower(t)) AS tags FROM v_pages),
    counted AS (
      SELECT page_id, len(list_filter(tags, lambda t: t IN ({KEPT}))) AS allowed, len(list_filter(tags, lambda t: t IN ({REMOVED}))) AS dangerous,
        len(list_filter(tags, lambda t: t NOT IN ({KEPT}, {REMOVED}))) AS unknown,
        len(regexp_extract_all(html, '(?i)\son[a-z]+\s*=')) AS handlers, len(regexp_extract_all(html, '(?i)\s(?:style|srcdoc)\s*=')) AS styles,
        len(regexp_extract_all(html, '<!--')) AS comments FROM tags),
    starts AS (SELECT page_id, unnest(regexp_extract_all(html, '<[a-zA-Z][^>"'']*(?:(?:"[^"]*"|''[^'']*'')[^>"'']*)*>')) AS t FROM v_pages),
    named AS (SELECT page_id, row_number() OVER () AS n, lower(regexp_extract(t, '^<([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag,
        regexp_extract_all(regexp_replace(t, '^<[a-zA-Z][a-zA-Z0-9-]*', ''), '[^\s"''<>/=]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''>]*))?') AS attributes FROM starts),
    named_attributes AS (SELECT page_id, n, tag, k, lower(regexp_extract(a, '^[^\s=]+')) AS name,
        lower(trim(regexp_replace(a, '^[^\s=]+\s*=?\s*', ''), '"' || chr(39))) AS value
      FROM (SELECT page_id, n, tag, unnest(attributes) AS a, generate_subscripts(attributes, 1) AS k FROM named WHERE tag IN ({KEPT})) x),
    bad AS (SELECT page_id, count(*) AS disallowed_count, string_agg(DISTINCT pair, ',' ORDER BY pair) AS disallowed FROM (
        SELECT DISTINCT page_id, n, concat(tag, '@', name) AS pair FROM named_attributes WHERE name NOT IN ('class', 'dir', 'lang', 'title')) y
      WHERE pair NOT IN ({MAY_HAVE}) GROUP BY page_id),
    firsts AS (SELECT page_id, n, name, arg_min(value, k) AS value FROM named_attributes WHERE tag = 'a' AND name IN ('rel', 'target') GROUP BY ALL),
    links AS (SELECT page_id, count(*) FILTER (WHERE name = 'target' AND value <> '_blank') AS bad_targets,
        CAST(sum(CASE WHEN name = 'rel' THEN len(list_filter(list_distinct(string_split_regex(value, '\s+')),
          lambda w: w <> '' AND w NOT IN ('nofollow', 'noopener', 'noreferrer', 'sponsored', 'ugc'))) ELSE 0 END) AS BIGINT) AS bad_rel FROM firsts GROUP BY page_id)
    SELECT c.*, COALESCE(disallowed_count, 0) AS disallowed_count, COALESCE(disallowed, '') AS disallowed, COALESCE(bad_rel, 0) AS bad_rel,
      COALESCE(bad_targets, 0) AS bad_targets FROM counted c LEFT JOIN bad b ON b.page_id = c.page_id LEFT JOIN links l ON l.page_id = c.page_id""")
def html_tag_audit(spark, folder):
    return markup.html_tag_audit(spread_rows(view(spark, folder, "v_pages"), "page_id").select("page_id", "html"))


VALUES = r"""list_transform(regexp_extract_all(html, '(?i)\s{0}\s*=\s*["'']([^"'']*)["'']', 1), lambda v: replace(v, '&#x73;', 's'))"""
ABS = r"regexp_matches(v, '^[A-Za-z][A-Za-z0-9+.-]*:')"
SCHEME_OF = rf"(CASE WHEN {ABS} THEN lower(regexp_extract(v, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) ELSE regexp_extract(url, '^([a-z]+):', 1) END)"
VALUE_HOST = r"NULLIF(lower(regexp_extract(v, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '')"


@query("html_link_audit", rf"""
    WITH found AS (SELECT page_id, url, {HOST} AS host, {VALUES.format('href')} AS hrefs, {VALUES.format('src')} AS srcs,
        list_transform(flatten(list_transform({VALUES.format('srcset')}, lambda v: string_split(v, ','))), lambda c: trim(c)) AS sets,
        list_transform(regexp_extract_all(html, '(?i)(<a\s[^>]*>)', 1), lambda a: lower(regexp_extract(a, '(?i)\srel\s*=\s*["'']([^"'']*)["'']', 1))) AS rels
      FROM v_pages)
    SELECT page_id, len(hrefs) AS links, len(srcs) AS resources,
      len(list_filter(hrefs, lambda v: {SCHEME_OF} NOT IN ('http', 'https', 'mailto', 'tel'))) AS unsafe_links,
      len(list_filter(srcs, lambda v: {SCHEME_OF} NOT IN ('http', 'https'))) AS unsafe_resources,
      len(list_filter(hrefs, lambda v: CASE WHEN {ABS} OR starts_with(v, '//') THEN {VALUE_HOST} ELSE host END = host)) AS same_host_links,
      len(list_filter(hrefs, lambda v: {SCHEME_OF} IN ('mailto', 'tel'))) AS mail_or_phone,
      CAST(list_sum(list_transform(rels, lambda r: CASE WHEN list_contains(string_split(r, ' '), 'noopener') THEN 0 ELSE 1 END
        + CASE WHEN list_contains(string_split(r, ' '), 'noreferrer') THEN 0 ELSE 1 END)) AS BIGINT) AS rel_tokens_missing,
      len(sets) AS image_candidates,
      len(list_filter(sets, lambda v: NOT regexp_matches(v, '^\S+(?:\s+(?:\d+w|(?:\d+(?:\.\d+)?|\.\d+)x))?$')
        OR {SCHEME_OF} NOT IN ('http', 'https'))) AS bad_image_candidates
    FROM found""")
def html_link_audit(spark, folder):
    return markup.html_link_audit(spread_rows(view(spark, folder, "v_pages"), "page_id"))


@query("lead_image_per_page", r"""
    SELECT page_id, CASE WHEN page_id % 6 = 1 THEN 'meta' ELSE 'body' END AS origin,
      CASE page_id % 6 WHEN 0 THEN 'Lead' WHEN 1 THEN 'Og title' ELSE '' END AS alt,
      CASE page_id % 6 WHEN 0 THEN concat(regexp_extract(url, '^[a-z]+://[^/?#]+'), '/img/', CAST(page_id AS VARCHAR), '.jpg')
        WHEN 1 THEN 'https://cdn.example.org/og.png'
        ELSE concat(regexp_extract(url, '^[a-z]+://[^/?#]+(?:/[^?#]*/|/)?'), 'lazy.png') END AS src
    FROM pages WHERE page_id % 6 IN (0, 1, 3)""")
def lead_image_per_page(spark, folder):
    return markup.lead_image_per_page(spread_rows(view(spark, folder, "v_pages"), "page_id"))


@query("title_derivation", rf"""
    WITH items AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat(text, chr(10), ' #  Head   ', CAST(doc_id AS VARCHAR), ' ')
        WHEN 1 THEN concat('https://x.example.org/a', chr(10), chr(10), text) ELSE text END AS text FROM documents),
    lines AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda l: {norm('l')}), lambda l: l <> '') AS lines FROM items),
    lead AS (SELECT doc_id, text, COALESCE(list_filter(lines, lambda l: NOT regexp_matches(l, '^https?://\S+$'))[1], lines[1]) AS line FROM lines)
    SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('Head ', CAST(doc_id AS VARCHAR))
      ELSE COALESCE(NULLIF({truncate('line', 72)}, ''), 'Untitled') END AS title FROM lead""")
def title_derivation(spark, folder):
    """Texts are disguised; the checking SQL derives titles from them as they were."""
    kind, text = F.col("doc_id") % 3, disguised(F.col("text"))
    items = spread_rows(view(spark, folder, "documents"), "doc_id").select(
        "doc_id",
        F.when(kind == 0, F.concat(text, F.lit("\n #  Head   "), F.col("doc_id").cast("string"), F.lit(" ")))
        .when(kind == 1, F.concat(F.lit("https://x.example.org/a\n\n"), text)).otherwise(text).alias("text"),
    )
    return corpus.title_derivation(items, "text").drop("text")


@query("identity_dedupe", r"""
    WITH keyed AS (SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN concat('x-tweet:', CAST(page_id % 30 AS VARCHAR))
        WHEN page_id % 4 = 1 THEN concat('x-article:', CAST(page_id % 30 AS VARCHAR))
        ELSE regexp_replace(url, '#.*$', '') END AS identity FROM pages)
    SELECT identity, count(*) AS copies, max(page_id) AS page_id FROM keyed GROUP BY identity""")
def identity_dedupe(spark, folder):
    number = (F.col("page_id") % 30).cast("string")
    kind = F.col("page_id") % 4
    saved = view(spark, folder, "pages").select(
        "page_id",
        F.when(kind == 0, F.concat(F.lit(" https://Twitter.com/u/statuses/"), number, F.lit("?s=1")))
        .when(kind == 1, F.concat(F.lit("https://x.com/i/article/"), number)).otherwise(F.col("url")).alias("url"),
    )
    return corpus.identity_dedupe(saved, "url", "page_id").select("identity", "copies", "page_id")


@query("response_audit", """
    WITH flags AS (SELECT provider, model, response_id, (response_id // 1000 + response_id % 1000) % 6 AS kind, raw FROM v_responses)
    SELECT provider, model, count(*) AS responses, count(*) FILTER (WHERE kind = 3 OR trim(raw) = '') AS empty,
      count(*) FILTER (WHERE kind IN (1, 2)) AS fenced, count(*) FILTER (WHERE kind IN (0, 1, 2, 4)) AS valid_json,
      count(*) FILTER (WHERE kind IN (0, 2)) AS complete,
      CAST(count(*) FILTER (WHERE kind IN (0, 2)) AS DOUBLE) / count(*) AS complete_rate FROM flags GROUP BY 1, 2""")
def response_audit(spark, folder):
    return corpus.response_audit(view(spark, folder, "v_responses"))


@query("reading_stats", f"""
    WITH readable AS (SELECT source, text, length(regexp_replace(text, '[{tx.SPACE}]+', '', 'g')) AS chars FROM documents),
    rows_ AS (SELECT source, chars, greatest(1, CAST(floor(chars / 200.0 + 0.5) AS BIGINT)) AS minutes,
        {mixed_words('text')} AS words FROM readable)
    SELECT source, count(*) AS items, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(minutes) AS BIGINT) AS minutes,
      CAST(sum(words) AS BIGINT) AS words, quantile_disc(words, 0.5) AS words_p50, quantile_disc(words, 0.95) AS words_p95
    FROM rows_ GROUP BY source""")
def reading_stats(spark, folder):
    return corpus.reading_stats(spread_rows(view(spark, folder, "documents"), "doc_id").select("source", "text"), "text", "source")
