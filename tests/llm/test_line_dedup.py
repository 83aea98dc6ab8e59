import random

from pyspark.sql import functions as F

from feedloom.llm import line_dedup
from feedloom.llm.line_dedup import SHINGLE, drop_duplicate_lines, duplicate_lines, line_links
from llm_help import classes, make, prose  # noqa: F401


def shingles(line):
    units = line.encode("utf-16-be")
    n = len(units) // 2
    return {units[2 * i:2 * (i + SHINGLE)] for i in range(max(1, n - SHINGLE + 1))}


def similar(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) >= 0.8 * len(x | y)


def brute(docs):
    """(row number, line number) to remove, by comparing all lines."""
    lines = sorted({line for _, t in docs for line in (t or "").split("\n") if line.strip(" ")})
    links = [(a, b) for k, a in enumerate(lines) for b in lines[k + 1:] if similar(a, b)]
    root = classes(lines, links)
    seen, gone = set(), set()
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0], k))
    for k in order:
        for pos, line in enumerate((docs[k][1] or "").split("\n")):
            if line.strip(" "):
                if root[line] in seen:
                    gone.add((k, pos))
                seen.add(root[line])
    return gone


def changed(line, r, edits):
    out = list(line)
    for _ in range(edits):
        out[r.randrange(len(out))] = r.choice("abcdefgh")
    return "".join(out)


def corpus():
    r = random.Random(11)
    base = [prose(k, 60, 60) for k in range(6)] + [prose(k, 9, 9) for k in range(20, 26)] + ["été à l'école 😀 naïve façon " * 3]
    rows = []
    for k in range(60):
        lines = [prose(100 + k, 30, 30)]
        for _ in range(3):
            line = r.choice(base)
            lines.append(changed(line, r, r.choice([0, 1, 2])))
        lines += ["", "  ", "ok"]
        rows.append((1000 - k, "\n".join(lines)))
    return rows + [(5, None), (6, ""), (1000, rows[0][1]), (7, "\n\n")]


def test_removed_lines_are_those_of_brute_force(make):
    rows = corpus()
    found = duplicate_lines(make(rows).coalesce(1)).collect()
    wanted = brute(rows)
    got = {(r.row, pos) for r in found for pos in r.removed}
    assert got == wanted
    assert {r.row: r.n_lines for r in found}[len(rows) - 4] == 0  # null text
    assert len(found) == len(rows)


def test_large_bucket_of_variants(make):
    r = random.Random(2)
    base = prose(500, 70, 70)
    rows = [(k, changed(base, r, 1)) for k in range(120)] + [(900 + k, prose(700 + k, 70, 70)) for k in range(5)]
    out = {x.doc_id: x.text for x in drop_duplicate_lines(make(rows), length="n_chars").collect()}
    assert out[0] == rows[0][1] and all(out[k] == "" for k in range(1, 120))
    assert all(out[k] == t for k, t in rows[120:])


def test_links_are_pairs_above_the_threshold(make):
    rows = corpus()
    lines, links = line_links(make(rows), "text")
    texts = {line for _, t in rows for line in (t or "").split("\n") if line.strip(" ")}
    assert lines.count() == len(texts)
    hashed = make(list(enumerate(sorted(texts)))).select("text", *line_dedup._hashes(F.col("text")))
    named = {r.id: r.text for r in lines.join(hashed, ["h1", "h2"]).collect()}
    found = {(named[r.a], named[r.b]) for r in links.collect()}
    assert found and all(a != b and similar(a, b) for a, b in found)


def test_large_bucket_of_unlike_lines_is_no_all_pairs(make, monkeypatch):
    """500 lines that share half of their text, and near copies of some of them: few pairs are met, no link is lost."""
    r = random.Random(4)
    shared = prose(900, 200, 200)[:160]
    lines = [shared + " " + "".join(r.choice("abcdefghijklmnop ") for _ in range(110)) for _ in range(500)]
    lines += [changed(line, r, 1) for line in lines[:500:10]]
    rows = [(k, line) for k, line in enumerate(lines)]
    tried, verify = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda pairs, *rest: tried.append(pairs.count()) or verify(pairs, *rest))
    line_links(make(rows), "text")
    sizes = line_dedup.signatures(make(rows), "text").select(F.explode("bands").alias("band")).groupBy("band").count().agg(F.max("count")).first()[0]
    assert sizes > 4 * line_dedup.SMALL_BUCKET
    met = sum(tried)
    found = duplicate_lines(make(rows).coalesce(1)).collect()
    assert {(x.row, pos) for x in found for pos in x.removed} == brute(rows)
    assert sum(len(x.removed) for x in found) == 50
    assert met < 20 * len(rows)


def test_texts_keep_columns_blank_lines_and_order(make):
    docs = make([(2, "same line of some length\n\nown line two"), (1, "same line of some length"), (3, None), (4, "own line four\n" * 3)])
    docs = docs.withColumn("row", F.lit(1)).withColumn("removed", F.lit(2)).withColumn("pos", F.lit(3))
    out = drop_duplicate_lines(docs, length="n_chars")
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("same line of some length", 24), 2: ("\nown line two", 13), 3: (None, None), 4: ("own line four\n", 14)}
    assert drop_duplicate_lines(docs.limit(0)).count() == 0 and duplicate_lines(docs.limit(0)).count() == 0


def test_near_equal_lines_of_120_to_140_characters(make):
    r = random.Random(8)
    lines = [prose(2000 + k, 60, 60)[:r.randint(134, 138)].replace("\n", " ") for k in range(40)]
    pairs = [(a, a + " and"[:r.randint(2, 4)]) for a in lines] + [(a[:125], changed(a[:125], r, 1)) for a in lines[:10]]
    rows = [(2 * k + i, pair[i]) for k, pair in enumerate(pairs) for i in (0, 1)]
    found = duplicate_lines(make(rows).coalesce(1)).collect()
    assert {(x.row, pos) for x in found for pos in x.removed} == brute(rows)
    assert all(x.removed for x in found if x.doc_id % 2)


def test_near_copies_by_shingles_of_eight_characters(make):
    lines = [prose(3000 + k, 60, 60)[:100].replace(".", "x") for k in range(30)]
    rows = [(2 * k + i, text) for k, a in enumerate(lines) for i, text in enumerate((a, a[:50] + "#" + a[51:]))]

    def eight(line):
        return {line[i:i + 8] for i in range(len(line) - 7)}

    assert all(len(eight(a) & eight(b)) >= 0.8 * len(eight(a) | eight(b)) for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    out = {x.doc_id: x.removed for x in duplicate_lines(make(rows)).collect()}
    assert all(out[k] == ([0] if k % 2 else []) for k in range(60))


def test_long_rules_of_one_character(make):
    rules = [(k, mark * n) for k, (mark, n) in enumerate((m, n) for m in "-=*_~.+#" for n in (150, 160, 40, 400))]
    rules += [(100 + k, pair * n) for k, (pair, n) in enumerate((p, n) for p in ("-=", "*-", "=_~", "+-") for n in (80, 90, 200))]
    found = duplicate_lines(make(rules).coalesce(1)).collect()
    assert {(x.row, pos) for x in found for pos in x.removed} == brute(rules)
    assert sum(len(x.removed) for x in found) == 24 + 8


def test_only_lines_that_share_a_band_have_a_sketch(make, monkeypatch):
    """Signatures of all lines carry bands alone; sketches are made of the few lines that meet, and occurrences go before texts are shuffled."""
    rows = corpus()
    assert line_dedup.signatures(make(rows), "text").columns == ["id", "h1", "h2", "bands"]
    stored, gone, save, drop = {}, [], line_dedup.saved, line_dedup.discard

    def saved(df, label):
        table = save(df, label)
        stored.setdefault(label, []).append((table, table.count()))
        return table

    monkeypatch.setattr(line_dedup, "saved", saved)
    monkeypatch.setattr(line_dedup, "discard", lambda *tables: gone.extend(tables) or drop(*tables))
    drop_duplicate_lines(make(rows))
    (_, sketched), (_, lines) = stored["sketched"][0], stored["lines"][0]
    assert 0 < sketched < lines
    assert any(t is stored["occurrences"][0][0] for t in gone)


def test_only_lines_that_pairs_name_are_shuffled(make, monkeypatch):
    """Of 2000 texts and sketches, those of two pairs go into the joins, and the links are those of the threshold."""
    lines = [prose(5000 + k, 20, 20) for k in range(2000)]
    lines[1] = lines[0] + " x"
    texts = line_dedup.saved(make(list(enumerate(lines))).select(F.col("doc_id").alias("id"), F.col("text").alias("line")), "texts")
    pairs = make([(0, "1"), (5, "9")]).select(F.col("doc_id").alias("a"), F.col("text").cast("long").alias("b"))
    kept, test = [], line_dedup.possible

    def possible(*of):
        rows = test(*of)
        kept.append(rows.count())
        return rows

    monkeypatch.setattr(line_dedup, "possible", possible)
    found = line_dedup._verified(pairs, line_dedup.sketches(texts), texts).collect()
    assert [tuple(r) for r in found] == [(0, 1)]
    assert len(kept) == 2 and all(0 < k < 100 for k in kept)
