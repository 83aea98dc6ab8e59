import random

from pyspark.sql import functions as F

from feedloom.llm import substrings
from feedloom.llm.substrings import drop_repeated_spans, runs, units
from llm_help import make, prose  # noqa: F401


def brute(docs):
    """Characters to remove per row, by looking every run up among all earlier ones."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0], k))
    first, gone = {}, {k: set() for k in order}
    for k in order:
        text = docs[k][1] or ""
        parts = [(a, b, n, " ".join(text[a:b].split())) for a, b, n, _ in units(text)]
        for i in range(len(parts)):
            words, j = 0, i
            while j < len(parts) and (words < 30 or j < i + 2):
                words += parts[j][2]
                j += 1
            if words < 30 or j < i + 2:
                continue
            key = tuple(p[3] for p in parts[i:j])
            start, end = parts[i][0], parts[j - 1][1]
            if key not in first:
                first[key] = (k, end)
            elif first[key][0] != k or start >= first[key][1]:
                gone[k] |= set(range(start, end))
    return gone


def corpus():
    r = random.Random(6)
    passage = [prose(900 + k, 60, 200) for k in range(4)]
    rows = []
    for k in range(80):
        parts = [prose(k, r.choice([5, 40, 120]))]
        if r.random() < 0.6:
            parts.insert(r.randrange(2), r.choice(passage))
        rows.append((500 - k, "\n".join(parts)))
    rows += [(3, rows[10][1]), (3, rows[10][1]), (None, rows[11][1]), (9, None), (10, ""), (11, "word " * 400), (12, "A. B. C. " * 100)]
    return rows


def test_removed_characters_are_those_of_brute_force(make):
    rows = corpus()
    docs = make(rows).coalesce(1)
    wanted = brute(rows)
    out = drop_repeated_spans(docs).collect()
    left = sorted((str(r.doc_id), str(r.text), sorted(c for s in r.removed for c in range(s.start, s.end))) for r in out)

    def text_of(k):
        t = rows[k][1]
        if t is None:
            return None
        return [c for i, c in enumerate(t) if i not in wanted[k]]

    assert sorted((str(rows[k][0]), sorted(wanted[k])) for k in wanted) == sorted((d, gone) for d, _, gone in left)
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    assert by[9].text is None and by[10].text == "" and by[9].first_doc_ids == []
    for k, (doc_id, t) in enumerate(rows[:80]):
        kept = "".join(by[doc_id].text.split())
        assert kept == "".join("".join(text_of(k)).split())


def test_passages_of_fifty_words_are_caught_and_clean_texts_stay(make):
    passage = prose(77, 55, 200)
    clean = [(k, prose(k, 100)) for k in range(20)]
    planted = [(100 + k, prose(200 + k, 30) + ".\n" + passage + "\n" + prose(300 + k, 30)) for k in range(10)]
    out = {r.doc_id: r for r in drop_repeated_spans(make(clean + planted)).collect()}
    assert all(out[k].text == t and not out[k].removed for k, t in clean)
    assert out[100].text == planted[0][1]
    words = passage.split()
    for k, _ in planted[1:]:
        assert out[k].first_doc_ids == [100] and out[k].n_removed
        kept = " ".join(out[k].text.split())
        assert not any(" ".join(words[i:i + 20]) in kept for i in range(len(words) - 19))


def test_runs_and_odd_tables(make):
    assert len(runs("")[0]) == 0 and len(runs("one two three")[0]) == 0
    docs = make(corpus()).withColumn("row", F.lit("x")).withColumn("start", F.lit(1))
    assert drop_repeated_spans(docs).count() == docs.count()
    assert drop_repeated_spans(docs.limit(0)).count() == 0


def test_passages_from_any_place_against_word_windows(make):
    r = random.Random(12)
    passages = [prose(4000 + k, r.randint(51, 56), 400) for k in range(12)] + [prose(4100 + k, 51, 400).replace(".", "") for k in range(12)]
    rows = []
    for k in range(72):
        before, after = prose(5000 + k, r.randint(1, 40), 400), prose(6000 + k, r.randint(1, 40), 400)
        if k % 2:
            before, after = before.replace(".", ""), after.replace(".", "")
        rows.append((k, f"{before} {passages[k % 24]} {after}"))
    out = {x.doc_id: x.removed for x in drop_repeated_spans(make(rows)).collect()}
    seen, met = set(), 0
    for k, text in rows:
        words, places, at = text.split(), [], 0
        for w in words:
            at = text.index(w, at)
            places.append((at, at + len(w)))
            at += len(w)
        windows = [tuple(words[i:i + 51]) for i in range(len(words) - 50)]
        for i, window in enumerate(windows):
            if window in seen:
                met += 1
                gone = [w for w in places[i:i + 51] if any(s.start <= w[0] and w[1] <= s.end for s in out[k])]
                assert len(gone) >= 30, (k, i, len(gone))
        seen.update(windows)
    assert met >= 48 and all(not out[k] for k in range(24))


def test_runs_are_gone_before_their_places_are_shuffled(make, monkeypatch):
    """The arrays of all runs never stand beside the shuffle of repeated ones, and hashes are counted in slices."""
    done, save, drop = [], substrings.saved, substrings.discard
    labels = {}

    def saved(df, label):
        table = save(df, label)
        labels[id(table)] = label
        done.append(("stored", label, table))  # keeps the table, so that its id stays its own
        return table

    monkeypatch.setattr(substrings, "saved", saved)
    monkeypatch.setattr(substrings, "discard", lambda *tables: [done.append(("removed", labels[id(t)], t)) for t in tables] and drop(*tables))
    out = drop_repeated_spans(make(corpus()))
    steps = [(what, label) for what, label, _ in done]
    assert steps.index(("removed", "runs")) < steps.index(("stored", "repeated"))
    assert steps.count(("stored", "often")) > 1
    assert out.filter("n_removed > 0").count() > 0
