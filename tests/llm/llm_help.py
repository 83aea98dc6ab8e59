"""Brute-force helpers of the tests."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return build


def prose(seed, words=80, per_line=12):
    """Invented prose, the same for the same seed."""
    import random

    r = random.Random(seed)
    parts = "an be con dor el fam gi hul in jor kel lum mo nar os per qui ros tal um ver wen xi yor zan".split()
    out = []
    for n in range(words):
        out.append("".join(r.choice(parts) for _ in range(r.randint(1, 3))) + ("." if n % 9 == 8 else ""))
    return "\n".join(" ".join(out[k:k + per_line]) for k in range(0, len(out), per_line))


def classes(nodes, links):
    """Smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}
