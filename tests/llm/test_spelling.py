import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from feedloom.llm.spelling import count_words, damaged, op11, runs, spelling_variants
from llm_help import make  # noqa: F401


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes one word the other."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1:] == short for k in range(len(long)))


def brute(counts, factor=10):
    best, n_near = {}, {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        n_near[w] = len(others)
        top = min(others, key=lambda o: (-counts[o], o), default=None)
        best[w] = top if top is not None and counts[top] >= factor * n else None
    out = []
    for w, n in counts.items():
        root = w
        while best[root] is not None:
            root = best[root]
        out.append((w, best[w], root, n, n_near[w], counts[best[w]] if best[w] else None))
    return sorted(out)


def words_of(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def answer(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_of_random_words(spark):
    r = random.Random(3)
    counts = {}
    for _ in range(60):
        word = "".join(r.choice("abé") for _ in range(r.randint(1, 6)))  # short words over three letters: runs of one letter, many ties
        counts[word] = r.choice([2, 2, 3, 25, 40, 400, 5000])
    counts |= {"a" * 300: 3, "a" * 301: 40, "a" * 150 + "b" + "a" * 150: 500, "aéa": 7, "ÿÿ": 2, "": 4, "x" * 199: 2, "x" * 200: 30, "x" * 201: 400}
    out = answer(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert out == brute(counts)
    assert any(f and root != f for _, f, root, *_ in out)


def test_chains_are_followed_to_the_last(spark):
    base = "abcdefghij"
    counts = {base[:k] + "z" * (10 - k): 10 ** k for k in range(9)}
    out = answer(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert out == brute(counts)
    assert {root for _, _, root, *_ in out} == {base[:8] + "zz"}


def test_one_letter_takes_all_places(spark):
    """A word with every letter of the alphabet in one place: the largest group there is."""
    letters = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    counts = {"wordwi" + c + "th": 2 for c in letters} | {"wordwith": 20}
    assert answer(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long"))) == brute(counts)


def test_words_of_texts(spark, make):
    long = "word" * 2000 + "Ünïcode×÷ " * 3
    docs = [(k, "Separate seperate SEPARATE, separate: occurrence occurence don't") for k in range(40)]
    docs += [(41, None), (42, ""), (42, ""), (43, long), (43, long), (None, "separate separate"), (44, "a b c \u0001 1234567 abcdefg1abcdefg"), (45, "naïveté naïvete naïveté")]
    table = make(docs).withColumn("word", F.lit("x")).withColumn("n", F.lit(1)).withColumn("rank", F.lit(1)).withColumn("key", F.lit("k"))
    found = table.select("doc_id", F.explode(runs(table)).alias("run"))
    counted = count_words(found.select(damaged(F.col("run"), F.col("doc_id")).alias("word")))
    counts = words_of(docs)
    assert {r.word: r.n for r in counted.collect()} == counts
    assert answer(spelling_variants(counted)) == brute(counts)


def test_query_against_brute_force(spark, small):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    counts = words_of(docs)
    keys = {}
    for w in counts:  # words that share a word with one place less are compared, so that this ends soon
        for k in range(len(w) + 1):
            keys.setdefault(w[:k] + w[k + 1:], set()).add(w)
    out = answer(op11(spark, small))
    assert {r[0]: r[3] for r in out} == counts
    for word, form, root, n, n_near, form_n in out:
        others = {o for k in range(len(word) + 1) for o in keys[word[:k] + word[k + 1:]] if near(word, o)}
        top = min(others, key=lambda o: (-counts[o], o), default=None)
        wanted = top if top is not None and counts[top] >= 10 * n else None
        assert (n_near, form, form_n) == (len(others), wanted, counts.get(wanted))
        assert root == word if form is None else counts[root] >= form_n


def test_empty_tables(spark):
    assert spelling_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert empty.select(F.explode(runs(empty))).count() == 0
