import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from feedloom.llm.components import components
from feedloom.llm.simhash import drop_near_duplicates, fingerprint, fingerprint_links, near_duplicate_classes, near_pairs
from llm_help import classes, make, prose  # noqa: F401


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\v\f\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_by_hand(spark):
    texts = [None, "", " \t\n", "One", "One TWO", "a b c", "É é ſ K x y z", prose(1), "b " * 300, prose(2, 3000)]
    for text in texts:
        assert fingerprint(text) == slow_fingerprint(text)
    hashed = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert fingerprint("A b\nC") == hashed % (1 << 64)


def test_pairs_of_blocks_are_those_of_brute_force():
    r = random.Random(3)
    values, groups = [], []
    for g, n in enumerate([1, 2, 63, 64, 65, 130, 3, 200]):
        centre = r.getrandbits(64)
        for _ in range(n):
            values.append(centre ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 1, 2, 3, 30]))))
            groups.append(g)
    found = set()
    for i, j in near_pairs(np.array(values, np.uint64), np.array(groups)):
        found |= set(zip(i.tolist(), j.tolist()))
    true = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values))
            if groups[i] == groups[j] and (values[i] ^ values[j]).bit_count() <= 2}
    assert found == true and true


def test_links_reach_what_brute_force_reaches(spark):
    r = random.Random(5)
    values = set()
    for n in [900, 5, 1, 40]:
        centre = r.getrandbits(64)
        for _ in range(n):
            values.add(centre ^ sum(1 << b for b in r.sample(range(64), r.choice([0, 1, 2, 3, 4]))))
    values = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    links = fingerprint_links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()
    true = [(a, b) for k, a in enumerate(values) for b in values[k + 1:] if ((a ^ b) % (1 << 64)).bit_count() <= 2]
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 2 or True for a, b in links)
    assert classes(values, links) == classes(values, true)


def test_components(spark):
    r = random.Random(9)
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    pairs += [(7, 7), (None, 3), (5, None), (-4, 300), (300, -4)]
    found = dict(components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect())
    nodes = sorted({x for p in pairs if None not in p and p[0] != p[1] for x in p})
    assert found == classes(nodes, [p for p in pairs if None not in p])
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_classes_of_odd_rows(make):
    text = prose(4, 300)
    rows = [(5, text), (3, text), (3, text), (None, text), (9, None), (8, ""), (7, "   "), (2, prose(6)), (1, prose(7, 20000))]
    found = sorted(near_duplicate_classes(make(rows)).select("doc_id", "component_id").collect(), key=str)
    assert sorted(map(tuple, found), key=str) == sorted(
        [(5, 3), (3, 3), (3, 3), (None, 3), (9, 7), (8, 7), (7, 7), (2, 2), (1, 1)], key=str)
    assert near_duplicate_classes(make([])).count() == 0


def test_one_row_of_each_class_stays_with_clashing_columns(spark, make):
    text = prose(4, 300)
    docs = make([(5, text), (3, text), (3, text), (None, text), (2, "x"), (None, None)]).withColumn("fp", F.lit("p")).withColumn("row", F.lit(0)).withColumn("a.b", F.lit(1))
    out = drop_near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in out.collect()))) == ["2", "3", "None"]
    assert drop_near_duplicates(docs.limit(0)).count() == 0
