import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import vector_codes
from feedloom.llm.vector_codes import codebooks_sha256, compressed, cover_tree, decoded, nearest, op13, squares, tallies

ROW = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=4, entries=256, rounds=4):
    """Codes, errors and codebooks with Python's integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    whole = [[max(-vector_codes.LIMIT, min(vector_codes.LIMIT, math.floor(1024 * x))) for x in v] for _, v, _ in kept]
    cut = [[(v + [0] * (width * parts - len(v)))[k * width:(k + 1) * width] for k in range(parts)] for v in whole]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, whole[k]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def best(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = defaultdict(list)
            for v in cut:
                own[best(v[p], book)[1]].append(v[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if own[k] else e for k, e in enumerate(book)]
    out = []
    for (i, _, label), v in zip(kept, cut):
        found = [best(v[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return out, books


def same(spark, rows, **asked):
    codes, books = compressed(spark.createDataFrame(rows, ROW).withColumn("v", F.lit(1)).withColumn("trees", F.lit("x")), **asked)
    wanted, wanted_books = brute(rows, **asked)
    assert [b.tolist() for b in books] == wanted_books or not wanted
    assert sorted(map(repr, (tuple(r) for r in codes.collect()))) == sorted(map(repr, wanted))
    return codes, books


def random_rows(seed, n, size, spread=0.05):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, size))
    return [(int(k * 7919 % 100003), (centres[r.integers(12)] + r.normal(size=size) * spread).tolist(), int(r.integers(4))) for k in range(n)]


@pytest.mark.parametrize("spread", [0.001, 0.05, 1.0])
def test_codes_are_those_of_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(vector_codes, "BLOCK", 300)
    same(spark, random_rows(1, 500, 16, spread), entries=20)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = random_rows(2, 60, 8) + [(k, [0.5, -0.5] * 4, None) for k in range(40)]  # a third are equal: ties, entries without points
    rows += [(None, [0.25] * 8, 1), (None, [0.125] * 8, 1), (5, None, 1), (6, [nan] * 8, 1), (7, [inf] + [0.0] * 7, 1), (8, [None] + [0.0] * 7, 1), (9, [], 1), (10, [0.75], None), (11, [1e30, -1e30, 3000.25] + [0.0] * 6, 2)]
    rows += [(3, [-0.0001] * 8, 3)] * 3
    same(spark, rows, entries=30)
    same(spark, rows[:60], entries=256, rounds=1)


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1)], [(1, [], 1), (2, [], None)]):
        codes, books = compressed(spark.createDataFrame(rows, ROW))
        assert [r.code for r in codes.collect()] == ["00000000"] * sum(v is not None for _, v, _ in rows)
        assert codebooks_sha256(books) == hashlib.sha256(",".join(["0"] * 8 if rows[1:] else []).encode()).hexdigest()


@pytest.mark.parametrize("scale", [1000, 1 << 25])
def test_trees_decide_as_all_comparisons(scale):
    r = np.random.default_rng(4)
    for size in (1, 2, 16):
        points = np.concatenate([r.integers(-scale, scale, (700, size)), np.repeat(r.integers(-scale, scale, (3, size)), 100, axis=0), np.zeros((50, size), np.int64)])
        entries = np.concatenate([points[::20], points[::20], points[5:6] + 1])  # every entry twice: ties
        tree = cover_tree(points)
        exact = ((points[:, None, :].astype(object) - entries[None, :, :].astype(object)) ** 2).sum(axis=2)
        assert (squares(points, entries) == exact).all()
        code, error = nearest(tree, entries)
        wanted = np.array([min(range(len(entries)), key=lambda k: (row[k], k)) for row in exact])
        assert (code == wanted).all() and (error == exact[np.arange(len(points)), wanted]).all()
        count, total = tallies(tree, entries)
        for k in range(len(entries)):
            assert count[k] == (wanted == k).sum() and (total[k] == points[wanted == k].sum(axis=0)).all()


def test_tree_covers_and_most_points_go_with_their_subtree():
    r = np.random.default_rng(6)
    points = np.concatenate([c + r.integers(-8, 9, (400, 8)) for c in r.integers(-2000, 2000, (10, 8))])
    tree = cover_tree(points)
    for lo, hi, centre, radius, sums in zip(tree["lo"], tree["hi"], tree["centre"], tree["radius"], tree["sums"]):
        below = tree["points"][lo:hi].astype(np.int64)
        assert (np.sqrt(((below - centre) ** 2).sum(axis=1)) <= radius).all() and (below.sum(axis=0) == sums).all()
    alone = sum(len(lo) for lo, _, _, sums in vector_codes.walk(tree, points[::400]) if sums is None)
    assert alone == 0


def test_decoded_vectors_are_near(spark):
    rows = random_rows(8, 200, 8, 0.01)
    codes, books = compressed(spark.createDataFrame(rows, ROW), entries=64)
    given = {i: v for i, v, _ in rows}
    for r in codes.withColumn("back", decoded(F.col("code"), books)).collect():
        off = sum((math.floor(1024 * a) - round(1024 * b)) ** 2 for a, b in zip(given[r.vec_id], r.back))
        assert off == r.error


def test_query_against_brute_force(spark, small):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    wanted, books = brute(rows)
    totals = defaultdict(int)
    for _, label, _, error in wanted:
        totals[label] += error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    out = sorted(tuple(r) for r in op13(spark, small).collect())
    assert out == sorted((i, code, error, totals[label], digest) for i, label, code, error in wanted)
