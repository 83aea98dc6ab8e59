import numpy as np
import pytest
from pyspark.sql import functions as F

from feedloom.llm import embeddings
from feedloom.llm.embeddings import near_vectors, robust_prune
from llm_help import classes

ROW = "vec_id long, embedding array<float>, label int"


def brute(rows):
    good = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)]
    links = []
    for n, i in enumerate(good):
        for j in good[n + 1:]:
            a, b = (np.array(rows[k][1], np.float32).astype(np.float64) for k in (i, j))
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                links.append((i, j))
    return links


def table():
    r = np.random.default_rng(2)
    rows = []
    for label in (0, 1, 2):
        for k in range(150):
            base = r.normal(size=16)
            for _ in range(r.integers(1, 5)):
                rows.append([base + r.normal(size=16) * r.choice([0.0, 0.02, 0.05, 0.1]), label])
    chain = r.normal(size=16)
    for k in range(60):  # neighbours link, the ends do not
        chain = chain + r.normal(size=16) * 0.1
        rows.append([chain.copy(), 1])
    dense = r.normal(size=16)
    rows += [[dense + r.normal(size=16) * 0.03, 2] for _ in range(150)]
    out = [(7 * k % 1999, [float(x) for x in np.float32(v)], label) for k, (v, label) in enumerate(rows)]
    out += [(2000 + k, out[3][1], out[3][2]) for k in range(50)] + [(3000, out[3][1], None), (3001, None, 1), (3002, [], 1), (3003, [0.0] * 16, 1)]
    out += [(3004, [float("nan")] * 16, 1), (3005, [float("inf")] + [1.0] * 15, 1), (3006, [None] + [1.0] * 15, 1), (3007, [1.0, 0.0], 1), (3008, [2.0, 0.0], 1)]
    return out + [(3009, [1e-30, 1e-30], 1), (3010, [1e-30, 1.1e-30], 1), (None, [1.0, 0.001], 1)]


@pytest.mark.parametrize("shard", [1500, 60])
def test_links_are_those_of_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(embeddings, "SHARD", shard)
    rows = table()
    links = brute(rows)
    out = near_vectors(spark.createDataFrame(rows, ROW).withColumn("node", F.lit(1))).collect()
    assert len(out) == len(rows)
    counts = np.zeros(len(rows), int)
    for i, j in links:
        counts[[i, j]] += 1
    found = {r.vec_id: r for r in out}
    got = sum(found[rows[k][0]].n_links for k in range(len(rows)))
    assert all(found[rows[k][0]].n_links <= counts[k] for k in range(len(rows)))
    assert got >= (0.999 if shard == 1500 else 0.97) * counts.sum()
    if shard == 1500:
        root = classes(range(len(rows)), links)
        lowest = {}
        for k in range(len(rows)):
            if rows[k][0] is not None:
                lowest[root[k]] = min(lowest.get(root[k], 1 << 60), rows[k][0])
        assert all(found[rows[k][0]].component_id == lowest.get(root[k]) for k in range(len(rows)))
        assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in out)
    assert all(r.recall >= 0.95 for r in out)


def test_empty_table_and_pruning(spark):
    assert near_vectors(spark.createDataFrame([], ROW)).count() == 0
    angles = np.array([0, 0.1, 0.11, 0.5, -0.3])
    units = np.stack([np.cos(angles), np.sin(angles)], 1)
    near = robust_prune(units, np.array([0]), np.array([[1, 2, 3, 4, -1]]))
    assert near[0, :3].tolist() == [1, 4, -1]  # 2 and 3 are nearer to 1 than to 0
