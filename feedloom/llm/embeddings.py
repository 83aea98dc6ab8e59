"""Embedding near-duplicates with a robust-pruned flat graph.

Equal vectors of one label are one node. Centroids are fitted per label on a bounded sample; every node goes to the shards of its
nearest centroids, so shards overlap. In each shard a node's candidates, its nearest nodes and some random ones, are
robust-pruned: a candidate goes if a chosen neighbour is nearer to it, by the factor ALPHA, than the node itself. The
adjacency lists of a node are then united over its shards. A shard's search cell holds its nodes and all their neighbours;
there each node that is at home in the shard is searched from the cell's medoid, greedily, and the search goes on
as long as nodes within the range are left to expand. Found pairs are verified in double precision. Recall is
measured against brute force for a bounded sample of queries over all nodes; below the target, the shards overlap more
and the search is run again.

Cells give counts and a spanning forest of links, so a dense cluster never sends all its pairs anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.components import components
from feedloom.llm.storage import quoted, saved

THRESHOLD = 0.98
SAMPLE = 20_000
PER_CENTROID = 8
SHARD = 400
DEGREE = 24
NEAREST = 64
RANDOM = 32
ALPHA = 1.2
BEAM = 32
EXPAND = 4
CELLS = 1 << 21
AUDIT = 200
RECALL = 0.95
OVERLAPS = (2, 4, 8)
SLACK = 1e-9


def _valid(vector: Column, label: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & vector.isNotNull() & good & some, F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def centroids(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit rows."""
    random = np.random.default_rng(seed)
    centres = sample[random.choice(len(sample), k, replace=False)]
    for _ in range(rounds):
        best = (sample @ centres.T).argmax(axis=1)
        for c in range(k):
            own = sample[best == c]
            if len(own):
                mean = own.sum(axis=0)
                norm = np.linalg.norm(mean)
                centres[c] = mean / norm if norm > 0 else centres[c]
    return centres


def robust_prune(units: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Up to `degree` neighbours of each node from its row of candidates (-1: none), nearest first, -1 where there is none."""
    missing = (candidates < 0) | (candidates == nodes[:, None])
    points = units[np.maximum(candidates, 0)]
    to_node = np.sqrt(np.maximum(0.0, 2 - 2 * np.einsum("bcd,bd->bc", points, units[nodes])))
    to_node[missing] = np.inf
    order = np.argsort(to_node, axis=1, kind="stable")
    candidates, to_node = np.take_along_axis(candidates, order, 1), np.take_along_axis(to_node, order, 1)
    points = np.take_along_axis(points, order[:, :, None], 1)
    between = np.sqrt(np.maximum(0.0, 2 - 2 * points @ points.transpose(0, 2, 1)))
    alive = np.isfinite(to_node)
    out = np.full((len(nodes), degree), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(degree):
        pick = alive.argmax(axis=1)
        some = alive[rows, pick]
        if not some.any():
            break
        out[some, k] = candidates[rows, pick][some]
        alive &= alpha * between[rows, pick] > to_node
        alive[rows, pick] = False
    return out


def _graph(units: np.ndarray, seed: int) -> np.ndarray:
    """Neighbours of each node of a shard, both directions, -1 where there is none."""
    n = len(units)
    random = np.random.default_rng(seed)
    near = min(NEAREST, n - 1)
    forward = np.empty((n, DEGREE), np.int64)
    step = max(1, min(128, CELLS // n))
    for low in range(0, n, step):
        nodes = np.arange(low, min(n, low + step))
        close = units[nodes] @ units.T
        close[np.arange(len(nodes)), nodes] = -2
        best = np.argpartition(-close, near - 1, axis=1)[:, :near] if near else np.empty((len(nodes), 0), np.int64)
        far = random.integers(0, n, (len(nodes), RANDOM))
        both = np.sort(np.concatenate([best, far], axis=1), axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        forward[nodes] = robust_prune(units, nodes, both)
    a, k = np.nonzero(forward >= 0)
    b = forward[a, k]
    pairs = np.unique(np.concatenate([np.stack([a, b], 1), np.stack([b, a], 1)]), axis=0)
    at = np.r_[0, np.cumsum(np.bincount(pairs[:, 0], minlength=n))]
    width = min(2 * DEGREE, int(np.diff(at).max(initial=0)))
    out = np.full((n, max(1, width)), -1, np.int64)
    place = np.arange(len(pairs)) - at[pairs[:, 0]]
    # forward neighbours always stay; of many reverse ones those that fit
    inside = place < width
    out[pairs[inside, 0], place[inside]] = pairs[inside, 1]
    return np.concatenate([forward, out], axis=1)


def _entries(units: np.ndarray, neighbours: np.ndarray) -> np.ndarray:
    """The medoid, and the medoid of what it does not reach, until all nodes are reached."""
    n = len(units)
    reached = np.zeros(n, bool)
    entries = []
    while not reached.all():
        rest = np.flatnonzero(~reached)
        medoid = rest[(units[rest] @ units[rest].mean(axis=0)).argmax()]
        entries.append(medoid)
        front = np.array([medoid])
        reached[medoid] = True
        while len(front):
            following = np.unique(neighbours[front])
            following = following[following >= 0]
            front = following[~reached[following]]
            reached[front] = True
    return np.array(entries)


def range_search(units: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) with a similarity of at least `least` that greedy search from the medoids meets.

    Each query keeps a beam of its nearest nodes so far. Open ones among the BEAM nearest, and all in range, are expanded; a
    beam that cannot hold all nodes in range grows.
    """
    n = len(units)
    entries = _entries(units, neighbours)
    step = max(1, min(256, CELLS // n))
    for low in range(0, len(queries), step):
        own = queries[low:low + step]
        rows = np.arange(len(own))
        width = max(2 * BEAM, len(entries))
        ids, open_ = np.zeros((len(own), width), np.int64), np.zeros((len(own), width), bool)
        near = np.full((len(own), width), -np.inf)
        seen = np.zeros((len(own), n), bool)
        seen[:, entries] = True
        ids[:, :len(entries)], open_[:, :len(entries)] = entries, True
        near[:, :len(entries)] = units[own] @ units[entries].T
        hits = [(rows.repeat(len(entries)), np.tile(entries, len(own)), near[:, :len(entries)].ravel())]
        while True:
            now = np.where(open_, near, -np.inf)
            best = np.argpartition(-now, EXPAND - 1, axis=1)[:, :EXPAND]
            score = np.take_along_axis(now, best, 1)
            bar = np.partition(near, width - BEAM, axis=1)[:, width - BEAM]
            row, column = np.nonzero(np.isfinite(score) & (score >= np.minimum(least, bar)[:, None]))
            if not len(row):
                break
            place = best[row, column]
            open_[row, place] = False
            reach = neighbours[ids[row, place]]
            r, c = np.nonzero(reach >= 0)
            q, m = row[r], reach[r, c]
            fresh = ~seen[q, m]
            key = np.unique(q[fresh] * n + m[fresh])
            if not len(key):
                continue
            q, m = key // n, key % n
            seen[q, m] = True
            similar = np.einsum("ij,ij->i", units[own[q]], units[m])
            hits.append((q, m, similar))
            counts = np.bincount(q, minlength=len(own))
            at = np.arange(len(q)) - (np.cumsum(counts) - counts)[q]
            shape = (len(own), int(counts.max()))
            more_ids, more_near, more_open = np.zeros(shape, np.int64), np.full(shape, -np.inf), np.zeros(shape, bool)
            more_ids[q, at], more_near[q, at], more_open[q, at] = m, similar, True
            ids, near, open_ = (np.concatenate(x, axis=1) for x in ((ids, more_ids), (near, more_near), (open_, more_open)))
            width = max(width, int((near >= least).sum(axis=1).max()) + BEAM)
            if near.shape[1] > width:
                kept = np.argpartition(-near, width - 1, axis=1)[:, :width]
                ids, near, open_ = (np.take_along_axis(x, kept, 1) for x in (ids, near, open_))
            else:
                width = near.shape[1]
        q, m, similar = (np.concatenate(x) for x in zip(*hits))
        true = similar >= least
        yield own[q[true]], m[true]


def _assign(centres: dict[tuple, tuple[int, np.ndarray]], overlap: int):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(node, shards) with the nearest shard first; groups without centroids are one shard, number 0."""
        for batch in batches:
            labels, sizes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i, group in enumerate(zip(labels, sizes)):
                groups.setdefault(group, []).append(i)
            shards: list[list[int]] = [[0]] * batch.num_rows
            for group, rows in groups.items():
                if group in centres:
                    units = _unit(_matrix(batch.column(3).take(pa.array(rows))))
                    near = np.argsort(-(units @ centres[group].T), axis=1, kind="stable")[:, :overlap]
                    for i, own in zip(rows, near.tolist()):
                        shards[i] = own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shards, pa.list_(pa.int32()))], ["node", "shards"])

    return compute


def _fit(nodes: DataFrame) -> dict[tuple, np.ndarray]:
    """Centroids of each (label, size) with more than SHARD nodes, from the SAMPLE nodes of the smallest hashes."""
    counts = nodes.groupBy("label", "size").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SHARD)
    large = {(r.label, r.size): r.n for r in counts.orderBy(F.desc("n"), "label", "size").limit(SAMPLE // PER_CENTROID).collect()}
    if not large:
        return {}
    h = F.xxhash64("node")
    last = nodes.select(h.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h").alias("h")).first().h  # hashes only
    picked = nodes.filter(h <= last).select("label", "size", "vector").toArrow()
    by_group: dict[tuple, list[int]] = {}
    for i, group in enumerate(zip(picked.column(0).to_pylist(), picked.column(1).to_pylist())):
        by_group.setdefault(group, []).append(i)
    out = {}
    for group, n in large.items():
        rows = by_group.get(group, [])
        k = min(-(-n // SHARD), len(rows) // PER_CENTROID)
        if k > 1:
            out[group] = centroids(_unit(_matrix(picked.column(2).take(pa.array(rows)))), k)
    return out


def _build(table: pa.Table) -> pa.Table:
    """(node, near) of one shard."""
    nodes = table.column("node").to_numpy()
    order = np.argsort(nodes, kind="stable")
    units = _unit(_matrix(table.column("vector")))[order]
    nodes = nodes[order]
    if len(nodes) == 1:
        near = [[]]
    else:
        graph = _graph(units, seed=len(nodes))
        near = [np.unique(nodes[row[row >= 0]]) for row in graph]
    return pa.table({"node": nodes, "near": pa.array(near, pa.list_(pa.int64()))})


def _search(table: pa.Table) -> pa.Table:
    """(node, links, root) of one cell: links of the nodes at home in it, and the spanning forest of its links."""
    nodes = table.column("node").to_numpy()
    order = np.argsort(nodes, kind="stable")
    raw = _matrix(table.column("vector"))[order]
    units, nodes = _unit(raw), nodes[order]
    weight = table.column("n").to_numpy()[order]
    home = table.column("home").to_numpy(zero_copy_only=False)[order].astype(bool)
    lists = table.column("near").combine_chunks().take(pa.array(order))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    at = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
    owner = np.repeat(np.arange(len(nodes)), np.diff(at))
    target = np.minimum(np.searchsorted(nodes, flat), len(nodes) - 1)
    inside = nodes[target] == flat if len(flat) else np.zeros(0, bool)
    owner, target = owner[inside], target[inside]
    degree = np.bincount(owner, minlength=len(nodes))
    start = np.r_[0, np.cumsum(degree)]
    graph = np.full((len(nodes), max(1, int(degree.max(initial=0)))), -1, np.int64)
    graph[owner, np.arange(len(owner)) - start[owner]] = target
    links = np.zeros(len(nodes), np.int64)
    label = np.arange(len(nodes))
    length = np.linalg.norm(raw, axis=1)
    for query, node in range_search(units, graph, np.flatnonzero(home), THRESHOLD - SLACK):
        other = query != node
        query, node = query[other], node[other]
        exact = np.einsum("ij,ij->i", raw[query], raw[node]) / (length[query] * length[node])
        plain = np.isfinite(exact)
        true = np.where(plain, exact, np.einsum("ij,ij->i", units[query], units[node])) >= THRESHOLD
        query, node = query[true], node[true]
        np.add.at(links, query, weight[node])
        label = _join(label, query, node)
    touched = home | (label != np.arange(len(nodes)))
    counted = pa.array(links[touched], mask=~home[touched])
    return pa.table({"node": nodes[touched], "links": counted, "root": nodes[label[touched]]})


def _join(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest index of each component after the links u-v."""
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _linked(nodes: DataFrame, centres: dict, overlap: int) -> DataFrame:
    """(node, links, root) rows of all cells."""
    assigned = nodes.select("node", "label", "size", "vector").mapInArrow(_assign(centres, overlap), "node long, shards array<int>")
    placed = saved(nodes.join(assigned, "node"), "placed")
    members = placed.select("label", "size", F.explode("shards").alias("shard"), "node", "vector")
    built = members.groupBy("label", "size", "shard").applyInArrow(
        lambda table: _build(table.select(["node", "vector"])), "node long, near array<long>")
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # one list per shard
    graph = saved(placed.join(united, "node"), "graph")
    own = graph.select("label", "size", F.explode("shards").alias("shard"), "node", "near")
    around = own.select("label", "size", "shard", F.explode("near").alias("node"))
    cells = own.select("label", "size", "shard", "node").unionByName(around).distinct()
    rows = cells.select("shard", "node").join(graph, "node").withColumn("home", F.col("shards")[0] == F.col("shard"))
    return saved(rows.select("label", "size", "shard", "node", "vector", "n", "near", "home").groupBy("label", "size", "shard").applyInArrow(
        lambda table: _search(table), "node long, links long, root long"), "found")


def recall(nodes: DataFrame, found: DataFrame) -> float:
    """Found by true links of the AUDIT nodes of the smallest hashes, compared with all nodes by brute force in blocks.

    The queries are AUDIT vectors, whatever the size of the table; 1.0 if they have no links.
    """
    picked = nodes.orderBy(F.xxhash64("node", F.lit("audit"))).limit(AUDIT).select("node", "label", "size", "vector").collect()
    if not picked:
        return 1.0
    by_group: dict[tuple, tuple[list[int], np.ndarray]] = {}
    for group in {(r.label, r.size) for r in picked}:
        own = [r for r in picked if (r.label, r.size) == group]
        by_group[group] = ([r.node for r in own], np.array([r.vector for r in own], np.float64))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals: dict[int, int] = {}
            groups: dict[tuple, list[int]] = {}
            for i, group in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                groups.setdefault(group, []).append(i)
            for group, rows in groups.items():
                if group in by_group:
                    names, queries = by_group[group]
                    at = pa.array(rows)
                    block = _matrix(batch.column(3).take(at))
                    ids, weight = batch.column(0).take(at).to_numpy(), batch.column(4).take(at).to_numpy()
                    cosine = _unit(queries) @ _unit(block).T
                    near = (cosine >= THRESHOLD) & (np.array(names)[:, None] != ids[None, :])
                    for name, n in zip(names, (near * weight).sum(axis=1).tolist()):
                        totals[name] = totals.get(name, 0) + int(n)
            if totals:
                yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], ["node", "true"])

    true = nodes.select("node", "label", "size", "vector", "n").mapInArrow(compare, "node long, true long")
    both = true.groupBy("node").agg(F.sum("true").alias("true")).join(found.filter("links is not null"), "node", "left")
    sums = both.agg(F.sum("true").alias("t"), F.sum(F.least(F.coalesce("links", F.lit(0)), F.col("true"))).alias("f")).first()
    return 1.0 if not sums.t else sums.f / sums.t


def near_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept, recall) of every row.

    Rows with a null label, a null or empty vector, null or non-finite numbers or only zeros link with nothing. Vectors of
    different lengths never link. Repeated rows link with each other; a null vec_id takes part, comes after all
    others as component_id, and is never kept. An empty table gives no rows. `recall` is that of the audit.
    """
    ok = _valid(quoted(vector), quoted(label))
    inputs = rows.select(quoted(vec_id).alias("vec_id"), quoted(label).alias("label"), quoted(vector).alias("vector"), ok.alias("ok"))
    clean = F.transform("vector", lambda x: F.when(x == 0, F.lit(0).cast("float")).otherwise(x))
    good = inputs.filter("ok").withColumn("vector", clean)
    same = good.groupBy("label", "vector").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    nodes = saved(same.select(F.monotonically_increasing_id().alias("node"), "label", F.size("vector").alias("size"), "vector", "low", "n"), "nodes")
    centres = _fit(nodes)
    for overlap in OVERLAPS:
        found = _linked(nodes, centres, overlap)
        reached = recall(nodes, found)
        if reached >= RECALL or overlap >= max((len(c) for c in centres.values()), default=1):
            break
    roots = components(found.filter("node <> root"), "node", "root")
    counts = found.filter("links is not null").select("node", "links")
    joined = nodes.join(counts, "node", "left").join(roots.withColumnRenamed("root", "top"), "node", "left")
    joined = saved(joined.withColumn("top", F.coalesce("top", "node")), "linked")
    lowest = joined.groupBy("top").agg(F.min("low").alias("component_id"))
    classes = joined.join(lowest, "top").select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = good.join(classes, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = inputs.filter(~F.col("ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return out.withColumn("recall", F.lit(float(reached)))


def op7(spark, folder: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{folder}/embeddings.parquet"))
