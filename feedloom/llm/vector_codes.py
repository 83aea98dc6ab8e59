"""Vector code compression: codebooks by Lloyd rounds over cover trees.

Components become integers, vectors are cut into equal parts, and each part is coded by the nearest of a codebook's entries. Blocks
of a partition's vectors are kept as cover trees, one per part, stored once: a node has a centre, a radius that covers the points
below it, and, from cumulative sums along the tree's order, the sum of these points. In a round a node keeps the entries that may be nearest to
some point below it: entry e stays while d(centre, e) <= d(centre, nearest entry) + 2 radius. With one entry left the whole
subtree goes to it by count and sum; only ambiguous nodes hand their entries down, and points of ambiguous leaves are compared
exactly. A level of all trees of a block is one matrix product. Tasks send one count and sum per entry, so a round shuffles
entries, not vectors, and the driver holds only codebooks.

All decisions are those of exact integer arithmetic: doubles where every product is below 2^53, 64-bit integers beyond.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.storage import quoted, saved, spread_join

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
LIMIT = 1 << 26
BLOCK = 4096
LEAF = 24
SHRINK = 1.3
EXACT = float(1 << 53)
FIELDS = ("points", "order", "lo", "hi", "first", "last", "centre", "radius", "sums")


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & good, F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; beyond LIMIT on either side it is LIMIT."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))).cast("int"))


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries (rows of integers)."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4.0 * points.shape[1] * most * most < EXACT else np.int64
    p, e = points.astype(kind), entries.astype(kind)
    return (p * p).sum(axis=1)[:, None] - 2 * (p @ e.T) + (e * e).sum(axis=1)


def _to(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return ((points - centre) ** 2).sum(axis=1)


def cover_tree(points: np.ndarray, leaf: int = LEAF, shrink: float = SHRINK) -> dict[str, np.ndarray]:
    """A cover tree of integer rows, nodes by levels, the points below a node and the children of a node each in one range.

    The children of a node lie around its own centre and around points that no earlier child covers, with a radius smaller by `shrink`.
    `radius` is rounded up.
    """
    points = points.astype(np.int64)
    order = np.arange(len(points))
    lo, hi, first, last, centre, radius, away = [0], [len(points)], [], [], [0], [], [_to(points, points[0])]
    node = 0
    while node < len(lo):
        a, b, dist = lo[node], hi[node], away[node]
        away[node] = None
        far = int(dist.max())
        radius.append(np.sqrt(float(far)) * (1 + 1e-12))
        first.append(len(lo))
        if b - a > leaf and far > 0:
            near = far / (shrink * shrink)
            members, at, mid = order[a:b].copy(), a, centre[node]
            while len(members):
                inside = dist <= near
                own = members[inside]
                order[at:at + len(own)] = own
                lo.append(at)
                hi.append(at + len(own))
                centre.append(mid)
                away.append(dist[inside])
                at += len(own)
                members, dist = members[~inside], dist[~inside]
                if len(members):
                    mid = members[0]
                    dist = _to(points[members], points[mid])
        last.append(len(lo))
        node += 1
    ordered = points[order]
    total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(ordered, axis=0)])
    lo, hi = np.array(lo), np.array(hi)
    return {
        "points": ordered.astype(np.int32), "order": order.astype(np.int32), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32),
        "first": np.array(first, np.int32), "last": np.array(last, np.int32), "centre": points[np.array(centre)].astype(np.int32),
        "radius": np.array(radius), "sums": total[hi] - total[lo],
    }


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges one after the other, and for each the range it is of."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[of], of


def walk(tree: dict[str, np.ndarray], entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Decisions over a tree: (lo, hi, entry, sums) of nodes that go as a whole, and of single points (sums None)."""
    nodes = np.zeros(1, np.int64)
    alive = np.ones((1, len(entries)), bool)
    while len(nodes):
        away = np.sqrt(np.maximum(squares(tree["centre"][nodes], entries).astype(np.float64), 0))
        away[~alive] = np.inf
        reach = away.min(axis=1) + 2 * tree["radius"][nodes]
        alive = away <= (reach + 1e-9 * (reach + 1))[:, None]
        one = alive.sum(axis=1) == 1
        whole = nodes[one]
        yield tree["lo"][whole], tree["hi"][whole], alive[one].argmax(axis=1), tree["sums"][whole]
        nodes, alive = nodes[~one], alive[~one]
        leaf = tree["first"][nodes] == tree["last"][nodes]
        at, of = _ranges(tree["lo"][nodes[leaf]], tree["hi"][nodes[leaf]])
        if len(at):
            exact = squares(tree["points"][at], entries)
            exact = np.where(alive[leaf][of], exact, np.iinfo(np.int64).max if exact.dtype == np.int64 else np.inf)
            yield at, at + 1, exact.argmin(axis=1), None
        inner, mask = nodes[~leaf], alive[~leaf]
        nodes, of = _ranges(tree["first"][inner], tree["last"][inner])
        alive = mask[of]


def nearest(tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and exact squared distance of each point, in the order the points had before the tree."""
    code = np.empty(len(tree["order"]), np.int64)
    for lo, hi, entry, _ in walk(tree, entries):
        at, of = _ranges(lo, hi)
        code[at] = entry[of]
    error = ((tree["points"].astype(np.int64) - entries[code]) ** 2).sum(axis=1)
    out, off = np.empty_like(code), np.empty_like(error)
    out[tree["order"]], off[tree["order"]] = code, error
    return out, off


def tallies(tree: dict[str, np.ndarray], entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and sum of the points of each entry."""
    count, total = np.zeros(len(entries), np.int64), np.zeros(entries.shape, np.int64)
    for lo, hi, entry, sums in walk(tree, entries):
        np.add.at(count, entry, hi - lo)
        np.add.at(total, entry, tree["points"][lo] if sums is None else sums)
    return count, total


def _rows(column: pa.Array, size: int) -> np.ndarray:
    """Lists as rows of `size` numbers, zeros behind shorter ones."""
    ends = np.asarray(column.value_lengths()).astype(np.int64)
    out = np.zeros((len(column), size), np.int64)
    out[np.arange(size) < ends[:, None]] = np.asarray(column.flatten())
    return out


def _packed(tree: dict[str, np.ndarray]) -> bytes:
    file = io.BytesIO()
    np.savez(file, **tree)
    return file.getvalue()


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as file:
        return {name: file[name] for name in FIELDS}


def stored_trees(vectors: DataFrame, width: int, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """(ids, labels, trees) per block of a partition's rows (vec_id, label, v); stored in the shared folder."""
    kind = {f.name: f.dataType.simpleString() for f in vectors.schema}

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(batches).combine_chunks()
            rows = _rows(table["v"].combine_chunks(), width * parts)
            trees = [_packed(cover_tree(rows[:, k * width:(k + 1) * width])) for k in range(parts)]

            def listed(name):
                return pa.ListArray.from_arrays([0, len(table)], table[name].combine_chunks())

            return pa.RecordBatch.from_arrays([listed("vec_id"), listed("label"), pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

        waiting, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                piece = batch.slice(at, block)
                if size + piece.num_rows > block:
                    yield packed(waiting)
                    waiting, size = [], 0
                waiting, size = [*waiting, piece], size + piece.num_rows
        if size:
            yield packed(waiting)

    return saved(vectors.mapInArrow(build, f"ids array<{kind['vec_id']}>, labels array<{kind['label']}>, trees array<binary>"), "vector_trees")


def lloyd_round(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round: each entry the floored mean of its points, entries without points as they were."""
    width = books[0].shape[1]

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [[np.zeros(len(b), np.int64), np.zeros(b.shape, np.int64)] for b in books]
        for batch in batches:
            for block in batch["trees"]:
                for sums, tree, book in zip(found, block, books):
                    count, total = tallies(_unpacked(tree.as_py()), book)
                    sums[0] += count
                    sums[1] += total
        for part, (count, total) in enumerate(found):
            used = np.flatnonzero(count)
            if len(used):
                lists = pa.ListArray.from_arrays(np.arange(len(used) + 1) * width, pa.array(total[used].ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(count[used]), lists], ["part", "entry", "n", "total"])

    tallied = trees.select("trees").mapInArrow(tally, "part int, entry int, n long, total array<long>")
    sums = F.array(*[F.sum(F.get("total", F.lit(k))) for k in range(width)])
    new = [book.copy() for book in books]
    for row in tallied.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums.alias("total")).collect():  # entries, not vectors
        new[row.part][row.entry] = np.array(row.total, np.int64) // row.n
    return new


def compressed(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of all vectors without null or non-finite components, and the codebooks.

    A codebook starts with its part of the vectors of the `entries` (256 at most) smallest ids, null ids last, equal ids by their components. Ties go to the lower index.
    Vectors shorter than the longest, or whose length `parts` does not divide, count as filled up with zeros, an empty one as all zeros. Components
    beyond 65536 on either side count as that bound (up to 2048 components all figures are exact). Repeated rows are coded each. An empty table gives an empty result and empty codebooks.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index is two hex digits")
    kept = vectors.filter(finite(quoted(vector))).select(quoted(vec_id).alias("vec_id"), quoted(label).alias("label"), integers(quoted(vector), scale).alias("v"))
    width = max(1, -(-(kept.agg(F.max(F.size("v"))).first()[0] or 0) // parts))
    start = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).select("v").collect()  # at most 256 rows
    first = np.zeros((len(start), width * parts), np.int64)
    for k, row in enumerate(start):
        first[k, :len(row.v)] = row.v
    books = [first[:, k * width:(k + 1) * width] for k in range(parts)]
    trees = stored_trees(kept, width, parts)
    for _ in range(rounds if start else 0):
        books = lloyd_round(trees, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = [nearest(_unpacked(tree.as_py()), book) for tree, book in zip(batch["trees"][k], books)]
                digits = ["".join(f"{x:02x}" for x in row) for row in np.stack([c for c, _ in found], axis=1).tolist()]
                errors = sum(e for _, e in found)
                yield pa.RecordBatch.from_arrays([batch["ids"][k].values, batch["labels"][k].values, pa.array(digits, pa.string()), pa.array(errors)], ["vec_id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in kept.schema}
    return saved(trees.mapInArrow(code, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"), "vector_codes"), books


def decoded(code: Column, books: list[np.ndarray], scale: int = SCALE) -> Column:
    """The vector that a code stands for: the entries' components, divided by `scale`."""
    pieces = []
    for part, book in enumerate(books):
        index = F.conv(F.substring(code, 2 * part + 1, 2), 16, 10).cast("int")
        pieces.append(F.get(F.array(*[F.array(*[F.lit(float(x) / scale) for x in row]) for row in book.tolist()]), index))
    return F.concat(*pieces)


def codebooks_sha256(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def op13(spark, folder: str) -> DataFrame:
    """Codes of all `embeddings`, the total error of each label beside them."""
    codes, books = compressed(spark.read.parquet(f"{folder}/embeddings.parquet"))
    totals = saved(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    told = spread_join(codes, totals, "label", F.col("vec_id"))
    return told.select("vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """One round as common table expressions: parts get the nearest entry of codebook k, then codebook k + 1."""
    return f"""
near{k} AS (
  SELECT p.vec, p.part, min((p.q - 2 * list_dot_product(p.x, b.x) + b.q)::BIGINT * 256 + b.entry) AS m FROM pieces p JOIN book{k} b ON b.part = p.part GROUP BY p.vec, p.part
), mean{k} AS (
  SELECT part, entry, list(floor(s / c)::DOUBLE ORDER BY pos) AS x FROM (
    SELECT n.part, n.m % 256 AS entry, d.pos, sum(d.v) AS s, count(*) AS c FROM near{k} n JOIN digits d ON d.vec = n.vec AND d.part = n.part GROUP BY ALL) GROUP BY part, entry
), book{k + 1} AS (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x, list_dot_product(coalesce(m.x, b.x), coalesce(m.x, b.x)) AS q FROM book{k} b LEFT JOIN mean{k} m ON m.part = b.part AND m.entry = b.entry
)"""


OP13_SQL = """
WITH kept AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS vec, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), pieces AS (
  SELECT vec, part::INT AS part, v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4] AS x,
    list_dot_product(v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4], v[part * len(v) // 4 + 1 : (part + 1) * len(v) // 4]) AS q FROM kept, range(4) r(part)
), digits AS (
  SELECT vec, part, unnest(x) AS v, unnest(range(len(x))) AS pos FROM pieces
), book0 AS (
  SELECT part, vec AS entry, x, q FROM pieces WHERE vec < 256
),""" + ",".join(_round_sql(k) for k in range(ROUNDS)) + """
, final AS (
  SELECT p.vec, p.part, min((p.q - 2 * list_dot_product(p.x, b.x) + b.q)::BIGINT * 256 + b.entry) AS m FROM pieces p JOIN book4 b ON b.part = p.part GROUP BY p.vec, p.part
), codes AS (
  SELECT vec, string_agg(lower(printf('%02x', m % 256)), '' ORDER BY part) AS code, sum(m // 256)::BIGINT AS error FROM final GROUP BY vec
), books AS (
  SELECT sha256(string_agg(array_to_string(list_transform(x, lambda v: v::BIGINT::VARCHAR), ','), ',' ORDER BY part, entry)) AS h FROM book4
)
SELECT k.vec_id, c.code, c.error, sum(c.error) OVER (PARTITION BY k.label)::BIGINT AS label_error, h AS codebooks_sha256 FROM kept k JOIN codes c ON c.vec = k.vec, books
"""
