"""SimHash near-duplicates with bit-sliced comparison.

A text's fingerprint has a bit set where more than half of its word shingles' hashes have it. Fingerprints within
two bits link. Of four 16-bit blocks at least two are then equal, so fingerprints are dealt to six tables by the
32 bits of two blocks. Cells of one table are compared with vertical bit planes: one 64-bit word holds one bit of
64 fingerprints, the differing bits of all 64 are added up at once by carry-save counters, and a block is left as
soon as all its lanes exceed the radius. Large cells are dealt again by the same argument on the remaining 32 bits
(two of four bytes equal), after which 48 bits are equal and a cell has at most 65536 fingerprints, whatever the data.
Only distinct fingerprints are compared; each cell gives a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedloom.llm.components import components
from feedloom.llm.storage import free_name, quoted, saved

RADIUS = 2
SHINGLE = 3
SEED = 42
LARGE_CELL = 256
BLOCK = 65536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint as an unsigned number; 0 for a text without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams: Iterator[bytes] = iter((b" ".join(words),))
    else:
        grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = hashes[at:at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """`docs` with the signed 64-bit fingerprint of `text` as column `name`."""

    @F.pandas_udf("long")
    def simhash(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))

    return docs.withColumn(name, simhash(quoted(text)))


def _masks() -> list[tuple[int, list[int]]]:
    """For each of the six tables its mask of 32 bits, and the six masks of 48 bits for its large cells."""
    tables = []
    for pair in combinations(range(4), 2):
        mask = sum(0xFFFF << (16 * b) for b in pair)
        rest = [8 * k for k in range(8) if k // 2 not in pair]
        tables.append((mask, [mask | sum(0xFF << at for at in two) for two in combinations(rest, 2)]))
    return tables


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _masked(fp: Column, mask: int) -> Column:
    return fp.bitwiseAND(F.lit(_signed(mask)))


def _forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the links u-v."""
    label = np.arange(n)
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


def near_pairs(values: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j), i < j, of the values of one group that differ in at most `radius` (2) bits.

    `groups` is sorted; groups are packed to words of 64 lanes.
    """
    n = len(values)
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[starts, n])
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    place = np.arange(n) - np.repeat(starts, sizes)
    word = np.repeat(first_word, sizes) + place // 64
    lane = (place % 64).astype(np.uint64)
    heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    planes = np.empty((64, len(heads)), np.uint64)
    for b in range(64):
        planes[b] = np.bitwise_or.reduceat(((values >> np.uint64(b)) & one) << lane, heads)
    valid = np.bitwise_or.reduceat(one << lane, heads)
    row_of_word = np.arange(n)[heads]
    last_word = np.repeat(first_word + words, sizes)
    todo = last_word - word
    ends = np.cumsum(todo)
    low = 0
    while low < n:
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + BLOCK, "right")))
        query = np.repeat(np.arange(low, high), todo[low:high])
        ahead = np.arange(len(query)) - np.repeat(np.cumsum(todo[low:high]) - todo[low:high], todo[low:high])
        block = word[query] + ahead
        open_ = valid[block]
        own = ahead == 0
        after = np.where(lane[query] == 63, np.uint64(0), full << np.minimum(lane[query] + one, np.uint64(63)))
        open_ = np.where(own, open_ & after, open_)
        ones = np.zeros(len(query), np.uint64)
        twos, over = ones.copy(), ones.copy()
        for b in range(64):
            differ = planes[b][block] ^ (np.uint64(0) - ((values[query] >> np.uint64(b)) & one))
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
            if b % 8 == 7:
                out = over | (ones & twos)
                alive = (open_ & ~out) != 0
                if alive.mean() < 0.7:
                    query, block, open_ = query[alive], block[alive], open_[alive]
                    ones, twos, over = ones[alive], twos[alive], over[alive]
            if not len(query):
                break
        hits = open_ & ~(over | (ones & twos))
        at = np.flatnonzero(hits)
        if len(at):
            bits = np.unpackbits(hits[at].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, c = np.nonzero(bits)
            yield query[at][r], row_of_word[block[at][r]] + c
        low = high


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spanning links of each cell; rows come sorted by (table, sub, key), and a cell may span batches."""

    def links(cell: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        u, v = [], []
        for i, j in near_pairs(fps, cell):
            u.append(i)
            v.append(j)
        if not u:
            return None
        label = _forest(np.concatenate(u), np.concatenate(v), len(fps))
        child = np.flatnonzero(label != np.arange(len(fps)))
        signed = fps.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[child]), pa.array(signed[label[child]])], ["a", "b"])

    kept: list[np.ndarray] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
        kept.append(now)
        rows = np.concatenate(kept, axis=1)
        change = np.flatnonzero((rows[:3, 1:] != rows[:3, :-1]).any(axis=0)) + 1
        if not len(change):
            kept = [rows]
            continue
        done, kept = rows[:, : change[-1]], [rows[:, change[-1]:]]
        cell = np.searchsorted(change[:-1], np.arange(done.shape[1]), "right")
        if (out := links(cell, done[3].view(np.uint64))) is not None:
            yield out
    if kept:
        rows = np.concatenate(kept, axis=1)
        if (out := links(np.zeros(rows.shape[1], np.int64), np.ascontiguousarray(rows[3]).view(np.uint64))) is not None:
            yield out


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links that span all pairs of distinct `fp` within the radius."""
    masks = _masks()
    fp = F.col("fp")
    dealt = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(t).alias("t"), _masked(fp, mask).alias("key")) for t, (mask, _) in enumerate(masks)
    ])).alias("d")).select("fp", "d.t", "d.key")
    sizes = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    whole = F.array(F.struct(F.lit(-1).alias("s"), F.col("key").alias("key")))
    finer = F.array(*[
        F.struct(F.lit(s).alias("s"), F.element_at(F.array(*[_masked(fp, m[1][s]) for m in masks]), F.col("t") + 1).alias("key"))
        for s in range(6)
    ])
    cells = (
        dealt.join(sizes, ["t", "key"])
        .select("t", "fp", F.explode(F.when(F.col("n") <= LARGE_CELL, whole).otherwise(finer)).alias("c"))
        .select("t", "c.s", "c.key", "fp")
    )
    sorted_cells = cells.repartition("t", "s", "key").sortWithinPartitions("t", "s", "key")
    return sorted_cells.mapInArrow(_cell_links, "a long, b long")


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, row, root, component_id) of every row of `docs`.

    component_id is the smallest doc_id that links reach. Null texts count as empty; texts without words share
    fingerprint 0. Repeated rows and repeated ids stay separate rows of one class; a null id takes part, and a class
    with null ids only has a null component_id. `row` numbers the rows. An empty table gives no rows.
    """
    prints = with_fingerprint(docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")), "text", "fp")
    return classes_of(saved(prints.select("doc_id", "fp", F.monotonically_increasing_id().alias("row")), "simhash"))


def classes_of(prints: DataFrame) -> DataFrame:
    """Adds root (the class) and component_id to stored rows (doc_id, fp, ...)."""
    lowest = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(fingerprint_links(lowest.select("fp")), "a", "b")
    rooted = lowest.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = saved(rooted, "roots")
    classes = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = rooted.select("fp", "root").join(classes, "root").select("fp", "root", "component_id")
    return prints.join(by_print, "fp")


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each near-duplicate class: that of the smallest id, the first stored one among repeated rows.

    All columns are kept, whatever their names. Rows without an id come last in the choice.
    """
    row, fp = free_name(docs, "row"), free_name(docs, "fp")
    named = with_fingerprint(docs, text, fp).withColumn(row, F.monotonically_increasing_id())
    stored = saved(named, "fingerprinted")
    classes = classes_of(stored.select(quoted(doc_id).alias("doc_id"), F.col(fp).alias("fp"), F.col(row).alias("row")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    keep = classes.groupBy("root").agg(first).select(F.col("first.row").alias(row))
    return stored.join(keep, row, "left_semi").select(*[quoted(c) for c in docs.columns])


def op2(spark, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = near_duplicate_classes(docs)
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", text.alias("fingerprint"), "component_id")
