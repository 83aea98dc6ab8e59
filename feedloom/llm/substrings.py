"""Substring deduplication by sliding sentence spans.

A text is cut after sentence ends and at line ends. Sentences of more than UNIT_WORDS words are also cut by what they say: after
the word of the smallest hash of every WINDOW words in a row. Such a cut depends on less than WINDOW words on either side, so a
passage is cut at the same places wherever it stands. From each unit goes the shortest run of at least two that has
MIN_WORDS words. A repeated passage of more than MIN_WORDS + 2 * UNIT_WORDS words (50) with the same line ends holds a whole run, from
whatever place it begins: up to UNIT_WORDS words to the first shared cut, MIN_WORDS + WINDOW - 1 at most to the end of a run (or a short
sentence's end), and WINDOW until that cut is sure. Runs are joined by their hashes over all documents, and units covered
by a run that also stands earlier are removed.

Runs that occur once are told by their counts first, which are added up before the shuffle; a Bloom filter of the repeated ones, of bounded size, then keeps
nearly all others from travelling with their places. A run that stands in a third of all documents is one row of the table of first places, and the join
with it has nothing above that needs its rows together, so adaptive execution splits it.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedloom.llm.bloom import block_count, blocked_filter, possible
from feedloom.llm.storage import discard, free_name, quoted, saved

MIN_WORDS = 30
UNIT_WORDS = 10
WINDOW = 5
SLICES = 2
SENTENCE = re.compile(r"\S[^\n]*?(?:[.!?]+(?=\s)|(?=\n)|\Z)")
WORD = re.compile(r"\S+")


def _cuts(words: list[str]) -> list[int]:
    """Numbers of words before each cut of a long sentence, its end among them; of equal hashes the last counts."""
    last = (1 << 32) - 1
    keys = [zlib.crc32(w.encode()) << 32 | last - at for at, w in enumerate(words, 1)]
    chosen = {last - (min(keys[low:low + WINDOW]) & last) for low in range(len(keys) - WINDOW + 1)}
    return sorted(chosen | {len(words)})


def units(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each sentence or part of a long one; white space inside does not count."""
    found = []
    for sentence in SENTENCE.finditer(text):
        words = sentence.group().split()
        if len(words) <= UNIT_WORDS:
            end = sentence.start() + len(sentence.group().rstrip())
            found.append((sentence.start(), end, len(words), xxhash.xxh3_64_digest(" ".join(words).encode())))
            continue
        places, low = [m.span() for m in WORD.finditer(text, sentence.start(), sentence.end())], 0
        for high in _cuts(words):
            digest = xxhash.xxh3_64_digest(" ".join(words[low:high]).encode())
            found.append((places[low][0], places[high - 1][1], high - low, digest))
            low = high
    return found


def runs(text: str, least: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 128-bit hash (two numbers) of the shortest long enough run from each sentence on."""
    found = units(text)
    if len(found) < 2:
        return np.empty(0, np.int32), np.empty(0, np.int32), np.empty((0, 2), np.int64)
    starts, ends, words, digests = zip(*found)
    total = np.r_[0, np.cumsum(words)]
    n = len(found)
    # the first unit after the run; at least two units
    after = np.maximum(np.searchsorted(total, total[:-1] + least, "left"), np.arange(n) + 2)
    first = np.flatnonzero(after <= n)
    joined = b"".join(digests)
    digest = xxhash.xxh3_128_digest
    raw = b"".join([digest(joined[8 * i:8 * j]) for i, j in zip(first.tolist(), after[first].tolist())])
    return (np.array(starts, np.int32)[first], np.array(ends, np.int32)[after[first] - 1],
            np.frombuffer(raw, "<i8").reshape(-1, 2))


def _run_arrays(least: int):
    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                made = [runs(t or "", least) for t in part.column(2).to_pylist()]
                offsets = pa.array(np.cumsum([0, *(len(m[0]) for m in made)]), pa.int32())
                columns = [np.concatenate(c) for c in zip(*((s, e, h[:, 0], h[:, 1]) for s, e, h in made))]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *lists], ["row", "doc_id", "start", "end", "h1", "h2"])

    return compute


def repeated_spans(docs: DataFrame, row: str, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(row, start, end, first_doc_id): spans whose words also stand earlier, by (doc_id, row, place).

    A span that overlaps the first one of its words, in the same text, is none. A null doc_id comes last.
    """
    inputs = docs.select(quoted(row).alias("row"), quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    kinds = "row long, doc_id long, start array<int>, end array<int>, h1 array<long>, h2 array<long>"
    arrays = saved(inputs.mapInArrow(_run_arrays(least), kinds), "runs")
    hashes = arrays.select(F.explode("h1").alias("h1"))
    parts = []
    for k in range(SLICES):  # the shuffle of each slice of the hashes is removed before the next
        counts = hashes.filter(F.pmod("h1", F.lit(SLICES)) == k).groupBy("h1").agg(F.count(F.lit(1)).alias("n"))
        parts.append(saved(counts.filter("n > 1").select("h1"), "often"))
    often = reduce(DataFrame.unionByName, parts)
    spans = arrays.select("row", "doc_id", F.explode(F.arrays_zip("start", "end", "h1", "h2")).alias("s")).select("row", "doc_id", "s.*")
    blocks = block_count(often.count())
    # stored before they are shuffled, without nearly all runs that occur once, so that the shuffle never stands beside the arrays
    likely = saved(possible(spans, blocked_filter(often, blocks, "h1"), blocks, "h1"), "likely")
    discard(arrays)
    hits = saved(likely.join(often, "h1"), "repeated")
    discard(likely, *parts)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "start", "end")
    firsts = hits.groupBy("h1", "h2").agg(F.min(order).alias("first")).select(
        "h1", "h2", F.col("first.row").alias("first_row"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.end").alias("first_end"))
    both = hits.select("row", "start", "end", "h1", "h2").join(firsts, ["h1", "h2"])
    return both.filter("row <> first_row or start >= first_end").select("row", "start", "end", "first_doc_id")


def _cut(text: str, spans: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the spans merged; the blank after a span goes with it."""
    merged: list[list[int]] = []
    for span in sorted((s["start"], s["end"]) for s in spans):
        if merged and span[0] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], span[1])
        else:
            merged.append(list(span))
    kept, at = [], 0
    for start, end in merged:
        kept.append(text[at:start])
        at = end + (text[end:end + 1] == " ")
    kept.append(text[at:])
    return "".join(kept), [(a, b) for a, b in merged]


def drop_repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text, n_removed, removed, first_doc_ids) of every row of `docs`.

    `text` is what is left, `removed` the merged spans (start, end) in code points, n_removed their characters, and
    first_doc_ids the documents in which the removed words stand first. Null texts stay null, empty and short ones stay
    as they are; repeated rows keep their words in the first row only. An empty table gives no rows.
    """
    row = free_name(docs, "row")
    stored = saved(docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"), F.monotonically_increasing_id().alias(row)), "spanned")
    found = repeated_spans(stored, row, "doc_id", "text", least)
    spans = saved(found.groupBy("row").agg(  # the spans of one text
        F.collect_list(F.struct("start", "end")).alias("spans"), F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids")), "spans")
    joined = stored.join(spans.withColumnRenamed("row", row) if row != "row" else spans, row, "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "spans", "first_doc_ids")
    schema = "doc_id long, text string, n_removed long, removed array<struct<start:int,end:int>>, first_doc_ids array<long>"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                left, merged = (t, []) if t is None or not s else _cut(t, s)
                texts.append(left)
                removed.append([{"start": a, "end": b} for a, b in merged])
            sizes = [sum(s["end"] - s["start"] for s in spans) for spans in removed]
            firsts = [f or [] for f in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, span_type),
                pa.array(firsts, pa.list_(pa.int64()))], ["doc_id", "text", "n_removed", "removed", "first_doc_ids"])

    return joined.mapInArrow(compute, schema)


def op5(spark, folder: str) -> DataFrame:
    return drop_repeated_spans(spark.read.parquet(f"{folder}/documents.parquet"))
