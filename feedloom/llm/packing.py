"""Best-fit packing of token sequences by hierarchical residual packing.

Every partition tokenises its texts and packs its pieces best-fit, longest first; in a tree of rounds the bins that are
left underfull then meet as items of a new best-fit round. After best-fit no two bins of one node fit together, so
at most one of them is at most half full. Only that one can still move, and only into a bin with room: a node passes
up this one and as many of its emptiest other bins as it has siblings. All other bins are emitted where they
are. What travels is therefore bounded by the number of partitions, not by the data.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.llm.storage import quoted, saved

CAPACITY = 4096
END = 1
FAN_IN = 16
CHUNK = 200_000
CACHE = 600_000
MARK = r"[!-&(-/:-@\[-`{-~]"  # an ASCII mark other than the apostrophe
MOVES = [(n, pa.int64()) for n in ("owner", "bin", "to_owner", "to_bin", "shift", "fill")] + [("travels", pa.bool_())]
_CACHES: dict[str, tuple[object, dict[str, bytes]]] = {}


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str) -> tuple[object, dict[str, bytes]]:
    """The tokenizer of this worker and what it has made of words so far (about CACHE of them at most)."""
    if path not in _CACHES:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _CACHES[path] = (Tokenizer.from_file(path), {})
    return _CACHES[path]


def _piece_ids(pieces: list[str], path: str) -> list[bytes]:
    """Ids of each of these different pieces; the worker remembers about CACHE of them."""
    tokenizer, known = _tokenizer(path)
    found = list(map(known.get, pieces))
    new = [k for k, ids in enumerate(found) if ids is None]
    for at in range(0, len(new), 20_000):
        some = new[at:at + 20_000]
        made = [e.ids for e in tokenizer.encode_batch_fast([pieces[k] for k in some], add_special_tokens=False)]
        ends = np.cumsum([0, *map(len, made)]) * 4
        raw = np.fromiter(chain.from_iterable(made), "<u4", ends[-1] // 4).tobytes()
        for k, low, high in zip(some, ends.tolist(), ends[1:].tolist()):
            found[k] = raw[low:high]
    if len(known) < CACHE:
        known.update((pieces[k], found[k]) for k in new)
    return found


def _gathered(ids: np.ndarray, begin: np.ndarray, which: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of sequences of items, and where each sequence begins: item k has ids[begin[k]:begin[k + 1]], sequence j the items which[bounds[j]:bounds[j + 1]]."""
    sizes = np.diff(begin)[which]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    return ids[np.repeat(begin[which] - upto[:-1], sizes) + np.arange(upto[-1])], upto[bounds]


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The different parts of texts between ASCII white space, the parts of each text by number, and where each text's parts begin."""
    lists = pc.ascii_split_whitespace(texts)
    bounds = lists.offsets.to_numpy()
    parts = lists.flatten().dictionary_encode()
    return parts.dictionary, parts.indices.to_numpy(), bounds - bounds[0]


def _slices(texts: list[str], size: int = 4_000_000) -> Iterator[list[str]]:
    """Neighbouring texts of about `size` characters together, one at least."""
    held, total = [], 0
    for text in texts:
        if held and total + len(text) > size:
            yield held
            held, total = [], 0
        held.append(text)
        total += len(text)
    if held:
        yield held


def token_bytes(texts: list[str | None], path: str, end: int = END) -> list[bytes]:
    """Little-endian 32-bit ids of each text, followed by `end`.

    The vocabulary lower-cases, drops white space and never merges across it or across the border of a letter and a mark, so a text's ids are
    those of its words between ASCII white space, and a word's those of its pieces between ASCII letters and marks (the apostrophe aside, as it
    begins endings). Each different piece is tokenised once. A word that may hold a special token is one piece and
    keeps its case, as special tokens are found by case before anything else.
    """
    last, out = np.array([end], "<u4").tobytes(), []
    for some in _slices([t or "" for t in texts]):
        words, in_text, text_bounds = _split(pa.array(some, pa.large_string()))
        low = pc.ascii_lower(words)
        for border in (f"([a-z])({MARK})", f"({MARK})([a-z])"):
            low = pc.replace_substring_regex(low, border, r"\1 \2")
        pieces, in_word, word_bounds = _split(pc.if_else(pc.match_substring(words, "<|"), words, low))
        made = _piece_ids(pieces.to_pylist(), path)
        begin = np.concatenate([[0], np.cumsum(np.fromiter(map(len, made), np.int64, len(made)) // 4)])
        ids, begin = _gathered(np.frombuffer(b"".join(made), "<u4"), begin, in_word, word_bounds)
        ids, begin = _gathered(ids, begin, in_text, text_bounds)
        data, ends = ids.tobytes(), (4 * begin).tolist()
        out += [data[a:b] + last for a, b in zip(ends, ends[1:])]
    return out


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first into the fullest bin with room; and the bins' fills."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fills: list[int] = []
    rooms: list[int] = []
    with_room: dict[int, list[int]] = {}
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        at = bisect_left(rooms, need)
        if at == len(rooms):
            chosen = len(fills)
            fills.append(0)
        else:
            room = rooms[at]
            chosen = with_room[room].pop()
            if not with_room[room]:
                del with_room[room]
                rooms.pop(at)
        bins[item], offsets[item] = chosen, fills[chosen]
        fills[chosen] += need
        left = capacity - fills[chosen]
        if left:
            if left not in with_room:
                with_room[left] = []
                insort(rooms, left)
            with_room[left].append(chosen)
    return bins, offsets, np.array(fills, np.int64)


def _local(path: str, capacity: int, end: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of a partition with their bins; bins are numbered within it, chunk after chunk."""
        kept: list[tuple] = []
        held = first = 0
        step = 4 * capacity

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal kept, held, first
            if not held:
                return
            ids, piece, start, length, crc = (np.concatenate(c) for c in zip(*(k[1:] for k in kept)))
            docs = pa.concat_arrays([k[0] for k in kept])
            bins, offsets, fills = best_fit(length, capacity)
            for at in range(0, len(ids), 10_000):
                cut = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays([
                    docs.take(pa.array(ids[cut])), pa.array(piece[cut].astype(np.int32)), pa.array(start[cut]),
                    pa.array(length[cut]), pa.array(crc[cut]), pa.array(bins[cut] + first), pa.array(offsets[cut]),
                    pa.array(fills[bins[cut]]),
                ], ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "at", "fill"])
            first += len(fills)
            kept, held = [], 0

        rows = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                some = batch.slice(low, 1000)
                tokens = token_bytes(some.column(1).to_pylist(), path, end)
                out = [
                    (rows + r, k, k * capacity, len(data) // 4, zlib.crc32(data))
                    for r, ids in enumerate(tokens)
                    for k, data in enumerate(ids[at:at + step] for at in range(0, len(ids), step))
                ]
                kept.append((some.column(0), *(np.array(c, np.int64) for c in zip(*out))))
                rows += some.num_rows
                held += len(out)
                if held >= CHUNK:
                    yield from flush()
                    rows = 0
        yield from flush()

    return pack


def _round(capacity: int, keep: int):
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best-fit of one node's bins; rows sorted by node. Says where each goes, and which still travel."""
        tables = [b for b in batches if b.num_rows]
        if not tables:
            return
        rows = pa.Table.from_batches(tables).to_pydict()
        out: list[tuple] = []
        nodes: dict[int, list[int]] = {}
        for i, node in enumerate(rows["node"]):
            nodes.setdefault(node, []).append(i)
        for node, own in nodes.items():
            own.sort(key=lambda i: (rows["owner"][i], rows["bin"][i]))
            lengths = np.array([rows["fill"][i] for i in own], np.int64)
            bins, offsets, fills = best_fit(lengths, capacity)
            emptiest = np.argsort(fills, kind="stable")[: keep + 1]
            travels = set(emptiest[fills[emptiest] < capacity].tolist())
            head: dict[int, int] = {}
            for k in np.argsort(offsets, kind="stable").tolist():
                head.setdefault(int(bins[k]), own[k])
            for k, i in enumerate(own):
                top = head[int(bins[k])]
                out.append((rows["owner"][i], rows["bin"][i], rows["owner"][top], rows["bin"][top], int(offsets[k]),
                            int(fills[bins[k]]), top == i and int(bins[k]) in travels))
        if out:
            names = [n for n, _ in MOVES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), MOVES)], names)

    return merge


def pack(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
    capacity: int = CAPACITY, end: int = END, fan_in: int = FAN_IN,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A text is its ids followed by `end`; only longer ones are cut, into pieces of `capacity` tokens. A null text is
    empty, so every row gives at least one piece; repeated rows and ids are packed one by one. sequence_id is any
    number, the pieces of a sequence follow each other from offset 0 without gaps. An empty table gives no rows.
    """
    path = tokenizer or vocabulary()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, fill long"
    rows = docs.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))
    local = rows.mapInArrow(_local(path, capacity, end), schema).withColumn("owner", F.spark_partition_id().cast("long"))
    pieces = saved(local, "pieces")

    moves = _moves(pieces, capacity, fan_in)
    place = F.shiftleft(F.coalesce("to_owner", "owner"), 40) + F.coalesce("to_bin", "bin")
    return pieces.join(moves, ["owner", "bin"], "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", place.alias("sequence_id"),
        (F.col("at") + F.coalesce("shift", F.lit(0))).cast("long").alias("offset"))


def _moves(pieces: DataFrame, capacity: int, fan_in: int) -> DataFrame:
    """(owner, bin, to_owner, to_bin, shift) of the bins that end in another one."""
    underfull = pieces.filter(F.col("fill") < capacity).select("owner", "bin", "fill").distinct()
    order = F.row_number().over(Window.partitionBy("owner").orderBy("fill", "bin"))  # one partition's bins
    moving = underfull.withColumn("n", order).filter(F.col("n") <= fan_in + 1).drop("n")
    moves = pieces.sparkSession.createDataFrame([], "owner long, bin long, to_owner long, to_bin long, shift long")
    last, width = pieces.agg(F.max("owner").alias("m")).first().m, 1
    schema = ", ".join(f"{n} {'boolean' if t == pa.bool_() else 'long'}" for n, t in MOVES)
    while last is not None and width <= last:
        width *= fan_in
        nodes = moving.withColumn("node", F.floor(F.col("owner") / width)).repartition("node")
        done = saved(nodes.mapInArrow(_round(capacity, fan_in), schema), "round")
        now = done.filter("owner <> to_owner or bin <> to_bin").select(
            "owner", "bin", F.col("to_owner").alias("next_owner"), F.col("to_bin").alias("next_bin"), F.col("shift").alias("more"))
        on = now.withColumnsRenamed({"owner": "to_owner", "bin": "to_bin"})
        further = moves.join(on, ["to_owner", "to_bin"], "left").select(
            "owner", "bin", F.coalesce("next_owner", "to_owner").alias("to_owner"),
            F.coalesce("next_bin", "to_bin").alias("to_bin"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        first = now.select("owner", "bin", F.col("next_owner").alias("to_owner"), F.col("next_bin").alias("to_bin"), F.col("more").alias("shift"))
        moves = further.unionByName(first)
        moving = done.filter("travels").select("owner", "bin", "fill")
    return moves


def op8(spark, folder: str) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet"))
