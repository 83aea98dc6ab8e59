"""Fixed-window rate limit whose windows start at a client's first event, exact for clients of any size.

A window is anchored at an event, so the next anchor depends on the last one. Within a partition each row points to the first row of its client
at or after its own expiry, found for all rows by one sorted search; the rows that start windows are those reached from a
client's first start, found by doubling the pointers, without a loop over rows. Rows are range-partitioned on (client, time), so only a
partition's first and last client can go on in another one (see `ordered`). For these, each cell becomes a step function, from the
expiry of an anchor from before the cell to the anchor that leaves it, with the rows counted so far; one pass over the
step functions of a client gives the anchor and the count at the entry of each of its cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedloom.operators.ordered import CELL, cells, with_carry

NO_ANCHOR = -(2**62)


def successors(group: np.ndarray, times: np.ndarray, span: int) -> np.ndarray:
    """For rows sorted by (group, time): the first row of the same group whose time is `span` or more later, or the number of rows."""
    n = len(times)
    ranks = np.unique(np.concatenate([times, times + span]), return_inverse=True)[1].reshape(2, n)
    keys = group * (2 * n + 1) + ranks[0]
    at = np.searchsorted(keys, group * (2 * n + 1) + ranks[1])
    return np.where((at < n) & (group[np.minimum(at, n - 1)] == group), at, n)


def reached(first: np.ndarray, hop: np.ndarray) -> np.ndarray:
    """Marks of the rows reached from `first` (row numbers) by any number of hops; a hop to len(hop) ends a chain."""
    n = len(hop)
    hop, marks = np.append(hop, n), np.zeros(n + 1, bool)
    marks[first] = True
    while True:
        marks[hop[np.flatnonzero(marks)]] = True
        if (hop == n).all():
            return marks[:n]
        hop = hop[hop]


def windows(group: np.ndarray, times: np.ndarray, anchor: np.ndarray, count: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor and number of each row. `anchor` and `count` are those at entry, per group; groups are 0, 1, ... and have rows."""
    n = len(times)
    begin = np.searchsorted(group, np.arange(len(anchor)))
    fresh = times >= anchor[group] + span  # of the window at entry, or of a later one
    first = np.full(len(anchor), n)
    at = np.flatnonzero(fresh)
    np.minimum.at(first, group[at], at)
    starts = reached(first, successors(group, times, span))
    last = np.maximum.accumulate(np.where(starts, np.arange(n), -1))
    own = last >= begin[group]
    row = np.arange(n)
    return np.where(own, times[last], anchor[group]), np.where(own, row - last + 1, row - begin[group] + 1 + count[group])


def _group_numbers(client: pd.Series) -> np.ndarray:
    """0, 1, ... for the runs of equal neighbours; nulls are equal."""
    codes = pd.factorize(client, use_na_sentinel=False)[0]
    return np.concatenate([[0], np.cumsum(codes[1:] != codes[:-1])])


def _steps(span: int):
    """Step function of each crossing (client, cell) of a partition: arrays (upto, leaves, counts), with the anchor that leaves the cell when the anchor at
    entry expires at or before `upto`, and its rows in the cell so far; `size` is the number of rows."""

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}
        for batch in batches:
            for key, part in batch.groupby(["client", CELL, "inner"], dropna=False, sort=False):
                held.setdefault(tuple(None if pd.isna(k) else k for k in key), []).append(part["us"].to_numpy())
        for (client, cell, inner), parts in held.items():
            times = np.sort(np.concatenate(parts))
            n = len(times)
            hop = successors(np.zeros(n, np.int64), times, span)
            # An anchor from before an inner cell expires before its first row + span: the next start is one of the rows up to then, or the first one after.
            starts = np.arange(min(hop[0] + 1, n)) if inner else np.arange(1)
            hops, at = [np.append(hop, n)], starts.copy()
            while (hops[-1] < n).any():
                hops.append(hops[-1][hops[-1]])
            for h in reversed(hops):
                at = np.where(h[at] < n, h[at], at)
            last_of_run = np.append(np.diff(times[at]) != 0, True)
            leaves = times[at[last_of_run]]
            counts = n - np.searchsorted(times, leaves)
            yield pd.DataFrame({"client": [client], CELL: [cell], "upto": [times[starts[last_of_run]]], "leaves": [leaves], "counts": [counts], "size": [n]})

    return build


def _entries(span: int):
    """Walks each client's step functions in order, giving anchor and count at the entry of each cell."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, anchor, count = object(), NO_ANCHOR, 0
        for batch in batches:
            out = []
            for client, cell, upto, leaves, counts, size in batch.itertuples(index=False):
                client = None if pd.isna(client) else client
                if client != before:
                    before, anchor, count = client, NO_ANCHOR, 0
                out.append((client, cell, anchor, count))
                k = int(np.searchsorted(upto, anchor + span))
                anchor, count = (int(leaves[k]), int(counts[k])) if k < len(upto) else (anchor, count + int(size))
            yield pd.DataFrame(out, columns=["client", CELL, "entry", "seen"])

    return walk


def _fold(span: int):
    """Anchor and number of each row of a partition sorted by (client, time, id); the last client of a batch goes on in the next."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, anchor, count = object(), NO_ANCHOR, 0
        for batch in batches:
            if not len(batch):
                continue
            group = _group_numbers(batch["client"])
            begin = np.searchsorted(group, np.arange(group[-1] + 1))
            entry, seen = batch["entry"].to_numpy()[begin], batch["seen"].to_numpy()[begin]
            first = batch["client"].iat[0]
            if first == before or (pd.isna(first) and before is None):
                entry[0], seen[0] = anchor, count
            anchors, numbers = windows(group, batch["us"].to_numpy(), entry, seen, span)
            last = batch["client"].iat[-1]
            before, anchor, count = None if pd.isna(last) else last, anchors[-1], numbers[-1]
            yield pd.DataFrame({"client": batch["client"], "us": batch["us"], "id": batch["id"], "anchor": anchors, "number": numbers})

    return fold


def rate_limit_fixed(
    events: DataFrame, client: str, ts: str, event_id: str, limit: int = 20, window_seconds: int = 60,
    parts: int | None = None,
) -> DataFrame:
    """Per event: the window it falls into, its number in the window, whether it is rejected and when to retry."""
    span = window_seconds * 1_000_000
    rows = events.select(
        F.col(client).alias("client"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(event_id).alias("id")
    ).filter("us IS NOT NULL")
    spread = cells(rows, ["client"], ["us", "id"], parts)
    kind = dict(rows.dtypes)

    # The first and the last client of a partition, if they have several cells: fewer than two rows per partition border.
    ends = spread.groupBy(CELL).agg(F.min(F.struct("client")).alias("a"), F.max(F.struct("client")).alias("b"))
    ends = ends.select(CELL, F.explode(F.array_distinct(F.array("a", "b"))).alias("e")).select(F.col("e.client").alias("client"), CELL)
    of_client = Window.partitionBy("client")
    large = ends.withColumn("_cells", F.count(F.lit(1)).over(of_client)).filter("_cells > 1").select(
        "client", CELL, (F.row_number().over(of_client.orderBy(CELL)) > 1).alias("inner")
    )
    crossing = with_carry(spread, large, ["client"]).filter("inner IS NOT NULL").select("client", CELL, "inner", "us")
    steps = crossing.mapInPandas(
        _steps(span), f"client {kind['client']}, {CELL} int, upto array<bigint>, leaves array<bigint>, counts array<bigint>, size bigint"
    )
    entry = steps.repartition("client").sortWithinPartitions("client", CELL).mapInPandas(
        _entries(span), f"client {kind['client']}, {CELL} int, entry bigint, seen bigint"
    )

    with_entry = with_carry(spread, entry, ["client"]).select(
        "client", "us", "id", F.coalesce("entry", F.lit(NO_ANCHOR)).alias("entry"), F.coalesce("seen", F.lit(0)).cast("bigint").alias("seen")
    )
    folded = with_entry.sortWithinPartitions("client", "us", "id").mapInPandas(
        _fold(span), f"client {kind['client']}, us bigint, id {kind['id']}, anchor bigint, number bigint"
    )
    left = F.ceil((F.col("anchor") + F.lit(span) - F.col("us")) / 1_000_000)
    rejected = F.col("number") > limit
    return folded.select(
        F.col("client").alias(client), F.col("id").alias(event_id),
        F.timestamp_micros("anchor").cast("timestamp_ntz").alias("window_start"), "number",
        rejected.alias("rejected"), F.when(rejected, F.greatest(left, F.lit(1)).cast("bigint")).alias("retry_after"),
    )
