"""The circuit of a provider over its log, exact for logs of any size and any number of rows per provider.

A failure on a closed circuit opens it until a probe is due; failures before that time only extend it, to a later hint; one at or
after it is a failed probe and opens the circuit anew with the next longer wait; a success closes it. State is (failures, next
probe). Rows are range-partitioned on (key, order); each run of rows of a key is a function from the state at its start to that
at its end, and such functions compose. With a success inside it the function is a constant. Otherwise, an open state goes on
to the first row that is due, and what follows depends on that row and on the step of the waits only: so the function is a table
over the due rows with one column per step. Tables are built in parallel for runs of one Arrow batch, and only for keys that
cross a partition border; a walk over them gives the state at the start of each cell, and then every cell is folded alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedloom.functions.values import PROBE_MINUTES
from feedloom.operators.ordered import CELL, cells, with_carry

NEVER = -(2**62)
WAITS = np.array(PROBE_MINUTES, np.int64) * 60_000_000
STEPS = len(WAITS)
CLOSED = (0, NEVER)


def step(state: tuple[int, int], us: int, failed: bool, hint: int) -> tuple[tuple[int, int], bool]:
    """State after a row, and whether the row opened the circuit. A row that did not fail is a success."""
    failures, probe = state
    if not failed:
        return CLOSED, False
    if failures and us < probe:
        return (failures, max(probe, hint)), False
    return (failures + 1, max(us + int(WAITS[min(failures, STEPS - 1)]), hint)), True


def _table(us: np.ndarray, hint: np.ndarray) -> dict[str, np.ndarray | int]:
    """The function of a run of failures: for the due rows in order their times, and for each step of the wait there the failures added and
    the next probe at the end; `top` is the latest hint, which an open state without a due row is extended to."""
    n = len(us)
    tops = [hint]  # tops[k][i]: latest hint of rows i to i + 2^k - 1
    while (1 << len(tops)) <= n:
        half = 1 << (len(tops) - 1)
        tops.append(np.maximum(tops[-1][:-half], tops[-1][half:]))
    probe = np.maximum(us[:, None] + WAITS, hint[:, None])  # after row i failed as a probe, by step
    after = np.arange(1, n + 1)
    due = np.maximum(np.searchsorted(us, probe.ravel()).reshape(n, STEPS), after[:, None])
    while True:  # a hint between a row and its due row makes that later
        size = due - after[:, None]
        level = np.frexp(np.maximum(size, 1))[1] - 1
        seen = np.full((n, STEPS), NEVER)
        for k in range(len(tops)):
            at = (level == k) & (size > 0)
            rows = np.broadcast_to(after[:, None], at.shape)[at]
            seen[at] = np.maximum(tops[k][rows], tops[k][due[at] - (1 << k)])
        probe = np.maximum(probe, seen)
        later = np.maximum(np.searchsorted(us, probe.ravel()).reshape(n, STEPS), due)
        if (later == due).all():
            break
        due = later
    added, end = np.ones((n, STEPS), np.int64), probe.copy()
    for i in range(n - 1, -1, -1):
        for c in range(STEPS):
            j = due[i, c]
            if j < n:
                d = min(c + 1, STEPS - 1)
                added[i, c], end[i, c] = 1 + added[j, d], end[j, d]
    before = np.maximum.accumulate(np.concatenate([[NEVER], hint[:-1]]))
    first = us >= before  # the hints of this run do not keep the row from being due
    return {"due": us[first], "added": added[first].ravel(), "end": end[first].ravel(), "top": int(hint.max())}


def run_function(us: np.ndarray, failed: np.ndarray, hint: np.ndarray) -> dict:
    """The function of a run of rows. `fixed` holds the end state if it is the same from every open start; `closed` is the end state from a closed one."""
    state, at = CLOSED, np.flatnonzero(~failed)
    rest = at[-1] + 1 if len(at) else 0
    for u, h in zip(us[rest:].tolist(), hint[rest:].tolist()):
        state, _ = step(state, u, True, h)
    if len(at):
        return {"closed": list(state), "fixed": list(state), "due": [], "added": [], "end": [], "top": NEVER}
    return {"closed": list(state), "fixed": None, **_table(us, hint)}


def applied(state: tuple[int, int], run) -> tuple[int, int]:
    """The state at the end of a run from the one at its start."""
    failures, probe = state
    if not failures:
        return tuple(int(x) for x in run.closed)
    if run.fixed is not None:
        return tuple(int(x) for x in run.fixed)
    k = int(np.searchsorted(run.due, probe))
    if k == len(run.due):
        return failures, max(probe, int(run.top))
    c = k * STEPS + min(failures, STEPS - 1)
    return failures + int(run.added[c]), int(run.end[c])


def _functions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One function per key, cell and batch; rows come sorted."""
    number = 0
    for batch in batches:
        out = []
        for (key, cell), part in batch.groupby(["key", CELL], dropna=False, sort=False):
            run = run_function(part["us"].to_numpy(), part["failed"].to_numpy(bool), part["hint"].to_numpy())
            out.append({"key": None if pd.isna(key) else key, CELL: cell, "run": number, **run})
        number += 1
        yield pd.DataFrame(out, columns=["key", CELL, "run", "closed", "fixed", "due", "added", "end", "top"])


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """State at the start of each cell, from the functions of a key in order."""
    key, cell, state = object(), None, CLOSED
    for batch in batches:
        out = []
        for run in batch.itertuples(index=False):
            own = None if pd.isna(run.key) else run.key
            if own != key:
                key, cell, state = own, None, CLOSED
            if run[1] != cell:
                cell = run[1]
                out.append((key, cell, *state))
            state = applied(state, run)
        yield pd.DataFrame(out, columns=["key", CELL, "failures", "probe"])


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Failures with the state after them; rows come sorted, and the state goes on from batch to batch."""
    key, state = object(), CLOSED
    for batch in batches:
        out = []
        columns = (batch[c].tolist() for c in ("key", "us", "failed", "hint", "failures", "probe"))
        for place, (own, us, failed, hint, failures, probe) in enumerate(zip(*columns)):
            own = None if pd.isna(own) else own
            if own != key:
                key, state = own, (failures, probe)
            state, opened = step(state, us, failed, hint)
            if failed:
                out.append((place, *state, opened))
        places = pd.DataFrame(out, columns=["place", "failure_count", "next_probe_us", "opened"])
        yield batch.iloc[places["place"]][["row"]].reset_index(drop=True).join(places.drop(columns="place"))


def circuit_backoff(log: DataFrame, key: str, order: Sequence[str], failed: Column, reset: Column, parts: int | None = None) -> DataFrame:
    """The rows of `log` that failed, with failure_count and next_probe_at of the circuit after each, and whether the row opened it.

    `order` begins with the time and is unique within a key; `provider_retry_at` is the provider's own hint, or null. A row with
    neither a failure nor a success changes nothing, one with both is a success, one without a time is left out. Null keys are one key."""
    ts = order[0]
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    reset = F.coalesce(reset, F.lit(False))
    rows = log.filter((F.coalesce(failed, F.lit(False)) | reset) & F.col(ts).isNotNull()).select(
        F.col(key).alias("key"), micros(ts).alias("us"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], (~reset).alias("failed"),
        F.coalesce(micros("provider_retry_at"), F.lit(NEVER)).alias("hint"), F.struct(*log.columns).alias("row"),
    )
    places = [f"_o{k}" for k in range(len(order))]
    spread = cells(rows, ["key"], places, parts)
    kind = spread.schema["key"].dataType.simpleString()

    # The first and the last key of a partition, if they have several cells: fewer than two rows per partition border.
    ends = spread.groupBy(CELL).agg(F.min(F.struct("key")).alias("a"), F.max(F.struct("key")).alias("b"))
    ends = ends.select(CELL, F.explode(F.array_distinct(F.array("a", "b"))).alias("e")).select(F.col("e.key").alias("key"), CELL)
    large = ends.withColumn("_cells", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter("_cells > 1").select("key", CELL, F.lit(True).alias("large"))
    crossing = with_carry(spread.drop("row"), large, ["key"]).filter("large").sortWithinPartitions("key", *places)
    functions = crossing.select("key", CELL, "us", "failed", "hint").mapInPandas(
        _functions, f"key {kind}, {CELL} int, run int, closed array<bigint>, fixed array<bigint>, due array<bigint>, added array<bigint>, end array<bigint>, top bigint"
    )
    entry = functions.repartition("key").sortWithinPartitions("key", CELL, "run").mapInPandas(_entries, f"key {kind}, {CELL} int, failures bigint, probe bigint")

    with_entry = with_carry(spread, entry, ["key"]).select(
        "key", "us", "failed", "hint", F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"), F.coalesce("probe", F.lit(NEVER)).alias("probe"), "row", *places,
    ).sortWithinPartitions("key", *places).drop(*places)
    row_type = spread.schema["row"].dataType.simpleString()
    folded = with_entry.mapInPandas(_fold, f"row {row_type}, failure_count bigint, next_probe_us bigint, opened boolean")
    return folded.select(
        *[F.col("row").getField(c).alias(c) for c in log.columns], "failure_count",
        F.timestamp_micros("next_probe_us").cast("timestamp_ntz").alias("next_probe_at"), "opened",
    )
