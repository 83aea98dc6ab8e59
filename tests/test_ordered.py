"""Keys that span many range partitions must give the results of a plain loop."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from feedloom.operators import circuits, limits, ordered, quantiles


def log(seed, n=1500, hot=0.7):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < hot else f"k{rnd.randrange(40)}"
        out.append((key, rnd.randrange(400), i, rnd.choice(["error", "ok", "reset"]), rnd.randrange(100)))
    return out


@pytest.fixture(scope="module", params=[1, 2])
def data(spark, request):
    plain = log(request.param)
    return plain, spark.createDataFrame(plain, "key string, ts bigint, id bigint, kind string, v bigint").cache()


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_running(data, parts):
    plain, df = data
    kind = F.col("kind")
    got = ordered.running(
        df, ["key"], ["ts", "id"],
        {"n": ("sum", (kind == "error").cast("bigint")), "top": ("max", F.when(kind == "error", F.col("v")))},
        reset=kind == "reset", parts=parts,
    )
    state, want = {}, {}
    for key, ts, i, what, v in sorted(plain):
        n, top = state.get(key, (0, None))
        if what == "reset":
            n, top = 0, None
        if what == "error":
            n, top = n + 1, v if top is None else max(top, v)
        state[key] = (n, top)
        want[i] = (n, top)
    assert {i: (n, top) for i, n, top in rows(got, "id", "n", "top")} == want


@pytest.mark.parametrize("parts", [1, 9, 60])
def test_previous_and_numbered(data, parts):
    plain, df = data
    last, count, want = {}, {}, {}
    for key, ts, i, what, v in sorted(plain):
        count[key] = count.get(key, 0) + 1
        want[i] = (last.get(key), count[key])
        last[key] = what
    before = dict(rows(ordered.previous(df, ["key"], ["ts", "id"], {"before": "kind"}, parts), "id", "before"))
    number = dict(rows(ordered.numbered(df, ["key"], ["ts", "id"], "no", parts), "id", "no"))
    assert {i: (before[i], number[i]) for i in want} == want


def test_nearest_rank(spark, data):
    plain, df = data
    big = [("w", 0, 0, "x", v) for v in (-(2**63), 2**63 - 1, 0, -1, 1, -5, 2**40, 2**40 + 1, 2**40 + 2**12, -(2**50) - 3, -(2**50), None, 16383, 16384, 16385, 2**30, 2**46 - 1, 2**46)]
    rnd = random.Random(4)
    big += [("r", 0, 0, "x", rnd.choice([1, -1]) * rnd.getrandbits(rnd.randrange(1, 63))) for _ in range(3000)] + [(None, 0, 0, "x", 7), ("none", 0, 0, "x", None)]
    both = df.unionByName(spark.createDataFrame(big, df.schema))
    by_key = {}
    for key, _, _, _, v in [*plain, *big]:
        if v is not None:
            by_key.setdefault(key, []).append(v)
    wanted = {"a": 0.5, "b": 0.95, "c": 0.0, "d": 1.0, "e": 0.05}
    got = {r[0]: tuple(r[1:]) for r in rows(quantiles.nearest_rank(both, ["key"], "v", wanted), "key", *wanted)}

    def rank(vs, q):
        vs = sorted(vs)
        return vs[max(math.ceil(len(vs) * q), 1) - 1]

    assert got == {k: tuple(rank(vs, q) for q in wanted.values()) for k, vs in by_key.items()}
    short = quantiles.nearest_rank(df.withColumn("v", F.col("v").cast("int") * 20_000_000), ["key"], "v", {"a": 0.5})
    assert dict(rows(short, "key", "a")) == {k: 20_000_000 * rank(vs, 0.5) for k, vs in by_key.items() if k in {p[0] for p in plain}}


def expected_windows(plain, span, limit):
    anchors, want = {}, {}
    for client, at, i in sorted(plain):
        anchor, n = anchors.get(client, (None, 0))
        if anchor is None or at >= anchor + span:
            anchor, n = at, 0
        n += 1
        anchors[client] = (anchor, n)
        left = -(-(anchor + span - at) // 1_000_000)
        want[i] = (anchor, n, n > limit, max(1, left) if n > limit else None)
    return want


@pytest.mark.parametrize("span,step,parts", [(60, 1_000_000, 13), (60, 25_000_000, 13), (5, 900_000, 40), (600, 1_000_000, 9), (60, 1_000_000, 1)])
def test_rate_limit_over_cells(spark, span, step, parts):
    rnd = random.Random(span * parts)
    plain, at = [], 0
    for i in range(1200):
        at += rnd.randrange(step)
        plain.append(("hot" if rnd.random() < 0.7 else f"c{rnd.randrange(30)}", at, i))
    df = spark.createDataFrame(plain, "client string, us bigint, id bigint").withColumn("ts", F.timestamp_micros("us"))
    got = limits.rate_limit_fixed(df, "client", "ts", "id", limit=4, window_seconds=span, parts=parts)
    micros = F.unix_micros(F.col("window_start").cast("timestamp")).alias("w")
    seen = {r[0]: tuple(r[1:]) for r in rows(got, "id", micros, "number", "rejected", "retry_after")}
    assert seen == expected_windows(plain, span * 1_000_000, 4)


def circuit_loop(plain):
    """The rules of a circuit, row by row: key, us, id, kind, hint -> failures, next probe, opened."""
    state, want = {}, {}
    for key, us, i, kind, hint in sorted(plain, key=lambda r: (str(r[0]), r[1], r[2])):
        fails, probe = state.get(key, (0, None))
        if kind == "error":
            opened = fails == 0 or us >= probe
            if opened:
                fails, probe = fails + 1, max(us + [15, 30, 60, 120][min(fails, 3)] * 60_000_000, hint or 0)
            else:
                probe = max(probe, hint or 0)
            want[i] = (fails, probe, opened)
        elif kind == "reset":
            fails, probe = 0, None
        state[key] = (fails, probe)
    return want


def circuit_rows(seed, n, minutes, reset, hinted):
    rnd, at, out = random.Random(seed), 0, []
    for i in range(n):
        at += rnd.randrange(minutes * 60_000_000)
        kind = "reset" if rnd.random() < reset else rnd.choice(["error", "error", "other"])
        hint = at + rnd.randrange(-30, 400) * 60_000_000 if rnd.random() < hinted else None
        out.append((rnd.choice(["hot", "hot", "hot", None, f"k{rnd.randrange(20)}"]), at, i, kind, hint))
    return out


@pytest.mark.parametrize("minutes,reset,hinted,parts", [(20, 0.0, 0.3, 13), (2, 0.01, 0.05, 30), (90, 0.02, 0.0, 7), (1, 0.0, 0.5, 40), (20, 0.2, 0.3, 1)])
def test_circuit_backoff_over_cells(spark, minutes, reset, hinted, parts):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        plain = circuit_rows(minutes + parts, 1200, minutes, reset, hinted)
        df = spark.createDataFrame(plain, "p string, us bigint, id bigint, k string, h bigint").select(
            "p", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "id", "k", F.timestamp_micros("h").cast("timestamp_ntz").alias("provider_retry_at"))
        out = circuits.circuit_backoff(df, "p", ["ts", "id"], F.col("k") == "error", F.col("k") == "reset", parts=parts)
        seen = {r[0]: tuple(r[1:]) for r in rows(out, "id", "failure_count", F.unix_micros(F.col("next_probe_at").cast("timestamp")).alias("us"), "opened")}
        assert seen == circuit_loop(plain)
        assert circuits.circuit_backoff(df.limit(0), "p", ["ts", "id"], F.col("k") == "error", F.col("k") == "reset").count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_functions_of_runs_compose():
    """A run in pieces, from any start, ends as the loop does."""
    rnd = random.Random(3)
    for n in range(60):
        plain = [(None, *r[1:]) for r in circuit_rows(n, 40, rnd.choice([3, 20, 90]), rnd.choice([0, 0, 0.1]), 0.4) if r[3] != "other"]
        us, hint = (np.array([circuits.NEVER if r[k] is None else r[k] for r in plain]) for k in (1, 4))
        failed = np.array([r[3] == "error" for r in plain])
        for start in [(0, circuits.NEVER), (1, 0), (2, 20 * 60_000_000), (7, int(us[len(us) // 2])), (3, int(us[-1]) + 1)]:
            cut = sorted(rnd.sample(range(1, len(us)), 3))
            got = start
            for a, b in zip([0, *cut], [*cut, len(us)]):
                got = circuits.applied(got, SimpleNamespace(**circuits.run_function(us[a:b], failed[a:b], hint[a:b])))
            want = start
            for u, f, h in zip(us.tolist(), failed.tolist(), hint.tolist()):
                want, _ = circuits.step(want, u, f, h)
            assert got == want


def test_circuit_backoff_is_extended_while_open(spark):
    data = [("p", "2024-01-01 00:00:00", 1, "f", "2024-01-01 05:00:00"), ("p", "2024-01-01 01:00:00", 2, "f", None), ("p", "2024-01-01 01:30:00", 6, "f", "2024-01-01 04:00:00"),
            ("p", "2024-01-01 05:00:00", 3, "f", None), ("p", "2024-01-01 05:10:00", 4, "f", "2024-01-01 05:50:00"), ("p", "2024-01-01 06:00:00", 5, "s", None), ("p", "2024-01-01 06:01:00", 7, "f", None)]
    df = spark.createDataFrame(data, "p string, ts string, id int, k string, h string").select(
        "p", F.col("ts").cast("timestamp_ntz").alias("ts"), "id", "k", F.col("h").cast("timestamp_ntz").alias("provider_retry_at"))
    out = circuits.circuit_backoff(df, "p", ["ts", "id"], F.col("k") == "f", F.col("k") == "s")
    assert [(i, n, str(t)[11:], o) for i, n, t, o in sorted(rows(out, "id", "failure_count", "next_probe_at", "opened"))] == [
        (1, 1, "05:00:00", True), (2, 1, "05:00:00", False), (3, 2, "05:30:00", True), (4, 2, "05:50:00", False), (6, 1, "05:00:00", False), (7, 1, "06:16:00", True)]


def test_rate_limit_of_null_clients_and_many_batches(spark):
    """Clients without a name are one client; partitions of several Arrow batches; equal times."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        rnd = random.Random(11)
        plain = [(rnd.choice(["", "hot", "hot", "b"]), rnd.randrange(200) * 1_000_000, i) for i in range(1500)]
        df = spark.createDataFrame(plain, "client string, us bigint, id bigint").withColumn("ts", F.timestamp_micros("us")).withColumn(
            "client", F.when(F.col("client") != "", F.col("client")))
        for parts in (1, 6):
            got = limits.rate_limit_fixed(df, "client", "ts", "id", limit=4, window_seconds=7, parts=parts)
            micros = F.unix_micros(F.col("window_start").cast("timestamp")).alias("w")
            seen = {r[0]: tuple(r[1:]) for r in rows(got, "id", micros, "number", "rejected", "retry_after")}
            assert seen == expected_windows(plain, 7_000_000, 4)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert limits.rate_limit_fixed(df.limit(0), "client", "ts", "id").count() == 0


def test_windows_of_arrays():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        sizes = rnd.integers(1, 12, 5)
        group = np.repeat(np.arange(5), sizes)
        times = np.concatenate([np.sort(rnd.integers(0, 40, n)) for n in sizes])
        anchor, count = rnd.choice([limits.NO_ANCHOR, 0, -5], 5), rnd.integers(0, 3, 5)
        got = limits.windows(group, times, anchor, count, 9)
        for g in range(5):
            a, n = anchor[g], count[g]
            for k in np.flatnonzero(group == g):
                if times[k] >= a + 9:
                    a, n = times[k], 0
                n += 1
                assert (got[0][k], got[1][k]) == (a, n)
