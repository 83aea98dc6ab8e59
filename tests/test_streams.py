import random
import shutil

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from feedloom.operators import limits
from feedloom.sources.tables import TABLES, table
from feedloom.streaming import stateful, upserts
from feedloom.streaming.runs import stream_table
from feedloom.streaming.snapshots import Snapshots


def out_of_order(spark, small, folder, n=3):
    """events dealt to n files by a hash, so that every file holds all times, and the last file has the first rows."""
    folder.mkdir()
    events = table(spark, small, "events").withColumn("_n", F.pmod(F.xxhash64("event_id"), F.lit(n)))
    for i in range(n):
        events.filter(F.col("_n") == i).drop("_n").coalesce(1).write.parquet(f"{folder}/p{i}")
        shutil.copy(next((folder / f"p{i}").glob("part-*.parquet")), folder / f"events-{i}.parquet")
    return str(folder)


def test_any_arrival_order_gives_the_rows_of_one_batch(spark, small, tmp_path):
    folder = out_of_order(spark, small, tmp_path / "in")
    one = lambda: stream_table(spark, small, "events")
    many = lambda: stream_table(spark, folder, "events", files_per_batch=1)
    content = lambda df: df.withColumn("content", (F.col("event_id") % 2).cast("string"))
    kinds = F.create_map(*[F.lit(x) for x in ("error", "limit", "signup", "claim", "click", "ok", "view", "claim", "purchase", "fail")])
    calls = lambda df: df.select(
        F.concat(F.lit("p"), F.col("user_id") % 9).alias("provider"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        F.col("event_id").alias("id"), F.try_element_at(kinds, F.col("event_type")).alias("kind"),
        F.lit(None).cast("bigint").alias("hint"), F.lit(None).cast("bigint").alias("claim"))
    usage = lambda df: df.select(F.col("event_type").alias("provider"), F.col("ts").alias("created_at"), F.lit(1).alias("total_tokens"))
    jobs = [
        lambda df: stateful.stream_rate_limit(df, "user_id", "ts", "event_id", 3, 86400, keep_hours=5000),
        lambda df: stateful.stream_recheck_gate(content(df), "user_id", "ts", "event_id", "content", keep_hours=5000),
        lambda df: stateful.stream_circuit(calls(df), keep_hours=5000),
        lambda df: upserts.stream_dedupe(df.select("event_id", "ts"), ["event_id"]),
        lambda df: upserts.stream_usage_windows(usage(df)),
    ]
    for job in jobs:
        assert sorted(map(str, job(many()).collect())) == sorted(map(str, job(one()).collect()))


def test_settled_rows_are_marked_and_none_is_lost(spark, small, tmp_path):
    folder = out_of_order(spark, small, tmp_path / "in")
    out = stateful.stream_rate_limit(stream_table(spark, folder, "events", files_per_batch=1), "user_id", "ts", "event_id", 3, 86400, keep_hours=48)
    events = table(spark, small, "events")
    assert sorted(rows(out, "id")) == sorted(rows(events, "event_id")) and out.filter("late").count()


class Memory:
    """A key's state in dictionaries, with the calls of Spark's state handle."""

    def __init__(self):
        self.values, self.maps, self.timers, self.writes = {}, {}, set(), 0

    def getValueState(self, name, schema):
        store = self.values

        class Value:
            exists = staticmethod(lambda: name in store)
            get = staticmethod(lambda: store[name])
            update = staticmethod(lambda v: store.__setitem__(name, v))

        return Value

    def getMapState(self, name, key_schema, schema):
        store, outer = self.maps.setdefault(name, {}), self

        class Map:
            keys = staticmethod(lambda: list(store))
            getValue = staticmethod(lambda k: store[k])
            removeKey = staticmethod(lambda k: store.pop(k))

            @staticmethod
            def updateValue(k, v):
                outer.writes += 1
                store[k] = v

        return Map

    def registerTimer(self, at):
        self.timers.add(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


def drive(processor, batches, keep_us):
    """Runs batches of events of one key as Spark does: input first, then timers below the new watermark. Gives the last result per id."""
    memory, newest, got, sizes, folded = Memory(), 0, {}, [], 0
    processor.init(memory)
    step = processor.step

    def counted(state, event):
        nonlocal folded
        folded += 1
        return step(state, event)

    processor.step, memory.watermark, work = counted, 0, []
    for batch in batches:
        before = folded
        frame = pd.DataFrame(batch, columns=processor.EVENT.names, dtype=object)
        for out in processor.handleInputRows(("k",), iter([frame]), memory):
            for row in out.itertuples(index=False):
                got[row[1]] = tuple(row[2:])
        newest = max(newest, *(e[0] for e in batch))
        memory.watermark = (newest - keep_us) // 1000
        for at in sorted(t for t in memory.timers if t <= memory.watermark):
            memory.timers.discard(at)
            list(processor.handleExpiredTimer(("k",), memory, None))
        sizes.append(sum(len(v[0]) for v in memory.maps["rows"].values()))
        work.append(folded - before)
    assert all(sum(v[-1] for v in memory.maps["ends"].values()) == n for n in sizes[-1:])
    return got, sizes, work


def plain(processor, events):
    """Results of a plain loop over all events in order."""
    state, got = processor.start(), {}
    for e in sorted(events, key=lambda e: e[:2]):
        state, results = processor.step(state, e)
        got[e[1]] = (*results, False)
    return got


HOUR = 3_600_000_000


def events_of(kind, n, rnd):
    at, out = 0, []
    for k in range(n):
        at += rnd.randrange(HOUR // 2)
        more = {"window": (), "gate": (rnd.choice("ab"),), "circuit": (rnd.choice(["limit", "claim", "ok", "fail"]), rnd.choice([None, at + 2 * HOUR]), None)}[kind]
        out.append((at, k, *more))
    return out


MACHINES = {"window": lambda keep: stateful.FixedWindow(HOUR, keep), "gate": lambda keep: stateful.RecheckGate(HOUR, keep), "circuit": lambda keep: stateful.Circuit(HOUR // 10, keep)}


@pytest.mark.parametrize("kind", MACHINES)
def test_state_of_a_thousand_batches_is_bounded(kind):
    """4000 events in 1000 batches, each up to two hours late: the rows of a loop, at every batch no more rows than the kept hours have, and
    no batch that folds much more than these."""
    rnd, keep = random.Random(7), 6 * HOUR
    events = events_of(kind, 4000, rnd)
    arriving = sorted(events, key=lambda e: e[0] + rnd.randrange(2 * HOUR))
    got, sizes, work = drive(MACHINES[kind](keep), [arriving[k:k + 4] for k in range(0, 4000, 4)], keep)
    assert got == plain(MACHINES[kind](keep), events)
    most = max(sum(a <= e[0] < a + 9 * HOUR for e in events) for a in range(0, events[-1][0], HOUR))
    assert len(sizes) == 1000 and max(sizes) <= most and max(work) <= 2 * most
    assert sum(work) < 12 * len(events)


@pytest.mark.parametrize("kind", MACHINES)
def test_any_order_within_the_kept_time(kind):
    rnd = random.Random(8)
    events = events_of(kind, 300, rnd)
    wanted = plain(MACHINES[kind](HOUR), events)
    keep = events[-1][0] + HOUR
    for _ in range(5):
        rnd.shuffle(events)
        cut = sorted(rnd.sample(range(1, 300), 20))
        batches = [events[a:b] for a, b in zip([0, *cut], [*cut, 300])]
        again = [batches[0], *batches, batches[3]]  # rows that come twice count once
        assert drive(MACHINES[kind](keep), again, keep)[0] == wanted


def test_late_rows_are_judged_by_the_settled_summary():
    keep = 2 * HOUR
    got, sizes, _ = drive(stateful.FixedWindow(HOUR, keep), [[(0, 1)], [(10 * HOUR, 2)], [(2, 3), (HOUR // 2, 6)], [(10 * HOUR + 5, 4)], [(2 * HOUR, 5)]], keep)
    assert got == {1: (0, 1, False), 2: (10 * HOUR, 1, False), 3: (0, 2, True), 6: (0, 2, False), 4: (10 * HOUR, 2, False), 5: (2 * HOUR, 1, False)}
    assert sizes[-1] <= 3


def test_a_late_row_leaves_buckets_alone_that_start_as_before():
    keep = 100 * HOUR
    batches = [[(k * 5 * HOUR, k)] for k in range(19)] + [[(5 * HOUR + 1, 50)]]
    got, _, work = drive(stateful.FixedWindow(HOUR, keep), batches, keep)
    assert got[50] == (5 * HOUR, 2, False) and work[-1] <= 4


@pytest.mark.parametrize("kind", MACHINES)
def test_a_batch_of_old_rows_stores_only_what_stays(kind):
    """2000 events of 30 weeks in one batch: the buckets of the last hours are written, the others leave one summary at once."""
    keep, memory = 6 * HOUR, Memory()
    events = events_of(kind, 2000, random.Random(9))
    processor, memory.watermark = MACHINES[kind](keep), 0
    processor.init(memory)
    frames = [pd.DataFrame(part, columns=processor.EVENT.names, dtype=object) for part in (events[:1500], events[1500:])]
    got = {r[1]: tuple(r[2:]) for out in processor.handleInputRows(("k",), iter(frames), memory) for r in out.itertuples(index=False)}
    assert got == plain(MACHINES[kind](keep), events)
    assert memory.writes <= 2 * 25 and memory.values["settled"][-1] >= events[-1][0] - keep - processor.width
    late = pd.DataFrame([(5, 9999, *events[0][2:])], columns=processor.EVENT.names, dtype=object)
    assert [r[-1] for out in processor.handleInputRows(("k",), iter([late]), memory) for r in out.itertuples(index=False)] == [True]


def in_files(spark, small, folder, n=4):
    """events split by time into n files, so that a stream sees several batches in order."""
    folder.mkdir()
    events = table(spark, small, "events")
    bounds = [r[0] for r in events.select(F.percentile_approx("event_id", [i / n for i in range(1, n)])).collect()][0]
    edges = [-1, *bounds, 10**12]
    for i in range(n):
        part = events.filter((F.col("event_id") > edges[i]) & (F.col("event_id") <= edges[i + 1]))
        part.coalesce(1).write.parquet(f"{folder}/p{i}")
        found = next((folder / f"p{i}").glob("part-*.parquet"))
        shutil.copy(found, folder / f"events-{i}.parquet")
    return str(folder)


def test_streams_equal_batch_over_several_batches(spark, small, tmp_path):
    folder = in_files(spark, small, tmp_path / "in")
    events = table(spark, small, "events")
    live = stateful.stream_rate_limit(stream_table(spark, folder, "events", files_per_batch=1), "user_id", "ts", "event_id", 3, 86400)
    batch = limits.rate_limit_fixed(events, "user_id", "ts", "event_id", 3, 86400)
    assert sorted(rows(live, "id", "number", "rejected")) == sorted(rows(batch, "event_id", "number", "rejected"))

    log = lambda df: df.select("event_id", "ts", F.col("user_id").cast("string").alias("idempotency_key"), F.col("event_type").alias("status"))
    status = upserts.stream_job_status(log(stream_table(spark, folder, "events", files_per_batch=1)))
    want = log(events).groupBy("idempotency_key").agg(F.max_by("status", F.struct("ts", "event_id")), F.max("ts"))
    assert sorted(rows(status)) == sorted(rows(want))

    once = upserts.stream_dedupe(stream_table(spark, folder, "events", files_per_batch=1).select("event_id", "ts"), ["event_id"])
    assert once.count() == events.count()


def test_upsert_snapshots_and_replay(spark, small, tmp_path):
    folder = in_files(spark, small, tmp_path / "in", 3)
    cols = lambda df: df.select(
        F.col("event_id").alias("id"), F.lit("f").alias("feed_name"), F.col("user_id").cast("string").alias("source_guid"),
        F.col("ts").alias("refreshed_at"), F.col("ts").alias("created_at"))
    events = cols(table(spark, small, "events"))
    stored = events.limit(0)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = cols(stream_table(spark, folder, "events", files_per_batch=1))
    got = upserts.stream_upsert(stream, stored, out=out, state_folder=state)
    want = events.groupBy("source_guid").agg(F.max("refreshed_at"))
    first = sorted(rows(got, "source_guid", "refreshed_at"))
    assert first == sorted(rows(want))
    again = upserts.stream_upsert(cols(stream_table(spark, folder, "events", files_per_batch=1)), stored, out=out, state_folder=state)
    assert sorted(rows(again, "source_guid", "refreshed_at")) == first


def bytes_of(folder):
    return sum(f.stat().st_size for f in folder.rglob("part-*"))


def test_a_batch_writes_its_own_buckets_only(spark, tmp_path):
    """4000 stored rows in 64 buckets, batches of a few keys: what a batch writes grows with it, old versions go, a batch that runs again changes nothing."""
    schema = "id long, feed_name string, source_guid string, body string"
    stored = spark.range(4000).selectExpr("id", "concat('f', id % 7) AS feed_name", "cast(id AS string) AS source_guid", "repeat(md5(cast(id AS string)), 20) AS body")
    out = str(tmp_path / "t")
    table_ = Snapshots(spark, out, stored.schema, ["feed_name", "source_guid"], 64)
    table_.create(stored)
    want = {(r.feed_name, r.source_guid): r.body for r in stored.collect()}

    def laid_over(before, new):
        return before.join(new.select("feed_name", "source_guid"), ["feed_name", "source_guid"], "left_anti").unionByName(new)

    written = []
    for n, size in enumerate([3, 1, 40, 0, 2]):
        ids = [(n * 997 + k * 31) % 4500 for k in range(size)]
        batch = spark.createDataFrame([(i, f"f{i % 7}", str(i), f"new {n}") for i in ids], schema)
        for _ in range(2):  # and once more, as after a lost driver
            table_.merge(batch, n, laid_over)
        want |= {(f"f{i % 7}", str(i)): f"new {n}" for i in ids}
        written.append(bytes_of(tmp_path / "t" / f"version={n}"))
        assert {(r.feed_name, r.source_guid): r.body for r in table_.read().collect()} == want and table_.latest() == n
    whole = bytes_of(tmp_path / "t" / "version=-1")
    assert written[3] == 0 and written[1] < written[0] < written[2] and written[0] < 0.1 * whole + bytes_of(tmp_path / "t" / "version=0")
    names = sorted(p.name for p in (tmp_path / "t-manifest").iterdir() if p.name.startswith("after"))
    assert names == ["after=3", "after=4"]
    kept = {(p.parent.name, p.name) for p in (tmp_path / "t").glob("version=*/bucket=*")}
    named = {(f"version={v}", f"bucket={b}") for n in (3, 4) for b, v in table_.manifest(n).items()}
    assert kept == named
    empty = Snapshots(spark, str(tmp_path / "e"), stored.schema, ["feed_name", "source_guid"], 4)
    empty.create(stored.limit(0))
    assert empty.read().count() == 0


def test_recheck_gate_matches_loop(spark, small):
    events = stream_table(spark, small, "events").withColumn("content", (F.col("event_id") % 2).cast("string"))
    got = {r[0] for r in rows(stateful.stream_recheck_gate(events, "user_id", "ts", "event_id", "content"), "id")}
    state, want = {}, set()
    plain = rows(table(spark, small, "events").select("user_id", "ts", "event_id"))
    for user, ts, i in sorted(plain, key=lambda r: (r[1], r[2])):
        known = state.get(user)
        if known is None or known[0] != i % 2 or (ts - known[1]).total_seconds() >= 86400:
            state[user] = (i % 2, ts)
            want.add(i)
    assert got == want


def circuit(spark, tmp_path, name, events):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    base = F.timestamp_micros(F.col("us")).cast("timestamp_ntz")
    df = spark.createDataFrame(events, "us bigint, event_type string, hint bigint, claim bigint").coalesce(1)
    df = df.select(F.monotonically_increasing_id().alias("event_id"), base.alias("ts"), F.lit(1).cast("bigint").alias("user_id"), "event_type",
                   F.col("hint").cast("double").alias("value"), F.col("claim").cast("string").alias("props"))
    df.select(*[c.split()[0] for c in schema.split(", ")]).write.parquet(str(tmp_path / name / "events.parquet"))
    stream = spark.readStream.schema(TABLES["events"]).parquet(str(tmp_path / name / "events.parquet")).select(
        F.lit("p").alias("provider"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_id").alias("id"),
        F.col("event_type").alias("kind"), F.col("value").cast("bigint").alias("hint"), F.col("props").cast("bigint").alias("claim"))
    out = stateful.stream_circuit(stream, lease_seconds=100)
    return [r[1:] for r in sorted(rows(out, "id", "accepted", "state", "failures", "next_probe"))]


def test_circuit(spark, tmp_path):
    s, m = 1_000_000, 60_000_000
    opened = circuit(spark, tmp_path, "open", [
        (1 * s, "limit", None, None), (2 * s, "limit", None, None), (3 * s, "limit", 30 * m, None), (4 * s, "limit", 20 * m, None),
        (5 * s, "claim", None, None), (30 * m, "claim", None, None), (30 * m + s, "claim", None, None), (30 * m + 2 * s, "ok", None, None)])
    assert opened == [
        (True, "open", 1, s + 15 * m), (False, "open", 1, s + 15 * m), (True, "open", 1, 30 * m), (False, "open", 1, 30 * m),
        (False, "open", 1, 30 * m), (True, "half-open", 1, 30 * m), (False, "half-open", 1, 30 * m), (True, "closed", 0, None)]
    steps, at, events = [15, 30, 60, 120, 120], 0, [(0, "limit", None, None)]
    for step in steps[:-1]:
        at += step * m
        events += [(at, "claim", None, None), (at, "fail", None, None)]
    grown = circuit(spark, tmp_path, "grow", events)
    times = [r[3] for r, e in zip(grown, events) if e[1] != "claim"]
    assert [b - a for a, b in zip([0, *[e[0] for e in events if e[1] == "fail"]], times)] == [x * m for x in steps]
    late = circuit(spark, tmp_path, "late", [
        (0, "force", None, None), (s, "limit", None, None), (2 * s, "ok", None, 0), (16 * m, "claim", None, None), (16 * m + 200 * s, "claim", None, None),
        (16 * m + 201 * s, "ok", None, 16 * m), (16 * m + 202 * s, "ok", None, 16 * m + 200 * s)])
    assert [r[:2] for r in late] == [(True, "closed"), (True, "open"), (False, "open"), (True, "half-open"), (True, "half-open"), (False, "half-open"), (True, "closed")]


def test_circuit_random_never_claims_early(spark, tmp_path):
    rnd, at, events = random.Random(5), 0, []
    for _ in range(200):
        at += rnd.randrange(20 * 60_000_000)
        events.append((at, rnd.choice(["limit", "claim", "ok", "fail"]), None, None))
    out = circuit(spark, tmp_path, "random", events)
    for (us, kind, _, _), (accepted, state, failures, probe) in zip(events, out):
        assert state in ("closed", "open", "half-open") and (state == "closed") == (failures == 0)
        if kind == "claim" and accepted:
            assert probe <= us
