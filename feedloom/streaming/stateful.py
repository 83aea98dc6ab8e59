"""Keyed state over streams: rate limits, circuits and the recheck gate.

What a row gives depends on all rows of its key before it, and rows arrive in any order. The recent rows of a key are therefore kept,
in buckets of event time, and each bucket has the summary of the fold at its end. A row that arrives late is folded into its
bucket from the summary of the bucket before; later buckets are folded again only as long as the summaries they start from change. The
results given anew replace the ones before (the last batch counts), so any arrival order and any cut into batches end in the same rows.

The state is bounded: a bucket is settled once the watermark, `keep_hours` behind the newest row of the stream, has passed its end. Its
rows go and its summary stays, one per key. Buckets that the newest row of their own key leaves that far behind are settled with its
batch and never stored, so a batch of old rows costs a few calls of the state store per key and not some per bucket; event-time timers
settle the others. A row that belongs before the settled place of its key is not lost: it is
judged by the settled summary and marked late. The watermark runs beside the rows (they carry no event-time column into the
operator), as Spark would drop late rows otherwise."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from feedloom.functions.values import PROBE_MINUTES
from feedloom.session import ROCKSDB
from feedloom.streaming.runs import last_update, write_batches

MINUTE = 60_000_000
KEEP_HOURS = 72.0
BUCKETS = 24


def _long(name: str) -> StructField:
    return StructField(name, LongType())


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    # Plain objects: the state API's serializer takes no chunked string columns.
    return pd.DataFrame(rows, columns=columns, dtype=object)


def _plain(value):
    """Python's own number or None for a cell of a frame."""
    if value is None or isinstance(value, str):
        return value
    return None if pd.isna(value) else int(value)


def _bare(value):
    """Rows of the state API as plain tuples and lists."""
    if isinstance(value, (list, tuple)):
        return tuple(_bare(v) for v in value) if isinstance(value, tuple) else [_bare(v) for v in value]
    return value


class Replay(StatefulProcessor):
    """Folds the rows of a key in event order, whatever the order in which they come.

    A subclass has STATE (what the fold carries), EVENT (us, id and what else it reads), RESULTS, `start` and
    `step(state, event) -> (state, results)`. Rows of one key must differ in (us, id); a row that comes twice counts once while
    its bucket is kept."""

    STATE: StructType
    EVENT: StructType
    RESULTS: str

    def __init__(self, keep_us: int, buckets: int = BUCKETS):
        self.keep = keep_us
        self.width = max(1, keep_us // buckets)

    @property
    def OUTPUT(self) -> str:  # noqa: N802
        return f"key STRING, id BIGINT, {self.RESULTS}, late BOOLEAN"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        summary = [*self.STATE.fields]
        self.settled = handle.getValueState("settled", StructType([*summary, _long("edge")]))
        self.ends = handle.getMapState("ends", StructType([_long("bucket")]), StructType([*summary, _long("rows")]))
        self.rows = handle.getMapState("rows", StructType([_long("bucket")]), StructType([StructField("rows", ArrayType(self.EVENT))]))

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, event: tuple) -> tuple[tuple, tuple]:
        raise NotImplementedError

    def _settled(self) -> tuple[tuple, int | None]:
        if not self.settled.exists():
            return self.start(), None
        stored = _bare(tuple(self.settled.get()))
        return stored[:-1], stored[-1]

    def _live(self) -> list[int]:
        return sorted(k[0] for k in self.ends.keys())

    def _end(self, bucket: int) -> tuple:
        return _bare(tuple(self.ends.getValue((bucket,))))[:-1]

    def _fold(
        self, bucket: int, known: bool, state: tuple, as_before: bool, fresh: list[tuple], key: str, out: list[tuple], stays: bool,
    ) -> tuple:
        """The summary at the end of a bucket, whose new rows are added; gives the results that may have changed. Only a bucket that stays
        is stored."""
        events = [_bare(tuple(e)) for e in self.rows.getValue((bucket,))[0]] if known else []
        first = min(fresh)[:2] if fresh else None
        if fresh:
            events = sorted({e[:2]: e for e in [*fresh, *events]}.values(), key=lambda e: e[:2])
            if stays:
                self.rows.updateValue((bucket,), (events,))
        for e in events:
            state, results = self.step(state, e)
            if not as_before or e[:2] >= first:
                out.append((key, e[1], *results, False))
        if stays:
            self.ends.updateValue((bucket,), (*state, len(events)))
        return state

    def _settle(self, summary: tuple, bucket: int, stored: list[int]) -> None:
        """Keeps the summary at the end of a bucket; the stored buckets up to it go."""
        self.settled.update((*summary, (bucket + 1) * self.width))
        for b in stored:
            self.ends.removeKey((b,))
            self.rows.removeKey((b,))

    def handleInputRows(self, key, rows, timerValues):
        names = self.EVENT.names
        settled, edge = self._settled()
        fresh: dict[int, list[tuple]] = {}
        out = []
        for frame in rows:
            for r in frame[names].itertuples(index=False):
                event = tuple(_plain(v) for v in r)
                if edge is not None and event[0] < edge:
                    out.append((key[0], event[1], *self.step(settled, event)[1], True))
                else:
                    fresh.setdefault(event[0] // self.width, []).append(event)
        live = self._live()
        known = set(live)
        passed = (max(e[0] for es in fresh.values() for e in es) - self.keep) // 1000 if fresh else None
        before = [b for b in live if fresh and b < min(fresh)]
        state = was = self._end(before[-1]) if before else settled  # the fold now, and as it was before these rows
        gone = None  # the last bucket that these rows settle, and its summary
        if before and self._expiry(before[-1]) <= passed:
            gone = before[-1], state
        for bucket in sorted(b for b in known | set(fresh) if fresh and b >= min(fresh)):
            stays = self._expiry(bucket) > passed
            ended = self._end(bucket) if bucket in known else was
            if bucket in fresh or state != was:
                state = self._fold(bucket, bucket in known, state, state == was, fresh.get(bucket, []), key[0], out, stays)
            else:
                state = ended
            was = ended
            if not stays:
                gone = bucket, state
        if gone:
            self._settle(gone[1], gone[0], [b for b in live if b <= gone[0]])
        kept = [b for b in sorted(known | set(fresh)) if not gone or b > gone[0]]
        if fresh and kept and (not live or kept[0] != live[0]):
            self.handle.registerTimer(self._expiry(kept[0]))
        if out:
            yield self._out(out)

    def _out(self, rows: list[tuple]) -> pd.DataFrame:
        return _frame(rows, [c.split()[0] for c in self.OUTPUT.split(", ")])

    def _expiry(self, bucket: int) -> int:
        """Milliseconds at which a bucket ends."""
        return -(-(bucket + 1) * self.width // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Buckets that end before the watermark leave their last summary; the others wait for the next timer."""
        now = timerValues.getCurrentWatermarkInMs()
        live = self._live()
        gone = [b for b in live if self._expiry(b) <= now]
        if gone:
            self._settle(self._end(gone[-1]), gone[-1], gone)
        if len(gone) < len(live):
            self.handle.registerTimer(self._expiry(live[len(gone)]))
        return iter(())

    def close(self) -> None:
        pass


EVENT = [_long("us"), _long("id")]


class FixedWindow(Replay):
    """A window opens at a client's first event and closes after its span."""

    STATE = StructType([_long("anchor"), _long("count")])
    EVENT = StructType(EVENT)
    RESULTS = "anchor BIGINT, number BIGINT"

    def __init__(self, span_us: int, keep_us: int):
        super().__init__(keep_us)
        self.span = span_us

    def start(self):
        return None, 0

    def step(self, state, event):
        anchor, count = state
        if anchor is None or event[0] >= anchor + self.span:
            anchor, count = event[0], 0
        return (anchor, count + 1), (anchor, count + 1)


class RecheckGate(Replay):
    """Lets an item pass when it is new, when its content changed, or when the last fetch is old enough."""

    STATE = StructType([StructField("hash", StringType()), _long("fetched")])
    EVENT = StructType([*EVENT, StructField("hash", StringType())])
    RESULTS = "passed BOOLEAN"

    def __init__(self, recheck_us: int, keep_us: int):
        super().__init__(keep_us)
        self.recheck = recheck_us

    def start(self):
        return None, None

    def step(self, state, event):
        known, fetched = state
        passed = fetched is None or event[2] != known or event[0] >= fetched + self.recheck
        return ((event[2], event[0]) if passed else state), (passed,)


class Circuit(Replay):
    """closed -> open on a usage limit; -> half-open when a due probe is claimed; -> closed when that probe succeeds.

    Event kinds: limit (usage limit reached), claim and force (ask for a probe), ok and fail (result of the probe claimed
    at `claim`; an empty claim means the running one)."""

    STATE = StructType([
        StructField("state", StringType()), _long("failures"), _long("opened"), _long("next_probe"), _long("last_probe"),
        StructField("probing", BooleanType()),
    ])
    EVENT = StructType([*EVENT, StructField("kind", StringType()), _long("hint"), _long("claim")])
    RESULTS = "kind STRING, accepted BOOLEAN, state STRING, failures BIGINT, next_probe BIGINT"

    def __init__(self, lease_us: int, keep_us: int):
        super().__init__(keep_us)
        self.lease = lease_us

    def start(self):
        return "closed", 0, None, None, None, False

    def _open(self, c: dict, now: int, hint: int | None) -> bool:
        if c["state"] == "open":
            # An open circuit is only ever extended.
            if hint is None or (c["next_probe"] is not None and hint <= c["next_probe"]):
                return False
            c["next_probe"] = hint
            return True
        delay = PROBE_MINUTES[min(c["failures"], len(PROBE_MINUTES) - 1)] * MINUTE
        c["next_probe"] = max(now + delay, hint or 0)
        c["opened"] = c["opened"] or now
        c["state"], c["failures"] = "open", c["failures"] + 1
        return True

    def _claim(self, c: dict, now: int, force: bool) -> bool:
        if c["probing"] and (c["last_probe"] is None or c["last_probe"] <= now - self.lease):
            c["probing"] = False
            if c["state"] == "half-open":
                c["state"], c["next_probe"] = "open", now
        due = force or (c["state"] == "open" and c["next_probe"] is not None and c["next_probe"] <= now)
        if c["probing"] or not due:
            return False
        c["state"] = "closed" if c["state"] == "closed" else "half-open"
        c["last_probe"], c["probing"] = now, True
        return True

    def _result(self, c: dict, now: int, ok: bool, claim: int | None, hint: int | None) -> bool:
        current = c["probing"] and (claim is None or claim == c["last_probe"])
        accepted = False
        if ok or c["state"] == "closed":
            if current and c["state"] in ("closed", "half-open"):
                c.update(state="closed", failures=0, opened=None, next_probe=None, probing=False)
                accepted = True
        elif current:
            accepted = self._open(c, now, hint)
        if current:
            c["probing"] = False
        return accepted

    def step(self, state, event):
        c = dict(zip(self.STATE.names, state))
        now, _, kind, hint, claim = event
        if kind == "limit":
            accepted = self._open(c, now, hint)
        elif kind in ("claim", "force"):
            accepted = self._claim(c, now, kind == "force")
        else:
            accepted = self._result(c, now, kind == "ok", claim, hint)
        return tuple(c[n] for n in self.STATE.names), (kind, accepted, c["state"], c["failures"], c["next_probe"])


def _keyed(stream: DataFrame, key: str, processor: Replay, keep_hours: float, options: dict) -> DataFrame:
    """The last result per key and row. The watermark is taken from `us`, the rows go on without it."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    clock = stream.withColumn("_clock", F.timestamp_micros("us")).withWatermark("_clock", f"{int(keep_hours * 3600)} seconds")
    results = clock.drop("_clock").groupBy(key).transformWithStateInPandas(processor, processor.OUTPUT, "update", "eventTime")
    return last_update(write_batches(results, "update", **options), ["key", "id"]).withColumnRenamed("key", key)


def _micros(hours: float) -> int:
    return int(hours * 60 * MINUTE)


def stream_rate_limit(
    events: DataFrame, client: str, ts: str, event_id: str, limit: int = 20, window_seconds: int = 60,
    keep_hours: float = KEEP_HOURS, **options,
) -> DataFrame:
    """The live form of `rate_limit_fixed`."""
    rows = events.select(
        F.col(client).cast("string").alias("client"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.col(event_id).alias("id"),
    )
    counted = _keyed(rows, "client", FixedWindow(window_seconds * 1_000_000, _micros(keep_hours)), keep_hours, options)
    return counted.withColumn("rejected", F.col("number") > limit)


def stream_recheck_gate(
    items: DataFrame, item: str, ts: str, event_id: str, content: str, recheck_hours: int = 24,
    keep_hours: float = KEEP_HOURS, **options,
) -> DataFrame:
    """Items that pass, with whether they came too late to be judged by their own time."""
    rows = items.select(
        F.col(item).cast("string").alias("item"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.col(event_id).alias("id"), F.col(content).alias("hash"),
    )
    judged = _keyed(rows, "item", RecheckGate(recheck_hours * 60 * MINUTE, _micros(keep_hours)), keep_hours, options)
    return judged.filter("passed").drop("passed")


def stream_circuit(events: DataFrame, lease_seconds: int = 245, keep_hours: float = KEEP_HOURS, **options) -> DataFrame:
    """Circuit after each event; `events` has provider, us, id, kind, hint, claim."""
    return _keyed(events, "provider", Circuit(lease_seconds * 1_000_000, _micros(keep_hours)), keep_hours, options)
