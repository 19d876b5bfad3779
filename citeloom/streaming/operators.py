"""Structured Streaming operators with event time, watermarks and fault-tolerant state."""

from __future__ import annotations

import copy
import heapq
import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from citeloom.functions import constants as K, scoring as S
from citeloom.session import ROCKSDB_PROVIDER

from .steps import Machine


# Sources --------------------------------------------------------------------

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "*.parquet", files_per_trigger: int = 64, schema: str = EVENT_SCHEMA) -> DataFrame:
    """Event feed over a folder of parquet files; zone-free times become UTC timestamps for watermarks."""
    stream = (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
              .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


# Windowed aggregates --------------------------------------------------------

def tumbling_counts(stream: DataFrame, keys: Sequence[str], every: str = "1 day", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w"), *keys).agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def sliding_error_rate(stream: DataFrame, failed: Column, width: str, slide: str, delay: str, threshold: float = 0.05) -> DataFrame:
    rate = F.count_if(failed) / F.greatest(F.count("*"), F.lit(0.001))
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w")).agg(S.rounded(rate, 6).alias("error_rate"), F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "error_rate", (F.col("error_rate") > threshold).alias("firing"))


def sliding_p95(stream: DataFrame, value: str, width: str, slide: str, delay: str, bounds: Sequence[float] = tuple(K.HISTOGRAM_BOUNDS), limit: float = 2.0) -> DataFrame:
    """95th percentile by interpolation over fixed buckets: constant state per window."""
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    agg = stream.withWatermark("ts", delay).groupBy(F.window("ts", width, slide).alias("w")).agg(F.count(value).alias("n"), *counts)
    rank = F.col("n") * 0.95
    out = None
    for i, b in enumerate(bounds):
        lo, below = (bounds[i - 1], F.col(f"b{i - 1}")) if i else (0.0, F.lit(0))
        value_here = F.lit(lo) + (b - lo) * F.try_divide(rank - below, F.col(f"b{i}") - below)
        out = F.when(F.col(f"b{i}") >= rank, value_here) if out is None else out.when(F.col(f"b{i}") >= rank, value_here)
    p95 = S.rounded(out.otherwise(F.lit(float(bounds[-1]))), 6)
    return agg.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", p95.alias("p95"), (p95 > limit).alias("firing"))


def session_windows(stream: DataFrame, keys: Sequence[str], gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("s"), *keys).agg(F.count("*").alias("n")).select(
        *keys, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def dedupe_stream(stream: DataFrame, keys: Sequence[str], delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def live_counters(stream: DataFrame, labels: Sequence[str], value: str) -> DataFrame:
    """Counter, gauge and sum per label set; run in update mode."""
    return stream.groupBy(*labels).agg(F.count("*").alias("requests"), F.max_by(value, "ts").alias("last_value"), F.sum(value).alias("total"))


def budget_monitor(stream: DataFrame, cost: Column, budget: float = 100.0) -> DataFrame:
    """Cost per month against the budget; run in update mode."""
    agg = stream.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(S.rounded(F.sum(cost), 6).alias("cost"))
    state = F.when(F.col("cost") > budget, "budget_exceeded").when(F.col("cost") > budget * 0.8, "budget_warning").otherwise("ok")
    return agg.withColumn("state", state)


def phase_pairing(starts: DataFrame, ends: DataFrame, timeout: str, delay: str) -> DataFrame:
    """Start/end pairing: duration, or a timed-out row once the watermark passes the timeout."""
    s = starts.withWatermark("ts", delay).select(F.col("run_id"), F.col("ts").alias("started"))
    e = ends.withWatermark("ts", delay).select(F.col("run_id").alias("end_run"), F.col("ts").alias("ended"))
    on = (F.col("run_id") == F.col("end_run")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"INTERVAL {timeout}"))
    joined = s.join(e, on, "leftOuter")
    seconds = F.unix_seconds("ended") - F.unix_seconds("started")
    return joined.select("run_id", "started", "ended", seconds.alias("seconds"), F.when(F.col("ended").isNull(), "timed_out").otherwise("completed").alias("state"))


# Stateful processors --------------------------------------------------------

def _require_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)


class ReorderProcessor(StatefulProcessor):
    """Folds the events of every key of a shard in event order, whatever the order they arrive in.

    Events wait in buckets of event time until the watermark has passed them, so no event
    can come between those already folded; memory per shard is one bucket and the small states of its
    keys, not what a trigger brings. State is read and written by shard and bucket: a call to the store costs
    far more than a fold. Events at or before the watermark of their trigger
    come out as late and change no state. With a lifetime, a state is forgotten once
    its key has been idle for longer than that in event time; a timer removes it.
    """

    def __init__(self, machine: Machine, key: str, names: Sequence[str], bucket_us: int, ttl_us: int | None = None) -> None:
        self.machine, self.key, self.names, self.bucket_us, self.ttl_us = machine, key, list(names), bucket_us, ttl_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "bucket bigint", "us array<bigint>, event_id array<bigint>, ok array<boolean>, id array<bigint>")
        self.state = handle.getValueState("machines", "docs string")
        self.timer = handle.getValueState("timer", "ms bigint")

    def _wake(self, us: int | None) -> None:
        """One timer per shard: the first moment at which the watermark has passed ``us``."""
        now = self.timer.get()[0] if self.timer.exists() else None
        ms = None if us is None else us // 1000 + 1
        if now == ms:
            return
        if now is not None:
            self.handle.deleteTimer(now)
        if ms is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def _rows(self, ids: list[int], event_ids: list[int], late: bool, verdicts: list[dict]) -> pd.DataFrame:
        out = {self.key: ids, "event_id": event_ids, "late": [late] * len(event_ids)}
        return pd.DataFrame({**out, **{n: [v.get(n) for v in verdicts] for n in self.names}})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed, first = timerValues.getCurrentWatermarkInMs() * 1000, None
        for frame in rows:
            late = frame["us"] <= passed
            if late.any():
                ids = frame.loc[late, "event_id"].tolist()
                yield self._rows(frame.loc[late, self.key].tolist(), ids, True, [{}] * len(ids))
            for bucket, part in frame[~late].groupby(frame["us"] // self.bucket_us):
                held = self.pending.getValue((int(bucket),)) if self.pending.containsKey((int(bucket),)) else ([], [], [], [])
                self.pending.updateValue((int(bucket),), tuple([*old, *part[c].tolist()] for old, c in zip(held, ("us", "event_id", "ok", self.key))))
                earliest = int(part["us"].min())
                first = earliest if first is None else min(first, earliest)
        if first is not None and not (self.timer.exists() and self.timer.get()[0] <= first // 1000 + 1):
            self._wake(first)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed, left = timerValues.getCurrentWatermarkInMs() * 1000, None
        self.timer.clear()  # the timer that fired is gone
        docs = {int(k): v for k, v in json.loads(self.state.get()[0]).items()} if self.state.exists() else {}
        for bucket in sorted(int(b[0]) for b in self.pending.keys()):
            if bucket * self.bucket_us > passed:
                left = int(min(self.pending.getValue((bucket,))[0]))
                break
            events = sorted(zip(*self.pending.getValue((bucket,))))
            due = [e for e in events if e[0] <= passed]
            verdicts = []
            for us, _, ok, one in due:
                state, last = docs.get(one, (None, None))
                if state is None or (self.ttl_us is not None and us - last > self.ttl_us):
                    state = copy.deepcopy(self.machine.start)
                state, verdict = self.machine.fold(state, int(us), bool(ok))
                verdicts.append(verdict)
                docs[one] = (state, int(us))
            if due:
                yield self._rows([int(e[3]) for e in due], [int(e[1]) for e in due], False, verdicts)
            if len(due) < len(events):
                rest = events[len(due):]
                self.pending.updateValue((bucket,), tuple(map(list, zip(*rest))))
                left = int(rest[0][0])
                break
            self.pending.removeKey((bucket,))
        if self.ttl_us is not None:  # whatever comes now is later than the lifetime of those that go
            docs = {k: v for k, v in docs.items() if v[1] + self.ttl_us > passed}
        if docs:
            self.state.update((json.dumps(docs),))
        else:
            self.state.clear()
        ends = [] if self.ttl_us is None else [last + self.ttl_us for _, last in docs.values()]
        self._wake(min([*ends, *([] if left is None else [left])], default=None))

    def close(self) -> None:
        pass


def run_machine(stream: DataFrame, machine: Machine, verdicts: str, key: str = "user_id", ok: Column | None = None, delay: str = "1 hour", delay_us: int = 3_600_000_000,
                ttl_us: int | None = None, shards: int = 256) -> DataFrame:
    """A verdict for every event the watermark has passed, in event order per key, and a row with ``late`` set for every event that came behind it.

    ``delay`` is the watermark's, ``delay_us`` the same in microseconds; events it has not passed yet are in no row. With
    ``ttl_us`` a key that is idle for longer starts anew. Keys are dealt out to ``shards``, the most tasks that
    can share the work; a shard holds one bucket of events and the states of its keys in memory.
    """
    _require_rocksdb(stream.sparkSession)
    # Without the event-time column itself, Spark leaves late rows to the processor.
    rows = stream.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64(key), F.lit(shards)).alias("shard"), key, "event_id", F.unix_micros("ts").alias("us"), (F.lit(True) if ok is None else ok).alias("ok"))
    names = [part.split()[0] for part in verdicts.split(",")]
    return rows.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=ReorderProcessor(machine, key, names, max(1, delay_us // 4), ttl_us),
        outputStructType=f"{key} bigint, event_id bigint, late boolean, {verdicts}", outputMode="Append", timeMode="EventTime")


class LateProcessor(StatefulProcessor):
    """Passes on the rows whose window had closed by the watermark of their trigger; keeps no state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for frame in rows:
            late = frame[frame["end_us"] <= passed]
            if len(late):
                yield late[["event_id", "us", "end_us"]]

    def close(self) -> None:
        pass


def late_rows(stream: DataFrame, every: str, delay: str = "1 hour", shards: int = 64) -> DataFrame:
    """Reject table of a windowed aggregate over ``every`` with the watermark ``delay``: event_id, us, end_us of each row it drops.

    Every row is judged by the watermark of its own trigger, as the aggregate does; rows of open windows are in neither table.
    """
    _require_rocksdb(stream.sparkSession)
    rows = stream.withWatermark("ts", delay).select(
        F.pmod(F.xxhash64("event_id"), F.lit(shards)).alias("shard"), "event_id", F.unix_micros("ts").alias("us"), F.unix_micros(F.window("ts", every)["end"]).alias("end_us"))
    return rows.groupBy("shard").transformWithStateInPandas(
        statefulProcessor=LateProcessor(), outputStructType="event_id bigint, us bigint, end_us bigint", outputMode="Append", timeMode="EventTime")


class BufferProcessor(StatefulProcessor):
    """Keeps the last n event ids per key and emits the buffer after each trigger."""

    def __init__(self, key: str, n: int) -> None:
        self.key, self.n = key, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "us bigint, event_id bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.kept.get()) if self.kept.exists() else []
        for frame in rows:  # n events and one frame are held
            held = heapq.nlargest(self.n, [*held, *zip(frame["us"].tolist(), frame["event_id"].tolist())])
        held.sort()
        self.kept.put([(int(u), int(e)) for u, e in held])
        yield pd.DataFrame({self.key: key[0], "event_id": [int(e) for _, e in held], "newest": [len(held) - i for i in range(len(held))]})

    def close(self) -> None:
        pass


def bounded_buffer(stream: DataFrame, n: int, key: str = "user_id") -> DataFrame:
    _require_rocksdb(stream.sparkSession)
    rows = stream.select(key, "event_id", F.unix_micros("ts").alias("us"))
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=BufferProcessor(key, n), outputStructType=f"{key} bigint, event_id bigint, newest int", outputMode="Append", timeMode="None")


class HeartbeatProcessor(StatefulProcessor):
    """Emits one dead row when event time passes the last heartbeat by the timeout."""

    def __init__(self, key: str, timeout_ms: int) -> None:
        self.key, self.timeout_ms = key, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(f["ms"].max()) for f in rows if len(f))
        before = self.last.get()[0] if self.last.exists() else None
        if before is None or newest > before:
            if before is not None:
                self.handle.deleteTimer(before + self.timeout_ms)
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.timeout_ms)
        yield pd.DataFrame({self.key: pd.Series([], dtype="int64"), "last_ms": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame({self.key: [key[0]], "last_ms": [last]})

    def close(self) -> None:
        pass


def heartbeat_liveness(stream: DataFrame, timeout_seconds: int = 30, delay: str = "10 seconds", key: str = "user_id") -> DataFrame:
    _require_rocksdb(stream.sparkSession)
    rows = stream.withWatermark("ts", delay).select(key, "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=HeartbeatProcessor(key, timeout_seconds * 1000), outputStructType=f"{key} bigint, last_ms bigint", outputMode="Append", timeMode="EventTime")


class SustainedProcessor(StatefulProcessor):
    """Fires once per run of hot samples that lasts at least the hold time."""

    def __init__(self, key: str, hold_us: int) -> None:
        self.key, self.hold_us = key, hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.since = handle.getValueState("since", "us bigint, fired boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        since, fired = self.since.get() if self.since.exists() else (None, False)
        frames = [f for f in rows if len(f)]  # the closed windows of one key: few, and later than those of earlier triggers
        batch = pd.concat(frames).sort_values(["us"]) if frames else pd.DataFrame({"us": [], "hot": []})
        out = []
        for us, hot in zip(batch["us"], batch["hot"]):
            if not hot:
                since, fired = None, False
                continue
            since = int(us) if since is None else since
            if not fired and int(us) - since >= self.hold_us:
                fired = True
                out.append({self.key: key[0], "since_us": since})
        self.since.update((since, fired))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def sustained_alert(samples: DataFrame, hold_seconds: int, key: str) -> DataFrame:
    """``samples(key, ts, hot)``: alert when hot has held for the given time.

    The samples are windows of an append-mode aggregate: they come once, when the watermark has
    passed them, so those of a later trigger are later in event time.
    """
    _require_rocksdb(samples.sparkSession)
    rows = samples.select(key, F.unix_micros("ts").alias("us"), "hot")
    return rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=SustainedProcessor(key, hold_seconds * 1_000_000), outputStructType=f"{key} bigint, since_us bigint", outputMode="Append", timeMode="None")
