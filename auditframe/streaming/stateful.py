"""Stateful operators on transformWithState: session correlation (ST1 to ST3), requests that wait for an answer (ST6, ST7).

State is kept in RocksDB on the executors and its changes in the checkpoint folder, so a lost executor
loses nothing. Both operators see the rows of a key in order of time within a batch; a result depends on the rows and
their times only, not on how batches cut them, as long as a key's rows arrive in order from batch to batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.window import Window

from auditframe.session import scratch_path, ship
from auditframe.streaming.session import IDLE_MS, _step

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: A request waits so long for its answer.
LIMIT_S = 30
#: Buckets of open requests; more of them make each one's value, which is read and written whole, shorter.
BUCKETS = 1_024


def use_rocksdb(spark: SparkSession) -> None:
    """transformWithState needs this store; it holds for queries that start from now on."""
    ship(spark)
    spark.conf.set(_STORE, _ROCKS)


class Correlation(StatefulProcessor):
    """The recent sensitive events of a session as a list; in processing time they have a time to live, in event time a timer."""

    OUT = "session string, sink_index long, sink_kind string, source_index long"

    def __init__(self, idle_ms: int = IDLE_MS, ttl: bool = False) -> None:
        self.idle_ms, self.ttl = idle_ms, ttl

    def init(self, handle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "i long, t double, k array<string>", self.idle_ms if self.ttl else None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buffer = [(i, t, tuple(k or ())) for i, t, k in self.recent.get()]
        own = pd.concat(list(rows)).sort_values("event_index")
        out = []
        for r in own.itertuples(index=False):
            keys = list(r.correlation_keys) if r.correlation_keys is not None else []
            buffer, matched = _step(buffer, int(r.event_index), r.ts.timestamp(), bool(r.sensitive), r.sink_kind or None, keys)
            if matched is not None:
                out.append((key[0], int(r.event_index), r.sink_kind, matched))
        if buffer:
            self.recent.put([(i, t, list(k)) for i, t, k in buffer])
        else:
            self.recent.clear()
        if not self.ttl:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if buffer:
                self.handle.registerTimer(int(own["ts"].max().timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame(out, columns=["session", "sink_index", "sink_kind", "source_index"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        yield pd.DataFrame({c: [] for c in ("session", "sink_index", "sink_kind", "source_index")})

    def close(self) -> None:
        pass


def correlate(events: DataFrame, delay: str = "60 seconds", processing_time: bool = False) -> DataFrame:
    """ST1 to ST3 on a stream of (session, event_index, ts, sensitive, sink_kind, correlation_keys).

    State of a session ends 300 seconds after its last event: by a timer in event time, or by the state's time to live in
    processing time. A global cap of sessions has no equivalent, as state is partitioned by session.
    """
    use_rocksdb(events.sparkSession)
    rows = events.select("session", "event_index", "ts", "sensitive", "sink_kind", "correlation_keys")
    if processing_time:
        return rows.groupBy("session").transformWithStateInPandas(Correlation(ttl=True), Correlation.OUT, "Append", "ProcessingTime")
    return rows.withWatermark("ts", delay).groupBy("session").transformWithStateInPandas(Correlation(), Correlation.OUT, "Append", "EventTime")


class Pending(StatefulProcessor):
    """The open requests of a bucket of sessions and ids, as one value; a timer at the first time limit tells of answers that do not come.

    Requests whose limit has been told of stay in a second value until the next message of their id, which is late by them
    whether or not the timer was first.
    """

    OUT = "session string, request_id string, state string, asked_at timestamp, answered_at timestamp"

    def __init__(self, limit_s: int = LIMIT_S) -> None:
        self.limit_us = limit_s * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "requests string")
        self.told = handle.getValueState("told", "requests string")

    def _passed(self) -> dict[tuple, int]:
        """(session, id) to the time of its last request, of which a timer told."""
        return {(s, r): us for s, r, us in json.loads(self.told.get()[0])} if self.told.exists() else {}

    def _keep_passed(self, passed: dict[tuple, int]) -> None:
        if passed:
            self.told.update((json.dumps([(*k, us) for k, us in passed.items()]),))
        else:
            self.told.clear()

    def _held(self) -> tuple[dict[tuple, int], int | None]:
        """(session, id) to the time of its open request, and the bucket's timer."""
        rows, timer = json.loads(self.open.get()[0]) if self.open.exists() else ([], None)
        return {(s, r): us for s, r, us in rows}, timer

    def _keep(self, held: dict[tuple, int], timer: int | None, rung: bool = False) -> None:
        """Keep what is open, with one timer for the first limit; an earlier timer than needed is left to ring."""
        if not held:
            if timer is not None and not rung:
                self.handle.deleteTimer(timer)
            self.open.clear()
            return
        due = (min(held.values()) + self.limit_us) // 1000 + 1
        if rung or timer is None or due < timer:
            if timer is not None and not rung:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
            timer = due
        self.open.update((json.dumps([[(*k, us) for k, us in held.items()], timer]),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows))
        own = own[own["request_id"].notna()]  # the others only move the watermark
        if own.empty:
            yield _states([])
            return
        own["us"] = own["ts"].astype("datetime64[us]").astype("int64")
        own = own.sort_values(["us", "is_response", "seq"])
        held, timer = self._held()
        passed = self._passed()
        n_passed, out = len(passed), []
        for s, q, is_response, us in zip(own["session"], own["request_id"], own["is_response"], own["us"], strict=True):
            at, us = (s if isinstance(s, str) else None, q), int(us)
            known = passed.pop(at, None) if passed else None
            asked = held.pop(at, None)
            in_time = asked is not None and us - asked <= self.limit_us
            if is_response:
                if asked is not None and not in_time:
                    out.append((*at, "response_timeout", asked, None))
                asked = known if asked is None else asked
                out.append((*at, "answered" if in_time else "late_response" if asked is not None else "unknown_response", asked, us))
            else:
                if asked is not None:
                    out.append((*at, "superseded" if in_time else "response_timeout", asked, None))
                held[at] = us
        self._keep(held, timer)
        if len(passed) < n_passed:
            self._keep_passed(passed)
        yield _states(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._held()
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000
        gone = [(k, us) for k, us in held.items() if us + self.limit_us < now]
        for k, _ in gone:
            del held[k]
        self._keep(held, None, rung=True)
        if gone:
            self._keep_passed(self._passed() | dict(gone))
        yield _states([(*k, "response_timeout", us, None) for k, us in gone])

    def close(self) -> None:
        pass


def _states(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["session", "request_id", "state", "asked_at", "answered_at"])
    for c in ("asked_at", "answered_at"):
        out[c] = pd.to_datetime(out[c].astype("Int64"), unit="us")
    return out


def pending_requests(messages: DataFrame, delay: str = "60 seconds", limit_s: int = LIMIT_S, buckets: int = BUCKETS) -> DataFrame:
    """What becomes of each request on a stream of (session, request_id, is_response, ts, seq): session, request_id, state, asked_at, answered_at.

    ``answered`` within ``limit_s`` seconds, ``response_timeout`` (told by a timer when the watermark passes
    the limit, or before that by a later message of the same id), ``superseded`` by a request of the same id, and of responses without an
    open request ``late_response`` or ``unknown_response``. Equal times: requests first, then by seq. Null ids
    only move the watermark. State is kept for each of ``buckets`` buckets of sessions and ids, so a busy session is dealt over many
    and a short request costs a place in its bucket's value, not a key, a timer and calls of its own. A request whose limit has
    passed stays in state until the next message of its id, for ever if there is none.
    """
    use_rocksdb(messages.sparkSession)
    rows = messages.select(F.col("session").cast("string").alias("session"), F.col("request_id").cast("string").alias("request_id"), "is_response", "ts", F.col("seq").cast("long").alias("seq"))
    # Null ids are dealt by their number, so that many of them are no busy bucket.
    bucket = F.pmod(F.xxhash64("session", F.coalesce("request_id", F.concat(F.lit("#"), F.col("seq").cast("string")))), F.lit(buckets)).cast("int")
    return rows.withColumn("bucket", bucket).withWatermark("ts", delay).groupBy("bucket").transformWithStateInPandas(Pending(limit_s), Pending.OUT, "Append", "EventTime")


def pending_batch(messages: DataFrame, limit_s: int = LIMIT_S) -> DataFrame:
    """The same over a log, by the neighbours of each message of an id; requests still open at its end have no answer."""
    own = Window.partitionBy("session", "request_id").orderBy("ts", "is_response", "seq")
    at = lambda x: F.unix_micros(F.col(x))
    rows = messages.filter("request_id is not null").select(F.col("session").cast("string").alias("session"), F.col("request_id").cast("string").alias("request_id"), "is_response", "ts", "seq")
    rows = rows.withColumn("before", F.lag(F.struct("is_response", "ts")).over(own)).withColumn("after", F.lead(F.struct("is_response", "ts")).over(own))
    in_time = lambda a, b: at(b) - at(a) <= limit_s * 1_000_000
    asked = F.col("before").isNotNull() & ~F.col("before.is_response")
    response = F.when(asked & in_time("before.ts", "ts"), "answered").when(asked, "late_response").otherwise("unknown_response")
    request = F.when(F.col("after").isNull() | ~in_time("ts", "after.ts"), "response_timeout").when(~F.col("after.is_response"), "superseded")
    told = rows.withColumn("state", F.when(F.col("is_response"), response).otherwise(request)).filter("state is not null")
    asked_at = F.when(~F.col("is_response"), F.col("ts")).when(asked, F.col("before.ts"))
    return told.select("session", "request_id", "state", asked_at.alias("asked_at"), F.when(F.col("is_response"), F.col("ts")).alias("answered_at"))


def replay(rows: DataFrame, operator, slices: int, schema: str, end: DataFrame | None = None, session: str = "session") -> DataFrame:
    """A log as a stream: cut into ``slices`` of equal time, each written and read as batches of its own, in order.

    ``operator`` maps (stream, delay) to its result. A session's rows of a slice are in one file, so that files of a slice may
    be read in any order; the watermark lags by a slice. ``end`` are rows behind all others, to let timers expire.
    """
    spark = rows.sparkSession
    span = rows.agg(F.min(F.unix_seconds("ts")).alias("a"), F.max(F.unix_seconds("ts")).alias("b")).first()
    source, target, state = (scratch_path(spark, n) for n in ("replay-in", "replay-out", "replay-state"))
    low, high = (span.a or 0), (span.b or 0) + 1
    width = -(-(high - low) // slices)
    for k in range(slices):
        part = rows.filter((F.unix_seconds("ts") >= low + k * width) & (F.unix_seconds("ts") < low + (k + 1) * width))
        part.repartition(F.col(session)).write.mode("append").parquet(source)
    if end is not None:
        end.select(*rows.columns).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 8).parquet(source)
    out = operator(stream, f"{width + 1} seconds")
    query = out.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(target)
