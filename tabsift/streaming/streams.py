"""Structured Streaming twins of the usage operators.

Each function takes a streaming DataFrame and returns one; the caller starts it with a
checkpoint in shared storage, so a restarted query resumes without loss. State is keyed and
bounded by a watermark or by one small row per key.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tabsift.functions.contracts import valid_messages
from tabsift.usage.audit import month_of
from tabsift.usage.jobs import QUEUED, RUNNING, TERMINAL, TRANSITIONS
from tabsift.usage.quota import (
    RATE_LIMITED_PATHS, REQUESTS_PER_MINUTE, SIZE_LIMITED_PATHS, starts_with_any,
)
from tabsift.usage.tiers import PAID, TierLimits, with_tier

# How late counters and idempotency keys may arrive, topics per tier.
COUNTER_DELAY = "10 minutes"
KEY_LIFETIME = "24 hours"
TOPIC_PAID, TOPIC_FREE = "topic.v1.jobs.paid", "topic.v1.jobs.free"
JOB_TOPICS = ("topic.v1.jobs", TOPIC_PAID, TOPIC_FREE)


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "json", **options) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).options(**options).load(path)


@contextmanager
def _state_partitions(spark: SparkSession):
    """One state partition per core: a query keeps the number it first started with."""
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def run_available(
    stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partition_by=None
):
    """Process everything that is there into parquet files, then stop."""
    writer = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _state_partitions(stream.sparkSession):
        query = writer.start()
        query.awaitTermination()
    return query


def run_batches(stream: DataFrame, sink, checkpoint: str, mode: str = "update"):
    """Hand every micro-batch to ``sink(df, batch_id)``; repeats of a batch carry its id."""
    with _state_partitions(stream.sparkSession):
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return query


def late_rows(query) -> int:
    """Rows a query dropped because they came after the watermark."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress for operator in progress["stateOperators"]
    )


# ---- messages --------------------------------------------------------------------------------

def route_jobs(messages: DataFrame, tiers: DataFrame, value: str = "value") -> DataFrame:
    """``key, value, topic``: job messages to their tier's lane, keyed by user."""
    user = F.get_json_object(value, "$.user_id")
    return with_tier(messages.withColumn("user_id", user), tiers).select(
        F.col("user_id").alias("key"), F.col(value).alias("value"),
        F.when(F.col("tier") == PAID, TOPIC_PAID).otherwise(TOPIC_FREE).alias("topic"),
    )


# ---- first writer wins -----------------------------------------------------------------------

def first_within(
    stream: DataFrame, keys: list[str], ts: str = "ts", lifetime: str = KEY_LIFETIME
) -> DataFrame:
    """The first arrival per key while the key lives; later ones are dropped."""
    return stream.withWatermark(ts, lifetime).dropDuplicatesWithinWatermark(keys)


# ---- counters ----------------------------------------------------------------------------------

def ops_per_day(stream: DataFrame, ts: str = "ts", delay: str = COUNTER_DELAY) -> DataFrame:
    """``user_id, day, ops`` in tumbling UTC days."""
    return (
        stream.withWatermark(ts, delay)
        .groupBy("user_id", F.window(ts, "1 day").alias("w"))
        .agg(F.count(F.lit(1)).alias("ops"))
        .select("user_id", F.to_date("w.start").alias("day"), "ops")
    )


def quota_overruns(
    stream: DataFrame, tiers: DataFrame, limits: TierLimits = TierLimits(), **options
) -> DataFrame:
    """Days beyond the cap: ``user_id, day, ops, tier, cap``."""
    counted = with_tier(ops_per_day(stream, **options), tiers)
    cap = limits.daily_ops(F.col("tier"))
    return counted.withColumn("cap", cap).filter((F.col("cap") > 0) & (F.col("ops") > F.col("cap")))


def ip_rate(
    stream: DataFrame, per_minute: int = REQUESTS_PER_MINUTE, ts: str = "ts",
    delay: str = COUNTER_DELAY,
) -> DataFrame:
    """``ip, minute, requests, limited`` in tumbling minutes over the rate-limited paths."""
    return (
        stream.filter(starts_with_any(F.col("path"), RATE_LIMITED_PATHS))
        .withWatermark(ts, delay)
        .groupBy("ip", F.window(ts, "60 seconds").alias("w"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .select("ip", F.col("w.start").alias("minute"), "requests",
                (F.col("requests") > per_minute).alias("limited"))
    )


def size_rejects(
    stream: DataFrame, tiers: DataFrame, limits: TierLimits = TierLimits()
) -> DataFrame:
    """Oversized requests with ``tier, max_upload_mb``; stateless."""
    seen = with_tier(
        stream.filter(
            starts_with_any(F.col("path"), SIZE_LIMITED_PATHS) & F.col("user_id").isNotNull()
        ), tiers,
    ).withColumn("max_upload_mb", limits.upload_mb(F.col("tier")))
    return seen.filter(
        (F.col("max_upload_mb") > 0)
        & (F.col("size_bytes") > F.col("max_upload_mb").cast("bigint") * 1024 * 1024)
    )


def quarantined(
    failures: DataFrame, count: int = 3, within: str = "5 minutes", step: str = "1 minute",
    minutes: int = 10, ts: str = "ts", delay: str = COUNTER_DELAY,
) -> DataFrame:
    """Plugins that failed ``count`` times within a sliding window."""
    return (
        failures.withWatermark(ts, delay)
        .groupBy("plugin_id", F.window(ts, within, step).alias("w"))
        .agg(F.count(F.lit(1)).alias("failures"))
        .filter(F.col("failures") >= count)
        .select(
            "plugin_id", "failures", F.col("w.end").alias("quarantined_from"),
            (F.col("w.end") + F.make_dt_interval(mins=F.lit(minutes))).alias("quarantined_until"),
        )
    )


# ---- audit -------------------------------------------------------------------------------------

def audit_log(messages: DataFrame, value: str = "value", lifetime: str = KEY_LIFETIME) -> DataFrame:
    """Valid audit messages as log rows with ``month``, each event once within its lifetime."""
    rows = valid_messages(messages.select(value), value, "audit-events").select(
        "event_id", "user_id", "action", "target",
        F.to_json("metadata").alias("metadata"), F.col("occurred_at").alias("created_at"),
    )
    return first_within(rows, ["event_id"], "created_at", lifetime).withColumn(
        "month", month_of(F.col("created_at"))
    )


# ---- job state -----------------------------------------------------------------------------------

_STATE = [
    T.StructField("status", T.StringType()),
    T.StructField("started_at", T.LongType()),
    T.StructField("finished_at", T.LongType()),
    T.StructField("result_ref", T.StringType()),
    T.StructField("error", T.StringType()),
]
_HELD = T.StructType([*_STATE, T.StructField("ends", T.LongType())])
_CHANGE = T.StructType([T.StructField("job_id", T.StringType()), *_STATE])
_ENDING = T.StructType([
    T.StructField("jobs", T.ArrayType(T.StringType())), T.StructField("ends", T.ArrayType(T.LongType())),
])
_EVENT = ("job", "at", "event_id", "status", "result_ref", "error")
_KNOWN = T.StructType([T.StructField("known", T.BooleanType())])

#: Groups of jobs that are handed to Python together.
JOB_GROUPS = 1024
#: Jobs are listed by the period their state ends in, so many to the time it is kept.
PERIODS = 8
#: Calls of the state store that go out together: of so many keys, with so many letters.
CALLS, CALL_LETTERS = 128, 1 << 13


class _Heard:
    """The events of a job that can change it: its first running, its first stop and its completions.
    Only those are kept, so a busy job's heartbeats, the bulk of its events, are not held; a completion
    counts once the run before it is known. ``last`` is the time of the last event.

    An event begins with its place in the order, (without a time, time, id): those without a time come last.
    """

    __slots__ = ("run", "stop", "done", "last")

    def __init__(self):
        self.run, self.stop, self.done, self.last = None, None, {}, None

    def add(self, event: tuple) -> None:
        timeless, at, _, status, *_ = event
        if not timeless and (self.last is None or at > self.last):
            self.last = at
        if status == "completed":
            self.done.setdefault(event[:3], event)
        elif timeless:
            return
        elif status == RUNNING:
            self.run = event if self.run is None or event[:3] < self.run[:3] else self.run
        elif status in TERMINAL:
            self.stop = event if self.stop is None or event[:3] < self.stop[:3] else self.stop

    def in_order(self) -> list[tuple]:
        events = [e for e in (self.run, self.stop) if e is not None] + [*self.done.values()]
        return sorted(events, key=lambda e: e[:3])


def _advance(state: tuple, event: tuple) -> tuple:
    """The state after one event; an illegal transition changes nothing."""
    status, started, finished, result_ref, error = state
    _, at, _, told, ref, problem = event
    if told not in TRANSITIONS.get(status, ()):
        return state
    return (
        told,
        at if told == RUNNING and started is None else started,
        at if told in TERMINAL else finished,
        ref or result_ref,
        problem or error,
    )


def _portions(keys: Iterable) -> Iterator[list]:
    """Keys whose calls may go out together."""
    some, letters = [], 0
    for key in keys:
        size = len(key) if isinstance(key, str) else 0
        if some and (len(some) == CALLS or letters + size > CALL_LETTERS):
            yield some
            some, letters = [], 0
        some.append(key)
        letters += size
    if some:
        yield some


class _Calls:
    """Calls of the state store under keys of one's choice, sent together before their answers are read.

    Spark's client waits for every answer, which costs far more than the call. The store answers in
    order. Nobody reads while calls go out, so either they or their answers have to be short.
    """

    def __init__(self, handle: StatefulProcessorHandle):
        self._client = handle._statefulProcessorApiClient
        # Keys and values are plain here and need none of the client's conversions.
        self._client._serialize_to_bytes = lambda schema, data: pickle.dumps(tuple(data), pickle.HIGHEST_PROTOCOL)

    def under(self, *key) -> None:
        """The calls that follow are for this key."""
        self._client.set_implicit_key(key)

    def read(self, value: bytes) -> tuple | None:
        return tuple(self._client._deserialize_from_bytes(value)) if value else None

    @contextmanager
    def together(self) -> Iterator[list]:
        """Status and value of every call that the body makes; what a call returns in there says nothing."""
        client, answers, sent = self._client, [], 0
        line, receive = client.sockfile, client._receive_proto_message

        def later() -> tuple:
            nonlocal sent
            sent += 1
            return 0, "", b""

        client.sockfile, client._receive_proto_message = io.BytesIO(), later
        try:
            yield answers
            calls = client.sockfile.getvalue()
        finally:
            client.sockfile, client._receive_proto_message = line, receive
        line.write(calls)
        line.flush()
        for _ in range(sent):
            status, message, value = receive()
            # 2: there is no such value.
            if status not in (0, 2):
                raise RuntimeError(f"state store: {message}")
            answers.append((status, value))


class _JobMachine(StatefulProcessor):
    """One small row of state per job, until nothing has been heard of it for the time it is kept.

    A call of the state store is what a job costs, so jobs come in groups and calls for many jobs go
    out together. A job's row is under ``(jobs, None, job_id)``. While the period of its end has not
    begun, the end stands in the list under ``(jobs, period, None)``, which has one timer, for the
    period's begin; a job's last entry there counts, and one without an end says that it moved. In a
    period that has begun every end has its own timer, and the last one of a job ends its state.
    """

    def __init__(self, kept_ms: int):
        self.kept_ms, self.period_ms = kept_ms, max(kept_ms // PERIODS, 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle, self._calls = handle, _Calls(handle)
        self._held = handle.getValueState("job", _HELD)
        self._ending = handle.getListState("ending", _ENDING)
        self._known = handle.getValueState("known", _KNOWN)

    def _states(self, group: int, jobs: list) -> list[tuple | None]:
        with self._calls.together() as answers:
            for job in jobs:
                self._calls.under(group, None, job)
                self._held.get()
        return [self._calls.read(value) for _, value in answers[1::2]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        group, mark, heard, ending, fields = key[0], timerValues.getCurrentWatermarkInMs(), {}, {}, None
        for row in rows:
            fields = fields or itemgetter(*[row.__fields__.index(c) for c in _EVENT])
            job, at, *event = fields(row)
            if job not in heard:
                heard[job] = _Heard()
            heard[job].add((at is None, at, *event))
        # A group that never had a state is not asked for those of its jobs.
        new, wrote = not self._known.exists(), False
        change = Row(*_CHANGE.names)
        for jobs in _portions(heard):
            changes = []
            states = [None] * len(jobs) if new else self._states(group, jobs)
            with self._calls.together():
                for job, held in zip(jobs, states):
                    *before, ends = held or (QUEUED, None, None, None, None, None)
                    after = before = tuple(before)
                    for event in heard[job].in_order():
                        after = _advance(after, event)
                    # Without a state there is nothing to end.
                    if held is None and after == before:
                        continue
                    last = heard[job].last
                    until = (mark if last is None else last // 1000) + self.kept_ms
                    until = until if ends is None else max(until, ends)
                    if after != before:
                        changes.append(change(str(job), *after))
                    elif until == ends:
                        continue
                    self._calls.under(group, None, job)
                    self._held.update((*after, until))
                    wrote = True
                    if until == ends:
                        continue
                    # Also where the period has begun: its list may be read in this very micro-batch.
                    if ends is not None:
                        ending.setdefault(ends // self.period_ms, []).append((job, None))
                    if until // self.period_ms * self.period_ms <= mark:
                        self._handle.registerTimer(until)
                    else:
                        ending.setdefault(until // self.period_ms, []).append((job, until))
            yield from changes
        self._list(group, ending)
        if new and wrote:
            self._calls.under(*key)
            self._known.update((True,))

    def _list(self, group: int, ending: dict[int, list]) -> None:
        for periods in _portions(ending):
            with self._calls.together() as answers:
                for period in periods:
                    self._calls.under(group, period, None)
                    self._ending.exists()
            with self._calls.together():
                for period, (missing, _) in zip(periods, answers[1::2]):
                    self._calls.under(group, period, None)
                    self._ending.appendValue(tuple(map(list, zip(*ending[period]))))
                    if missing:
                        self._handle.registerTimer(period * self.period_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        group, period, _ = key
        mark = timerValues.getCurrentWatermarkInMs()
        if period is None:
            held = self._held.get()
            if held is not None and held[-1] <= mark:
                self._held.clear()
            return iter(())
        ends = {job: end for jobs, moments in self._ending.get() for job, end in zip(jobs, moments)}
        self._ending.clear()
        for jobs in _portions(job for job, end in ends.items() if end is not None):
            with self._calls.together():
                for job in jobs:
                    self._calls.under(group, None, job)
                    if ends[job] <= mark:
                        self._held.clear()
                    else:
                        self._handle.registerTimer(ends[job])
        # Spark ends the timer of the key that was called last.
        self._calls.under(*key)
        return iter(())

    def close(self) -> None:
        pass


def _job_rows(events: DataFrame, late: str) -> DataFrame:
    return events.select(
        F.col("job_id").cast("string").alias("job_id"), "status",
        F.col("ts").cast("timestamp").alias("ts"), "event_id",
        F.col("result_ref").cast("string").alias("result_ref"),
        F.col("error").cast("string").alias("error"),
    ).withWatermark("ts", late)


def _group(groups: int) -> Column:
    return F.pmod(F.xxhash64("job_id"), F.lit(groups)).cast("int").alias("jobs")


def job_states(events: DataFrame, late: str = KEY_LIFETIME, kept: pd.Timedelta = pd.Timedelta(days=7)) -> DataFrame:
    """Changed jobs per micro-batch from ``job_id, status, ts, event_id, result_ref, error``.

    Micro-batches apply in arrival order, the events of one micro-batch by ``(ts, event_id)``. Events
    older than the watermark (``late`` behind the newest) are dropped. A job's state ends when the
    watermark is ``kept`` beyond its last event, so what is held follows from the jobs of that time.
    """
    # Events come by group; keys with a period or a job are those under which the machine keeps state.
    none = F.col("jobs") < 0
    rows = _job_rows(events, late).select("*", _group(JOB_GROUPS), F.unix_micros("ts").alias("at")).select(
        "jobs", F.when(none, F.col("at")).alias("period"), F.when(none, F.col("job_id")).alias("job_id"),
        F.col("job_id").alias("job"), "status", "ts", "at", "event_id", "result_ref", "error",
    )
    changes = rows.groupBy("jobs", "period", "job_id").transformWithState(
        statefulProcessor=_JobMachine(int(kept.total_seconds() * 1000)), outputStructType=_CHANGE,
        outputMode="Update", timeMode="EventTime",
    )
    return changes.select("job_id", "status", *[F.timestamp_micros(c).alias(c) for c in ("started_at", "finished_at")],
                          "result_ref", "error")


#: Groups of jobs whose last ticks are kept as one list: a call of the state store serves many jobs.
TICK_GROUPS = 1024
_TICKS = T.StructType([
    T.StructField("job_id", T.StringType()), T.StructField("last_seen", T.LongType()),
    T.StructField("ended", T.BooleanType()), T.StructField("ends", T.LongType()),
])


class _Silence(StatefulProcessor):
    """The last ticks of a group of running jobs; a timer tells when the next of them is overdue."""

    def __init__(self, kept_ms: int):
        self.kept_ms = kept_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._held = handle.getListState("jobs", _TICKS)

    def _known(self) -> pd.DataFrame:
        held = pd.DataFrame([tuple(r) for r in self._held.get()], columns=_TICKS.names)
        return held.astype({"last_seen": "Int64", "ended": "bool", "ends": "Int64"})

    def _keep(self, jobs: pd.DataFrame) -> None:
        if jobs.empty:
            self._held.clear()
            return
        columns = [jobs[c].astype(object).where(jobs[c].notna(), None) for c in _TICKS.names]
        self._held.put(list(zip(*columns)))
        self._handle.registerTimer(int(jobs["ends"].min()))

    @staticmethod
    def _merged(parts: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(parts).groupby("job_id", dropna=False, as_index=False, sort=False).agg(
            {"last_seen": "max", "ended": "max", "ends": "max", "seen": "max"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        news = None
        for frame in rows:
            at = frame["at"].astype("Int64")
            part = pd.DataFrame({
                "job_id": frame["job_id"], "last_seen": at.where(frame["tick"].astype(bool)),
                "ended": frame["ended"].astype(bool), "ends": pd.array([None] * len(frame), "Int64"), "seen": at})
            news = self._merged([part] if news is None else [news, part])
        if news is None or news.empty:
            return iter(())
        known = self._known()
        jobs = self._merged([known.assign(seen=pd.array([None] * len(known), "Int64")), news]) if len(known) else news
        touched = jobs["job_id"].isin(news["job_id"])
        # An ended job is held as long as a running one, so that a late tick does not revive it.
        last = jobs["last_seen"].mask(jobs["ended"].astype(bool)).fillna(jobs["seen"]) // 1000
        ends = last.fillna(timerValues.getCurrentWatermarkInMs()) + self.kept_ms
        later = ends.where(jobs["ends"].isna() | (ends > jobs["ends"]), jobs["ends"])
        jobs["ends"] = later.where(touched, jobs["ends"])
        self._keep(jobs)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        jobs = self._known()
        due = jobs["ends"] <= timerValues.getCurrentWatermarkInMs()
        if due.any():
            self._keep(jobs[~due])
        stale = jobs[due & jobs["last_seen"].notna() & ~jobs["ended"]]
        if len(stale):
            yield pd.DataFrame({"job_id": stale["job_id"].map(str), "last_seen": stale["last_seen"].astype("int64")})

    def close(self) -> None:
        pass


def stale_jobs(events: DataFrame, silent: pd.Timedelta = pd.Timedelta(minutes=10), late: str = COUNTER_DELAY) -> DataFrame:
    """``job_id, last_seen`` of running jobs that have not ticked for ``silent``, once for each silence.

    A job is stale when the watermark (``late`` behind the newest event of all) has passed its last
    tick by that time and it has neither completed, failed nor been cancelled.
    """
    status = F.col("status")
    rows = _job_rows(events, late).select(
        _group(TICK_GROUPS), "job_id", "ts",
        F.unix_micros("ts").alias("at"), *[F.coalesce(is_so, F.lit(False)).alias(name) for name, is_so in (
            ("tick", status == RUNNING), ("ended", status.isin(*TERMINAL)))])
    stale = rows.groupBy("jobs").transformWithStateInPandas(
        statefulProcessor=_Silence(int(silent.total_seconds() * 1000)),
        outputStructType="job_id string, last_seen long", outputMode="Append", timeMode="EventTime",
    )
    return stale.select("job_id", F.timestamp_micros("last_seen").alias("last_seen"))


# ---- results of jobs -----------------------------------------------------------------------------

def applied_results(
    jobs: DataFrame, results: DataFrame, within: str = KEY_LIFETIME, late: str = COUNTER_DELAY,
    unanswered: bool = False,
) -> DataFrame:
    """Jobs (``job_id, created_at``, other columns) with the results that reach them: ``status, ts,
    result_ref, error``.

    Both are streams. A result counts from its job's creation until ``within`` after it; one of an
    unknown job, one before its job, and one behind the watermark change nothing. The time range
    bounds what both sides hold. With ``unanswered`` a job without a result shows once no result can
    come any more, with nulls.
    """
    left = jobs.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    right = results.select(
        F.col("job_id").alias("_job"), "status", F.col("ts").cast("timestamp").alias("ts"), "result_ref", "error",
    ).withWatermark("ts", late)
    reached = (
        (left["job_id"] == right["_job"]) & (right["ts"] >= left["created_at"])
        & (right["ts"] <= left["created_at"] + F.expr(f"INTERVAL {within}"))
    )
    return left.join(right, reached, "left_outer" if unanswered else "inner").drop("_job")


def latest_states(changes: DataFrame) -> DataFrame:
    """The last state per job from an append-only table of changes with a ``batch`` number."""
    fields = [c for c in changes.columns if c not in ("job_id", "batch")]
    return changes.groupBy("job_id").agg(
        F.max_by(F.struct(*fields), "batch").alias("s")
    ).select("job_id", "s.*")


def change_sink(path: str):
    """Batch sink that stores job changes under their batch number; a repeated batch replaces its
    own folder."""

    def write(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/b{batch:08d}")

    return write
