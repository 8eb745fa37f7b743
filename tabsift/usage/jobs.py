"""Job and request lifecycles folded from event tables by combining aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.operators.joins import keyed_join
from tabsift.operators.ranking import first_rows

# States, legal transitions, job kinds and where their results go.
QUEUED, RUNNING = "queued", "running"
TERMINAL = ("completed", "failed", "cancelled")
TRANSITIONS = {
    "queued": ("running", "cancelled", "failed"),
    "running": ("completed", "failed", "cancelled"),
    "completed": (),
    "failed": (),
    "cancelled": (),
}
RESULT_PREFIX = {
    "batch-filter": "filter",
    "convert": "convert",
    "analyze": "analyze",
    "ai-anomaly-full": "ai/anomaly",
}
OPEN_STATES = ("open", "triaged", "in-progress")
CLOSED_STATES = ("shipped", "rejected")
RECENT = 20


def _first(status: Column, fields: list[str]) -> Column:
    """The earliest event for which the condition holds, as a struct."""
    return F.min(F.when(status, F.struct(*fields)))


def fold_jobs(
    events: DataFrame, ts: str = "ts", seq: str = "event_id", jobs: DataFrame | None = None
) -> DataFrame:
    """State of each job after its result events: ``job_id, status, started_at, finished_at,
    result_ref, error``.

    Events count in the order ``(ts, seq)``. The machine has a closed form, so no job's events
    need to be gathered and sorted: a job starts at its first ``running``; its first ``failed`` or
    ``cancelled`` ends it from any state; its first ``completed`` after the start ends it too; the
    earlier end wins and everything later is ignored. Repeated states change nothing. With
    ``jobs`` (``job_id``) every listed job shows and events of unknown jobs are dropped.
    """
    if jobs is not None:
        events = keyed_join(events, jobs, {"job_id": "job_id"}, "left_semi")
    have = [c for c in ("result_ref", "error") if c in events.columns]
    fields = [ts, seq, "status", *have]
    status = F.col("status")

    def at(name: str) -> Column:
        return F.struct(f"{name}.{ts}", f"{name}.{seq}")

    # Only four kinds of event matter; heartbeats collapse to the first one per task.
    marks = events.groupBy("job_id").agg(
        _first(status == RUNNING, fields).alias("run"),
        _first(status.isin("failed", "cancelled"), fields).alias("stop"),
        _first(status == "completed", fields).alias("first_done"),
    )
    # A completion before the start does not count: only such jobs need a second look.
    early = at("first_done") < at("run")
    again = marks.filter(early).select(F.col("job_id").alias("_j"), "run")
    finishing = events.filter(status == "completed").select("job_id", F.struct(*fields).alias("e"))
    later = (
        keyed_join(finishing, again, {"job_id": "_j"}).filter(at("e") > at("run"))
        .groupBy("job_id").agg(F.min("e").alias("later_done"))
    )
    folded = marks.join(later, "job_id", "left").withColumn(
        "done", F.when(F.col("run").isNotNull(),
                       F.when(early, F.col("later_done")).otherwise(F.col("first_done")))
    )
    end = (
        F.when(F.col("stop").isNull(), F.col("done"))
        .when(F.col("done").isNull() | (at("stop") < at("done")), F.col("stop"))
        .otherwise(F.col("done"))
    )
    folded = folded.select("job_id", "run", end.alias("end")).withColumn(
        "ran", F.col("run").isNotNull() & (F.col("end").isNull() | (at("run") < at("end")))
    )
    outcome = [
        F.coalesce(F.col(f"end.{c}"), F.when(F.col("ran"), F.col(f"run.{c}"))).alias(c)
        for c in have
    ]
    state = folded.select(
        "job_id",
        F.when(F.col("end").isNotNull(), F.col("end.status"))
        .when(F.col("ran"), RUNNING).otherwise(QUEUED).alias("status"),
        F.when(F.col("ran"), F.col(f"run.{ts}")).alias("started_at"),
        F.col(f"end.{ts}").alias("finished_at"),
        *outcome,
    )
    if jobs is None:
        return state
    return (
        jobs.join(state, "job_id", "left")
        .withColumn("status", F.coalesce("status", F.lit(QUEUED)))
    )


def last_heartbeats(events: DataFrame, ts: str = "ts") -> DataFrame:
    """``job_id, last_seen, beats`` of running events, for finding stale jobs."""
    return events.filter(F.col("status") == RUNNING).groupBy("job_id").agg(
        F.max(ts).alias("last_seen"), F.count(F.lit(1)).alias("beats")
    )


def pending_messages(messages: DataFrame, states: DataFrame) -> DataFrame:
    """Job messages still to be run: a job that runs or has ended is skipped."""
    known = states.filter(F.col("status") != QUEUED).select("job_id")
    return keyed_join(messages, known, {"job_id": "job_id"}, "left_anti")


def cancellable(requests: DataFrame, states: DataFrame) -> DataFrame:
    """Cancel requests that hit a job which has not ended."""
    live = states.filter(~F.col("status").isin(*TERMINAL)).select("job_id")
    return keyed_join(requests, live, {"job_id": "job_id"}, "left_semi")


def recent_jobs(jobs: DataFrame, limit: int = RECENT) -> DataFrame:
    """The newest jobs of every user with their ``rank``."""
    return first_rows(jobs, ["user_id"], ["created_at", "id"], limit, descending=True)


def result_path(user_id: Column, kind: Column, job_id: Column) -> Column:
    """``results/<user>/<prefix>/<job>.json``; null for an unknown kind."""
    prefix = F.create_map(*[F.lit(x) for pair in RESULT_PREFIX.items() for x in pair])
    return F.concat(
        F.lit("results/"), user_id.cast("string"), F.lit("/"), F.try_element_at(prefix, kind),
        F.lit("/"), job_id.cast("string"), F.lit(".json"),
    )


def fold_requests(updates: DataFrame, ts: str = "ts", seq: str = "event_id") -> DataFrame:
    """State of each format request: ``request_id, status, issue, resolved_at``.

    Any transition is allowed; the latest status and the latest issue number that is given win;
    the resolution time is that of the latest closing update.
    """
    order = F.struct(ts, seq)
    closing = F.col("status").isin(*CLOSED_STATES)
    return updates.groupBy("request_id").agg(
        F.max_by("status", order).alias("status"),
        F.max_by("issue", F.when(F.col("issue").isNotNull(), order)).alias("issue"),
        F.max(F.when(closing, F.col(ts))).alias("resolved_at"),
    )


def open_requests(requests: DataFrame) -> DataFrame:
    """Requests still open, most urgent first, older before newer."""
    return requests.filter(F.col("status").isin(*OPEN_STATES)).orderBy(
        F.col("priority").desc(), F.col("created_at").asc()
    )
