"""Queries: the streaming twins run to the end over the event table, then read back.

Update-mode queries store each micro-batch's changes; the last change per key is the state.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tabsift.catalog.base import (
    SQL_JOB_EVENTS, SQL_REQUESTS, SQL_TIERS, job_events, query, requests, table,
)
from tabsift.catalog.usage import (
    _FOLD, _LOW, SQL_REQUEST_FOLD, _tiers, job_messages, request_updates, shown_states,
)
from tabsift.functions.contracts import split_messages
from tabsift.session import scratch_path
from tabsift.streaming import streams
from tabsift.usage import jobs

def _event_stream(spark, sf_dir):
    batch = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir.rstrip('/')}/events*.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _changes(spark, stream, label):
    """Run an update-mode query to the end and return its table of changes."""
    path = scratch_path(spark, label)
    streams.run_batches(stream, streams.change_sink(path), scratch_path(spark, f"{label}-cp"))
    return spark.read.parquet(f"{path}/b*")


def _rows(spark, stream, label, partition_by=None):
    path = scratch_path(spark, label)
    streams.run_available(stream, path, scratch_path(spark, f"{label}-cp"), "append", partition_by)
    return spark.read.parquet(path)


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS ops FROM events GROUP BY ALL""")
def stream_ops_per_day(spark, sf_dir):
    seen = _changes(spark, streams.ops_per_day(_event_stream(spark, sf_dir)), "ops")
    last = seen.groupBy("user_id", "day").agg(F.max_by("ops", "batch").alias("ops"))
    return last.withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {SQL_TIERS}, d AS (
  SELECT user_id, ts::DATE AS day, count(*) AS ops FROM events GROUP BY ALL)
SELECT d.user_id, strftime(day, '%Y-%m-%d') AS day, ops FROM d LEFT JOIN tiers USING (user_id)
WHERE coalesce(tier, 'free') = 'free' AND ops > 2""")
def stream_quota_overruns(spark, sf_dir):
    over = streams.quota_overruns(_event_stream(spark, sf_dir), _tiers(spark, sf_dir), _LOW)
    seen = _changes(spark, over, "quota")
    last = seen.groupBy("user_id", "day").agg(F.max_by("ops", "batch").alias("ops"))
    return last.withColumn("day", F.col("day").cast("string"))


@query(f"""WITH {SQL_REQUESTS} SELECT ip, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M')
    AS minute, count(*) AS requests, count(*) > 1 AS limited
FROM requests WHERE starts_with(path, '/api/v1/auth/signup') GROUP BY 1, 2""")
def stream_ip_rate(spark, sf_dir):
    stream = requests(_event_stream(spark, sf_dir))
    seen = _changes(spark, streams.ip_rate(stream, per_minute=1), "rate")
    last = seen.groupBy("ip", "minute").agg(
        F.max_by(F.struct("requests", "limited"), "batch").alias("s")
    )
    return last.select("ip", F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "s.*")


@query(f"""WITH {SQL_TIERS}, {SQL_REQUESTS}, s AS (SELECT event_id, size_bytes,
  coalesce(tier, 'free') AS tier FROM requests r LEFT JOIN tiers USING (user_id)
  WHERE starts_with(path, '/api/v1/uploads'))
SELECT event_id, tier FROM s WHERE size_bytes > CASE WHEN tier = 'paid' THEN 50 ELSE 5 END * 1048576""")
def stream_size_rejects(spark, sf_dir):
    stream = requests(_event_stream(spark, sf_dir))
    out = streams.size_rejects(stream, _tiers(spark, sf_dir), _LOW)
    return _rows(spark, out.select("event_id", "tier"), "size")


@query("""SELECT user_id, event_type FROM events GROUP BY ALL""")
def stream_first_within(spark, sf_dir):
    stream = _event_stream(spark, sf_dir)
    first = streams.first_within(stream, ["user_id", "event_type"], lifetime="60 days")
    return _rows(spark, first.select("user_id", "event_type"), "first")


@query("""WITH w AS (SELECT event_type AS plugin_id, ts,
  unnest(generate_series(0, 4)) AS back FROM events),
s AS (SELECT plugin_id, date_trunc('minute', ts) - back * INTERVAL 1 MINUTE AS start FROM w)
SELECT plugin_id, count(*) AS failures, epoch_us(start + INTERVAL 5 MINUTE) AS quarantined_from
FROM s GROUP BY plugin_id, start HAVING count(*) >= 3""")
def stream_quarantine(spark, sf_dir):
    failures = _event_stream(spark, sf_dir).withColumnRenamed("event_type", "plugin_id")
    seen = _changes(spark, streams.quarantined(failures), "quarantine")
    last = seen.groupBy("plugin_id", "quarantined_from").agg(
        F.max_by("failures", "batch").alias("failures")
    )
    return last.withColumn("quarantined_from", F.unix_micros("quarantined_from"))


@query(_FOLD)
def stream_job_states(spark, sf_dir):
    seen = _changes(spark, streams.job_states(job_events(_event_stream(spark, sf_dir))), "jobs")
    states = streams.latest_states(seen)
    # A job whose events changed nothing is still queued and has no change row.
    known = job_events(table(spark, sf_dir, "events")).select("job_id").distinct()
    full = known.join(states, "job_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("queued"))
    )
    return shown_states(full)


@query("""WITH {events}, last AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT job_id, epoch_us(max(ts) FILTER (status = 'running')) AS last_seen FROM job_events, last
GROUP BY job_id, mark HAVING count(*) FILTER (status IN ('completed', 'failed', 'cancelled')) = 0
  AND max(ts) FILTER (status = 'running') + INTERVAL 1 HOUR <= mark""".replace("{events}", SQL_JOB_EVENTS))
def stream_stale_jobs(spark, sf_dir):
    """Running jobs whose ticks have stopped, told by timers."""
    events = job_events(_event_stream(spark, sf_dir))
    rows = _rows(spark, streams.stale_jobs(events, pd.Timedelta(hours=1)), "stale")
    return rows.select("job_id", F.unix_micros("last_seen").alias("last_seen"))


@query("""SELECT j.event_id AS id, r.event_id AS result, r.event_type AS status
FROM events j JOIN events r ON j.user_id = r.user_id AND j.event_type = 'signup'
  AND r.event_type IN ('view', 'error') AND r.ts >= j.ts AND r.ts <= j.ts + INTERVAL 6 HOUR""")
def stream_applied_results(spark, sf_dir):
    """Results joined to the jobs they reach, both as streams."""
    jobs_in = _event_stream(spark, sf_dir).filter(F.col("event_type") == "signup").select(
        F.col("user_id").alias("job_id"), F.col("ts").alias("created_at"), F.col("event_id").alias("id"))
    results = _event_stream(spark, sf_dir).filter(F.col("event_type").isin("view", "error")).select(
        F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), "ts",
        F.col("event_id").alias("result_ref"), F.lit(None).cast("string").alias("error"))
    out = streams.applied_results(jobs_in, results, within="6 hours")
    return _rows(spark, out, "applied").select("id", F.col("result_ref").alias("result"), "status")


@query("""SELECT event_id, CASE WHEN value < 0.5 OR event_type IN ('signup', 'view') THEN 1
       WHEN event_type = 'error' THEN 2 END::BIGINT AS problems
FROM events WHERE NOT (value >= 0.5 AND event_type IN ('click', 'purchase'))""")
def stream_dead_letters(spark, sf_dir):
    """Messages that break their contract, with what is wrong."""
    split = split_messages(_messages(spark, sf_dir), "value", "jobs")
    out = split.filter(F.col("message").isNull()).select("event_id", F.size("errors").cast("bigint").alias("problems"))
    return _rows(spark, out, "dead")


@query(SQL_REQUEST_FOLD)
def stream_request_fold(spark, sf_dir):
    """The request fold is a plain aggregate, so it runs on a stream as it is."""
    folded = jobs.fold_requests(request_updates(_event_stream(spark, sf_dir)))
    seen = _changes(spark, folded, "requests")
    last = seen.groupBy("request_id").agg(
        F.max_by(F.struct("status", "issue", "resolved_at"), "batch").alias("s")
    )
    return last.select("request_id", "s.status", "s.issue", F.unix_micros("s.resolved_at")
                       .alias("resolved_at"))


def _messages(spark, sf_dir):
    return job_messages(_event_stream(spark, sf_dir))


@query("""SELECT event_id, value >= 0.5 AND event_type IN ('click', 'purchase') AS good,
  CASE WHEN value < 0.5 OR event_type IN ('signup', 'view') THEN 1
       WHEN event_type = 'error' THEN 2 ELSE 0 END::BIGINT AS problems FROM events""")
def stream_validation(spark, sf_dir):
    split = split_messages(_messages(spark, sf_dir), "value", "jobs")
    out = split.select(
        "event_id", F.col("message").isNotNull().alias("good"),
        F.size("errors").cast("bigint").alias("problems"),
    )
    return _rows(spark, out, "valid")


@query(f"""WITH {SQL_TIERS} SELECT event_id, CASE WHEN coalesce(tier, 'free') = 'paid'
  THEN 'topic.v1.jobs.paid' ELSE 'topic.v1.jobs.free' END AS topic, user_id
FROM events LEFT JOIN tiers USING (user_id) WHERE value >= 0.5""")
def stream_routing(spark, sf_dir):
    uid = F.format_string("00000000-0000-0000-0001-%012d", "user_id")
    known = _tiers(spark, sf_dir).withColumn("user_id", uid)
    stream = _messages(spark, sf_dir).filter(F.col("value").startswith("{"))
    routed = streams.route_jobs(stream.select("value"), known)
    rows = _rows(spark, routed, "route")
    tail = F.regexp_extract
    return rows.select(
        tail(F.get_json_object("value", "$.job_id"), r"-0*(\d+)$", 1).cast("bigint").alias("event_id"),
        "topic", tail("key", r"-0*(\d+)$", 1).cast("bigint").alias("user_id"),
    )


@query("""SELECT strftime(ts, '%Y_%m') AS month, event_type AS action, count(*) AS events
FROM events WHERE value >= 0.5 GROUP BY ALL""")
def stream_audit(spark, sf_dir):
    stream = _event_stream(spark, sf_dir)
    uid = F.format_string("00000000-0000-0000-0000-%012d", "event_id")
    body = F.to_json(F.struct(
        uid.alias("event_id"), F.col("event_type").alias("action"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("occurred_at"),
        F.lit("t").alias("trace_id"),
        F.struct("value").alias("metadata"),
    ))
    # Every message arrives twice and some are broken.
    value = F.when(F.col("value") < 0.5, F.lit("{")).otherwise(body)
    messages = stream.select(F.explode(F.array(value, value)).alias("value"))
    log = _rows(spark, streams.audit_log(messages, lifetime="60 days"), "audit", ["month"])
    return log.groupBy(F.col("month").cast("string").alias("month"), "action").agg(
        F.count(F.lit(1)).alias("events")
    )
