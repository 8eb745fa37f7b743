import datetime as dt
import io
import json
import random
import struct

import pandas as pd
import pytest
from pyspark.serializers import CPickleSerializer
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessorHandle
from pyspark.sql.streaming.proto import StateMessage_pb2
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.streaming.stateful_processor_api_client import StatefulProcessorApiClient
from test_usage import EVENT_DDL, JOB, U, random_job_events, run_machine

from tabsift.functions.contracts import split_messages
from tabsift.streaming import streams
from tabsift.usage.tiers import TierLimits

DAY = dt.datetime(2026, 5, 1)
DDL = "event_id long, user_id string, ts timestamp, path string, ip string, size_bytes long"


@pytest.fixture
def feed(spark, tmp_path):
    """Writes files one after the other; each run picks up what is new."""
    class Feed:
        path, made = str(tmp_path / "in"), 0

        def add(self, rows, ddl):
            self.made += 1
            df = spark.createDataFrame(rows, ddl).coalesce(1)
            df.write.mode("append").json(self.path)

        def stream(self, ddl):
            return streams.file_stream(spark, self.path, ddl)

    return Feed()


def at(seconds):
    return DAY + dt.timedelta(seconds=seconds)


def test_counters_over_two_runs(spark, feed, tmp_path):
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        counted = streams.ops_per_day(feed.stream(DDL))
        streams.run_batches(counted, streams.change_sink(sink), checkpoint)

    feed.add([(i, "ann", at(i), "/x", "1", 1) for i in range(3)], DDL)
    run()
    feed.add([(9, "ann", at(60), "/x", "1", 1), (10, "bob", at(90000), "/x", "1", 1)], DDL)
    run()
    changes = spark.read.parquet(f"{sink}/b*")
    last = changes.groupBy("user_id", "day").agg(F.max_by("ops", "batch").alias("ops"))
    assert {(r.user_id, str(r.day)): r.ops for r in last.collect()} == {
        ("ann", "2026-05-01"): 4, ("bob", "2026-05-02"): 1}


def test_first_within_over_two_runs(spark, feed, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        first = streams.first_within(feed.stream(DDL), ["user_id"])
        streams.run_available(first, out, checkpoint)

    feed.add([(1, "ann", at(0), "/x", "1", 1), (2, "bob", at(5), "/x", "1", 1)], DDL)
    run()
    feed.add([(3, "ann", at(7), "/x", "1", 1), (4, "cat", at(8), "/x", "1", 1)], DDL)
    run()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 4]


def test_job_states_over_two_runs_equal_the_machine(spark, feed, tmp_path):
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    events = random_job_events(3, 40)
    ordered = {j: sorted(es, key=lambda e: e[:2]) for j, es in events.items()}

    def run():
        states = streams.job_states(feed.stream(EVENT_DDL.replace("timestamp_ntz", "timestamp")))
        streams.run_batches(states, streams.change_sink(sink), checkpoint)

    ddl = EVENT_DDL.replace("timestamp_ntz", "timestamp")
    feed.add([(j, *e) for j, es in ordered.items() for e in es[:3]], ddl)
    run()
    feed.add([(j, *e) for j, es in ordered.items() for e in es[3:]] or [], ddl)
    run()
    states = streams.latest_states(spark.read.parquet(f"{sink}/b*"))
    got = {r.job_id: r for r in states.collect()}
    for job, es in events.items():
        want = run_machine(es)
        if want["status"] == "queued":
            assert job not in got
            continue
        assert {k: got[job][k] for k in want} == want


EVENTS = "job_id string, status string, ts timestamp, event_id long, result_ref string, error string"


def event(job, status, seconds, i=0):
    return job, status, at(seconds), i, None, None


def test_the_state_of_a_finished_job_goes_away(spark, feed, tmp_path):
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        states = streams.job_states(feed.stream(EVENTS), late="1 minute", kept=pd.Timedelta(hours=1))
        streams.run_batches(states, streams.change_sink(sink), checkpoint)
        held = spark.read.format("statestore").option("stateVarName", "job").load(checkpoint)
        return sorted(r[0] for r in held.select("key.job_id").collect())

    feed.add([event("a", "running", 0), event("a", "completed", 9, 1), event("b", "running", 5), event("c", "beat", 5)], EVENTS)
    assert run() == ["a", "b"]
    # Two hours later a has gone; b has ticked meanwhile.
    feed.add([event("b", "running", 7000), event("d", "running", 7200)], EVENTS)
    assert run() == ["b", "d"]
    last = streams.latest_states(spark.read.parquet(f"{sink}/b*"))
    assert {r.job_id: r.status for r in last.collect()} == {"a": "completed", "b": "running", "d": "running"}


def test_jobs_end_when_they_have_been_silent_for_long_enough(spark, feed, tmp_path):
    """Ends that move within a period and to others, jobs that start again, one without an id."""
    sink, checkpoint, seed = str(tmp_path / "out"), str(tmp_path / "cp"), random.Random(5)
    kept, late, number, last, status = 480, 60, 2, {}, {}
    for since, until in ((0, 300), (300, 500), (500, 900), (900, 1000), (1000, 1900)):
        rows = [event(seed.choice([*"abcdefghijkl", None]), seed.choice(["running", "running", "failed", "beat"]), s, i)
                for i, s in enumerate(range(since + 1, until + 1, 9), number)]
        # The watermark comes to 500 and 900 s, where v and w end.
        rows += [event("y", "beat", until + late, number - 1)]
        rows += [event(j, "running", s, number - 2) for j, s in (("v", 20), ("w", 420)) if since < s <= until]
        number += len(rows)
        for job, told, ts, *_ in sorted(rows, key=lambda r: r[2]):
            seconds, before = (ts - DAY).total_seconds(), status.get(job)
            if before in (None, "running") and told in ("running", "failed"):
                status[job] = told
            if job in status:
                last[job] = seconds
        feed.add(rows, EVENTS)
        states = streams.job_states(feed.stream(EVENTS), late=f"{late} seconds", kept=pd.Timedelta(seconds=kept))
        streams.run_batches(states, streams.change_sink(sink), checkpoint)
        for job in [j for j, seconds in last.items() if seconds + kept <= until]:
            del last[job], status[job]
        held = spark.read.format("statestore").option("stateVarName", "job").load(checkpoint)
        got = {r.job_id: r.status for r in held.select("key.job_id", "value.status").collect()}
        assert got == status, (since, until)
        assert held.count() == len(status)


class EmptyStore:
    """The far end of a line to the state store; it counts how often it is waited for."""

    def __init__(self):
        self.waits, self.calls, self.heard, self.said = 0, 0, b"", io.BytesIO()

    def write(self, data):
        self.heard += bytes(data)

    def flush(self):
        line, self.heard, said = io.BytesIO(self.heard), b"", self.said.read()
        self.waits += 1
        while line.read(4):
            call = StateMessage_pb2.StateRequest.FromString(line.read(*struct.unpack(">i", line.read(4))))
            answer = StateMessage_pb2.StateResponse(statusCode=2 if "exists" in str(call) else 0).SerializeToString()
            said += struct.pack(">i", len(answer)) + answer
            self.calls += 1
        self.said = io.BytesIO(said)

    def read(self, size):
        return self.said.read(size)


def test_many_jobs_wait_for_the_state_store_a_few_times(spark):
    store, client = EmptyStore(), StatefulProcessorApiClient.__new__(StatefulProcessorApiClient)
    client.key_schema, client.sockfile = T.StructType.fromDDL("jobs int, period long, job_id string"), store
    client.utf8_deserializer, client.pickleSer = None, CPickleSerializer()
    machine = streams._JobMachine(1000)
    machine.init(StatefulProcessorHandle(client))
    told = Row("jobs", "period", "job_id", "job", "status", "ts", "at", "event_id", "result_ref", "error")
    rows = [told(0, None, None, f"j{i}", "running", at(i), i * 10**6, i, None, None) for i in range(1000)]
    changes = list(machine.handleInputRows((0, None, None), iter(rows), TimerValues(-1, 0)))
    assert [c.job_id for c in changes] == [f"j{i}" for i in range(1000)]
    assert store.calls > 2000 and store.waits < 100, (store.calls, store.waits)


def test_silent_jobs_are_told_once(spark, feed, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stale = streams.stale_jobs(feed.stream(EVENTS), pd.Timedelta(minutes=10), late="1 minute")
        streams.run_available(stale, out, checkpoint)
        return sorted((r.job_id, r.last_seen) for r in spark.read.parquet(out).collect())

    feed.add([event("a", "running", 0), event("b", "running", 0), event("c", "running", 0), event("c", "failed", 3),
              event("q", "queued", 0)], EVENTS)
    assert run() == []
    feed.add([event("b", "running", 500), event("x", "running", 700)], EVENTS)
    assert run() == [("a", at(0))]
    feed.add([event("a", "running", 800), event("x", "running", 1300)], EVENTS)
    assert run() == [("a", at(0)), ("b", at(500))]
    feed.add([event("x", "running", 2000)], EVENTS)
    assert run() == [("a", at(0)), ("a", at(800)), ("b", at(500))]


def test_a_busy_group_of_jobs_is_kept_by_few_calls(spark, feed, tmp_path, monkeypatch):
    """Jobs of one group, over two runs, each judged for itself."""
    monkeypatch.setattr(streams, "TICK_GROUPS", 1)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        stale = streams.stale_jobs(feed.stream(EVENTS), pd.Timedelta(minutes=10), late="1 minute")
        streams.run_available(stale, out, checkpoint)
        return sorted((r.job_id, r.last_seen) for r in spark.read.parquet(out).collect())

    feed.add([event(f"j{i}", "running", i) for i in range(300)] + [event("j7", "cancelled", 9)], EVENTS)
    assert run() == []
    # The watermark comes to 799 s: j0 to j199 are overdue, but for the cancelled one and one that ticked.
    feed.add([event("j8", "running", 500), event("x", "queued", 859)], EVENTS)
    assert run() == sorted((f"j{i}", at(i)) for i in range(200) if i not in (7, 8))


def test_events_without_a_time_change_no_order(spark, feed, tmp_path):
    sink = str(tmp_path / "out")
    late = ("a", "running", None, 2, None, None)
    feed.add([event("a", "running", 0), late, event("a", "completed", 9, 1), ("b", "running", None, 1, None, None)], EVENTS)
    states = streams.job_states(feed.stream(EVENTS))
    assert "transformWithStateInPandas" not in states._jdf.queryExecution().logical().toString()
    streams.run_batches(states, streams.change_sink(sink), str(tmp_path / "cp"))
    row, = streams.latest_states(spark.read.parquet(f"{sink}/b*")).collect()
    assert (row.job_id, row.status, row.started_at, row.finished_at) == ("a", "completed", at(0), at(9))


def test_filtered_messages_are_parsed_once(spark):
    split = split_messages(spark.createDataFrame([(JOB,), ("nothing",)], "value string"), "value", "jobs")
    bad = split.filter(F.col("message").isNull()).select(F.size("errors").alias("n"))
    assert [r.n for r in bad.collect()] == [1]
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") <= 2, plan


def test_results_reach_known_jobs_in_time(spark, tmp_path):
    jobs_path, results_path = str(tmp_path / "jobs"), str(tmp_path / "results")
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    job_ddl, result_ddl = "job_id string, created_at timestamp", "job_id string, status string, ts timestamp, result_ref string, error string"

    def add(path, rows, ddl):
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").json(path)

    def result(job, seconds):
        return job, "completed", at(seconds), f"r{seconds}", None

    def run():
        joined = streams.applied_results(
            streams.file_stream(spark, jobs_path, job_ddl), streams.file_stream(spark, results_path, result_ddl),
            within="1 hour", late="1 minute", unanswered=True)
        streams.run_available(joined, out, checkpoint)
        return sorted((r.job_id, r.result_ref or "") for r in spark.read.parquet(out).collect())

    add(jobs_path, [("a", at(100)), ("b", at(100)), ("c", at(100))], job_ddl)
    # One of an unknown job, one before its job, one after its time.
    add(results_path, [result("a", 150), result("z", 150), result("b", 50), result("c", 3800)], result_ddl)
    assert run() == [("a", "r150")]
    add(jobs_path, [("d", at(9000))], job_ddl)
    add(results_path, [result("d", 9001)], result_ddl)
    assert run() == [("a", "r150"), ("b", ""), ("c", ""), ("d", "r9001")]
    # Behind the watermark on either side.
    add(jobs_path, [("e", at(200))], job_ddl)
    add(results_path, [result("b", 300), result("e", 300)], result_ddl)
    assert run() == [("a", "r150"), ("b", ""), ("c", ""), ("d", "r9001")]


def test_good_and_bad_messages(spark, feed, tmp_path):
    feed.add([(JOB,), ("neither here nor there",), ('{"job_id":"job seven"}',)], "value string")
    split = split_messages(feed.stream("value string"), "value", "jobs")
    out = split.select(F.col("message.kind").alias("kind"), F.size("errors").alias("n"))
    streams.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).fillna("").collect())
    assert got == [("", 1), ("", 7), ("convert", 0)]


def test_routing(spark, feed, tmp_path):
    other = U.replace("123e", "999e")
    feed.add([(JOB,), (JOB.replace(f'"user_id":"{U}"', f'"user_id":"{other}"'),)], "value string")
    known = spark.createDataFrame([(U, "paid")], "user_id string, tier string")
    routed = streams.route_jobs(feed.stream("value string"), known)
    streams.run_available(routed, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r.key: r.topic for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {U: "topic.v1.jobs.paid", other: "topic.v1.jobs.free"}


def test_limits(spark, feed, tmp_path):
    rows = [(i, "ann", at(i), "/api/v1/auth/login", "1.1.1.1", 0) for i in range(4)]
    rows += [(10 + i, "bob", at(i), "/api/v1/uploads", "2.2.2.2", (4 + i) << 20) for i in range(4)]
    feed.add(rows, DDL)
    known = spark.createDataFrame([("ann", "paid")], "user_id string, tier string")

    def changes(stream, name):
        sink = str(tmp_path / name)
        streams.run_batches(stream, streams.change_sink(sink), str(tmp_path / f"{name}-cp"))
        return spark.read.parquet(f"{sink}/b*").collect()

    rate, = changes(streams.ip_rate(feed.stream(DDL), 3), "rate")
    assert (rate.ip, rate.requests, rate.limited) == ("1.1.1.1", 4, True)
    over, = changes(streams.quota_overruns(feed.stream(DDL), known, TierLimits(free_daily_ops=3)), "quota")
    assert (over.user_id, over.ops, over.cap) == ("bob", 4, 3)
    sizes = streams.size_rejects(feed.stream(DDL), known)
    streams.run_available(sizes.select("event_id"), str(tmp_path / "s"), str(tmp_path / "s-cp"))
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "s")).collect()) == [12, 13]


def test_quarantine(spark, feed, tmp_path):
    feed.add([("p", at(60 * m)) for m in (0, 2, 4)] + [("q", at(0))], "plugin_id string, ts timestamp")
    sink = str(tmp_path / "out")
    stream = streams.quarantined(feed.stream("plugin_id string, ts timestamp"))
    streams.run_batches(stream, streams.change_sink(sink), str(tmp_path / "cp"))
    assert {r.plugin_id for r in spark.read.parquet(f"{sink}/b*").collect()} == {"p"}


def test_audit_stream(spark, feed, tmp_path):
    def message(n, when):
        return json.dumps({"event_id": U[:-1] + str(n), "action": "login", "trace_id": "t",
                           "occurred_at": when, "metadata": {"n": n}})

    feed.add([(message(1, "2026-04-30T23:00:00Z"),), (message(2, "2026-05-01T00:00:00Z"),),
              (message(1, "2026-04-30T23:00:00Z"),), ("{}",)], "value string")
    out = str(tmp_path / "log")
    log = streams.audit_log(feed.stream("value string"))
    streams.run_available(log, out, str(tmp_path / "cp"), partition_by=["month"])
    got = spark.read.parquet(out).groupBy(F.col("month").cast("string").alias("m")).count().collect()
    assert {r.m: r["count"] for r in got} == {"2026_04": 1, "2026_05": 1}


def test_late_rows_are_counted(spark, feed, tmp_path):
    sink, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        counted = streams.ops_per_day(feed.stream(DDL))
        return streams.run_batches(counted, streams.change_sink(sink), checkpoint)

    feed.add([(1, "ann", at(0), "/x", "1", 1), (2, "ann", at(500_000), "/x", "1", 1)], DDL)
    assert streams.late_rows(run()) == 0
    feed.add([(3, "ann", at(10), "/x", "1", 1)], DDL)
    assert streams.late_rows(run()) == 1
