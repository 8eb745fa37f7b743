import datetime as dt
import random

import pytest
from conftest import ids
from pyspark.sql import functions as F

from tabsift.functions.contracts import check_messages, dead_letters, valid_messages
from tabsift.operators import ranking
from tabsift.operators.quantiles import exact_quantiles
from tabsift.operators.ranking import claims, first_rows, first_wins, rows_beyond
from tabsift.usage import audit, jobs, quota, retention, tiers
from tabsift.usage.tiers import TierLimits

NOW = dt.datetime(2026, 6, 1, 12)


def ago(**delta):
    return NOW - dt.timedelta(**delta)


def now():
    return F.lit(NOW.isoformat(sep=" ")).cast("timestamp_ntz")


# ---- tiers ---------------------------------------------------------------------------------

@pytest.fixture
def subscriptions(spark):
    return spark.createDataFrame(
        [(1, "ann", "paid", "active", ago(days=9), None),
         (2, "bob", "paid", "active", ago(days=40), ago(days=10)),
         (3, "cat", "paid", "active", ago(days=40), None),
         (4, "cat", "free", "active", ago(days=3), None),
         (5, "dan", "paid", "cancelled", ago(days=3), None),
         (6, "eve", "paid", "active", ago(days=3), NOW + dt.timedelta(days=1)),
         (7, "fay", "paid", "active", ago(days=9), None),
         (8, "fay", "paid", "active", ago(days=3), ago(days=1))],
        "id long, user_id string, tier string, status string, started_at timestamp_ntz, "
        "expires_at timestamp_ntz",
    )


def test_effective_tiers(spark, subscriptions):
    users = spark.createDataFrame([(u,) for u in "ann bob cat dan eve fay gil".split()], "user_id string")
    got = dict(tiers.with_tier(users, tiers.effective_tiers(subscriptions, now())).collect())
    assert got == {"ann": "paid", "bob": "free", "cat": "free", "dan": "free", "eve": "paid",
                   "fay": "free", "gil": "free"}
    assert ids(tiers.users_without_subscription(users, subscriptions), "user_id") == ["dan", "gil"]


def test_feature_gate(spark, subscriptions):
    registry = spark.createDataFrame(
        [("ai-auto-summary", "1.9.0", "enabled", "free"), ("ai-auto-summary", "1.10.0", "enabled", "paid"),
         ("ai-auto-summary", "2.0.0", "disabled", "free"), ("recipe-crud", "1.0.0", "enabled", "paid")],
        "plugin_id string, version string, status string, required_tier string",
    )
    calls = spark.createDataFrame(
        [(1, "ann", "/api/v1/ai/summary/x", "POST"), (2, "bob", "/api/v1/ai/summary", "POST"),
         (3, "bob", "/api/v1/detect", "POST"), (4, "bob", "/api/v1/format-requests", "POST"),
         (5, "bob", "/api/v1/recipes", "GET")],
        "id long, user_id string, path string, method string",
    ).withColumn("plugin_id", tiers.feature_of(F.col("path"), F.col("method")))
    out = tiers.feature_gate(calls, registry, tiers.effective_tiers(subscriptions, now()))
    assert ids(out.filter("not allowed")) == [2, 5]
    assert {r.id: r.plugin_id for r in out.collect()}[4] == "format-request-submit"


def test_owned(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "id long, user_id string")
    asked = spark.createDataFrame([(1, "b"), (2, "b"), (2, "b")], "id long, user_id string")
    assert ids(tiers.owned(items, asked)) == [2]


# ---- ranking ---------------------------------------------------------------------------------

def skewed(spark, n=4000):
    """One key holds most rows; many rows share a time."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.6 else f"k{rng.randrange(40)}", rng.randrange(200), i)
            for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, t long, id long").repartition(6)


@pytest.mark.parametrize("limit", [1, 3, 100])
def test_rows_beyond_a_limit(spark, limit):
    rows, df = skewed(spark)
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r[2])
    assert ids(rows_beyond(df, ["k"], ["t", "id"], limit)) == \
        sorted(i for g in groups.values() for i in g[limit:])
    first = {(r.k, r["rank"]): r.id for r in first_rows(df, ["k"], ["t", "id"], limit).collect()}
    assert first == {(k, n + 1): i for k, g in groups.items() for n, i in enumerate(g[:limit])}


def test_rank_limit_runs_before_the_shuffle(spark):
    _, df = skewed(spark, 50)
    plan = first_rows(df, ["k"], ["t", "id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("row_number(), 3, Partial") == 2


def test_hot_keys_of_joins_are_split(spark):
    """With the thresholds of a small table, the adaptive plan splits the hot key."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    rows, df = skewed(spark, 40_000)
    saves = spark.createDataFrame(
        [(i, f"k{i % 40}" if i else "hot", "paid", "active", NOW, None) for i in range(900)],
        "id long, user_id string, tier string, status string, started_at timestamp_ntz, "
        "expires_at timestamp_ntz",
    )
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = tiers.with_tier(df, tiers.effective_tiers(saves, now()), "k")
        beyond = rows_beyond(df, ["k"], ["t", "id"], 50)
        middle = exact_quantiles(df, ["k"], {"t": F.col("t")}, [0.5], 200, small_input=0)
        for out in (joined, beyond, middle):
            out.collect()
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin(skew=true)" in plan
        assert joined.filter("tier = 'paid'").count() == len(rows)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_first_wins(spark):
    rows, df = skewed(spark)
    want = {}
    for k, t, i in rows:
        want[k] = min(want.get(k, (t, i)), (t, i))
    got = {r.k: (r.t, r.id) for r in first_wins(df, ["k"], ["t", "id"]).collect()}
    assert got == want


def test_claims_restart_after_the_lifetime(spark):
    rows, df = skewed(spark, 600)
    want = []
    for key in {r[0] for r in rows}:
        free = None
        for _, t, i in sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2])):
            if free is None or t >= free:
                want.append(i)
                free = t + 60
    assert ids(claims(df, ["k"], "t", "id", F.lit(60))) == sorted(want)


def test_claims_of_many_lifetimes_take_few_rounds(spark, monkeypatch):
    rounds = []
    keep = ranking.reliable_checkpoint
    monkeypatch.setattr(ranking, "reliable_checkpoint", lambda df: rounds.append(1) or keep(df))
    r = random.Random(3)
    rows = [("a", t, i) for i, t in enumerate(r.choices(range(3000), k=900))]
    rows += [(None, 5, 1000), (None, 15, 1001), (None, 14, 1002), ("once", 1, 1003), ("once", 1, 1004)]
    want = []
    for key in {x[0] for x in rows}:
        free = None
        for _, t, i in sorted((x for x in rows if x[0] == key), key=lambda x: x[1:]):
            if free is None or t >= free:
                want.append(i)
                free = t + 10
    df = spark.createDataFrame(rows, "k string, t long, id long")
    assert ids(claims(df, ["k"], "t", "id", F.lit(10))) == sorted(want)
    # Some 280 winners of one key: nine doublings, three tables each.
    assert len(want) > 200 and len(rounds) <= 3 * 10 + 3


# ---- quota -----------------------------------------------------------------------------------

@pytest.fixture
def requests(spark):
    day = dt.datetime(2026, 5, 1, 23, 59, 50)
    rows = [(i, "ann", day + dt.timedelta(seconds=i), "/api/v1/uploads/x", "1.1.1.1", 6 << 20)
            for i in range(20)]
    rows += [(100 + i, "bob", day + dt.timedelta(seconds=i), "/api/v1/auth/login", "2.2.2.2", 6 << 20)
             for i in range(20)]
    rows += [(200 + i, "bob", day, "/api/v1/uploads/y", "2.2.2.2", (6 << 20) + i) for i in range(3)]
    rows.append((300, None, day, "/api/v1/uploads/z", "3.3.3.3", 9 << 20))
    return spark.createDataFrame(
        rows, "event_id long, user_id string, ts timestamp_ntz, path string, ip string, size_bytes long"
    )


def test_quota(spark, requests, subscriptions):
    known = tiers.effective_tiers(subscriptions, now())
    limits = TierLimits(free_daily_ops=2)
    used = quota.counted_requests(requests)
    assert ids(quota.quota_rejects(used, known, limits), "event_id") == [202]
    both = TierLimits(free_daily_ops=2, paid_daily_ops=7)
    assert ids(quota.quota_rejects(used, known, both), "event_id") == [7, 8, 9, 17, 18, 19, 202]
    daily = {(r.user_id, str(r.day)): r.rejected for r in quota.daily_quota(used, known, both).collect()}
    assert daily == {("ann", "2026-05-01"): 3, ("ann", "2026-05-02"): 3, ("bob", "2026-05-01"): 1}
    last = quota.quota_rejects(used, known, limits).first()
    assert (last.cap, last.tier, last.retry_after) == (2, "free", 10)
    assert quota.quota_rejects(used, known, TierLimits(free_daily_ops=0)).count() == 0


def test_rates_and_sizes(requests, subscriptions):
    rate = {(r.ip, r.minute.minute): (r.requests, r.limited) for r in quota.ip_rate(requests, 9).collect()}
    assert rate == {("2.2.2.2", 59): (10, True), ("2.2.2.2", 0): (10, True)}
    assert ids(quota.ip_rejects(requests, 9), "event_id") == [109, 119]
    known = tiers.effective_tiers(subscriptions, now())
    assert ids(quota.size_rejects(requests, known, TierLimits(free_upload_mb=6)), "event_id") == [201, 202]
    assert quota.size_rejects(requests, known, TierLimits(0, 0, 0, 0)).count() == 0


def test_usage_view(spark, requests, subscriptions):
    users = spark.createDataFrame([("ann",), ("bob",), ("zed",)], "user_id string")
    day = F.lit("2026-05-01").cast("date")
    out = quota.usage_view(users, tiers.effective_tiers(subscriptions, now()), requests, day)
    got = {r.user_id: r for r in out.collect()}
    assert (got["ann"].ops_today, got["ann"].ops_unlimited, got["ann"].upgrade_hint) == (10, True, None)
    assert (got["zed"].ops_today, got["zed"].ops_limit, got["zed"].max_upload_mb) == (0, 100, 5)


def test_client_address(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "9"), ("", "9"), (None, "9"), ("7.7.7.7", "9")],
                               "f string, r string")
    got = [r[0] for r in df.select(quota.client_ip(F.col("f"), F.col("r"))).collect()]
    assert got == ["1.2.3.4", "9", "9", "7.7.7.7"]


def test_quarantine(spark):
    at = dt.datetime(2026, 5, 1, 10)
    rows = [("p", at + dt.timedelta(minutes=m)) for m in (0, 2, 4)]
    rows += [("q", at + dt.timedelta(minutes=m)) for m in (0, 4, 8)]
    out = quota.quarantined(spark.createDataFrame(rows, "plugin_id string, ts timestamp")).collect()
    assert {r.plugin_id for r in out} == {"p"}
    assert out[0].quarantined_until - out[0].quarantined_from == dt.timedelta(minutes=10)


# ---- retention -------------------------------------------------------------------------------

def test_sweep(spark):
    paid = spark.createDataFrame([("bob", "paid")], "user_id string, tier string")
    uploads = spark.createDataFrame(
        [("users/alice/uploads/old.csv", ago(hours=48)), ("alice/new.csv", ago(hours=2)),
         ("bob/recent.csv", ago(days=5)), ("users/bob/uploads/ancient.csv", ago(days=60)),
         ("edge/x", ago(hours=24))],
        "key string, last_modified timestamp_ntz",
    )
    results = spark.createDataFrame(
        [("alice/r.csv", ago(hours=3)), ("bob/r.csv", ago(hours=36)), ("stray", ago(days=99))],
        "key string, last_modified timestamp_ntz",
    )
    rules = retention.RetentionRules(result_free_hours=2, result_paid_days=1)
    plan = retention.sweep_plan(retention.listing(uploads, results), paid, now(), rules).cache()
    assert ids(retention.deletion_manifest(plan), "key") == [
        "alice/r.csv", "bob/r.csv", "stray", "users/alice/uploads/old.csv", "users/bob/uploads/ancient.csv"]
    counts = {r.bucket: tuple(r)[1:] for r in retention.sweep_counts(plan).collect()}
    assert counts == {"uploads": (5, 2, 3), "results": (3, 3, 0), None: (8, 5, 3)}
    assert {r.key: r.owner_id for r in plan.collect()}["stray"] == "unknown"


def test_record_stages(spark):
    df = spark.createDataFrame([(1, ago(days=1), "free"), (2, ago(days=100), "free"), (3, ago(days=100), "paid"),
                                (4, ago(days=999), "free")], "id long, created_at timestamp_ntz, tier string")
    out = retention.record_lifecycle(df, now(), archive_days=365, tier="tier")
    assert {r.id: r.stage for r in out.collect()} == {1: "hot", 2: "archive", 3: "hot", 4: "expired"}


# ---- jobs and requests -----------------------------------------------------------------------

def run_machine(events):
    """The state machine, one event after the other."""
    state = {"status": "queued", "started_at": None, "finished_at": None, "result_ref": None, "error": None}
    for ts, _, status, result_ref, error in sorted(events, key=lambda e: e[:2]):
        if status not in jobs.TRANSITIONS[state["status"]]:
            continue
        state["status"] = status
        if status == "running" and state["started_at"] is None:
            state["started_at"] = ts
        if status in jobs.TERMINAL:
            state["finished_at"] = ts
        state["result_ref"] = result_ref or state["result_ref"]
        state["error"] = error or state["error"]
    return state


def random_job_events(seed, n_jobs=300):
    rng = random.Random(seed)
    kinds = ["running"] * 4 + ["completed"] * 2 + ["failed", "cancelled"]
    out = {}
    for j in range(n_jobs):
        out[f"j{j}"] = [
            (dt.datetime(2026, 5, 1) + dt.timedelta(seconds=rng.randrange(6)), 1000 * j + i,
             rng.choice(kinds), rng.choice([None, f"r{i}"]), rng.choice([None, f"e{i}"]))
            for i in range(rng.randrange(1, 9))
        ]
    return out


EVENT_DDL = ("job_id string, ts timestamp_ntz, event_id long, status string, result_ref string, "
             "error string")


def test_fold_jobs_against_the_machine(spark):
    events = random_job_events(1)
    df = spark.createDataFrame([(j, *e) for j, es in events.items() for e in es], EVENT_DDL)
    got = {r.job_id: {k: r[k] for k in r.asDict() if k != "job_id"} for r in jobs.fold_jobs(df).collect()}
    assert got == {j: run_machine(es) for j, es in events.items()}


def test_fold_only_known_jobs(spark):
    df = spark.createDataFrame([("a", dt.datetime(2026, 1, 1), 1, "running", None, None),
                                ("x", dt.datetime(2026, 1, 1), 2, "running", None, None)], EVENT_DDL)
    known = spark.createDataFrame([("a",), ("b",)], "job_id string")
    states = jobs.fold_jobs(df, jobs=known)
    assert {r.job_id: r.status for r in states.collect()} == {"a": "running", "b": "queued"}
    assert ids(jobs.pending_messages(known, states), "job_id") == ["b"]
    assert ids(jobs.cancellable(known, states), "job_id") == ["a", "b"]
    assert jobs.last_heartbeats(df).count() == 2


def test_request_fold_and_open_list(spark):
    at = dt.datetime(2026, 5, 1)
    rows = [(1, at, 1, "open", None), (1, at, 2, "triaged", 77), (1, at, 3, "shipped", None),
            (2, at, 4, "open", None), (3, at, 5, "rejected", 5), (3, at, 6, "open", None)]
    out = jobs.fold_requests(spark.createDataFrame(
        rows, "request_id long, ts timestamp_ntz, event_id long, status string, issue long"))
    got = {r.request_id: (r.status, r.issue, r.resolved_at is not None) for r in out.collect()}
    assert got == {1: ("shipped", 77, True), 2: ("open", None, False), 3: ("open", 5, True)}
    log = spark.createDataFrame([(1, "open", 1, at), (2, "shipped", 9, at), (3, "triaged", 5, at),
                                 (4, "in-progress", 5, at - dt.timedelta(days=1))],
                                "id long, status string, priority int, created_at timestamp_ntz")
    assert [r.id for r in jobs.open_requests(log).collect()] == [4, 3, 1]


# ---- contracts, audit, cache -------------------------------------------------------------------

U = "123e4567-e89b-12d3-a456-426614174000"
JOB = ('{"job_id":"%s","user_id":"%s","kind":"convert","params":{},"priority":3,'
       '"created_at":"2026-05-01T10:00:00Z","trace_id":"t"}' % (U, U))


@pytest.mark.parametrize("contract,message,errors", [
    ("jobs", JOB, []),
    ("jobs", JOB.replace("convert", "ai-anomaly-full"), []),
    ("jobs", "neither here nor there", ["not a JSON object"]),
    ("jobs", "[1]", ["not a JSON object"]),
    ("jobs", None, ["not a JSON object"]),
    ("jobs", JOB.replace('"priority":3', '"priority":11'), ["invalid priority"]),
    ("jobs", JOB.replace('"priority":3', '"priority":3.5'), ["invalid priority"]),
    ("jobs", JOB.replace('"priority":3', '"priority":"3"'), ["invalid priority"]),
    ("jobs", JOB.replace('"params":{}', '"params":[]'), ["invalid params"]),
    ("jobs", JOB.replace('"t"', '""'), ["invalid trace_id"]),
    ("jobs", JOB.replace('"t"', "null"), ["invalid trace_id"]),
    ("jobs", JOB.replace("2026-05-01T10:00:00Z", "May"), ["invalid created_at"]),
    ("jobs", JOB.replace("{", '{"z":1,"b":2,', 1), ["unexpected b", "unexpected z"]),
    ("jobs", '{"job_id":"job seven"}', ["invalid job_id"] + [
        f"missing {k}" for k in ("user_id", "kind", "params", "priority", "created_at", "trace_id")]),
    ("job-results", '{"job_id":"%s","status":"failed","finished_at":"2026-05-01T10:00:00+02:00",'
     '"trace_id":"t","progress":99.5,"error":{"code":"X","message":"m"}}' % U, []),
    ("job-results", '{"job_id":"%s","status":"queued","finished_at":"2026-05-01T10:00:00Z",'
     '"trace_id":"t","progress":101,"error":{"code":"X"}}' % U,
     ["invalid error", "invalid progress", "invalid status"]),
    ("audit-events", '{"event_id":"%s","action":"a","occurred_at":"2026-05-01T10:00:00.123Z",'
     '"trace_id":"t","metadata":{"k":1}}' % U, []),
    ("audit-events", '{"event_id":"%s","action":"%s","occurred_at":"2026-05-01T10:00:00Z",'
     '"trace_id":"t"}' % (U, "a" * 129), ["invalid action"]),
    ("format-requests", '{"request_id":"%s","user_id":"%s","sample_ref":"x","status":"open",'
     '"priority":0,"action":"created","trace_id":"t"}' % (U, U), []),
])
def test_contracts(spark, contract, message, errors):
    df = spark.createDataFrame([(message,)], "value string")
    assert sorted(check_messages(df, "value", contract).first()["errors"]) == sorted(errors)


def test_typed_messages(spark):
    df = spark.createDataFrame([(1, JOB), (2, "{")], "offset long, value string")
    row, = valid_messages(df, "value", "jobs").collect()
    assert (row.offset, row.kind, row.priority, row.created_at) == (1, "convert", 3, dt.datetime(2026, 5, 1, 10))
    assert dead_letters(df, "value", "jobs").count() == 1


def test_audit_log(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.datetime(2026, 4, 30)), (1, dt.datetime(2026, 5, 2)),
                                (2, dt.datetime(2026, 5, 1))], "event_id long, created_at timestamp_ntz")
    rows = audit.audit_rows(df)
    assert {r.event_id: r.month for r in rows.collect()} == {1: "2026_04", 2: "2026_05"}
    audit.write_audit(rows, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log")).filter(F.col("month") == "2026_05")
    assert log.count() == 1
    assert "PartitionFilters: [isnotnull(month" in log._jdf.queryExecution().executedPlan().toString()


def test_cache(spark):
    asked = spark.createDataFrame([(1, "s", '{"b":1, "a":2}'), (2, "s", '{"a":3}'), (3, "t", '{"a":2,"b":1}')],
                                  "id long, capability string, payload string")
    from tabsift.operators.trees import canonical_hash
    cache = spark.createDataFrame(
        [("s", '{"a":2,"b":1}', "old", ago(minutes=50)), ("s", '{"a":2,"b":1}', "new", ago(minutes=5)),
         ("s", '{"a":3}', "stale", ago(hours=2))],
        "capability string, payload string, answer string, stored_at timestamp_ntz",
    ).withColumn("cache_key", canonical_hash(F.col("payload")))
    out = audit.answer_cache(asked, cache, now())
    assert {r.id: r.answer for r in out.collect()} == {1: "new", 2: None, 3: None}


def test_audit_rows_from_messages(spark):
    good = ('{"event_id":"%s","action":"login","occurred_at":"2026-05-01T10:00:00Z","trace_id":"t",'
            '"metadata":{"k":1}}' % U)
    row, = audit.audit_rows_from_messages(
        spark.createDataFrame([(good,), ("{}",)], "value string")).collect()
    assert (row.action, row.metadata, row.month) == ("login", '{"k":1}', "2026_05")


def test_keys_of_paths(spark):
    df = spark.createDataFrame([("s3://store/uploads/users/u-7/a.tar.GZ",)], "p string")
    key = retention.blob_key(F.col("p"), "uploads")
    row = df.select(key, retention.owner_of(key), retention.extension_of(key)).first()
    assert tuple(row) == ("users/u-7/a.tar.GZ", "u-7", "gz")
