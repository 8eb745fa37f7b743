"""Queries: tiers, gates, quotas, rates, retention, jobs, requests, audit, cache, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsift.catalog.base import (
    NOW_SUBS, SQL_JOB_EVENTS, SQL_REQUESTS, SQL_SUBSCRIPTIONS, SQL_TIERS, as_long, job_events,
    moment, query, requests, subscriptions, table, users,
)
from tabsift.functions.contracts import check_messages, valid_messages
from tabsift.operators.ranking import claims, first_wins
from tabsift.plans.flow import current_recipes, replay, run_operations
from tabsift.usage import audit, jobs, quota, retention, tiers
from tabsift.usage.tiers import TierLimits


def _tiers(spark, sf_dir):
    return tiers.effective_tiers(subscriptions(spark, sf_dir), moment(NOW_SUBS))


@query(f"""WITH {SQL_TIERS} SELECT user_id, id AS started_order, tier FROM latest_subs""")
def latest_subscription(spark, sf_dir):
    subs = subscriptions(spark, sf_dir).withColumn("expires_at", F.col("id"))
    return tiers.latest_subscriptions(subs).select(
        "user_id", F.col("expires_at").alias("started_order"), "tier"
    )


@query(f"""WITH {SQL_TIERS} SELECT c_custkey AS user_id, coalesce(t.tier, 'free') AS tier
FROM customer LEFT JOIN tiers t ON t.user_id = c_custkey""")
def effective_tier(spark, sf_dir):
    out = tiers.with_tier(users(spark, sf_dir), _tiers(spark, sf_dir))
    return out.select("user_id", "tier")


@query(f"""WITH {SQL_SUBSCRIPTIONS} SELECT c_custkey AS user_id FROM customer
WHERE NOT EXISTS (SELECT 1 FROM subscriptions s WHERE s.user_id = c_custkey
                  AND s.status = 'active')""")
def users_without_sub(spark, sf_dir):
    out = tiers.users_without_subscription(users(spark, sf_dir), subscriptions(spark, sf_dir))
    return out.select("user_id")


_REGISTRY = """registry AS (
  SELECT 'ai-auto-summary' AS plugin_id, '1.' || (p_size // 5)::VARCHAR || '.0' AS version,
    p_size // 5 AS minor, CASE WHEN p_size >= 25 THEN 'paid' ELSE 'free' END AS required_tier,
    CASE WHEN p_size < 48 THEN 'enabled' ELSE 'disabled' END AS status FROM part
  WHERE p_type = 'ECONOMY' UNION ALL
  SELECT 'recipe-crud', '1.' || (p_size // 5)::VARCHAR || '.0', p_size // 5,
    CASE WHEN p_size >= 25 THEN 'paid' ELSE 'free' END,
    CASE WHEN p_size < 48 THEN 'enabled' ELSE 'disabled' END FROM part WHERE p_type <> 'ECONOMY'),
latest_plugins AS (SELECT plugin_id, max(minor) AS minor,
  CASE WHEN max(minor) >= 5 THEN 'paid' ELSE 'free' END AS required_tier
  FROM registry WHERE status = 'enabled' GROUP BY plugin_id)"""


def _registry(spark, sf_dir):
    """Plugin versions: part sizes as minor numbers, so version 1.9 and 1.10 both occur."""
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.when(F.col("p_type") == "ECONOMY", "ai-auto-summary").otherwise("recipe-crud")
        .alias("plugin_id"),
        F.concat(F.lit("1."), F.expr("p_size div 5").cast("string"), F.lit(".0")).alias("version"),
        F.when(size >= 25, "paid").otherwise("free").alias("required_tier"),
        F.when(size < 48, "enabled").otherwise("disabled").alias("status"),
    )


@query(f"""WITH {_REGISTRY} SELECT plugin_id, '1.' || minor::VARCHAR || '.0' AS version,
  required_tier FROM latest_plugins""")
def latest_plugin(spark, sf_dir):
    return tiers.latest_plugins(_registry(spark, sf_dir))


_GATED = f"""WITH {SQL_TIERS}, {SQL_REQUESTS}, {_REGISTRY},
gated AS (SELECT event_id, r.user_id, ts, path, method,
  CASE WHEN path = '/api/v1/format-requests' AND method = 'POST' THEN 'format-request-submit'
       WHEN starts_with(path, '/api/v1/ai/summary') THEN 'ai-auto-summary'
       WHEN starts_with(path, '/api/v1/recipes') THEN 'recipe-crud' END AS plugin_id FROM requests r),
decided AS (SELECT g.*, coalesce(t.tier, 'free') AS tier, p.required_tier,
  NOT (coalesce(p.required_tier = 'paid', FALSE) AND coalesce(t.tier, 'free') <> 'paid') AS allowed
  FROM gated g LEFT JOIN tiers t USING (user_id) LEFT JOIN latest_plugins p USING (plugin_id)) """


def _gated(spark, sf_dir):
    seen = requests(table(spark, sf_dir, "events")).withColumn(
        "plugin_id", tiers.feature_of(F.col("path"), F.col("method"))
    )
    return tiers.feature_gate(seen, _registry(spark, sf_dir), _tiers(spark, sf_dir))


@query(_GATED + "SELECT event_id, user_id, plugin_id, tier, required_tier, allowed FROM decided")
def tier_gate(spark, sf_dir):
    return _gated(spark, sf_dir).select(
        "event_id", "user_id", "plugin_id", "tier", "required_tier", "allowed"
    )


_LOW = TierLimits(free_upload_mb=5, free_daily_ops=2, paid_upload_mb=50, paid_daily_ops=0)


@query(f"""WITH {SQL_TIERS}, d AS (
  SELECT user_id, ts::DATE AS day, count(*) AS ops FROM events GROUP BY ALL)
SELECT d.user_id, strftime(day, '%Y-%m-%d') AS day, ops, coalesce(tier, 'free') AS tier,
  CASE WHEN coalesce(tier, 'free') = 'paid' THEN 0 ELSE greatest(ops - 2, 0) END::BIGINT AS rejected
FROM d LEFT JOIN tiers t USING (user_id)""")
def quota_daily(spark, sf_dir):
    out = quota.daily_quota(table(spark, sf_dir, "events"), _tiers(spark, sf_dir), _LOW)
    return out.select("user_id", F.col("day").cast("string").alias("day"), "ops", "tier",
                      "rejected")


@query(f"""WITH {SQL_TIERS}, n AS (SELECT event_id, e.user_id, ts, coalesce(tier, 'free') AS tier,
  row_number() OVER (PARTITION BY e.user_id, ts::DATE ORDER BY ts, event_id) AS nth
  FROM events e LEFT JOIN tiers t USING (user_id))
SELECT event_id, user_id, ceil((epoch_us(date_trunc('day', ts) + INTERVAL 1 DAY) - epoch_us(ts))
    / 1000000.0 - 1)::BIGINT AS retry_after
FROM n WHERE tier = 'free' AND nth > 2""")
def quota_rejects(spark, sf_dir):
    out = quota.quota_rejects(table(spark, sf_dir, "events"), _tiers(spark, sf_dir), _LOW)
    return out.select("event_id", "user_id", *as_long("retry_after"))


@query("""SELECT event_id, user_id, nth FROM (SELECT event_id, user_id,
  row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS nth FROM events)
WHERE nth <= 2""")
def nth_operation(spark, sf_dir):
    out = quota.first_ops(table(spark, sf_dir, "events"), 2)
    return out.select("event_id", "user_id", *as_long("nth"))


@query(f"""WITH {SQL_REQUESTS} SELECT ip, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M')
    AS minute, count(*) AS requests, count(*) > 1 AS limited
FROM requests WHERE starts_with(path, '/api/v1/auth/signup') GROUP BY 1, 2""")
def ip_rate(spark, sf_dir):
    return quota.ip_rate(requests(table(spark, sf_dir, "events")), per_minute=1).withColumn(
        "minute", F.date_format("minute", "yyyy-MM-dd HH:mm")
    )


@query(f"""WITH {SQL_REQUESTS} SELECT event_id, ip FROM (
  SELECT event_id, ip, row_number() OVER (PARTITION BY ip, date_trunc('minute', ts)
    ORDER BY ts, event_id) AS nth FROM requests WHERE starts_with(path, '/api/v1/auth/signup'))
WHERE nth > 1""")
def ip_rejects(spark, sf_dir):
    return quota.ip_rejects(requests(table(spark, sf_dir, "events")), per_minute=1).select("event_id", "ip")


@query(f"""WITH {SQL_TIERS}, {SQL_REQUESTS}, s AS (SELECT event_id, r.user_id, size_bytes,
  coalesce(tier, 'free') AS tier FROM requests r LEFT JOIN tiers USING (user_id)
  WHERE starts_with(path, '/api/v1/uploads'))
SELECT event_id, user_id, size_bytes, tier, CASE WHEN tier = 'paid' THEN 50 ELSE 5 END::BIGINT
  AS max_upload_mb FROM s
WHERE size_bytes > CASE WHEN tier = 'paid' THEN 50 ELSE 5 END * 1048576""")
def size_rejects(spark, sf_dir):
    out = quota.size_rejects(requests(table(spark, sf_dir, "events")), _tiers(spark, sf_dir), _LOW)
    return out.select("event_id", "user_id", "size_bytes", "tier", *as_long("max_upload_mb"))


@query(_GATED + f""", q AS (SELECT r.user_id, ts, coalesce(tier, 'free') AS tier, path, event_id,
  row_number() OVER (PARTITION BY r.user_id, ts::DATE ORDER BY ts, event_id) AS nth
  FROM requests r LEFT JOIN tiers USING (user_id) WHERE NOT starts_with(path, '/api/v1/auth/'))
SELECT user_id, 'tier-reject' AS action, 'POST ' || path AS target,
  '{{"reason":"TIER_QUOTA_EXCEEDED","tier":"free"}}' AS metadata, epoch_us(ts) AS at
FROM q WHERE tier = 'free' AND nth > 2
UNION ALL SELECT user_id, 'tier-reject', 'POST ' || path,
  '{{"reason":"FEATURE_REQUIRES_PAID_TIER","tier":"' || tier || '","plugin_id":"' || plugin_id || '"}}',
  epoch_us(ts) FROM decided WHERE NOT allowed
UNION ALL SELECT r.user_id, 'tier-reject', 'POST ' || path,
  '{{"reason":"PAYLOAD_TOO_LARGE","tier":"' || coalesce(tier, 'free') || '","size_bytes":'
    || size_bytes::VARCHAR || '}}', epoch_us(ts)
FROM requests r LEFT JOIN tiers USING (user_id) WHERE starts_with(path, '/api/v1/uploads')
  AND size_bytes > CASE WHEN coalesce(tier, 'free') = 'paid' THEN 50 ELSE 5 END * 1048576""")
def reject_events(spark, sf_dir):
    known, seen = _tiers(spark, sf_dir), requests(table(spark, sf_dir, "events"))
    target = F.concat_ws(" ", "method", "path")
    parts = [
        quota.reject_audit(
            quota.quota_rejects(quota.counted_requests(seen), known, _LOW),
            quota.REJECT_QUOTA, target, [],
        ),
        quota.reject_audit(
            _gated(spark, sf_dir).filter(~F.col("allowed")), tiers.REJECT_FEATURE, target,
            ["plugin_id"],
        ),
        quota.reject_audit(
            quota.size_rejects(seen, known, _LOW), quota.REJECT_SIZE, target, ["size_bytes"]
        ),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.select("user_id", "action", "target", "metadata",
                      F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))


@query(f"""WITH {SQL_TIERS}, d AS (SELECT user_id, count(*) AS ops FROM events
  WHERE ts::DATE = DATE '2024-01-15' GROUP BY 1)
SELECT c_custkey AS user_id, coalesce(tier, 'free') AS tier, coalesce(ops, 0) AS ops_today,
  CASE WHEN coalesce(tier, 'free') = 'paid' THEN 0 ELSE 100 END::BIGINT AS ops_limit,
  coalesce(tier, 'free') = 'paid' AS ops_unlimited,
  CASE WHEN coalesce(tier, 'free') = 'paid' THEN 500 ELSE 5 END::BIGINT AS max_upload_mb,
  FALSE AS upload_unlimited,
  CASE WHEN coalesce(tier, 'free') = 'free' THEN '/account/billing' END AS upgrade_hint
FROM customer LEFT JOIN tiers t ON t.user_id = c_custkey LEFT JOIN d ON d.user_id = c_custkey""")
def usage_view(spark, sf_dir):
    out = quota.usage_view(
        users(spark, sf_dir), _tiers(spark, sf_dir), table(spark, sf_dir, "events"),
        F.lit("2024-01-15").cast("date"),
    )
    for c in ("ops_limit", "max_upload_mb"):
        out = out.withColumn(c, F.col(c).cast("bigint"))
    return out


@query("""WITH w AS (SELECT event_type AS plugin_id, ts,
  unnest(generate_series(0, 4)) AS back FROM events),
s AS (SELECT plugin_id, date_trunc('minute', ts) - back * INTERVAL 1 MINUTE AS start FROM w)
SELECT plugin_id, count(*) AS failures, epoch_us(start + INTERVAL 5 MINUTE) AS quarantined_from,
  epoch_us(start + INTERVAL 15 MINUTE) AS quarantined_until
FROM s GROUP BY plugin_id, start HAVING count(*) >= 3""")
def quarantine(spark, sf_dir):
    failures = table(spark, sf_dir, "events").withColumnRenamed("event_type", "plugin_id")
    out = quota.quarantined(failures)
    return out.select("plugin_id", "failures", *[
        F.unix_micros(F.col(c).cast("timestamp")).alias(c)
        for c in ("quarantined_from", "quarantined_until")
    ])


# ---- retention -----------------------------------------------------------------------------------

NOW_BLOBS = "2000-06-01 00:00:00"
_BLOBS = f"""WITH {SQL_TIERS}, blobs AS (
  SELECT 'uploads' AS bucket, 'users/' || o_custkey::VARCHAR || '/uploads/' || o_orderkey::VARCHAR
    || '.csv' AS key, o_orderdate AS last_modified, o_custkey AS owner FROM orders
    WHERE o_orderstatus <> 'F' UNION ALL
  SELECT 'results', o_custkey::VARCHAR || '/' || o_orderkey::VARCHAR || '.json', o_orderdate,
    o_custkey FROM orders WHERE o_orderstatus = 'F'),
plan AS (SELECT bucket, key, owner::VARCHAR AS owner_id, coalesce(tier, 'free') AS tier, last_modified,
  last_modified < TIMESTAMP '{NOW_BLOBS}' - CASE WHEN tier = 'paid' THEN INTERVAL 720 HOUR
    ELSE INTERVAL 24 HOUR END AS expired
  FROM blobs LEFT JOIN tiers t ON t.user_id = owner) """


def _sweep(spark, sf_dir):
    owner, order = F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")
    o = table(spark, sf_dir, "orders").withColumn("last_modified", F.col("o_orderdate"))
    uploads = o.filter(F.col("o_orderstatus") != "F").withColumn(
        "key", F.concat(F.lit("users/"), owner, F.lit("/uploads/"), order, F.lit(".csv"))
    )
    results = o.filter(F.col("o_orderstatus") == "F").withColumn(
        "key", F.concat(owner, F.lit("/"), order, F.lit(".json"))
    )
    known = _tiers(spark, sf_dir).withColumn("user_id", F.col("user_id").cast("string"))
    return retention.sweep_plan(retention.listing(uploads, results), known, moment(NOW_BLOBS))


@query(_BLOBS + """SELECT bucket, key, owner_id, tier, epoch_us(last_modified) AS modified
FROM plan WHERE expired""")
def retention_manifest(spark, sf_dir):
    out = retention.deletion_manifest(_sweep(spark, sf_dir))
    return out.select("bucket", "key", "owner_id", "tier", F.unix_micros(
        F.col("last_modified").cast("timestamp")).alias("modified"))


@query(_BLOBS + """SELECT coalesce(bucket, 'total') AS bucket, count(*) AS scanned,
  count(*) FILTER (expired) AS deleted, count(*) FILTER (NOT expired) AS retained
FROM plan GROUP BY ROLLUP (bucket)""")
def retention_counts(spark, sf_dir):
    return retention.sweep_counts(_sweep(spark, sf_dir)).withColumn(
        "bucket", F.coalesce("bucket", F.lit("total"))
    )


@query("""SELECT event_id, CASE WHEN value < 10 THEN '10.1.' || user_id || '.9' ELSE '::1' END AS ip,
  CAST(floor(epoch(ts) / 60) AS BIGINT) AS minute_id FROM events""")
def client_addresses(spark, sf_dir):
    hops = F.concat(F.lit("10.1."), F.col("user_id"), F.lit(".9 , 172.16.0.1"))
    forwarded = F.when(F.col("value") < 10, hops).otherwise("  ")
    return table(spark, sf_dir, "events").select(
        "event_id", quota.client_ip(forwarded, F.lit("::1")).alias("ip"),
        F.expr("unix_seconds(cast(ts AS timestamp)) div 60").alias("minute_id"),
    )


@query("""SELECT stage, count(*) AS records FROM (SELECT
  CASE WHEN o_orderpriority = '1-URGENT' OR o_orderdate >= TIMESTAMP '2000-06-01' - INTERVAL 90 DAY
       THEN 'hot' WHEN o_orderdate >= TIMESTAMP '2000-06-01' - INTERVAL 455 DAY THEN 'archive'
       ELSE 'expired' END AS stage FROM orders) GROUP BY stage""")
def record_retention(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn(
        "tier", F.when(F.col("o_orderpriority") == "1-URGENT", "paid").otherwise("free")
    )
    out = retention.record_lifecycle(
        o, moment("2000-06-01 00:00:00"), "o_orderdate", 90, 365, "tier"
    )
    return out.groupBy("stage").agg(F.count(F.lit(1)).alias("records"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey::VARCHAR ELSE 'unknown' END
  AS owner, 'gz' AS extension FROM orders""")
def key_parts(spark, sf_dir):
    owner = F.col("o_custkey").cast("string")
    key = F.when(
        F.col("o_orderstatus") == "F", F.concat(F.lit("users/"), owner, F.lit("/a.b/c.tar.GZ"))
    ).otherwise("stray.gz")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", retention.owner_of(key).alias("owner"),
        retention.extension_of(key).alias("extension"),
    )


# ---- jobs and requests ---------------------------------------------------------------------------

# An ordered fold, event by event: the state machine as the reader of the log would run it.
_FOLD = f"""WITH {SQL_JOB_EVENTS}, folded AS (SELECT job_id, list_reduce(
  list({{'s': status, 'st': CAST(NULL AS TIMESTAMP), 'fi': CAST(NULL AS TIMESTAMP), 't': ts,
         'r': result_ref, 'e': error}} ORDER BY ts, event_id),
  lambda a, x: CASE
    WHEN a.s = 'queued' AND x.s = 'running' THEN {{'s': x.s, 'st': x.t, 'fi': a.fi, 't': x.t,
      'r': coalesce(x.r, a.r), 'e': coalesce(x.e, a.e)}}
    WHEN (a.s = 'queued' AND x.s IN ('failed', 'cancelled'))
      OR (a.s = 'running' AND x.s IN ('failed', 'cancelled', 'completed'))
      THEN {{'s': x.s, 'st': a.st, 'fi': x.t, 't': x.t, 'r': coalesce(x.r, a.r),
             'e': coalesce(x.e, a.e)}}
    ELSE a END,
  {{'s': 'queued', 'st': CAST(NULL AS TIMESTAMP), 'fi': CAST(NULL AS TIMESTAMP),
    't': CAST(NULL AS TIMESTAMP), 'r': CAST(NULL AS VARCHAR), 'e': CAST(NULL AS VARCHAR)}}) AS f
  FROM job_events GROUP BY job_id)
SELECT job_id, f.s AS status, epoch_us(f.st) AS started_at, epoch_us(f.fi) AS finished_at,
  f.r AS result_ref, f.e AS error FROM folded"""


def shown_states(states):
    return states.select(
        "job_id", "status",
        F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_at"),
        F.unix_micros(F.col("finished_at").cast("timestamp")).alias("finished_at"),
        "result_ref", "error",
    )


@query(_FOLD)
def job_fold(spark, sf_dir):
    return shown_states(jobs.fold_jobs(job_events(table(spark, sf_dir, "events"))))


@query(_FOLD.replace("FROM folded", """FROM folded WHERE job_id IN (SELECT job_id FROM job_events
  WHERE status = 'completed')"""))
def job_results_of_known_jobs(spark, sf_dir):
    """Result events of listed jobs only; here the list holds the jobs with a completion."""
    events = job_events(table(spark, sf_dir, "events"))
    known = events.filter(F.col("status") == "completed").select("job_id").distinct()
    return shown_states(jobs.fold_jobs(events, jobs=known))


@query(f"""WITH {SQL_JOB_EVENTS} SELECT job_id, epoch_us(max(ts)) AS last_seen, count(*) AS beats
FROM job_events WHERE status = 'running' GROUP BY job_id""")
def heartbeats(spark, sf_dir):
    out = jobs.last_heartbeats(job_events(table(spark, sf_dir, "events")))
    return out.withColumn("last_seen", F.unix_micros(F.col("last_seen").cast("timestamp")))


@query(_FOLD.replace("SELECT job_id, f.s AS status", ", states AS (SELECT job_id, f.s AS status")
       + """) SELECT DISTINCT u.job_id FROM (SELECT job_id FROM job_events) u
WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.job_id = u.job_id AND s.status <> 'queued')""")
def skip_known_jobs(spark, sf_dir):
    events = job_events(table(spark, sf_dir, "events"))
    messages = events.select("job_id").distinct()
    return jobs.pending_messages(messages, jobs.fold_jobs(events))


@query(_FOLD.replace("SELECT job_id, f.s AS status", ", states AS (SELECT job_id, f.s AS status")
       + """) SELECT job_id FROM states WHERE status IN ('queued', 'running')""")
def cancellable_jobs(spark, sf_dir):
    events = job_events(table(spark, sf_dir, "events"))
    asked = events.select("job_id").distinct()
    return jobs.cancellable(asked, jobs.fold_jobs(events))


@query("""SELECT user_id, id, rank FROM (SELECT o_custkey AS user_id, o_orderkey AS id,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rank
  FROM orders) WHERE rank <= 5""")
def recent_topk(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("created_at"),
    )
    return jobs.recent_jobs(log, 5).select("user_id", "id", *as_long("rank"))


SQL_UPDATES = """WITH updates AS (SELECT user_id AS request_id, event_id, ts,
  CASE event_type WHEN 'signup' THEN 'open' WHEN 'view' THEN 'triaged' WHEN 'click' THEN 'in-progress'
    WHEN 'purchase' THEN 'shipped' ELSE 'rejected' END AS status,
  CASE WHEN json_extract(props, '$.k')::BIGINT < 20 THEN json_extract(props, '$.k')::BIGINT END AS issue
  FROM events) """


def request_updates(events):
    kind, k = F.col("event_type"), F.get_json_object("props", "$.k").cast("bigint")
    status = (
        F.when(kind == "signup", "open").when(kind == "view", "triaged")
        .when(kind == "click", "in-progress").when(kind == "purchase", "shipped")
        .otherwise("rejected")
    )
    return events.select(
        F.col("user_id").alias("request_id"), "event_id", "ts", status.alias("status"),
        F.when(k < 20, k).alias("issue"),
    )


SQL_REQUEST_FOLD = SQL_UPDATES + """SELECT request_id, arg_max(status, (ts, event_id)) AS status,
  arg_max(issue, (ts, event_id)) FILTER (issue IS NOT NULL) AS issue,
  epoch_us(max(ts) FILTER (status IN ('shipped', 'rejected'))) AS resolved_at
FROM updates GROUP BY request_id"""


@query(SQL_REQUEST_FOLD)
def request_fold(spark, sf_dir):
    out = jobs.fold_requests(request_updates(table(spark, sf_dir, "events")))
    return out.withColumn("resolved_at", F.unix_micros(F.col("resolved_at").cast("timestamp")))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'triaged' END AS status
FROM orders WHERE o_orderstatus IN ('O', 'P')""")
def open_requests(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "triaged")
        .otherwise("shipped").alias("status"),
        F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("created_at"),
    )
    return jobs.open_requests(log).select("id", "status")


@query("""SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id
FROM events GROUP BY user_id, event_type""")
def idempotent_first(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    return first_wins(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""WITH RECURSIVE c AS (
  SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY user_id, event_type UNION ALL
  SELECT c.user_id, c.event_type, min(e.ts) FROM c JOIN events e ON e.user_id = c.user_id
    AND e.event_type = c.event_type AND e.ts >= c.ts + INTERVAL 10 DAY
  GROUP BY c.user_id, c.event_type, c.ts)
SELECT user_id, event_type, epoch_us(ts) AS claimed_at FROM c""")
def idempotent_claims(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    out = claims(
        rows, ["user_id", "event_type"], "ts", "event_id", F.make_dt_interval(days=F.lit(10))
    )
    return out.select("user_id", "event_type", F.unix_micros(
        F.col("ts").cast("timestamp")).alias("claimed_at"))


@query("""SELECT o_orderkey AS id, o_custkey AS user_id FROM orders
WHERE (o_orderkey, o_custkey) IN (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey
  ELSE -1 END FROM orders)""")
def owned_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    items = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"))
    asked = o.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).otherwise(-1).alias("user_id"),
    )
    return tiers.owned(items, asked)


# ---- audit, cache, contracts ---------------------------------------------------------------------

@query("""SELECT strftime(ts, '%Y_%m') AS month, event_type AS action, count(*) AS events
FROM events GROUP BY ALL""")
def audit_by_month(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("event_type").alias("action"), F.col("ts").alias("created_at")
    )
    # Every message arrives twice; the log keeps one.
    rows = audit.audit_rows(log.unionAll(log))
    return rows.groupBy("month", "action").agg(F.count(F.lit(1)).alias("events"))


@query("""SELECT o_orderkey, 'audit_log_' || strftime(o_orderdate, '%Y_%m') AS name,
  strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS first_day,
  strftime(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month FROM orders""")
def month_partitions(spark, sf_dir):
    out = table(spark, sf_dir, "orders").select(
        "o_orderkey", audit.month_bounds(F.col("o_orderdate")).alias("m")
    )
    return out.select(
        "o_orderkey", "m.name", F.date_format("m.start", "yyyy-MM-dd").alias("first_day"),
        F.date_format("m.end", "yyyy-MM-dd").alias("next_month"),
    )


@query("""WITH c AS (SELECT event_type AS capability, props, arg_max(event_id, ts) AS answer FROM events
  WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 864000 SECOND AND value > 10 GROUP BY ALL)
SELECT event_id, answer, answer IS NOT NULL AS hit FROM events e
LEFT JOIN c ON c.capability = e.event_type AND c.props = e.props""")
def answer_cache(spark, sf_dir):
    from tabsift.operators.trees import canonical_hash

    events = table(spark, sf_dir, "events")
    asked = events.select(
        "event_id", F.col("event_type").alias("capability"),
        F.replace(F.col("props"), F.lit(": "), F.lit(" :  ")).alias("payload"),
    )
    cache = events.filter(F.col("value") > 10).select(
        F.col("event_type").alias("capability"), canonical_hash(F.col("props")).alias("cache_key"),
        F.col("event_id").alias("answer"), F.col("ts").alias("stored_at"),
    )
    out = audit.answer_cache(asked, cache, moment("2024-01-30 00:00:00"), 864000)
    return out.select("event_id", "answer", "hit")


def job_messages(events):
    """Job messages made of events: signups lack a trace, errors have a bad kind and priority."""
    uid = F.format_string("00000000-0000-0000-0000-%012d", "event_id")
    user = F.format_string("00000000-0000-0000-0001-%012d", "user_id")
    kind = F.when(F.col("event_type") == "error", "explode").otherwise("convert")
    k = F.get_json_object("props", "$.k").cast("bigint")
    body = F.to_json(F.struct(
        uid.alias("job_id"), user.alias("user_id"), kind.alias("kind"),
        F.struct(F.col("event_type").alias("note")).alias("params"),
        F.when(F.col("event_type") == "error", k + 100).otherwise(F.pmod(k, F.lit(10)))
        .alias("priority"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("t-"), F.col("event_id")))
        .alias("trace_id"),
        F.when(F.col("event_type") == "view", F.lit(1)).alias("surplus"),
    ))
    return events.select(
        "event_id", "user_id", "ts",
        F.when(F.col("value") < 0.5, F.lit("this is not json")).otherwise(body).alias("value"),
    )


@query("""SELECT event_id, CASE WHEN value < 0.5 THEN 'not a JSON object'
  WHEN event_type = 'signup' THEN 'missing trace_id' WHEN event_type = 'view' THEN 'unexpected surplus'
  WHEN event_type = 'error' THEN 'invalid kind; invalid priority' ELSE '' END AS errors FROM events""")
def message_validation(spark, sf_dir):
    checked = check_messages(job_messages(table(spark, sf_dir, "events")), "value", "jobs")
    return checked.select("event_id", F.array_join("errors", "; ").alias("errors"))


@query("""SELECT event_id, event_type AS note, json_extract(props, '$.k')::BIGINT % 10 AS priority,
  epoch(date_trunc('second', ts))::BIGINT AS created
FROM events WHERE value >= 0.5 AND event_type IN ('click', 'purchase')""")
def message_fields(spark, sf_dir):
    good = valid_messages(job_messages(table(spark, sf_dir, "events")), "value", "jobs")
    return good.select(
        "event_id", F.variant_get("params", "$.note", "string").alias("note"), "priority",
        F.unix_seconds("created_at").alias("created"),
    )


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'results/' || user_id || '/convert/'
  || event_id || '.json' WHEN 'view' THEN 'results/' || user_id || '/ai/anomaly/' || event_id || '.json'
  END AS path FROM events""")
def result_paths(spark, sf_dir):
    kind = F.when(F.col("event_type") == "click", "convert").when(
        F.col("event_type") == "view", "ai-anomaly-full").otherwise("unheard-of")
    return table(spark, sf_dir, "events").select(
        "event_id", jobs.result_path(F.col("user_id"), kind, F.col("event_id")).alias("path")
    )


# ---- chains and recipes ----------------------------------------------------------------------------

@query("""SELECT o_custkey, o_totalprice FROM orders
WHERE o_totalprice > 300000 AND o_orderstatus = 'O' AND regexp_matches(o_orderpriority, '(?i)high')""")
def chain_filters(spark, sf_dir):
    steps = [
        {"kind": "filter", "mode": "row", "predicate": "o_totalprice > 300000 AND o_orderstatus = 'O'"},
        {"kind": "filter", "mode": "regex", "pattern": "high", "flags": ["i"]},
        {"kind": "filter", "mode": "column", "keep": ["o_custkey", "o_totalprice"]},
    ]
    return run_operations(table(spark, sf_dir, "orders"), steps)


@query("""WITH r AS (SELECT c_nationkey AS user_id, c_mktsegment AS name, c_custkey AS id,
  c_acctbal AS updated_at FROM customer)
SELECT user_id::BIGINT AS user_id, name, arg_max(id, (updated_at, id)) AS id FROM r GROUP BY ALL""")
def recipe_latest(spark, sf_dir):
    saves = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("user_id"), F.col("c_mktsegment").alias("name"),
        F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("updated_at"),
    )
    return current_recipes(saves).select("user_id", "name", "id")


@query("""SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice_sum,
  count(o_totalprice) AS o_totalprice_count
FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY o_orderstatus""")
def recipe_replay(spark, sf_dir):
    recipe = """{"operations": [
      {"kind": "filter", "mode": "row",
       "predicate": {"col": "o_orderpriority", "op": "ne", "value": "5-LOW"}},
      {"kind": "analyze", "analysis": "group_by",
       "options": {"by": ["o_orderstatus"], "agg": {"o_totalprice": ["sum", "count"]}}}]}"""
    out = replay(table(spark, sf_dir, "orders"), recipe)
    return out.withColumn("o_totalprice_sum", F.round("o_totalprice_sum", 2))
