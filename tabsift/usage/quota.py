"""Usage counters and limits over request tables."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsift.operators.ranking import first_rows, group_edges, rows_after, rows_beyond
from tabsift.usage.tiers import FREE, PAID, TierLimits, with_tier

# Path rules, the per-minute limit and the reject codes.
EXEMPT_PREFIXES = ("/api/v1/auth/", "/api/v1/billing/me", "/actuator/", "/api/v1/admin/")
RATE_LIMITED_PATHS = ("/api/v1/auth/signup", "/api/v1/auth/login", "/api/v1/auth/reset")
SIZE_LIMITED_PATHS = ("/api/v1/uploads", "/api/v1/detect", "/api/v1/paste", "/api/v1/jobs")
REQUESTS_PER_MINUTE = 60
REJECT_QUOTA, REJECT_SIZE = "TIER_QUOTA_EXCEEDED", "PAYLOAD_TOO_LARGE"
REJECT_ACTION = "tier-reject"
UPGRADE_HINT = "/account/billing"


def starts_with_any(path: Column, prefixes: tuple[str, ...]) -> Column:
    return reduce(or_, [path.startswith(p) for p in prefixes])


def client_ip(forwarded: Column, remote: Column) -> Column:
    """First hop of the forwarding header, else the peer address."""
    hop = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.when(F.coalesce(F.trim(forwarded), F.lit("")) != "", hop).otherwise(remote)


def seconds_left_in_day(ts: Column) -> Column:
    """Whole seconds until the UTC day of ``ts`` ends."""
    into = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    partial = F.when(F.date_trunc("second", ts) == ts, 0).otherwise(1)
    return F.lit(86400) - into - partial


def counted_requests(requests: DataFrame) -> DataFrame:
    """Requests that use up quota: a known user on a path that is not exempt."""
    return requests.filter(
        F.col("user_id").isNotNull() & ~starts_with_any(F.col("path"), EXEMPT_PREFIXES)
    )


def ops_per_day(events: DataFrame) -> DataFrame:
    """``user_id, day, ops`` per UTC day; counts combine before the shuffle."""
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("ops")
    )


def daily_quota(events: DataFrame, tiers: DataFrame, limits: TierLimits = TierLimits()) -> DataFrame:
    """``user_id, day, tier, ops, cap, rejected``. Days are counted before the tiers join."""
    counted = with_tier(ops_per_day(events), tiers).withColumn(
        "cap", limits.daily_ops(F.col("tier"))
    )
    over = F.when(F.col("cap") == 0, F.lit(0)).otherwise(F.col("ops") - F.col("cap"))
    return counted.withColumn("rejected", F.greatest(over, F.lit(0)).cast("bigint"))


def _capped(limits: TierLimits) -> list[tuple[str, int]]:
    caps = ((FREE, limits.free_daily_ops), (PAID, limits.paid_daily_ops))
    return [(tier, cap) for tier, cap in caps if cap > 0]


def quota_rejects(
    events: DataFrame, tiers: DataFrame, limits: TierLimits = TierLimits(),
    order: tuple[str, ...] = ("ts", "event_id"),
) -> DataFrame:
    """Events after the cap-th of their user's day, with ``day, tier, cap, retry_after``."""
    keys, order = ["user_id", "day"], list(order)
    dated = events.withColumn("day", F.to_date("ts"))
    # Only the users at the edge of a cap need their tier looked up.
    edges = [
        with_tier(group_edges(dated, keys, order, cap), tiers)
        .filter(F.col("tier") == tier).withColumn("cap", F.lit(cap))
        for tier, cap in _capped(limits)
    ]
    if not edges:
        return dated.withColumns({"tier": F.lit(FREE), "cap": F.lit(0), "retry_after": F.lit(0)}).limit(0)
    out = rows_after(dated, reduce(DataFrame.unionByName, edges), keys, order)
    return out.withColumn("retry_after", seconds_left_in_day(F.col("ts")))


def first_ops(
    events: DataFrame, cap: int, order: tuple[str, ...] = ("ts", "event_id")
) -> DataFrame:
    """The operations of each user's day within the cap, numbered ``nth``."""
    dated = events.withColumn("day", F.to_date("ts"))
    return first_rows(dated, ["user_id", "day"], list(order), cap, rank="nth")


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def ip_rate(requests: DataFrame, per_minute: int = REQUESTS_PER_MINUTE) -> DataFrame:
    """``ip, minute, requests, limited`` over the rate-limited paths."""
    guarded = requests.filter(starts_with_any(F.col("path"), RATE_LIMITED_PATHS))
    return (
        guarded.groupBy("ip", minute_of(F.col("ts")).alias("minute"))
        .agg(F.count(F.lit(1)).alias("requests"))
        .withColumn("limited", F.col("requests") > per_minute)
    )


def ip_rejects(
    requests: DataFrame, per_minute: int = REQUESTS_PER_MINUTE,
    order: tuple[str, ...] = ("ts", "event_id"),
) -> DataFrame:
    """Requests after the allowed number of their address and minute."""
    guarded = requests.filter(starts_with_any(F.col("path"), RATE_LIMITED_PATHS))
    return rows_beyond(
        guarded.withColumn("minute", minute_of(F.col("ts"))), ["ip", "minute"], list(order),
        per_minute,
    )


def size_rejects(
    requests: DataFrame, tiers: DataFrame, limits: TierLimits = TierLimits()
) -> DataFrame:
    """Requests on size-limited paths beyond their tier's limit, with ``tier, max_upload_mb``.

    Sizes under the smallest limit are dropped before the join.
    """
    caps = [c for c in (limits.free_upload_mb, limits.paid_upload_mb) if c > 0]
    if not caps:
        caps = [0]
    large = requests.filter(
        starts_with_any(F.col("path"), SIZE_LIMITED_PATHS) & F.col("user_id").isNotNull()
        & (F.col("size_bytes") > min(caps) * 1024 * 1024)
    )
    return (
        with_tier(large, tiers)
        .withColumn("max_upload_mb", limits.upload_mb(F.col("tier")))
        .filter(
            (F.col("max_upload_mb") > 0)
            & (F.col("size_bytes") > F.col("max_upload_mb").cast("bigint") * 1024 * 1024)
        )
    )


def usage_view(
    users: DataFrame, tiers: DataFrame, events: DataFrame, day: Column,
    limits: TierLimits = TierLimits(),
) -> DataFrame:
    """Per user: tier, operations of the day, limits and what is unlimited."""
    today = (
        events.filter(F.to_date("ts") == day).groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("_ops"))
    )
    seen = with_tier(users.select("user_id"), tiers).join(today, "user_id", "left")
    tier = F.col("tier")
    return seen.select(
        "user_id", "tier",
        F.coalesce("_ops", F.lit(0)).alias("ops_today"),
        limits.daily_ops(tier).alias("ops_limit"),
        (limits.daily_ops(tier) == 0).alias("ops_unlimited"),
        limits.upload_mb(tier).alias("max_upload_mb"),
        (limits.upload_mb(tier) == 0).alias("upload_unlimited"),
        F.when(tier == FREE, UPGRADE_HINT).alias("upgrade_hint"),
    )


def reject_audit(rejects: DataFrame, reason: str, target: Column, extra: list[str]) -> DataFrame:
    """Rejects as audit rows: ``user_id, action, target, metadata, created_at``."""
    metadata = F.to_json(F.struct(F.lit(reason).alias("reason"), F.col("tier"),
                                  *[F.col(c) for c in extra]))
    return rejects.select(
        "user_id", F.lit(REJECT_ACTION).alias("action"), target.alias("target"),
        metadata.alias("metadata"), F.col("ts").alias("created_at"),
    )


def quarantined(
    failures: DataFrame, count: int = 3, within: str = "5 minutes", step: str = "1 minute",
    minutes: int = 10,
) -> DataFrame:
    """Plugins that fail ``count`` times within a sliding window: ``plugin_id, failures,
    quarantined_from, quarantined_until``."""
    return (
        failures.groupBy("plugin_id", F.window("ts", within, step).alias("w"))
        .agg(F.count(F.lit(1)).alias("failures"))
        .filter(F.col("failures") >= count)
        .select(
            "plugin_id", "failures", F.col("w.end").alias("quarantined_from"),
            (F.col("w.end") + F.make_dt_interval(mins=F.lit(minutes))).alias("quarantined_until"),
        )
    )
