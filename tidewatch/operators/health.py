"""Service health and delivery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.slices import SLICE, neighbour, null_safe_join, running_totals, slice_of
from tidewatch.operators.search import monitoring_summary

SLA_TARGET = 99.9
# Replica limits and the reset timeout of a breaker in seconds.
MIN_REPLICAS, MAX_REPLICAS = 2, 20
RESET_TIMEOUT = 60


def health_streaks(checks: DataFrame, keys: Sequence[str] = ("service",), order: Sequence[str] = ("ts", "event_id"), seconds: int = 3600) -> DataFrame:
    """Failures in a row up to each check, and the time of the last healthy check.

    Streaks are counted inside time slices; a slice passes on the failures at its end, and slices without a healthy
    check add up. The table that links slices has one row per service and slice.
    """
    healthy = F.col("status") == "healthy"
    d = checks.withColumn(SLICE, slice_of(F.col("ts"), seconds))
    part = [*keys, SLICE]
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_island": F.count_if(healthy).over(upto), "_ok": F.max(F.when(healthy, F.col("ts"))).over(upto)})
    island = Window.partitionBy(*part, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_run", F.count_if(~healthy).over(island))
    ends = d.groupBy(*part).agg(
        F.max_by("_run", F.struct(*order)).alias("_end"), F.max("_island").alias("_healthy"), F.max("_ok").alias("_last"))
    along = Window.partitionBy(*keys).orderBy(SLICE)
    ends = ends.withColumn("_seg", F.count_if(F.col("_healthy") > 0).over(along.rowsBetween(Window.unboundedPreceding, 0)))
    seg = Window.partitionBy(*keys, "_seg").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_out", F.sum("_end").over(seg))
    ends = ends.select(
        *part, F.lag("_out").over(along).alias("_in"),
        F.max("_last").over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    d = null_safe_join(d, ends, part)
    return d.select(
        *checks.columns,
        (F.col("_run") + F.when(F.col("_island") == 0, F.coalesce("_in", F.lit(0))).otherwise(0)).alias("consecutive_failures"),
        F.coalesce("_ok", "_before").alias("last_success"),
    )


def availability(checks: DataFrame, keys: Sequence[str] = ("service",), order: Sequence[str] = ("ts", "event_id"), sla: float = SLA_TARGET, seconds: int = 3600) -> DataFrame:
    """Share of time in which the latest check was healthy, outages, mean time to repair and between failures.

    An outage is a run of checks that are not healthy. Time after the last check does not count.
    """
    d = neighbour(checks, keys, "ts", order, F.col("ts"), "_next", seconds, following=True)
    d = neighbour(d, keys, "ts", order, F.col("status") == "healthy", "_was", seconds)
    ok = F.col("status") == "healthy"
    secs = F.coalesce((F.unix_micros("_next") - F.unix_micros("ts")) / F.lit(1e6), F.lit(0.0))
    last_ok = F.max_by(ok, F.struct(*order))
    first_bad = F.coalesce(F.max_by("_next", F.when(ok, F.struct(*order))), F.min("ts"))
    d = d.groupBy(*keys).agg(
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1e6)).alias("total_seconds"),
        F.coalesce(F.sum(F.when(~ok, secs)), F.lit(0.0)).alias("downtime_seconds"),
        F.count_if(~ok & F.coalesce(F.col("_was"), F.lit(True))).alias("incident_count"),
        F.when(last_ok, 0).otherwise(1).alias("_open"),
        F.when(last_ok, 0.0).otherwise((F.unix_micros(F.max("ts")) - F.unix_micros(first_bad)) / F.lit(1e6)).alias("_open_seconds"),
    )
    up = F.col("total_seconds") - F.col("downtime_seconds")
    pct = F.when(F.col("total_seconds") > 0, up / F.col("total_seconds") * 100).otherwise(F.lit(100.0))
    repaired = F.col("incident_count") - F.col("_open")
    return d.select(
        *keys, "total_seconds", "downtime_seconds", pct.alias("uptime_percentage"), F.lit(sla).alias("sla_target"),
        (pct >= sla).alias("sla_met"), "incident_count",
        F.when(repaired > 0, (F.col("downtime_seconds") - F.col("_open_seconds")) / repaired).alias("mttr_seconds"),
        F.when(F.col("incident_count") > 0, up / F.col("incident_count")).alias("mtbf_seconds"),
    )


def deployment_history(events: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """D3: one row per deployment: the first event gives version, strategy and start, the last one the status.

    The duration is known for completed deployments only; canary fields are kept for the canary strategy.
    """
    pos = F.struct(*order)
    done = F.max(F.when(F.col("status") == "completed", F.col("ts")))
    d = events.groupBy("deployment_id").agg(
        F.min_by("version", pos).alias("version"), F.min_by("strategy", pos).alias("strategy"), F.min("ts").alias("started_at"),
        F.max_by("status", pos).alias("status"), done.alias("completed_at"),
        F.max_by("canary_percentage", pos).alias("_canary"), F.count(F.lit(1)).alias("events"),
    )
    return d.withColumns({
        "duration_seconds": (F.unix_micros("completed_at") - F.unix_micros("started_at")) / F.lit(1e6),
        "canary_percentage": F.when(F.col("strategy") == "canary", F.col("_canary")),
    }).drop("_canary")


def scaling_events(events: DataFrame, low: int = MIN_REPLICAS, high: int = MAX_REPLICAS) -> DataFrame:
    """Replica limits filled in and the change of each event."""
    return events.withColumns({
        "min_replicas": F.coalesce("min_replicas", F.lit(low)), "max_replicas": F.coalesce("max_replicas", F.lit(high)),
        "replica_delta": F.col("replicas_after") - F.col("replicas_before"),
    })


def scaling_counts(events: DataFrame) -> DataFrame:
    """Events and summed change by event type and trigger."""
    return scaling_events(events).groupBy("event_type", "scale_trigger").agg(
        F.count(F.lit(1)).alias("events"), F.sum("replica_delta").cast("bigint").alias("replica_delta"))


def circuit_breaker_state(events: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Latest state of each breaker, and the last time it opened."""
    pos = F.struct(*order)
    return events.groupBy("name").agg(
        F.max_by("state", pos).alias("state"), F.max_by("failure_count", pos).alias("failure_count"),
        F.max(F.when(F.col("state") == "open", F.col("ts"))).alias("last_failure"),
        F.coalesce(F.max_by("reset_timeout", pos), F.lit(RESET_TIMEOUT)).alias("reset_timeout"),
    )


def incident_lifecycle(events: DataFrame, order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """One row per incident episode. A resolved event closes it; a later event with the same id opens another."""
    resolved = F.col("status") == "resolved"
    d = running_totals(
        events, ["incident_id"], order[0], order, {"episode": F.when(resolved, 1).otherwise(0).cast("bigint")}, 3600, include_current=False)
    pos = F.struct(*order)
    d = d.groupBy("incident_id", "episode").agg(
        F.min_by("severity", pos).alias("severity"), F.max_by("status", pos).alias("status"),
        F.min("ts").alias("started_at"), F.count(F.lit(1)).alias("events"),
        F.max(F.when(resolved, F.col("ts"))).alias("resolved_at"),
    )
    return d.withColumn(
        "duration_seconds", F.floor((F.unix_micros("resolved_at") - F.unix_micros("started_at")) / F.lit(1e6)).cast("bigint"))


def incident_totals(episodes: DataFrame) -> DataFrame:
    return episodes.agg(
        F.count(F.lit(1)).alias("incidents"), F.count_if(F.col("resolved_at").isNull()).alias("open_incidents"),
        F.avg("duration_seconds").alias("avg_duration_seconds"))


def system_status(checks: DataFrame, deployments: DataFrame, incidents: DataFrame, breakers: DataFrame, resources: DataFrame) -> DataFrame:
    """One row: latest health, availability over all checks, deployments and incidents under way, breakers, means."""
    pos = F.struct("ts", "event_id")
    health = checks.agg(F.coalesce(F.max_by("status", pos), F.lit("unknown")).alias("health"))
    # the checks of all services are one history, so they are ordered by the minute
    avail = availability(checks.withColumn("_all", F.lit(1)), ["_all"], seconds=60)
    states = circuit_breaker_state(breakers)
    rows = [
        health,
        avail.select("uptime_percentage", "sla_met", "incident_count"),
        deployment_history(deployments).agg(F.count_if(~F.col("status").isin("completed", "failed")).alias("active_deployments")),
        incident_lifecycle(incidents).agg(F.count_if(F.col("resolved_at").isNull()).alias("active_incidents")),
        states.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "state")))).alias("circuit_breakers")),
        resources.agg(F.avg("cpu").alias("cpu_percent"), F.avg("mem").alias("memory_percent")),
    ]
    report = monitoring_summary({f"part{i}": row for i, row in enumerate(rows)})
    return report.select(*[F.col(f"part{i}")[c].alias(c) for i, row in enumerate(rows) for c in row.columns])


def health_status_counts(checks: DataFrame, n: int = 5) -> DataFrame:
    """The most frequent statuses."""
    return checks.groupBy("status").agg(F.count(F.lit(1)).alias("checks")).orderBy(F.desc("checks"), "status").limit(n)


def resource_usage_over_time(metrics: DataFrame, window: str = "1 day") -> DataFrame:
    """Mean CPU and memory per time bucket."""
    return metrics.groupBy(F.window("ts", window)["start"].alias("bucket")).agg(F.avg("cpu").alias("cpu"), F.avg("mem").alias("mem"))
