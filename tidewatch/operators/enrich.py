"""Log enrichment and routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.columns import as_map, nested, text_of

# Latency budget in ms and availability in per cent of each tier.
SLA_TIERS = {"platinum": (100, 99.99), "gold": (250, 99.9), "silver": (500, 99.5), "bronze": (1000, 99.0)}
# Cost centre of each service; any other service belongs to engineering.
COST_CENTERS = {
    "api-gateway": "platform", "auth-service": "platform", "user-service": "product", "order-service": "product",
    "payment-service": "product", "notification-service": "platform", "inventory-service": "product",
    "search-service": "analytics", "recommendation-engine": "analytics", "analytics-service": "analytics",
}
# Built-in routes per strategy: field and topic of each value.
BUILT_IN_ROUTES = {
    "by_level": ("level", {
        "ERROR": "logs-errors", "FATAL": "logs-errors", "WARN": "logs-warnings", "INFO": "logs-info", "DEBUG": "logs-debug",
    }),
    "by_log_type": ("log_type", {"application": "logs-application", "access": "logs-access", "metric": "logs-metrics"}),
    "by_environment": ("service.environment", {
        "production": "logs-prod", "staging": "logs-staging", "development": "logs-dev",
    }),
    "by_rules": None,
}
# Example custom routes: field, topic of each value, priority.
EXAMPLE_ROUTES = (
    ("level", {"FATAL": "logs-critical", "ERROR": "logs-errors"}, 100),
    ("service.name", {"payment-service": "logs-payments", "order-service": "logs-payments"}, 90),
    ("host.datacenter", {
        "dc-us-east-1": "logs-us-east", "dc-us-west-2": "logs-us-west", "dc-eu-west-1": "logs-europe",
        "dc-ap-south-1": "logs-asia",
    }, 50),
    ("sli.latency_category", {"critical": "logs-performance-issues", "very_slow": "logs-performance-issues"}, 80),
    ("sla.breach", {"true": "logs-sla-breaches"}, 95),
)
CHAIN_LIMIT = 10


def sla_check(df: DataFrame, tier: Column, latency: Column, tiers: dict = SLA_TIERS) -> DataFrame:
    """Budget and availability of the tier, breach (never for a latency of 0 or null) and what is left."""
    budget = as_map({k: v[0] for k, v in tiers.items()})[tier]
    target = as_map({k: v[1] for k, v in tiers.items()})[tier]
    known = F.coalesce(latency, F.lit(0)) != 0
    return df.withColumn("sla", F.struct(
        tier.alias("tier"),
        budget.alias("latency_budget_ms"),
        target.alias("availability_target"),
        F.when(known, latency > budget).otherwise(F.lit(False)).alias("breach"),
        F.when(known, F.greatest(F.lit(0), budget - latency)).alias("remaining_budget_ms"),
    ))


def sli_flags(df: DataFrame, latency: Column, status: Column, breach: Column | None = None) -> DataFrame:
    """Latency class, success (no status counts as 200) and whether the error budget is touched."""
    broken = F.col("sla.breach") if breach is None else breach
    return df.withColumn("sli", F.struct(
        latency_category(latency).alias("latency_category"),
        (F.coalesce(status, F.lit(200)) < 500).alias("success"),
        F.when(broken, 1).otherwise(0).alias("error_budget_impact"),
    ))


def latency_category(latency: Column) -> Column:
    """Unknown for 0 and null, then fast, normal, slow, very_slow, critical."""
    return (
        F.when(latency.isNull() | (latency == 0), "unknown").when(latency < 50, "fast").when(latency < 200, "normal")
        .when(latency < 500, "slow").when(latency < 2000, "very_slow").otherwise("critical")
    )


def correlation_chain(df: DataFrame, trace: str = "trace_id", span: str = "span_id", order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Depth, parent and root span of each row in its trace.

    A chain stores the first ten spans of a trace. Those are found by a per-trace limit that is applied before the
    shuffle, and each row then looks into the short list: no task orders a whole trace, however long it is.
    """
    pos = F.struct(*order)
    w = Window.partitionBy(trace).orderBy(*order)
    stored = (
        df.where(F.col(span).isNotNull() & F.col(trace).isNotNull())
        .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= CHAIN_LIMIT)
        .groupBy(F.col(trace).alias("_trace")).agg(
            F.array_sort(F.collect_list(F.struct(pos.alias("pos"), F.col(span).alias("span")))).alias("_spans"))
    )
    d = df.join(stored, F.col(trace) == F.col("_trace"), "left")
    earlier = F.coalesce(F.filter("_spans", lambda s: s["pos"] < pos), F.array().cast(stored.schema["_spans"].dataType))
    d = d.withColumn("_before", earlier)
    depth = F.size("_before")
    chain = F.struct(
        depth.alias("chain_depth"),
        F.when(depth > 0, F.get("_before", depth - 1)["span"]).alias("parent_span_id"),
        F.when(depth > 0, F.get("_before", F.lit(0))["span"]).otherwise(F.col(span)).alias("root_span_id"),
        (depth == 0).alias("is_root"),
    )
    return d.withColumn("correlation", F.when(F.col(trace).isNotNull(), chain)).drop("_trace", "_spans", "_before")


def cost_center(service: Column, mapping: dict[str, str] = COST_CENTERS, default: str = "engineering") -> Column:
    """E5: cost centre of a service."""
    return F.coalesce(as_map(mapping)[service], F.lit(default))


def level_from_status(status: Column) -> Column:
    """INFO below 400, WARN below 500, else ERROR."""
    return F.when(status < 400, "INFO").when(status < 500, "WARN").otherwise("ERROR")


def level_from_resources(cpu: Column, mem: Column) -> Column:
    """Level and message from CPU and memory use."""
    def row(level, message):
        return F.struct(F.lit(level).alias("level"), F.lit(message).alias("message"))
    return (
        F.when((cpu > 90) | (mem > 90), row("ERROR", "Resource usage critical"))
        .when((cpu > 75) | (mem > 80), row("WARN", "Resource usage high"))
        .otherwise(row("INFO", "System metrics collected"))
    )


def route_topic(df: DataFrame, strategy: str = "static", rules: Sequence[tuple] = (), default: str = "logs") -> Column:
    """Topic of each row.

    Custom rules run by priority, high first, before the built-in map of the strategy; the first match wins. Booleans
    compare as true and false. The strategies by service and by datacenter name the topic after the value.
    """
    if strategy == "static":
        return F.lit(default)
    if strategy == "by_service":
        name = nested(df, "service.name")
        return F.when(name != "", F.concat(F.lit("logs-"), name)).otherwise(F.lit(default))
    if strategy == "by_datacenter":
        dc = nested(df, "host.datacenter")
        return F.when(dc != "", F.concat(F.lit("logs-"), F.replace(dc, F.lit("dc-"), F.lit("")))).otherwise(F.lit(default))
    if strategy not in BUILT_IN_ROUTES:
        raise ValueError(f"unknown strategy {strategy}")
    ordered = sorted(rules, key=lambda r: -r[2])
    maps = [(field, values) for field, values, _ in ordered]
    if BUILT_IN_ROUTES[strategy]:
        maps.append(BUILT_IN_ROUTES[strategy])
    return F.coalesce(*[as_map(values)[text_of(nested(df, field))] for field, values in maps], F.lit(default))


def partition_key(df: DataFrame, field: str = "service.name") -> Column:
    """Key text of a row; null if missing or empty."""
    key = text_of(nested(df, field))
    return F.when(key != "", key)


def topic_stats(df: DataFrame) -> DataFrame:
    """Messages per topic."""
    return df.groupBy("topic").agg(F.count(F.lit(1)).alias("messages"))


def ingest_rate(df: DataFrame, window: str = "1 hour", sink: str = "sink") -> DataFrame:
    """Rows per second of each sink and window."""
    w = F.window("ts", window)
    seconds = (F.unix_micros(F.col("w.end")) - F.unix_micros(F.col("w.start"))) / F.lit(1e6)
    return df.groupBy(sink, w.alias("w")).agg(F.count(F.lit(1)).alias("rows")).select(
        sink, F.col("w.start").alias("window_start"), "rows", (F.col("rows") / seconds).alias("rows_per_second"))


def enrichment_stamp(df: DataFrame, custom: dict[str, str] | None = None, now=None, enricher: str = "tidewatch") -> DataFrame:
    """Constant custom fields and the version, time and name of the enrichment."""
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    out = df.withColumn("custom", as_map(custom)) if custom else df
    return out.withColumn("_enrichment", F.struct(
        F.lit("1.0").alias("version"), at.alias("timestamp"), F.lit(enricher).alias("enricher")))
