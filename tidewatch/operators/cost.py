"""Cost, budget and value of AI requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.slices import null_safe_join, running_totals, trailing_totals

# Rate per 1000 tokens where a model has no price.
DEFAULT_INPUT_RATE = 0.001
DEFAULT_OUTPUT_RATE = 0.002
# Spending limits in dollars and the shares at which an alert is due.
LIMITS = {"daily": 1000.0, "weekly": 5000.0, "monthly": 15000.0}
ALERT_SHARES = (50, 75, 90, 100)
ALLOCATION_DIMENSIONS = ("team", "project", "department", "application")
MONEY = "decimal(20,10)"
PERIODS = {"daily": "day", "weekly": "week", "monthly": "month"}


def price_lookup(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """rate per 1000 tokens of the priced, enabled model; the default for cost, 0 in the pricing columns.

    The price list has one row per model, so it is small by nature; Spark broadcasts it when its size allows.
    """
    priced = rates.where("enabled").select(
        "provider", "model", F.col("input_per_1k").cast("double").alias("_in"), F.col("output_per_1k").cast("double").alias("_out")
    )
    return usage.join(priced, ["provider", "model"], "left").select(
        *usage.columns,
        F.coalesce("_in", F.lit(DEFAULT_INPUT_RATE)).alias("input_rate"),
        F.coalesce("_out", F.lit(DEFAULT_OUTPUT_RATE)).alias("output_rate"),
        F.coalesce("_in", F.lit(0.0)).alias("pricing_input"),
        F.coalesce("_out", F.lit(0.0)).alias("pricing_output"),
    )


def request_cost(usage: DataFrame, rates: DataFrame) -> DataFrame:
    """input (without cached tokens), output and total cost, and what the cache saved."""
    k = F.lit(1000.0)
    d = price_lookup(usage, rates).withColumns({
        "input_cost": F.greatest(F.lit(0), F.col("input_tokens") - F.col("cached_tokens")) / k * F.col("input_rate"),
        "output_cost": F.col("output_tokens") / k * F.col("output_rate"),
        "cached_savings": F.col("cached_tokens") / k * F.col("input_rate"),
    })
    return d.withColumn("total_cost", F.col("input_cost") + F.col("output_cost"))


def period_start(period: str):
    return F.date_trunc(PERIODS[period], F.col("ts"))


def period_spend(costs: DataFrame, period: str = "daily", keys: Sequence[str] = ("provider", "model")) -> DataFrame:
    """running spend within the UTC day, week (Monday) or month, per key (pass no keys for the overall one)."""
    d = costs.withColumn("period_start", period_start(period))
    return running_totals(
        d, [*keys, "period_start"], "ts", ["ts", "request_id"], {"spent": F.col("total_cost").cast(MONEY)}
    )


def budget_level(share):
    return (
        F.when(share >= 100, "exceeded").when(share >= 90, "warning_90")
        .when(share >= 75, "warning_75").when(share >= 50, "warning_50").otherwise("normal")
    )


def budget_status(costs: DataFrame, limits: dict[str, float] = LIMITS) -> DataFrame:
    """spend so far in the day, week and month of each request, what is left of the day, and the alert level."""
    # all periods begin on a minute, so a table of minutes holds what lies before each; rows are ordered in their minute
    minute = F.date_trunc("minute", "ts")
    d = costs.withColumns({"_minute": minute, "_cost": F.col("total_cost").cast(MONEY)})
    minutes = d.groupBy("_minute").agg(F.sum("_cost").alias("_sum"))
    for name, unit in PERIODS.items():
        before = Window.partitionBy(F.date_trunc(unit, "_minute")).orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
        minutes = minutes.withColumn(f"_{name}", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    d = null_safe_join(d, minutes.drop("_sum"), ["_minute"])
    inside = F.sum("_cost").over(Window.partitionBy("_minute").orderBy("ts", "request_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    d = d.withColumns({f"{name}_spent": (F.col(f"_{name}") + F.col("_inside")).cast("double") for name in PERIODS})
    d = d.drop("_minute", "_cost", "_inside", *[f"_{name}" for name in PERIODS])
    daily = F.lit(float(limits["daily"]))
    share = F.when(daily > 0, F.col("daily_spent") / daily * 100).otherwise(F.lit(0.0))
    return d.withColumns({
        "daily_remaining": F.greatest(F.lit(0.0), daily - F.col("daily_spent")),
        "percentage_used": share,
        "alert_level": budget_level(share),
    })


def cost_by_allocation(costs: DataFrame, dims: Sequence[str] = ALLOCATION_DIMENSIONS) -> DataFrame:
    """spend per value of each dimension; empty values are left out. One pass over the data."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims
    ]))
    return (
        costs.select("total_cost", pairs.alias("p")).select("p.*", "total_cost")
        .where("value IS NOT NULL AND value <> ''")
        .groupBy("dimension", "value")
        .agg(F.sum(F.col("total_cost").cast(MONEY)).cast("double").alias("total_cost"), F.count(F.lit(1)).alias("requests"))
    )


def roi_facts(costs: DataFrame) -> DataFrame:
    """value per dollar; 0 for a free request."""
    ratio = F.when(F.col("total_cost") > 0, F.col("business_value") / F.col("total_cost")).otherwise(F.lit(0.0))
    return costs.withColumn("roi_ratio", ratio)


def roi_summary(costs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """cost, value, their ratio, conversions, conversion rate and cost per conversion."""
    d = costs.groupBy(*keys).agg(
        F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum(F.col("business_value").cast("double")), F.lit(0.0)).alias("total_value"),
        F.count_if("conversion").alias("conversions"),
        F.count(F.lit(1)).alias("_n"),
    )
    def ratio(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return d.withColumns({
        "roi_ratio": ratio("total_value", "total_cost"),
        "conversion_rate": ratio("conversions", "_n"),
        "avg_cost_per_conversion": ratio("total_cost", "conversions"),
    }).drop("_n")


def usage_pattern(df: DataFrame) -> DataFrame:
    """F8: UTC hour, weekday from Monday 0, and whether it is a peak hour (9 to 17)."""
    return df.withColumns({
        "hour_of_day": F.hour("ts"), "day_of_week": F.weekday("ts"), "is_peak": F.hour("ts").between(9, 17),
    })


def request_frequency(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """class of the number of earlier requests of the scope in the last 60 seconds."""
    d = trailing_totals(df, keys, "ts", "request_id", {"recent_requests": F.lit(1).cast("bigint")}, 60, 60)
    n = F.col("recent_requests")
    return d.withColumn(
        "request_frequency",
        F.when(n > 100, "very_high").when(n > 50, "high").when(n > 10, "medium").otherwise("low"),
    )


# Costs are counted in whole units of 1e-10 dollars, so that sums and variances of equal costs are exact.
_UNIT = 10_000_000_000


def _units():
    return F.round(F.col("total_cost") * F.lit(float(_UNIT))).cast("decimal(18,0)")


def _last_hour(costs: DataFrame, keys: Sequence[str]) -> DataFrame:
    u = _units()
    return trailing_totals(
        costs, keys, "ts", "request_id",
        {"_n": F.lit(1).cast("bigint"), "_u": u, "_uu": (u * u).cast("decimal(28,0)")}, 3600, 60,
    )


def cost_forecast(costs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """once the scope has ten earlier requests: mean cost of the last hour times its request count times 24."""
    d = _last_hour(costs, keys)
    d = running_totals(d, keys, "ts", ["ts", "request_id"], {"_seen": F.lit(1).cast("bigint")}, 3600, include_current=False)
    daily = F.when((F.col("_seen") >= 10) & (F.col("_n") > 0), F.col("_u").cast("double") / _UNIT * 24).otherwise(F.lit(0.0))
    return d.withColumns({
        "predicted_daily_cost": daily, "predicted_monthly_cost": daily * 30,
    }).withColumnRenamed("_n", "requests_last_hour").drop("_u", "_uu", "_seen")


def cost_trend(costs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """later half of the last hour's costs against the earlier half: above 1.2 times, below 0.8 times.

    The halves come from running sums by position: the sums at the middle position are looked up by an equi-join
    on (scope, position), whose keys are unique.
    """
    d = _last_hour(costs, keys)
    d = running_totals(
        d, keys, "ts", ["ts", "request_id"], {"_pos": F.lit(1).cast("bigint"), "_sum": _units()}, 60, include_current=False
    )
    at = d.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_pos").alias("_at"), F.col("_sum").alias("_at_sum"))
    cond = (F.col("_pos") - F.col("_n") + F.floor(F.col("_n") / 2)) == F.col("_at")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    d = d.join(at, cond, "left")
    later = (F.col("_sum") - F.col("_at_sum")).cast("double")
    earlier = F.col("_u").cast("double") - later
    trend = (
        F.when(F.col("_n") < 2, F.lit(None).cast("string"))
        .when(later > earlier * 1.2, "increasing").when(later < earlier * 0.8, "decreasing").otherwise("stable")
    )
    return d.withColumn("trend", trend).select(*costs.columns, F.col("_n").alias("requests_last_hour"), "trend")


def cost_anomaly(costs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """distance of the cost from the mean of the last hour's earlier costs, in population deviations."""
    d = _last_hour(costs, keys)
    n = F.col("_n").cast("decimal(12,0)")
    spread = (n * F.col("_uu") - (F.col("_u") * F.col("_u")).cast("decimal(38,0)")).cast("double")
    std = F.when(spread > 0, F.sqrt(spread) / F.col("_n") / _UNIT).otherwise(F.lit(1.0))
    mean = F.col("_u").cast("double") / F.col("_n") / _UNIT
    z = F.when(F.col("_n") >= 5, F.abs(F.col("total_cost") - mean) / std)
    return d.withColumn("_z", z).select(
        *costs.columns,
        F.least(F.lit(1.0), F.coalesce(F.col("_z") / 3, F.lit(0.0))).alias("anomaly_score"),
        F.coalesce(F.col("_z") > 2, F.lit(False)).alias("anomaly_detected"),
    )


def cost_summary(costs: DataFrame, as_of, limits: dict[str, float] = LIMITS) -> DataFrame:
    """spend of the day, week and month of ``as_of``: total, by model, budget and share used."""
    now = F.lit(as_of).cast("timestamp")
    d = costs.where(F.col("ts") <= now)
    named = F.explode(F.filter(F.array(*[
        F.when(F.date_trunc(unit, "ts") == F.date_trunc(unit, now), F.lit(name)) for name, unit in PERIODS.items()
    ]), lambda x: x.isNotNull()))
    # No period starts before the week or month of as_of; say so in a form the scan can use.
    first = F.least(F.date_trunc("week", now), F.date_trunc("month", now))
    per_model = (
        d.where(F.col("ts") >= first).select(named.alias("period"), "provider", "model", "total_cost")
        .groupBy("period", "provider", "model").agg(F.sum("total_cost").alias("cost"))
    )
    entry = F.struct(F.concat("provider", F.lit(":"), "model").alias("k"), F.col("cost").alias("v"))
    budget = F.create_map(*[x for n, v in limits.items() for x in (F.lit(n), F.lit(float(v)))])
    return per_model.groupBy("period").agg(
        F.sum("cost").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("by_model"),
    ).withColumn("budget", budget[F.col("period")]).withColumn(
        "percentage_used", F.when(F.col("budget") > 0, F.col("total") / F.col("budget") * 100).otherwise(F.lit(0.0))
    )


def optimization_recommendations(facts: DataFrame) -> DataFrame:
    """rows for a cache hit rate under 10 %, compression under 50 %, and a model above half of the spend."""
    per_model = facts.groupBy("provider", "model").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("cache_hit").alias("hits"),
        F.count_if("prompt_compressed").alias("packed"), F.sum("total_cost").alias("cost"),
    )
    by_model = per_model.groupBy("model").agg(*[F.sum(c).alias(c) for c in ("n", "hits", "packed", "cost")])
    totals = by_model.agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "hits", "packed", "cost")])

    def row(kind, priority, subject, value):
        return F.struct(
            F.lit(kind).alias("type"), F.lit(priority).alias("priority"), subject.alias("model"), value.alias("value")
        )

    hit_rate = F.col("all_hits") / F.col("all_n")
    packed_rate = F.col("all_packed") / F.col("all_n")
    general = totals.where("all_n > 0").select(F.explode(F.filter(F.array(
        F.when(hit_rate < 0.1, row("caching", "high", F.lit(None).cast("string"), hit_rate)),
        F.when(packed_rate < 0.5, row("compression", "medium", F.lit(None).cast("string"), packed_rate)),
    ), lambda x: x.isNotNull())).alias("r")).select("r.*")
    costly = by_model.crossJoin(F.broadcast(totals)).where(F.col("cost") > F.col("all_cost") * 0.5).select(
        F.lit("model_selection").alias("type"), F.lit("medium").alias("priority"), "model", F.col("cost").alias("value")
    )
    return general.unionByName(costly)


def budget_alerts(costs: DataFrame, limit: float = LIMITS["daily"], shares: Sequence[int] = ALERT_SHARES) -> DataFrame:
    """one row per day that reached a share of the budget, with the highest share reached."""
    days = costs.groupBy(F.to_date("ts").alias("day")).agg(F.sum("total_cost").alias("spent"))
    used = F.col("spent") / F.lit(float(limit)) * 100 if limit > 0 else F.lit(0.0)
    d = days.withColumn("current_percentage", used).withColumn(
        "threshold",
        F.array_max(F.filter(F.array(*[F.lit(int(s)) for s in shares]), lambda s: s <= F.col("current_percentage"))),
    ).where("threshold IS NOT NULL")
    return d.select(
        "day", F.lit("budget_threshold").alias("type"), "threshold", "current_percentage",
        F.when(F.col("threshold") >= 100, "critical").otherwise("warning").alias("severity"),
        F.format_string("Daily budget %d%% threshold reached", "threshold").alias("message"),
        "spent", F.lit(float(limit)).alias("budget"),
    )


def daily_cost_series(costs: DataFrame) -> DataFrame:
    """F16: spend per day from the first to the last day, empty days as 0."""
    days = costs.groupBy(F.to_date("ts").alias("day")).agg(F.sum("total_cost").alias("total_cost"))
    spine = days.agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(days, "day", "left").withColumn("total_cost", F.coalesce("total_cost", F.lit(0.0)))


def top_models_by_cost(costs: DataFrame, n: int = 10) -> DataFrame:
    """the most expensive models."""
    by_model = costs.groupBy("model").agg(F.sum("total_cost").alias("total_cost"))
    return by_model.orderBy(F.desc("total_cost"), "model").limit(n)


def savings_rollup(facts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """cached and fallback savings, and the share of batched and of compressed requests."""
    def share(c):
        return F.avg(F.col(c).cast("int")).alias(f"{c}_share")
    return facts.groupBy(*keys).agg(
        F.sum("cached_savings").alias("cached_savings"), F.sum(F.col("fallback_savings").cast("double")).alias("fallback_savings"),
        share("batch_used"), share("prompt_compressed"),
    )
