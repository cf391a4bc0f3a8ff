"""Registered queries of T and F."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import cost, requests
from tidewatch.plans.fixtures import with_fixtures
from tidewatch.plans.registry import query
from tidewatch.session import work_dir

AS_OF = "2024-01-20 12:00:00"

COSTS_SQL = with_fixtures("ai_requests", "price_rates") + """, costs AS (
SELECT a.*, coalesce(r.input_per_1k, 0.001) AS input_rate, coalesce(r.output_per_1k, 0.002) AS output_rate,
  greatest(0, input_tokens - cached_tokens) / 1000.0 * CAST(coalesce(r.input_per_1k, 0.001) AS DOUBLE) AS input_cost,
  output_tokens / 1000.0 * CAST(coalesce(r.output_per_1k, 0.002) AS DOUBLE) AS output_cost,
  cached_tokens / 1000.0 * CAST(coalesce(r.input_per_1k, 0.001) AS DOUBLE) AS cached_savings,
  greatest(0, input_tokens - cached_tokens) / 1000.0 * CAST(coalesce(r.input_per_1k, 0.001) AS DOUBLE)
    + output_tokens / 1000.0 * CAST(coalesce(r.output_per_1k, 0.002) AS DOUBLE) AS total_cost,
  CAST(coalesce(r.input_per_1k, 0) AS DOUBLE) AS pricing_input, CAST(coalesce(r.output_per_1k, 0) AS DOUBLE) AS pricing_output
FROM ai_requests a LEFT JOIN price_rates r ON a.provider = r.provider AND a.model = r.model AND r.enabled
)"""
REQ_SQL = with_fixtures("ai_requests")

PCT = """list_sort(list(latency_ms))[CAST(floor(count(*) * {p}::DOUBLE) AS BIGINT) + 1]"""
P50, P95, P99 = (PCT.format(p=p) for p in ("0.5", "0.95", "0.99"))


def costs(t):
    return cost.request_cost(t.ai_requests, t.price_rates)


def r(col, places=6):
    return F.round(F.col(col).cast("double"), places).alias(col)


@query("flagship_hourly_levels", COSTS_SQL + f""",
levels AS (
  SELECT provider, model, date_trunc('hour', ts) AS window_start, count(*) AS requests,
    {P50} AS p50, {P95} AS p95, {P99} AS p99,
    100.0 * count(*) FILTER (WHERE status <> 'success') / count(*) AS error_rate, sum(total_cost) AS total_cost
  FROM costs GROUP BY 1, 2, 3)
SELECT provider, model, window_start, requests, p50, p95, p99, round(error_rate, 6) AS error_rate,
  round(total_cost, 9) AS total_cost,
  CAST((CASE WHEN p50 > 500 THEN 1 ELSE 0 END) + (CASE WHEN p95 > 2000 THEN 1 ELSE 0 END)
   + (CASE WHEN p99 > 5000 THEN 1 ELSE 0 END) + (CASE WHEN error_rate > 1 THEN 1 ELSE 0 END) AS BIGINT) AS violations
FROM levels""")
def flagship(t):
    """Per model and hour: requests, error rate, exact percentiles, cost and the number of broken limits."""
    keys = ["provider", "model", "window_start"]
    levels = requests.service_levels(costs(t), window="1 hour", also={"total_cost": F.sum("total_cost")})
    return levels.select(
        *keys, "requests", "p50", "p95", "p99", r("error_rate"), r("total_cost", 9),
        F.size(requests.violations_of()).cast("bigint").alias("violations"))


@query("t1_request_facts", REQ_SQL + """
SELECT request_id, CAST(input_tokens + output_tokens AS BIGINT) AS tokens_total,
  round(CASE WHEN latency_ms > 0 THEN (input_tokens + output_tokens) / (latency_ms / 1000.0) ELSE 0 END, 6) AS tokens_per_second
FROM ai_requests""")
def _(t):
    return requests.request_facts(t.ai_requests).select(
        "request_id", F.col("tokens_total").cast("bigint").alias("tokens_total"), r("tokens_per_second"))


T2_SQL = REQ_SQL + f"""
SELECT provider, model, {P50} AS p50, {P95} AS p95, {P99} AS p99, min(latency_ms) AS min, max(latency_ms) AS max,
  round(avg(latency_ms), 6) AS avg, count(*) AS count FROM ai_requests GROUP BY provider, model"""


@query("t2_latency_percentiles", T2_SQL)
def _(t):
    return requests.latency_percentiles(t.ai_requests).withColumn("avg", F.round("avg", 6))


@query("t2_latency_percentiles_overall", T2_SQL.replace("provider, model, ", "").replace(" GROUP BY provider, model", ""))
def _(t):
    return requests.latency_percentiles(t.ai_requests, ()).withColumn("avg", F.round("avg", 6))


@query("t2_stored_sketches", REQ_SQL + """
SELECT provider, model, date_trunc('day', ts) AS window_start, count(latency_ms) AS requests, min(latency_ms) AS min, max(latency_ms) AS max, round(avg(latency_ms), 6) AS avg,
  true AS p50_within, true AS p95_within, true AS p99_within FROM ai_requests WHERE latency_ms IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    """Minutes in a table, merged into days: each percentile lies within two per cent of its rank among the day's requests."""
    path = work_dir(t.spark, "sketches")
    requests.latency_sketches(t.ai_requests).write.parquet(path)
    days = requests.sketched_percentiles(requests.merge_sketches(t.spark.read.parquet(path), window="1 day"))
    d = t.ai_requests.where("latency_ms IS NOT NULL").withColumn("window_start", F.date_trunc("day", "ts"))
    joined = d.select("provider", "model", "window_start", "latency_ms").join(days, ["provider", "model", "window_start"])
    share = {n: F.count_if(F.col("latency_ms") < F.col(n)) / F.count(F.lit(1)) for n in requests.QUANTILES}
    upto = {n: F.count_if(F.col("latency_ms") <= F.col(n)) / F.count(F.lit(1)) for n in requests.QUANTILES}
    within = [((share[n] <= p + 0.02) & (upto[n] >= p - 0.02)).alias(f"{n}_within") for n, p in requests.QUANTILES.items()]
    return joined.groupBy("provider", "model", "window_start", F.col("count").alias("requests"), "min", "max", F.round("avg", 6).alias("avg")).agg(*within)


@query("t3_error_rate", REQ_SQL + """
SELECT provider, model, date_trunc('day', ts) AS window_start, count(*) AS requests,
  count(*) FILTER (WHERE status <> 'success') AS errors,
  round(100.0 * count(*) FILTER (WHERE status <> 'success') / count(*), 6) AS error_rate
FROM ai_requests GROUP BY 1, 2, 3""")
def _(t):
    return requests.error_rate(t.ai_requests, window="1 day").withColumn("error_rate", F.round("error_rate", 6))


@query("t4_windowed_requests", REQ_SQL + """
SELECT provider, model, date_trunc('minute', ts) AS window_start, count(*) AS requests,
  count(*) FILTER (WHERE status <> 'success') AS errors, round(sum(latency_ms), 4) AS latency_sum,
  min(latency_ms) AS latency_min, max(latency_ms) AS latency_max FROM ai_requests GROUP BY 1, 2, 3""")
def _(t):
    return requests.windowed_requests(t.ai_requests).withColumn("latency_sum", F.round("latency_sum", 4))


LEVELS_SQL = REQ_SQL + f""", levels AS (
  SELECT provider, model, date_trunc('hour', ts) AS window_start, {P50} AS p50, {P95} AS p95, {P99} AS p99,
    100.0 * count(*) FILTER (WHERE status <> 'success') / count(*) AS error_rate
  FROM ai_requests GROUP BY 1, 2, 3),
long AS (
  SELECT provider, model, window_start, 'latency_p50' AS k, p50 AS value, 500.0 AS warning, 1000.0 AS critical FROM levels
  UNION ALL SELECT provider, model, window_start, 'latency_p95', p95, 2000, 5000 FROM levels
  UNION ALL SELECT provider, model, window_start, 'latency_p99', p99, 5000, 10000 FROM levels
  UNION ALL SELECT provider, model, window_start, 'error_rate', error_rate, 1, 5 FROM levels),
violations AS (
  SELECT provider, model, window_start, concat(k, '_', CASE WHEN value > critical THEN 'critical' ELSE 'warning' END) AS type,
    value, CAST(CASE WHEN value > critical THEN critical ELSE warning END AS DOUBLE) AS threshold,
    CASE WHEN value > critical THEN 'critical' ELSE 'warning' END AS severity
  FROM long WHERE value > warning)"""


def hourly_violations(t):
    levels = requests.service_levels(t.ai_requests, window="1 hour")
    return requests.latency_violations(levels, ["provider", "model", "window_start"])


@query("t5_latency_violations", LEVELS_SQL + """
SELECT provider, model, window_start, type, round(value, 6) AS value, threshold, severity FROM violations""")
def _(t):
    return hourly_violations(t).withColumn("value", F.round("value", 6))


@query("t6_technical_summary", REQ_SQL + f""", levels AS (
  SELECT provider, model, {P50} AS p50, {P95} AS p95, {P99} AS p99, count(*) AS requests,
    100.0 * count(*) FILTER (WHERE status <> 'success') / count(*) AS error_rate,
    CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS BIGINT) AS window_age_us
  FROM ai_requests GROUP BY 1, 2)
SELECT provider, model, p50, p95, p99, requests, round(error_rate, 6) AS error_rate, window_age_us,
  array_to_string(list_sort(list_filter([
    CASE WHEN p50 > 1000 THEN 'latency_p50_critical' WHEN p50 > 500 THEN 'latency_p50_warning' END,
    CASE WHEN p95 > 5000 THEN 'latency_p95_critical' WHEN p95 > 2000 THEN 'latency_p95_warning' END,
    CASE WHEN p99 > 10000 THEN 'latency_p99_critical' WHEN p99 > 5000 THEN 'latency_p99_warning' END,
    CASE WHEN error_rate > 5 THEN 'error_rate_critical' WHEN error_rate > 1 THEN 'error_rate_warning' END
  ], lambda x: x IS NOT NULL)), ',') AS violation_types
FROM levels""")
def _(t):
    return requests.technical_summary(t.ai_requests).select(
        "provider", "model", "p50", "p95", "p99", "requests", r("error_rate"), "window_age_us",
        F.array_join(F.transform("violations", lambda v: v["type"]), ",").alias("violation_types"))


CHUNKS_SQL = """SELECT CAST(floor(event_id / 8) AS BIGINT) AS request_id, ts,
  CASE WHEN event_id % 8 = 0 THEN 'start' WHEN event_id % 8 = 7 THEN CASE WHEN event_type = 'error' THEN 'exception' ELSE 'end' END
       ELSE 'chunk' END AS kind, CAST(event_id % 5 AS BIGINT) AS tokens FROM events"""


@query("t7_streaming_trace", f"""WITH chunks AS ({CHUNKS_SQL}), s AS (
  SELECT request_id, min(ts) FILTER (WHERE kind = 'start') AS t0, min(ts) FILTER (WHERE kind = 'chunk') AS c0,
    max(ts) FILTER (WHERE kind = 'chunk') AS c1, max(ts) FILTER (WHERE kind IN ('end', 'exception')) AS t1,
    count(*) FILTER (WHERE kind = 'chunk') AS chunks_count, coalesce(sum(tokens) FILTER (WHERE kind = 'chunk'), 0) AS tokens,
    count(*) FILTER (WHERE kind = 'exception') AS bad FROM chunks GROUP BY request_id)
SELECT request_id, round((epoch_us(c0) - epoch_us(t0)) / 1000.0, 3) AS ttft_ms, round((epoch_us(c1) - epoch_us(t0)) / 1000.0, 3) AS last_chunk_ms,
  chunks_count, round((epoch_us(t1) - epoch_us(t0)) / 1000.0, 3) AS total_ms, CAST(tokens AS BIGINT) AS tokens,
  CASE WHEN bad > 0 THEN 'error' ELSE 'success' END AS status FROM s""")
def _(t):
    chunks = t.spark.sql(CHUNKS_SQL.replace("FROM events", "FROM {e}"), e=t.events)
    return requests.streaming_trace(chunks).withColumns({c: F.round(c, 3) for c in ("ttft_ms", "last_chunk_ms", "total_ms")})


@query("t8_requests_per_minute", REQ_SQL + """
SELECT provider, model, date_trunc('minute', ts) AS window_start, count(*) AS requests,
  CASE WHEN count(*) < 10 THEN 'low' WHEN count(*) > 10000 THEN 'high' ELSE 'normal' END AS throughput
FROM ai_requests GROUP BY 1, 2, 3""")
def _(t):
    return requests.requests_per_minute(t.ai_requests)


@query("t9_latency_histogram", REQ_SQL + """
SELECT CAST(floor(latency_ms / 100) * 100 AS BIGINT) AS latency_from, count(*) AS requests FROM ai_requests GROUP BY 1""")
def _(t):
    return requests.latency_histogram(t.ai_requests)


@query("t10_status_over_time", REQ_SQL + """
SELECT date_trunc('day', ts) AS bucket, round(avg(status_code), 6) AS avg_status_code, count(*) AS requests
FROM ai_requests GROUP BY 1""")
def _(t):
    return requests.status_over_time(t.ai_requests).withColumn("avg_status_code", F.round("avg_status_code", 6))


@query("f1_price_lookup", COSTS_SQL + """
SELECT request_id, CAST(input_rate AS DOUBLE) AS input_rate, CAST(output_rate AS DOUBLE) AS output_rate, pricing_input, pricing_output FROM costs""")
def _(t):
    return cost.price_lookup(t.ai_requests, t.price_rates).select(
        "request_id", "input_rate", "output_rate", "pricing_input", "pricing_output")


@query("f2_request_cost", COSTS_SQL + """
SELECT request_id, round(input_cost, 10) AS input_cost, round(output_cost, 10) AS output_cost,
  round(total_cost, 10) AS total_cost, round(cached_savings, 10) AS cached_savings FROM costs""")
def _(t):
    return costs(t).select("request_id", *[r(c, 10) for c in ("input_cost", "output_cost", "total_cost", "cached_savings")])


@query("f3_period_spend", COSTS_SQL + """
SELECT request_id, date_trunc('week', ts) AS period_start,
  round(CAST(sum(CAST(total_cost AS DECIMAL(20,10))) OVER (PARTITION BY provider, model, date_trunc('week', ts) ORDER BY ts, request_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE), 9) AS spent FROM costs""")
def _(t):
    return cost.period_spend(costs(t), "weekly").select("request_id", "period_start", r("spent", 9))


@query("f4_budget_status", COSTS_SQL + """, s AS (SELECT request_id,
  CAST(sum(CAST(total_cost AS DECIMAL(20,10))) OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS d,
  CAST(sum(CAST(total_cost AS DECIMAL(20,10))) OVER (PARTITION BY date_trunc('week', ts) ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS w,
  CAST(sum(CAST(total_cost AS DECIMAL(20,10))) OVER (PARTITION BY date_trunc('month', ts) ORDER BY ts, request_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS m
  FROM costs)
SELECT request_id, round(d, 9) AS daily_spent, round(w, 9) AS weekly_spent, round(m, 9) AS monthly_spent,
  round(greatest(0.0, 10.0 - d), 9) AS daily_remaining, round(d / 10.0 * 100, 8) AS percentage_used,
  CASE WHEN d / 10.0 * 100 >= 100 THEN 'exceeded' WHEN d / 10.0 * 100 >= 90 THEN 'warning_90' WHEN d / 10.0 * 100 >= 75 THEN 'warning_75'
       WHEN d / 10.0 * 100 >= 50 THEN 'warning_50' ELSE 'normal' END AS alert_level FROM s""")
def _(t):
    out = cost.budget_status(costs(t), {"daily": 10.0, "weekly": 50.0, "monthly": 150.0})
    return out.select("request_id", *[r(f"{p}_spent", 9) for p in ("daily", "weekly", "monthly")],
                      r("daily_remaining", 9), r("percentage_used", 8), "alert_level")


@query("f5_cost_by_allocation", COSTS_SQL + """
SELECT 'team' AS dimension, team AS value, round(sum(total_cost), 9) AS total_cost, count(*) AS requests FROM costs WHERE team IS NOT NULL GROUP BY 2
UNION ALL SELECT 'project', project, round(sum(total_cost), 9), count(*) FROM costs GROUP BY 2""")
def _(t):
    return cost.cost_by_allocation(costs(t), ["team", "project"]).withColumn("total_cost", F.round("total_cost", 9))


@query("f6_roi_facts", COSTS_SQL + """
SELECT request_id, round(CASE WHEN total_cost > 0 THEN business_value / total_cost ELSE 0 END, 4) AS roi_ratio FROM costs""")
def _(t):
    return cost.roi_facts(costs(t)).select("request_id", r("roi_ratio", 4))


@query("f7_roi_summary", COSTS_SQL + """
SELECT provider, round(sum(total_cost), 9) AS total_cost, round(sum(business_value), 4) AS total_value,
  count(*) FILTER (WHERE conversion) AS conversions, round(sum(business_value) / sum(total_cost), 6) AS roi_ratio,
  round(count(*) FILTER (WHERE conversion) / count(*), 6) AS conversion_rate,
  round(sum(total_cost) / count(*) FILTER (WHERE conversion), 6) AS avg_cost_per_conversion FROM costs GROUP BY provider""")
def _(t):
    return cost.roi_summary(costs(t), ["provider"]).select(
        "provider", r("total_cost", 9), r("total_value", 4), "conversions", r("roi_ratio"), r("conversion_rate"), r("avg_cost_per_conversion"))


@query("f8_usage_pattern", REQ_SQL + """
SELECT request_id, CAST(hour(ts) AS INT) AS hour_of_day, CAST(isodow(ts) - 1 AS INT) AS day_of_week, hour(ts) BETWEEN 9 AND 17 AS is_peak FROM ai_requests""")
def _(t):
    return cost.usage_pattern(t.ai_requests).select("request_id", "hour_of_day", "day_of_week", "is_peak")


EARLIER = "PARTITION BY provider ORDER BY epoch_us(ts) RANGE BETWEEN {us} PRECEDING AND 1 PRECEDING"


@query("f9_request_frequency", REQ_SQL + f""", n AS (
SELECT request_id, count(*) OVER ({EARLIER.format(us=59_999_999)}) AS recent_requests FROM ai_requests)
SELECT request_id, recent_requests, CASE WHEN recent_requests > 100 THEN 'very_high' WHEN recent_requests > 50 THEN 'high'
  WHEN recent_requests > 10 THEN 'medium' ELSE 'low' END AS request_frequency FROM n""")
def _(t):
    return cost.request_frequency(t.ai_requests, ["provider"]).select("request_id", "recent_requests", "request_frequency")


HOUR = EARLIER.format(us=3_599_999_999)


@query("f10_cost_forecast", COSTS_SQL + f""", h AS (
SELECT request_id, avg(total_cost) OVER ({HOUR}) AS a, count(*) OVER ({HOUR}) AS n,
  row_number() OVER (PARTITION BY provider ORDER BY ts, request_id) - 1 AS seen FROM costs)
SELECT request_id, n AS requests_last_hour,
  round(CASE WHEN seen >= 10 AND n > 0 THEN a * n * 24 ELSE 0 END, 8) AS predicted_daily_cost,
  round(CASE WHEN seen >= 10 AND n > 0 THEN a * n * 24 * 30 ELSE 0 END, 7) AS predicted_monthly_cost FROM h""")
def _(t):
    return cost.cost_forecast(costs(t), ["provider"]).select(
        "request_id", "requests_last_hour", r("predicted_daily_cost", 8), r("predicted_monthly_cost", 7))


@query("f11_cost_trend", COSTS_SQL + f""", h AS (
SELECT request_id, list(total_cost) OVER (PARTITION BY provider ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS c FROM costs),
s AS (SELECT request_id, coalesce(len(c), 0) AS n, list_sum(c[1:len(c) // 2]) AS a, list_sum(c[len(c) // 2 + 1:]) AS b FROM h)
SELECT request_id, CAST(n AS BIGINT) AS requests_last_hour, CASE WHEN n < 2 THEN NULL WHEN b > a * 1.2 THEN 'increasing' WHEN b < a * 0.8 THEN 'decreasing' ELSE 'stable' END AS trend FROM s""")
def _(t):
    return cost.cost_trend(costs(t), ["provider"]).select("request_id", "requests_last_hour", "trend")


@query("f12_cost_anomaly", COSTS_SQL + f""", h AS (
SELECT request_id, total_cost, avg(total_cost) OVER ({HOUR}) AS a, stddev_pop(total_cost) OVER ({HOUR}) AS s, count(*) OVER ({HOUR}) AS n FROM costs),
z AS (SELECT request_id, CASE WHEN n >= 5 THEN abs(total_cost - a) / CASE WHEN s > 0 THEN s ELSE 1 END ELSE 0 END AS z FROM h)
SELECT request_id, round(least(1.0, z / 3), 5) AS anomaly_score, z > 2 AS anomaly_detected FROM z""")
def _(t):
    return cost.cost_anomaly(costs(t), ["provider"]).select("request_id", r("anomaly_score", 5), "anomaly_detected")


@query("f13_cost_summary", COSTS_SQL + f""", p AS (
  SELECT 'daily' AS period, * FROM costs WHERE ts <= TIMESTAMP '{AS_OF}' AND date_trunc('day', ts) = date_trunc('day', TIMESTAMP '{AS_OF}')
  UNION ALL SELECT 'weekly', * FROM costs WHERE ts <= TIMESTAMP '{AS_OF}' AND date_trunc('week', ts) = date_trunc('week', TIMESTAMP '{AS_OF}')
  UNION ALL SELECT 'monthly', * FROM costs WHERE ts <= TIMESTAMP '{AS_OF}' AND date_trunc('month', ts) = date_trunc('month', TIMESTAMP '{AS_OF}')),
b AS (SELECT period, sum(total_cost) AS total, count(DISTINCT model) AS models,
  CASE period WHEN 'daily' THEN 1000.0 WHEN 'weekly' THEN 5000.0 ELSE 15000.0 END AS budget FROM p GROUP BY period)
SELECT period, round(total, 9) AS total, CAST(models AS INT) AS models, CAST(budget AS DOUBLE) AS budget, round(total / budget * 100, 6) AS percentage_used FROM b""")
def _(t):
    return cost.cost_summary(costs(t), AS_OF).select(
        "period", r("total", 9), F.size("by_model").alias("models"), "budget", r("percentage_used"))


@query("f14_optimization_recommendations", COSTS_SQL + """, m AS (SELECT model, sum(total_cost) AS c FROM costs GROUP BY model)
SELECT 'caching' AS type, 'high' AS priority, NULL AS model, round(avg(CAST(cache_hit AS INT)), 6) AS value FROM costs HAVING avg(CAST(cache_hit AS INT)) < 0.1
UNION ALL SELECT 'compression', 'medium', NULL, round(avg(CAST(prompt_compressed AS INT)), 6) FROM costs HAVING avg(CAST(prompt_compressed AS INT)) < 0.5
UNION ALL SELECT 'model_selection', 'medium', model, round(c, 9) FROM m WHERE c > 0.5 * (SELECT sum(c) FROM m)""")
def _(t):
    return cost.optimization_recommendations(costs(t)).withColumn(
        "value", F.when(F.col("type") == "model_selection", F.round("value", 9)).otherwise(F.round("value", 6)))


@query("f15_budget_alerts", COSTS_SQL + """, d AS (SELECT CAST(ts AS DATE) AS day, sum(total_cost) AS spent FROM costs GROUP BY 1),
x AS (SELECT day, spent, spent / 10.0 * 100 AS pct FROM d),
y AS (SELECT *, CASE WHEN pct >= 100 THEN 100 WHEN pct >= 90 THEN 90 WHEN pct >= 75 THEN 75 WHEN pct >= 50 THEN 50 END AS threshold FROM x)
SELECT day, 'budget_threshold' AS type, threshold, round(pct, 6) AS current_percentage,
  CASE WHEN threshold >= 100 THEN 'critical' ELSE 'warning' END AS severity, concat('Daily budget ', threshold, '% threshold reached') AS message,
  round(spent, 9) AS spent, CAST(10.0 AS DOUBLE) AS budget FROM y WHERE threshold IS NOT NULL""")
def _(t):
    return cost.budget_alerts(costs(t), 10.0).withColumns(
        {"current_percentage": F.round("current_percentage", 6), "spent": F.round("spent", 9)})


@query("f16_daily_cost_series", COSTS_SQL + """, d AS (SELECT CAST(ts AS DATE) AS day, sum(total_cost) AS c FROM costs GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
SELECT s.day, round(coalesce(c, 0), 9) AS total_cost FROM s LEFT JOIN d ON s.day = d.day""")
def _(t):
    return cost.daily_cost_series(costs(t)).withColumn("total_cost", F.round("total_cost", 9))


@query("f17_top_models_by_cost", COSTS_SQL + """
SELECT model, round(sum(total_cost), 9) AS total_cost FROM costs GROUP BY model ORDER BY sum(total_cost) DESC, model LIMIT 5""")
def _(t):
    return cost.top_models_by_cost(costs(t), 5).withColumn("total_cost", F.round("total_cost", 9))


@query("f18_savings_rollup", COSTS_SQL + """
SELECT provider, round(sum(cached_savings), 9) AS cached_savings, round(CAST(sum(fallback_savings) AS DOUBLE), 6) AS fallback_savings,
  round(avg(CAST(batch_used AS INT)), 6) AS batch_used_share, round(avg(CAST(prompt_compressed AS INT)), 6) AS prompt_compressed_share
FROM costs GROUP BY provider""")
def _(t):
    return cost.savings_rollup(costs(t), ["provider"]).select(
        "provider", r("cached_savings", 9), r("fallback_savings"), r("batch_used_share"), r("prompt_compressed_share"))
