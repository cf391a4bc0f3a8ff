"""Technical facts of AI requests: latency, errors, throughput, thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.quantiles import exact_quantiles
from tidewatch.functions.slices import null_safe_join

MODEL_KEYS = ("provider", "model")

# Warning and critical limits; milliseconds, error rate in per cent.
THRESHOLDS = (
    ("p50", 500.0, 1000.0),
    ("p95", 2000.0, 5000.0),
    ("p99", 5000.0, 10000.0),
    ("error_rate", 1.0, 5.0),
)
# Accepted requests per minute.
MIN_REQUESTS_PER_MINUTE = 10
MAX_REQUESTS_PER_MINUTE = 10000

QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def request_facts(requests: DataFrame) -> DataFrame:
    """Total tokens and tokens per second (0 when there is no latency); other fields pass through."""
    total = F.col("input_tokens") + F.col("output_tokens")
    seconds = F.col("latency_ms") / F.lit(1000.0)
    return requests.withColumns({
        "tokens_total": total,
        "tokens_per_second": F.when(F.col("latency_ms") > 0, total / seconds).otherwise(F.lit(0.0)),
    })


def _scoped(requests: DataFrame, keys: Sequence[str], window: str | None) -> tuple[DataFrame, list[str]]:
    if window is None:
        return requests, list(keys)
    return requests.withColumn("window_start", F.window("ts", window)["start"]), [*keys, "window_start"]


def latency_percentiles(
    requests: DataFrame, keys: Sequence[str] = MODEL_KEYS, window: str | None = None, approximate: bool = False,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """p50, p95, p99 at 0-based rank floor(n*p), and min, max, mean, count per group and window.

    Exact by default; ``approximate`` uses the mergeable sketch instead, one shuffle for any group size.
    Without keys the single row of an empty input holds zeros. ``also`` adds aggregates to the same grouping.
    """
    d, by = _scoped(requests, keys, window)
    stats = [
        F.min("latency_ms").alias("min"), F.max("latency_ms").alias("max"),
        F.avg("latency_ms").alias("avg"), F.count("latency_ms").alias("count"), *[c.alias(n) for n, c in (also or {}).items()],
    ]
    if approximate:
        sketch = [F.percentile_approx("latency_ms", p, 10000).alias(n) for n, p in QUANTILES.items()]
        out = d.groupBy(*by).agg(*sketch, *stats)
    elif by:
        out = null_safe_join(d.groupBy(*by).agg(*stats), exact_quantiles(d, by, "latency_ms", QUANTILES), by)
    else:
        out = d.agg(*stats).join(exact_quantiles(d, [], "latency_ms", QUANTILES), how="left")
    zero = {n: F.coalesce(F.col(n), F.lit(0.0)) for n in ("p50", "p95", "p99", "min", "max", "avg")}
    return out.withColumns(zero).select(*by, "p50", "p95", "p99", "min", "max", "avg", "count", *(also or {}))


def latency_sketches(requests: DataFrame, keys: Sequence[str] = MODEL_KEYS, window: str = "1 minute", k: int = 400) -> DataFrame:
    """T2 for long spans: a KLL sketch of the latencies of each group and window, with count, sum, least and largest.

    A table of these is what to keep by day: sketches of any windows merge into those of longer ones, and the requests need
    not be read again. With k of 400 a quantile lies within about half a per cent of its rank.
    """
    d, by = _scoped(requests.where(F.col("latency_ms").isNotNull()), keys, window)
    v = F.col("latency_ms").cast("double")
    return d.groupBy(*by).agg(
        F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"), F.count(v).alias("count"), F.sum(v).alias("total"), F.min(v).alias("min"), F.max(v).alias("max"))


def merge_sketches(sketches: DataFrame, keys: Sequence[str] = MODEL_KEYS, window: str | None = None, k: int = 400) -> DataFrame:
    """Sketches of short windows merged into ``window``, or into one for each group of keys."""
    d, by = _scoped(sketches.withColumnRenamed("window_start", "ts"), keys, window)
    return d.groupBy(*by).agg(
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("count").alias("count"), F.sum("total").alias("total"),
        F.min("min").alias("min"), F.max("max").alias("max"))


def sketched_percentiles(sketches: DataFrame) -> DataFrame:
    """The percentiles of stored sketches in the form of ``latency_percentiles``, within the rank error of the sketch."""
    by = [c for c in sketches.columns if c not in ("sketch", "count", "total", "min", "max")]
    of = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(n) for n, p in QUANTILES.items()]
    return sketches.select(*by, *of, "min", "max", (F.col("total") / F.col("count")).alias("avg"), "count")


def _error_rate() -> dict[str, Column]:
    n = F.count(F.lit(1))
    errors = F.count_if(F.col("status") != "success")
    return {"requests": n, "errors": errors, "error_rate": F.when(n > 0, F.lit(100.0) * errors / n).otherwise(F.lit(0.0))}


def error_rate(requests: DataFrame, keys: Sequence[str] = MODEL_KEYS, window: str | None = None) -> DataFrame:
    """Per cent of requests whose status is not success; 0 where there are none."""
    d, by = _scoped(requests, keys, window)
    return d.groupBy(*by).agg(*[c.alias(n) for n, c in _error_rate().items()])


def windowed_requests(requests: DataFrame, window: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """T4: tumbling event-time windows per model; the same body serves a table and a stream (with a watermark)."""
    d = requests.withWatermark("ts", watermark) if watermark else requests
    return d.groupBy(*MODEL_KEYS, F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") != "success").alias("errors"),
        F.sum("latency_ms").alias("latency_sum"),
        F.min("latency_ms").alias("latency_min"),
        F.max("latency_ms").alias("latency_max"),
    ).select(*MODEL_KEYS, F.col("w.start").alias("window_start"), "requests", "errors",
             "latency_sum", "latency_min", "latency_max")


def violations_of(thresholds: Sequence[tuple] = THRESHOLDS) -> Column:
    """The broken limits of a row of levels, at most one per metric: critical, else warning; both strict."""
    def row(metric: str, severity: str, limit: float) -> Column:
        kind = f"latency_{metric}_{severity}" if metric.startswith("p") else f"{metric}_{severity}"
        return F.struct(
            F.lit(kind).alias("type"), F.col(metric).alias("value"), F.lit(float(limit)).alias("threshold"), F.lit(severity).alias("severity"))

    found = [
        F.when(F.col(metric) > critical, row(metric, "critical", critical)).when(F.col(metric) > warning, row(metric, "warning", warning))
        for metric, warning, critical in thresholds
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def latency_violations(levels: DataFrame, keys: Sequence[str], thresholds: Sequence[tuple] = THRESHOLDS) -> DataFrame:
    """T5: one row per broken limit. Limits are part of the expression, so there is neither join nor shuffle."""
    return levels.select(*keys, F.explode(violations_of(thresholds)).alias("v")).select(*keys, "v.*")


def service_levels(
    requests: DataFrame, keys: Sequence[str] = MODEL_KEYS, window: str | None = None, also: dict[str, Column] | None = None
) -> DataFrame:
    """T2 and T3 from one grouping."""
    return latency_percentiles(requests, keys, window, also=_error_rate() | (also or {}))


def technical_summary(requests: DataFrame, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """One row per scope: percentiles, error rate, violations (at most four) and the age of its window."""
    age = F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))
    levels = service_levels(requests, keys, also={"window_age_us": age})
    return levels.withColumn("violations", F.array_sort(violations_of()))


def streaming_trace(chunks: DataFrame) -> DataFrame:
    """Timing of streamed answers from (request_id, kind start|chunk|end|exception, ts, tokens) rows."""
    def at(kind: str) -> Column:
        return F.when(F.col("kind") == kind, F.unix_micros("ts"))

    start = F.min(at("start"))
    last = F.max(F.when(F.col("kind").isin("end", "exception"), F.unix_micros("ts")))
    ms = F.lit(1000.0)
    return chunks.groupBy("request_id").agg(
        ((F.min(at("chunk")) - start) / ms).alias("ttft_ms"),
        ((F.max(at("chunk")) - start) / ms).alias("last_chunk_ms"),
        F.count_if(F.col("kind") == "chunk").alias("chunks_count"),
        ((last - start) / ms).alias("total_ms"),
        F.coalesce(F.sum(F.when(F.col("kind") == "chunk", F.col("tokens"))), F.lit(0)).alias("tokens"),
        F.when(F.count_if(F.col("kind") == "exception") > 0, "error").otherwise("success").alias("status"),
    )


def requests_per_minute(
    requests: DataFrame, low: int = MIN_REQUESTS_PER_MINUTE, high: int = MAX_REQUESTS_PER_MINUTE
) -> DataFrame:
    """Requests per model and minute, flagged below ``low`` or above ``high``."""
    d, by = _scoped(requests, MODEL_KEYS, "1 minute")
    n = F.count(F.lit(1))
    return d.groupBy(*by).agg(
        n.alias("requests"), F.when(n < low, "low").when(n > high, "high").otherwise("normal").alias("throughput"),
    )


def latency_histogram(requests: DataFrame, width: int = 100) -> DataFrame:
    """Requests per latency band of ``width`` ms; empty bands are left out."""
    band = (F.floor(F.col("latency_ms") / F.lit(float(width))) * width).cast("bigint")
    return requests.groupBy(band.alias("latency_from")).agg(F.count(F.lit(1)).alias("requests"))


def status_over_time(requests: DataFrame, window: str = "1 day") -> DataFrame:
    """Mean status code per time bucket."""
    return requests.groupBy(F.window("ts", window)["start"].alias("bucket")).agg(
        F.avg("status_code").alias("avg_status_code"), F.count(F.lit(1)).alias("requests")
    )
