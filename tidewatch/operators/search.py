"""Search-style queries and panel reductions (Q1-Q9)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.quantiles import exact_ranks
from tidewatch.functions.slices import null_safe_join

_UNITS = {"m": 60, "h": 3600, "d": 86400, "w": 604800}


def range_seconds(text: str) -> int:
    """Seconds of a range such as 24h or 7d."""
    found = re.fullmatch(r"(\d+)([mhdw])", text)
    if not found:
        raise ValueError(f"not a range: {text}")
    return int(found[1]) * _UNITS[found[2]]


def time_filter(df: DataFrame, span: str, as_of, ts: str = "ts") -> DataFrame:
    """Q1: rows from ``span`` before ``as_of`` on; the bound is a constant that the scan can use."""
    return df.where(F.col(ts) >= F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {range_seconds(span)} SECONDS"))


def search(df: DataFrame, predicate: Column | None = None, size: int = 100, sort: Sequence = ()) -> DataFrame:
    """Q2: the first ``size`` matching rows in the given order."""
    d = df if predicate is None else df.where(predicate)
    return (d.orderBy(*sort) if sort else d).limit(size)


def histogram_seconds(span: str) -> int:
    """Bucket width for a range: fixed values of the panel."""
    unit, n = span[-1], int(span[:-1])
    if unit == "h":
        return 300 if n <= 6 else 3600 if n <= 24 else 6 * 3600
    if unit == "d":
        return 6 * 3600 if n <= 7 else 86400 if n <= 30 else 7 * 86400
    return 3600


def date_histogram(df: DataFrame, span: str, ts: str = "ts", fill: bool = False) -> DataFrame:
    """Q3: rows per bucket (counted from the epoch); ``fill`` adds empty buckets between the first and the last."""
    width = histogram_seconds(span)
    bucket = F.timestamp_seconds((F.floor(F.unix_seconds(ts) / width) * width).cast("bigint"))
    d = df.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))
    if not fill:
        return d
    spine = d.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(
        F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {width} SECONDS"))).alias("bucket"))
    return spine.join(d, "bucket", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def terms(df: DataFrame, field: str, size: int = 50) -> DataFrame:
    """Q4: the most frequent values; null is left out."""
    d = df.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return d.orderBy(F.desc("rows"), "value").limit(size)


def metrics_summary(df: DataFrame, span: str, as_of, group_by: Sequence[str] = (), size: int = 50) -> DataFrame:
    """Q5: total, histogram and one block of the ``size`` most frequent terms per field as (block, key, rows).

    One scan and one grouping: every row counts once in each block.
    """
    width = histogram_seconds(span)
    bucket = F.timestamp_seconds((F.floor(F.unix_seconds("ts") / width) * width).cast("bigint"))
    blocks = {"total": F.lit(""), "histogram": F.date_format(bucket, "yyyy-MM-dd HH:mm:ss")} | {f"by_{f}": F.col(f).cast("string") for f in group_by}
    cells = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), k.alias("key")) for b, k in blocks.items()]))
    counts = time_filter(df, span, as_of).select(cells.alias("c")).select("c.*").where("key IS NOT NULL").groupBy("block", "key").agg(F.count(F.lit(1)).alias("rows"))
    # an empty range still has a total
    none = df.sparkSession.range(1).select(F.lit("total").alias("block"), F.lit("").alias("key"), F.lit(0).cast("bigint").alias("rows"))
    counts = counts.unionByName(none).groupBy("block", "key").agg(F.sum("rows").alias("rows"))
    by_rank = Window.partitionBy("block").orderBy(F.desc("rows"), "key")
    top = counts.where(F.col("block").startswith("by_")).withColumn("_rank", F.row_number().over(by_rank)).where(F.col("_rank") <= size).drop("_rank")
    return counts.where(~F.col("block").startswith("by_")).unionByName(top)


def count_documents(df: DataFrame, predicate: Column | None = None, name: str = "rows") -> DataFrame:
    """Q6: one row with the number of matching rows."""
    return (df if predicate is None else df.where(predicate)).agg(F.count(F.lit(1)).alias(name))


def aggregate_query(df: DataFrame, aggs: dict[str, Column], keys: Sequence = (), predicate: Column | None = None) -> DataFrame:
    """Q7: any named aggregations by any keys over the matching rows."""
    d = df if predicate is None else df.where(predicate)
    return d.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])


def reduce_series(series: DataFrame, keys: Sequence[str], ts: str = "t", value: str = "value", share: float = 0.95) -> DataFrame:
    """Q8: last, last not null, mean, max, min and 95th percentile (between the two nearest ranks) of each panel series."""
    v = F.col(value)
    plain = series.groupBy(*keys).agg(
        F.max_by(v, F.when(v.isNotNull(), F.col(ts))).alias("last_not_null"), F.max_by(v, F.col(ts)).alias("last"),
        F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.count(v).alias("_n"))
    place = lambda n: (n - 1) * F.lit(share)
    ranks = exact_ranks(series, keys, value, {"_below": lambda n: F.floor(place(n)), "_above": lambda n: F.ceil(place(n))})
    between = F.col("_below") + (F.col("_above") - F.col("_below")) * (place(F.col("_n")) - F.floor(place(F.col("_n"))))
    # a percentile of finite values does not turn into NaN between two equal infinities
    p95 = F.when(F.col("_below") == F.col("_above"), F.col("_below")).otherwise(between)
    return null_safe_join(plain, ranks, keys, "left").withColumn("p95", p95).drop("_n", "_below", "_above")


def monitoring_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """Q9: one report row; every part is a single-row frame and becomes a struct of its name, null where a part has no row."""
    out = None
    for name, part in parts.items():
        row = part.select(F.struct(*part.columns).alias(name))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out.agg(*[F.first(name, ignorenulls=True).alias(name) for name in parts])
